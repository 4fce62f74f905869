r"""Personal data: pattern spans, and terms that corpus co-occurrence shows to reveal them. DataFrame expressions only.

Base kinds are found by pattern. For the method, every base kind k is a protected entity with information content
IC(k) = -log2 p(k), p(k) being the share of documents that hold one. A term t discloses k as far as their pointwise mutual
information reaches IC(k):

    disclosure(t, k) = log2(p(t, k) / (p(t) p(k))) / IC(k)        1: whoever reads t knows of k; 0: t says nothing

p(t, k) is the share of documents that hold an entity of kind k and, outside all base spans, the term t; p(t) the share that
hold t. All of them are exact counts of rows over the whole corpus. A term counts only where it stands with SUPPORT different
entities of the kind (a document stands for the least of its entities), so that copies of one document prove nothing, however
many there are. Terms are words in lower case; a word with a digit in it is rare by itself and counts by its shape: digits as
0, and where it holds letters too, letters and digits alike as x.

In documents that hold an entity of kind k, terms at REMOVE or above are removed and terms at GENERALISE or above, which give
away half of what there is to know, give way to their class (<NAME>, <NUMBER>, <WORD>).

The patterns are possessive forms, in linear time, of those that the kinds are defined by: a match starts where the
run of its first character class does, or where the last match ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, barrier, few

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these hold no span of the kind.
NEEDED = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
SUPPORT, GENERALISE, REMOVE = 6, 0.5, 0.95
#: Shorter words are no terms.
LEAST = 3
#: Characters at which terms end, besides white space.
EDGES = r"""\x20\x09-\x0D.,;:!?"'()\[\]{}<>|"""
_SPAN = "struct<start:int,end:int,text:string>"


def running(values: str, both: str) -> str:
    """SQL for what the elements before each element of an array of ints fold to, from 0; both is SQL of the fold so far, b.n, and x.

    Results gather in runs of 256, so that a text with very many matches doesn't copy one growing array at each.
    """
    inner = f"aggregate(slice({values}, 256 * r + 1, 256), named_struct('n', a.n, 'out', CAST(array() AS array<int>)), (b, x) -> named_struct('n', {both}, 'out', array_append(b.out, b.n)))"
    runs = f"sequence(0, CAST((size({values}) - 1) / 256 AS int))"
    last = f"transform(array({inner}), c -> named_struct('n', c.n, 'out', array_append(a.out, c.out)))[0]"
    return f"IF(size({values}) = 0, CAST(array() AS array<int>), aggregate({runs}, named_struct('n', 0, 'out', CAST(array() AS array<array<int>>)), (a, r) -> {last}, a -> flatten(a.out)))"


TOTAL, MOST = "b.n + x", "greatest(b.n, x)"


def _matches(df: DataFrame, text: str, pattern: Column, needed: Column, out: str) -> DataFrame:
    """Adds `out`: the spans (code points, end exclusive) of all leftmost non-overlapping matches."""
    none = F.array().cast("array<string>")
    df = df.withColumns({"_m": F.when(needed, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none), "_g": F.when(needed, F.split(text, pattern, -1)).otherwise(none)})
    df = df.withColumn("_len", F.expr("transform(_m, (x, i) -> length(x) + length(get(_g, i)))"))
    df = df.withColumn("_at", F.expr(running("_len", TOTAL)))
    span = "named_struct('start', get(_at, i) + length(get(_g, i)), 'end', get(_at, i) + length(get(_g, i)) + length(x), 'text', x)"
    return df.withColumn(out, F.expr(f"transform(_m, (x, i) -> {span})").cast(f"array<{_SPAN}>")).drop("_m", "_g", "_len", "_at")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + transform(array(CAST(substring(d, length(d) - i + 1, 1) AS int) * IF(i % 2 = 0, 2, 1)), v -> IF(v > 9, v - 9, v))[0]) % 10 = 0"
)
VALID = {
    "email": "true",
    "ip": "forall(split(x.text, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', substring(ltrim('0', p), 1, 3)) AS int) <= 255)",
    "card": f"transform(array({_digits('x.text')}), d -> length(d) BETWEEN 16 AND 19 AND {_LUHN})[0]",
    "phone": f"length({_digits('x.text')}) BETWEEN 8 AND 15",
}


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds a column of spans for each kind."""
    for kind in KINDS:
        df = _matches(df, text, F.lit(PATTERNS[kind]), F.col(text).rlike(NEEDED[kind]), f"_{kind}")
        df = df.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, x -> {VALID[kind]})"))
    return df


def term_of(word: str) -> str:
    """SQL for a word's term."""
    return f"transform(array(lower({word})), w -> CASE WHEN NOT w RLIKE '[0-9]' THEN w WHEN w RLIKE '\\\\p{{L}}' THEN regexp_replace(w, '[\\\\p{{L}}0-9]', 'x') ELSE regexp_replace(w, '[0-9]', '0') END)[0]"


def _marks() -> Column:
    """All base spans of a row, in order."""
    return F.expr("array_sort(concat(" + ", ".join(f"transform(_{k}, x -> named_struct('start', x.start, 'side', 0, 'end', x.end, 'text', '<{k.upper()}>'))" for k in KINDS) + "))")


def with_words(found: DataFrame, text: str) -> DataFrame:
    """Adds _words: the words of LEAST characters or more that no base span touches, as (start, end, text).

    Spans and words are sorted together, so a word looks at the furthest end before it and at the next entry only.
    """
    edges = F.lit(f"[{EDGES}]+")
    df = found.withColumns({"_w": F.split(text, edges, -1), "_g": F.regexp_extract_all(text, edges, F.lit(0))})
    # Arrays are zipped: one that a lambda merely refers to may be written out in it, and computed again for each element.
    df = df.withColumn("_len", F.expr("zip_with(_w, _g, (x, g) -> length(x) + coalesce(length(g), 0))"))
    df = df.withColumn("_at", F.expr(running("_len", TOTAL)))
    own = f"filter(zip_with(_w, _at, (x, a) -> named_struct('start', a, 'side', 1, 'end', a + length(x), 'text', x)), x -> x.end - x.start >= {LEAST})"
    df = df.withColumn("_both", F.array_sort(F.concat(_marks(), F.expr(own))))
    df = df.withColumn("_ends", F.expr("transform(_both, x -> IF(x.side = 0, x.end, 0))")).withColumn("_far", F.expr(running("_ends", MOST)))
    df = df.withColumn("_z", F.expr("arrays_zip(_both, _far, slice(_both, 2, greatest(size(_both), 1)))").cast("array<struct<x:struct<start:int,side:int,end:int,text:string>,far:int,y:struct<start:int,side:int,end:int,text:string>>>"))
    free = "z.x.side = 1 AND z.far <= z.x.start AND NOT coalesce(z.y.side = 0 AND z.y.start < z.x.end, false)"
    return df.withColumn("_words", F.expr(f"transform(filter(_z, z -> {free}), z -> named_struct('start', z.x.start, 'end', z.x.end, 'text', z.x.text))")).drop("_w", "_g", "_len", "_at", "_both", "_ends", "_far", "_z")


def disclosing_terms(tables: Tables, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, term, disclosure) of the terms at GENERALISE or above.

    found: the rows with base spans (has: their kinds, _words and the spans by kind). texts: all rows (text).
    """
    least = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.xxhash64(F.array_min(F.transform(f"_{k}", lambda s: s["text"]))))])
    lines = found.select("has", least.alias("least"), F.expr(f"array_distinct(transform(_words, x -> {term_of('x.text')}))").alias("terms"))
    lines = lines.select(F.explode("has").alias("kind"), "least", "terms").select("kind", F.element_at("least", F.col("kind")).alias("entity"), F.explode("terms").alias("term"))
    # Both aggregations combine before their shuffle: by (kind, term, entity), then over entities.
    pairs = lines.groupBy("kind", "term", "entity").agg(F.count(F.lit(1)).alias("n")).groupBy("kind", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("support"))
    pairs = tables.write(pairs.where(F.col("support") >= SUPPORT).select("kind", "term", "both"), "pairs")
    wanted = tables.write(pairs.select("term").distinct(), "terms")
    if wanted.isEmpty():
        return pairs.select("kind", "term", F.lit(0.0).alias("disclosure"))
    total = texts.count()
    kinds = {r["kind"]: r["n"] for r in found.select(F.explode("has").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = texts.select(F.split("text", f"[{EDGES}]+").alias("_w"))
    each = each.select(F.explode(F.array_distinct(F.expr(f"transform(filter(_w, x -> length(x) >= {LEAST}), x -> {term_of('x')})"))).alias("term"))
    each = each.join(F.broadcast(wanted), "term", "left_semi") if few(wanted) else each
    freq = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    p_kind = F.element_at(F.create_map(*[F.lit(x) for k, c in kinds.items() for x in (k, c / max(total, 1))]), F.col("kind"))
    scored = pairs.join(freq, "term").withColumn("ic", -F.log2(p_kind)).where("ic > 0")
    scored = scored.withColumn("disclosure", (F.log2(F.col("both") / F.col("df")) + F.col("ic")) / F.col("ic"))
    out = tables.write(scored.where(F.col("disclosure") >= GENERALISE).select("kind", "term", "disclosure"), "disclosing")
    tables.drop(pairs, wanted)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, `carry`, spans by kind and the sanitised text for every row of docs.

    Columns email, ip, card, phone, term: arrays of (start, end, text), code points, end exclusive, ordered by start;
    sanitised: the text with base spans replaced by <EMAIL> and so on, and terms generalised or removed. Spans that
    overlap are replaced together, by the tag of the first. A null text counts as empty: no spans, and null stays
    null. Rows are the unit of all counts: rows that repeat count as often as they stand there, so repeating every row
    changes nothing, and rows of one text fare alike. Ids may be null or repeat; nothing is joined by them. Terms tied at a
    threshold are all above it. An empty table gives no rows. Columns of docs not named are not read.

    Rows without spans hold no terms either: they pass as they are. Only the others are written down and meet the terms, by
    a row number of their own.
    """
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("_id"), (F.struct(*[F.col(c) for c in carry]) if carry else F.lit(0)).alias("_carry"), F.col(text_col).alias("_t"))
    spans = base_spans(own, "_t")
    has = F.filter(F.array(*[F.when(F.size(f"_{k}") > 0, F.lit(k)) for k in KINDS]), lambda x: x.isNotNull())
    spans = spans.withColumn("has", has).withColumn("any", barrier(F.size("has") > 0))
    found = spans.where("any").select(F.monotonically_increasing_id().alias("row"), "_id", "_carry", "_t", "has", *[f"_{k}" for k in KINDS])
    spanned = tables.write(found, "spanned")
    found = tables.write(with_words(spanned, "_t"), "found")
    tables.drop(spanned)
    flagged = disclosing_terms(tables, found, own.select(F.col("_t").alias("text")))
    words = found.select("row", "has", F.explode("_words").alias("x")).select("row", "has", "x.*").withColumn("term", F.expr(term_of("text")))
    hits = words.join(F.broadcast(flagged) if few(flagged) else flagged, "term").where(F.array_contains("has", F.col("kind")))
    hits = hits.groupBy("row", "start").agg(F.first("end").alias("end"), F.first("text").alias("text"), F.max("disclosure").alias("d"))
    tag = F.when(F.col("d") >= REMOVE, "").when(F.col("text").rlike("[0-9]"), "<NUMBER>").when(F.col("text").rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", tag.alias("tag")))).alias("_hits"))  # at most a text's own words
    held = found.drop("_words").join(hits, "row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<struct<start:int,end:int,text:string,tag:string>>")))
    held = held.withColumn("_m", F.array_sort(F.concat(_marks(), F.expr("transform(_hits, x -> named_struct('start', x.start, 'side', 0, 'end', x.end, 'text', x.tag))"))))
    held = held.withColumn("_ends", F.expr("transform(_m, x -> x.end)")).withColumn("_far", F.expr(running("_ends", MOST)))
    pieces = "filter(zip_with(_m, _far, (x, far) -> IF(x.start >= far, concat(substring(_t, far + 1, x.start - far), x.text), NULL)), x -> x IS NOT NULL)"
    held = held.withColumn("_sanitised", F.expr(f"concat(array_join({pieces}, ''), substring(_t, array_max(_ends) + 1))"))
    held = held.withColumn("_term", F.expr("transform(_hits, x -> named_struct('start', x.start, 'end', x.end, 'text', x.text))"))
    none = F.array().cast(f"array<{_SPAN}>")
    rest = spans.where("NOT any").select("_id", "_carry", *[none.alias(f"_{k}") for k in (*KINDS, "term")], F.col("_t").alias("_sanitised"))
    out = rest.unionByName(held.select(rest.columns))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_carry.{c}").alias(c) for c in carry], *[F.col(f"_{k}").alias(k) for k in (*KINDS, "term")], F.col("_sanitised").alias("sanitised"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.concat(*[F.expr(f"transform({k}, x -> concat_ws(':', '{k}', x.start, x.end))") for k in kinds]), ",")
