"""Text rules, candidate forms, reference vocabularies and overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import text as T


def check_rules(rules: list[dict]) -> list[str]:
    """Problems of rules [{pattern, replacement}]: empty or bad patterns, and references other than a leading "$1 "."""
    out = []
    for i, r in enumerate(rules):
        if not r.get("pattern"):
            out.append(f"rule {i}: empty pattern")
            continue
        try:
            re.compile(r["pattern"])
        except re.error as e:
            out.append(f"rule {i}: {e}")
        if "$" in re.sub(r"^\$1 ", "", r.get("replacement") or ""):
            out.append(f"rule {i}: reference in replacement")
    return out


def apply_rules(texts: DataFrame, rules: list[dict], column: str = "text") -> DataFrame:
    """Rewrites by each rule in turn, on the text as the rules before left it; adds fired: matches of each rule.

    Rules are a review's short list, so the cascade is one projection after another and stays in the JVM.
    """
    out = texts.withColumn("_t", F.col(column))
    counts = []
    for i, r in enumerate(rules):
        out = out.withColumn(f"_n{i}", F.regexp_count("_t", F.lit(r["pattern"])))
        out = out.withColumn("_t", F.regexp_replace("_t", r["pattern"], r["replacement"]))
        counts.append(F.col(f"_n{i}"))
    out = out.withColumn("fired", F.array(*counts).cast("array<int>") if counts else F.array().cast("array<int>"))
    return out.withColumn(column, F.col("_t")).drop("_t", *[f"_n{i}" for i in range(len(rules))])


def rule_totals(fired: DataFrame, rules: list[dict]) -> DataFrame:
    """(pattern, count): rules that share a pattern share a count."""
    names = F.array(*[F.lit(r["pattern"]) for r in rules])
    own = fired.select(F.posexplode("fired").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    return own.withColumn("pattern", F.element_at(names, F.col("i") + 1)).groupBy("pattern").agg(F.sum("n").alias("count"))


def dead_rules(texts: DataFrame, rules: list[dict]) -> DataFrame:
    """(pattern,) of rules that match in no text: one pass that says of every rule whether it fired anywhere."""
    spark = texts.sparkSession
    names = spark.createDataFrame([(r["pattern"],) for r in rules], "pattern string").distinct()
    hits = texts.agg(*[F.coalesce(F.bool_or(F.col("text").rlike(r["pattern"])), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)])
    live = hits.select(F.explode(F.array(*[F.when(F.col(f"r{i}"), F.lit(r["pattern"])) for i, r in enumerate(rules)])).alias("pattern"))
    return names.join(live, "pattern", "left_anti")


def derive_base(form: Column) -> Column:
    """A replacement without its leading "$1 " and possessive."""
    return F.regexp_replace(F.regexp_replace(form, r"^\$1 ", ""), "'s$", "")


def gates(texts: DataFrame, reference: DataFrame, rules: list[dict]) -> DataFrame:
    """(pattern, problem): left side still there, right side missing, right side not in the reference. One pass over each input."""
    bases = [re.sub("'s$", "", re.sub(r"^\$1 ", "", r["replacement"])) for r in rules]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    used = texts.agg(*[x for i, (r, base) in enumerate(zip(rules, bases, strict=True)) for x in (total(F.regexp_count("text", F.lit(r["pattern"]))).alias(f"l{i}"), total(T.occurrences(F.col("text"), base)).alias(f"r{i}"))])
    attested = reference.agg(*[total(T.occurrences(F.col("text"), base)).alias(f"a{i}") for i, base in enumerate(bases)])
    found = [
        F.when(broken, F.struct(F.lit(r["pattern"]).alias("pattern"), F.lit(problem).alias("problem")))
        for i, r in enumerate(rules)
        for broken, problem in ((F.col(f"l{i}") > 0, "left_remains"), (F.col(f"r{i}") == 0, "right_missing"), (F.col(f"a{i}") == 0, "right_unattested"))
    ]
    both = used.join(F.broadcast(attested), F.lit(True))  # one row each
    return both.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.pattern", "x.problem")


CAPITAL = r"^\p{Lu}|'\p{Lu}"
TOKEN = r"\p{L}+(?:['’]\p{L}+)*"


def token_table(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, i, token, start, capital, initial, joined): words with word-internal apostrophes. start counts code points; initial
    words begin a sentence; joined ones follow the one before after a single space."""
    own = texts.select(key, T.fold_apostrophe(F.coalesce(F.col(column), F.lit(""))).alias("_t"))
    own = own.select(key, F.regexp_extract_all("_t", F.lit(f"({TOKEN})"), F.lit(1)).alias("_w"), F.split("_t", TOKEN, -1).alias("_g"))
    rows = own.select(key, F.posexplode(F.arrays_zip(F.col("_w").alias("token"), F.slice("_g", 1, F.greatest(F.size("_w"), F.lit(1))).alias("gap"))).alias("i", "x")).where("x.token IS NOT NULL")
    w = Window.partitionBy(key).orderBy("i")
    upto = F.sum(F.length("x.gap") + F.length("x.token")).over(w)
    initial = (F.col("i") == 0) | F.col("x.gap").rlike(r'[.!?…]["”’)\]]*\s*["“‘(\[]*$|\n')
    return rows.select(key, "i", F.col("x.token").alias("token"), (upto - F.length("x.token")).alias("start"), F.col("x.token").rlike(r"^\p{Lu}|'\p{Lu}").alias("capital"), initial.alias("initial"), ((F.col("i") > 0) & (F.col("x.gap") == " ")).alias("joined"))


def capital_runs(tokens: DataFrame, key: str, common: DataFrame | None = None) -> DataFrame:
    """(key, first, words): islands of capital tokens joined by single spaces, not begun by a sentence's first word or a common one."""
    w = Window.partitionBy(key).orderBy("i")
    own = tokens.where("capital")
    if common is not None:
        known = common.select(F.lower(F.col(common.columns[0])).alias("_c")).distinct()
        own = own.join(F.broadcast(known), F.lower("token") == F.col("_c"), "left").withColumn("initial", F.col("initial") | F.col("_c").isNotNull()).drop("_c")
    own = own.where("NOT initial")
    new = F.coalesce((~F.col("joined") | (F.col("i") != F.lag("i").over(w) + 1)).cast("int"), F.lit(1))
    own = own.withColumn("_n", new).withColumn("_k", F.sum("_n").over(w))
    runs = own.groupBy(key, "_k").agg(F.min("i").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("words"))
    return runs.drop("_k")


def phrases(runs: DataFrame, key: str) -> DataFrame:
    """(key, form): adjacent pairs of a run, and the three words of a run of exactly three."""
    pairs = "IF(size(words) < 2, array(), transform(sequence(0, size(words) - 2), i -> concat(get(words, i), ' ', get(words, i + 1))))"
    three = "IF(size(words) = 3, array(array_join(words, ' ')), array())"
    return runs.select(key, F.explode(F.expr(f"concat(CAST({pairs} AS array<string>), CAST({three} AS array<string>))")).alias("form"))


def candidates(texts: DataFrame, key: str, common: DataFrame, least_single: int = 3, least_phrase: int = 2) -> DataFrame:
    """(form, count, chapters, kind, rank): names by capitals, phrases before single words, each kind ranked and capped by its
    report size; singles are words of a run that no common-word list has. Only names inside sentences; name_candidates has the
    whole of the heuristics."""
    runs = capital_runs(token_table(texts, key), key, common)
    ph = phrases(runs, key).withColumn("kind", F.lit("phrase"))
    single = runs.select(key, F.explode("words").alias("form")).where(F.length("form") >= 3).withColumn("kind", F.lit("single"))
    own = ph.unionByName(single).groupBy("kind", "form").agg(F.count(F.lit(1)).alias("count"), F.count_distinct(key).alias("chapters"))
    own = own.where(F.col("count") >= F.when(F.col("kind") == "phrase", least_phrase).otherwise(least_single))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "form")))
    return ranked.where(F.col("rank") <= F.when(F.col("kind") == "phrase", C.PHRASE_CAP).otherwise(C.SINGLE_CAP))


def name_candidates(texts: DataFrame, key: str, common: DataFrame, least_single: int = 2, least_novel: int = 3) -> DataFrame:
    """(form, count, non_initial, chapters, kind, rank, truncated): likely names and invented terms, by four heuristics.

    Phrases: pairs and exact threes of capital runs, however rare; a common word that opens a sentence is cut off a run. Singles:
    capital words used least_single times inside sentences, or least_novel times anywhere if `common` lacks them. Lower-case
    words that spell an included single, or that `common` lacks and that are used least_novel times. Lower-case windows of two
    or three words that spell an included phrase, or an included single without the spaces. Phrases are ranked by count, singles
    that `common` lacks first; each kind is cut at its report size, and truncated is the number of forms cut off in all.

    Words, runs and windows are found inside each text's row, and only forms and their counts move. A text without a key counts
    as no chapter.
    """
    known = F.broadcast(common.select(F.lower(F.col(common.columns[0])).alias("_c")).distinct())
    # The text's first word follows a line break too, so that it begins a sentence like others.
    own = texts.select(key, F.concat(F.lit("\n"), T.fold_apostrophe(F.coalesce(F.col("text"), F.lit("")))).alias("_t"))
    again = not texts.groupBy(key).count().where("count > 1").isEmpty()
    found = lambda pattern, group=0: F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))

    # A word's uses (0), the chapters it is in (1) and its uses as a sentence's first word with a capital (2) are stretches of one
    # list, so that tasks add them up before they send anything.
    words = own.select(key, found(_WORD).alias("_w"), found(_OPENING, 1).alias("_i")).withColumn("_d", F.expr(f"IF(`{key}` IS NULL, slice(_w, 1, 0), array_distinct(_w))"))
    uses = words.select(key, F.size("_w").alias("_a"), (F.size("_w") + F.size("_d")).alias("_b"), F.posexplode(F.concat("_w", "_d", "_i")).alias("_p", "form"))
    uses = uses.select(key, "form", F.when(F.col("_p") < F.col("_a"), 0).when(F.col("_p") < F.col("_b"), 1).otherwise(2).alias("what"))
    chapters = F.count_distinct(F.when(F.col("what") == 1, F.col(key))) if again else F.count_if(F.col("what") == 1)
    each = _written(uses.groupBy("form").agg(F.count_if(F.col("what") == 0).alias("count"), F.count_if(F.col("what") == 2).alias("_i"), chapters.alias("chapters")), "words")
    each = each.withColumn("_f", F.lower("form")).join(known, F.col("_f") == F.col("_c"), "left")
    each = each.select("form", "count", (F.col("count") - F.col("_i")).alias("non_initial"), "chapters", F.col("_c").isNull().alias("novel"), F.col("form").rlike(CAPITAL).alias("capital"), "_f")
    repeated = F.col("novel") & (F.col("count") >= least_novel)
    upper = each.where(F.col("capital") & ((F.col("non_initial") >= least_single) | repeated))
    single = upper.select("_f").distinct().withColumn("_s", F.lit(True))
    lower = each.where(~F.col("capital")).join(single, "_f", "left").where(F.col("_s") | repeated).drop("_s").withColumn("non_initial", F.col("count"))

    def counted(uses, name):
        one = uses.groupBy("form", key).agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.sum("n").alias("count"), F.count(key).alias("chapters"))
        return _written(one, name).withColumns({"non_initial": F.col("count"), "_f": F.lower("form"), "novel": F.lit(True)})

    runs = own.select(key, F.explode(found(_RUN)).alias("_r")).select(key, F.col("_r").rlike(r"^\P{L}*[.!?\n]").alias("initial"), F.split(F.regexp_replace("_r", r"^\P{L}+", ""), " +").alias("words"))
    runs = runs.join(known, F.lower(F.get("words", F.lit(0))) == F.col("_c"), "left")
    phrase = counted(phrases(runs.select(key, F.when(F.col("initial") & F.col("_c").isNotNull(), F.expr("slice(words, 2, size(words))")).otherwise(F.col("words")).alias("words")), key), "phrases")

    # Windows meet what they may spell by a hash of their letters, as many as are fit for a broadcast at a time; forms decide.
    letters = lambda c: F.xxhash64(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" "), F.lit("")))
    spelt = _written(phrase.select(letters("_f").alias("_h")).unionByName(single.select(letters("_f").alias("_h"))).distinct(), "spelt")
    parts = -(-spelt.count() // C.BROADCAST_ROWS)
    stretch = own.select(key, F.explode(found(_STRETCH)).alias("_r")).select(key, F.split("_r", " +").alias("_w"))
    window = lambda n: "transform(_w, (x, i) -> concat(x, {}))".format(", ".join(f"' ', get(_w, i + {j})" for j in range(1, n)))
    near = stretch.select(key, F.explode(F.expr(f"IF(size(_w) < 3, {window(2)}, concat({window(2)}, {window(3)}))")).alias("form")).where("form IS NOT NULL").withColumn("_h", letters(F.lower("form")))
    split = None
    for i in range(parts):
        one = near.join(F.broadcast(spelt.where(F.pmod("_h", F.lit(parts)) == i)), "_h", "left_semi").select(key, "form")
        split = one if split is None else split.unionByName(one)
    split = counted(near.select(key, "form").limit(0) if split is None else split, "windows").withColumn("_j", F.regexp_replace("_f", " ", ""))
    split = split.join(phrase.select("_f").distinct().withColumn("_p", F.lit(True)), "_f", "left").join(single.withColumnRenamed("_f", "_j"), "_j", "left").where("_p OR _s")

    columns = ["form", "count", "non_initial", "chapters", "novel"]
    own = {"phrase": phrase.select(columns).unionByName(split.select(columns)), "single": upper.select(columns).unionByName(lower.select(columns))}
    caps = {"phrase": C.PHRASE_CAP, "single": C.SINGLE_CAP}
    # The best of each kind by a limit, which keeps so many rows of a task; what it cuts off is counted.
    best, cut = None, None
    for kind, forms in own.items():
        top = forms.orderBy(F.desc("novel"), F.desc("count"), "form").limit(caps[kind]).withColumn("kind", F.lit(kind))
        over = forms.agg(F.greatest(F.count(F.lit(1)) - caps[kind], F.lit(0)).alias("n"))
        best, cut = (top, over) if best is None else (best.unionByName(top), cut.unionByName(over))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("novel"), F.desc("count"), "form"))).drop("novel")
    return ranked.crossJoin(F.broadcast(cut.agg(F.sum("n").alias("truncated")))).select("form", "count", "non_initial", "chapters", "kind", "rank", "truncated")


#: Words once apostrophes are alike, whole ones each: any; one with a capital; one without. What precedes a word is taken from the
#: end of the word before it, so that no stretch without words is looked through more than once.
_WORD = r"\p{L}++(?:'\p{L}++)*+"
_UPPER = rf"(?=\p{{Lu}}|\p{{L}}++(?:'\p{{L}}++)*?'\p{{Lu}}){_WORD}"
_LOWER = r"(?!\p{Lu})\p{L}++(?:'(?!\p{Lu})\p{L}++)*+(?!'\p{L})"
_AFTER = r"(?:\A|(?<=\p{L})(?!'\p{L}))"
_OPENING = rf"{_AFTER}[^\p{{L}}.!?\n]*+[.!?\n]\P{{L}}*+({_UPPER})"
_RUN = rf"{_AFTER}\P{{L}}++{_UPPER}(?: ++{_UPPER})++"
_STRETCH = rf"(?<!\p{{L}})(?<!\p{{L}}'){_LOWER}(?: ++{_LOWER})++"


def _written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what several plans read is made once."""
    from ..sources.shared import shared_path

    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def snippets(tokens: DataFrame, texts: DataFrame, key: str, n: int = C.SNIPPETS) -> DataFrame:
    """(token, key, snippet): the first use in each of the first n chapters."""
    one = tokens.groupBy("token", key).agg(F.min("start").alias("start"))
    own = one.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(key))).where(F.col("r") <= n).join(texts.select(key, "text"), key)
    return own.select("token", key, F.expr(f"substring(text, greatest(start - 40, 0) + 1, {C.SNIPPET_CHARS})").alias("snippet"))


#: A word of a name or a text, for first uses.
WORD = r"[\p{L}\p{M}\p{N}]+"


def first_use(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(name, first): the lowest key whose text uses the name. names: (name), of any number of words.

    Names are found among the texts' own word n-grams by an equi-join; texts and names are never paired off. Words are runs of
    letters, marks and digits, of names too.
    """
    own = names.select("name", F.regexp_extract_all(T.fold_apostrophe(F.col("name")), F.lit(f"({WORD})"), F.lit(1)).alias("_w"))
    own = own.select("name", F.array_join("_w", " ").alias("_g"), F.size("_w").alias("n"))
    sizes = sorted(r["n"] for r in own.select("n").distinct().where("n > 0").collect())
    own = F.broadcast(own) if own.count() <= C.BROADCAST_ROWS else own
    words = texts.select(key, F.regexp_extract_all(T.fold_apostrophe(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"), F.lit(1)).alias("_w"))
    out = None
    for n in sizes:
        grams = F.expr(f"IF(size(_w) < {n}, CAST(array() AS array<string>), array_distinct(transform(sequence(0, size(_w) - {n}), i -> array_join(slice(_w, i + 1, {n}), ' '))))")
        one = words.select(key, F.explode(grams).alias("_g")).join(own.where(F.col("n") == n), "_g").groupBy("name").agg(F.min(key).alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


def first_use_claims(claims: DataFrame, heard: DataFrame) -> DataFrame:
    """(name, claimed, first, verdict): ok, early, late, unheard, or unknown for a claim without a chapter."""
    own = claims.join(heard, "name", "left")
    verdict = F.when(F.col("claimed").isNull(), "unknown").when(F.col("first").isNull(), "unheard").when(F.col("claimed") < F.col("first"), "early").when(F.col("claimed") > F.col("first"), "late").otherwise("ok")
    return own.select("name", "claimed", "first", verdict.alias("verdict"))


def sheet_rows(ledger: DataFrame, ends: DataFrame, heard: DataFrame) -> DataFrame:
    """(end, name): what a sheet may show at each chunk end: names first heard by then. Chapter 0 passes always."""
    own = ledger.join(heard, "name")
    return own.join(F.broadcast(ends), (F.col("first") <= F.col("end")) | (F.col("first") == 0)).select("end", "name")


#: Names that a form's block may hold without more ado.
FEW_NAMES = 5_000


def vocabulary(sources: DataFrame, common: list[str]) -> DataFrame:
    """(name, authority, pos, part, folded) of reference names (name, authority, pos) and of the parts of those of several words,
    common words left out. Shorter ones than MATCH_MIN_LENGTH are no names."""
    own = sources.select(F.trim("name").alias("name"), "authority", "pos").where(F.length("name") >= C.MATCH_MIN_LENGTH)
    words = F.filter(F.split(F.col("name"), r"\s+"), lambda w: ~F.lower(w).isin(*common) if common else F.lit(True))
    parts = own.where(F.size(F.split("name", r"\s+")) > 1).select(F.posexplode(words).alias("part", "name"), "authority", "pos").where(F.length("name") >= C.MATCH_MIN_LENGTH)
    out = own.select("name", "authority", "pos", F.lit(-1).alias("part")).unionByName(parts.select("name", "authority", "pos", "part"))
    return out.withColumn("folded", T.fold_form(F.col("name")))


def known_forms(forms: DataFrame, names: DataFrame) -> DataFrame:
    """The forms that verified names settle: a name itself, its possessive, a name and a stray short word, or a plural whose
    singular is itself among the forms; without that an s at the end is as likely a slip. forms: (form, ...); names: (folded)."""
    verified = names.select(F.col("folded").alias("_k")).distinct()
    own = forms.withColumn("_f", T.fold_form(F.col("form")))
    stem = lambda pattern: F.when(F.col("_f").rlike(pattern), F.regexp_replace("_f", pattern, ""))
    head = F.when(F.length(F.regexp_extract("_f", r" ([^ ]*)$", 1)) < C.MATCH_MIN_LENGTH, stem(r" [^ ]*$"))
    bases = [(F.col("_f"), False), (stem("'s$"), False), (head, False), (stem("es$"), True), (stem("s$"), True)]
    tries = own.select("form", F.explode(F.array(*[F.struct(b.alias("base"), F.lit(plural).alias("plural")) for b, plural in bases])).alias("x")).select("form", F.col("x.base").alias("_k"), "x.plural").where("_k IS NOT NULL")
    said = own.select(F.col("_f").alias("_k")).distinct().withColumn("said", F.lit(True))
    settled = tries.join(verified, "_k").join(said, "_k", "left").where("NOT plural OR said").select("form").distinct()
    return forms.join(settled, "form", "left_semi")


def _shortened(text: str, least: str, most: int) -> str:
    """SQL for the forms that a text has with up to `most` characters after the first taken out, `least` being SQL of a smaller bound."""
    one = "transform(sequence(2, greatest(length({x}), 2)), i -> concat(substring({x}, 1, i - 1), substring({x}, i + 1)))"
    once = f"IF({least} >= 1, {one.format(x=text)}, array())"
    twice = f"IF({least} >= 2, flatten(transform({once}, y -> {one.format(x='y')})), array())" if most > 1 else "array()"
    return f"array_distinct(concat(array({text}), CAST({once} AS array<string>), CAST({twice} AS array<string>)))"


def best_references(forms: DataFrame, names: DataFrame, most: int = C.MATCH_MAX_DISTANCE) -> DataFrame:
    """(form, name, authority, distance): the nearest name within min(most, length / MATCH_DIVISOR) edits, but not the form itself,
    that begins with the form's letter; a verified one among equals, then the earlier. names: as vocabulary() gives them.

    Two texts so near have a form in common that either gets by taking out as many characters, so they meet on those forms, by
    hash, and no block of similar length is paired off. A vocabulary of FEW_NAMES at most is met by length and first letter.
    """
    f = forms.select("form", T.fold_form(F.col("form")).alias("_f")).distinct().withColumn("_d", F.least(F.lit(most), F.floor(F.length("_f") / C.MATCH_DIVISOR).cast("int"))).where("_d >= 1")
    v = names.where("folded <> ''").select("name", "authority", "pos", "part", "folded")
    if v.count() <= FEW_NAMES:  # a block of so few is looked through sooner than forms are shortened
        f = f.withColumn("_s", F.explode(F.sequence(F.length("_f") - F.col("_d"), F.length("_f") + F.col("_d"))))
        v = F.broadcast(v.withColumn("_s", F.length("folded")))
        near = f.join(v, (f["_s"] == v["_s"]) & (F.substring("_f", 1, 1) == F.substring("folded", 1, 1)))
    else:
        f = f.select("form", "_f", "_d", F.explode(F.expr(_shortened("_f", "_d", most))).alias("_s")).withColumn("_s", F.xxhash64("_s"))
        v = v.withColumn("_s", F.explode(F.expr(_shortened("folded", str(most), most)))).withColumn("_s", F.xxhash64("_s"))
        near = f.join(v, "_s").where(F.substring("_f", 1, 1) == F.substring("folded", 1, 1))
    near = near.withColumn("distance", F.levenshtein("_f", "folded", most)).where((F.col("distance") > 0) & (F.col("distance") <= F.col("_d")))
    order = F.struct("distance", (F.col("authority") != "verified").alias("a"), "pos", "part")
    return near.groupBy("form").agg(F.min_by(F.struct("name", "authority", "distance"), order).alias("_x")).select("form", "_x.*")


def reference_matches(forms: DataFrame, sources: DataFrame, common: list[str], cap: int = C.MATCH_CAP) -> DataFrame:
    """(form, count, name, authority, distance, truncated): proposals for name-shaped forms (form, count) that no verified source
    settles, verified ones first, then by count; the first `cap` of them, and how many more there are. Carryover names propose
    but never settle: what an earlier volume wrote may be the same slip."""
    names = vocabulary(sources, common)
    own = forms.withColumn("form", F.trim("form")).where((F.length("form") >= C.MATCH_MIN_LENGTH) & proper_shape(F.col("form"), common))
    settled = known_forms(forms.select(F.trim("form").alias("form")), names.where("authority = 'verified'"))
    found = best_references(own.join(settled.select("form").distinct(), "form", "left_anti"), names).join(own.select("form", "count"), "form")
    over = found.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("truncated"))
    top = found.orderBy(F.col("authority") != "verified", F.desc("count"), "form").limit(cap)
    return top.join(F.broadcast(over), F.lit(True)).select("form", "count", "name", "authority", "distance", "truncated")  # one row


def overlap(texts: DataFrame, sources: DataFrame, key: str, source_key: str, n: int = C.SHINGLE) -> DataFrame:
    """(key, source_key, first, words): maximal runs of n-word shingles of a text that a source has too.

    Shingles meet by two independent 64-bit hashes, so that no text is shuffled. Raises if no text or no source has a shingle:
    a check that measured nothing.
    """
    def tokenised(df, k):
        return df.select(k, T.tokens(T.normalise_ascii(F.col("text"))).alias("_t")).where(F.size("_t") >= n)

    words = ", ".join(f"get(_t, i + {j})" for j in range(n))
    hashes = F.expr(f"posexplode(transform(sequence(0, size(_t) - {n}), i -> named_struct('a', xxhash64({words}), 'b', xxhash64('second', {words}))))").alias("i", "h")
    own, theirs = tokenised(texts, key), tokenised(sources, source_key)
    grams = theirs.select(source_key, hashes).select(source_key, "h.a", "h.b").distinct()
    known = grams.count()
    if not known or own.isEmpty():
        raise ValueError("no shingle to compare")
    grams = F.broadcast(grams) if known <= C.BROADCAST_ROWS else grams
    hits = own.select(key, hashes).select(key, "i", "h.a", "h.b").join(grams, ["a", "b"]).select(key, source_key, "i").distinct()
    w = Window.partitionBy(key, source_key).orderBy("i")
    own = hits.withColumn("_k", F.col("i") - F.row_number().over(w))
    return own.groupBy(key, source_key, "_k").agg(F.min("i").alias("first"), (F.count(F.lit(1)) + n - 1).alias("words")).drop("_k")


def glossary(books: DataFrame, names: DataFrame, cap: int = 200) -> DataFrame:
    """(id, names): distinct names of earlier books of the series, sorted. books: (id, series, pos); names: (id, name)."""
    own = books.join(names, "id").groupBy("series", "name").agg(F.min("pos").alias("since"))
    both = books.where(F.col("series") != "").join(own, "series").where(F.col("since") < F.col("pos"))
    return both.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("name")), 1, cap).alias("names"))


# Cues of error classes, in order.
ERROR_CLASSES = [("rate_limit", ["rate limit", "too many requests", "429"]), ("auth", ["unauthorized", "forbidden", "login"]), ("timeout", ["timeout", "timed out", "deadline"]), ("network", ["connection", "network", "dns"]), ("validation", ["invalid", "schema", "missing"])]


def error_class(message: Column) -> Column:
    return T.first_class(message, ERROR_CLASSES)


def reset_time(message: Column, now: Column) -> Column:
    """When a limit ends: an epoch suffix within 48 hours of now, or the next time a clock shows the hour named."""
    epoch = F.timestamp_seconds(F.regexp_extract(message, r"\|([0-9]{10})$", 1).try_cast("long"))
    near = F.when((epoch > now) & (epoch <= now + F.expr("INTERVAL 48 HOURS")), epoch)
    hour = F.regexp_extract(F.lower(message), r"resets? (?:at )?([0-9]{1,2})(?::[0-9]{2})? ?[ap]m", 1).try_cast("int") % 12
    minute = F.coalesce(F.regexp_extract(F.lower(message), r"resets? (?:at )?[0-9]{1,2}:([0-9]{2})", 1).try_cast("int"), F.lit(0))
    pm = F.when(F.lower(message).rlike("[0-9] ?pm"), 12).otherwise(0)
    at = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), hour + pm, minute)
    return F.coalesce(near, F.when(at <= now, at + F.expr("INTERVAL 1 DAY")).otherwise(at))


def sheet_gates(ledger: DataFrame, ends: DataFrame, heard: DataFrame) -> DataFrame:
    """(name, other, end): notes of a name that mention another first heard after the sheet's end; each pair at its smallest end.

    ledger: (name, note). A note mentions a name that it contains, whatever stands around it. Names first heard in chapter 0
    break nothing.
    """
    late = heard.select(F.col("name").alias("other"), F.col("first").alias("late")).where("late > 0")
    late = _mentions(ledger.select("name", "note"), "note", late, "other")
    own = late.join(heard.select("name", "first"), "name").where("other <> name AND late > 0")
    both = own.join(F.broadcast(ends), (F.col("first") <= F.col("end")) & (F.col("late") > F.col("end")))
    return both.groupBy("name", "other").agg(F.min("end").alias("end"))


def sheet_audit(ledger: DataFrame, ends: DataFrame, heard: DataFrame, prior: DataFrame, preamble: DataFrame) -> DataFrame:
    """(gate, name, other): what any of the sheets' gates finds: notes that name what is heard later, rows that claim to be carried
    over, preamble lines that name what is heard after the first sheet."""
    first = ends.agg(F.min("end")).first()[0]
    ledger, heard = _written(ledger.select("name", "note", "carryover"), "ledger"), _written(heard.select("name", "first"), "heard")
    notes = sheet_gates(ledger, ends, heard).select(F.lit("note").alias("gate"), "name", "other")
    carried = carryover_gate(ledger, prior).select(F.lit("carryover").alias("gate"), "name", F.lit("").alias("other"))
    out = notes.unionByName(carried)
    return out if first is None else out.unionByName(preamble_leaks(preamble, heard, first).select(F.lit("preamble").alias("gate"), "name", F.col("line").alias("other")))


def carryover_gate(ledger: DataFrame, prior: DataFrame) -> DataFrame:
    """Rows that claim to be carried over and weren't there before."""
    return ledger.where("carryover").join(prior.select(F.col("canonical").alias("name")), "name", "left_anti")


def preamble_leaks(lines: DataFrame, heard: DataFrame, end: int) -> DataFrame:
    """(line, name): preamble lines (pos, line) with a name first heard after `end`."""
    late = heard.where(F.col("first") > end).select("name").distinct()
    return _mentions(lines.select("pos", "line"), "line", late, "name").select("line", "name")


def _if_few(df: DataFrame, rows: int, size: int | None) -> DataFrame:
    """df to be broadcast, if that many rows and bytes of strings are fit for it; else neither side is: what it meets may be exploded
    rows, which Spark takes to be as few as those that they come from."""
    return F.broadcast(df) if rows <= C.BROADCAST_ROWS and (size or 0) <= 32 << 20 else df.hint("merge")


#: First characters of a name on which it meets texts, at most.
MENTION_PREFIX = 16
#: Beginnings of names that any worker may hold, to tell where in a text no name can start.
MENTION_HEADS = 50_000


def _mentions(texts: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """Rows of texts and names whose text contains the name.

    Each different text is looked through once. Its places first meet the heads of names, which are as long as leaves about
    MENTION_HEADS of them and are broadcast; only places that a head stands at meet names on their first MENTION_PREFIX characters
    at most, by an equi-join. What was found joins the texts again. Without names no text is read.
    """
    own = names.where(F.length(name) > 0).withColumn("_b", F.substring(F.col(name), 1, MENTION_PREFIX))
    heads = [F.approx_count_distinct(F.substring("_b", 1, k)) for k in range(1, MENTION_PREFIX + 1)]
    n, size, sizes, *heads = own.agg(F.count(F.lit(1)), F.sum(F.octet_length(name)), F.collect_set(F.length("_b")), *heads).first()
    if not n:
        return texts.join(own.drop("_b"), F.lit(False))
    k = max((k for k, found in enumerate(heads, 1) if found <= MENTION_HEADS), default=1)  # single characters are few anyway
    lengths = F.array(*map(F.lit, sorted({min(x, k) for x in sizes})))
    head = own.groupBy(F.substring("_b", 1, k).alias("_h")).agg(F.collect_set(F.length("_b")).alias("_l"))
    once = texts.where(F.length(column) > 0).select(F.col(column).alias("_t")).distinct()
    each = once.select("_t", F.explode(F.array_distinct(F.expr(f"transform(sequence(1, length(_t)), i -> substring(_t, i, {MENTION_PREFIX}))"))).alias("_w"))
    each = each.select("_t", "_w", F.explode(lengths).alias("_n")).where("length(_w) >= _n").select("_t", "_w", F.expr("substring(_w, 1, _n)").alias("_h"))
    each = each.join(F.broadcast(head), "_h").select("_t", "_w", F.explode("_l").alias("_n")).where("length(_w) >= _n").select("_t", F.expr("substring(_w, 1, _n)").alias("_b"))
    found = each.join(_if_few(own, n, size), "_b").where(F.contains("_t", F.col(name))).drop("_b").distinct()
    found = _written(found, "mentions")
    n, size = found.agg(F.count(F.lit(1)), F.sum(F.octet_length("_t") + F.octet_length(name))).first()
    return texts.join(_if_few(found, n, size), F.col(column) == F.col("_t")).drop("_t")


def proper_shape(token: Column, common: list[str]) -> Column:
    """Capitalised, and no contraction of a common word."""
    stem = F.when(F.contains(token, F.lit("'")), F.lower(F.element_at(F.split(token, "'"), 1)))
    return token.rlike(r"^\p{Lu}|'\p{Lu}") & (~F.coalesce(stem.isin(*common), F.lit(False)) if common else F.lit(True))


def glossary_name(name: Column, least: int = 4) -> Column:
    """Long enough, and each word after the first is capitalised or a small connecting word."""
    words = F.split(name, " ")
    return (F.length(name) >= least) & name.rlike(r"^\p{Lu}") & F.forall(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w: w.rlike(r"^\p{Lu}|^(of|the|de|van|von|le|la)$"))


def top_counts(values: DataFrame, column: str, n: int) -> DataFrame:
    return values.groupBy(column).count().orderBy(F.desc("count"), column).limit(n)
