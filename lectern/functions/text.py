"""Scalar text functions, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any script; SQL's \\s is ASCII only.
SPACE = r"[\s\p{Z}\x85]+"


def tokens(text: Column) -> Column:
    """Raw tokens: what stands between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normalise_unicode(text: Column) -> Column:
    """Letters and digits of any script and single spaces, in lower case."""
    return collapse(F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}\s]", " ")))


def normalise_ascii(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def normalise_tail(text: Column) -> Column:
    """Like normalise_ascii, but apostrophes stay."""
    return collapse(F.regexp_replace(F.lower(fold_apostrophe(text)), "[^a-z0-9' ]", " "))


def normalise_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fold_apostrophe(text: Column) -> Column:
    return F.translate(text, "’", "'")


def fold_form(text: Column) -> Column:
    return collapse(F.lower(fold_apostrophe(text)))


def truncate(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def occurrences(text: Column, form: str) -> Column:
    """Non-overlapping uses of a literal that no ASCII letter touches."""
    return F.regexp_count(text, F.lit(f"(?<![A-Za-z]){quote(form)}(?![A-Za-z])"))


def error_fingerprint(text: Column) -> Column:
    """24 hex digits that stand for a message, whatever paths, ids and numbers it holds."""
    masked = F.regexp_replace(F.lower(text), r"(/[^\s:]+)+", "<path>")
    masked = F.regexp_replace(masked, r"[0-9a-f]{8,}|[0-9]+", "#")
    return F.substring(F.sha2(collapse(masked), 256), 1, 24)


#: What a status code of three digits follows, and what it doesn't run on into; other numbers are ids and counts.
STATUS = r"(?:^|[:(\[]|\b(?:https?(?:/[0-9.]+)?|status|code|errors?|response|returned|returns|got|received|with)\b[:=]?)\s*(?:{codes})(?![a-z0-9]|[.,][0-9])"


def first_class(text: Column, ladder: list[tuple[str, list[str]]], default: str = "unknown") -> Column:
    """The first class of the ladder that has a cue in the text. A cue of digits is a status code and counts only as one: 429 is
    in "HTTP 429" but not in "job 382429" or "job 429"."""
    out = F.lit(None).cast("string")
    for name, cues in reversed(ladder):
        codes, words = [c for c in cues if c.isdigit()], [c for c in cues if not c.isdigit()]
        hit = F.exists(F.array(*map(F.lit, words)).cast("array<string>"), lambda cue: F.contains(F.lower(text), cue))
        hit = hit | F.lower(text).rlike(STATUS.format(codes="|".join(codes))) if codes else hit
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(default))


def leading_number(text: Column, otherwise: float) -> Column:
    """The number that a position starts with, or `otherwise`."""
    return F.coalesce(F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(otherwise))


def sequence_number(text: Column) -> Column:
    """A position that is one number; ranges have none."""
    return F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double")


# Fixed values.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(text: Column) -> Column:
    """The value of a cardinal in English words, null if any word isn't part of one."""
    values = {w: i for i, w in enumerate(UNITS)} | {w: 10 * i for i, w in enumerate(TENS, 2)}
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    words = F.filter(F.split(F.lower(F.translate(text, "-", " ")), " +"), lambda x: (x != "") & (x != "and"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("part"), (F.size(words) > 0).alias("ok"))

    def step(a, w):
        v = F.element_at(table, w)
        return (
            F.when(w == "hundred", F.struct(a["sum"].alias("sum"), (F.greatest(a["part"], F.lit(1)) * 100).alias("part"), a["ok"].alias("ok")))
            .when(w == "thousand", F.struct((a["sum"] + F.greatest(a["part"], F.lit(1)) * 1000).alias("sum"), F.lit(0).alias("part"), a["ok"].alias("ok")))
            .otherwise(F.struct(a["sum"].alias("sum"), (a["part"] + F.coalesce(v, F.lit(0))).alias("part"), (a["ok"] & v.isNotNull()).alias("ok")))
        )

    return F.aggregate(words, start, step, lambda a: F.when(a["ok"], a["sum"] + a["part"]))


def spoken_chapter(text: Column) -> Column:
    """The number that a text's first sentence (four words at most after "chapter") announces."""
    first = F.trim(F.regexp_extract(F.lower(text), r"^\s*(?:chapter\s+)?([^.!?]*)", 1))
    digits = F.regexp_extract(first, r"^([0-9]{1,4})$", 1).try_cast("int")
    return F.when(F.size(tokens(first)) <= 4, F.coalesce(digits, number_words(first)))


def label_number(label: Column) -> Column:
    """Chapter number of a marker's label: "chapter 7", "7. title", "7", or in words, tried in this order."""
    tries = [r"(?i)^\s*chapter\s+([0-9]{1,4})\b", r"^\s*([0-9]{1,4})\s*[.:)-]", r"^\s*([0-9]{1,4})\s*$"]
    words = number_words(F.regexp_extract(label, r"(?i)^\s*chapter\s+([a-z -]+)", 1))
    return F.coalesce(*[F.regexp_extract(label, t, 1).try_cast("int") for t in tries], words)


def split_title(label: Column) -> Column:
    """struct(head, title): a label cut at its earliest delimiter."""
    return F.struct(F.trim(F.regexp_extract(label, r"^(.*?)(?:[:—–]| - |\. |$)", 1)).alias("head"), F.trim(F.regexp_extract(label, r"^.*?(?:[:—–]| - |\. )(.*)$", 1)).alias("title"))


# N-grams of one row's tokens, without a shuffle ------------------------------------------------


def with_gram_counts(df: DataFrame, tokens_col: str, n: int, out: str, least: int = 1) -> DataFrame:
    """Adds `out`: array of struct(count, first, gram) of the row's n-grams counted `least` times or more.

    Hashes of the grams are sorted with their places, so equal ones are neighbours: n log n in a row, and no row leaves
    its task.
    """
    t = tokens_col
    words = ", ".join(f"get({t}, i + {j})" for j in range(n))
    df = df.withColumn("_h", F.expr(f"IF(size({t}) < {n}, CAST(array() AS array<bigint>), transform(sequence(0, size({t}) - {n}), i -> xxhash64({words})))"))
    # Where too few grams repeat for one to be counted `least` times, nothing is sorted.
    df = df.withColumn("_g", F.expr(f"IF(size(_h) - size(array_distinct(_h)) >= {least - 1}, array_sort(transform(_h, (x, i) -> named_struct('h', x, 'p', i))), CAST(array() AS array<struct<h:bigint,p:int>>))"))
    starts = "filter(sequence(0, size(_g) - 1), i -> i = 0 OR get(_g, i).h <> get(_g, i - 1).h)"
    df = df.withColumn("_b", F.expr(f"IF(size(_g) = 0, CAST(array() AS array<int>), {starts})"))
    runs = f"filter(transform(_b, (b, i) -> named_struct('count', coalesce(get(_b, i + 1), size(_g)) - b, 'first', get(_g, b).p)), x -> x.count >= {least})"
    df = df.withColumn("_r", F.expr(runs))
    gram = f"transform(_r, x -> named_struct('count', x.count, 'first', x.first, 'gram', array_join(slice({t}, x.first + 1, {n}), ' ')))"
    # A filter on what follows would be pushed below these columns, with each written out in it over and over; not below this one.
    return df.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, F.expr(gram))).drop("_h", "_g", "_b", "_r")


def top_of(grams: str) -> Column:
    """The most frequent gram, the first seen of equals; null if there is none."""
    return F.expr(f"aggregate({grams}, CAST(null AS struct<count:int,first:int,gram:string>), (a, x) -> IF(a IS NULL OR x.count > a.count OR (x.count = a.count AND x.first < a.first), x, a))")


def word_set(gram: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(gram, " "))), " ")
