"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text goes whole.

Everything is a DataFrame expression. Repeated three-word windows are found on arrays of 64-bit window hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier

# What lines are judged by.
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright \(c\)|copyright ©|spdx-license-identifier|licensed under|permission is hereby granted"
    r"|terms of (use|service)|privacy policy|cookie policy|we use cookies|enable javascript|click here|subscribe to our|sign up for|skip to (main )?content|lorem ipsum)"
)
WORD = r"[^\x20\x09-\x0D]"
#: A document goes when its surviving lines hold less than this share of the characters of its lines.
MIN_KEPT_SHARE = 0.5
#: A line goes with this many " | " separators or more, this share of symbol characters to words, or of capitals to letters.
MAX_SEPARATORS, MAX_SYMBOL_SHARE, MAX_CAPITAL_SHARE = 3, 0.3, 0.6
#: Capitals are looked at in lines with this many letters or more.
MIN_LETTERS = 20
#: A line without a sentence mark anywhere goes if it has fewer words than this.
MIN_UNPUNCTUATED_WORDS = 4


def line_fails(line: Column) -> Column:
    """Whether a line with a word in it breaks a rule: navigation, symbols, shouting, boilerplate or punctuation.

    Words are counted once, and only where a count can matter: a line of symbols, or one without a sentence mark.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    marked = line.rlike(r"[.!?:;,。！？…]")
    by_words = F.transform(F.array(count(WORD + "+")), lambda n: (count(SYMBOLS) >= n * MAX_SYMBOL_SHARE) | ((n < MIN_UNPUNCTUATED_WORDS) & ~marked))[0]
    letters = F.transform(F.array(count(r"\p{Lu}")), lambda n: (n >= MIN_LETTERS * MAX_CAPITAL_SHARE) & (count(r"\p{L}") >= MIN_LETTERS) & (n >= count(r"\p{L}") * MAX_CAPITAL_SHARE))[0]
    return (line.contains(" | ") & (count(r" \| ") >= MAX_SEPARATORS)) | ((~marked | line.rlike(SYMBOLS)) & by_words) | letters | line.rlike(BOILERPLATE)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in `carry`, counts, verdict and cleaned text for every row of docs.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words that lie in a window of three words found twice
    or more in the text), base_failed, n_lines (lines with a word), removed_lines, kept and cleaned. A null text
    counts as empty: all counts 0, base_failed, not kept, cleaned empty. Lines without words stay as they are. Columns
    of docs not named are not read, so their names can't clash; repeated rows are judged each on its own.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(None).alias("_carry"), t.alias("_t"))
    df = df.select("*", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "").alias("_w"), F.split("_t", "\n").alias("_lines"))
    window = "xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))"
    df = df.select(
        "*",
        F.expr(f"IF(size(_w) < 3, array(), transform(sequence(0, size(_w) - 3), i -> {window}))").cast("array<long>").alias("_h"),
        F.filter("_lines", lambda x: x.rlike(WORD)).alias("_wl"),
    )
    df = df.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")).otherwise(F.array().cast("array<long>")).alias("_s"))
    df = df.select("*", F.expr("array_distinct(filter(_s, (x, i) -> x = get(_s, i + 1)))").alias("_d"))
    # Where windows repeat: few repeated hashes are looked up; many are found as neighbours after sorting (hash, place).
    df = df.select("*", F.when(F.size("_d") > 24, F.expr("sort_array(transform(_h, (x, i) -> named_struct('h', x, 'i', i)))")).alias("_p"))
    places = """CASE WHEN size(_d) = 0 THEN array()
      WHEN size(_d) <= 24 THEN filter(sequence(0, size(_h) - 1), i -> array_contains(_d, get(_h, i)))
      ELSE sort_array(transform(filter(_p, (x, i) -> x.h <=> get(_p, i - 1).h OR x.h <=> get(_p, i + 1).h), x -> x.i)) END"""
    covered = "aggregate(_at, named_struct('n', 0L, 'to', 0L), (a, i) -> named_struct('n', a.n + i + 3 - greatest(CAST(i AS bigint), a.to), 'to', CAST(i + 3 AS bigint)), a -> a.n)"
    # Lines are judged once: those that go turn null.
    good = F.transform("_lines", lambda x: F.when(~x.rlike(WORD) | ~line_fails(x), x))
    df = df.select("*", F.expr(places).cast("array<int>").alias("_at"), good.alias("_judged"))
    df = df.select("*", F.filter("_judged", lambda x: x.isNotNull()).alias("_left"))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    df = df.select(
        "*",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_wl") - F.size(F.array_distinct("_wl"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.size("_wl").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_left")).cast("long").alias("removed_lines"),
        total(F.col("_wl")).alias("_all"),
        (total(F.col("_wl")) - total(F.col("_lines")) + total(F.col("_left"))).alias("_good"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    kept = ~F.col("base_failed") & (F.col("_good") >= F.col("_all") * MIN_KEPT_SHARE)
    cleaned = F.when(F.col("removed_lines") == 0, F.col("_t")).otherwise(F.array_join("_left", "\n"))
    df = df.withColumn("base_failed", failed).withColumn("kept", barrier(kept)).withColumn("cleaned", cleaned)
    return df.select(F.col("_id").alias(id_col), *[F.col(f"_carry.{c}").alias(c) for c in carry], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "removed_lines", "kept", "cleaned")
