"""Transcript QA: detectors over chapters (chapter, text, duration) and segments (chapter, pos, start, end, text, words)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import text as T


def rate_outliers(chapters: DataFrame, z: float = C.OUTLIER_Z) -> DataFrame:
    """(chapter, words, minutes, rate, z): words an hour that lie more than z sample deviations from the mean. Chapter 0 takes no
    part; a chapter without a duration has the rate 0 and takes part.

    Mean and deviation are one-row aggregates that every row meets, so no window gathers all chapters in one task.
    """
    own = chapters.where("chapter <> 0").select("chapter", F.size(T.tokens(F.col("text"))).alias("words"), F.coalesce("duration", F.lit(0.0)).alias("duration"))
    own = own.withColumn("rate", F.when(F.col("duration") != 0, F.col("words") / (F.col("duration") / 3600)).otherwise(0.0))
    stats = own.agg(F.avg("rate").alias("mean"), F.coalesce(F.stddev_samp("rate"), F.lit(0.0)).alias("sd"))
    joined = own.join(F.broadcast(stats), F.lit(True))  # one row
    scored = joined.withColumn("z", F.when(F.col("sd") != 0, (F.col("rate") - F.col("mean")) / F.col("sd")).otherwise(0.0))
    return scored.where(F.abs("z") > z).select("chapter", "words", F.round(F.col("duration") / 60, 1).alias("minutes"), F.round("rate", 1).alias("rate"), F.round("z", 2).alias("z"))


def repeat_runs(segments: DataFrame, durations: DataFrame, least: int = C.RUN_MINIMUM) -> DataFrame:
    """(chapter, first_pos, last_pos, n, start, text, kind): runs of equal normalised segments. Empty ones don't break a run.

    kind is end_fade for runs that begin at END_FADE of the chapter's duration (chapter, duration) or later, else mid, and mid
    where no duration is known. Chapter 0 takes no part.
    """
    own = segments.where("chapter <> 0").withColumn("norm", T.normalise_unicode(F.col("text"))).where("norm <> ''")
    order = Window.partitionBy("chapter").orderBy("pos")
    own = own.withColumn("new", F.coalesce((F.col("norm") != F.lag("norm").over(order)).cast("int"), F.lit(1)))
    own = own.withColumn("island", F.sum("new").over(order))
    runs = own.groupBy("chapter", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"), F.min_by("start", "pos").alias("start"), F.min_by("text", "pos").alias("text"))
    runs = runs.where(F.col("n") >= least).join(durations.select("chapter", "duration"), "chapter", "left")
    late = F.coalesce(F.col("start") / F.nullif("duration", F.lit(0.0)), F.lit(0.0)) >= C.END_FADE
    return runs.select("chapter", "first_pos", "last_pos", "n", "start", T.truncate(F.col("text"), C.RUN_CHARS).alias("text"), F.when(late, "end_fade").otherwise("mid").alias("kind"))


def low_confidence(words: DataFrame, worst: int = C.WORST) -> DataFrame:
    """(chapter, low, total, rate): the chapters of highest share of words with p below LOW_P. Null p is no low p."""
    tally = words.where("chapter <> 0").groupBy("chapter").agg(F.count_if(F.col("p") < C.LOW_P).alias("low"), F.count(F.lit(1)).alias("total"))
    tally = tally.withColumn("rate", F.col("low") / F.greatest("total", F.lit(1)))
    return tally.orderBy(F.desc("rate"), "chapter").limit(worst)


def cross_loops(chapters: DataFrame, least: int = C.CROSS_COUNT, tokens: int = C.CROSS_MIN_TOKENS, n: int = C.GRAM) -> DataFrame:
    """(chapter, phrase, count, first): each chapter's top gram, if it is a loop."""
    own = chapters.select("chapter", T.tokens(F.col("text")).alias("_t")).where(F.size("_t") >= tokens)
    top = T.with_gram_counts(own, "_t", n, "grams", least).withColumn("top", T.top_of("grams")).where("top is not null")
    return top.select("chapter", F.col("top.gram").alias("phrase"), F.col("top.count").alias("count"), F.col("top.first").alias("first"))


def locate_phrase(loops: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds at (start of the first segment that holds the phrase) and until (end of the last one in document order)."""
    near = loops.join(segments.select("chapter", "pos", "start", "end", F.col("text").alias("segment")), "chapter").where(F.contains(T.collapse(F.col("segment")), F.col("phrase")))
    found = near.groupBy("chapter", "phrase").agg(F.min_by("start", "pos").alias("at"), F.max_by("end", "pos").alias("until"))
    return loops.join(found, ["chapter", "phrase"], "left")


def within_loops(segments: DataFrame, least: int = C.WITHIN_COUNT, tokens: int = C.WITHIN_MIN_TOKENS, n: int = C.GRAM) -> DataFrame:
    """(chapter, pos, phrase, count): segments whose own top gram is a loop."""
    own = segments.where("chapter <> 0").select("chapter", "pos", T.tokens(F.col("text")).alias("_t")).where(F.size("_t") >= tokens)
    top = T.with_gram_counts(own, "_t", n, "grams", least).withColumn("top", T.top_of("grams")).where("top is not null")
    return top.select("chapter", "pos", F.col("top.gram").alias("phrase"), F.col("top.count").alias("count"))


def multi_loops(chapters: DataFrame, least: int = C.MULTI_COUNT, tokens: int = C.MULTI_MIN_TOKENS, n: int = C.GRAM) -> DataFrame:
    """(chapter, phrase, count, first): all looping grams of the ASCII-normalised text, one for each set of words."""
    own = chapters.select("chapter", T.tokens(T.normalise_ascii(F.col("text"))).alias("_t")).where(F.size("_t") >= tokens)
    rows = T.with_gram_counts(own, "_t", n, "grams", least).select("chapter", F.explode("grams").alias("g"))
    place = Window.partitionBy("chapter", T.word_set(F.col("g.gram"))).orderBy(F.desc("g.count"), "g.first")
    kept = rows.withColumn("r", F.row_number().over(place)).where("r = 1")
    return kept.select("chapter", F.col("g.gram").alias("phrase"), F.col("g.count").alias("count"), F.col("g.first").alias("first"))


def locate_loop(loops: DataFrame, segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Adds at, null where the phrase's prefix isn't found or begins at exactly 0, and mid (0 <= percent < MULTI_MID_PERCENT)."""
    texts = segments.select("chapter", "pos", "start", T.normalise_ascii(F.col("text")).alias("segment"))
    near = loops.join(texts, "chapter").where(F.contains("segment", T.truncate(F.col("phrase"), C.MULTI_PREFIX)))
    found = near.groupBy("chapter", "phrase").agg(F.nullif(F.min_by("start", "pos"), F.lit(0.0)).alias("at"))
    out = loops.join(found, ["chapter", "phrase"], "left").join(durations.select("chapter", "duration"), "chapter", "left")
    percent = 100 * F.col("at") / F.nullif("duration", F.lit(0.0))
    return out.withColumn("mid", F.coalesce((percent >= 0) & (percent < C.MULTI_MID_PERCENT), F.lit(False)))


def tail_rates(words: DataFrame, n: int = C.TAIL_WORDS, limit: float = C.TAIL_MAX_RATE) -> DataFrame:
    """(chapter, words, span, rate, tail): chapters whose last n words come faster than limit a second; tail is those words' text.

    words: (chapter, pos, word, start, end). Blank words don't count. Chapters with fewer than n + TAIL_SLACK words are let be.
    """
    back = Window.partitionBy("chapter").orderBy(F.desc("pos"))
    last = words.withColumn("word", T.collapse(F.coalesce("word", F.lit("")))).where("word <> ''").withColumn("r", F.row_number().over(back)).where(F.col("r") <= n + C.TAIL_SLACK)
    within = F.col("r") <= n
    tail = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(within, F.struct((-F.col("r")).alias("r"), "word")))), lambda x: x["word"]), " ")  # n words
    own = last.groupBy("chapter").agg(F.max("r").alias("have"), F.min_by("start", F.when(within, -F.col("r"))).alias("a"), F.max_by("end", -F.col("r")).alias("b"), tail.alias("tail"))
    own = own.where(F.col("have") >= n + C.TAIL_SLACK).withColumn("span", F.greatest(F.col("b") - F.col("a"), F.lit(C.TAIL_FLOOR)))
    own = own.withColumn("rate", n / F.col("span")).where(F.col("rate") > limit)
    return own.select("chapter", F.lit(n).alias("words"), F.round("span", 2).alias("span"), F.round("rate", 1).alias("rate"), T.truncate(F.col("tail"), C.TAIL_CHARS).alias("tail"))


def union_of(*findings: DataFrame, key: str = "chapter") -> DataFrame:
    """The keys that any finding names, once each."""
    out = findings[0].select(key)
    for f in findings[1:]:
        out = out.unionByName(f.select(key))
    return out.distinct()


def restrict(findings: DataFrame, keep: DataFrame, key: str = "chapter") -> DataFrame:
    return findings.join(keep.select(key), key, "left_semi")


def is_clean(findings: dict[str, DataFrame]) -> DataFrame:
    """One row: the count of each detector, and clean, which the low-confidence tally has no say in."""
    rows = None
    for name, f in findings.items():
        one = f.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("detector"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("detector", "n")))).alias("counts"), (F.coalesce(F.sum(F.when(F.col("detector") != "low_confidence", F.col("n"))), F.lit(0)) == 0).alias("clean"))


def missing(required: DataFrame, planned: DataFrame, key: str = "chapter") -> DataFrame:
    return required.select(key).distinct().join(planned.select(key), key, "left_anti")


def unexpected(planned: DataFrame, allowed: DataFrame, key: str = "chapter") -> DataFrame:
    return planned.select(key).distinct().join(allowed.select(key), key, "left_anti")


def plan_problems(planned: DataFrame, required: DataFrame, allowed: DataFrame) -> DataFrame:
    """(chapter, problem) of a plan (chapter, action, start, end, duration): missing, unexpected, duplicate, range."""
    label = lambda df, what: df.select("chapter", F.lit(what).alias("problem"))
    twice = planned.groupBy("chapter").count().where("count > 1")
    bad = planned.where((F.col("start") < 0) | (F.col("end") <= F.col("start")) | ~clip_in_range(F.col("start"), F.col("duration")))
    return label(missing(required, planned), "missing").unionByName(label(unexpected(planned, allowed), "unexpected")).unionByName(label(twice, "duplicate")).unionByName(label(bad, "range")).distinct()


def non_accept(plan: DataFrame) -> DataFrame:
    """Entries of a plan that ask for work."""
    return plan.where(F.col("action") != "accept")


def entries_done(plan: DataFrame, verdicts: DataFrame, repaired: DataFrame, key: str = "chapter") -> DataFrame:
    """Adds done: a retranscription whose chapter has a verdict and, unless that says to keep the old text, a repaired text."""
    own = plan.join(verdicts.select(key, F.col("verdict").alias("_v")), key, "left").join(repaired.select(key, F.lit(True).alias("_r")).distinct(), key, "left")
    return own.withColumn("done", F.coalesce(F.col("_v").isNotNull() & ((F.col("_v") == "keep") | F.coalesce("_r", F.lit(False))), F.lit(False))).drop("_v", "_r")


def run_detectors(chapters: DataFrame, segments: DataFrame, words: DataFrame) -> dict[str, DataFrame]:
    """The findings of all detectors over the same chapters (chapter, text, duration), segments (chapter, pos, start, end, text) and
    words (chapter, pos, word, start, end, p), by name; retranscribe is the queue of chapters that any but the tally names."""
    found = {
        "wph_outliers": rate_outliers(chapters),
        "repeated_runs": repeat_runs(segments, chapters),
        "cross_segment": locate_phrase(cross_loops(chapters), segments),
        "within_segment": within_loops(segments),
        "multi_loop": locate_loop(multi_loops(chapters), segments, chapters),
        "tail_rate": tail_rates(words),
        "low_confidence": low_confidence(words),
    }
    return found | {"retranscribe": union_of(found["cross_segment"], found["within_segment"], found["multi_loop"].where("mid"), found["repeated_runs"].where("kind = 'mid'"), found["tail_rate"])}


def clip_in_range(start: Column, duration: Column) -> Column:
    return (F.coalesce(duration, F.lit(0.0)) <= 0) | (start < duration - 1)


def percent(n: Column, d: Column) -> Column:
    return 100 * n / F.greatest(d, F.lit(1))
