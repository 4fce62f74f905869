"""Interval logic: coverage, snapping, loop location, adjudication and splicing. Seconds are doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import text as T


def merge(spans: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, start, end): overlapping or touching spans as one."""
    order = Window.partitionBy(key).orderBy(start, end)
    own = spans.withColumn("_m", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("_i", F.sum(F.coalesce((F.col(start) > F.col("_m")).cast("int"), F.lit(0))).over(order))
    return own.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def gaps(spans: DataFrame, totals: DataFrame, key: str, least: float = C.MIN_SPAN) -> DataFrame:
    """(key, start, end, place): holes of [0, duration] that no span covers; place is leading, interior or trailing.

    A key without spans is one interior hole, for nothing is there that it could lead or trail. A key without a duration has none.
    """
    known = totals.where(F.col("duration") > 0).select(key, "duration")
    merged = merge(spans.where(F.col("end") > F.col("start")), key)
    prior = F.lag("end").over(Window.partitionBy(key).orderBy("start"))
    inner = merged.select(key, F.coalesce(prior, F.lit(0.0)).alias("a"), F.col("start").alias("b"), F.when(prior.isNull(), "leading").otherwise("interior").alias("place")).join(known.select(key), key, "left_semi")
    last = known.join(merged.groupBy(key).agg(F.max("end").alias("a")), key, "left")
    tail = last.select(key, F.coalesce("a", F.lit(0.0)).alias("a"), F.col("duration").alias("b"), F.when(F.col("a").isNull(), "interior").otherwise("trailing").alias("place"))
    long = F.col("b") - F.col("a") >= least
    return inner.where(long).unionByName(tail.where(long | (F.col("place") == "interior"))).select(key, F.col("a").alias("start"), F.col("b").alias("end"), "place")


def tolerated(start: Column, end: Column, place: Column) -> Column:
    return end - start < F.when(place == "interior", F.lit(C.INTERIOR_GAP)).otherwise(F.lit(C.EDGE_GAP))


def complete_maps(holes: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    own = holes.groupBy(key).agg(F.bool_and(tolerated(F.col("start"), F.col("end"), F.col("place"))).alias("ok"))
    return totals.select(key).join(own, key, "left").select(key, F.coalesce("ok", F.lit(True)).alias("complete"))


def span_titles(holes: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Adds titles: those of markers with half of their own length or more inside the hole, in order of start. Blank titles say nothing."""
    m = markers.select(key, F.col("start").alias("ms"), F.col("end").alias("me"), F.trim("title").alias("title")).where("title <> ''")
    both = holes.join(m, key).where((F.col("ms") < F.col("end")) & (F.col("me") > F.col("start")))
    shared = F.least("end", "me") - F.greatest("start", "ms")
    found = both.where(shared >= 0.5 * (F.col("me") - F.col("ms"))).groupBy(key, "start").agg(F.expr("transform(array_sort(collect_list(struct(ms, title))), x -> x.title)").alias("titles"))
    return holes.join(found, [key, "start"], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def describe(holes: DataFrame, key: str) -> DataFrame:
    """(key, text): one text a key for the holes that are not tolerated: how long, where, at what place, and the titles there."""
    titles = F.col("titles") if "titles" in holes.columns else F.array().cast("array<string>")
    bad = holes.where(~tolerated(F.col("start"), F.col("end"), F.col("place")))
    minutes = F.translate(F.format_number((F.col("end") - F.col("start")) / 60, 1), ",", "")  # rounds the double itself
    named = F.when(F.size(titles) > 0, F.concat(F.lit("; "), F.array_join(titles, ", "))).otherwise("")
    line = F.concat(F.format_string("%s min at %.0f-%.0fs (%s", minutes, "start", "end", "place"), named, F.lit(")"))
    return bad.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", line.alias("l")))), lambda x: x["l"]), "; ").alias("text"))


def snap_back(points: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Adds snapped: the largest segment end at or before the point (a backward as-of), 0 without one.

    Points and ends are ranked together, so a point looks at one running maximum and not at every segment.
    """
    ends = segments.select(key, F.col("end").alias("_at"), F.col("end").alias("_end"), F.lit(0).alias("_side"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns if c != key])
    mine = points.select(key, F.col("point").alias("_at"), F.lit(None).cast("double").alias("_end"), F.lit(1).alias("_side"), *[c for c in points.columns if c != key])
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return mine.unionByName(ends).withColumn("snapped", F.coalesce(F.max("_end").over(w), F.lit(0.0))).where("_side = 1").select(*points.columns, "snapped")


def snap_window(windows: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Adds left (largest end <= start) and right (smallest start >= end), outward snaps of (key, id, start, end)."""
    s = segments.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    own = windows.join(s, key, "left").groupBy(*windows.columns).agg(F.max(F.when(F.col("_e") <= F.col("start"), F.col("_e"))).alias("left"), F.min(F.when(F.col("_s") >= F.col("end"), F.col("_s"))).alias("right"))
    return own.withColumn("left", F.coalesce("left", F.lit(0.0))).withColumn("right", F.coalesce("right", "end"))


def tail_start(segments: DataFrame, points: DataFrame, key: str, context: float = C.DECODE_WINDOW) -> DataFrame:
    """(key, at, from): the end before a segment that straddles the point, and `context` seconds before it."""
    both = points.select(key, "point").join(segments, key)
    at = F.min(F.when((F.col("start") < F.col("point")) & (F.col("end") > F.col("point")), F.col("start")))
    prior = F.max(F.when(F.col("end") <= F.col("point"), F.col("end")))
    own = both.groupBy(key, "point").agg(F.coalesce(at, prior, F.lit(0.0)).alias("at"))
    return own.select(key, "at", F.greatest(F.col("at") - context, F.lit(0.0)).alias("from"))


def text_after(words: DataFrame, points: DataFrame, key: str) -> DataFrame:
    own = words.join(points.select(key, "point"), key).where(F.col("end") > F.col("point"))
    return own.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def splice_tail(segments: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """(key, text, before, after): segments that end at the point or before, then the new text; word counts of both versions."""
    both = segments.join(repairs.select(key, "point", F.col("text").alias("new")), key)
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    own = both.groupBy(key, "new").agg(joined(F.col("end") <= F.col("point")).alias("head"), joined(F.lit(True)).alias("all"))
    text = T.collapse(F.concat_ws(" ", "head", "new"))
    return own.select(key, text.alias("text"), F.size(T.tokens(F.col("all"))).alias("before"), F.size(T.tokens(text)).alias("after"))


def splice_window(segments: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """(key, text): head, the new text of the window, and tail, cut at the outward snaps. repairs: (key, start, end, text)."""
    w = snap_window(repairs.select(key, "start", "end", "text").withColumnRenamed("text", "new"), segments, key)
    both = segments.join(w.select(key, "left", "right", "new"), key)
    part = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "text")))), lambda x: x["text"]), " ")
    own = both.groupBy(key, "new").agg(part(F.col("end") <= F.col("left")).alias("head"), part(F.col("start") >= F.col("right")).alias("tail"))
    return own.select(key, T.collapse(F.concat_ws(" ", "head", "new", "tail")).alias("text"))


def locate_tail_run(words: DataFrame, key: str, n: int = C.GRAM, least: int = C.TAIL_GRAM_COUNT) -> DataFrame:
    """(key, phrase, first_pos, uses): the top gram's last cluster that reaches the end, gaps of 2 n words at most."""
    own = words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("_t"))
    top = T.with_gram_counts(own, "_t", n, "grams", least).withColumn("top", T.top_of("grams")).where("top is not null")
    at = F.expr(f"filter(sequence(0, size(_t) - {n}), i -> array_join(slice(_t, i + 1, {n}), ' ') = top.gram)")
    places = top.select(key, F.col("top.gram").alias("phrase"), F.size("_t").alias("total"), F.explode(at).alias("p"))
    back = Window.partitionBy(key).orderBy(F.desc("p"))
    nxt = F.coalesce(F.lag("p").over(back), F.col("total"))
    own = places.withColumn("_b", (nxt - (F.col("p") + n) > 2 * n).cast("int")).withColumn("_k", F.sum("_b").over(back))
    return own.where("_k = 0").groupBy(key, "phrase").agg(F.min("p").alias("first_pos"), F.count(F.lit(1)).alias("uses"))


def tail_runs(rows: DataFrame, key: str, n: int = C.GRAM, least: int = C.TAIL_GRAM_COUNT) -> DataFrame:
    """(key, tokens, phrase, first_pos, uses): locate_tail_run for rows that hold their tokens; no row leaves its task."""
    top = T.with_gram_counts(rows.select(key, "tokens"), "tokens", n, "grams", least).withColumn("top", T.top_of("grams")).where("top is not null")
    at = F.expr(f"filter(sequence(size(tokens) - {n}, 0, -1), i -> array_join(slice(tokens, i + 1, {n}), ' ') = top.gram)")
    near = f"a.near AND a.first - (p + {n}) <= {2 * n}"
    run = F.expr(f"aggregate(_at, named_struct('first', size(tokens), 'uses', 0, 'near', true), (a, p) -> named_struct('first', IF({near}, p, a.first), 'uses', a.uses + IF({near}, 1, 0), 'near', {near}))")
    own = top.select(key, "tokens", F.col("top.gram").alias("phrase"), at.alias("_at")).withColumn("_run", run)
    return own.where("_run.uses > 0").select(key, "tokens", "phrase", F.col("_run.first").alias("first_pos"), F.col("_run.uses").alias("uses"))


def loop_seconds(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(end - start, F.lit(C.LOOP_FLOOR))).otherwise(F.lit(-1.0))


def claimed_rate(words: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, words / seconds).otherwise(F.lit(-1.0))


def impossible(rate: Column) -> Column:
    return rate > C.NORMAL_RATE * C.IMPOSSIBLE_TIMES


def plausible(wpm: Column) -> Column:
    return wpm.between(C.WPM_LOW, C.WPM_HIGH)


def adopt(old_wpm: Column, new_wpm: Column) -> Column:
    """Which text to take, by whether its words a minute are plausible."""
    return F.when(plausible(new_wpm) & ~plausible(old_wpm), "adopt").when(plausible(new_wpm), "prefer_longer").when(plausible(old_wpm), "keep").otherwise("review")


def half_even(df: DataFrame, column: str, digits: int) -> DataFrame:
    """Rounds the double itself, so 2.675 gives 2.67; SQL's round works on its decimal form and gives 2.68."""
    import pandas as pd

    def own(s):
        return s.map(lambda x: None if x is None or x != x else round(x, digits))

    own.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return df.withColumn(column, F.pandas_udf(own, "double")(column))


def float_text(column: Column) -> Column:
    """A double as Python writes it: the shortest digits that read back, always with a point, powers from 1e16 and below 1e-4."""
    import pandas as pd

    def own(s):
        return s.map(lambda x: None if x is None else repr(float(x)))

    own.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(own, "string")(column.cast("double"))


def unit_of(words: list[str], most: int = 15, share: float = 0.9) -> int:
    """The smallest period at which `share` of the words equal those a period later; 0 if none does."""
    for p in range(1, min(most, len(words) - 1) + 1):
        pairs = len(words) - p
        if sum(a == b for a, b in zip(words, words[p:], strict=False)) >= share * pairs:
            return p
    return 0


def uses_of(unit: list[str], words: list[str]) -> int:
    """Non-overlapping uses of a unit among words."""
    n = at = 0
    while unit and at + len(unit) <= len(words):
        if words[at : at + len(unit)] == unit:
            n, at = n + 1, at + len(unit)
        else:
            at += 1
    return n


def adjudicate(rows: DataFrame, key: str) -> DataFrame:
    """(key, period, uses, verdict) of (key, looped, fresh): how often the loop's repeating unit, in its best rotation, is in the
    fresh text. Twice or more is real, not at all gone, else fragment if 60 % of the unit is there, or reduced. Where no period is
    found, the unit is the first three words of `phrase`, if rows have one, or else all of the loop."""
    import re

    def plain(text):
        return re.sub("[^a-z0-9 ]", "", (text or "").lower()).split()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for k, looped, fresh, *phrase in zip(*(pdf[c] for c in pdf.columns), strict=True):
                words, text = plain(looped), plain(fresh)
                p = unit_of(words)
                unit = words[:p] if p else plain(phrase[0])[:3] if phrase else words
                uses = max((uses_of(unit[r:] + unit[:r], text) for r in range(len(unit))), default=0)
                part = unit[: max(1, -(-len(unit) * 6 // 10))]
                verdict = "real" if uses >= 2 else "reduced" if uses == 1 else "fragment" if uses_of(part, text) else "gone"
                out.append((k, p, uses, verdict))
            yield pd.DataFrame(out, columns=[key, "period", "uses", "verdict"])

    return rows.select(key, "looped", "fresh", *(["phrase"] if "phrase" in rows.columns else [])).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, period int, uses int, verdict string")


def repeated_suffix(tokens: Column, period: int = C.SUFFIX_PERIOD, times: int = C.SUFFIX_REPEATS) -> Column:
    """Whether the tokens end with a unit of 1..period words said `times` times."""
    tests = [_same_tail(tokens, p, times) for p in range(1, period + 1)]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _same_tail(tokens: Column, p: int, times: int) -> Column:
    size = F.size(tokens)
    last = F.slice(tokens, F.greatest(size - p + 1, F.lit(1)), p)
    same = F.lit(True)
    for i in range(1, times):
        same = same & (F.slice(tokens, F.greatest(size - p * (i + 1) + 1, F.lit(1)), p) == last)
    return (size >= p * times) & same


def clip_healthy(df: DataFrame, text: str = "text", n: int = C.GRAM) -> DataFrame:
    """Adds healthy: no gram twice and no repeated suffix."""
    own = df.withColumn("_t", T.tokens(T.normalise_ascii(F.col(text))))
    own = T.with_gram_counts(own, "_t", n, "_many", C.CLIP_MAX_GRAM + 1)
    return own.withColumn("healthy", (F.size("_many") == 0) & ~repeated_suffix(F.col("_t"))).drop("_t", "_many")


def known_failed(windows: DataFrame, verdicts: DataFrame, key: str, tolerance: float = C.WINDOW_TOLERANCE) -> DataFrame:
    """Windows whose bounds both lie within the tolerance of a failed one of the same key."""
    v = verdicts.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return windows.join(v, (F.col(key) == F.col("_k")) & (F.abs(F.col("start") - F.col("_s")) <= tolerance) & (F.abs(F.col("end") - F.col("_e")) <= tolerance), "left_semi")


def covered(start: Column, end: Column, from_: Column, until: Column, slack: float = C.COVER_SLACK) -> Column:
    return (start >= from_ - slack) & (end <= until + slack)


def not_excluded(spans: DataFrame, exclusions: DataFrame, key: str, tolerance: float = C.WINDOW_TOLERANCE) -> DataFrame:
    """Spans that no declared exclusion of the key contains."""
    x = exclusions.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans.join(x, (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_s") - tolerance) & (F.col("end") <= F.col("_e") + tolerance), "left_anti")


def only_tails(flagged: DataFrame, disqualifying: DataFrame, key: str = "chapter") -> DataFrame:
    return flagged.select(key).distinct().join(disqualifying.select(key), key, "left_anti")


def auto_accepted(tails: DataFrame, verdicts: DataFrame, repaired: DataFrame, key: str = "chapter") -> DataFrame:
    return tails.join(verdicts.select(key), key, "left_semi").join(repaired.select(key), key, "left_semi")


def resolved(phrases: DataFrame, repaired: DataFrame, key: str = "chapter") -> DataFrame:
    return phrases.join(repaired.select(key, "text"), key).where(~F.contains(T.collapse(F.col("text")), T.collapse(F.col("phrase")))).drop("text")
