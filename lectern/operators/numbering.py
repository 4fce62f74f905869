"""Chapter numbering, chunk plans and section classification. Tables carry their order in idx or chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import text as T


def is_contiguous(df: DataFrame, key: str, number: str = "chapter") -> DataFrame:
    """(key, contiguous): numbers without gaps or repeats from 0 or 1."""
    own = df.groupBy(key).agg(F.min(number).alias("a"), F.max(number).alias("b"), F.count_distinct(number).alias("d"), F.count(number).alias("n"))
    return own.select(key, (F.col("a").isin(0, 1) & (F.col("b") - F.col("a") + 1 == F.col("d")) & (F.col("d") == F.col("n"))).alias("contiguous"))


def cumulative(df: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """Adds start and end: running sums of size."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(size).over(w)).withColumn("start", F.col("end") - F.col(size))


def chunk_plan(chapters: DataFrame, key: str, budget: int = C.CHUNK_WORDS, least: int = C.CHUNK_MIN_FINAL) -> DataFrame:
    """(key, chunk, first, last, words) of (key, chapter, words): a chunk closes when it reaches the budget; a last one that is
    smaller than `least` joins the one before. A fold over one book's chapters, in order."""
    own = chapters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chapter", F.coalesce("words", F.lit(0)).cast("long").alias("words")))).alias("_c"))
    step = f"""aggregate(_c, named_struct('done', CAST(array() AS array<struct<first:bigint,last:bigint,words:bigint>>), 'first', CAST(null AS bigint), 'words', 0L),
      (a, x) -> IF(a.words + x.words >= {budget},
        named_struct('done', array_append(a.done, named_struct('first', coalesce(a.first, CAST(x.chapter AS bigint)), 'last', CAST(x.chapter AS bigint), 'words', a.words + x.words)), 'first', CAST(null AS bigint), 'words', 0L),
        named_struct('done', a.done, 'first', coalesce(a.first, CAST(x.chapter AS bigint)), 'words', a.words + x.words)),
      a -> CASE WHEN a.first IS NULL THEN a.done
        WHEN a.words < {least} AND size(a.done) > 0 THEN array_append(slice(a.done, 1, size(a.done) - 1), named_struct('first', element_at(a.done, -1).first, 'last', CAST(element_at(_c, -1).chapter AS bigint), 'words', element_at(a.done, -1).words + a.words))
        ELSE array_append(a.done, named_struct('first', a.first, 'last', CAST(element_at(_c, -1).chapter AS bigint), 'words', a.words)) END)"""
    return own.select(key, F.posexplode(F.expr(step)).alias("chunk", "x")).select(key, "chunk", "x.first", "x.last", "x.words")


def fill_numbers(sections: DataFrame, key: str, order: str = "idx", number: str = "number") -> DataFrame:
    """Adds chapter: a labelled section without a number takes the next one's, an unlabelled one the previous one's."""
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.coalesce(F.trim("label"), F.lit("")) != "", F.first(number, ignorenulls=True).over(ahead))
    own = sections.withColumn("_n", F.coalesce(F.col(number), named))
    return own.withColumn("chapter", F.last("_n", ignorenulls=True).over(before)).drop("_n")


def ordinals(sections: DataFrame, key: str, order: str = "idx") -> DataFrame:
    """Adds ordinal: labelled sections numbered in order."""
    labelled = F.coalesce(F.trim("label"), F.lit("")) != ""
    return sections.withColumn("ordinal", F.when(labelled, F.sum(labelled.cast("int")).over(Window.partitionBy(key).orderBy(order))))


def shift_zero(sections: DataFrame, key: str, number: str = "number") -> DataFrame:
    """Numbers one up throughout a book that has a number 0."""
    zero = F.bool_or(F.coalesce(F.col(number) == 0, F.lit(False))).over(Window.partitionBy(key))
    return sections.withColumn(number, F.when(zero, F.col(number) + 1).otherwise(F.col(number)))


def collect_chapters(sections: DataFrame, key: str) -> DataFrame:
    """(key, chapter, files, words, title) of sections (key, idx, chapter, file, words, label)."""
    return sections.where("chapter IS NOT NULL").groupBy(key, "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "file"))), lambda x: x["file"]).alias("files"), F.sum("words").alias("words"), F.min_by("label", F.when(F.coalesce("label", F.lit("")) != "", F.col("idx"))).alias("title"))


def upper_median(values: Column) -> Column:
    """The element at half the size of the sorted array: of two middle ones the upper."""
    s = F.array_sort(values)
    return F.when(F.size(s) > 0, F.element_at(s, (F.size(s) / 2).cast("int") + 1))


def size_outlier(sections: DataFrame, key: str, ratio: int = C.OUTLIER_RATIO) -> DataFrame:
    """(key, outlier): whether the first section has less than a ratio-th of the upper median of words."""
    own = sections.groupBy(key).agg(F.min_by("words", "idx").alias("first"), F.collect_list("words").alias("all"))
    return own.select(key, (F.col("first") * ratio < upper_median(F.col("all"))).alias("outlier"))


def apparatus(label: Column, exact: list[str], parts: list[str]) -> Column:
    """Whether a label is front or back matter; the cue lists are the caller's."""
    folded = T.fold_form(label)
    return F.coalesce(folded.isin(*exact) | F.exists(F.array(*map(F.lit, parts or ["\0"])), lambda cue: F.contains(folded, cue)), F.lit(False))


def excerpt(label: Column, words: Column, cues: list[str], boilerplate: Column) -> Column:
    return F.exists(F.array(*map(F.lit, cues or ["\0"])), lambda cue: F.contains(T.fold_form(label), cue)) | ((words >= C.EXCERPT_WORDS) & ~boilerplate)


def story_span(sections: DataFrame, key: str, number: str = "number") -> DataFrame:
    """(key, first, last): from the first numbered section to the last, and the unlabelled ones of its spine file after that."""
    own = sections.groupBy(key).agg(F.min(F.when(F.col(number).isNotNull(), F.col("idx"))).alias("first"), F.max(F.when(F.col(number).isNotNull(), F.col("idx"))).alias("last"), F.max_by("spine", F.when(F.col(number).isNotNull(), F.col("idx"))).alias("spine"))
    after = sections.join(own.select(key, "last", F.col("spine").alias("_sp")), key).where(F.col("idx") > F.col("last"))
    w = Window.partitionBy(key).orderBy("idx")
    broken = ((F.col("spine") != F.col("_sp")) | (F.coalesce("label", F.lit("")) != "")).cast("int")
    more = after.withColumn("_b", F.sum(broken).over(w)).where("_b = 0").groupBy(key).agg(F.max("idx").alias("more"))
    return own.join(more, key, "left").select(key, "first", F.coalesce("more", "last").alias("last"))


def titled_span(sections: DataFrame, key: str, is_apparatus: Column) -> DataFrame:
    story = F.when(~is_apparatus, F.col("idx"))
    return sections.groupBy(key).agg(F.min(story).alias("first"), F.max(story).alias("last"))


def quarantine(sections: DataFrame, span: DataFrame, key: str) -> DataFrame:
    """Adds place: front, story or back."""
    own = sections.join(span, key, "left")
    return own.withColumn("place", F.when(F.col("idx") < F.col("first"), "front").when(F.col("idx") > F.col("last"), "back").otherwise("story")).drop("first", "last")


def edge_files(files: DataFrame, key: str, depth: int = C.EDGE_DEPTH) -> DataFrame:
    """The first and last `depth` files of books with more than twice as many; the rest need no probing."""
    up, down, all_ = Window.partitionBy(key).orderBy("idx"), Window.partitionBy(key).orderBy(F.desc("idx")), Window.partitionBy(key)
    own = files.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).withColumn("_n", F.count(F.lit(1)).over(all_))
    return own.where((F.col("_n") > 2 * depth) & ((F.col("_u") <= depth) | (F.col("_d") <= depth))).drop("_u", "_d", "_n")


def not_narrative(words: Column, duration: Column) -> Column:
    return (words < C.EDGE_WORDS) & F.coalesce(duration < C.EDGE_SECONDS, F.lit(True))


def classify_edges(files: DataFrame, key: str) -> DataFrame:
    """Adds edge: leading or trailing runs of short files; none where all are short or a run exceeds EDGE_DEPTH."""
    own = files.withColumn("_short", not_narrative(F.col("words"), F.col("duration")))
    w = Window.partitionBy(key)
    first, last = F.min(F.when(~F.col("_short"), F.col("idx"))).over(w), F.max(F.when(~F.col("_short"), F.col("idx"))).over(w)
    own = own.withColumn("edge", F.when(F.col("idx") < first, "leading").when(F.col("idx") > last, "trailing"))
    n = F.count("edge").over(Window.partitionBy(key, "edge"))
    return own.withColumn("edge", F.when(n <= C.EDGE_DEPTH, F.col("edge"))).drop("_short")


def positional(markers: DataFrame, key: str) -> DataFrame:
    """(key, chapter, start, end): markers numbered by time where no gap between them reaches INTERIOR_GAP."""
    w = Window.partitionBy(key).orderBy("start")
    own = markers.withColumn("_g", F.coalesce(F.col("start") - F.lag("end").over(w), F.lit(0.0))).withColumn("chapter", F.row_number().over(w))
    return own.withColumn("_m", F.max("_g").over(Window.partitionBy(key))).where(F.col("_m") < C.INTERIOR_GAP).select(key, "chapter", "start", "end")


def manifest(markers: DataFrame, key: str) -> DataFrame:
    """(key, chapter, title, start, end, duration) of markers (key, title, start, end) whose titles number them."""
    own = markers.select(key, T.label_number(F.col("title")).alias("chapter"), T.split_title(F.col("title"))["title"].alias("title"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))
    return own.where("chapter IS NOT NULL")


def constant_shift(pairs: DataFrame, key: str) -> DataFrame:
    """(key, shift): chapter minus position, where it is one number."""
    own = pairs.groupBy(key).agg(F.min(F.col("chapter") - F.col("idx")).alias("a"), F.max(F.col("chapter") - F.col("idx")).alias("b"))
    return own.select(key, F.when(F.col("a") == F.col("b"), F.col("a")).alias("shift"))


def shift_runs(pairs: DataFrame, key: str) -> DataFrame:
    """(key, shift, first, last): islands of consecutive files with one shift."""
    w = Window.partitionBy(key).orderBy("idx")
    own = pairs.withColumn("shift", F.col("chapter") - F.col("idx"))
    new = F.coalesce(((F.col("shift") != F.lag("shift").over(w)) | (F.col("idx") != F.lag("idx").over(w) + 1)).cast("int"), F.lit(1))
    own = own.withColumn("_n", new).withColumn("_i", F.sum("_n").over(w))
    return own.groupBy(key, "_i", "shift").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("_i")


def narrated(rows: DataFrame, key: str, least: int = C.ANCHOR_RUN) -> DataFrame:
    """(key, idx, chapter) of (key, idx, announced): the longest run of consecutive announced numbers anchors a book; other
    announcements count where they keep rising outward from it; files without one take the next chapter. One book is a group."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("idx")
        said = [None if x is None or x != x else int(x) for x in pdf["announced"]]
        best, at = (0, 0), 0
        while at < len(said):
            end = at
            while said[at] is not None and end + 1 < len(said) and said[end + 1] == said[end] + 1:
                end += 1
            if said[at] is not None and end - at + 1 > best[1] - best[0]:
                best = (at, end + 1)
            at = end + 1
        out = [None] * len(said)
        if best[1] - best[0] >= least:
            out[best[0] : best[1]] = said[best[0] : best[1]]
            low = said[best[0]]
            for i in range(best[0] - 1, -1, -1):
                if said[i] is not None and said[i] < low:
                    out[i] = low = said[i]
            high = said[best[1] - 1]
            for i in range(best[1], len(said)):
                if said[i] is not None and said[i] > high:
                    out[i] = high = said[i]
            following = None
            for i in range(len(out) - 1, -1, -1):
                following = out[i] if out[i] is not None else following
                out[i] = following
        return pd.DataFrame({key: pdf[key], "idx": pdf["idx"], "chapter": pd.array(out, dtype="Int64")})

    return rows.select(key, F.col("idx").cast("long").alias("idx"), F.col("announced").cast("double").alias("announced")).groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, idx long, chapter long")


def apply_map(sections: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Sections with the chapter that a map (key, file, chapter) gives, where it names the file."""
    own = chosen.select(key, "file", F.col("chapter").alias("_c"))
    return sections.join(own, [key, "file"], "left").withColumn("chapter", F.coalesce("_c", "chapter")).drop("_c")


def contiguous_from_one(df: DataFrame, key: str, number: str = "chapter") -> DataFrame:
    own = df.groupBy(key).agg(F.min(number).alias("a"), F.max(number).alias("b"), F.count_distinct(number).alias("d"))
    return own.select(key, ((F.col("a") == 1) & (F.col("b") == F.col("d"))).alias("contiguous"))


def position_of(rows: DataFrame, mapping: DataFrame, shifts: DataFrame, key: str) -> DataFrame:
    """Adds chapter: from the map (key, idx, chapter), else idx and the book's constant shift."""
    own = rows.join(mapping.select(key, "idx", F.col("chapter").alias("_m")), [key, "idx"], "left").join(shifts, key, "left")
    return own.withColumn("chapter", F.coalesce("_m", F.col("idx") + F.col("shift"))).drop("_m", "shift")


def contiguous_run(sections: DataFrame, key: str, number: str, least: int = C.MIN_CHAPTERS) -> DataFrame:
    """(key, n, contiguous): how many sections have a number, and whether those are `least` or more that run without gap or repeat
    from 0 or 1."""
    own = sections.groupBy(key).agg(F.min(number).alias("a"), F.max(number).alias("b"), F.count_distinct(number).alias("d"), F.count(number).alias("n"))
    fine = F.col("a").isin(0, 1) & (F.col("b") - F.col("a") + 1 == F.col("d")) & (F.col("d") == F.col("n")) & (F.col("n") >= least)
    return own.select(key, "n", F.coalesce(fine, F.lit(False)).alias("contiguous"))


def build_universe(sections: DataFrame, key: str, apparatus_exact: list[str], apparatus_parts: list[str]) -> DataFrame:
    """(key, idx, chapter, place, contiguous, source) of a book's sections (key, idx, label, spine, words, strict, loose): strict is
    the number that a label states beyond doubt, loose the one that it may state.

    Loose numbers count if with them more sections are numbered and all of a book's numbers make one run; otherwise strict ones
    alone. A run from 0 moves up by one. What lies before the first numbered section or after the last and its continuations is
    front and back matter; in a book without numbers, what lies outside the first and last label that is no apparatus. Its labelled
    story sections are then numbered in order, unless the first is so short beside the others that it is no chapter. Sections
    between take the number of the next labelled or the last numbered one.
    """
    runs = contiguous_run(sections, key, "strict").select(key, F.col("n").alias("_ns"), F.col("contiguous").alias("_cs"))
    either = sections.withColumn("_either", F.coalesce("strict", "loose"))
    runs = runs.join(contiguous_run(either, key, "_either").select(key, F.col("n").alias("_nl"), F.col("contiguous").alias("_cl")), key)
    runs = runs.select(key, (F.col("_cl") & (F.col("_nl") > F.col("_ns"))).alias("_loose"), (F.col("_cl") & (F.col("_nl") > F.col("_ns")) | F.col("_cs")).alias("_run"))
    own = either.join(runs, key).withColumn("number", F.when(F.col("_loose"), F.col("_either")).otherwise(F.col("strict"))).withColumn("source", F.when(F.col("number").isNull(), F.lit("")).when(F.col("strict").isNotNull(), "strict").otherwise("loose"))
    shifted = shift_zero(own, key).withColumn("number", F.col("number").cast("long"))
    own = own.drop("number").join(shifted.select(key, "idx", F.col("number").alias("_up")), [key, "idx"]).withColumn("number", F.when(F.col("_run"), F.col("_up")).otherwise(F.coalesce(F.when(F.col("_loose"), F.col("_either")), F.col("strict")).cast("long"))).drop("_up")
    named = F.coalesce(F.trim("label"), F.lit("")) != ""
    by_number, by_title = story_span(own, key), titled_span(own, key, ~named | apparatus(F.col("label"), apparatus_exact, apparatus_parts))
    span = by_number.join(by_title.select(key, F.col("first").alias("_f"), F.col("last").alias("_l")), key).select(key, F.col("first").isNotNull().alias("_numbered"), F.coalesce("first", "_f").alias("first"), F.when(F.col("first").isNotNull(), F.col("last")).otherwise(F.col("_l")).alias("last"))
    placed = quarantine(own, span.select(key, "first", "last"), key).join(span.select(key, "_numbered"), key)
    story = placed.where("place = 'story'")
    counted = ordinals(story, key).withColumn("number", F.when(F.col("_numbered"), F.col("number")).otherwise(F.col("ordinal").cast("long")))
    counted = counted.withColumn("source", F.when(~F.col("_numbered") & F.col("number").isNotNull(), "ordinal").otherwise(F.col("source")))
    filled = fill_numbers(counted, key)
    sizes = filled.where("chapter IS NOT NULL").groupBy(key, F.col("chapter").alias("idx")).agg(F.sum("words").alias("words"))
    sound = sizes.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(size_outlier(sizes, key), key)
    out = filled.select(key, "idx", "chapter", "source").join(placed.select(key, "idx", "place", "_numbered", "_run"), [key, "idx"], "right").join(sound, key, "left")
    contiguous = (F.coalesce("_n", F.lit(0)) >= C.MIN_CHAPTERS) & F.when(F.col("_numbered"), F.col("_run")).otherwise(~F.coalesce("outlier", F.lit(False)))
    return out.select(key, "idx", "chapter", "place", contiguous.alias("contiguous"), F.coalesce("source", F.lit("")).alias("source"))
