"""Identity resolution of scanned books (path, source_path, title, author, series, sequence, asin, isbn, ...) against a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

THRESHOLD = 0.75


def title_score(a: Column, b: Column) -> Column:
    """Jaccard of title words, or one less edits over length, whichever is larger. This scorer is our own definition."""
    x, y = F.array_distinct(T.tokens(T.normalise_ascii(a))), F.array_distinct(T.tokens(T.normalise_ascii(b)))
    words = F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))
    edits = 1 - F.levenshtein(T.normalise_ascii(a), T.normalise_ascii(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(words, edits)


def fuzzy_match(books: DataFrame, catalogue: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(path, work_id, score): the best-scored work that shares a title word of four letters or more, if it reaches the threshold."""
    block = lambda df, k: df.select(*k, F.explode(F.array_distinct(F.filter(T.tokens(T.normalise_ascii(F.col("title"))), lambda x: F.length(x) >= 4))).alias("_b"))
    b, c = block(books, ["path", "title"]), block(catalogue.select("work_id", "title"), ["work_id", "title"]).withColumnRenamed("title", "other")
    pairs = b.join(c, "_b").select("path", "title", "work_id", "other").distinct()
    scored = pairs.withColumn("score", title_score(F.col("title"), F.col("other"))).where(F.col("score") >= threshold)
    return scored.groupBy("path").agg(F.max_by(F.struct("work_id", "score"), F.struct("score", F.col("work_id"))).alias("x")).select("path", "x.work_id", "x.score")


def coverage(books: DataFrame, recordings: DataFrame, works: DataFrame) -> DataFrame:
    """(path, work_id, matched_by): by ASIN, then ISBN, then title. recordings: (work_id, asin, isbn)."""
    one = lambda k: recordings.where(F.coalesce(k, F.lit("")) != "").groupBy(k).agg(F.min("work_id").alias(f"w_{k}"))
    fuzzy = fuzzy_match(books, works).select("path", F.col("work_id").alias("w_title"))
    own = books.join(one("asin"), "asin", "left").join(one("isbn"), "isbn", "left").join(fuzzy, "path", "left")
    by = F.when(F.col("w_asin").isNotNull(), "asin").when(F.col("w_isbn").isNotNull(), "isbn").when(F.col("w_title").isNotNull(), "title")
    return own.select("path", F.coalesce("w_asin", "w_isbn", "w_title").alias("work_id"), by.alias("matched_by"))


def manual(books: DataFrame, overrides: DataFrame, works: DataFrame) -> DataFrame:
    own = books.join(overrides.select("source_path", F.col("work_id").alias("asked")), "source_path").join(works.select(F.col("work_id").alias("asked"), F.lit(True).alias("known")), "asked", "left")
    return own.select("path", F.col("asked").alias("work_id"), F.when(F.col("known"), "matched").otherwise("not_found").alias("status"))


def work_details(catalogue: DataFrame) -> DataFrame:
    """(work_id, names, recordings): character names and aliases flattened, lower-cased and distinct."""
    names = F.flatten(F.transform("characters", lambda c: F.concat(F.array(c["name"]), F.coalesce(c["aliases"], F.array().cast("array<string>")))))
    return catalogue.select("work_id", F.array_sort(F.array_distinct(F.transform(names, lambda x: F.lower(F.trim(x))))).alias("names"), "recordings")


def prefer_known(known: Column, local: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(known), F.lit("")), local)


def provenance(fields: dict[str, Column]) -> Column:
    """field -> source, for fields that have one."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))


def pair_epubs(books: DataFrame, epubs: DataFrame) -> DataFrame:
    """Adds epub and note: a folder's only readable epub is its book's; none or several make a note."""
    own = epubs.groupBy("dir").agg(F.count_if("readable").alias("n"), F.min(F.when(F.col("readable"), F.col("path"))).alias("_e"))
    both = books.join(own, "dir", "left")
    return both.withColumn("epub", F.when(F.col("n") == 1, F.col("_e"))).withColumn("note", F.when(F.coalesce("n", F.lit(0)) == 0, "no epub").when(F.col("n") > 1, "several epubs")).drop("n", "_e")


def unclaimed(epubs: DataFrame, paired: DataFrame) -> DataFrame:
    return epubs.join(paired.where("epub IS NOT NULL").select(F.col("epub").alias("path")), "path", "left_anti")


def apply_overrides(books: DataFrame, overrides: DataFrame) -> DataFrame:
    return books.join(overrides, "source_path", "left").withColumn("hidden", F.coalesce("hidden", F.lit(False))).withColumn("force_audio", F.coalesce("force_audio", F.lit(False)))


def newer(a: DataFrame, b: DataFrame, key: str, generation: str) -> DataFrame:
    rest = [c for c in a.columns if c != key]
    return a.unionByName(b).groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("x")).select(key, "x.*")


def best_recording(candidates: DataFrame) -> DataFrame:
    """(path, recording_id): a sole recording; else the only one of highest score: shared narrators x 10, and 5 if runtimes are near."""
    score = 10 * F.size(F.array_intersect("narrators", "own_narrators")) + F.when(F.abs(F.col("runtime") - F.col("own_runtime")) <= 0.05 * F.col("own_runtime"), 5).otherwise(0)
    own = candidates.withColumn("s", score).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("path"))).withColumn("top", F.max("s").over(Window.partitionBy("path")))
    best = own.where((F.col("n") == 1) | ((F.col("s") == F.col("top")) & (F.col("s") > 0)))
    return best.groupBy("path").agg(F.count(F.lit(1)).alias("k"), F.min("recording_id").alias("recording_id")).where("k = 1").drop("k")


def contribution_summary(rows: DataFrame) -> DataFrame:
    """(book_id, status, attention): open before rejected before all merged; attention if a note asks for action."""
    own = rows.groupBy("book_id").agg(F.bool_or(F.col("status").isin("open", "pending")).alias("o"), F.bool_or(F.col("status") == "rejected").alias("r"), F.bool_and(F.col("status") == "merged").alias("m"), F.bool_or(F.coalesce("note", F.lit("")) != "").alias("attention"))
    return own.select("book_id", F.when(F.col("o"), "open").when(F.col("r"), "rejected").when(F.col("m"), "merged").otherwise("none").alias("status"), "attention")


def converted(scanned: DataFrame, overrides: DataFrame, root: str) -> DataFrame:
    """Scanned books (source_path, title, author, ...) as candidates: path is relative to root, an override's work wins over a found
    one, and flags without an override are false."""
    own = apply_overrides(scanned, overrides.withColumnRenamed("work_id", "_asked"))
    path = F.regexp_replace("source_path", F.lit("^" + root.rstrip("/") + "/"), F.lit(""))
    return own.withColumn("path", path).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.element_at(F.split(path, "/"), -1))).withColumn("work_id", F.coalesce(F.nullif("_asked", F.lit("")), "work_id")).drop("_asked")


def book_view(books: DataFrame, **parts: DataFrame) -> DataFrame:
    """Books with each part joined by book_id."""
    out = books
    for part in parts.values():
        out = out.join(part, out["id"] == part["book_id"], "left").drop("book_id")
    return out
