"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import ship, spread

CHARACTERS_A_SECOND = 15.0
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall(ts):
    """A timestamp without zone as the instant at which UTC's clocks show it, whatever zone the session is in."""
    return F.from_utc_timestamp((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"), F.current_timezone())


def at(text: str):
    """The instant at which UTC's clocks show the text."""
    return wall(F.lit(text))


def now():
    return wall(F.lit(NOW))


def seconds(ts: str):
    return F.unix_micros(wall(ts)) / 1e6


def chapters(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("chapter"), "text", (F.col("n_chars") / CHARACTERS_A_SECOND).alias("duration"))


def segments(spark, sf) -> DataFrame:
    own = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("chapter"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return own.select("chapter", "pos", F.col("pos").cast("double").alias("start"), (F.col("pos") + 1).cast("double").alias("end"), "text")


def runs(spark, sf) -> DataFrame:
    """events as runs: book = user, stage = type, ok unless it is an error, cost = value, the next event ends it."""
    e = table(spark, sf, "events").select("event_id", wall("ts").alias("ts"), "user_id", "event_type", "value")
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("book_id"), F.col("event_type").alias("stage"), F.col("ts").alias("started_at"), nxt.alias("finished_at"),
        (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("superseded"), F.col("value").alias("cost_usd"),
        F.col("event_type").isin("purchase", "signup").alias("cost_reported"), (F.col("value") / 2).alias("estimated_cost"), (F.col("event_type") == "click").alias("estimate_complete"),
        F.floor("value").cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(0).cast("long").alias("tokens_cached"),
    )


def books(spark, sf) -> DataFrame:
    """orders as books: series = customer, place = month."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("series"), F.month("o_orderdate").cast("string").alias("series_pos"), F.col("o_orderstatus").alias("status"))


#: Words that are no names, for the text operators.
COMMON = ["the", "and", "for", "that", "with"]


def forms(spark, sf) -> DataFrame:
    """Words of documents with a capital, and in how many documents they are: a list on disk, as what collects candidates leaves it."""
    from ..sources.shared import shared_path

    words = spread(table(spark, sf, "documents")).select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)))).alias("w"))
    path = shared_path(spark, "forms")
    words.groupBy(F.concat(F.upper(F.substring("w", 1, 1)), F.lower(F.substring("w", 2, 100))).alias("form")).agg(F.count(F.lit(1)).alias("count")).write.parquet(path)
    return spark.read.schema("form string, count long").parquet(path)


def names(spark, sf) -> DataFrame:
    """Part names as reference names; those of types that begin with S are an earlier volume's."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("t"), F.min("p_partkey").alias("pos"))
    return p.select(F.col("p_name").alias("name"), F.when(F.startswith("t", F.lit("S")), "carryover").otherwise("verified").alias("authority"), "pos")


def totals(spark, sf) -> DataFrame:
    """Books with their durations; customers that no event names are books without coverage."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("book"))
    return c.select("book", F.when(F.col("book") % 7 == 0, 0.0).otherwise(3_000_000.0).alias("duration"))


def spans(spark, sf) -> DataFrame:
    """events as spans of a user: from the event's second, 10 minutes for each unit of value."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("book"), (F.floor(seconds("ts")) - 1704067200).cast("double").alias("start"), (F.floor(seconds("ts")) - 1704067200 + F.floor("value") * 600).cast("double").alias("end"))
