"""Event streams: replay, last-write-wins folds, rolling counts, moving averages and due timers.

Events have (event_id, ts, key, type, value, ...). Order is by event_id; duplicates are dropped by it within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..sources.shared import shared_path


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def dedupe(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def replay(events: DataFrame, cursor: int) -> DataFrame:
    """What a reader that has seen `cursor` still has to see."""
    return events.where(F.col("event_id") > cursor)


def cursor(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("cursor"))


def last_write(events: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    """The value of each key's latest event; a streaming or a batch fold."""
    return events.groupBy(*keys).agg(F.max_by(value, "event_id").alias(value), F.max("event_id").alias("event_id"))


def counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def rolling(events: DataFrame, key: str, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), key).agg(F.count(F.lit(1)).alias("n"))


def moving_average(events: DataFrame, key: str = "key", alpha: float = C.EWMA_ALPHA) -> DataFrame:
    """(key, rate, n): each key's average after a micro-batch, its samples folded in order of event_id. One double a key is kept."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(k, batches: Iterator, state: GroupState):
        import pandas as pd

        rate, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for v in rows["value"]:
            if v is not None and v == v and v > 0:
                rate, n = (v if rate is None else alpha * v + (1 - alpha) * rate), n + 1
        state.update((rate, n))
        yield pd.DataFrame({key: [k[0]], "rate": [rate], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "event_id", "value").groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, rate double, n long", "rate double, n long", "update", GroupStateTimeout.NoTimeout)


def changed(events: DataFrame, key: str = "key") -> DataFrame:
    """Events whose value differs from the key's last one; the last value is the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(k, batches: Iterator, state: GroupState):
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("event_id").itertuples():
            if r.value != last:
                out.append((k[0], r.event_id, r.value))
                last = r.value
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id", "value"])

    kind, value = events.schema[key].dataType.simpleString(), events.schema["value"].dataType.simpleString()
    return events.select(key, "event_id", "value").groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, event_id long, value {value}", f"value {value}", "append", GroupStateTimeout.NoTimeout)


def _instant(now) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def due(parked: DataFrame, now) -> DataFrame:
    return parked.where(F.col("retry_at").isNotNull() & (F.col("retry_at") <= _instant(now)))


def stale(rows: DataFrame, now, grace: str = "INTERVAL 7 DAYS") -> DataFrame:
    return rows.where(_instant(now) >= F.col("updated_at") + F.expr(grace))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs the stream over what is there and ends; each micro-batch lands once."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs the stream over what is there and returns the rows of its micro-batches, with `batch`. Offsets, state and rows are
    kept in the session's shared folder."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    to_table(stream, f"{path}/rows", f"{path}/state", mode).awaitTermination()
    own = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]) if mode != "append" else stream.schema
    return spark.read.schema(own).parquet(f"{path}/rows")


def patch(state: DataFrame, changes: DataFrame, key: str, order: str = "event_id") -> DataFrame:
    """state with each key's latest change written over it; keys that only changes have are added, nulls in a change leave what was."""
    columns = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_x"))
    both = state.join(last, key, "full")
    return both.select(key, *[F.coalesce(F.col("_x")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in state.columns if c != key])


def replace(state: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """state with the snapshot's columns as the snapshot has them: a key that it lacks has none."""
    columns = [c for c in snapshot.columns if c != key]
    return state.drop(*columns).join(snapshot, key, "left").select(*state.columns)


def ticking(stream: DataFrame, sink, every: str = "1 minute"):
    """Starts the stream with a micro-batch each `every`; sink(batch, number) sees each once."""
    return stream.writeStream.foreachBatch(sink).trigger(processingTime=every).start()
