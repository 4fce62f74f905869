"""What sharded file writers share: temporary names, a manifest, and a commit that can be repeated.

A task writes each file under a name that no other attempt uses and reports it in its manifest row. The manifest is
written as a table first; only files named there are published, so leftovers of lost attempts never count.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, delete, publish, range_bounds, writing

MANIFEST = "shard int, seq int, temporary string, final string, records long, units long, bytes long"


def with_shard(df: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """Adds `shard` (int): how many bounds are at or below the key; null keys go to shard 0. A binary search in the JVM."""
    if not bounds:
        return df.withColumn("shard", F.lit(0))
    edges = F.lit(np.array(bounds, dtype=np.int64))
    steps = len(bounds).bit_length()
    half = lambda a: ((a["lo"] + a["hi"]) / 2).cast("int")
    below = lambda a: F.element_at(edges, half(a) + 1) <= F.col(key)

    def step(a, _):
        go = a["lo"] < a["hi"]
        return F.struct(F.when(go & below(a), half(a) + 1).otherwise(a["lo"]).alias("lo"), F.when(go & ~below(a), half(a)).otherwise(a["hi"]).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda a: a["lo"])
    return df.withColumn("shard", F.when(F.col(key).isNull(), F.lit(0)).otherwise(found))


def deal(df: DataFrame, key: str, weight: str, target: float, *then: str) -> DataFrame:
    """df with `shard`, each shard one partition in order of (key, *then); shards ascend with key."""
    bounds = range_bounds(df, key, weight, target)
    return with_shard(df, key, bounds).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(F.col(key).asc_nulls_first(), *then)


def _publish(batches):
    for batch in batches:
        for old, new in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist(), strict=True):
            publish(old, new)
        yield batch


def commit(spark: SparkSession, written: DataFrame, out: str) -> DataFrame:
    """Runs the writing job, publishes its files and returns the manifest, which stays in out/_manifest."""
    tables = Tables(spark)
    manifest = tables.write(written, "manifest")
    files = max(1, min(manifest.count(), 1000))
    manifest.repartition(files).mapInArrow(_publish, MANIFEST).write.parquet(f"{out}/_manifest")
    tables.drop(manifest)
    final = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    total = final.agg(F.count(F.lit(1)), F.sum("records"), F.sum("units"), F.sum("bytes")).first()
    with writing(f"{out}/_COMMITTED.tmp") as f:
        f.write(json.dumps(dict(zip(("files", "records", "units", "bytes"), total, strict=True))).encode())
    publish(f"{out}/_COMMITTED.tmp", f"{out}/_COMMITTED")
    delete(spark, f"{out}/_temporary")
    return final


def spread(manifest: DataFrame, *columns: str) -> DataFrame:
    """One row a file, dealt over as many tasks as there are files (10,000 at most)."""
    return manifest.select(*columns).repartition(max(1, min(manifest.count(), 10_000)))
