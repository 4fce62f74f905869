"""Shared plumbing: tables in the cluster's shared folder, checked broadcasts, range shards, files."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has at most this many rows of a few longs (about 16 MB).
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own in local mode; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = context._lectern_shared = getattr(context, "_lectern_shared", None) or "file://" + tempfile.mkdtemp(prefix="lectern-")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, with the scheme of its store, so that Python on executors finds the same place."""
    fs, p = _hadoop(spark, f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}")
    return fs.makeQualified(p).toString()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def barrier(condition: Column) -> Column:
    """The condition, in a form that stays where it is: a filter on it would otherwise be pushed below the columns that it is
    computed from, with each of them, and all that they come from, written out in it again."""
    return condition & (F.monotonically_increasing_id() >= 0)


class Tables:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if found := self.paths.pop(id(t), None):
                delete(self.spark, found[1])

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*[t for t, _ in list(self.paths.values()) if not any(t is k for k in kept)])


#: Bytes of the strings of a side that is broadcast, at most.
BROADCAST_BYTES = 32 << 20


def few(table: DataFrame) -> bool:
    """Whether a written table is small enough to be broadcast, by rows and by the bytes of its strings."""
    texts = [F.octet_length(f.name) for f in table.schema.fields if f.dataType.simpleString() == "string"]
    r = table.agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(f"b{i}") for i, t in enumerate(texts)]).first()
    return r[0] <= BROADCAST_ROWS and sum(b or 0 for b in r[1:]) <= BROADCAST_BYTES


def semi_join_ids(df: DataFrame, ids: DataFrame, column: str, rows: int) -> DataFrame:
    """Rows of df whose column is in ids (one column of longs): broadcast if few, else shuffled."""
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids.hint("merge"), column, "left_semi")


#: Keys that a join splits, at most, and the rows of a key below which none is split.
HOT_KEYS, HOT_ROWS = 20_000, 256


def hot_keys(tables: Tables, counts: DataFrame, *key: str) -> DataFrame | None:
    """(key, parts) of the keys with more than a HOT_KEYS-th of all rows, and more than HOT_ROWS; None if there are none.

    counts: (key, n), each key once. No more than HOT_KEYS keys can have so many rows, so the table is always fit for a broadcast.
    """
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    per = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= per:
        return None
    return tables.write(counts.where(F.col("n") > per).select(*key, F.ceil(F.col("n") / per).cast("int").alias("parts")), "hot")


def split_join(big: DataFrame, small: DataFrame, key: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """big joined with small, which has each key once. Rows of a hot key are dealt over its parts by a hash of `by`, and small's
    row is there in each part, so that no key lands in one task."""
    if hot is None:
        return big.join(small, key, how)
    parts = F.coalesce("parts", F.lit(1))
    left = big.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("parts")
    right = small.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*key, "_part"], how).drop("_part")


def range_bounds(df: DataFrame, key: str, weight: str, target: float, sample_rows: int = 32_768) -> list[int]:
    """Ascending upper bounds (exclusive) of key ranges of about `target` weight each.

    Bounds come from a sample of keys chosen by their hash, so they depend on the rows alone, not on
    how they are dealt over tasks. About sample_rows distinct keys reach the driver, however many rows there are.
    """
    n = df.agg(F.approx_count_distinct(key)).first()[0]
    step = max(1, -(-n // sample_rows))
    found = df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(step)) == 0)).groupBy(key).agg(F.sum(weight).alias("w")).orderBy(key).collect()
    bounds, run = [], 0.0
    for k, w in found:
        if run >= target:
            bounds.append(k)
            run = 0.0
        run += (w or 0) * step
    return bounds


# Files ---------------------------------------------------------------------------------------


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in any store that pyarrow knows, or of a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def writing(uri: str) -> Iterator[io.RawIOBase]:
    store, path = filesystem(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        yield out


def reading(uri: str):
    store, path = filesystem(uri)
    return store.open_input_stream(path)


def publish(temporary: str, final: str) -> None:
    """Renames a finished file; repeating it is harmless, so a retried task may call it again."""
    from pyarrow import fs

    store, old = filesystem(temporary)
    new = filesystem(final)[1]
    if store.get_file_info(old).type != fs.FileType.NotFound:
        store.create_dir(new.rsplit("/", 1)[0], recursive=True)
        store.move(old, new)
    elif store.get_file_info(new).type == fs.FileType.NotFound:
        raise FileNotFoundError(temporary)
