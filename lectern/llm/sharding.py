"""Jump consistent hashing: stable keys to shards without a ring table, in DataFrame expressions only.

The generator is the 64-bit linear congruential one of the published method. SQL's long arithmetic raises on overflow,
so a state is kept as two 32-bit halves and multiplied by 16-bit limbs, which never leaves 63 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

# Fixed values of the published method.
MULTIPLIER = 2862933555777941757
#: Jumps taken before the rarely needed second fold; a key takes about ln(shards) of them.
FIRST_STEPS = 64

_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
_STEP = f"""(s, i) -> IF(s.j >= {{n}}L, s,
  transform(array((s.lo & 65535L) * {_LOW}L + 1L), t0 ->
  transform(array(shiftright(s.lo, 16) * {_LOW}L + shiftright(t0, 16)), t1 ->
  transform(array((shiftright(t1, 16) + s.lo * {_HIGH}L + (((s.hi & 65535L) * {_LOW}L + shiftleft((shiftright(s.hi, 16) * {_LOW}L) & 65535L, 16)) & 4294967295L)) & 4294967295L), hi ->
    named_struct('b', s.j, 'j', cast(floor((s.j + 1) * (2147483648D / (shiftright(hi, 1) + 1))) AS bigint), 'hi', hi, 'lo', shiftleft(t1 & 65535L, 16) | (t0 & 65535L))
  )[0])[0])[0])"""


def jump(key: str, shards: int) -> Column:
    """struct(b: the key's shard among `shards`, j: where its next jump lands, at or beyond `shards`)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    step = _STEP.format(n=shards)
    first = f"aggregate(sequence(1, {min(shards, FIRST_STEPS)}), named_struct('b', -1L, 'j', 0L, 'hi', shiftright({key}, 32) & 4294967295L, 'lo', {key} & 4294967295L), {step})"
    if shards <= FIRST_STEPS:
        return F.expr(first)
    return F.expr(f"transform(array({first}), f -> IF(f.j >= {shards}L, f, aggregate(sequence({FIRST_STEPS + 1}, {shards}), f, {step})))[0]")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of docs.

    The id and the number of shards alone decide a shard, so rows that repeat an id share one. grown_shard is the
    shard with one more: either the same or the new one. size is the text's UTF-8 bytes and 8; a null text counts as
    empty (8 bytes, checksum 0). A null id takes the key -1. Slots number each shard's rows from 0 without gaps in
    order of id (nulls first), then checksum and size. Other columns of docs are not read; an empty table gives none.

    Slots come from a range partitioning by (shard, id): a row's place in its partition, less the first place of its
    shard there, and the shard's rows in earlier partitions. Those counts are one row for each partition and shard met.
    """
    tables = Tables(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    placed = own.withColumn("k", F.coalesce("id", F.lit(-1).cast("long"))).withColumn("s", jump("k", shards))
    placed = tables.write(placed.select("id", "size", "crc", F.col("s.b").alias("shard"), F.when(F.col("s.j") == shards, F.lit(shards)).otherwise(F.col("s.b")).alias("grown")), "placed")
    order = ["shard", "id", "crc", "size"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = tables.write(dealt.select("*", F.shiftright("place", 33).alias("part")), "dealt")
    tables.drop(placed)
    met = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    met = met.selectExpr("shard", "part", "coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first AS shift")
    out = dealt.join(F.broadcast(met), ["shard", "part"])  # at most partitions + shards rows
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") + F.col("shift")).alias("slot"), F.col("grown").cast("int").alias("grown_shard"))
