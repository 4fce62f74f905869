"""Near-duplicate documents by b-bit MinHash.

One pass over the texts gives each document its shingle count, a fingerprint of its shingle set by two independent 64-bit
hashes, band keys from the full minima of the first, and a sketch that keeps only the lowest BITS bits of each minimum, packed as bit planes. Band
keys bring candidates together; XOR and bit counts over the planes estimate their similarity, corrected for minima
that agree in their low bits by chance; and the pairs that may reach the threshold are confirmed on full shingle sets, by the
second hash, so that what the first took for equal by chance doesn't count.

No step lists all pairs of a group. Documents with equal sets fall into one class before any pairing. In each band
bucket, every class is first compared with one hub, then with another, and in large buckets with a few more, which
leaves little. Buckets whose members are connected by then need nothing more.
In the others, members outside the bucket's largest component meet all members of other components, so that every
pair that shares a bucket is either inside one component or compared: small buckets by a join, large ones inside
tasks, block by block, where only confirmed links come out. Keys of very many rows (a bucket, a hub, a class of
copies) are counted and split in every join that they key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Tables, hot_keys, semi_join_ids, split_join
from .components import connected_components

BANDS, ROWS, BITS = 32, 4, 4
N = BANDS * ROWS
#: Standard deviations that a pair's estimate may lie under the threshold and still be confirmed: a loss of 3 in ten million.
SLACK = 5.0
#: Buckets with more classes than this are compared inside tasks, in cells, and give only links instead of pairs.
SMALL_BUCKET = 64
#: Hubs that buckets are compared with at most; from the third on only large ones are.
HUBS = 4
#: Shingles that one side of a cell holds, about.
CELL_ITEMS = 1_000_000

_A = (K.mix(np.arange(1, N + 1, dtype=K.U)) >> K.U(32)).astype(np.uint32) | np.uint32(1)
_B = (K.mix(np.arange(1001, N + 1001, dtype=K.U)) >> K.U(32)).astype(np.uint32)

PLANES = [f"p{i}" for i in range(BITS * N // 64)]
SKETCH = "id long, n long, s1 long, s2 long, bands array<long>, " + ", ".join(f"{p} long" for p in PLANES)


def minima(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(documents, N) minima of N hash functions; documents without shingles must not be among counts."""
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    x = (values >> K.U(32)).astype(np.uint32)
    out = np.empty((len(counts), N), dtype=np.uint32)
    y = np.empty_like(x)
    for k in range(N):
        np.multiply(x, _A[k], out=y)
        np.bitwise_xor(y, _B[k], out=y)
        out[:, k] = np.minimum.reduceat(y, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), dtype=K.U)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, dtype=K.U)
        for r in range(ROWS):
            h = K.mix(h * K.U(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
        keys[:, b] = h
    return keys


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """(documents, BITS * N / 64) words: plane after plane, one bit a minimum."""
    planes = [np.packbits(((sig >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(BITS)]
    return np.concatenate(planes, axis=1)


def _sketch(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, end, data, offsets in K.chunks(batch.column(1)):
                values, counts, others = K.shingles(data, offsets, width, second=True)
                full = counts > 0
                cut = np.concatenate([[0], np.cumsum(counts)])
                s1, s2 = K.segment_sums(values.view(np.int64), cut), K.segment_sums(others.view(np.int64), cut)
                keys, planes = np.zeros((len(counts), BANDS), np.int64), np.zeros((len(counts), len(PLANES)), np.int64)
                if full.any():
                    sig = minima(values, counts[full])
                    keys[full], planes[full] = band_keys(sig).view(np.int64), bit_planes(sig).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(counts), pa.array(s1), pa.array(s2), bands, *(pa.array(planes[:, i].copy()) for i in range(len(PLANES)))], names=[x.split()[0] for x in SKETCH.split(", ")])

    return run


def _sets(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, end, data, offsets in K.chunks(batch.column(1)):
                values, counts = K.shingles(data, offsets, width, seed=1)
                cut = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(cut), pa.array(values.view(np.int64)))], names=["id", "items"])

    return run


def estimate(a: str, b: str) -> Column:
    """Similarity of two sketches, corrected for chance agreement of BITS-bit minima."""
    per = N // 64
    off = F.lit(0)
    for w in range(per):
        differ = F.lit(0).cast("long")
        for plane in range(BITS):
            p = PLANES[plane * per + w]
            differ = differ.bitwiseOR(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}")))
        off = off + F.bit_count(differ)
    chance = 2.0**-BITS
    return (1 - off / F.lit(float(N)) - chance) / (1 - chance)


def _may_link(threshold: float) -> Column:
    return (F.col("a.n") >= F.lit(threshold - 1e-9) * F.col("b.n")) & (F.col("b.n") >= F.lit(threshold - 1e-9) * F.col("a.n")) & (estimate("a", "b") >= _cut(threshold))


def _confirm(tables: Tables, texts: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """The candidates (a: a hub, which may have very many, b) whose full sets have 100 * intersection >= percent * union."""
    candidates = tables.write(candidates, "candidates")
    ids = tables.write(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    sets = tables.write(semi_join_ids(texts, ids, "id", ids.count()).mapInArrow(_sets(width), "id long, items array<long>").where(F.size("items") > 0), "sets")
    left, right = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    hot = hot_keys(tables, candidates.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    # Hubs join last, so that a pair carries its other set only. An id of several texts has several sets.
    pairs = split_join(candidates.join(right, "b"), left, ["a"], hot, ["b"]).select("a", "b", common.alias("both"), (F.size("items_a") + F.size("items_b") - common).alias("all"))
    links = tables.write(pairs.where(F.col("both") * 100 >= F.col("all") * percent).select("a", "b").distinct(), "links")
    tables.drop(candidates, ids, sets)
    return links


def _cut(threshold: float) -> float:
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - SLACK * (agree * (1 - agree) / N) ** 0.5 / (1 - chance)


def _compare_cell(percent: int):
    """Links between the two sides of a cell: those of a bucket's smaller components, and all its members. What links given so far
    connect isn't compared again, so a cell gives fewer links than it has members, however many of its pairs are alike."""
    cut = _cut(percent / 100)
    least = (1 - 2.0**-BITS) * (cut + 2.0**-BITS / (1 - 2.0**-BITS))

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        col = {c: table.column(c).to_numpy() for c in ("key", "side", "node", "component", "top", "n", *PLANES)}
        planes = np.stack([col[p] for p in PLANES], axis=1).view(np.uint64)
        flat = lambda c: (table.column(c).combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(table.column(c).combine_chunks().value_lengths().to_numpy())]))
        (bands, _), (items, at) = flat("bands"), flat("items")
        bands, items = bands.reshape(-1, BANDS), items.view(np.uint64)
        n, per, links, label = np.diff(at), N // 64, [], col["component"].copy()
        other = np.flatnonzero(col["side"] == 1)
        for a in np.flatnonzero(col["side"] == 0):
            b = other[(label[other] != label[a]) & ((col["component"][other] == col["top"][other]) | (col["node"][other] > col["node"][a]))]
            b = b[(100 * n[b] >= percent * n[a]) & (100 * n[a] >= percent * n[b])]
            differ = planes[b] ^ planes[a]
            off = sum(np.bitwise_count(np.bitwise_or.reduce(differ[:, w::per], axis=1)).astype(np.int64) for w in range(per))
            b = b[1 - off / N >= least - 1e-9]
            # A pair that shares several buckets counts in the first.
            same = np.where(bands[b] == bands[a], bands[b], np.iinfo(np.int64).max).min(axis=1)
            b = b[same == col["key"][a]]
            if not len(b):
                continue
            own = items[at[a] : at[a + 1]]
            theirs = np.concatenate([items[at[x] : at[x + 1]] for x in b])
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.add.reduceat((own[place] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(n[b])[:-1]]))
            hit = b[100 * both >= percent * (n[a] + n[b] - both)]
            for x in hit:
                if label[x] != label[a]:
                    links.append((col["node"][a], col["node"][x]))
                    label[label == label[x]] = label[a]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _compare_in_cells(texts: DataFrame, rows: DataFrame, tables: Tables, width: int, percent: int) -> DataFrame:
    """Links (a, b) within large buckets. Each bucket is dealt into blocks, and each pair of blocks is a cell of its own."""
    ids = tables.write(rows.select(F.col("node").alias("id")).distinct(), "cell-ids")
    sets = tables.write(semi_join_ids(texts, ids, "id", ids.count()).mapInArrow(_sets(width), "id long, items array<long>").where(F.size("items") > 0), "cell-sets")
    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(sets.withColumnRenamed("id", "node"), "node")
    blocks = F.expr("explode(sequence(0, blocks - 1))")
    columns = ["key", "x", "y", "side", "node", "component", "top", "n", "bands", *PLANES, "items"]
    left = own.where("component <> top").select("*", F.lit(0).alias("side"), F.col("block").alias("x"), blocks.alias("y")).select(columns)
    right = own.select("*", F.lit(1).alias("side"), F.col("block").alias("y"), blocks.alias("x")).select(columns)
    links = left.unionByName(right).groupBy("key", "x", "y").applyInArrow(_compare_cell(percent), "a long, b long")
    links = tables.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cell-links")
    tables.drop(ids, sets)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Links join rows whose sets of `width`-word shingles have 100 * intersection >= percent * union. component_id is
    the smallest id reachable over links; kept says that it is the row's own. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat an id count as one vertex. A row with a null id keeps a
    null component and is kept, since nothing can stand in for it. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = tables.write(texts.mapInArrow(_sketch(width), SKETCH), "sketch")
    known = texts.where("id is not null")
    usable = sketch.where("n > 0 and id is not null")
    classes = usable.groupBy("s1", "s2", "n").agg(F.min_by(F.struct("id", "bands", *PLANES), "id").alias("x"), F.count(F.lit(1)).alias("copies"))
    classes = tables.write(classes.select(F.col("x.id").alias("node"), "copies", "s1", "s2", "n", "x.bands", *[f"x.{p}" for p in PLANES]), "classes")
    reps = classes.select(F.col("node").alias("id"), "n", "bands", *PLANES)

    keyed = reps.select(F.col("id").alias("node"), F.explode("bands").alias("key")).distinct()
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("hub < last")
    buckets = tables.write(buckets.select("key", "hub", "n"), "buckets")
    crowded = hot_keys(tables, buckets, "key")
    members = tables.write(split_join(keyed, buckets.select("key", "hub"), ["key"], crowded, ["node"]), "members")

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs (a: the hub, b) that the sketches don't rule out."""
        pairs = tables.write(pairs, "pairs")
        hot = hot_keys(tables, pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "a")
        a, b = (reps.select(F.col("id").alias(x), F.struct("n", *PLANES).alias(f"s{x}")) for x in "ab")
        both = split_join(pairs.join(b, "b"), a, ["a"], hot, ["b"]).select(F.struct("a", "sa.*").alias("a"), F.struct("b", "sb.*").alias("b"))
        return both.where(_may_link(percent / 100)).select(F.col("a.a").alias("a"), F.col("b.b").alias("b"))

    def mixed() -> DataFrame:
        """Members of buckets that more than one component has part in, with their component."""
        own = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        several = own.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("size")).where("c1 < c2").select("key", "size")
        return split_join(own, several, ["key"], crowded, ["node"])

    links = _confirm(tables, known, compared(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()), width, percent)
    labels = connected_components(tables, links)

    # Further hubs for buckets that are not yet connected: of its members the first by a hash, so that buckets share theirs.
    left = tables.write(mixed(), "mixed")
    for nth in range(2, HUBS + 1):
        now = left if nth == 2 else left.where(F.col("size") > SMALL_BUCKET)
        if now.isEmpty():
            break
        hubs = now.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64(F.lit(nth), "node")).alias("hub"))
        pairs = split_join(now, hubs, ["key"], crowded, ["node"]).where("component <> hub.component").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
        more = _confirm(tables, known, compared(pairs), width, percent)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        labels = connected_components(tables, links)
        tables.drop(left)
        left = tables.write(mixed(), "mixed")

    # The rest: members outside a bucket's largest component meet the members of its other components.
    largest = left.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
    full = split_join(left.select("key", "node", "component"), largest, ["key"], crowded, ["node"]).join(reps.select(F.col("id").alias("node"), "n", "bands", *PLANES), "node")
    full = tables.write(full, "rest")
    large = full.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.sum("n") / CELL_ITEMS).cast("int").alias("blocks")).where(F.col("size") > SMALL_BUCKET)
    large = tables.write(large.select("key", "blocks"), "large")
    small = full.join(large, "key", "left_anti")
    a, b = small.where("component <> top").alias("a"), small.alias("b")
    once = (F.col("b.component") == F.col("b.top")) | (F.col("a.node") < F.col("b.node"))
    first = F.array_min(F.array_intersect("a.bands", "b.bands")) == F.col("a.key")
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & once & _may_link(percent / 100) & first)
    rest = rest.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
    last = _confirm(tables, known, rest, width, percent)
    if not large.isEmpty():
        last = last.unionByName(_compare_in_cells(known, full.join(large, "key"), tables, width, percent))
    if not last.isEmpty():
        labels = connected_components(tables, links.unionByName(last))
    tables.drop(left, full, large)

    groups = classes.join(labels, "node", "left").where("copies > 1 or component is not null").select("s1", "s2", "n", F.coalesce("component", "node").alias("component"))
    groups = tables.write(groups, "groups")
    copies = hot_keys(tables, classes.where("copies > 1").select("s1", "s2", F.col("n").alias("size"), F.col("copies").alias("n")), "s1", "s2", "size")
    tables.drop_all_but(sketch, groups, copies)
    copies = None if copies is None else copies.withColumnRenamed("size", "n")
    out = split_join(sketch.select("id", "n", "s1", "s2"), groups, ["s1", "s2", "n"], copies, ["id"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
