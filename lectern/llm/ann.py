"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into the leaf that greedy descent reaches. A search keeps
a priority queue of tree nodes by the inner product of query and centroid, and visits leaves in the order they come off it.
How many leaves a search visits is calibrated: for a set of calibration queries all true neighbours are found by brute force
over all rows, and the number of visits widens until the share of true neighbours in visited leaves reaches the target. If no
number short of all leaves does, all are visited and the search is exact.

Equal vectors are one point of the index, with the smallest ids that could ever be reported, so a very common vector costs no
more than a rare one. (An id of several vectors is a point for each, of which a query reports the best.) Scoring runs in cells
of a block of points and a block of queries: small leaves share a cell, so that a query passes on one short list for many
leaves, and full leaves are dealt over several, so that every cell is bounded. Points go only to the blocks of queries that
visit their cell. Equal scores go to the smaller id at every cut, which is why points carry their smallest.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, Tables

#: Vectors that the tree is fitted on, at most.
FIT_ROWS = 20_000
BRANCHES, MAX_LEAVES = 8, 4096
#: Points a leaf should hold while there are fewer than MAX_LEAVES leaves.
LEAF_POINTS = 500
CALIBRATION, TARGET_RECALL = 200, 0.95
#: Points, and queries, of a cell, about.
CELL = 8192


@dataclass
class Tree:
    """Nodes in one array; children[i] is empty for leaves, and leaf[i] their number, else -1."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row by descent to the nearest child."""
        out = np.zeros(len(x), dtype=np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
            elif len(rows):
                near = _nearest(x[rows], self.centroids[kids])
                stack += [(kid, rows[near == k]) for k, kid in enumerate(kids)]
        return out

    def order(self, q: np.ndarray):
        """Leaf numbers, best bin first."""
        score = self.centroids @ q
        heap = [(-score[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                yield int(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(heap, (-score[kid], kid))


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers * centers).sum(axis=1) - 2 * (x @ centers.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        for c in range(k):
            if (own := near == c).any():
                centers[c] = x[own].mean(axis=0)
    return centers, _nearest(x, centers)


def fit_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centroids, children, leaf, made = [sample.mean(axis=0)], [[]], [-1], 1
    # The fullest node is split next, until there are leaves enough.
    heap = [(-len(sample), 0, sample)]
    while heap and made + BRANCHES - 1 <= max(leaves, 1) and -heap[0][0] >= 2 * BRANCHES:
        _, node, own = heapq.heappop(heap)
        centers, near = _kmeans(own, BRANCHES, rng)
        for c in range(BRANCHES):
            if (near == c).any():
                children[node].append(len(centroids))
                centroids.append(centers[c])
                children.append([])
                leaf.append(-1)
                heapq.heappush(heap, (-int((near == c).sum()), len(centroids) - 1, own[near == c]))
        made += len(children[node]) - 1
    out = Tree(np.array(centroids), children, np.array(leaf))
    out.leaf[[i for i, kids in enumerate(children) if not kids]] = np.arange(sum(not kids for kids in children))
    return out


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _assigner(tree: Tree):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(_matrix(batch.column("v"))) if len(batch) else [], pa.int32())], names=[*batch.schema.names, "leaf"])

    return run


def best(queries: np.ndarray, x: np.ndarray, low: np.ndarray, k: int, visible=None, shared: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, point's place, score) of the k points of largest inner product for each query, ties to the smaller `low`.

    A matrix product finds all that may be among them; those are scored anew, each pair in one order of summing, so that equal
    vectors score alike whatever block they are in. visible: which points a query sees. shared: points may share a low, which
    then counts once, by its best point.
    """
    rows, cols, scores = [], [], []
    norms = np.abs(x).sum(axis=1).max(initial=0.0)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rough = q @ x.T
        if visible is not None:
            rough[~visible[at : at + 256]] = -np.inf
        if shared:
            near = rough > -np.inf
        else:
            m = min(k, rough.shape[1])
            cut = np.partition(rough, rough.shape[1] - m, axis=1)[:, rough.shape[1] - m]
            near = (rough > -np.inf) & (rough >= (cut - 1e-12 * np.abs(q).max(axis=1, initial=0.0) * norms)[:, None])
        r, c = np.nonzero(near)
        exact = np.concatenate([(x[c[i : i + 65_536]] * q[r[i : i + 65_536]]).sum(axis=1) for i in range(0, len(r), 65_536)] or [np.zeros(0)])
        order = np.lexsort((low[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        if shared and len(r):
            _, first = np.unique(np.stack([r, low[c]], axis=1), axis=0, return_index=True)
            first.sort()
            r, c, exact = r[first], c[first], exact[first]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        rows.append(r[place < k] + at)
        cols.append(c[place < k])
        scores.append(exact[place < k])
    return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in ((rows, np.int64), (cols, np.int64), (scores, np.float64)))


def _brute(queries: np.ndarray, names: np.ndarray, k: int, shared: bool):
    """Per batch, the k best rows for each query: what an exact scan passes on."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            points, low, leaves = (batch.column(c).to_numpy() for c in ("point", "low", "leaf"))
            r, c, score = best(queries, _matrix(batch.column("v")), low, k, names[:, None] != points[None, :], shared)
            yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(low[c]), pa.array(leaves[c]), pa.array(score)], names=["query", "low", "leaf", "score"])

    return run


def _prober(tree: Tree, visits: int, cell_of: np.ndarray):
    """For each query and cell that it visits, the leaves to look at there."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, cells, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"))):
                seen = np.fromiter((leaf for leaf, _ in zip(tree.order(q), range(visits), strict=False)), dtype=np.int32)
                for c in np.unique(cell_of[seen]):
                    rows.append(i)
                    cells.append(c)
                    leaves.append(seen[cell_of[seen] == c])
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("point").take(rows), batch.column("v").take(rows), pa.array(cells, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["query", "v", "cell", "leaves"])

    return run


def deal_leaves(counts: dict[int, int], leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each leaf, and into how many blocks each leaf's points are dealt: small leaves share cells, full ones are split."""
    cell, blocks, now, held = np.zeros(leaves, np.int32), np.ones(leaves, np.int32), 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if held and held + n > CELL:
            now, held = now + 1, 0
        cell[leaf], blocks[leaf] = now, max(1, -(-n // CELL))
        held += n
    return cell, blocks


def _score(k: int, shared: bool):
    """The k best points of a cell for each of its queries, scored in double precision on the original vectors."""

    def run(key, left, right):
        import pyarrow as pa

        names, kinds = ["query", "point", "low", "score"], [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        x, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        points, low, queries = left.column("point").to_numpy(), left.column("low").to_numpy(), right.column("query").to_numpy()
        leaf, asked = left.column("leaf").to_numpy(), right.column("leaves").combine_chunks()
        least = int(leaf.min())
        sees = np.zeros((len(q), int(leaf.max()) - least + 1), dtype=bool)
        who, what = np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy() - least
        here = (what >= 0) & (what < sees.shape[1])
        sees[who[here], what[here]] = True
        r, c, score = best(q, x, low, k, Seen(sees, leaf - least), shared)
        return pa.Table.from_arrays([pa.array(queries[r], pa.int64()), pa.array(points[c], pa.int64()), pa.array(low[c], pa.int64()), pa.array(score, pa.float64())], names=names)

    return run


class Seen:
    """Which points each query sees, by leaf; made for a slice of queries at a time."""

    def __init__(self, sees: np.ndarray, leaf: np.ndarray):
        self.sees, self.leaf = sees, leaf

    def __getitem__(self, rows) -> np.ndarray:
        return self.sees[rows][:, self.leaf]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows that take part. Null, empty, zero and non-finite vectors don't, nor rows without an id, nor vectors whose
    length isn't the most common one (the larger, if equally common)."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    own = vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    length = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return own.where(F.size("v") == (length["d"] if length else 0))


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", leaf_points: int = LEAF_POINTS, target: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, id_col, score): for each row whose id is divisible by query_every, the k rows found of largest inner
    product among all others, best first, ties to the smaller id, also where very many tie; fewer if there are fewer.

    Rows that repeat an id and vector count once; different vectors of one id are points of their own, of which a query
    reports the best, and none of its own id. Tables without usable vectors or queries give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    own = usable(vectors, id_col, vector_col)
    keep = k + 1  # the query's own id is among them at most once
    # Ids of several vectors aren't merged with others, so that such an id is the only one of its points.
    named = own.groupBy("id").agg(F.min(F.xxhash64("v")).alias("a"), F.max(F.xxhash64("v")).alias("b")).where("a < b").select("id", F.lit(True).alias("several"))
    named = tables.write(named, "several")
    several = named.count()
    own = own.distinct()
    if several:
        own = own.join(F.broadcast(named) if several <= BROADCAST_ROWS else named, "id", "left").withColumn("alone", F.when(F.col("several"), F.col("id"))).drop("several")
    else:
        own = own.withColumn("alone", F.lit(None).cast("long"))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("v", "alone").orderBy("id"))).where(F.col("r") <= keep)
    points = ranked.groupBy("v", "alone").agg(F.sort_array(F.collect_list("id")).alias("ids")).drop("alone").withColumn("point", F.monotonically_increasing_id())
    points = tables.write(points.withColumn("low", F.element_at("ids", 1)), "points")
    n = points.count()
    schema = f"query_id long, rank int, {id_col} long, score double"
    if not n:
        return spark.createDataFrame([], schema)

    sample = np.array([r["v"] for r in points.orderBy(F.xxhash64("v"), "point").limit(FIT_ROWS).select("v").collect()], dtype=np.float64)
    tree = fit_tree(sample, min(MAX_LEAVES, -(-n // leaf_points)))
    assigned = points.mapInArrow(_assigner(tree), T.StructType([*points.schema.fields, T.StructField("leaf", T.IntegerType())]))
    assigned = tables.write(assigned, "assigned")

    # A query is a vector, and the smallest of the points that hold it stands for it.
    asks = own.where(F.col("id") % query_every == 0).select("id", "v").distinct().join(points.groupBy("v").agg(F.min("point").alias("point")) if several else points.select("v", "point"), "v").select(F.col("id").alias("query_id"), "point")
    asks = tables.write(asks, "asks")
    queries = points.join(asks.select("point").distinct(), "point", "left_semi").select("point", "v")

    visits = calibrate(queries, assigned, tree, k, target, several > 0)
    held = {r["leaf"]: r["count"] for r in assigned.groupBy("leaf").count().collect()}  # MAX_LEAVES rows at most
    cell_of, blocks = deal_leaves(held, tree.leaves)
    kind = points.schema["v"].dataType.simpleString()
    probes = tables.write(queries.mapInArrow(_prober(tree, visits, cell_of), f"query long, v {kind}, cell int, leaves array<int>"), "probes")
    asked = {r["cell"]: r["count"] for r in probes.groupBy("cell").count().collect()}
    # Of each cell: how many blocks its points are in, and how many the queries that visit it; none does, and its points stay out.
    wide = {int(c): (int(blocks[cell_of == c].max()), -(-asked[int(c)] // CELL)) for c in np.unique(cell_of) if int(c) in asked}
    dealt = spark.createDataFrame([(i, int(c), int(b), wide[int(c)][1]) for i, (c, b) in enumerate(zip(cell_of, blocks, strict=True)) if int(c) in wide], "leaf int, cell int, px int, py int")
    widest = spark.createDataFrame([(c, *w) for c, w in wide.items()], "cell int, px int, py int")
    cells = ["cell", "x", "y"]
    left = assigned.join(F.broadcast(dealt), "leaf").select("cell", F.pmod(F.xxhash64("point"), "px").cast("int").alias("x"), F.expr("explode(sequence(0, py - 1))").alias("y"), "leaf", "point", "low", "v")
    right = probes.join(F.broadcast(widest), "cell")
    right = right.select("cell", F.expr("explode(sequence(0, px - 1))").alias("x"), F.pmod(F.xxhash64("query"), "py").cast("int").alias("y"), "query", "v", "leaves")
    found = left.groupBy(cells).cogroup(right.groupBy(cells)).applyInArrow(_score(keep, several > 0), "query long, point long, low long, score double")

    if several:  # points that share an id count once, by the best
        found = found.groupBy("query", "low").agg(F.max_by(F.struct("point", "score"), F.struct("score", (-F.col("point")).alias("p"))).alias("b")).select("query", "b.point", "low", "b.score")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    best_ = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).join(points.select("point", "ids"), "point")
    lists = best_.groupBy("query").agg(F.flatten(F.collect_list(F.expr("transform(ids, i -> named_struct('s', -score, 'id', i))"))).alias("all"))  # (k + 1) ** 2 at most
    lists = lists.select(F.col("query").alias("point"), F.array_sort("all").alias("all"))
    mine = asks.join(lists, "point").withColumn("all", F.expr("filter(all, x -> x.id <> query_id)"))
    # An id of several vectors, or a query id of several, keeps its best.
    flat = mine.select("query_id", F.explode("all").alias("x")).groupBy("query_id", F.col("x.id").alias("id")).agg((-F.min("x.s")).alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = flat.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def calibrate(queries: DataFrame, assigned: DataFrame, tree: Tree, k: int, target: float, shared: bool = False) -> int:
    """Leaf visits at which the calibration queries find the target share of their true neighbours."""
    rows = queries.orderBy(F.xxhash64("point")).limit(CALIBRATION).collect()
    if not rows:
        return 1
    names, q = np.array([r["point"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.float64)
    near = assigned.select("point", "low", "v", "leaf").mapInArrow(_brute(q, names, k, shared), "query long, low long, leaf int, score double")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low"))).where(F.col("r") <= k)
    truth = top.select("query", "leaf").collect()  # CALIBRATION * k rows at most
    place = {int(n): {leaf: i for i, leaf in enumerate(tree.order(x))} for n, x in zip(names, q, strict=True)}
    needed = np.array([place[r["query"]][r["leaf"]] + 1 for r in truth] or [1])
    visits = 1
    while visits < tree.leaves and (needed <= visits).mean() < target:
        visits = min(tree.leaves, max(visits + 1, round(visits * 1.25)))
    return visits
