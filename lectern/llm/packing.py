"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

A bin never holds two pieces of one source or of one duplicate cluster. Bins are kept in order of their residual room and
carry a bitmap of sources and one of clusters; the search starts at the first bin with room enough and goes on to its
successors until it meets the tightest bin whose bitmaps are free of conflict. Documents longer than a bin are cut into full
bins, which close at once, and a rest, which is packed.

Documents are dealt by hash into groups of about GROUP pieces, each packed by one task from lengths, sources and clusters
alone. Group numbers come from hashes and the row count, so the packing depends on the rows and not on how they are dealt.
"""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 4096
#: Pieces of a group that make a source common.
COMMON = 32
PACKED = "id long, piece int, start long, length long, bin_group int, bin int, bin_offset long, bin_fill long"


class Bins:
    """Open bins in order of (residual, number). Bitmaps are ints of one bit for each source or cluster of the group.

    Each common source has a list of its own, of the bins still free of it, so that its pieces don't walk again and again
    over bins that hold it already.
    """

    def __init__(self, capacity: int, common: set[int]):
        self.capacity, self.made, self.common = capacity, 0, common
        self.order: list[tuple[int, int]] = []
        self.sources: dict[int, int] = {}
        self.clusters: dict[int, int] = {}
        self.fill: list[int] = []
        self.free: dict[int, list[tuple[int, int]]] = {}

    def place(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for a piece; source and cluster are bits, 0 for none."""
        order = self.order
        if source in self.common:
            order = self.free.setdefault(source, list(order))
        at = bisect.bisect_left(order, (need, -1))
        while at < len(order) and (self.sources[order[at][1]] & source or self.clusters[order[at][1]] & cluster):
            at += 1
        if at == len(order):
            number, room = self.made, self.capacity
            self.made += 1
            self.fill.append(0)
            self.sources[number] = self.clusters[number] = 0
        else:
            room, number = order[at]
            self._remove(room, number)
        offset = self.fill[number]
        self.fill[number] += need
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if room > need:
            self._insert(room - need, number)
        return number, offset

    def close(self, length: int) -> tuple[int, int]:
        """A bin of its own that takes nothing more."""
        self.fill.append(length)
        self.made += 1
        return self.made - 1, 0

    def _lists(self, number: int):
        yield self.order
        for source, order in self.free.items():
            if not self.sources[number] & source:
                yield order

    def _remove(self, room: int, number: int) -> None:
        for order in self._lists(number):
            order.pop(bisect.bisect_left(order, (room, number)))

    def _insert(self, room: int, number: int) -> None:
        for order in self._lists(number):
            bisect.insort(order, (room, number))


def pack(rows: list[tuple], capacity: int) -> list[tuple]:
    """rows: (id, length, source, cluster), in any order. Returns PACKED's columns without bin_group, longest first."""
    out, rest, closed = [], [], []
    for i, (doc, length, source, cluster) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2] or "", r[3] or 0))):
        full = length // capacity if length > capacity else 0
        for p in range(full):
            closed.append([doc, p, p * capacity, capacity])
        if length - full * capacity > 0 or not full:
            rest.append((length - full * capacity, i, doc, full, full * capacity, source, cluster))
    bit: list[dict] = [{}, {}]
    counts = Counter(r[5] for r in rest if r[5] is not None)
    common = {1 << bit[0].setdefault(x, len(bit[0])) for x, n in counts.most_common() if n >= COMMON}
    bins = Bins(capacity, common)
    out += [[*r, *bins.close(capacity)] for r in closed]
    for length, _, doc, p, start, source, cluster in sorted(rest, key=lambda r: (-r[0], r[1])):
        flags = [0 if x is None else 1 << seen.setdefault(x, len(seen)) for x, seen in zip((source, cluster), bit, strict=True)]
        out.append([doc, p, start, length, *bins.place(length, *flags)])
    return [(*r, bins.fill[r[4]]) for r in out]


def _pack_group(capacity: int):
    def run(key, table):
        import pyarrow as pa

        rows = list(zip(*(table.column(c).to_pylist() for c in ("id", "length", "source", "cluster")), strict=True))
        packed = pack(rows, capacity)
        cols = list(zip(*packed, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        arrays.insert(4, pa.array([key[0].as_py()] * len(packed), pa.int32()))
        return pa.Table.from_arrays(arrays, names=[x.split()[0] for x in PACKED.split(", ")])

    return run


def pack_documents(docs: DataFrame, capacity: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", group: int = GROUP) -> DataFrame:
    """(id_col, piece, start, length, bin_group, bin, bin_offset, bin_fill): one row for each piece of each row of docs.

    Lengths are the bytes of the text, as a byte-level model reads it, and one end mark; a null or empty text is the end
    mark alone. A duplicate cluster is the set of documents with equal texts up to case and white space. A null source
    conflicts with nothing, and null ids are ids like others. Pieces of equal length go by id (nulls last), source and cluster.
    Rows may repeat: those that are alike in everything are interchangeable, so they are dealt over the groups in turn and no
    group gets them all. A very long text is full bins and a rest. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cluster = F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))
    own = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("length"), F.col(source_col).alias("source"), cluster.alias("cluster"))
    groups = max(1, round(docs.count() / group))
    alike = ["id", "length", "source", "cluster"]
    rows = own.groupBy(*alike).agg(F.count(F.lit(1)).alias("n"))
    # Copy i of a row goes to the i-th group after the first of them; a group gets n / groups copies, as runs of rows.
    runs = rows.select(*alike, F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(groups)) - 1)).alias("i"), "n")
    runs = runs.select(*alike, F.pmod(F.xxhash64("id", "cluster", "source") + F.col("i"), F.lit(groups)).cast("int").alias("g"), ((F.col("n") - 1 - F.col("i")) / groups).cast("long").alias("more"))
    own = runs.withColumn("_", F.explode(F.sequence(F.lit(0).cast("long"), "more"))).drop("_", "more")
    return own.groupBy("g").applyInArrow(_pack_group(capacity), PACKED).withColumnRenamed("id", id_col)
