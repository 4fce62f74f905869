"""Token ids on disk in shuffled planes.

Texts are encoded by a public tokenizer and end with an end id. A shard holds a range of document ids in ascending order.
Its file is a sequence of blocks of BLOCK ids; a block's ids are transposed into byte planes (all first bytes, all second
bytes, ...) or bit planes, each plane compressed on its own with zstandard, so that the nearly empty high planes cost next
to nothing. A table of documents, an index of blocks (offset, ids, plane sizes, checksum) and a footer follow.

    magic | planes of block 0 | planes of block 1 | ... | documents | index | offset of documents u64, sizes u32 u32, magic
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import MANIFEST, commit, deal, spread
from .common import filesystem, writing

MAGIC = b"LPLANES1"
BLOCK = 65_536
#: Words whose ids a worker remembers; beyond it starts anew.
REMEMBERED = 1_000_000
#: str.split() also splits at these, which the tokenizer doesn't take for white space; texts with one are split at ASCII white space.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_state: dict = {}


class Words(dict):
    """Ids of words, as little-endian unsigned 32-bit integers. A new word is encoded when it is first asked for.

    The tokenizer's splitting never joins characters across white space, lowers case and parts letters from marks. So texts
    are put together from words, and a word whose stem ends in an ASCII letter or digit has the ids of its stem (in lower case,
    if it is ASCII) and of the full stops and commas after it. Others are encoded whole: normalising turns some letters into a
    letter and a mark, which joins what follows. tests/llm holds this against encoding texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii()
        lower = word.lower() if plain else word
        stem = lower.rstrip(".,")
        if stem != word and stem and stem[-1].isascii() and stem[-1].isalnum() and "<|" not in word:
            found = self[stem] + (self[lower[len(stem) :]] if len(stem) < len(lower) else b"")
        else:
            # Letters a to z pass through normalising and splitting as they are, so the library's model takes them at once.
            ids = [t.id for t in self.tokenize(word)] if plain and word.isalpha() and word.islower() else self.encode(word, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found


def encoder(path: str):
    """A function from texts to the ids of each. A worker keeps REMEMBERED words, then starts anew."""
    if path not in _state:
        _state[path] = Words(path)
    known = _state[path]
    get = known.__getitem__

    def run(texts: list[str]) -> list[bytes]:
        if len(known) > REMEMBERED:
            known.clear()
        return [b"".join(map(get, filter(None, _SPACE.split(t)) if any(c in t for c in _ODD) else t.split())) for t in texts]

    return run


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        raw = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n) for p in planes], axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class PlaneWriter:
    def __init__(self, f, unit: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.f, self.unit, self.block, self.at = f, unit, block, len(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=level).compress
        self.held, self.waiting, self.index, self.ids, self.counts = [], 0, [], [], []
        f.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            ids = np.frombuffer(b"".join(self.held), dtype="<u4")
            whole = len(ids) - len(ids) % self.block
            for at in range(0, whole, self.block):
                self._flush(ids[at : at + self.block])
            self.held, self.waiting = [ids[whole:].tobytes()], len(ids) - whole

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.zip(p) for p in to_planes(ids, self.unit)]
        self.index.append([self.at, len(ids), [len(p) for p in planes], zlib.crc32(ids.tobytes())])
        for p in planes:
            self.f.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Bytes written."""
        if self.waiting:
            self._flush(np.frombuffer(b"".join(self.held), dtype="<u4"))
        null = np.array([x is None for x in self.ids], dtype=np.uint8)
        docs = self.zip(null.tobytes() + np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + np.array(self.counts, dtype="<u8").tobytes())
        index = self.zip(json.dumps({"unit": self.unit, "block": self.block, "documents": len(self.ids), "blocks": self.index}).encode())
        self.f.write(docs + index + struct.pack("<QII", self.at, len(docs), len(index)) + MAGIC)
        return self.at + len(docs) + len(index) + 24


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


class PlaneReader:
    """Reads a file by its index; blocks can be read in any order."""

    def __init__(self, f):
        self.f = f
        size = f.seek(0, 2) or f.tell()
        f.seek(size - 24)
        at, docs, index, magic = struct.unpack("<QII8s", f.read(24))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        f.seek(at)
        docs, self.index = _unzip(f.read(docs)), json.loads(_unzip(f.read(index)))
        n = self.index["documents"]
        ids = np.frombuffer(docs, dtype="<i8", count=n, offset=n)
        self.ids = [None if null else int(x) for null, x in zip(docs[:n], ids, strict=True)]
        self.counts = np.frombuffer(docs, dtype="<u8", count=n, offset=9 * n).astype(np.int64)

    def block(self, i: int) -> np.ndarray:
        at, n, sizes, crc = self.index["blocks"][i]
        self.f.seek(at)
        ids = from_planes([_unzip(self.f.read(s)) for s in sizes], n, self.index["unit"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
        return ids

    def documents(self):
        """(doc_id, first id's place, ids' count, iterator of the ids' parts), in order; one block is held at a time."""
        block, at, i, start = np.zeros(0, "<u4"), 0, 0, 0
        for doc, count in zip(self.ids, self.counts.tolist(), strict=True):
            parts, left = [], count
            while left:
                if at == len(block):
                    block, at, i = self.block(i), 0, i + 1
                parts.append(block[at : at + left])
                at += len(parts[-1])
                left -= len(parts[-1])
            yield doc, start, count, parts
            start += count


def _writer(out: str, path: str, end: int, unit: str, block: int):
    def run(batches):
        import pyarrow as pa

        row = opened = writer = None
        encode, tail = encoder(path), struct.pack("<I", end)
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 256):
                if opened is None:
                    shard = batch.column("shard")[0].as_py()
                    name = f"part-{shard:06d}.planes"
                    row = [shard, 0, f"{out}/_temporary/{uuid.uuid4().hex}-{name}", f"{out}/{name}", 0, 0, 0]
                    opened = writing(row[2])
                    writer = PlaneWriter(opened.__enter__(), unit, block)
                for doc, blob in zip(ids[at : at + 256], encode([t or "" for t in texts[at : at + 256].to_pylist()]), strict=True):
                    writer.add(doc, blob + tail)
                    row[4], row[5] = row[4] + 1, row[5] + len(blob) // 4 + 1
        if opened is not None:
            row[6] = writer.close()
            opened.__exit__(None, None, None)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([row[i]] if row else [], kinds[i]) for i in range(7)], names=["shard", "seq", "temporary", "final", "records", "units", "bytes"])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, unit: str = "byte", block: int = BLOCK, shard_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every row's ids and end_id under `out` (a folder that all executors share); returns the manifest.

    A null or empty text is the end id alone. Null ids come first; rows that repeat an id follow each other in order of
    text. Other columns are not read. An empty table gives an empty manifest. shard_bytes: UTF-8 bytes of text a shard.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).alias("size"))
    dealt = deal(own, "id", "size", shard_bytes, "text").select("shard", "id", "text")
    return commit(docs.sparkSession, dealt.mapInArrow(_writer(out, tokenizer, end_id, unit, block), MANIFEST), out)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def _reader(batches):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [x.split()[0] for x in READ.split(", ")]
    rows = []
    for batch in batches:
        for path, shard, before in zip(*(batch.column(c).to_pylist() for c in ("final", "shard", "before")), strict=True):
            store, own = filesystem(path)
            with store.open_input_file(own) as f:
                for doc, start, count, parts in PlaneReader(f).documents():
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p.tobytes(), crc)
                    rows.append((doc, before + start, count, crc, shard))
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=names)
                        rows = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names=names)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """READ's columns of every document of a committed folder; start counts ids over all shards."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    placed = manifest.selectExpr("final", "shard", "coalesce(sum(units) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")  # one row a file
    return spread(placed, "final", "shard", "before").mapInArrow(_reader, READ)
