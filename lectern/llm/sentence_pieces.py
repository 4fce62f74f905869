"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has an arc for each piece that ends at a character. Only arcs that the model admits survive: with a BPE model an
arc may follow another only if merging the two pieces' characters gives back exactly these two pieces, and then every
position has one surviving arc, so that the path is the one that merging would give. (Scores of a BPE model are merge ranks;
adding them up along a path, as one does with a unigram model, gives other pieces.) An arc is no longer than the longest
piece, so the window of positions that a later arc can start from is as long as that. When all surviving backpointer paths
from the window meet in one boundary, what lies before it is committed and forgotten.

All texts go through stream(). Where no piece crosses a boundary, all paths meet in it and what lies before is committed: that
is so between white space and what precedes it, and between characters that no piece has side by side. A worker remembers what
stream() committed between two such boundaries, so that a word that comes again isn't walked again. Characters without a piece
are barriers too and become byte pieces.
"""

from __future__ import annotations

import re
import struct
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Words, and parts of words, that a worker remembers in each of two generations: when the younger is full it becomes the older,
#: so that what is used again stays. A dict of up to 2/3 of a power of two takes half the memory of one just beyond. Parts cost more
#: to find than words of known parts. Pairs of pieces that it remembers; beyond it starts anew.
REMEMBERED, PARTS, PAIRS = 170_000, 340_000, 170_000
#: Rows that are decoded at a time; indices take eight times the room of their texts.
DECODED = 100
#: Characters that a text is streamed in, if its words can't be told apart beforehand.
CHUNK = 4096
_models: dict[str, Model] = {}
_decoders: dict[str, Decoder] = {}


def read_pieces(path: str) -> tuple[list[str], list[float], dict[int, int], set[int], int]:
    """(piece texts, scores, id of each byte piece, control ids, unknown id) by id, read by the public library."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    text, score = [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids]
    return text, score, {int(text[i][3:5], 16): i for i in ids if sp.is_byte(i)}, {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}, sp.unk_id()


class Decoder:
    """What decoding needs of a model: the bytes that each id stands for, end to end, with space marks as spaces."""

    def __init__(self, path: str):
        text, _, of_byte, control, _ = read_pieces(path)
        byte_of = {i: b for b, i in of_byte.items()}
        raw = [b"" if i in control else bytes([byte_of[i]]) if i in byte_of else t.replace(MARK, " ").encode() for i, t in enumerate(text)]
        self.size = np.array([len(x) for x in raw], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of runs of ids: pieces end to end, byte pieces as UTF-8 (U+FFFD where they are not), control ids dropped,
        space marks as spaces, and the one in front removed."""
        size = self.size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[ids] - end[:-1], size)
        at += np.arange(end[-1])
        data = self.data[at].tobytes()
        cut = end[offsets].tolist()
        out = [data[a:b].decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(cut, cut[1:], strict=False)]
        return [t[1:] if t.startswith(" ") else t for t in out]


class Model:
    """Pieces of a BPE model with byte fallback."""

    def __init__(self, path: str):
        self.text, score, self.bytes, self.control, self.unknown = read_pieces(path)
        special = self.control | set(self.bytes.values())
        normal = {t: (score[i], i) for i, t in enumerate(self.text) if i not in special}
        self.rank = {p: -s for p, (s, _) in normal.items()}
        self.ids = {p: i for p, (_, i) in normal.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        # Arcs are pieces that merging their own characters leads to.
        self.arcs = {p for p in normal if len(p) == 1 or self.merge(p) == [p]}
        self.longest = max(map(len, self.arcs), default=1)
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.arcs) and "\n" not in self.ids
        self.prefixes = {p[:n] for p in self.arcs for n in range(1, len(p) + 1)}
        self.joined = {p[i : i + 2].replace(MARK, " ") for p in self.arcs for i in range(len(p) - 1)}
        self.words = Words(self)

    def merge(self, text: str) -> list[str]:
        """BPE by definition: the adjacent pair of best rank is joined, leftmost first, until none can be."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def admits(self, a: str, b: str) -> bool:
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(a + b) == [a, b]
        return found

    def emit(self, piece: str) -> tuple[int, ...]:
        found = self.ids.get(piece)
        if found is not None:
            return (found,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)


class Words(dict):
    """Ids of words, as little-endian 32-bit integers. The key is a word without its space mark, or with a line break in front
    for one that follows it; a new word is encoded when it is first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.parts, self.old, self.old_parts = model, {}, {}, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.of(key if key.startswith("\n") else " " + key)
        self[key] = found
        return found

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()
        if len(self.parts) > PARTS:
            self.parts, self.old_parts = {}, self.parts

    def of(self, text: str) -> bytes:
        """Ids of a few characters, with spaces for space marks, so that keys take a byte a letter where they can: those between
        boundaries that no piece crosses are remembered on their own."""
        joined, parts, out, at = self.model.joined, self.parts, [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in joined:
                part, at = text[at:i], i
                found = parts.get(part)
                if found is None:
                    found = self.old_parts.get(part)
                    if found is None:
                        ids = list(stream(self.model, (part.replace(" ", MARK),)))
                        found = struct.pack(f"<{len(ids)}i", *ids)
                    parts[part] = found
                out.append(found)
        return b"".join(out)


def stream(model: Model, chunks: Iterable[str], committed: list[int] | None = None) -> Iterator[int]:
    """Ids of a normalised text that arrives in chunks, each as soon as it is certain.

    Arcs are laid from each position in turn, once the characters that its longest arc could take are there; the first arc into
    a position survives, being the longest that the model admits. committed: takes the characters of each commit.
    """
    prefixes, arcs, admits, pairs, known, longest = model.prefixes, model.arcs, model.admits, model.pairs, model.ids, model.longest
    text, at = "", 0  # the window's characters, and the first position without arcs
    before: list[str | None] = [None]  # the surviving arc into each position of the window; None at the text's start

    for chunk in chain(chunks, [None]):
        text += chunk or ""
        n = len(text)
        before += [None] * (n + 1 - len(before))
        ready = n if chunk is None else n - longest + 1
        while at < ready:
            last = before[at]
            barrier = last is None or last not in known
            for j in range(at + 1, n + 1):
                piece = text[at:j]
                if piece not in prefixes:
                    break
                if before[j] is None and piece in arcs:
                    if not barrier:
                        fits = pairs.get((last, piece))
                        if not (admits(last, piece) if fits is None else fits):
                            continue
                    before[j] = piece
            if before[at + 1] is None:
                before[at + 1] = text[at]
            at += 1
            if at >= 2 * longest and at < n and (done := _meet(before, at, longest)):
                if committed is not None:
                    committed.append(done)
                for piece in _path(before, done):
                    yield from model.emit(piece)
                text, before, at, ready, n = text[done:], before[done:], at - done, ready - done, n - done
    if text:
        if committed is not None:
            committed.append(len(text))
        for piece in _path(before, len(text)):
            found = known.get(piece)
            if found is None:
                yield from model.emit(piece)
            else:
                yield found


def _meet(before: list[str | None], at: int, longest: int) -> int:
    """The last boundary that every path goes through which a later arc can continue: those into position `at` and those that
    arcs from before it have led beyond it."""
    reach = {p for p in range(at, min(at + longest, len(before))) if p == at or before[p] is not None}
    while len(reach) > 1:
        top = max(reach)
        reach.remove(top)
        reach.add(max(0, top - len(before[top])))
    return reach.pop()


def _path(before: list[str | None], end: int) -> list[str]:
    """Pieces from the window's start to `end`. The first entry is the arc that led to the start, already emitted."""
    out = deque()
    while end > 0:
        out.appendleft(before[end])
        end -= len(before[end])
    return list(out)


def normalise(text: str) -> str:
    """The model's own rule: one space mark in front, and one for each space. The empty text stays so."""
    return MARK + text.replace(" ", MARK) if text else ""


_WORD = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")


def encode_bytes(model: Model, text: str) -> bytes:
    """Ids of a whole text, as little-endian 32-bit integers. Between words every path meets, so each is committed on its own:
    streamed when it first comes, and remembered."""
    if not text:
        return b""
    if not model.by_word:
        own = normalise(text)
        ids = list(stream(model, (own[i : i + CHUNK] for i in range(0, len(own), CHUNK))))
        return struct.pack(f"<{len(ids)}i", *ids)
    known = model.words
    known.age()
    words = text.replace("\n", " \n").split(" ")
    if "" in words or MARK in text:  # runs of spaces are pieces too
        return b"".join(known.of(word.replace(MARK, " ")) for word in _WORD.findall(normalise(text)))
    return b"".join(map(known.__getitem__, words))


def encode(model: Model, text: str) -> list[int]:
    data = encode_bytes(model, text)
    return list(struct.unpack(f"<{len(data) // 4}i", data))


def decode(decoder: Decoder, ids: Iterable[int]) -> str:
    own = np.array(list(ids), dtype=np.int64)
    return decoder.texts(own, np.array([0, len(own)]))[0]


def model_of(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


CODED = "id long, n_ids int, ids array<int>, ids_crc32 long, text_crc32 long"


def _coder(path: str):
    def run(batches):
        import zlib

        import pyarrow as pa

        model = model_of(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids, crc, own_crc = [], [], []
                for text in batch.column("text").slice(at, 500).to_pylist():
                    own = np.frombuffer(encode_bytes(model, text or ""), dtype="<i4")
                    ids.append(own)
                    crc.append(zlib.crc32(own.tobytes()))
                    own_crc.append(zlib.crc32((text or "").replace(MARK, " ").encode()))
                sizes = np.array([len(x) for x in ids], dtype=np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, 500), pa.array(sizes), flat, pa.array(crc, pa.int64()), pa.array(own_crc, pa.int64())], names=[x.split()[0] for x in CODED.split(", ")])

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_ids, ids, ids_crc32, text_crc32) for every row of docs.

    ids are those that the public library gives; text_crc32 is of the text's UTF-8 with U+2581 read as a space, which is what
    decoding gives back. A null or empty text has no ids. Equal texts have equal ids, and rows may repeat; ids of rows may be
    null or repeat; other columns are not read; an empty table gives no rows. A task holds one batch of texts and what it
    remembers, which is bounded.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_coder(model), CODED).withColumnRenamed("id", id_col)


def _decoder(path: str):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        if path not in _decoders:
            _decoders[path] = Decoder(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for first in range(0, len(batch), DECODED):
                part = batch.slice(first, DECODED)
                ids = part.column(at)
                offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                texts = _decoders[path].texts(ids.flatten().to_numpy(zero_copy_only=False), offsets)
                texts = pa.array(texts, pa.string(), mask=np.asarray(ids.is_null())) if ids.null_count else pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), texts], names=[*(n for n in batch.schema.names if n != "ids"), "text"])

    return run


def decode_documents(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, columns in `carry`, text) for every row of tokens: the text that its ids stand for, as the public library decodes
    them. No ids are the empty text, a null array stays null; control ids are dropped, an id that the model lacks is an error.
    Rows may repeat, ids of rows may be null; other columns are not read; an empty table gives no rows."""
    own = tokens.select(F.col(id_col).alias("c0"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 1)], F.col(ids_col).alias("ids"))
    schema = T.StructType([f for f in own.schema if f.name != "ids"] + [T.StructField("text", T.StringType())])
    out = own.mapInArrow(_decoder(model), schema)
    return out.select(F.col("c0").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry, 1)], "text")
