"""A quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the counts of
vote patterns, which are at most 3 ** LABELLERS rows however large the corpus, estimates each labeller's accuracy and
the share of good documents, and gives each pattern a posterior. Posteriors then train a linear scorer on hashed byte
trigrams; the scorer judges all documents, also where the labellers abstain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

LABELLERS = 8
DIMENSIONS = 1 << 13
FEATURES = DIMENSIONS + LABELLERS
#: Documents that the scorer is trained on, the first by a hash of their id: a bound on one task's memory.
SAMPLE = 4000
STEPS, RATE, SCALE, DECAY = 250, 0.05, 100.0, 1e-4
KEEP_AT = 0.5

_SYMBOL, _UPPER, _LETTER = (np.zeros(256, dtype=bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xE0] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:;")] = True


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _vote(x: np.ndarray, bad: np.ndarray, good: np.ndarray, known: np.ndarray) -> np.ndarray:
    """2: good, 0: bad, 1: abstains."""
    return np.where(known & bad, 0, np.where(known & good, 2, 1)).astype(np.int64)


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, labellers)."""
    count = lambda hit: K.segment_sums(hit.astype(np.int64), offsets)
    starts, ends, text = K.words(data, offsets)
    n = np.bincount(text, minlength=len(offsets) - 1)
    short = np.bincount(text, weights=(ends - starts) <= 3, minlength=len(n))
    letters, upper = count(_LETTER[data]), count(_UPPER[data])
    symbols, bangs, bars = _share(count(_SYMBOL[data]), n), _share(count(data == 33), n), _share(count(data == 124), n)
    newline = data == 10
    last = np.zeros(len(data), dtype=bool)
    if len(data):
        last[:-1] = newline[1:]
        last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        last &= ~newline
    lines, stopped = count(last), count(last & _STOP[data])
    _, different = K.shingles(data, offsets, 3)
    fresh = _share(different, np.maximum(n - 2, 1))
    capitals, size, closed, little = _share(upper, letters), _share(ends_sum(text, ends - starts, len(n)), n), _share(stopped, lines), _share(short, n)
    some, many = n > 0, n >= 20
    return np.stack(
        [
            _vote(symbols, symbols >= 0.3, symbols <= 0.05, some),
            _vote(capitals, capitals >= 0.4, capitals <= 0.2, letters >= 20),
            _vote(bangs, bangs >= 0.2, bangs <= 0.05, some),
            _vote(bars, bars >= 0.15, bars <= 0.02, some),
            _vote(closed, closed <= 0.1, closed >= 0.6, (lines > 0) & many),
            _vote(fresh, fresh <= 0.85, fresh >= 0.95, many),
            _vote(little, little <= 0.02, little >= 0.2, many),
            _vote(size, (size >= 16) | (size <= 2), (size >= 4) & (size <= 9), many),
        ],
        axis=1,
    )


def ends_sum(text: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=lengths, minlength=n)


def pattern(v: np.ndarray) -> np.ndarray:
    """A row of votes as one number in base 3."""
    return v @ (3 ** np.arange(LABELLERS))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" for each pattern, p(vote | class) as (class, labeller, vote), and the share of good documents.

    A document may be bad in one way only, which the other labellers don't see. So "bad" is a mixture of one component for
    each labeller, which begins with the patterns where that labeller says bad; "good" begins with those where none does.
    Votes are taken as independent given the component.
    """
    v = patterns[:, None] // 3 ** np.arange(LABELLERS) % 3
    hot = np.eye(3)[v]
    cast = hot * np.array([1.0, 0.0, 1.0])  # who abstains says nothing
    weight = counts / max(counts.sum(), 1)
    bad = v == 0
    post = np.concatenate([~bad.any(axis=1)[None], bad.T]).astype(float)
    post = (post / post.sum(axis=0) + 0.02) / (1 + 0.02 * len(post))
    for _ in range(rounds):
        p = post * weight
        table = np.einsum("cp,plv->clv", p, cast) + 1e-4
        table /= table[:, :, [0, 2]].sum(axis=2, keepdims=True)
        mix = np.clip(p.sum(axis=1), 1e-6, None)
        log = np.einsum("plv,clv->cp", cast, np.log(table)) + np.log(mix / mix.sum())[:, None]
        new = np.exp(log - log.max(axis=0))
        new /= new.sum(axis=0)
        done = np.abs(new - post).max(initial=0) < 1e-9
        post = new
        if done:
            break
    p = post * weight
    good, rest = p[0], p[1:].sum(axis=0)
    by_class = np.stack([np.einsum("p,plv->lv", x, hot) / max(x.sum(), 1e-12) for x in (rest, good)])
    return post[0], by_class, float(good.sum())


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte, and whether it lies within one text."""
    x = data.astype(np.uint32)
    h = np.zeros(len(x), dtype=np.uint32)
    whole = np.zeros(len(x), dtype=bool)
    if len(x) >= 3:
        h[:-2] = (x[:-2] * np.uint32(0x01000193) + x[1:-1]) * np.uint32(0x01000193) + x[2:]
        whole[:-2] = True
        for back in (1, 2):
            at = offsets[1:] - back
            whole[at[at >= 0]] = False
    h = (h * np.uint32(2654435761)) >> np.uint32(32 - 13)
    return h.astype(np.int64), whole


def _train(posteriors: dict[int, float]):
    def run(batches):
        import pyarrow as pa

        xs, ys = [], []
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                h, whole = grams(data, offsets)
                v = votes(data, offsets)
                q = [posteriors[int(p)] for p in pattern(v)]
                for d in range(len(offsets) - 1):
                    own = h[offsets[d] : offsets[d + 1]][whole[offsets[d] : offsets[d + 1]]]
                    if len(own):
                        xs.append(np.append(np.bincount(own, minlength=DIMENSIONS) * (SCALE / len(own)), v[d] == 0).astype(np.float32))
                        ys.append(q[d])
        w, b = np.zeros(FEATURES, np.float32), 0.0
        if xs:
            x, y = np.stack(xs), np.array(ys, dtype=np.float32)
            m, s = np.zeros(FEATURES + 1, np.float32), np.zeros(FEATURES + 1, np.float32)
            for t in range(1, STEPS + 1):  # Adam on the whole sample
                p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
                e = (p - y) / len(y)
                g = np.append(e @ x + DECAY * w, e.sum()).astype(np.float32)
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
                w, b = w - step[:-1], b - float(step[-1])
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float32())), pa.array([float(b)])], names=["w", "b"])

    return run


def _patterns(batches):
    import pyarrow as pa

    for batch in batches:
        counts: dict[int, int] = {}
        for _, _, data, offsets in K.chunks(batch.column(0)):
            for p, c in zip(*np.unique(pattern(votes(data, offsets)), return_counts=True), strict=True):
                counts[int(p)] = counts.get(int(p), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["pattern", "n"])


class Model:
    """posteriors: by vote pattern; accuracy: p(vote | class) of each labeller; share: of good documents; w, b: the scorer."""

    def __init__(self, posteriors, accuracy, share, w, b):
        self.posteriors, self.accuracy, self.share, self.w, self.b = posteriors, accuracy, share, w, b


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Vote patterns are counted over all documents; the scorer is trained on `sample` of them at most.

    An empty table gives a scorer that says 0.5 to everything.
    """
    text = docs.select(F.col(text_col).alias("text"))
    found = text.mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3 ** 8 rows at most
    patterns, counts = np.array([r["pattern"] for r in found], dtype=np.int64), np.array([r["n"] for r in found], dtype=np.float64)
    order = np.argsort(patterns)
    patterns, counts = patterns[order], counts[order]
    post, table, share = estimate(patterns, counts)
    posteriors = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    # The sample's hash bound comes from ids alone; the limit only tells apart rows that share the last hash.
    hashed = docs.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    bound = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(bound)).select("text").limit(sample)
    row = chosen.coalesce(1).mapInArrow(_train(posteriors), "w array<float>, b double").first()
    return Model(posteriors, table, share, np.array(row["w"], dtype=np.float32) if row else np.zeros(FEATURES, np.float32), row["b"] if row else 0.0)


def _scorer(w: np.ndarray, b: float, posteriors: dict[int, float]):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for _, _, data, offsets in K.chunks(batch.column(1)):
                h, whole = grams(data, offsets)
                total = K.segment_sums(np.where(whole, w[h].astype(np.float64), 0.0), offsets)
                n = K.segment_sums(whole.astype(np.int64), offsets)
                v = votes(data, offsets)
                score = 1 / (1 + np.exp(-np.clip(total * SCALE / np.maximum(n, 1) + (v == 0) @ w[DIMENSIONS:].astype(np.float64) + b, -30, 30)))
                p = pattern(v)
                words = np.bincount(K.words(data, offsets)[2], minlength=len(n))
                out.append((p, np.array([posteriors.get(int(x), 0.5) for x in p]), score, (score >= KEEP_AT) & (words > 0)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, bool)]
            given = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in given), *map(pa.array, cols)], names=[*(batch.schema.names[i] for i in given), "votes", "weak_label", "score", "kept"])

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in `carry`, votes, weak_label, score and kept for every row: the vote pattern, its posterior, the
    scorer's probability of "good" and whether it reaches KEEP_AT.

    Null, empty and blank texts are scored by the bias alone and never kept. Rows that repeat a text fare alike, a score of exactly
    KEEP_AT is kept, a text of any length is scored whole, ids may be null or repeat, and other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry, 1)])
    schema = T.StructType([f for f in own.schema if f.name != "text"] + [T.StructField("votes", T.LongType()), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    out = own.mapInArrow(_scorer(model.w, model.b, model.posteriors), schema)
    return out.select(F.col("c0").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry, 1)], "votes", "weak_label", "score", "kept")
