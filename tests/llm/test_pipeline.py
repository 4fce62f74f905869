"""The pipeline's stages against brute-force versions, and held-out accuracy of its classifier."""

from __future__ import annotations

import os
import random
import re

import pytest

import corpus_pipeline as P
from lectern.llm import quality_classifier

DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, f in P.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/{name}"
        f(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return [spark.read.parquet(f"{DIR}/documents.parquet").toPandas(), *out]


HARD = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept boolean, _t string"


def hard_docs(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    good = lambda n: " ".join(rng.choice(vocabulary) + "." * (k % 12 == 11) for k in range(n))
    texts = [None, "", " \n ", "short", good(120), good(130), good(140), "BUY NOW! " * 40, good(20_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (4, texts[5]), (20, texts[5]), (None, texts[6]), (None, texts[6]), (None, None), (21, texts[4] + " write to a@b.org")]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", len(t or ""), -1, False, "clash") for k, (i, t) in enumerate(rows)], HARD), texts


def test_stages_on_hard_rows(spark):
    docs, texts = hard_docs(spark)
    for name, stage in P.STAGES:
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0, name
        assert name == P.STAGES[-1][0] or none.columns == P.COLUMNS
    stages = dict(P.STAGES)
    cleaned = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in stages["quality_rules"](spark, docs, "").collect())
    assert cleaned == sorted((i is None, i or 0, n) for i, n in [(4, len(texts[4]))] * 3 + [(4, len(texts[5])), (5, len(texts[5])), (6, len(texts[6])), (8, len(texts[8])), (20, len(texts[5])), (None, len(texts[6])), (None, len(texts[6])), (21, len(texts[4]) + 17)])
    scored = stages["quality_classifier"](spark, docs, "").collect()
    assert all((r.text or "").strip() for r in scored) and all(len([x for x in scored if x.text == r.text]) == sum(x.text == r.text for x in docs.collect()) for r in scored)
    left = stages["minhash_near_dedup"](spark, docs, "").collect()
    # Id 4 holds two texts, so it stands for the copies of both.
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left) == sorted((i is None, i or 0, t or "") for i, t in [(0, None), (1, ""), (2, texts[2]), (3, "short"), (4, texts[4]), (4, texts[5]), (6, texts[6]), (7, texts[7]), (8, texts[8]), (None, texts[6]), (None, None)])
    clean = stages["pii"](spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in clean) == sorted((str(r.doc_id), (r.text or "").replace("a@b.org", "<EMAIL>")) for r in docs.collect())
    packed = stages["best_fit_packing"](spark, docs, "").collect()
    assert sum(r.length for r in packed) == sum(len((r.text or "").encode()) + 1 for r in docs.collect())


@needs_data
def test_rules_stage_keeps_what_the_rules_keep(staged):
    before, after = staged[0], staged[1]
    word, want = r"[^\x20\x09-\x0D]", {}
    from lectern.llm import quality_rules as R

    def fails(x):
        n, letters, up = len(re.findall(word + "+", x)), sum(c.isalpha() for c in x), sum(c.isupper() for c in x)
        return x.count(" | ") >= 3 or len(re.findall(R.SYMBOLS, x)) >= 0.3 * n or (letters >= 20 and up >= 0.6 * letters) or bool(re.search(R.BOILERPLATE, x)) or (n < 4 and not re.search("[.!?:;,。！？…]", x))

    for i, t in zip(before.doc_id, before.text, strict=True):
        w = re.findall(word + "+", t)
        seen: dict = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        again = {p for at in seen.values() if len(at) > 1 for k in at for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(word, x)]
        good = [x for x in lines if not fails(x)]
        if len(w) >= 50 and 100 * len(again) <= 50 * len(w) and sum(map(len, good)) >= 0.5 * sum(map(len, lines)):
            want[i] = "\n".join(x for x in t.split("\n") if not re.search(word, x) or not fails(x))
    assert dict(zip(after.doc_id, after.text, strict=True)) == want


@needs_data
def test_classifier_stage_against_a_plain_version(staged):
    """Votes, posteriors and scores worked out text by text."""
    import numpy as np

    from lectern.llm import kernels as K

    def voted(t):
        data = t.encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", data)
        n, letters, up = len(w), len(re.findall(rb"[A-Za-z\xC3-\xDF]", data)), len(re.findall(rb"[A-Z]", data))
        lines = [x for x in data.split(b"\n") if x]
        per = lambda a, b: a / max(b, 1)
        low = [x.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for x in w]
        different = len({tuple(low[i : i + 3]) for i in range(len(low) - 2)} or ({tuple(low)} if low else set()))
        closed = per(sum(x[-1:] in (b".", b"!", b"?", b":", b";") for x in lines), len(lines))
        size, little, fresh = per(sum(map(len, w)), n), per(sum(len(x) <= 3 for x in w), n), per(different, max(n - 2, 1))
        symbols, bangs, bars, caps = per(len(re.findall(rb"[#*$%&|<>]", data)), n), per(data.count(b"!"), n), per(data.count(b"|"), n), per(up, letters)
        v = lambda known, bad, good: (0 if bad else 2 if good else 1) if known else 1
        return [v(n > 0, symbols >= 0.3, symbols <= 0.05), v(letters >= 20, caps >= 0.4, caps <= 0.2), v(n > 0, bangs >= 0.2, bangs <= 0.05), v(n > 0, bars >= 0.15, bars <= 0.02), v(lines and n >= 20, closed <= 0.1, closed >= 0.6), v(n >= 20, fresh <= 0.85, fresh >= 0.95), v(n >= 20, little <= 0.02, little >= 0.2), v(n >= 20, size >= 16 or size <= 2, 4 <= size <= 9)]

    texts = [t for t in staged[0].text if t is not None] + ["", "a", "A! B! C!"]
    blob = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(blob), dtype=np.uint8), np.cumsum([0, *map(len, blob)])
    assert quality_classifier.votes(data, offsets).tolist() == [voted(t) for t in texts]
    h, whole = quality_classifier.grams(data, offsets)
    for d in range(0, len(texts), 7):
        x = blob[d]
        plain = [(((x[i] * 0x01000193 + x[i + 1]) * 0x01000193 + x[i + 2]) * 2654435761 % 2**32) >> 19 for i in range(len(x) - 2)]
        own = slice(offsets[d], offsets[d + 1])
        assert h[own][whole[own]].tolist() == plain
    assert K.CHUNK >= 1


@needs_data
def test_columns_and_lengths(staged):
    for before, after in zip(staged, staged[1:-1], strict=False):
        assert list(after.columns) == P.COLUMNS
        assert set(after.doc_id) <= set(before.doc_id) and (after.text.map(len) == after.n_chars).all()


@needs_data
def test_one_of_each_near_duplicate_group_stays(staged):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    before, after = staged[2], staged[3]
    sets = [(i, shingles(t)) for i, t in zip(before.doc_id, before.text, strict=True)]
    reach = {i: i for i, _ in sets}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                reach[y] = x
    assert set(after.doc_id) == {find(i) for i in reach}


@needs_data
def test_no_personal_data_is_left(staged):
    assert not staged[4].text.str.contains(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]").any()


@needs_data
def test_everything_is_packed(staged):
    before, packed = staged[4], staged[5]
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: len(t.encode()) + 1 for i, t in zip(before.doc_id, before.text, strict=True)}
    assert (packed.bin_fill <= 8192).all()


@needs_data
def test_run_is_the_stages_in_turn(spark, staged):
    assert P.run(spark, DIR).count() == len(staged[5])


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_classifier_on_held_out_labels(spark):
    """No label is used in training, so all of them are held out."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality_classifier.classify(docs, quality_classifier.fit(docs)).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() >= 0.93
    assert got[got.quality == 1].kept.mean() >= 0.98
