"""Each dealt operator on a small table of hard rows, against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, minhash, packing, pii, quality_classifier, quality_rules, sentence_pieces, sharding, token_output, warc
from lectern.llm.common import filesystem, new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, id long, node long, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(rng, n):
    return " ".join(rng.choice(["the", "of", "Thing", "ouer", "erinst,", "hation.", "é", "que", "naïve"]) + str(rng.randrange(40)) for _ in range(n))


def hard_texts() -> list[tuple]:
    rng = random.Random(5)
    base = [_words(rng, 120) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.02 else "x" for w in base[0].split()) for _ in range(8)]
    texts = [None, "", " \n\t ", "one", "two words", "Two  WORDS", *base, base[1], base[1], base[1].upper(), *near, "long " + _words(rng, 20_000), "a b " * 300, "日本語 テスト 😀 é\n" * 3, "a@b.co mail +1 (234) 567-8901 10.0.0.1 4111 1111 1111 1111\nx"]
    rows = [(i * 7 - 3, t) for i, t in enumerate(texts)]
    return [*rows, (rows[7][0], rows[7][1]), (None, "no id at all"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 5 else None, len(t or ""), k, 99, -1, 0.5) for k, (i, t) in enumerate(hard_texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, empty, width):
    rows = [(r.doc_id, shingle_set(r.text, width)) for r in docs.collect()]
    reach = {i: i for i, _ in rows if i is not None}

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a, s in rows:
        for b, t in rows:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((find(a), find(b)))
                reach[y] = x
    want = sorted((i is None, i or 0, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in rows)
    got = minhash.near_duplicates(docs, width=width).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert minhash.near_duplicates(empty).count() == 0


def test_regular_words_and_other_hash_traps(spark):
    """Words that are equal under any polynomial modulo 2 ** 64: the Thue-Morse sequence and its complement."""
    from lectern.llm import kernels as K

    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, morse), (2, morse.translate(str.maketrans("ab", "ba"))), (3, morse + " x y"), (4, morse.translate(str.maketrans("ab", "ba")) + " x y"), (5, "ab"), (6, "ba"), (7, "a b"), (8, morse)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 1}
    many = [f"{a}{b}" * k for a in "abcdefgh" for b in "abcdefgh" for k in range(1, 40)] + ["a" * k for k in range(1, 500)]
    data = np.frombuffer(" ".join(dict.fromkeys(many)).encode(), dtype=np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    one, two = (K.word_hashes(data, starts, ends, s) for s in (0, 1))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(dict.fromkeys(many)) and not set(one.tolist()) & set(two.tolist())


def test_large_mixed_bucket_is_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "HUBS", 2)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > rng.choice([0.01, 0.05, 0.12]) else f"q{rng.randrange(10**6)}" for w in base)) for i in range(60)]
    sets = [shingle_set(t, 2) for _, t in rows]
    reach = list(range(60))

    def find(x):
        while reach[x] != x:
            x = reach[x]
        return x

    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                reach[y] = x
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(60)}
    assert 1 < len({find(i) for i in range(60)}) < 60


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, shards=24).collect()
    assert len(got) == docs.count()
    texts = {(r.doc_id, zlib.crc32((r.text or "").encode())): r.text or "" for r in docs.collect()}
    slots: dict = {}
    for r in got:
        t = texts[(r.doc_id, r.text_crc32)]
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.size, r.law, r.shard, r.grown_shard) == (len(t.encode()) + 8, "key", jump(key, 24), jump(key, 25))
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


def test_jump_with_many_shards(spark):
    keys = [*range(40), -1, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 64, 65, 1000):
        assert {r.k: r.b for r in df.select("k", sharding.jump("k", n)["b"].alias("b")).collect()} == {k: jump(k, n) for k in keys}


def test_quality_rules(docs, empty):
    got = sorted((r.asDict() for r in quality_rules.judge(docs, carry=("text",)).collect()), key=lambda r: (r["text"] or "", str(r["doc_id"])))
    assert len(got) == docs.count()
    for r in got:
        t = r["text"] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows: dict = {}
        for i in range(len(w) - 2):
            windows.setdefault(tuple(w[i : i + 3]), []).append(i)
        hit = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
        assert r["removed_lines"] or r["cleaned"] == t
    assert quality_rules.judge(empty).count() == 0


def test_failing_lines_go(spark):
    good = "This is a fine sentence of clean text that stays as it is. " * 12
    text = f"{good}\nHome | News | Sport | Weather\n{good}\nAll rights reserved.\nBUY NOW GREAT OFFERS EVERYWHERE TODAY!!"
    r = quality_rules.judge(spark.createDataFrame([(1, text.replace(good, good, 1))], "doc_id long, text string")).first()
    assert r.removed_lines == 3 and "Home" not in r.cleaned and "rights" not in r.cleaned and "BUY" not in r.cleaned


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    luhn = sum((v - 9 if v > 9 else v) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0]))


def test_pii_base_spans(spark, docs, empty):
    odd = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "00255.1.1.256 0255.01.1.1", "é😀 4111-1111 1111 1111 x@y.z", "@a.b a@b.c@d.e --@x.y.", "+1+12345678 and 5500-0000-0000-0004,4111111111111111 12  34", "a@b." + "c." * 3000 + "d", "9" * 5000, "+" + "1-" * 4000, "x@" * 2000, "1." * 3000]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = pii.find(both, carry=("text",)).select("text", pii.listed(pii.KINDS).alias("base")).collect()
    assert len(got) == both.count()
    for r in got:
        assert r.base == base(r.text), r.text[:80]
    assert pii.find(empty).count() == 0


def test_pii_terms_that_disclose_are_sanitised(spark):
    rng = random.Random(1)
    rows = [(i, f"Filler {_words(rng, 8)}\nwrite to zephyrine at u{i}@mail{i}.org soon {rng.randrange(10**6)}") for i in range(30)] + [(100 + i, f"nothing to see {_words(rng, 30)} soon") for i in range(300)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(30):
        assert [s["text"] for s in got[i].term if s["text"] == "zephyrine"] and "zephyrine" not in got[i].sanitised and "<EMAIL>" in got[i].sanitised and "soon" in got[i].sanitised
    assert all(not got[100 + i].term and got[100 + i].sanitised == rows[30 + i][1] for i in range(300))


def test_pii_repeated_rows_change_nothing(spark):
    rows = [(i, f"filler\nwrite {i} to zephyrine at u{i}@mail{i}.org") for i in range(30)] + [(100 + i, f"nothing to see {i}") for i in range(450)]
    for copies in (1, 2):
        got = [r for r in pii.find(spark.createDataFrame(rows * copies, "doc_id long, text string")).collect() if r.doc_id < 100]
        assert len(got) == 30 * copies and all("zephyrine" not in r.sanitised for r in got)


def test_pii_support_is_exact(spark):
    few = [(10_000 * n + 8 * j + i, f"say {8 * j + i} term{'abcdefg'[n]}{'x' * j} to u{n}y{8 * j + i}@mail.org") for n in (5, 6) for j in range(60) for i in range(n)]
    docs = spark.createDataFrame(few + [(-i - 1, "plain text") for i in range(len(few))], "doc_id long, text string")
    kept = [s["text"] for r in pii.find(docs).select("term").collect() for s in r.term if s["text"].startswith("term")]
    assert sorted(kept) == sorted(f"termg{'x' * j}" for j in range(60) for _ in range(6))


def brute_terms(rows):
    """(spans by row, sanitised by row) from the definition, for texts whose lower case has their length."""
    def shape(w):
        w = w.lower()
        return w if not re.search("[0-9]", w) else re.sub(r"[^\W_]", "x", w) if re.search(r"[^\W\d_]", w) else re.sub("[0-9]", "0", w)

    def words(t):
        return [(m.start(), m.end(), m[0]) for m in re.finditer(f"[^{pii.EDGES}]{{{pii.LEAST},}}", t)]

    bases = [[(m.start(), m.end(), k, m[0]) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m[0])] for _, t in rows]
    free = [[w for w in words(t or "") if not any(b[0] < w[1] and w[0] < b[1] for b in base)] for (_, t), base in zip(rows, bases, strict=True)]
    holds = [{k: min(b[3] for b in base if b[2] == k) for k in {b[2] for b in base}} for base in bases]
    df, both, support, kinds = {}, {}, {}, {}
    for (_, t), own, has in zip(rows, free, holds, strict=True):
        for x in {shape(w[2]) for w in words(t or "")}:
            df[x] = df.get(x, 0) + 1
        for k, entity in has.items():
            kinds[k] = kinds.get(k, 0) + 1
            for x in {shape(w[2]) for w in own}:
                both[k, x] = both.get((k, x), 0) + 1
                support.setdefault((k, x), set()).add(entity)
    d = {}
    for (k, x), n in both.items():
        ic = -np.log2(kinds[k] / len(rows))
        if len(support[k, x]) >= pii.SUPPORT and ic > 0:
            d[k, x] = (np.log2(n / df[x]) + ic) / ic
    out = []
    for (_, t), base, own, has in zip(rows, bases, free, holds, strict=True):
        marks, terms = [(a, b, f"<{k.upper()}>") for a, b, k, _ in base], []
        for a, b, w in own:
            best = max((d.get((k, shape(w)), 0) for k in has), default=0)
            if best >= pii.GENERALISE:
                terms.append((a, b))
                marks.append((a, b, "" if best >= pii.REMOVE else "<NUMBER>" if re.search("[0-9]", w) else "<NAME>" if w[0].isupper() else "<WORD>"))
        text, at = "", 0
        for a, b, tag in sorted(marks):
            if a >= at:
                text += (t or "")[at:a] + tag
            at = max(at, b)
        out.append((terms, text + (t or "")[at:] if t is not None else None))
    return out


def test_pii_terms_against_brute_force(spark, docs, empty):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = [rng.choice(["alpha", "Beta", "gamma7", "delta", "the", "étude", "4711", "é-1x"]) for _ in range(rng.randrange(3, 12))]
        if rng.random() < 0.12:
            words += ["zephyr"] * (rng.random() < 0.8) + [rng.choice(["Token", "token"])] * (rng.random() < 0.7) + ["%040x" % rng.getrandbits(160)] * (rng.random() < 0.6)
            words.append(rng.choice([f"u{i}@m{i}.org", f"+1 (234) 555-{1000 + i}", f"10.0.{i % 250}.{i % 9}", f"x+1{2345678 + i}y"]))
        if rng.random() < 0.02:
            words.append("zephyr")
        rng.shuffle(words)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (900, ""), (901, "long " + " ".join(f"q{i}@w.org token zephyr" for i in range(3000)))]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(str(i), t) for (i, _), t in zip(rows, brute_terms(rows), strict=True)]
    mine = [(str(r.doc_id), ([(s["start"], s["end"]) for s in r.term], r.sanitised)) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert sum(len(x[1][0]) for x in want) > 30


def test_warc_round_trip(spark, docs, tmp_path):
    big = "<p>" + "x" * 1200 + "é</p>"
    rows = [(5, "http://a", big), (9, "http://b", big), (7, None, big), (1, "http://c", "small"), (2, "http://d", "small"), (3, "bad url\n", None), (None, "http://n", big), (9, "http://b", big), *[(20 + i, f"http://x/{i}", f"page {i} " * 200) for i in range(40)]]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, id int")
    out = new_path(spark, "warc")
    made = warc.write_archives(pages, out, shard_bytes=20_000, roll_bytes=3_000)
    assert made.count() > 3
    got = warc.read_archives(spark, out, with_payload=True).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and i is not None and i < 9
        want.append((i is None, i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: (x[:2], x[2:4]))
    again = new_path(spark, "warc")
    warc.write_archives(pages.orderBy(F.desc("url")).repartition(3), again, shard_bytes=20_000, roll_bytes=3_000)
    names = lambda o: {p.name: p.read_bytes() for p in Path(filesystem(o)[1]).glob("*.gz")}
    assert names(out) == names(again)
    none = new_path(spark, "warc")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_token_files(spark, docs, empty, unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(["<|endoftext|> x<|ENDOFTEXT|>y", "it's I'M don't.", "ΑΣ ΣΑΣ. é, É.", "a\x1cb\x1fc", "a b c\u0085d", "x.,. ,.x ..", "é ́", "ABC.DEF,GHI 12.5, ¼. ２,"])], "doc_id long, text string")
    both = docs.select("doc_id", "text", "shard", "id").unionByName(odd, allowMissingColumns=True)
    out = new_path(spark, "tokens")
    assert token_output.write_tokens(both, out, path, unit=unit, block=1000, shard_bytes=30_000).count() > 1
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_tokens(spark, out).collect()), key=lambda r: r[2])
    rows = sorted(both.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    tokenizer, start, want = Tokenizer.from_file(path), 0, []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id is not None, r.doc_id or 0, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    none = new_path(spark, "tokens")
    token_output.write_tokens(empty, none, path)
    assert token_output.read_tokens(spark, none).count() == 0


def test_words_that_normalising_parts_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [f"x {c}{end} y" for c in ("\u09df", "\u095e", "\u0130", "a\u09dc", "\u0a33", "\ufb2a", "é", "a") for end in (",", ".", ".,")]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert token_output.encoder(path)(texts) == want


def test_plane_blocks_are_read_alone():
    import io

    f = io.BytesIO()
    w = token_output.PlaneWriter(f, "bit", block=100)
    ids = np.arange(1050, dtype="<u4") * 2654435761
    w.add(1, ids.tobytes())
    w.close()
    assert (token_output.PlaneReader(f).block(7) == ids[700:800]).all()


def test_sentence_pieces(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model, raw = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Model(path), sentence_pieces.Decoder(path)
    odd = ["", " ", "  a  b   ", "\n\n x", "x \n y\n", "▁a ▁▁b▁", "a" * 300, " " * 100 + "x", "hello\r\nworld\t!", "def f(x):\n    return x+1\n\n\n  # c", "<s> <0x0A>", "\x00"]
    rng = random.Random(2)
    odd += ["".join(rng.choice("abcde.,'() \n▁éß日0") for _ in range(60)) for _ in range(150)]
    for t in odd:
        want = sp.encode(t)
        assert sentence_pieces.encode(model, t) == want, t
        text = sentence_pieces.normalise(t)
        assert list(sentence_pieces.stream(model, [text[i : i + 3] for i in range(0, len(text), 3)])) == want, t
        assert sentence_pieces.decode(raw, want) == sp.decode(want), t
    got = sentence_pieces.encode_documents(docs, path).collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(sp.encode(r.text or "")) for r in docs.collect())
    assert sentence_pieces.encode_documents(empty, path).count() == 0
    back = sentence_pieces.decode_documents(sentence_pieces.encode_documents(docs, path), path)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), sp.decode(sp.encode(r.text or ""))) for r in docs.collect())


def test_decoding_a_table_of_ids(spark, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, sp.encode("two words"), "x"), (1, sp.encode("two words"), "x"), (None, [], "y"), (3, None, None), (4, [1, 2, 300, 13], "z")]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, text string")
    got = [(r.doc_id, r.text) for r in sentence_pieces.decode_documents(df, path).collect()]
    assert got == [(i, None if ids is None else sp.decode(ids)) for i, ids, _ in rows]
    assert sentence_pieces.decode_documents(df.limit(0), path, carry=("text",)).count() == 0


def test_every_text_is_streamed_and_committed_in_parts(monkeypatch):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Model(path)
    calls, stream = [], sentence_pieces.stream
    monkeypatch.setattr(sentence_pieces, "stream", lambda model, chunks, committed=None: calls.append(1) or stream(model, chunks, committed))
    texts = [t for _, t in hard_texts() if t]
    assert [sentence_pieces.encode(model, t) for t in texts] == [sp.encode(t) for t in texts] and calls
    for t in (texts[4] * 20, "internationalisation" * 200, "aaab" * 500):
        commits, text = [], sentence_pieces.normalise(t)
        assert list(stream(model, [text[i : i + 7] for i in range(0, len(text), 7)], commits)) == sp.encode(t)
        assert sum(commits) == len(text) and len(commits) > len(text) / (6 * model.longest)


def test_stream_keeps_a_bounded_window():
    import public_tokenizers

    model = sentence_pieces.Model(public_tokenizers.path("piece_bpe_32k.model"))
    seen = 0

    def feed():
        nonlocal seen
        for _ in range(3000):
            seen += 4
            yield "the▁"

    first = next(iter(sentence_pieces.stream(model, feed())))
    assert isinstance(first, int) and seen < 200


def test_packing_against_a_plain_search(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, int(min(50_000, rng.lognormvariate(6.5, 1))), f"s{rng.choice([0] * 7 + list(range(20)))}" if rng.random() > 0.05 else None, rng.randrange(300)) for i in range(900)]
    bins, want = [], {}
    rest = []
    for i, (d, n, s, c) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        full = n // 4096 if n > 4096 else 0
        for p in range(full):
            want[d, p] = len(bins)
            bins.append(None)
        if n - full * 4096 > 0 or not full:
            rest.append((n - full * 4096, i, d, full, s, c))
    for n, _, d, p, s, c in sorted(rest, key=lambda r: (-r[0], r[1])):
        fits = [(b[0], k) for k, b in enumerate(bins) if b and b[0] >= n and (s is None or s not in b[1]) and c not in b[2]]
        if not fits:
            bins.append([4096, set(), set()])
        k = min(fits)[1] if fits else len(bins) - 1
        bins[k][0] -= n
        bins[k][1].add(s)
        bins[k][2].add(c)
        want[d, p] = k
    got = packing.pack(rows, 4096)
    assert {(r[0], r[1]): r[4] for r in got} == want
    out = packing.pack_documents(docs, capacity=512, group=8).collect()
    total: dict = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.bin_offset + r.length <= r.bin_fill <= 512
    sizes: dict = {}
    for r in docs.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + len((r.text or "").encode()) + 1
    assert total == sizes and packing.pack_documents(empty).count() == 0


def test_classifier_on_hard_rows(docs, empty):
    model = quality_classifier.fit(docs)
    got = quality_classifier.classify(docs, model, carry=("text", "shard")).collect()
    assert len(got) == docs.count() and all(not r.kept for r in got if not (r.text or "").strip()) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.classify(empty, quality_classifier.fit(empty)).count() == 0


def test_em_finds_the_accurate_labeller():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.8
    v = np.full((20_000, quality_classifier.LABELLERS), 2)
    v[:, 0] = np.where(rng.random(20_000) < 0.95, np.where(y, 2, 0), 1)
    v[:, 1] = np.where(y, 2, np.where(rng.random(20_000) < 0.5, 0, 2))
    p, n = np.unique(quality_classifier.pattern(v), return_counts=True)
    post, accuracy, share = quality_classifier.estimate(p, n.astype(float))
    label = dict(zip(p.tolist(), (post > 0.5).tolist(), strict=True))
    assert np.mean([label[int(x)] == t for x, t in zip(quality_classifier.pattern(v), y, strict=True)]) > 0.98
    assert abs(share - 0.8) < 0.03 and accuracy[0, 0, 0] > accuracy[0, 1, 0]


def test_search_small_and_hard(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(40)] + [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [1.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (2100, [1.0] * 3), (2120, []), (None, [1.0] * 8), rows[20], (40, [float(x) for x in rng.normal(size=8)])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, leaf int, point int")
    good = [(i, np.array(v)) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}]
    got: dict = {}
    for r in ann.search(df, leaf_points=40, target=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = {i for i, _ in good if i % 20 == 0}
    assert set(got) == queries
    for q in queries:
        best: dict = {}
        for qi, qv in good:
            if qi == q:
                for i, v in good:
                    if i != q:
                        best[i] = max(best.get(i, -np.inf), round(float((v * qv).sum()), 9))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert np.allclose([s for _, _, s in mine], [s for _, s in want]) and [i for _, i, _ in mine] == [i for i, _ in want]
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf_points", [1000, 40])
def test_ties_at_the_cut_go_to_the_smaller_id(spark, leaf_points):
    """Different vectors that all score 1 with the queries: the 20 smallest ids, from whatever points."""
    rows = [(i * 20, [1.0, 0.0, 0.0, 0.0]) for i in range(100, 103)] + [(i, [1.0, i / 512, (i % 7) / 4, 0.0]) for i in range(1, 400) if i % 20]
    rows += [(7, [1.0, 0.5, 0.0, 2.0]), (9, [1.0, 0.25, 0.0, 3.0]), (3000, [1.0, 1 / 512, 0.25, 0.0]), *[(5, [1.0, 0.0, float(j), 1.0]) for j in range(60)]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, leaf_points=leaf_points, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {2000, 2020, 2040, 3000}
    want = [i for i in range(1, 400) if i % 20][:20]
    assert all(got[q] == [(i, 1.0) for i in want] for q in (2000, 2020, 2040))


def test_recall_of_the_widened_search(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, leaf_points=60).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    assert np.mean(hits) >= 0.9


def test_hot_keys_are_split(spark, monkeypatch):
    from lectern.llm import common

    tables = common.Tables(spark)
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k long, x long")
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(tables, counts, "k")
    assert [(r.k, r.parts) for r in hot.collect()] == [(1, 8)]
    small = counts.select("k", (F.col("k") * 2).alias("y")).where("k <> 6")
    for how in ("inner", "left"):
        got = common.split_join(big, small, ["k"], hot, ["x"], how)
        assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "k", how).collect()))
    assert common.hot_keys(tables, counts.where("k > 1"), "k") is None
    assert common.hot_keys(tables, counts.limit(0), "k") is None


def test_a_star_with_a_tail_is_one_component(spark):
    from lectern.llm.common import Tables
    from lectern.llm.components import connected_components

    links = [(5000, i) for i in range(1, 900)] + [(i, i + 1) for i in range(900, 920)] + [(7000, 7001)]
    got = {r.node: r.component for r in connected_components(Tables(spark), spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (*range(1, 900), 5000)}, **{i: 900 for i in range(900, 921)}, 7000: 7000, 7001: 7000}


def test_packing_deals_rows_that_repeat(spark):
    rows = [(1, "same text", "s")] * 500 + [(None, "no id", None)] * 100 + [(i, f"text {i} " * (i % 9), f"s{i % 5}") for i in range(2, 302)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=64, group=50).collect()
    assert len({r.bin_group for r in out}) == 18 and sum(r.doc_id == 1 for r in out) == 500 and sum(r.piece == 0 and r.doc_id is None for r in out) == 100
    shared = [(r.bin_group, r.bin) for r in out if r.doc_id == 1]
    assert len(set(shared)) == 500 and max(sum(g == x for g, _ in shared) for x in range(18)) <= 29


def test_shards_by_binary_search(spark):
    from lectern.llm import archive

    for bounds in ([], [5], [1, 2, 3], [-3, 0, 7, 100], list(range(0, 900, 3))):
        got = archive.with_shard(spark.range(-5, 1000).withColumn("id", F.when(F.col("id") != 11, F.col("id"))), "id", bounds).collect()
        assert all(r.shard == (0 if r.id is None else int(np.searchsorted(bounds, r.id, side="right"))) for r in got)


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from lectern.llm.common import shared_dir

    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://x:7077")))


def test_words_of_every_code_point_have_the_library_s_ids():
    """Each code point before and after letters, full stops and commas, and strings of random ones."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(9)
    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(f"a{c}. {c}, {c}B." for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    small = [chr(i) for i in range(1, 0x250)] + list("  ..,,'\"\n\t") * 20
    texts += ["".join(rng.choice(small if k % 2 else chars) for _ in range(rng.randrange(1, 40))) for k in range(6000)]
    encode = token_output.encoder(path)
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert encode(part) == want, next(t for t, a, b in zip(part, encode(part), want, strict=True) if a != b)


def test_sentence_pieces_memory(monkeypatch):
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Model(path)
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 20)
    monkeypatch.setattr(sentence_pieces, "PARTS", 30)
    texts = [f"Ablo{i} und  {i}\u2581wörter\n tail{i % 7} x " for i in range(200)]
    for t in texts:
        assert sentence_pieces.encode(model, t) == sp.encode(t), t
        assert max(len(model.words), len(model.words.old)) < 40 and max(len(model.words.parts), len(model.words.old_parts)) < 60
    sentence_pieces.encode(model, "plain words take a byte a letter")
    assert {" plain", " letter"} <= set(model.words.parts) | set(model.words.old_parts)

    ids = pa.array([sp.encode("some words of a text " * 150)] * 500, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), ids], names=["c0", "ids"])
    run = sentence_pieces._decoder(path)
    list(run([batch.slice(0, 1)]))
    tracemalloc.start()
    try:
        assert sum(map(len, run([batch]))) == 500
        assert tracemalloc.get_traced_memory()[1] < 15_000_000  # indices of all 500 took over 30 MB
    finally:
        tracemalloc.stop()
