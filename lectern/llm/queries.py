"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship, spread
from . import ann, minhash, packing, pii, quality_classifier, quality_rules, sentence_pieces, sharding, token_output, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op3_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.encode_documents(table(spark, sf_dir, "documents"), model)
    back = sentence_pieces.decode_documents(coded, model, carry=("n_ids", "ids", "ids_crc32", "text_crc32"))
    return back.select("doc_id", "n_ids", "ids", "ids_crc32", (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32")).alias("decoded_ok"))


def op4_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), out)
    return warc.read_archives(spark, out).drop("url")


OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN w USING (d)
"""


def op10_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_output.read_tokens(spark, out)


def op5_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
ids AS (SELECT s, row_number() OVER () AS k, count(*) AS df FROM sh GROUP BY s),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ranked AS (
  SELECT sh.doc_id, n.n, ids.k, row_number() OVER (PARTITION BY sh.doc_id ORDER BY ids.df, ids.k) AS r FROM sh JOIN ids USING (s) JOIN n USING (doc_id)),
pre AS (SELECT doc_id, n, k FROM ranked WHERE r <= n - CAST(ceil(0.8 * n - 1e-9) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.k = b.k AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
both_ AS (SELECT x, y, count(*) AS c FROM cand JOIN sh a ON a.doc_id = x JOIN sh b ON b.doc_id = y AND a.s = b.s GROUP BY x, y),
links AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

def op1_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


OP2_SQL = """
WITH RECURSIVE t AS (
  SELECT list(crc ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT r, doc_id, octet_length(encode(text)) + 8 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: (16 * (instr('0123456789ABCDEF', h[1]) - 1) + instr('0123456789ABCDEF', h[2]) - 1)::BIGINT),
      lambda c, x: xor(c >> 8, crcs[xor(c & 255, x) + 1])), 4294967295) AS crc
  FROM d, t),
jump(r, b, j, k) AS (
  SELECT r, -1::BIGINT, 0::BIGINT, CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END FROM d
  UNION ALL
  SELECT r, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT, k2
  FROM (SELECT r, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < 24)),
placed AS (SELECT r, b AS shard, CASE WHEN j = 24 THEN 24 ELSE b END AS grown_shard FROM jump WHERE j >= 24)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM sized JOIN placed USING (r)
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=8192)


def op8_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*pii.KINDS, "term")]
    return found.select("doc_id", *counts, F.sha2(pii.listed(pii.KINDS), 256).alias("base_sha256"), pii.listed((*pii.KINDS, "term")).alias("spans"))


def _op8_sql() -> str:
    """The definition in SQL: spans by kind from matches and the gaps between them, words outside spans, counts of documents."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[length({digits}) - i + 1]::INT ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][{digits}[length({digits}) - i + 1]::INT + 1] END)) % 10 = 0"
    valid = {"email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR ('0' || ltrim(p, '0')[1:3])::INT > 255)) = 0", "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}", "phone": f"length({digits}) BETWEEN 8 AND 15"}
    edges = f"[{pii.EDGES}]+".replace("'", "''")
    term = r"CASE WHEN NOT regexp_matches({w}, '[0-9]') THEN {w} WHEN regexp_matches({w}, '\p{{L}}') THEN regexp_replace({w}, '[\p{{L}}0-9]', 'x', 'g') ELSE regexp_replace({w}, '[0-9]', '0', 'g') END".format(w="lower(w)")
    each = " UNION ALL ".join(
        f"SELECT r, {n} AS o, '{k}' AS kind, e - length(m) AS s, e, m FROM (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest(x) AS m, unnest(gs[1:len(x)]) AS g, generate_subscripts(x, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{p}') AS x, regexp_split_to_array(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')))) WHERE {valid[k]}"
        for n, (k, p) in enumerate(plain.items())
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({each}),
cut AS (SELECT r, unnest(ws) AS w, unnest(list_concat(gs, [''])[1:len(ws)]) AS g, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_split_to_array(t, '{edges}') AS ws, regexp_extract_all(t, '{edges}') AS gs FROM d SEMI JOIN base USING (r))),
placed AS (SELECT r, w, sum(length(w) + length(g)) OVER (PARTITION BY r ORDER BY i) - length(g) AS e FROM cut),
words AS (SELECT r, w, e - length(w) AS s, e, {term} AS term FROM placed WHERE length(w) >= {pii.LEAST} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = placed.r AND b.s < placed.e AND placed.e - length(w) < b.e)),
holds AS (SELECT r, kind, min(m) AS entity FROM base GROUP BY r, kind),
pairs AS (SELECT kind, term, count(DISTINCT r) AS n_both, count(DISTINCT entity) AS support FROM holds JOIN (SELECT DISTINCT r, term FROM words) USING (r) GROUP BY kind, term HAVING count(DISTINCT entity) >= {pii.SUPPORT}),
every AS (SELECT DISTINCT r, {term} AS term FROM (SELECT r, unnest(regexp_split_to_array(t, '{edges}')) AS w FROM d) WHERE length(w) >= {pii.LEAST}),
df AS (SELECT term, count(*) AS df FROM every SEMI JOIN pairs USING (term) GROUP BY term),
ic AS (SELECT kind, -log2(count(*) / (SELECT count(*) FROM d)) AS ic FROM holds GROUP BY kind),
flagged AS (SELECT kind, term FROM pairs JOIN df USING (term) JOIN ic USING (kind) WHERE ic > 0 AND (log2(n_both / df) + ic) / ic >= {pii.GENERALISE}),
terms AS (SELECT DISTINCT w.r, 4 AS o, 'term' AS kind, w.s, w.e FROM words w JOIN holds USING (r) JOIN flagged f ON f.kind = holds.kind AND f.term = w.term),
listed AS (SELECT r, count(*) FILTER (WHERE o = 4) AS n_term, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY o, s) AS spans, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY o, s) FILTER (WHERE o < 4) AS base,
  {", ".join(f"count(*) FILTER (WHERE o = {n}) AS n_{k}" for n, k in enumerate(plain))} FROM (SELECT r, o, kind, s, e FROM base UNION ALL SELECT * FROM terms) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*plain, "term"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (r)
"""


def op9_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("cleaned")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl FROM d),
win AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
rep AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM win),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY r),
lines AS (SELECT r, unnest(wl) AS l FROM w),
judged AS (
  SELECT r, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw, len(regexp_extract_all(l, ' \| ')) AS bars, len(regexp_extract_all(l, '[#*$%&|<>]')) AS sy,
    len(regexp_extract_all(l, '\p{Lu}')) AS up, len(regexp_extract_all(l, '\p{L}')) AS le,
    regexp_matches(l, '{BOILERPLATE}') AS boiler, regexp_matches(l, '[.!?:;,。！？…]') AS marked
  FROM lines),
doc AS (
  SELECT r, sum(length(l)) AS total, count(*) FILTER (WHERE bad) AS removed, coalesce(sum(length(l)) FILTER (WHERE NOT bad), 0) AS good
  FROM (SELECT *, bars >= 3 OR sy >= nw * 0.3 OR (le >= 20 AND up >= le * 0.6) OR boiler OR (nw < 4 AND NOT marked) AS bad FROM judged) GROUP BY r),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(wl)::BIGINT AS n_lines,
    coalesce(removed, 0)::BIGINT AS removed_lines, coalesce(total, 0) AS total, coalesce(good, 0) AS good
  FROM w LEFT JOIN cov USING (r) LEFT JOIN doc USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, removed_lines, NOT base_failed AND good >= total * 0.5 AS kept FROM f
""".replace("{BOILERPLATE}", quality_rules.BOILERPLATE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kmeans_tree_search": op1_kmeans_tree_search,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_streaming_viterbi": op3_streaming_viterbi,
    "op4_sharded_warc": op4_sharded_warc,
    "op5_weak_label_classifier": op5_weak_label_classifier,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_disclosure_sanitiser": op8_disclosure_sanitiser,
    "op9_line_first_cleaning": op9_line_first_cleaning,
    "op10_bit_plane_tokens": op10_bit_plane_tokens,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jump_sharding": OP2_SQL,
    "op4_sharded_warc": OP4_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
    "op8_disclosure_sanitiser": _op8_sql(),
    "op9_line_first_cleaning": OP9_SQL,
}
