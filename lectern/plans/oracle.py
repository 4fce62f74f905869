"""DuckDB SQL of the registered queries, written from each operator's definition and not from its plan."""

from __future__ import annotations

_TOKENS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"
_ASCII = r"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
_GRAMS = """
toks AS ({toks}),
grams AS (SELECT {keys}, unnest(range(1, len(t) - 4)) AS i, t FROM toks WHERE len(t) >= {least}),
named AS (SELECT {keys}, i, array_to_string(t[i:i + 5], ' ') AS phrase FROM grams),
g AS (SELECT {keys}, phrase, count(*) AS count, min(i) - 1 AS first FROM named GROUP BY {keys}, phrase)"""
_DOC = "SELECT doc_id AS chapter, " + _TOKENS.format(t="text") + " AS t FROM documents"
_LINES = "lines AS (SELECT doc_id AS chapter, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_CROSS = _GRAMS.format(toks=_DOC, keys="chapter", least=50) + ", top AS (SELECT chapter, phrase, count, first FROM (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY count DESC, first) AS r FROM g) WHERE r = 1 AND count >= 5)"
_RATES = "rates AS (SELECT doc_id AS chapter, n_chars / 15.0 AS duration, len(" + _TOKENS.format(t="text") + ") AS words, CASE WHEN n_chars > 0 THEN len(" + _TOKENS.format(t="text") + ") / (n_chars / 15.0 / 3600) ELSE 0 END AS rate FROM documents WHERE doc_id <> 0), outliers AS (SELECT chapter, words, duration, rate, (rate - m) / s AS z FROM rates, (SELECT avg(rate) AS m, stddev_samp(rate) AS s FROM rates) WHERE abs((rate - m) / s) > 2.5)"
_FLAGGED = f"{_CROSS}, {_RATES}, flagged AS (SELECT chapter FROM top UNION SELECT chapter FROM outliers), planned AS (SELECT doc_id AS chapter FROM labels WHERE quality = 0)"
_RUNS = """runs AS (SELECT event_id AS id, user_id AS book_id, event_type AS stage, ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finished_at,
  event_type <> 'error' AS ok, event_type = 'view' AS superseded, value AS cost_usd, event_type IN ('purchase', 'signup') AS cost_reported, value / 2 AS estimated_cost, event_type = 'click' AS estimate_complete, floor(value)::BIGINT AS tokens_in FROM events)"""
_BOOKS = "books AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS series, month(o_orderdate) AS pos, o_orderstatus AS status FROM orders)"
_SPANS = "spans AS (SELECT user_id AS book, floor(epoch(ts)) - 1704067200 AS start, floor(epoch(ts)) - 1704067200 + floor(value) * 600 AS stop FROM events)"
_MERGED = _SPANS + """, m AS (SELECT *, max(stop) OVER (PARTITION BY book ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
k AS (SELECT *, sum(CASE WHEN start > before THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY start, stop) AS i FROM m),
merged AS (SELECT book, min(start) AS start, max(stop) AS stop FROM k GROUP BY book, i)"""
_GAPS = _SPANS + """, real_spans AS (SELECT * FROM spans WHERE stop > start), m AS (SELECT *, max(stop) OVER (PARTITION BY book ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM real_spans),
k AS (SELECT *, sum(CASE WHEN start > before THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY start, stop) AS i FROM m),
merged AS (SELECT book, min(start) AS start, max(stop) AS stop FROM k GROUP BY book, i),
totals AS (SELECT c_custkey AS book, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 3000000.0 END AS duration FROM customer),
inner_gaps AS (SELECT book, coalesce(lag(stop) OVER w, 0) AS a, start AS b, CASE WHEN lag(stop) OVER w IS NULL THEN 'leading' ELSE 'interior' END AS place FROM merged WINDOW w AS (PARTITION BY book ORDER BY start)),
tails AS (SELECT t.book, coalesce(max(stop), 0) AS a, duration AS b, CASE WHEN max(stop) IS NULL THEN 'interior' ELSE 'trailing' END AS place, max(stop) IS NULL AS bare FROM totals t LEFT JOIN merged USING (book) GROUP BY t.book, duration),
gaps AS (SELECT book, a, b, place FROM (SELECT *, false AS bare FROM inner_gaps UNION ALL SELECT * FROM tails) JOIN totals USING (book) WHERE duration > 0 AND (b - a >= 1 OR bare))"""

_FORMS = "words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS w FROM documents), forms AS (SELECT upper(w[1]) || lower(w[2:]) AS form, count(*) AS count FROM words GROUP BY 1)"
_NAMES = """sources AS (SELECT p_name AS name, CASE WHEN arg_min(p_type, p_partkey) LIKE 'S%' THEN 'carryover' ELSE 'verified' END AS authority, min(p_partkey) AS pos FROM part GROUP BY 1),
refs AS (SELECT name, authority, pos, -1 AS part, lower(name) AS folded FROM sources WHERE length(name) >= 4 UNION ALL SELECT w, authority, pos, i - 1, lower(w) FROM (SELECT authority, pos, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT authority, pos, list_filter(string_split(name, ' '), lambda x: lower(x) NOT IN ('the', 'and', 'for', 'that', 'with')) AS ws FROM sources WHERE contains(name, ' '))) WHERE length(w) >= 4)"""

SQL = {
    "doc_loop_top_gram": f"WITH {_CROSS} SELECT chapter, phrase, count, first FROM top",
    "line_loop_top_gram": f"WITH {_LINES}, " + _GRAMS.format(toks="SELECT chapter, pos, " + _TOKENS.format(t="text") + " AS t FROM lines WHERE chapter <> 0", keys="chapter, pos", least=12) + " SELECT chapter, pos, phrase, count FROM (SELECT *, row_number() OVER (PARTITION BY chapter, pos ORDER BY count DESC, first) AS r FROM g) WHERE r = 1 AND count >= 8",
    "doc_multi_loop_dedup": "WITH " + _GRAMS.format(toks="SELECT doc_id AS chapter, " + _TOKENS.format(t=_ASCII.format(t="text")) + " AS t FROM documents", keys="chapter", least=50) + " SELECT chapter, phrase, count, first FROM (SELECT *, row_number() OVER (PARTITION BY chapter, list_sort(list_distinct(string_split(phrase, ' '))) ORDER BY count DESC, first) AS r FROM g WHERE count >= 5) WHERE r = 1",
    "doc_rate_outliers": f"WITH {_RATES} SELECT chapter, words, round(duration / 60, 1) AS minutes, round(rate, 1) AS rate, round(z, 2) AS z FROM outliers",
    "line_repeat_runs": f"""WITH {_LINES}, n AS (SELECT *, trim(regexp_replace(lower(regexp_replace(text, '[^\\p{{L}}\\p{{Nd}}\\s]', ' ', 'g')), '\\s+', ' ', 'g')) AS norm FROM lines WHERE chapter <> 0),
      c AS (SELECT *, CASE WHEN norm = lag(norm) OVER (PARTITION BY chapter ORDER BY pos) THEN 0 ELSE 1 END AS new FROM n WHERE norm <> ''),
      i AS (SELECT *, sum(new) OVER (PARTITION BY chapter ORDER BY pos) AS island FROM c)
      SELECT chapter, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, min(pos)::DOUBLE AS start, substr(arg_min(text, pos), 1, 60) AS text, CASE WHEN any_value(n_chars) > 0 AND min(pos) / (any_value(n_chars) / 15.0) >= 0.85 THEN 'end_fade' ELSE 'mid' END AS kind
      FROM i JOIN (SELECT doc_id AS chapter, n_chars FROM documents) USING (chapter) GROUP BY chapter, island HAVING count(*) >= 3""",
    "loop_located": f"WITH {_CROSS}, {_LINES}, hit AS (SELECT t.chapter, t.phrase, pos FROM top t JOIN lines l ON t.chapter = l.chapter AND contains(trim(regexp_replace(l.text, '\\s+', ' ', 'g')), t.phrase)) SELECT t.chapter, t.phrase, min(pos)::DOUBLE AS at, max(pos)::DOUBLE + 1 AS until FROM top t LEFT JOIN hit USING (chapter, phrase) GROUP BY t.chapter, t.phrase",
    "low_quality_worst5": "SELECT regexp_extract(source, '([0-9]+)', 1)::INT AS chapter, count(*) FILTER (WHERE quality < 0.5) AS low, count(*) AS total, round(count(*) FILTER (WHERE quality < 0.5) / count(*), 6) AS rate FROM labels JOIN documents USING (doc_id) WHERE regexp_extract(source, '([0-9]+)', 1)::INT <> 0 GROUP BY 1 ORDER BY count(*) FILTER (WHERE quality < 0.5) / count(*) DESC, 1 LIMIT 5",
    "flagged_union": f"WITH {_FLAGGED} SELECT chapter FROM flagged",
    "plan_missing": f"WITH {_FLAGGED} SELECT chapter FROM flagged EXCEPT SELECT chapter FROM planned",
    "plan_unexpected": f"WITH {_FLAGGED} SELECT chapter FROM planned EXCEPT SELECT chapter FROM flagged",
    "clean_verdict": f"WITH {_CROSS}, {_RATES} SELECT (SELECT count(*) FROM top) AS loops, (SELECT count(*) FROM outliers) AS outliers, (SELECT count(*) FROM top) + (SELECT count(*) FROM outliers) = 0 AS clean",
    "tail_burst": """WITH w AS (SELECT user_id, event_type AS word, (floor(epoch(ts)) - 1704067200) / 86400 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view'),
      t AS (SELECT user_id, max(r) AS have, greatest(max(s) FILTER (WHERE r = 1) - max(s) FILTER (WHERE r = 12), 0.001) AS span, string_agg(word, ' ' ORDER BY r DESC) FILTER (WHERE r <= 12) AS tail FROM w WHERE r <= 17 GROUP BY 1)
      SELECT user_id AS chapter, 12 AS words, substr(tail, 1, 52) AS tail, true AS fast FROM t WHERE have >= 17 AND 12 / span > 4.5""",
    "ledger_cost": "SELECT user_id AS book_id, round(sum(value), 4) AS cost FROM events GROUP BY 1",
    "ledger_total": "SELECT coalesce(sum(floor(value)::BIGINT), 0)::BIGINT AS total FROM events",
    "ledger_first_start": "SELECT user_id AS book_id, epoch_us(min(ts)) AS first_start FROM events GROUP BY 1",
    "ledger_budget": f"WITH {_RUNS}, k AS (SELECT *, CASE WHEN cost_reported THEN cost_usd WHEN estimate_complete THEN estimated_cost END AS c FROM runs) SELECT book_id, round(sum(coalesce(c, 0)), 4) AS cost, count(*) FILTER (WHERE c IS NULL AND tokens_in > 0) AS unknown, count(*) FILTER (WHERE c IS NULL AND tokens_in > 0) = 0 AS complete FROM k GROUP BY 1",
    "ledger_successes": f"WITH {_RUNS} SELECT book_id, stage, count(*) FILTER (WHERE ok AND NOT superseded) AS successes, count(*) AS runs FROM runs GROUP BY 1, 2",
    "ledger_open_runs": f"WITH {_RUNS} SELECT id, book_id, stage FROM runs WHERE finished_at IS NULL",
    "ledger_succeeded_stages": f"WITH {_RUNS} SELECT book_id, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM runs WHERE ok AND NOT superseded GROUP BY 1",
    "ledger_timing": f"WITH {_RUNS}, e AS (SELECT *, coalesce(finished_at, TIMESTAMP '2024-02-01 00:00:00') AS stop FROM runs), f AS (SELECT book_id, min(started_at) AS a, max(stop) AS b, sum(greatest(epoch_us(stop) - epoch_us(started_at), 0)) / 1e6 AS active, count(*) FILTER (WHERE finished_at IS NULL) AS n FROM e GROUP BY 1) SELECT c_custkey AS book_id, round(coalesce(greatest(epoch_us(b) - epoch_us(a), 0) / 1e6, 0), 3) AS elapsed_s, round(coalesce(active, 0), 3) AS active_s, 0.0::DOUBLE AS asr_s, coalesce(n, 0) AS open FROM customer LEFT JOIN f ON c_custkey = book_id",
    "active_rollup": "SELECT user_id AS book_id, count(*) AS active FROM events WHERE event_type = 'error' GROUP BY ROLLUP (user_id)",
    "child_rollup": """WITH c AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS tokens_in, sum(l_linenumber)::BIGINT AS tokens_out, CASE WHEN bool_and(l_returnflag <> 'N') THEN round(sum(l_extendedprice), 2) END AS cost_usd, bool_and(l_linestatus = 'F') AS e,
      'm' || (max(l_partkey) FILTER (WHERE l_partkey < 1000)) AS model, bool_or(l_returnflag = 'R') AS a, epoch_us(max(l_shipdate)) AS heartbeat_at FROM lineitem GROUP BY 1)
      SELECT o_orderkey AS stage_run_id, tokens_in, tokens_out, cost_usd, coalesce(e, true) AS estimate_complete, model, coalesce(a, false) AS active, heartbeat_at FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""",
    "semi_unresolved": "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')",
    "keyset_page": "SELECT event_id AS id, user_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 100",
    "incident_family_count": "SELECT count(*) AS n FROM events WHERE event_type = 'error' AND user_id::VARCHAR LIKE '%7'",
    "batch_cost_summary": """WITH w AS (SELECT c_mktsegment AS batch_id, round(sum(CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN o_totalprice / 2 ELSE 0 END), 2) AS work_cost, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS u FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
      s AS (SELECT c_mktsegment AS batch_id, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 0.25 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.25 ELSE 0 END)::DOUBLE AS b, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS u FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
      SELECT batch_id, work_cost, a AS book_supervision, b AS batch_supervision, w.u + s.u AS unknown FROM w JOIN s USING (batch_id)""",
    "latest_per_key": "SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1, 2",
    "superseded_successes": f"WITH {_RUNS}, x AS (SELECT book_id, stage, max(started_at) AS t FROM runs WHERE stage = 'click' AND cost_usd > 100 GROUP BY 1, 2) SELECT r.stage, count(*) FILTER (WHERE superseded OR coalesce(ok AND started_at <= t, false)) AS superseded, round(sum(cost_usd), 2) AS cost FROM runs r LEFT JOIN x USING (book_id, stage) GROUP BY 1",
    "pruned_events": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-22 00:00:00'",
    "contribution_upsert": "SELECT user_id AS book_id, event_type AS kind, arg_max(value, event_id) AS note, max(event_id) AS seq, min(event_id) AS created_at FROM events GROUP BY 1, 2",
    "rolling_recoveries": "SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') WHERE n >= 2",
    "trailing_error_run": "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1), c AS (SELECT l.user_id, t, max(e.event_id) FILTER (WHERE e.event_type <> t) AS cut FROM l JOIN events e USING (user_id) GROUP BY 1, 2) SELECT c.user_id, t AS event_type, count(*) AS n FROM c JOIN events e ON e.user_id = c.user_id AND e.event_id > coalesce(cut, -1) GROUP BY 1, 2",
    "non_converging3": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = a AND event_type = b",
    "ewma_rate": """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 0),
      f AS (SELECT user_id, i, n, value AS rate FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, 0.3 * o.value + 0.7 * f.rate FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
      SELECT user_id, round(rate, 4) AS rate FROM f WHERE i = n""",
    "running_best": "SELECT event_id, user_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events",
    "state_changes": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events) WHERE a IS NULL OR a <> event_type",
    "series_rank": f"WITH {_BOOKS} SELECT id, series, row_number() OVER (PARTITION BY series ORDER BY pos, id) - 1 AS rank FROM books",
    "lock_owner": f"WITH {_BOOKS} SELECT series, id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos, id) AS r FROM books WHERE status <> 'F') WHERE r = 1",
    "blocked_by": f"WITH {_BOOKS}, o AS (SELECT series, id AS owner FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos, id) AS r FROM books WHERE status <> 'F') WHERE r = 1) SELECT id, owner FROM books JOIN o USING (series) WHERE status <> 'F' AND id <> owner",
    "predecessor_asof": f"WITH {_BOOKS}, g AS (SELECT series, pos, max(id) AS last FROM books GROUP BY 1, 2) SELECT b.id, g.last AS previous FROM books b LEFT JOIN g ON g.series = b.series AND g.pos = (SELECT max(pos) FROM g x WHERE x.series = b.series AND x.pos < b.pos)",
    "queue_snapshot": f"WITH {_BOOKS} SELECT id, series || '/' || status AS bucket, row_number() OVER (PARTITION BY series, status ORDER BY id) AS place FROM books",
    "lane_fill": f"WITH {_BOOKS} SELECT id, status AS lane FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY id) AS r FROM books) WHERE r <= CASE status WHEN 'O' THEN 3 WHEN 'P' THEN 2 ELSE 0 END",
    "finding_counts": "SELECT user_id AS book_id, count(*) FILTER (WHERE event_type = 'error') AS blockers, count(*) FILTER (WHERE event_type = 'click') AS fixs, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS nits FROM events GROUP BY 1",
    "audit_acceptance": """WITH f AS (SELECT user_id, event_id, event_type, (event_type = 'error')::INT AS b, floor(value)::BIGINT % 8 AS fix FROM events),
      p AS (SELECT *, min(b + fix) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f)
      SELECT user_id AS book_id, count(*) FILTER (WHERE b = 0 AND fix BETWEEN 1 AND 3 AND event_id >= 2 AND event_type <> 'view' AND event_id % 6 < 4 AND coalesce(b + fix <= best + 2, false)) AS accepted FROM p GROUP BY 1""",
    "interval_merge": f"WITH {_MERGED} SELECT book, start, stop AS \"end\" FROM merged",
    "interval_gaps": f"WITH {_GAPS} SELECT book, a AS start, b AS \"end\", place FROM gaps",
    "map_complete": f"WITH {_GAPS} SELECT x.book, coalesce(bool_and(b - a < CASE WHEN place = 'interior' THEN 60 ELSE 180 END), true) AS complete FROM totals x LEFT JOIN gaps USING (book) GROUP BY 1",
    "snap_back": f"WITH {_SPANS} SELECT e.event_id, coalesce(max(s.stop), 0)::DOUBLE AS snapped FROM events e LEFT JOIN spans s ON s.book = e.user_id AND s.stop <= floor(epoch(e.ts)) - 1704067200 WHERE e.event_type = 'purchase' GROUP BY 1",
    "chunk_plan": "WITH RECURSIVE o AS (SELECT doc_id // 100 AS book, doc_id, len(" + _TOKENS.format(t="text") + """) AS words, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY doc_id // 100) AS n FROM documents),
      f AS (SELECT book, doc_id, i, n, words, words AS run, 0 AS chunk FROM o WHERE i = 1
        UNION ALL SELECT o.book, o.doc_id, o.i, o.n, o.words, CASE WHEN f.run >= 5000 THEN o.words ELSE f.run + o.words END, f.chunk + CASE WHEN f.run >= 5000 THEN 1 ELSE 0 END FROM f JOIN o ON o.book = f.book AND o.i = f.i + 1),
      c AS (SELECT book, chunk, min(doc_id) AS first, max(doc_id) AS last, sum(words) AS words, max(chunk) OVER (PARTITION BY book) AS final FROM f GROUP BY book, chunk),
      j AS (SELECT book, CASE WHEN chunk = final AND words < 2000 AND words < 5000 AND chunk > 0 THEN chunk - 1 ELSE chunk END AS chunk, first, last, words FROM c)
      SELECT book, chunk, min(first) AS first, max(last) AS last, sum(words)::BIGINT AS words FROM j GROUP BY 1, 2""",
    "cumulative_offsets": 'SELECT l_orderkey, l_linenumber, l_partkey, (sum(l_quantity) OVER w - l_quantity)::BIGINT AS start, (sum(l_quantity) OVER w)::BIGINT AS "end" FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)',
    "fold_forward_backward": """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN turn WHEN role = 'user' THEN (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn >= c.turn AND x.role = 'assistant') END AS n FROM conversations c)
      SELECT conv_id, turn AS idx, last_value(n IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter FROM c""",
    "section_ordinals": "SELECT conv_id, turn AS idx, CASE WHEN role = 'user' THEN count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) END AS ordinal FROM conversations",
    "contiguous_turns": "SELECT conv_id, min(turn) IN (0, 1) AND max(turn) - min(turn) + 1 = count(DISTINCT turn) AND count(DISTINCT turn) = count(turn) AS contiguous FROM conversations GROUP BY 1",
    "size_outliers": "WITH w AS (SELECT conv_id, turn, len(" + _TOKENS.format(t="text") + ") AS words FROM conversations), l AS (SELECT conv_id, arg_min(words, turn) AS first, list_sort(list(words)) AS s FROM w GROUP BY 1) SELECT conv_id, first * 10 < s[len(s) // 2 + 1] AS outlier FROM l",
    "edge_turns": "SELECT conv_id, turn AS idx FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS u, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations) WHERE n > 2 AND (u = 1 OR d = 1)",
    "fuzzy_reference": f"""WITH {_FORMS}, {_NAMES},
      keyed AS (SELECT *, lower(form) AS f FROM forms WHERE length(form) >= 4),
      open_ AS (SELECT * FROM keyed k WHERE f NOT IN (SELECT folded FROM refs WHERE authority = 'verified')
        AND NOT EXISTS (SELECT 1 FROM refs r JOIN forms s ON lower(s.form) = r.folded WHERE r.authority = 'verified' AND (k.f = r.folded || 's' OR k.f = r.folded || 'es'))),
      p AS (SELECT form, count, name, authority, pos, part, levenshtein(f, folded) AS distance FROM open_ JOIN refs ON f[1] = folded[1] AND abs(length(f) - length(folded)) <= 2 WHERE levenshtein(f, folded) BETWEEN 1 AND least(2, length(f) // 3)),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY distance, authority <> 'verified', pos, part) AS r FROM p) WHERE r = 1)
      SELECT form, count, name, authority, distance, (SELECT greatest(count(*) - 200, 0) FROM best) AS truncated FROM best ORDER BY authority <> 'verified', count DESC, form LIMIT 200""",
    "rule_cascade": r"WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'the ([a-z]+ing)', 'a \1', 'g'), 'and ', '& ', 'g'), 'zzqx+', 'z', 'g'), 'a ([a-z]+ing) of', '\1 for', 'g') AS t FROM documents) SELECT doc_id AS chapter, length(t) AS n_chars, md5(t) AS digest FROM r",
    "dead_rules": "SELECT p AS pattern FROM (VALUES ('the ([a-z]+ing)'), ('and '), ('zzqx+'), ('a ([a-z]+ing) of')) v(p) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(text, p))",
    "first_use": "WITH w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') || ' ' AS t FROM documents) SELECT p AS name, min(doc_id) AS first FROM (VALUES ('ring'), ('bolt'), ('the ing'), ('of the'), ('and the'), ('widget'), ('is the')) v(p) JOIN w ON contains(t, ' ' || p || ' ') GROUP BY 1",
    "shingle_overlap": "WITH a AS (SELECT doc_id AS chapter, " + _TOKENS.format(t=_ASCII.format(t="text")) + " AS t FROM documents), b AS (SELECT item_id, " + _TOKENS.format(t=_ASCII.format(t="text")) + """ AS t FROM benchmark),
      ga AS (SELECT chapter, i, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT chapter, t, unnest(range(1, len(t) - 6)) AS i FROM a)), gb AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM b)),
      h AS (SELECT DISTINCT chapter, item_id, i FROM ga JOIN gb USING (g)), k AS (SELECT *, i - row_number() OVER (PARTITION BY chapter, item_id ORDER BY i) AS k FROM h)
      SELECT chapter, item_id, min(i) - 1 AS first, count(*) + 7 AS words FROM k GROUP BY chapter, item_id, k""",
    "error_fingerprint": r"SELECT page_id, substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '(/[^\s:]+)+', '<path>', 'g'), '[0-9a-f]{8,}|[0-9]+', '#', 'g'), '\s+', ' ', 'g'))), 1, 24) AS fingerprint FROM pages",
    "name_slugs": r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS plain, trim(regexp_replace(lower(p_brand), '[^a-z0-9 ]', ' ', 'g')) AS ascii FROM part",
    "token_search": "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring') AND contains(lower(p_name || ' ' || p_brand), 'brand#1')",
    "price_estimate": "WITH p(b, m, i, o, c) AS (VALUES ('A', 'F', 2.0, 8.0, 0.5), ('A', '*', 1.0, 4.0, 0.2), ('N', '*', 3.0, 9.0, 0.3)) SELECT l_returnflag AS backend, l_linestatus AS model, coalesce(x.i, y.i) IS NOT NULL AS known, count(*) AS n, round(sum((l_quantity * coalesce(x.i, y.i)::DOUBLE + l_linenumber * coalesce(x.o, y.o)::DOUBLE + coalesce(x.c, y.c)::DOUBLE) / 1e6), 6) AS cost FROM lineitem LEFT JOIN p x ON x.b = l_returnflag AND x.m = l_linestatus LEFT JOIN p y ON y.b = l_returnflag AND y.m = '*' GROUP BY 1, 2, 3",
    "history_groups": "SELECT event_type AS stage, 'b' AS backend, CASE WHEN value > 50 THEN 'large' ELSE 'small' END AS model, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value) FILTER (WHERE event_type <> 'error'), 4) AS mean_seconds FROM events GROUP BY 1, 3",
    "profile_report": "SELECT user_id AS profile, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS completed, round(median(value) FILTER (WHERE event_type <> 'error'), 4) AS median_wall, round(avg(value / 500), 6) AS mean_recall, sum(floor(value)) AS tokens_in, CASE WHEN bool_and(event_type <> 'error' OR floor(value) = 0) THEN round(sum(value), 2) END AS cost, bool_and(event_type <> 'error' OR floor(value) = 0) AS cost_complete, bool_and(event_type <> 'error') AND bool_and(value < 400) AS hard_gate FROM events GROUP BY 1",
    "set_jaccard": "WITH s AS (SELECT doc_id, list_distinct(" + _TOKENS.format(t="lower(string_split(text, chr(10))[1])") + ") AS a, list_distinct(" + _TOKENS.format(t="lower(text)") + ") AS b FROM documents) SELECT doc_id AS chapter, CASE WHEN len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS jaccard, CASE WHEN len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(b), 6) END AS recall FROM s",
    "pareto_front": """WITH a AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS cost FROM part WHERE p_partkey % 3 <> 0)
      SELECT p_partkey, p_brand FROM a p WHERE NOT EXISTS (SELECT 1 FROM a q WHERE q.p_brand = p.p_brand AND NOT (p.cost IS NOT NULL AND q.cost IS NULL) AND q.p_size >= p.p_size AND q.p_partkey >= p.p_partkey AND (p.cost IS NULL OR q.cost <= p.cost)
        AND (q.p_size > p.p_size OR q.p_partkey > p.p_partkey OR (p.cost IS NOT NULL AND q.cost < p.cost)))""",
    "rule_violations": "SELECT conv_id, turn, 'role_unknown' AS rule FROM conversations WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, turn, 'text_too_long' FROM conversations WHERE length(text) > 1500 UNION ALL SELECT conv_id, turn, 'text_blank' FROM conversations WHERE trim(text) = '' UNION ALL SELECT conv_id, turn, 'turn_out_of_range' FROM conversations WHERE NOT turn BETWEEN 0 AND 5",
    "cost_summary": "SELECT user_id AS book_id, round(sum(value), 4) AS cost, bool_or(event_type NOT IN ('purchase', 'signup')) AS estimated, false AS incomplete FROM events GROUP BY 1",
    "series_gap": "SELECT p_brand AS series FROM part GROUP BY 1 HAVING min(p_size) FILTER (WHERE p_type <> 'ECONOMY') < min(p_size) FILTER (WHERE p_type = 'ECONOMY')",
    "contribution_summary": "SELECT l_orderkey AS book_id, CASE WHEN bool_or(l_returnflag NOT IN ('A', 'R')) THEN 'open' WHEN bool_or(l_returnflag = 'R') THEN 'rejected' WHEN bool_and(l_returnflag = 'A') THEN 'merged' ELSE 'none' END AS status, bool_or(l_linestatus = 'O') AS attention FROM lineitem GROUP BY 1",
    "gram_word_sets": "SELECT array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS words, count(*) AS n FROM part GROUP BY 1",
    "repeated_suffixes": "WITH t AS (SELECT doc_id AS chapter, " + _TOKENS.format(t="text") + " AS t FROM documents), p AS (SELECT chapter, t, unnest(range(1, 6)) AS p FROM t) SELECT DISTINCT chapter FROM p WHERE len(t) >= 3 * p AND t[len(t) - p + 1:] = t[len(t) - 2 * p + 1:len(t) - p] AND t[len(t) - p + 1:] = t[len(t) - 3 * p + 1:len(t) - 2 * p]",
    "plan_problems": f"WITH {_FLAGGED} SELECT chapter, 'missing' AS problem FROM (SELECT chapter FROM flagged EXCEPT SELECT chapter FROM planned) UNION ALL SELECT chapter, 'unexpected' FROM (SELECT chapter FROM planned EXCEPT SELECT chapter FROM flagged) UNION ALL SELECT doc_id, 'range' FROM documents SEMI JOIN planned ON doc_id = planned.chapter WHERE n_chars / 15.0 > 0 AND 10 >= n_chars / 15.0 - 1",
    "success_baseline": f"WITH {_RUNS} SELECT stage, round(max(epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 3) AS seconds, max(tokens_in) AS tokens, round(max(CASE WHEN cost_reported THEN cost_usd WHEN estimate_complete THEN estimated_cost END), 4) AS cost FROM runs WHERE ok AND NOT superseded GROUP BY 1",
    "not_improving": "WITH p AS (SELECT *, floor(value / 10) AS found, coalesce(count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM events), l AS (SELECT event_id, found, lag(found) OVER (PARTITION BY user_id, p ORDER BY event_id) AS b FROM p) SELECT event_id FROM l WHERE found >= b",
    "remaining_units": "SELECT l_orderkey, sum(greatest(l_linenumber * 8 - l_quantity, 0)) AS remaining FROM lineitem GROUP BY 1",
    "lock_holders": f"WITH {_BOOKS} SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos, id) AS r FROM books WHERE status = 'O') WHERE r = 1 UNION ALL SELECT id FROM books WHERE status = 'P'",
    "seeded_ewma": """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value > 0),
      f AS (SELECT user_id, i, n, 0.3 * value + 0.7 * 10.0::DOUBLE AS rate FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.n, 0.3 * o.value + 0.7 * f.rate FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
      SELECT user_id, round(rate, 4) AS rate FROM f WHERE i = n""",
    "rewind_stage": "WITH d AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'error' EXCEPT SELECT user_id, event_type FROM events WHERE value > 120) SELECT user_id AS book_id, min(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS stage_order FROM d GROUP BY 1",
    "span_titles": f"WITH {_GAPS}, mk AS (SELECT book, start - 300 AS ms, start + 100 AS me FROM spans WHERE stop > start AND (start - 300) % 2 = 0) SELECT g.book, g.a AS start, (SELECT count(*) FROM mk WHERE mk.book = g.book AND ms < g.b AND me > g.a AND least(g.b, me) - greatest(g.a, ms) >= 0.5 * (me - ms)) AS n FROM gaps g",
    "spans_described": f"""WITH {_GAPS}, mk AS (SELECT book, start - 300 AS ms, start + 100 AS me, 't' || start::BIGINT AS t FROM spans WHERE stop > start),
      g AS (SELECT * FROM gaps WHERE b - a >= CASE WHEN place = 'interior' THEN 60 ELSE 180 END),
      n AS (SELECT g.book, a, string_agg(t, ', ' ORDER BY ms, t) AS ts FROM g JOIN mk ON mk.book = g.book AND ms < b AND me > a AND least(b, me) - greatest(a, ms) >= 0.5 * (me - ms) GROUP BY 1, 2)
      SELECT g.book, string_agg(printf('%.1f min at %.0f-%.0fs (%s', ((b - a) / 60)::DOUBLE, a::DOUBLE, b::DOUBLE, place) || coalesce('; ' || ts, '') || ')', '; ' ORDER BY a) AS text FROM g LEFT JOIN n USING (book, a) GROUP BY 1""",
    "shift_runs": "WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 ELSE 1 END AS shift FROM conversations), i AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, shift ORDER BY turn) AS k FROM c) SELECT conv_id, shift, min(turn) AS first, max(turn) AS last FROM i GROUP BY conv_id, shift, k",
    "constant_shift": "SELECT conv_id, CASE WHEN count(DISTINCT role = 'system') = 1 THEN CASE WHEN bool_or(role = 'system') THEN 0 ELSE 1 END END AS shift FROM conversations GROUP BY 1",
    "edge_classes": "WITH w AS (SELECT conv_id, turn, len(" + _TOKENS.format(t="text") + ") < 120 AS s FROM conversations), f AS (SELECT conv_id, min(turn) FILTER (WHERE NOT s) AS a, max(turn) FILTER (WHERE NOT s) AS b FROM w GROUP BY 1), e AS (SELECT w.conv_id, turn, CASE WHEN turn < a THEN 'leading' WHEN turn > b THEN 'trailing' END AS edge FROM w JOIN f USING (conv_id)) SELECT conv_id, turn AS idx, CASE WHEN count(edge) OVER (PARTITION BY conv_id, edge) <= 8 THEN edge END AS edge FROM e",
    "collected_chapters": "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_quantity::BIGINT AS q FROM lineitem) SELECT l_orderkey AS book, l_linenumber AS chapter, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS files, sum(q)::BIGINT AS words, 't' AS title FROM d GROUP BY 1, 2",
    "known_forms": """WITH n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS k FROM part), v(f) AS (VALUES ('Rings'), ('ring'), ('bolt''s'), ('BLUE'), ('gizmos'), ('smalls'), ('Blue ox'), ('Blue whale'))
      SELECT f AS form FROM v WHERE lower(f) IN (SELECT k FROM n) OR regexp_replace(lower(f), chr(39) || 's$', '') IN (SELECT k FROM n) OR (length(string_split(f, ' ')[-1]) < 4 AND lower(string_split(f, ' ')[1]) IN (SELECT k FROM n))
        OR EXISTS (SELECT 1 FROM n JOIN v w ON lower(w.f) = k WHERE lower(v.f) IN (k || 's', k || 'es'))""",
    "top_names": "SELECT p_name, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "series_glossary": "SELECT a.o_orderkey AS id, string_agg(DISTINCT b.o_orderpriority, ',' ORDER BY b.o_orderpriority) AS names FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND month(b.o_orderdate) < month(a.o_orderdate) GROUP BY 1",
    "override_view": "SELECT p_partkey AS source_path, coalesce(s_acctbal < 0, false) AS hidden, coalesce(s_nationkey = 1, false) AS force_audio FROM part LEFT JOIN supplier ON p_partkey = s_suppkey",
    "epub_pairs": "WITH e AS (SELECT s_nationkey, count(*) FILTER (WHERE s_acctbal > 5000) AS n, min(s_suppkey) FILTER (WHERE s_acctbal > 5000) AS p FROM supplier GROUP BY 1) SELECT n_nationkey AS dir, CASE WHEN n = 1 THEN p END AS epub, CASE WHEN coalesce(n, 0) = 0 THEN 'no epub' WHEN n > 1 THEN 'several epubs' END AS note FROM nation LEFT JOIN e ON n_nationkey = s_nationkey",
    "newest_snapshot": "SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS generation FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
    "timeline_places": "SELECT r_name AS stage, r_regionkey AS stage_order, CASE WHEN r_regionkey < 2 THEN 'done' WHEN r_regionkey = 2 THEN 'current' ELSE 'ahead' END AS place FROM region",
    "result_tally": "SELECT count(*) FILTER (WHERE event_type = 'signup') AS created, count(*) FILTER (WHERE event_type = 'click') AS duplicate, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events",
    "log_lines": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error: ' || (props->>'$.k') ELSE event_type END AS line FROM events",
    "spend_runs": "SELECT event_id AS id FROM events WHERE value > 0 OR floor(value) > 0",
    "run_seconds": f"WITH {_RUNS} SELECT id, CASE WHEN finished_at >= started_at THEN round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 3) END AS seconds FROM runs",
    "coverage_ladder": """WITH p AS (SELECT p_partkey::VARCHAR AS path, lower(p_name || ' ' || p_type) AS t, CASE WHEN p_size < 10 THEN p_brand END AS asin, CASE WHEN p_size < 20 THEN p_type END AS isbn FROM part),
      a AS (SELECT 'Brand#' || s_nationkey AS k, min('w' || s_suppkey) AS w FROM supplier GROUP BY 1), i AS (SELECT 'SMALL' AS k, min('w' || s_suppkey) AS w FROM supplier WHERE s_nationkey = 3),
      works(work_id, o) AS (VALUES ('t1', 'blue bolt economy'), ('t2', 'red ring small'), ('t3', 'large gear standard')),
      s AS (SELECT path, work_id, list_distinct(string_split(t, ' ')) AS x, list_distinct(string_split(o, ' ')) AS y, 1 - levenshtein(t, o) / greatest(length(t), length(o))::DOUBLE AS e FROM p, works),
      sc AS (SELECT path, work_id, greatest(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, e) AS score FROM s WHERE len(list_filter(list_intersect(x, y), lambda w: length(w) >= 4)) > 0),
      f AS (SELECT path, work_id FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, work_id DESC) AS r FROM sc WHERE score >= 0.75) WHERE r = 1)
      SELECT p.path, coalesce(a.w, i.w, f.work_id) AS work_id, CASE WHEN a.w IS NOT NULL THEN 'asin' WHEN i.w IS NOT NULL THEN 'isbn' WHEN f.work_id IS NOT NULL THEN 'title' END AS matched_by
      FROM p LEFT JOIN a ON a.k = p.asin LEFT JOIN i ON i.k = p.isbn AND i.w IS NOT NULL LEFT JOIN f ON f.path = p.path""",
}
SQL["stream_last_write"] = SQL["latest_per_key"]
SQL["stream_moving_average"] = SQL["ewma_rate"]
SQL["stream_counts"] = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2"
SQL["stream_deduplicated"] = "SELECT DISTINCT event_id, user_id FROM events"
SQL["stream_changes"] = SQL["state_changes"]
SQL["stream_rolling"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2"
SQL["stream_replayed"] = "SELECT event_id FROM events WHERE event_id > 400"
