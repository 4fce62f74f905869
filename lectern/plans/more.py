"""Further registered queries, each beside its SQL: reads and changes of the ledger, schedules, intervals, numbering and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import experiments as X
from ..operators import identity, intervals, ledger, numbering, qa, ranking, spelling
from ..sources import sinks, transcripts
from . import standins as S
from .queries import QUERIES

SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark, sf):
    return S.table(spark, sf, "events").withColumn("ts", S.wall("ts"))


def orders(spark, sf):
    return S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("note"), S.wall("o_orderdate").alias("at"))


# Reads of ledger tables --------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def books_listed(spark, sf):
    return ledger.listed(orders(spark, sf), "id").select("id", "status")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey = 77")
def book_read(spark, sf):
    return ledger.listed(orders(spark, sf), id=77).select("id", "price")


@query("SELECT o_orderkey::VARCHAR AS source_path, o_orderkey AS id, month(o_orderdate)::VARCHAR AS state, o_orderstatus AS status FROM orders")
def book_tracking(spark, sf):
    return ledger.tracking(S.books(spark, sf).withColumn("source_path", F.col("id").cast("string")).withColumn("state", F.col("series_pos")))


@query("SELECT p_partkey::VARCHAR AS source_path, o_orderkey AS id, month(o_orderdate)::VARCHAR AS state, o_orderstatus AS status FROM part LEFT JOIN orders ON o_orderkey = p_partkey")
def scan_tracking(spark, sf):
    b = S.books(spark, sf).withColumn("source_path", F.col("id").cast("string")).withColumn("state", F.col("series_pos"))
    return ledger.attach_tracking(S.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("source_path")), b)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1995-06-01'")
def books_due_for_retry(spark, sf):
    b = orders(spark, sf).select("id", F.when(F.col("status") == "P", "parked").otherwise("queued").alias("status"), F.when(F.col("status") != "O", F.col("at")).alias("retry_at"))
    return ledger.due_for_retry(b, "1995-06-01 00:00:00").select("id")


@query("SELECT event_id AS id, event_type AS stage FROM events WHERE user_id = 7")
def runs_of_a_book(spark, sf):
    return ledger.listed(S.runs(spark, sf), "id", book_id=7).select("id", "stage")


@query("SELECT user_id AS book_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS runs FROM events GROUP BY 1")
def runs_by_book(spark, sf):
    return ledger.runs_grouped(S.runs(spark, sf)).select("book_id", F.array_join(F.transform("runs", lambda r: r["id"].cast("string")), ",").alias("runs"))


@query("SELECT l_orderkey AS book_id, l_linenumber AS stage, sum(l_quantity)::BIGINT AS done FROM lineitem GROUP BY 1, 2")
def progress_listed(spark, sf):
    p = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("stage")).agg(F.sum("l_quantity").cast("long").alias("done"))
    return ledger.listed(p, "book_id", "stage")


@query("SELECT l_linenumber AS stage, l_quantity::BIGINT AS done FROM lineitem WHERE l_orderkey = 5")
def progress_of_a_book(spark, sf):
    p = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("stage"), F.col("l_quantity").cast("long").alias("done"))
    return ledger.listed(p, "stage", book_id=5).select("stage", "done")


def invocations(spark, sf):
    li = S.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("book_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("unit"), (F.col("l_returnflag") == "R").alias("active"), F.col("l_linestatus").alias("stage"), S.wall("l_shipdate").alias("heartbeat_at"))


@query("SELECT l_partkey AS id, l_linenumber AS unit FROM lineitem WHERE l_orderkey = 9")
def invocations_of_a_book(spark, sf):
    return ledger.listed(invocations(spark, sf), "id", book_id=9).select("id", "unit")


@query("SELECT l_orderkey AS book_id, count(*) AS n, max(l_partkey) AS last FROM lineitem GROUP BY 1")
def invocations_by_book(spark, sf):
    return ledger.listed(invocations(spark, sf), "book_id", "id").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


@query("SELECT l_orderkey AS book_id, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'")
def invocations_active(spark, sf):
    return ledger.listed(invocations(spark, sf), "book_id", "id", active=True).select("book_id", "id")


@query("SELECT l_orderkey AS book_id, epoch_us(min(l_shipdate)) AS oldest FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def oldest_heartbeats(spark, sf):
    return ledger.oldest_heartbeat(invocations(spark, sf), "book_id").select("book_id", F.unix_micros("oldest").alias("oldest"))


@query("SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS total FROM events")
def model_calls_since(spark, sf):
    return ledger.calls_since(events(spark, sf).withColumn("calls", F.lit(1)), "ts", S.at("2024-01-20 00:00:00"))


@query("SELECT round(sum(CASE event_type WHEN 'purchase' THEN value WHEN 'view' THEN value / 2 END), 2) AS cost, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'view') AND value >= 1) AS unknown FROM events WHERE user_id = 11")
def supervisor_spend(spark, sf):
    e = events(spark, sf).select("user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("provider_cost_usd"), (F.col("event_type") == "view").alias("estimate_complete"), (F.col("value") / 2).alias("estimated_cost_usd"), F.floor("value").alias("calls"))
    return ledger.supervisor_spend(e, user_id=11).withColumn("cost", F.round("cost", 2))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('O', 'P')")
def contributions_open(spark, sf):
    return ledger.listed(orders(spark, sf), "id", status=["O", "P"]).select("id")


@query("SELECT o_custkey AS owner, count(*) AS n FROM orders GROUP BY 1")
def contributions_by_book(spark, sf):
    return ledger.listed(orders(spark, sf), "owner", "id").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, o_orderpriority AS note FROM orders WHERE o_custkey = 14")
def contributions_of_a_book(spark, sf):
    return ledger.listed(orders(spark, sf), "id", owner=14).select("id", "note")


@query("SELECT n_name AS stage, n_regionkey * 1.5 AS rate FROM nation")
def rates_listed(spark, sf):
    return ledger.listed(S.table(spark, sf, "nation").select(F.col("n_name").alias("stage"), (F.col("n_regionkey") * 1.5).alias("rate")), "stage")


@query("SELECT n_regionkey * 1.5 AS rate FROM nation WHERE n_nationkey = 3")
def rate_read(spark, sf):
    return ledger.listed(S.table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") * 1.5).alias("rate")), n_nationkey=3).select("rate")


@query("SELECT r_name AS value FROM region WHERE r_regionkey = 2")
def setting_read(spark, sf):
    return ledger.listed(S.table(spark, sf, "region"), r_regionkey=2).select(F.col("r_name").alias("value"))


@query("SELECT s_suppkey AS source_path, s_acctbal < 0 AS hidden FROM supplier")
def overrides_listed(spark, sf):
    return ledger.listed(S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_path"), (F.col("s_acctbal") < 0).alias("hidden")), "source_path")


@query("SELECT o_custkey AS id, epoch_us(max(o_orderdate)) AS created FROM orders GROUP BY 1")
def batches_listed(spark, sf):
    b = orders(spark, sf).groupBy(F.col("owner").alias("id")).agg(F.unix_micros(F.max("at")).alias("created"))
    return ledger.listed(b, F.desc("created"), F.desc("id"))


# Changes -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, 'old' AS origin FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT p_partkey, 'new' FROM part WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey AND o_orderkey % 2 = 0)")
def books_created(spark, sf):
    have = orders(spark, sf).where("id % 2 = 0").select("id", F.lit("old").alias("origin"))
    return ledger.append_new(have, S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("new").alias("origin")), "id")[0]


@query("SELECT p_partkey AS id FROM part WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = p_partkey AND o_orderkey % 2 = 0)")
def books_duplicate(spark, sf):
    return ledger.append_new(orders(spark, sf).where("id % 2 = 0").select("id"), S.table(spark, sf, "part").select(F.col("p_partkey").alias("id")), "id")[1]


@query("SELECT o_orderkey AS id, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 2 ELSE o_totalprice END AS price FROM orders")
def book_state_set(spark, sf):
    return ledger.rewrite(orders(spark, sf), F.col("price") > 100_000, status=F.lit("big"), price=F.col("price") / 2).select("id", "status", "price")


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey = 3 THEN 'ready' ELSE o_orderpriority END AS state FROM orders")
def pipeline_state_set(spark, sf):
    b = orders(spark, sf).withColumnRenamed("note", "state")
    return ledger.rewrite(b, F.col("owner") == 3, state=F.lit("ready")).select("id", "state")


@query("""SELECT o_orderkey AS id, CASE WHEN h THEN 'needs_attention' ELSE o_orderstatus END AS status, CASE WHEN h THEN 'boom' ELSE 'e' END AS error, CASE WHEN h THEN 'budget' ELSE 'c' END AS park_code, CASE WHEN h THEN NULL ELSE epoch_us(o_orderdate) END AS retry_at
  FROM (SELECT *, o_orderkey % 4 = 1 AS h FROM orders)""")
def status_set(spark, sf):
    b = orders(spark, sf).select("id", "status", F.lit("e").alias("error"), F.lit("c").alias("park_code"), F.col("at").alias("retry_at"))
    out = ledger.set_status(b, F.col("id") % 4 == 1, "needs_attention", "boom", "budget", "2030-01-01 00:00:00")
    return out.withColumn("retry_at", F.unix_micros("retry_at"))


@query("SELECT 'books' AS t, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'runs', count(*) FROM events WHERE user_id % 3 <> 0")
def book_deleted(spark, sf):
    tables = {"books": S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "runs": S.runs(spark, sf)}
    left = ledger.delete_cascade(tables, tables["books"].where("id % 3 = 0"))
    count = lambda n: left[n].agg(F.lit(n).alias("t"), F.count(F.lit(1)).alias("n"))
    return count("books").unionByName(count("runs"))


@query("SELECT event_id AS id, user_id AS book_id, 'started' AS status FROM events WHERE event_type = 'signup'")
def run_started(spark, sf):
    runs = events(spark, sf).where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("user_id").alias("book_id"), F.lit("started").alias("status"))
    return ledger.append_new(runs.limit(0), runs, "id")[0]


@query("SELECT o.o_orderkey AS id, arg_max(l_returnflag, l_partkey * 1000 + l_linenumber) AS outcome FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1")
def runs_finished(spark, sf):
    fin = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("outcome"), (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("seq"))
    return ledger.finish_runs(orders(spark, sf).select("id"), fin)


@query("SELECT user_id AS id, sum(floor(value))::BIGINT AS tokens_in, round(sum(value), 2) AS cost_usd, bool_and(event_type <> 'error') AS estimate_complete, 'm' || (max(event_id) FILTER (WHERE event_type = 'click')) AS model FROM events GROUP BY 1")
def usage_accumulated(spark, sf):
    zero = F.lit(0).cast("long")
    u = events(spark, sf).select(F.col("user_id").alias("id"), F.floor("value").alias("tokens_in"), zero.alias("tokens_out"), zero.alias("tokens_cached"), F.col("value").alias("cost_usd"), (F.col("event_type") != "error").alias("estimate_complete"), F.when(F.col("event_type") == "click", F.concat(F.lit("m"), F.col("event_id").cast("string"))).otherwise("").alias("model"), F.col("event_id").alias("seq"))
    return ledger.accumulate_usage(u).select("id", "tokens_in", F.round("cost_usd", 2).alias("cost_usd"), "estimate_complete", "model")


@query("SELECT user_id AS id, epoch_us(max(ts)) AS heartbeat_at, epoch_us(max(ts) FILTER (WHERE event_type = 'purchase')) AS progress_at FROM events GROUP BY 1")
def runs_touched(spark, sf):
    h = events(spark, sf).select(F.col("user_id").alias("id"), "ts", (F.col("event_type") == "purchase").alias("progress"))
    return ledger.touch(h).select("id", F.unix_micros("heartbeat_at").alias("heartbeat_at"), F.unix_micros("progress_at").alias("progress_at"))


@query("SELECT user_id AS source_path, arg_max(event_type, event_id) AS work_id FROM events GROUP BY 1 HAVING arg_max(event_type = 'view', event_id) OR arg_max(event_type = 'click', event_id)")
def overrides_upserted(spark, sf):
    o = events(spark, sf).select(F.col("user_id").alias("source_path"), (F.col("event_type") == "view").alias("hidden"), (F.col("event_type") == "click").alias("force_audio"), F.lit("").alias("work_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    return ledger.meaningful_overrides(o).select("source_path", F.col("kind").alias("work_id"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def contribution_status(spark, sf):
    return ledger.latest(events(spark, sf).select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("event_id").alias("seq")), "id").select("id", "status")


@query("""WITH r AS (SELECT event_id, user_id, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events), o AS (SELECT user_id, event_type, max(event_id) AS run FROM r WHERE f IS NULL GROUP BY 1, 2)
  SELECT e.event_id AS id, run AS stage_run_id FROM events e LEFT JOIN o USING (user_id, event_type)""")
def invocations_attached(spark, sf):
    i = events(spark, sf).select(F.col("event_id").alias("invocation"), F.col("user_id").alias("book_id"), F.col("event_type").alias("stage"))
    return ledger.attach_open_run(i, S.runs(spark, sf)).select(F.col("invocation").alias("id"), "stage_run_id")


@query("SELECT event_id AS id, 'run' AS kind FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'done' FROM events WHERE event_type = 'signup'")
def supervisor_runs(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    runs = ledger.append_new(e.limit(0), e.where("kind IN ('purchase', 'signup')"), "id")[0]
    return ledger.rewrite(ledger.rewrite(runs, F.col("kind") == "signup", kind=F.lit("done")), F.col("kind") == "purchase", kind=F.lit("run"))


@query("SELECT event_id, CASE WHEN user_id <> 0 THEN user_id END AS book_id FROM events")
def events_inserted(spark, sf):
    return ledger.insert_event(events(spark, sf).select("event_id", F.col("user_id").alias("book_id")))


# Detectors and plans -----------------------------------------------------------------------------


@query("SELECT doc_id AS chapter FROM labels WHERE toxic = 1")
def plan_non_accept(spark, sf):
    return qa.non_accept(S.table(spark, sf, "labels").select(F.col("doc_id").alias("chapter"), F.when(F.col("toxic") == 1, "retranscribe").otherwise("accept").alias("action"))).select("chapter")


@query("""SELECT d.doc_id AS chapter, l.doc_id IS NOT NULL AND (l.quality = 1 OR d.doc_id % 2 = 0) AS done FROM documents d LEFT JOIN labels l USING (doc_id)""")
def plan_entries_done(spark, sf):
    plan = S.table(spark, sf, "documents").select(F.col("doc_id").alias("chapter"))
    verdicts = S.table(spark, sf, "labels").select(F.col("doc_id").alias("chapter"), F.when(F.col("quality") == 1, "keep").otherwise("adopt").alias("verdict"))
    return qa.entries_done(plan, verdicts, plan.where("chapter % 2 = 0"))


@query("SELECT doc_id AS chapter, quality FROM labels SEMI JOIN documents USING (doc_id) WHERE doc_id % 5 = 0")
def findings_restricted(spark, sf):
    return qa.restrict(S.table(spark, sf, "labels").select(F.col("doc_id").alias("chapter"), "quality"), S.table(spark, sf, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").alias("chapter")))


@query("SELECT l_orderkey, round(100 * sum(l_quantity * (l_returnflag = 'R')::INT) / greatest(sum(l_quantity), 1), 4) AS percent FROM lineitem GROUP BY 1")
def shares(spark, sf):
    li = S.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)).alias("a"), F.sum("l_quantity").alias("b"))
    return li.select("l_orderkey", F.round(qa.percent(F.col("a"), F.col("b")), 4).alias("percent"))


# Windows, splices and gates ------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN greatest(value - 100, 0.01) ELSE -1 END AS seconds, CASE WHEN event_type <> 'view' THEN round(user_id / greatest(value - 100, 0.01), 6) ELSE -1 END AS rate, event_type <> 'view' AND user_id / greatest(value - 100, 0.01) > 7.5 AS impossible FROM events")
def loop_rates(spark, sf):
    e = events(spark, sf).withColumn("s", intervals.loop_seconds(F.lit(100.0), F.when(F.col("event_type") != "view", F.col("value")))).withColumn("r", intervals.claimed_rate(F.col("user_id"), F.col("s")))
    return e.select("event_id", F.col("s").alias("seconds"), F.round("r", 6).alias("rate"), intervals.impossible(F.col("r")).alias("impossible"))


@query("SELECT event_id, CASE WHEN value BETWEEN 70 AND 300 AND user_id NOT BETWEEN 70 AND 300 THEN 'adopt' WHEN value BETWEEN 70 AND 300 THEN 'prefer_longer' WHEN user_id BETWEEN 70 AND 300 THEN 'keep' ELSE 'review' END AS decision, value BETWEEN 70 AND 300 AS plausible FROM events")
def texts_adopted(spark, sf):
    return events(spark, sf).select("event_id", intervals.adopt(F.col("user_id"), F.col("value")).alias("decision"), intervals.plausible(F.col("value")).alias("plausible"))


_SEG = "seg AS (SELECT conv_id, turn AS pos, (turn * 10)::DOUBLE AS s, (turn * 10 + 8)::DOUBLE AS e, text FROM conversations)"


def seg(spark, sf):
    return S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"), "text")


def points(spark, sf):
    return seg(spark, sf).select("conv_id").distinct().withColumn("point", (F.col("conv_id") % 4) * 7.0 + 3)


_POINTS = "points AS (SELECT DISTINCT conv_id, (conv_id % 4) * 7.0 + 3 AS point FROM conversations)"


@query(f"""WITH {_SEG}, w AS (SELECT DISTINCT conv_id, (conv_id % 3) * 5.0 + 9 AS a, (conv_id % 3) * 5.0 + 15 AS b FROM conversations)
  SELECT conv_id, coalesce(max(e) FILTER (WHERE e <= a), 0) AS "left", coalesce(min(s) FILTER (WHERE s >= b), any_value(b))::DOUBLE AS "right" FROM w JOIN seg USING (conv_id) GROUP BY 1""")
def windows_snapped(spark, sf):
    w = seg(spark, sf).select("conv_id").distinct().select("conv_id", ((F.col("conv_id") % 3) * 5.0 + 9).alias("start"), ((F.col("conv_id") % 3) * 5.0 + 15).alias("end"))
    return intervals.snap_window(w, seg(spark, sf), "conv_id").select("conv_id", "left", "right")


@query(f"""WITH {_SEG}, {_POINTS}, t AS (SELECT conv_id, coalesce(min(s) FILTER (WHERE s < point AND e > point), max(e) FILTER (WHERE e <= point), 0) AS a FROM points JOIN seg USING (conv_id) GROUP BY 1)
  SELECT conv_id, a AS at, greatest(a - 30, 0) AS "from" FROM t""")
def tails_started(spark, sf):
    return intervals.tail_start(seg(spark, sf), points(spark, sf), "conv_id")


@query(f"WITH {_SEG}, {_POINTS} SELECT conv_id, md5(string_agg(text, ' ' ORDER BY pos)) AS digest FROM seg JOIN points USING (conv_id) WHERE e > point GROUP BY 1")
def texts_after(spark, sf):
    return intervals.text_after(seg(spark, sf), points(spark, sf), "conv_id").select("conv_id", F.md5("text").alias("digest"))


@query(f"""WITH {_SEG}, {_POINTS} SELECT conv_id, md5(trim(regexp_replace(concat_ws(' ', string_agg(text, ' ' ORDER BY pos) FILTER (WHERE e <= point), 'the new end'), '\\s+', ' ', 'g'))) AS digest, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS before FROM seg JOIN points USING (conv_id) GROUP BY 1""")
def tails_spliced(spark, sf):
    out = intervals.splice_tail(seg(spark, sf), points(spark, sf).withColumn("text", F.lit("the new end")), "conv_id")
    return out.select("conv_id", F.md5("text").alias("digest"), F.col("before").cast("long").alias("before"))


@query(f"""WITH {_SEG}, w AS (SELECT DISTINCT conv_id, (conv_id % 3) * 5.0 + 9 AS a, (conv_id % 3) * 5.0 + 15 AS b FROM conversations),
  c AS (SELECT conv_id, coalesce(max(e) FILTER (WHERE e <= a), 0) AS l, coalesce(min(s) FILTER (WHERE s >= b), any_value(b)) AS r FROM w JOIN seg USING (conv_id) GROUP BY 1)
  SELECT conv_id, md5(trim(regexp_replace(coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE e <= l), '') || ' mid ' || coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE s >= r), ''), '\\s+', ' ', 'g'))) AS digest FROM seg JOIN c USING (conv_id) GROUP BY 1""")
def windows_spliced(spark, sf):
    w = seg(spark, sf).select("conv_id").distinct().select("conv_id", ((F.col("conv_id") % 3) * 5.0 + 9).alias("start"), ((F.col("conv_id") % 3) * 5.0 + 15).alias("end"), F.lit("mid").alias("text"))
    return intervals.splice_window(seg(spark, sf), w, "conv_id").select("conv_id", F.md5("text").alias("digest"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+'), lambda x: x <> '') AS t FROM conversations),
  g AS (SELECT conv_id, turn, array_to_string(t[i:i + 5], ' ') AS g FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) - 4)) AS i FROM t)),
  d AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, g FROM g GROUP BY ALL HAVING count(*) > 1)),
  s AS (SELECT DISTINCT conv_id, turn FROM (SELECT conv_id, turn, t, unnest(range(1, 6)) AS p FROM t) WHERE len(t) >= 3 * p AND t[len(t) - p + 1:] = t[len(t) - 2 * p + 1:len(t) - p] AND t[len(t) - p + 1:] = t[len(t) - 3 * p + 1:len(t) - 2 * p])
  SELECT conv_id, turn, NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = t.conv_id AND d.turn = t.turn) AND NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND s.turn = t.turn) AS healthy FROM t""")
def clips_checked(spark, sf):
    return intervals.clip_healthy(S.table(spark, sf, "conversations")).select("conv_id", "turn", "healthy")


_WIN = "w AS (SELECT event_id, user_id, floor(value) AS s, floor(value) + 20 AS e, event_type FROM events)"


def wins(spark, sf):
    return events(spark, sf).select("event_id", F.col("user_id").alias("chapter"), F.floor("value").cast("double").alias("start"), (F.floor("value") + 20).cast("double").alias("end"), "event_type")


@query(f"WITH {_WIN} SELECT event_id FROM w a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM w b WHERE b.event_type = 'error' AND a.user_id = b.user_id AND abs(a.s - b.s) <= 1 AND abs(a.e - b.e) <= 1)")
def windows_known_failed(spark, sf):
    w = wins(spark, sf)
    return intervals.known_failed(w.where("event_type = 'view'"), w.where("event_type = 'error'"), "chapter").select("event_id")


@query(f"WITH {_WIN} SELECT event_id FROM w a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM w b WHERE b.event_type = 'error' AND a.user_id = b.user_id AND a.s >= b.s - 1 AND a.e <= b.e + 6)")
def spans_not_excluded(spark, sf):
    w = wins(spark, sf)
    return intervals.not_excluded(w.where("event_type = 'view'"), w.where("event_type = 'error'").withColumn("end", F.col("end") + 5), "chapter").select("event_id")


@query(f"WITH {_WIN} SELECT event_id, s >= 35 AND e <= 215 AS covered FROM w")
def spans_covered(spark, sf):
    return wins(spark, sf).select("event_id", intervals.covered(F.col("start"), F.col("end"), F.lit(50.0), F.lit(200.0)).alias("covered"))


@query("SELECT DISTINCT user_id AS chapter FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 50)")
def tails_only(spark, sf):
    e = events(spark, sf).withColumnRenamed("user_id", "chapter")
    return intervals.only_tails(e.where("event_type = 'view'"), e.where("event_type = 'signup' AND value > 50"))


@query("SELECT c_custkey AS chapter FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error') AND c_custkey IN (SELECT user_id FROM events WHERE value > 300)")
def repairs_accepted(spark, sf):
    e = events(spark, sf).withColumnRenamed("user_id", "chapter")
    return intervals.auto_accepted(S.table(spark, sf, "customer").select(F.col("c_custkey").alias("chapter")), e.where("event_type = 'error'"), e.where("value > 300"))


@query("SELECT doc_id AS chapter, p AS phrase FROM documents, (VALUES ('the  and'), ('of the'), ('que la')) v(p) WHERE doc_id % 2 = 0 AND NOT contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), regexp_replace(p, '\\s+', ' ', 'g'))")
def phrases_resolved(spark, sf):
    d = S.chapters(spark, sf).where("chapter % 2 = 0").select("chapter", "text")
    phrases = d.select("chapter", F.explode(F.array(F.lit("the  and"), F.lit("of the"), F.lit("que la"))).alias("phrase"))
    return intervals.resolved(phrases, d)


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '''s ' || p_brand), '[^a-z0-9'' ]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM part")
def tails_normalised(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", T.normalise_tail(F.concat("p_name", F.lit("’s "), "p_brand")).alias("norm"))


@query("SELECT event_id, printf('%.1f', value)::DOUBLE AS rounded FROM events")
def halves_even(spark, sf):
    return intervals.half_even(events(spark, sf).select("event_id", F.col("value").alias("rounded")), "rounded", 1)


@query("SELECT event_id, CASE WHEN contains(value::VARCHAR, '.') THEN value::VARCHAR ELSE value::VARCHAR || '.0' END AS text FROM events")
def floats_as_text(spark, sf):
    return events(spark, sf).select("event_id", intervals.float_text(F.col("value")).alias("text"))


# Numbering ---------------------------------------------------------------------------------------

_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def labels(spark, sf):
    """Nations as markers: label by place in five styles."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    words = F.element_at(F.array(*map(F.lit, _WORDS)), (k % 11 + 1).cast("int"))
    label = F.when(k % 5 == 0, F.concat(F.lit("Chapter "), k.cast("string"), F.lit(": "), n)).when(k % 5 == 1, F.concat(k.cast("string"), F.lit(". "), n)).when(k % 5 == 2, F.concat(F.lit("Chapter "), words)).when(k % 5 == 3, k.cast("string")).otherwise(n)
    return S.table(spark, sf, "nation").select(F.col("n_regionkey").alias("book"), k.alias("idx"), label.alias("title"), (k * 100.0).alias("start"), (k * 100.0 + 90).alias("end"))


_LABELS = f"""mk AS (SELECT n_regionkey AS book, n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'Chapter ' || n_nationkey || ': ' || n_name WHEN 1 THEN n_nationkey || '. ' || n_name WHEN 2 THEN 'Chapter ' || {_WORDS}[n_nationkey % 11 + 1] WHEN 3 THEN n_nationkey::VARCHAR ELSE n_name END AS title,
  CASE n_nationkey % 5 WHEN 2 THEN n_nationkey % 11 WHEN 4 THEN NULL ELSE n_nationkey END AS n FROM nation)"""


@query(f"WITH {_LABELS} SELECT k AS idx, n AS number FROM mk")
def markers_numbered(spark, sf):
    return labels(spark, sf).select("idx", T.label_number(F.col("title")).alias("number"))


@query(f"WITH {_LABELS} SELECT k AS idx, trim(regexp_extract(title, '^(.*?)(?:[:—–]| - |\\. |$)', 1)) AS head, trim(regexp_extract(title, '^.*?(?:[:—–]| - |\\. )(.*)$', 1)) AS rest FROM mk")
def titles_split(spark, sf):
    t = T.split_title(F.col("title"))
    return labels(spark, sf).select("idx", t["head"].alias("head"), t["title"].alias("rest"))


@query(f"WITH {_LABELS} SELECT book, n AS chapter, trim(regexp_extract(title, '^.*?(?:[:—–]| - |\\. )(.*)$', 1)) AS title, k * 100.0::DOUBLE AS start, 90.0::DOUBLE AS duration FROM mk WHERE n IS NOT NULL")
def markers_manifest(spark, sf):
    return numbering.manifest(labels(spark, sf), "book").select("book", "chapter", "title", "start", "duration")


_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
_TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]


def spelled(n):
    """A number below 1000 in words, as the text functions read them."""
    ten, unit, at = F.floor(n / 10) % 10, n % 10, lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    below = F.when(ten == 1, at(_TEENS, unit)).when((ten > 1) & (unit == 0), at(_TENS, ten)).when(ten > 1, F.concat(at(_TENS, ten), F.lit("-"), at(_WORDS, unit))).otherwise(at(_WORDS, unit))
    hundreds = F.floor(n / 100)
    return F.when(hundreds == 0, below).when(n % 100 == 0, F.concat(at(_WORDS, hundreds), F.lit(" hundred"))).otherwise(F.concat(at(_WORDS, hundreds), F.lit(" hundred and "), below))


@query("SELECT p_partkey, p_partkey % 1000 AS number, CASE WHEN p_partkey % 1000 <= 100 OR p_partkey % 100 < 21 OR p_partkey % 10 = 0 THEN p_partkey % 1000 END AS spoken FROM part")
def numbers_spelled(spark, sf):
    """Numbers in words and back; a chapter is announced in four words at most."""
    p = S.table(spark, sf, "part").select("p_partkey", spelled(F.col("p_partkey") % 1000).alias("w"))
    spoken = T.spoken_chapter(F.concat(F.lit("Chapter "), F.regexp_replace("w", "-", " "), F.lit(". And so on.")))
    return p.select("p_partkey", T.number_words(F.col("w")).alias("number"), spoken.alias("spoken"))


@query("""WITH m AS (SELECT l_orderkey AS book, l_shipdate AS s, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS r FROM lineitem),
  p AS (SELECT book, r, r * 100.0 + (l_partkey % 3) * 20 AS a, r * 100.0 + 60 AS b FROM m), g AS (SELECT *, coalesce(a - lag(b) OVER (PARTITION BY book ORDER BY a), 0) AS gap FROM p)
  SELECT book, r AS chapter, a AS start FROM g QUALIFY max(gap) OVER (PARTITION BY book) < 60""")
def markers_positional(spark, sf):
    from pyspark.sql.window import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey"))
    m = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), "l_partkey", r.alias("r"))
    m = m.select("book", (F.col("r") * 100.0 + (F.col("l_partkey") % 3) * 20).alias("start"), (F.col("r") * 100.0 + 60).alias("end"))
    return numbering.positional(m, "book").select("book", "chapter", "start")


def talk(spark, sf):
    """Turns as sections: users' are labelled, assistants' numbered."""
    return S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "user", F.concat(F.lit("Part "), F.col("turn").cast("string"))).otherwise("").alias("label"), F.when(F.col("role") == "assistant", F.col("turn")).alias("number"), (F.col("turn") / 3).cast("int").alias("spine"), F.size(T.tokens(F.col("text"))).alias("words"))


_TALK = "c AS (SELECT conv_id, turn AS idx, role, CASE WHEN role = 'user' THEN 'Part ' || turn ELSE '' END AS label, CASE WHEN role = 'assistant' THEN turn END AS number, turn // 3 AS spine FROM conversations)"


@query(f"""WITH {_TALK}, o AS (SELECT conv_id, min(idx) FILTER (WHERE number IS NOT NULL) AS first, max(idx) FILTER (WHERE number IS NOT NULL) AS last, arg_max(spine, idx) FILTER (WHERE number IS NOT NULL) AS sp FROM c GROUP BY 1),
  a AS (SELECT c.conv_id, idx, last, sum((spine <> sp OR label <> '')::INT) OVER (PARTITION BY c.conv_id ORDER BY idx) AS b FROM c JOIN o USING (conv_id) WHERE idx > last)
  SELECT o.conv_id, first, coalesce((SELECT max(idx) FROM a WHERE a.conv_id = o.conv_id AND b = 0), last) AS last FROM o""")
def story_spans(spark, sf):
    return numbering.story_span(talk(spark, sf), "conv_id")


@query(f"WITH {_TALK} SELECT conv_id, min(idx) FILTER (WHERE label NOT IN ('Part 0', 'Part 2')) AS first, max(idx) FILTER (WHERE label NOT IN ('Part 0', 'Part 2')) AS last FROM c GROUP BY 1")
def titled_spans(spark, sf):
    return numbering.titled_span(talk(spark, sf), "conv_id", numbering.apparatus(F.col("label"), ["part 0"], ["rt 2"]))


@query("SELECT p_partkey, p_name = 'small ring' OR contains(p_name, 'ax') OR contains(p_name, 'red') AS apparatus FROM part")
def labels_apparatus(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", numbering.apparatus(F.upper("p_name"), ["small ring"], ["ax", "red"]).alias("apparatus"))


@query("SELECT p_partkey, contains(p_name, 'blue') OR (p_size * 100 >= 2000 AND p_type <> 'PROMO') AS excerpt FROM part")
def labels_excerpt(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", numbering.excerpt(F.col("p_name"), F.col("p_size") * 100, ["blue"], F.col("p_type") == "PROMO").alias("excerpt"))


@query(f"""WITH {_TALK}, o AS (SELECT conv_id, min(idx) FILTER (WHERE label <> '') AS first, max(idx) FILTER (WHERE label <> '') AS last FROM c GROUP BY 1)
  SELECT c.conv_id, idx, CASE WHEN idx < first THEN 'front' WHEN idx > last THEN 'back' ELSE 'story' END AS place FROM c JOIN o USING (conv_id)""")
def sections_quarantined(spark, sf):
    own = talk(spark, sf)
    return numbering.quarantine(own, numbering.titled_span(own, "conv_id", F.col("label") == ""), "conv_id").select("conv_id", "idx", "place")


@query(f"WITH {_TALK} SELECT conv_id, idx, CASE WHEN bool_or(coalesce(number = 1, false)) OVER (PARTITION BY conv_id) THEN number ELSE number - 1 END AS number FROM c")
def numbers_shifted(spark, sf):
    return numbering.shift_zero(talk(spark, sf).withColumn("number", F.col("number") - 1), "conv_id").select("conv_id", "idx", "number")


@query("SELECT l_orderkey AS book, l_partkey AS file, CASE WHEN l_linenumber < 4 THEN l_linenumber * 10 ELSE l_linenumber END AS chapter FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)")
def maps_applied(spark, sf):
    own = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("file"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("chapter")).distinct()
    chosen = own.where("chapter < 4").select("book", "file", (F.col("chapter") * 10).alias("chapter"))
    return numbering.apply_map(own, chosen, "book").select("book", F.col("part").alias("file"), "chapter")


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def maps_contiguous(spark, sf):
    return numbering.contiguous_from_one(S.table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn AS idx, CASE WHEN role = 'assistant' THEN turn * 2 ELSE turn + s END AS chapter FROM conversations JOIN (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 1 END AS s FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id)")
def positions_found(spark, sf):
    own = talk(spark, sf)
    shifts = own.select("conv_id").distinct().withColumn("shift", F.when(F.col("conv_id") % 2 == 0, 1))
    return numbering.position_of(own.select("conv_id", "idx"), own.where("number IS NOT NULL").select("conv_id", "idx", (F.col("number") * 2).alias("chapter")), shifts, "conv_id")


# Text and names ----------------------------------------------------------------------------------


@query("SELECT doc_id AS chapter, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '.', '')))::INT AS dots FROM documents")
def matches_counted(spark, sf):
    fired = spelling.apply_rules(S.chapters(spark, sf), [{"pattern": "[.]", "replacement": "."}])
    return fired.select("chapter", F.element_at("fired", 1).alias("dots"))


@query("SELECT 'the ([a-z]+ing)' AS pattern, sum(len(regexp_extract_all(text, 'the [a-z]+ing')))::BIGINT AS count FROM documents UNION ALL SELECT 'zzqx+', 0")
def rules_totalled(spark, sf):
    rules = [{"pattern": "the ([a-z]+ing)", "replacement": "the $1"}, {"pattern": "zzqx+", "replacement": "z"}, {"pattern": "zzqx+", "replacement": "y"}]
    return spelling.rule_totals(spelling.apply_rules(S.chapters(spark, sf), rules), rules)


@query("SELECT i, problem FROM (VALUES (0, 'empty pattern'), (1, 'reference in replacement')) v(i, problem)")
def rules_checked(spark, sf):
    found = spelling.check_rules([{"pattern": "", "replacement": "x"}, {"pattern": "a(b)", "replacement": "c $1"}, {"pattern": "a(b)", "replacement": "$1 c"}])
    return spark.createDataFrame([(int(x.split()[1].rstrip(":")), x.split(": ")[1]) for x in found], "i int, problem string")


@query(r"SELECT doc_id AS chapter, len(regexp_extract_all(' ' || regexp_replace(text, '([^A-Za-z])', '\1\1', 'g') || ' ', '[^A-Za-z]the[^A-Za-z]')) AS uses FROM documents")
def forms_bounded(spark, sf):
    return S.chapters(spark, sf).select("chapter", T.occurrences(F.col("text"), "the").alias("uses"))


@query("SELECT p_partkey, replace(p_name, ' ', '''s ') || '''s' AS folded, lower(p_name) AS form FROM part")
def apostrophes_folded(spark, sf):
    own = F.concat(F.regexp_replace("p_name", " ", "’s "), F.lit("’s"))
    return S.table(spark, sf, "part").select("p_partkey", T.fold_apostrophe(own).alias("folded"), T.fold_form(F.concat(F.lit("  "), F.upper(F.regexp_replace("p_name", " ", "   ")))).alias("form"))


@query(r"""WITH t AS (SELECT string_agg(text, chr(10)) AS t FROM documents), r(p, b) AS (VALUES ('the ([a-z]+ing)', 'a'), ('zzqx+', 'qqzz')),
  c AS (SELECT p, b, (SELECT sum(len(regexp_extract_all(text, p))) FROM documents) AS l, (SELECT count(*) FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z])' || b || '($|[^A-Za-z])')) AS u, (SELECT count(*) FROM benchmark WHERE regexp_matches(text, '(^|[^A-Za-z])' || b || '($|[^A-Za-z])')) AS a FROM r)
  SELECT p AS pattern, 'left_remains' AS problem FROM c WHERE l > 0 UNION ALL SELECT p, 'right_missing' FROM c WHERE u = 0 UNION ALL SELECT p, 'right_unattested' FROM c WHERE a = 0""")
def rule_gates(spark, sf):
    rules = [{"pattern": "the ([a-z]+ing)", "replacement": "a's"}, {"pattern": "zzqx+", "replacement": "$1 qqzz"}]
    return spelling.gates(S.chapters(spark, sf), S.table(spark, sf, "benchmark"), rules)


@query("SELECT p_partkey, p_name AS base FROM part")
def bases_derived(spark, sf):
    own = F.concat(F.lit("$1 "), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "'s").otherwise(""))
    return S.table(spark, sf, "part").select("p_partkey", spelling.derive_base(own).alias("base"))


def heard(spark, sf):
    """Part names with the first size they come in as the chapter where they are heard."""
    return S.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.min(F.col("p_partkey") % 20).alias("first"))


_HEARD = "heard AS (SELECT p_name AS name, min(p_partkey % 20) AS first FROM part GROUP BY 1)"
_CLAIMS = "claims AS (SELECT p_name || CASE WHEN min(p_partkey) % 6 = 5 THEN ' x' ELSE '' END AS name, CASE WHEN min(p_partkey) % 4 <> 0 THEN min(p_size) END AS claimed FROM part GROUP BY p_name)"


@query(f"WITH {_HEARD}, {_CLAIMS} SELECT c.name, claimed, first, CASE WHEN claimed IS NULL THEN 'unknown' WHEN first IS NULL THEN 'unheard' WHEN claimed < first THEN 'early' WHEN claimed > first THEN 'late' ELSE 'ok' END AS verdict FROM claims c LEFT JOIN heard USING (name)")
def first_uses_checked(spark, sf):
    p = S.table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_size").alias("s"))
    claims = p.select(F.concat("p_name", F.when(F.col("k") % 6 == 5, " x").otherwise("")).alias("name"), F.when(F.col("k") % 4 != 0, F.col("s")).alias("claimed"))
    return spelling.first_use_claims(claims, heard(spark, sf))


_ENDS = "ends(\"end\") AS (VALUES (2), (5), (9))"


def ends(spark):
    return spark.createDataFrame([(2,), (5,), (9,)], "end int")


@query(f"WITH {_HEARD}, {_ENDS} SELECT \"end\", name FROM heard, ends WHERE first <= \"end\" OR first = 0")
def sheets_rendered(spark, sf):
    return spelling.sheet_rows(heard(spark, sf).select("name"), ends(spark), heard(spark, sf))


_NOTES = "ledger AS (SELECT p_name AS name, 'kin of ' || arg_max(p_type, p_partkey) || ' and ' || lag(p_name, 1, 'none') OVER (ORDER BY p_name) AS note, min(p_partkey) % 3 = 0 AS carryover FROM part GROUP BY p_name)"


def notes(spark, sf):
    from pyspark.sql.window import Window

    p = S.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.max_by("p_type", "p_partkey").alias("t"), F.min("p_partkey").alias("k"))
    note = F.concat(F.lit("kin of "), F.col("t"), F.lit(" and "), F.lag("name", 1, "none").over(Window.orderBy("name")))  # some dozens of names
    return p.select("name", note.alias("note"), (F.col("k") % 3 == 0).alias("carryover"))


_GATE2 = 'SELECT l.name, o.name AS other, min(e."end") AS "end" FROM ledger l JOIN heard h ON h.name = l.name JOIN heard o ON o.name <> l.name AND contains(l.note, o.name) AND o.first > 0 JOIN ends e ON h.first <= e."end" AND o.first > e."end" GROUP BY 1, 2'


@query(f"WITH {_HEARD}, {_NOTES}, {_ENDS} {_GATE2}")
def sheet_gates(spark, sf):
    return spelling.sheet_gates(notes(spark, sf), ends(spark), heard(spark, sf))


@query(f"WITH {_NOTES} SELECT name FROM ledger WHERE carryover AND name NOT IN (SELECT p_name FROM part WHERE p_type = 'PROMO')")
def carryovers_gated(spark, sf):
    prior = S.table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_name").alias("canonical"))
    return spelling.carryover_gate(notes(spark, sf), prior).select("name")


def preamble(spark, sf):
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("On the "), F.col("p_name"), F.lit(" of old")).alias("line"))


_PREAMBLE = "preamble AS (SELECT p_partkey AS pos, 'On the ' || p_name || ' of old' AS line FROM part)"


@query(f"WITH {_HEARD}, {_PREAMBLE} SELECT line, name FROM preamble JOIN heard ON contains(line, name) WHERE first > 2")
def preambles_gated(spark, sf):
    return spelling.preamble_leaks(preamble(spark, sf), heard(spark, sf), 2)


@query(f"""WITH {_HEARD}, {_NOTES}, {_ENDS}, {_PREAMBLE} SELECT 'note' AS gate, name, other FROM ({_GATE2}) UNION ALL SELECT 'carryover', name, '' FROM ledger WHERE carryover AND name NOT IN (SELECT p_name FROM part WHERE p_type = 'PROMO')
  UNION ALL SELECT 'preamble', name, line FROM preamble JOIN heard ON contains(line, name) WHERE first > 2""")
def sheets_audited(spark, sf):
    prior = S.table(spark, sf, "part").where("p_type = 'PROMO'").select(F.col("p_name").alias("canonical"))
    return spelling.sheet_audit(notes(spark, sf), ends(spark), heard(spark, sf), prior, preamble(spark, sf))


@query("SELECT form, shaped FROM (VALUES ('Anna', true), ('anna', false), ('d''Aston', true), ('He''d', false), ('The''x', true), ('Éva', true)) v(form, shaped)")
def shapes_proper(spark, sf):
    forms = spark.createDataFrame([("Anna",), ("anna",), ("d'Aston",), ("He'd",), ("The'x",), ("Éva",)], "form string")
    return forms.select("form", spelling.proper_shape(F.col("form"), ["he"]).alias("shaped"))


@query("SELECT name, ok FROM (VALUES ('Anna of Green', true), ('Ann', false), ('Anna green', false), ('anna Green', false), ('Anna', true)) v(name, ok)")
def glossary_names(spark, sf):
    names = spark.createDataFrame([("Anna of Green",), ("Ann",), ("Anna green",), ("anna Green",), ("Anna",)], "name string")
    return names.select("name", spelling.glossary_name(F.col("name")).alias("ok"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'rate_limit' WHEN 'click' THEN 'auth' ELSE 'unknown' END AS class FROM events")
def errors_classed(spark, sf):
    message = F.when(F.col("event_type") == "error", "Request TIMED OUT").when(F.col("event_type") == "view", "HTTP 429: timeout").when(F.col("event_type") == "click", "Unauthorized").otherwise("fine")
    return events(spark, sf).select("event_id", spelling.error_class(message).alias("class"))


@query("SELECT event_id, epoch_us(CASE WHEN user_id % 2 = 0 THEN date_trunc('day', ts) + INTERVAL 15 HOURS + INTERVAL 30 MINUTES + CASE WHEN date_trunc('day', ts) + INTERVAL 15 HOURS + INTERVAL 30 MINUTES <= ts THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END ELSE to_timestamp(floor(epoch(ts)) + 3600)::TIMESTAMP END) AS until FROM events")
def limits_reset(spark, sf):
    e = events(spark, sf)
    message = F.when(F.col("user_id") % 2 == 0, "limit hit, resets 3:30pm").otherwise(F.concat(F.lit("limit|"), (F.floor(F.unix_micros("ts") / 1e6) + 3600).cast("string")))
    return e.select("event_id", F.unix_micros(spelling.reset_time(message, F.col("ts"))).alias("until"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_size || '.5')::DOUBLE WHEN 1 THEN NULL ELSE p_size::DOUBLE END AS sequence, CASE p_partkey % 3 WHEN 0 THEN (p_size || '.5')::DOUBLE ELSE p_size::DOUBLE END AS position FROM part")
def sequences_parsed(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(size, F.lit(".5"))).when(k % 3 == 1, F.concat(size, F.lit("-"), size)).otherwise(F.concat(F.lit(" "), size))
    return S.table(spark, sf, "part").select("p_partkey", T.sequence_number(text).alias("sequence"), T.leading_number(text, 1e18).alias("position"))


@query("SELECT doc_id AS chapter, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM documents")
def words_counted(spark, sf):
    return S.chapters(spark, sf).select("chapter", F.size(T.tokens(F.col("text"))).alias("words"))


# Identity ----------------------------------------------------------------------------------------


@query("SELECT p_partkey AS path, 'w' || p_size AS work_id, CASE WHEN p_size % 2 = 0 THEN 'matched' ELSE 'not_found' END AS status FROM part WHERE p_partkey % 10 = 0")
def manual_matches(spark, sf):
    p = S.table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_partkey").alias("source_path"), "p_size")
    overrides = p.where("path % 10 = 0").select("source_path", F.concat(F.lit("w"), F.col("p_size").cast("string")).alias("work_id"))
    works = p.where("p_size % 2 = 0").select(F.concat(F.lit("w"), F.col("p_size").cast("string")).alias("work_id")).distinct()
    return identity.manual(p.select("path", "source_path"), overrides, works)


@query("SELECT n_regionkey AS work_id, string_agg(DISTINCT lower(n_name), ',' ORDER BY lower(n_name)) AS names FROM nation GROUP BY 1")
def works_detailed(spark, sf):
    c = S.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("work_id")).agg(F.collect_list(F.struct(F.concat(F.lit(" "), F.upper("n_name")).alias("name"), F.array(F.lower("n_name")).alias("aliases"))).alias("characters"), F.count(F.lit(1)).alias("recordings"))
    return identity.work_details(c).select("work_id", F.array_join("names", ",").alias("names"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN p_type ELSE p_name END AS title FROM part")
def metadata_preferred(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", identity.prefer_known(F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("  "), F.col("p_name")).alias("title"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN 'tag' END AS title, 'scan' AS author, NULL::VARCHAR AS year FROM part")
def provenance_mapped(spark, sf):
    m = identity.provenance({"title": F.when(F.col("p_size") > 20, "tag"), "author": F.lit("scan"), "year": F.lit(None).cast("string")})
    return S.table(spark, sf, "part").select("p_partkey", m.alias("m")).select("p_partkey", *[F.col("m")[k].alias(k) for k in ("title", "author", "year")])


@query("""WITH e AS (SELECT s_nationkey AS dir, s_suppkey AS path, s_acctbal > 5000 AS ok FROM supplier), c AS (SELECT dir, min(path) FILTER (WHERE ok) AS p FROM e GROUP BY 1 HAVING count(*) FILTER (WHERE ok) = 1)
  SELECT path FROM e WHERE path NOT IN (SELECT p FROM c JOIN nation ON n_nationkey = dir)""")
def epubs_unclaimed(spark, sf):
    books = S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("dir"))
    epubs = S.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dir"), F.col("s_suppkey").alias("path"), (F.col("s_acctbal") > 5000).alias("readable"))
    return identity.unclaimed(epubs, identity.pair_epubs(books, epubs)).select("path")


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS path, l_partkey AS r, l_linenumber AS n, l_quantity AS q FROM lineitem), s AS (SELECT *, 10 * (n = 1)::INT + CASE WHEN abs(q - 25) <= 0.05 * 25 THEN 5 ELSE 0 END AS s FROM c),
  t AS (SELECT *, count(*) OVER (PARTITION BY path) AS k, max(s) OVER (PARTITION BY path) AS top FROM s)
  SELECT path, min(r) AS recording_id FROM t WHERE k = 1 OR (s = top AND s > 0) GROUP BY 1 HAVING count(*) = 1""")
def recordings_chosen(spark, sf):
    c = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("recording_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("runtime")).distinct()
    return identity.best_recording(c.withColumn("narrators", F.array(F.col("n").cast("string"))).withColumn("own_narrators", F.array(F.lit("1"))).withColumn("own_runtime", F.lit(25.0)))


@query("SELECT c_custkey AS id, c_mktsegment AS status, n AS active, t AS cost FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) ON user_id = c_custkey LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def book_views(spark, sf):
    books = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"))
    active = S.runs(spark, sf).where("NOT ok").groupBy("book_id").agg(F.count(F.lit(1)).alias("active"))
    cost = orders(spark, sf).groupBy(F.col("owner").alias("book_id")).agg(F.round(F.sum("price"), 2).alias("cost"))
    return identity.book_view(books, active=active, cost=cost)


@query("SELECT p_partkey::VARCHAR || '/' || p_name AS path, CASE WHEN p_size > 5 THEN p_name ELSE p_name END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'asked' ELSE p_brand END AS work_id, p_partkey % 8 = 0 AS hidden FROM part")
def books_converted(spark, sf):
    p = S.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/books/"), F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_name")).alias("source_path"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(" ").alias("title"), F.col("p_brand").alias("work_id"))
    o = p.where("p_partkey % 4 = 0").select("source_path", F.lit("asked").alias("work_id"), (F.col("p_partkey") % 8 == 0).alias("hidden"), F.lit(False).alias("force_audio"))
    return identity.converted(p, o, "/books").select("path", "title", "work_id", "hidden")


# Schedules ---------------------------------------------------------------------------------------

_SERIES = "books AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS series, month(o_orderdate) AS pos, o_orderstatus AS status, o_orderpriority AS prio FROM orders), ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY pos, id) - 1 AS rank FROM books)"


def waiting(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("prio"))
    return S.books(spark, sf).join(o, "id").withColumn("state", F.when(F.col("prio") == "5-LOW", "retranscribing").otherwise("transcribing"))


@query(f"WITH {_SERIES} SELECT id, rank FROM ranked")
def asr_turns(spark, sf):
    return ranking.asr_order(waiting(spark, sf)).select("id", "rank")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '5-LOW' THEN 'again' ELSE 'first' END AS part FROM orders")
def asr_parts(spark, sf):
    again, first = ranking.asr_partition(waiting(spark, sf))
    return again.select("id", F.lit("again").alias("part")).unionByName(first.select("id", F.lit("first").alias("part")))


@query(f"WITH {_SERIES} SELECT status AS bucket, prio AS lane, id FROM books")
def queue_payloads(spark, sf):
    return ranking.queue_payload(waiting(spark, sf).select(F.col("status").alias("bucket"), F.col("id").alias("place"), F.col("prio").alias("lane"), "id"), ["O", "P", "F"]).select("bucket", "lane", "id")


@query("SELECT event_id, event_type IN ('error', 'click') OR contains(lower('Net ' || event_type), 'view') AS recoverable FROM events")
def parks_recoverable(spark, sf):
    return events(spark, sf).select("event_id", ranking.restart_recoverable(F.col("event_type"), F.concat(F.lit("Net "), F.col("event_type")), ["error", "click"], ["view"]).alias("recoverable"))


_RATES = "r(stage, rate, seed) AS (VALUES ('view', 2.5, 9.0), ('click', 0.0, 4.0), ('purchase', NULL, 7.0), ('signup', 1.25, 3.0), ('error', 30.0, 1.0))"


def rates(spark):
    return spark.createDataFrame([("view", 2.5, 9.0), ("click", 0.0, 4.0), ("purchase", None, 7.0), ("signup", 1.25, 3.0), ("error", 30.0, 1.0)], "stage string, rate double, seed double")


@query(f"WITH {_RATES} SELECT user_id AS book_id, greatest(round(sum(ceil(floor(value) / 2) * CASE WHEN rate > 0 THEN rate ELSE seed END) / 10) * 10, 0)::DOUBLE AS eta_s FROM events JOIN r ON stage = event_type GROUP BY 1")
def book_etas(spark, sf):
    paths = events(spark, sf).select(F.col("user_id").alias("book_id"), F.col("event_type").alias("stage"), F.floor("value").alias("units"))
    return ranking.book_eta(paths, rates(spark), F.lit(2))


@query("SELECT l_orderkey AS book_id, max(l_quantity) AS chapters FROM lineitem WHERE l_linenumber IN (1, 2) GROUP BY 1")
def chapters_by_progress(spark, sf):
    p = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("string").alias("stage"), F.col("l_quantity").alias("total"))
    return ranking.chapters_of(p, ["1", "2"])


@query("SELECT event_id, CASE WHEN value > 200 THEN floor(value) WHEN event_type = 'view' THEN CASE WHEN user_id > 20 THEN user_id ELSE 60 END WHEN event_type = 'click' THEN 8 WHEN event_type = 'signup' THEN round(value, 2) ELSE 1 END::DOUBLE AS units, greatest(round(floor(value) * 0.04), 1)::DOUBLE AS redo FROM events")
def units_estimated(spark, sf):
    kind = F.when(F.col("event_type") == "view", "chapter").when(F.col("event_type") == "click", "chunk").when(F.col("event_type") == "signup", "hour").otherwise("book")
    e = events(spark, sf)
    total = F.when(F.col("value") > 200, F.floor("value")).otherwise(0)
    return e.select("event_id", ranking.total_units(kind, total, F.when(F.col("user_id") > 20, F.col("user_id")), F.round("value", 2)).alias("units"), ranking.redo_units(F.floor("value").cast("double")).alias("redo"))


_STATES = "t(state, outcome, next, pos) AS (VALUES ('view', 'low', 'click', 1), ('view', 'high', 'purchase', 2), ('click', 'low', 'purchase', 1), ('signup', 'low', 'view', 1))"


def transitions(spark):
    return spark.createDataFrame([("view", "low", "click", 1), ("view", "high", "purchase", 2), ("click", "low", "purchase", 1), ("signup", "low", "view", 1)], "state string, outcome string, next string, pos int")


@query(f"WITH {_STATES} SELECT event_id, next FROM events LEFT JOIN t ON state = event_type AND outcome = CASE WHEN value > 50 THEN 'high' ELSE 'low' END")
def states_next(spark, sf):
    e = events(spark, sf).select("event_id", F.col("event_type").alias("state"), F.when(F.col("value") > 50, "high").otherwise("low").alias("outcome"))
    return ranking.next_states(e, transitions(spark).drop("pos")).select("event_id", "next")


@query(f"WITH {_STATES} SELECT state, arg_max(next, pos) AS next FROM t WHERE EXISTS (SELECT 1 FROM events WHERE event_type = state) GROUP BY 1")
def states_mainline(spark, sf):
    live = events(spark, sf).select(F.col("event_type").alias("state")).distinct()
    return ranking.mainline(transitions(spark).join(live, "state", "left_semi"))


@query("SELECT event_id, event_type = 'view' AND user_id % 2 = 0 AND value > 20 AS start FROM events")
def starts_allowed(spark, sf):
    status = F.when(F.col("event_type") == "view", "queued").otherwise("running")
    return events(spark, sf).select("event_id", ranking.can_start(status, F.col("user_id") % 2 == 0, F.floor(F.col("value") - 20) + F.when(F.col("value") > 20, 1).otherwise(0)).alias("start"))


@query("SELECT user_id AS book_id, arg_max(event_type, [len(event_type), -event_id]) AS kind FROM events GROUP BY 1")
def incidents_primary(spark, sf):
    i = events(spark, sf).select(F.col("user_id").alias("book_id"), F.col("event_type").alias("kind"), F.length("event_type").alias("priority"), F.col("event_id").alias("pos"))
    return ranking.primary_incident(i)


@query("SELECT event_id, step, stage FROM events JOIN (VALUES ('view', 'a', 1), ('view', 'b', 2), ('click', 'b', 1)) p(state, stage, step) ON state = event_type")
def paths_remaining(spark, sf):
    paths = spark.createDataFrame([("view", "a", 1), ("view", "b", 2), ("click", "b", 1)], "state string, stage string, step int")
    return ranking.remaining_path(events(spark, sf).select(F.col("event_id").alias("id"), F.col("event_type").alias("state")), paths).select(F.col("id").alias("event_id"), "step", "stage")


@query("SELECT event_type AS lane, min(value) AS finish_at FROM events GROUP BY 1")
def finishes_earliest(spark, sf):
    return ranking.earliest_finish(events(spark, sf).select(F.col("event_type").alias("lane"), F.col("value").alias("finish_at")))


@query("""WITH i AS (SELECT event_id, user_id, event_type FROM events), n AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
  SELECT event_id, CASE WHEN coalesce(n, 0) >= 12 THEN 'escalate' WHEN event_type = 'error' THEN 'retry' WHEN event_type = 'view' THEN 'wait' ELSE 'observe' END AS action FROM i LEFT JOIN n USING (user_id)""")
def incidents_decided(spark, sf):
    e = events(spark, sf)
    i = e.select(F.col("event_id").alias("kind_id"), F.col("user_id").alias("book_id"), F.col("event_type").alias("kind"))
    table = spark.createDataFrame([("error", "retry"), ("view", "wait")], "kind string, action string")
    past = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("book_id")).agg(F.count(F.lit(1)).alias("recoveries"))
    return ranking.decide(i, table, past, 12, "kind_id").select(F.col("kind_id").alias("event_id"), "action")


# Experiments and views -----------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE greatest(round(value - 100, 3), 0) END::DOUBLE AS seconds FROM events")
def spans_elapsed(spark, sf):
    e = events(spark, sf)
    start = F.lit("2024-01-01T00:01:40Z")
    ms = F.round(F.col("value") * 1000).cast("int")
    clock = F.format_string("2024-01-01T00:%02d:%02d.%03dZ", (ms / 60_000).cast("int"), (ms / 1000).cast("int") % 60, ms % 1000)
    end = F.when(F.col("event_type") == "error", "never").otherwise(clock)
    return e.select("event_id", F.round(X.elapsed(start, end), 3).alias("seconds"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '))), ',') AS words FROM part")
def words_unique(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", F.array_join(X.unique_sorted(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), ",").alias("words"))


@query("""WITH a AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS x, list_distinct(['small', lower(p_type)]) AS y FROM part), b AS (SELECT *, len(list_intersect(x, y)) AS i FROM a)
  SELECT p_partkey, len(x) AS names, i / len(y) AS recall, i / (len(x) + len(y) - i) AS jaccard, 1.0::DOUBLE AS recap_jaccard FROM b""")
def qualities(spark, sf):
    none = F.array().cast("array<int>")
    q = X.quality(F.split("p_name", " "), F.array(F.lit("small"), F.lower("p_type")), none, none)
    return S.table(spark, sf, "part").select("p_partkey", q.alias("q")).select("p_partkey", "q.*")


@query("SELECT r_name AS profile, n_nationkey AS \"case\", i AS repeat FROM region, nation, range(1, 4) t(i)")
def experiments_planned(spark, sf):
    profiles = S.table(spark, sf, "region").select(F.col("r_name").alias("profile"))
    plan = X.experiment_plan(profiles, S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("case")), 3, seed=5)
    return plan.where("place >= 1").select("profile", "case", "repeat")


@query(r"SELECT sha256(string_agg('n' || n_nationkey || chr(0) || sha256(n_name), chr(10) ORDER BY 'n' || n_nationkey)) AS digest FROM nation")
def trees_digested(spark, sf):
    return X.tree_digest(S.table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("path"), F.col("n_name").alias("content")))


@query("SELECT s_suppkey AS pos, s_name AS canonical FROM supplier WHERE s_acctbal > 0")
def ledger_verified(spark, sf):
    s = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("canonical"), F.lit("t").alias("type"), F.lit("v").alias("variants"), F.when(F.col("s_acctbal") > 0, "verified").otherwise("guess").alias("status"))
    return X.verified_rows(s).select("pos", "canonical")


@query("SELECT coalesce(s_suppkey, c_custkey) AS id, s_name AS a, c_name AS b FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON s_suppkey = c_custkey")
def sidecars_viewed(spark, sf):
    a = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("a"))
    return X.merge_views(a, S.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("b")), "id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' WHEN p_size < 10 THEN 'unmatched' WHEN p_type = 'PROMO' THEN 'covered' ELSE 'missing' END AS state FROM part")
def coverage_states(spark, sf):
    state = X.coverage_state(F.when(F.col("p_size") >= 10, F.col("p_brand")), F.col("p_type") == "PROMO", F.col("p_partkey") % 7 == 0)
    return S.table(spark, sf, "part").select("p_partkey", state.alias("state"))


@query("SELECT p_partkey FROM part WHERE p_size >= 5 AND NOT (p_type = 'PROMO' AND p_size >= 10)")
def coverage_filtered(spark, sf):
    p = S.table(spark, sf, "part").withColumn("hidden", F.col("p_size") < 5).withColumn("state", X.coverage_state(F.when(F.col("p_size") >= 10, F.col("p_brand")), F.col("p_type") == "PROMO", F.lit(False)))
    return X.coverage_filter(p, exclude_covered=True).select("p_partkey")


@query("SELECT p_partkey FROM part")
def series_sorted(spark, sf):
    p = S.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_type") != "PROMO", F.col("p_brand")).otherwise("").alias("series"), F.col("p_size").alias("pos"), F.col("p_name").alias("title"), F.col("p_partkey").alias("path"))
    return X.series_sort(p).select("p_partkey")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'")
def books_done(spark, sf):
    return X.done_books(orders(spark, sf).select("id", F.when(F.col("status") == "F", "done").otherwise("open").alias("status"), F.col("at").alias("finished_at"))).select("id")


@query("SELECT o_orderstatus AS section, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def books_sectioned(spark, sf):
    s = X.sections(orders(spark, sf).select("id", F.col("status").alias("section")), ["P", "O"])
    return s.select("section", F.size("ids").alias("n"), F.element_at("ids", 1).alias("first"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def board_sorted(spark, sf):
    return X.board_sort(S.books(spark, sf).withColumn("pos", F.col("series_pos").cast("int")), ["P", "O", "F"]).select("id", "status")


@query("SELECT 0 AS place, NULL::INT AS chapter, 'sum' AS text UNION ALL SELECT 1, n_nationkey::INT, n_name FROM nation UNION ALL SELECT 2, NULL, 'end'")
def stories_told(spark, sf):
    one = lambda t: S.table(spark, sf, "region").limit(1).select(F.lit(t).alias("text"))
    recaps = S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("chapter"), F.col("n_name").alias("text"))
    return X.story_rows(recaps, one("sum"), one("end"))


@query("SELECT user_id AS book_id, round(sum(value), 4) AS cost FROM events GROUP BY 1")
def costs_total(spark, sf):
    return X.total_cost(S.runs(spark, sf)).withColumn("cost", F.round("cost", 4))


_CHARS = """c AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 11 = 0 THEN 'Bad Slug' WHEN p_partkey % 13 = 0 THEN 'twin' ELSE 'id-' || p_partkey END AS id, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'villain' WHEN p_partkey % 5 = 1 THEN '' ELSE 'minor' END AS role,
  CASE WHEN p_partkey % 7 = 0 THEN repeat('x', 1501) WHEN p_partkey % 7 = 1 THEN 'a — b' WHEN p_partkey % 7 = 2 THEN '' ELSE p_type END AS d, p_size - 2 AS reveal, CASE WHEN p_partkey % 19 = 0 THEN ['a', ' '] ELSE ['a'] END AS aliases, CASE WHEN p_partkey % 23 = 0 THEN 'P12' WHEN p_partkey % 23 = 1 THEN 'Q12' ELSE '' END AS wd FROM part)"""


def characters(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    d = F.when(k % 7 == 0, F.repeat(F.lit("x"), 1501)).when(k % 7 == 1, "a — b").when(k % 7 == 2, "").otherwise(F.col("p_type"))
    return S.table(spark, sf, "part").select(
        k.alias("pos"), F.when(k % 11 == 0, "Bad Slug").when(k % 13 == 0, "twin").otherwise(F.concat(F.lit("id-"), k.cast("string"))).alias("id"), F.when(k % 17 == 0, " ").otherwise(F.col("p_name")).alias("name"),
        F.when(k % 5 == 0, "villain").when(k % 5 == 1, "").otherwise("minor").alias("role"), d.alias("description"), (size - 2).alias("reveal"), F.when(k % 19 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("aliases"),
        F.when(k % 23 == 0, "P12").when(k % 23 == 1, "Q12").otherwise("").alias("wikidata"),
    )


@query(f"""WITH {_CHARS} SELECT pos, 'id_slug' AS rule FROM c WHERE id = 'Bad Slug' UNION ALL SELECT pos, 'id_repeated' FROM (SELECT pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS r FROM c WHERE id = 'twin') WHERE r > 1 UNION ALL SELECT pos, 'name_blank' FROM c WHERE trim(name) = ''
  UNION ALL SELECT pos, 'role_unknown' FROM c WHERE role = 'villain' UNION ALL SELECT pos, 'reveal_range' FROM c WHERE reveal NOT BETWEEN 0 AND 40 UNION ALL SELECT pos, 'description_blank' FROM c WHERE d = '' UNION ALL SELECT pos, 'description_long' FROM c WHERE length(d) > 1500
  UNION ALL SELECT pos, 'description_dash' FROM c WHERE contains(d, '—') UNION ALL SELECT pos, 'alias_blank' FROM c WHERE len(aliases) = 2 UNION ALL SELECT pos, 'wikidata_id' FROM c WHERE wd = 'P12'""")
def characters_validated(spark, sf):
    return X.character_problems(characters(spark, sf), 40)


_RECAPS = """r AS (SELECT n_nationkey AS pos, CASE WHEN n_nationkey % 6 = 5 THEN 3 ELSE n_nationkey END AS through, CASE n_nationkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN repeat('y', 3001) WHEN 2 THEN 'a—b' ELSE n_name END AS t, CASE n_nationkey % 3 WHEN 0 THEN 'series' WHEN 1 THEN 'world' ELSE '' END AS scope FROM nation)"""


@query(f"""WITH {_RECAPS} SELECT pos, 'through_range' AS rule FROM r WHERE through NOT BETWEEN 0 AND 20 UNION ALL SELECT pos, 'through_repeated' FROM (SELECT pos, row_number() OVER (PARTITION BY through ORDER BY pos) AS k FROM r) WHERE k > 1 UNION ALL SELECT pos, 'text_blank' FROM r WHERE trim(t) = ''
  UNION ALL SELECT pos, 'text_long' FROM r WHERE length(t) > 3000 UNION ALL SELECT pos, 'text_dash' FROM r WHERE contains(t, '—') UNION ALL SELECT pos, 'scope_unknown' FROM r WHERE scope = 'world'""")
def recaps_validated(spark, sf):
    k = F.col("n_nationkey")
    text = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.repeat(F.lit("y"), 3001)).when(k % 4 == 2, "a—b").otherwise(F.col("n_name"))
    r = S.table(spark, sf, "nation").select(k.alias("pos"), F.when(k % 6 == 5, 3).otherwise(k).alias("through"), text.alias("text"), F.when(k % 3 == 0, "series").when(k % 3 == 1, "world").otherwise("").alias("scope"))
    return X.recap_problems(r, 20)


@query("""SELECT r_regionkey AS pos, rule FROM region, (VALUES (0, 'work_slug'), (1, 'license'), (2, 'sources'), (3, 'empty'), (4, 'in_short_long'), (4, 'ending_dash'), (0, 'opener_has_series_recap'), (2, 'series_recap_missing')) v(k, rule) WHERE r_regionkey = k""")
def sidecars_validated(spark, sf):
    k = F.col("r_regionkey")
    files = S.table(spark, sf, "region").select(
        k.alias("pos"), F.when(k == 0, "Bad Work").otherwise("good-work").alias("work"), F.when(k == 1, "MIT").otherwise(X.SIDECAR_LICENSE).alias("license"), F.when(k == 2, F.array(F.lit("wiki"))).otherwise(F.array(F.lit("community"))).alias("sources"),
        F.when(k == 3, 0).otherwise(4).alias("entries"), F.when(k == 4, F.repeat(F.lit("z"), 1501)).otherwise("short").alias("in_short"), F.when(k == 4, "a—b").otherwise("").alias("ending"),
        (k == 0).alias("opener"), (k != 2).alias("series_recap"),  # region 0 opens a series and has a recap of it; region 2 opens none and has none
    )
    return X.sidecar_file_problems(files)


# Incidents ---------------------------------------------------------------------------------------

_STAGE = "CASE event_type WHEN 'view' THEN 'qa_sweep' WHEN 'click' THEN 'auditing' WHEN 'error' THEN 'asr' WHEN 'purchase' THEN 'fixing' ELSE 'inspect' END"
_MESSAGE = "CASE floor(value)::BIGINT % 4 WHEN 0 THEN 'HTTP 401' WHEN 1 THEN 'Rate Limit hit' WHEN 2 THEN 'boom ' || event_id ELSE '' END"
_WATCHED = f"""runs AS (SELECT event_id AS id, user_id AS book_id, {_STAGE} AS stage, ts AS started, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finished, event_type <> 'error' AS ok, event_id % 9 = 0 AS superseded,
    CASE WHEN event_type = 'error' THEN {_MESSAGE} ELSE '' END AS error, floor(value)::BIGINT AS tokens, CASE WHEN event_type = 'view' THEN value WHEN event_type = 'click' THEN value / 2 END AS cost, CASE WHEN event_type = 'view' THEN 'r' WHEN event_type = 'click' THEN 'e' END AS ck,
    'f' || floor(value / 100)::BIGINT AS findings, floor(value)::BIGINT % 2 AS blocker, floor(value)::BIGINT % 3 AS fix, value < 5 AS passed FROM events),
  books AS (SELECT c_custkey AS id, ['asr', 'auditing', 'qa_sweep', 'fixing', 'ready'][c_custkey % 5 + 1] AS state, CASE WHEN c_custkey % 7 = 0 THEN 'needs_attention' WHEN c_custkey % 7 = 1 THEN 'paused' ELSE 'running' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'qa_no_converge' ELSE '' END AS code FROM customer)"""


def watched(spark, sf):
    e, v = events(spark, sf), F.floor("value")
    from pyspark.sql.window import Window

    kind, is_ = F.col("event_type"), lambda t: F.col("event_type") == t
    message = F.when(v % 4 == 0, "HTTP 401").when(v % 4 == 1, "Rate Limit hit").when(v % 4 == 2, F.concat(F.lit("boom "), F.col("event_id").cast("string"))).otherwise("")
    runs = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("book_id"), F.when(is_("view"), "qa_sweep").when(is_("click"), "auditing").when(is_("error"), "asr").when(is_("purchase"), "fixing").otherwise("inspect").alias("stage"),
        F.col("ts").alias("started_at"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("finished_at"), (kind != "error").alias("ok"), (F.col("event_id") % 9 == 0).alias("superseded"), F.when(is_("error"), message).otherwise("").alias("error"),
        F.col("ts").alias("heartbeat_at"), F.col("ts").alias("progress_at"), v.alias("tokens"), F.col("value").alias("cost_usd"), is_("view").alias("cost_reported"), (F.col("value") / 2).alias("estimated_cost"), is_("click").alias("estimate_complete"),
        F.concat(F.lit("f"), F.floor(F.col("value") / 100).cast("string")).alias("findings"), (v % 2).alias("blocker"), (v % 3).alias("fix"), (F.col("value") < 5).alias("passed"),
    )
    k = F.col("c_custkey")
    books = S.table(spark, sf, "customer").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, ["asr", "auditing", "qa_sweep", "fixing", "ready"])), (k % 5 + 1).cast("int")).alias("state"), F.when(k % 7 == 0, "needs_attention").when(k % 7 == 1, "paused").otherwise("running").alias("status"),
        F.when(k % 2 == 0, "qa_no_converge").otherwise("").alias("park_code"), (k % 10 != 0).alias("runtime_active"), F.when(k % 4 == 0, k % 8 == 0).alias("process_alive"), F.lit(1).alias("agent_active"), F.when(k % 50 == 3, 2).otherwise(1).alias("agent_capacity"), F.lit(5).alias("eligible_books"),
        (k % 5 == 3).alias("fans_out"), (k % 3).alias("book_calls"), F.lit(2).alias("most_book_calls"), F.lit(3).alias("calls"), F.lit(4).alias("call_capacity"), (k % 6).alias("remaining_units"),
    )
    artifacts = S.table(spark, sf, "customer").where("c_custkey % 6 = 5").select(F.col("c_custkey").alias("book_id"), F.lit("splitting").alias("stage"), F.lit(0).cast("long").alias("run"), (F.col("c_custkey") % 12 == 5).alias("valid"))
    return books, runs, artifacts


_CLASSIFIED = """open_ AS (SELECT * FROM runs WHERE finished IS NULL QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY id) = 1),
  s AS (SELECT o.*, epoch(TIMESTAMP '2024-02-01') - epoch(started) AS age, (SELECT max(epoch(finished) - epoch(started)) FROM runs r WHERE r.book_id = o.book_id AND r.stage = o.stage AND r.ok AND finished IS NOT NULL) AS s0,
    (SELECT max(tokens) FROM runs r WHERE r.book_id = o.book_id AND r.stage = o.stage AND r.ok AND finished IS NOT NULL) AS t0, (SELECT max(cost) FROM runs r WHERE r.book_id = o.book_id AND r.stage = o.stage AND r.ok AND finished IS NOT NULL AND r.ck = o.ck) AS c0 FROM open_ o JOIN books b ON b.id = o.book_id),
  staged AS (SELECT r.* FROM runs r JOIN books b ON b.id = r.book_id AND b.state = r.stage WHERE NOT superseded), l AS (SELECT * FROM staged QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY id DESC) = 1),
  f AS (SELECT l.*, CASE WHEN l.error LIKE 'boom%' THEN 'boom' ELSE l.error END AS fp FROM l WHERE NOT ok AND error <> ''),
  rep AS (SELECT f.book_id, count(*) FILTER (WHERE s.id > coalesce((SELECT max(x.id) FROM staged x WHERE x.book_id = f.book_id AND CASE WHEN x.error LIKE 'boom%' THEN 'boom' ELSE x.error END <> f.fp), -1)) AS n FROM f JOIN staged s USING (book_id) GROUP BY 1),
  good AS (SELECT r.*, b.state FROM runs r JOIN books b ON b.id = r.book_id WHERE NOT superseded AND ok),
  q AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY id DESC) AS k, lag(findings) OVER w AS a, lag(findings, 2) OVER w AS b FROM good WHERE stage = 'qa_sweep' AND state = 'qa_sweep' WINDOW w AS (PARTITION BY book_id ORDER BY id)),
  au AS (SELECT * FROM good g WHERE stage = 'auditing' AND state IN ('auditing', 'fixing') AND NOT passed AND id > coalesce((SELECT max(id) FROM good p WHERE p.book_id = g.book_id AND p.stage = 'auditing' AND p.passed), -1)),
  ap AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY id DESC) AS k, lag(blocker) OVER w AS b0, lag(fix) OVER w AS f0 FROM au WINDOW w AS (PARTITION BY book_id ORDER BY id)),
  found AS (SELECT book_id, 'missing_process' AS kind, stage, id AS run FROM s WHERE book_id % 10 = 0 OR (book_id % 4 = 0 AND book_id % 8 <> 0)
    UNION ALL SELECT book_id, 'stale_heartbeat', stage, id FROM s WHERE age > 900 UNION ALL SELECT book_id, 'no_progress', stage, id FROM s WHERE age > 200000 UNION ALL SELECT book_id, 'duration_limit', stage, id FROM s WHERE age > 400000 OR (s0 >= 60 AND age >= 1200 AND age > s0 * 1.5)
    UNION ALL SELECT book_id, 'token_limit', stage, id FROM s WHERE tokens >= 120 OR (t0 > 0 AND tokens > t0 * 1.5) UNION ALL SELECT book_id, 'cost_limit', stage, id FROM s WHERE cost >= 90 OR (c0 > 0 AND cost > c0 * 1.5)
    UNION ALL SELECT book_id, CASE error WHEN 'HTTP 401' THEN 'authentication_failure' WHEN 'Rate Limit hit' THEN 'rate_limit' ELSE CASE WHEN n >= 2 THEN 'repeated_error' ELSE 'unclassified' END END, stage, id FROM f JOIN rep USING (book_id)
    UNION ALL SELECT book_id, 'qa_non_converging', 'qa_sweep', id FROM q WHERE k = 1 AND findings = a AND findings = b UNION ALL SELECT book_id, 'audit_non_converging', 'auditing', id FROM ap WHERE k = 1 AND blocker >= b0 AND blocker + fix >= b0 + f0
    UNION ALL SELECT b.id, 'parked_recovery', state, coalesce((SELECT max(r.id) FROM runs r WHERE r.book_id = b.id AND r.stage = state AND NOT superseded), 0) FROM books b WHERE status = 'needs_attention' AND code <> ''
    UNION ALL SELECT id, 'artifact_invalid', 'splitting', 0 FROM books WHERE id % 6 = 5 AND id % 12 <> 5
    UNION ALL SELECT id, 'slot_inefficiency', '', 0 FROM books WHERE id % 50 = 3 OR (id % 5 = 3 AND id % 10 <> 0 AND id % 3 = 1 AND id % 6 > 1)),
  incidents AS (SELECT book_id, kind, stage, run, status = 'paused' OR (kind = 'artifact_invalid' AND state = 'ready') AS protected FROM found JOIN books ON id = book_id)"""
_POLICY = {"no_progress_after": 200_000, "max_seconds": 400_000, "max_tokens": 120, "max_cost": 90.0, "growth": 1.5, "max_repeats": 2}


@query(f"WITH {_WATCHED}, {_CLASSIFIED} SELECT * FROM incidents")
def incidents_classified(spark, sf):
    return ranking.classify_incidents(*watched(spark, sf), S.now(), _POLICY)


@query(f"""WITH {_WATCHED}, {_CLASSIFIED}, d AS (SELECT *, CASE WHEN kind = 'parked_recovery' THEN 'retry' WHEN kind IN ('missing_process', 'stale_heartbeat') THEN 'terminate_requeue' WHEN kind IN ('duration_limit', 'token_limit', 'cost_limit') THEN 'stop_budget' WHEN kind = 'rate_limit' THEN 'readmit'
    WHEN kind = 'artifact_invalid' AND NOT protected THEN 'supersede_rerun' WHEN kind = 'slot_inefficiency' THEN 'reallocate' WHEN kind LIKE '%non_converging' THEN 'observe' ELSE 'park_escalate' END AS a FROM incidents),
  e AS (SELECT *, (book_id % 4 >= 2 AND a IN ('retry', 'readmit', 'terminate_requeue', 'supersede_rerun')) OR (book_id % 5 >= 2 AND a IN ('retry', 'readmit', 'supersede_rerun') AND NOT protected) AS spent FROM d),
  g AS (SELECT *, CASE WHEN spent THEN 'park_escalate' ELSE a END AS action, spent OR a = 'park_escalate' AS approval FROM e)
  SELECT book_id, kind, run, action, approval, NOT protected AND action <> 'observe' AND (NOT approval OR (action = 'park_escalate' AND kind <> 'no_progress')) AS automatic FROM g""")
def incidents_handled(spark, sf):
    books, runs, artifacts = watched(spark, sf)
    found = ranking.classify_incidents(books, runs, artifacts, S.now(), _POLICY).join(books.select(F.col("id").alias("book_id"), "park_code"), "book_id")
    asked = found.withColumn("attempts", F.col("book_id") % 4).withColumn("recoveries", F.col("book_id") % 5)
    return ranking.decisions(asked, 2).select("book_id", "kind", "run", "action", "approval", "automatic")


# Operators that were held against models only ------------------------------------------------------


SQL["narrated_numbering"] = """
WITH RECURSIVE e AS (SELECT user_id AS book, event_id AS idx, CASE WHEN event_type <> 'view' THEN (floor(value / 50) + 1)::BIGINT END AS said, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
k AS (SELECT *, CASE WHEN said = lag(said) OVER w + 1 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY book ORDER BY r)),
i AS (SELECT *, sum(new) OVER (PARTITION BY book ORDER BY r) AS island FROM k),
best AS (SELECT book, a, b, lo, hi FROM (SELECT book, min(r) AS a, max(r) AS b, min(said) AS lo, max(said) AS hi, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(r)) AS n FROM i WHERE said IS NOT NULL GROUP BY book, island HAVING count(*) >= 3) WHERE n = 1),
front(book, r, low, kept) AS (SELECT book, a, lo, lo FROM best UNION ALL SELECT f.book, f.r - 1, CASE WHEN e.said < f.low THEN e.said ELSE f.low END, CASE WHEN e.said < f.low THEN e.said END FROM front f JOIN e ON e.book = f.book AND e.r = f.r - 1),
behind(book, r, high, kept) AS (SELECT book, b, hi, hi FROM best UNION ALL SELECT f.book, f.r + 1, CASE WHEN e.said > f.high THEN e.said ELSE f.high END, CASE WHEN e.said > f.high THEN e.said END FROM behind f JOIN e ON e.book = f.book AND e.r = f.r + 1),
kept AS (SELECT e.book, e.idx, e.r, CASE WHEN e.r BETWEEN b.a AND b.b THEN e.said WHEN e.r < b.a THEN f.kept ELSE h.kept END AS c FROM e LEFT JOIN best b USING (book) LEFT JOIN front f ON f.book = e.book AND f.r = e.r LEFT JOIN behind h ON h.book = e.book AND h.r = e.r)
SELECT book, idx, first_value(c IGNORE NULLS) OVER (PARTITION BY book ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS chapter FROM kept
"""

_TAIL = r"""t AS (SELECT doc_id AS chapter, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT chapter, len(t) AS total, i - 1 AS p, array_to_string(t[i:i + 5], ' ') AS g FROM (SELECT chapter, t, unnest(range(1, len(t) - 4)) AS i FROM t)),
top AS (SELECT chapter, g AS phrase FROM (SELECT chapter, g, count(*) AS n, min(p) AS f, row_number() OVER (PARTITION BY chapter ORDER BY count(*) DESC, min(p)) AS r FROM g GROUP BY 1, 2 HAVING count(*) >= 3) WHERE r = 1),
spots AS (SELECT g.chapter, phrase, total, p, coalesce(lead(p) OVER w, total) - (p + 6) > 12 AS far FROM g JOIN top ON top.chapter = g.chapter AND phrase = g WINDOW w AS (PARTITION BY g.chapter ORDER BY p)),
run AS (SELECT *, sum(far::INT) OVER (PARTITION BY chapter ORDER BY p DESC) AS k FROM spots)"""

SQL["tail_run_located"] = f"WITH {_TAIL} SELECT chapter, phrase, min(p) AS first_pos, count(*) AS uses FROM run WHERE k = 0 GROUP BY 1, 2"


_PLAIN = "list_filter(string_split(regexp_replace(lower({t}), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '')"
_USES = "(length(fresh) - length(replace(fresh, {u}, ''))) // length({u})"
SQL["adjudicate"] = f"""WITH {_TAIL}, l AS (SELECT chapter, any_value(phrase) AS phrase, min(p) AS first FROM run WHERE k = 0 GROUP BY chapter),
a AS (SELECT chapter, {_PLAIN.format(t="array_to_string(t[first + 1:], ' ')")} AS words, {_PLAIN.format(t="phrase")}[1:3] AS short, array_to_string(list_transform({_PLAIN.format(t="array_to_string(t, ' ')")}, lambda x: '|' || x || '|'), '') AS fresh FROM l JOIN t USING (chapter)),
b AS (SELECT *, coalesce(list_min(list_filter(range(1, least(15, len(words) - 1) + 1), lambda p: len(list_filter(range(1, len(words) - p + 1), lambda i: words[i] = words[i + p])) >= 0.9 * (len(words) - p))), 0) AS period FROM a),
u AS (SELECT *, list_transform(CASE WHEN period > 0 THEN words[1:period] ELSE short END, lambda x: '|' || x || '|') AS unit FROM b),
r AS (SELECT chapter, period, fresh, unit, array_to_string(unit[1:greatest(1, (len(unit) * 6 + 9) // 10)], '') AS part, unnest(range(0, greatest(len(unit), 1))) AS i FROM u),
c AS (SELECT chapter, period, coalesce(max(CASE WHEN len(unit) > 0 THEN {_USES.format(u="array_to_string(list_concat(unit[i + 1:], unit[1:i]), '')")} END), 0) AS uses, any_value(CASE WHEN part <> '' THEN {_USES.format(u="part")} ELSE 0 END) AS parts FROM r GROUP BY 1, 2)
SELECT chapter, period::INT AS period, uses::INT AS uses, CASE WHEN uses >= 2 THEN 'real' WHEN uses = 1 THEN 'reduced' WHEN parts > 0 THEN 'fragment' ELSE 'gone' END AS verdict FROM c"""


_CAND = r"""d AS (SELECT doc_id AS k, replace(coalesce(text, ''), '’', '''') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '\p{L}+(?:[''’]\p{L}+)*') AS ws, regexp_split_to_array(t, '\p{L}+(?:[''’]\p{L}+)*') AS gs FROM d),
tok AS (SELECT k, unnest(ws) AS token, unnest(gs[1:len(ws)]) AS gap, generate_subscripts(ws, 1) - 1 AS i FROM w),
f AS (SELECT k, i, token, regexp_matches(token, '^\p{Lu}|''\p{Lu}') AS capital, i = 0 OR regexp_matches(gap, '[.!?\n]') AS initial, i > 0 AND regexp_matches(gap, '^ *$') AS joined, lower(token) NOT IN ('the', 'and', 'of') AS novel FROM tok),
each_ AS (SELECT token AS form, count(*) AS count, count(*) FILTER (WHERE NOT initial) AS non_initial, count(DISTINCT k) AS chapters, any_value(novel) AS novel, any_value(capital) AS capital, lower(token) AS lf FROM f GROUP BY token),
up AS (SELECT * FROM each_ WHERE capital AND (non_initial >= 2 OR (novel AND count >= 3))),
low AS (SELECT form, count, count AS non_initial, chapters, novel FROM each_ WHERE NOT capital AND ((novel AND count >= 3) OR lf IN (SELECT lf FROM up))),
c AS (SELECT *, (initial OR NOT joined OR coalesce(i <> lag(i) OVER v + 1, true))::INT AS n FROM f WHERE capital WINDOW v AS (PARTITION BY k ORDER BY i)),
r AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY i) AS run FROM c),
runs AS (SELECT k, list(token ORDER BY i) AS ws FROM r WHERE NOT (n = 1 AND initial AND NOT novel) GROUP BY k, run),
uses AS (SELECT k, unnest(list_concat(list_transform(range(1, len(ws)), lambda j: ws[j] || ' ' || ws[j + 1]), CASE WHEN len(ws) = 3 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS form FROM runs),
ph AS (SELECT form, count(*) AS count, count(DISTINCT k) AS chapters, lower(form) AS lf FROM uses GROUP BY form),
nx AS (SELECT k, i, token, capital, lead(token) OVER v AS t1, lead(NOT capital AND joined) OVER v AS o1, lead(token, 2) OVER v AS t2, lead(NOT capital AND joined, 2) OVER v AS o2 FROM f WINDOW v AS (PARTITION BY k ORDER BY i)),
wins AS (SELECT k, token || ' ' || t1 AS form FROM nx WHERE NOT capital AND o1 UNION ALL SELECT k, token || ' ' || t1 || ' ' || t2 FROM nx WHERE NOT capital AND o1 AND o2),
sp AS (SELECT form, count(*) AS count, count(DISTINCT k) AS chapters FROM wins GROUP BY form HAVING lower(form) IN (SELECT lf FROM ph) OR replace(lower(form), ' ', '') IN (SELECT lf FROM up)),
alls AS (SELECT 'phrase' AS kind, form, count, count AS non_initial, chapters, true AS novel FROM ph UNION ALL SELECT 'phrase', form, count, count, chapters, true FROM sp UNION ALL SELECT 'single', form, count, non_initial, chapters, novel FROM up UNION ALL SELECT 'single', form, count, non_initial, chapters, novel FROM low),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY novel DESC, count DESC, form) AS rank, CASE kind WHEN 'phrase' THEN 500 ELSE 300 END AS cap FROM alls)"""

SQL["candidates"] = f"WITH {_CAND} SELECT form, count, non_initial, chapters, kind, rank, (SELECT count(*) FROM ranked WHERE rank > cap) AS truncated FROM ranked WHERE rank <= cap"


@query(rf"""WITH {_TALK}, n AS (SELECT c.*, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, CASE WHEN label <> '' AND idx % 4 = 2 THEN NULL WHEN label <> '' THEN idx // 2 + 1 END AS strict FROM c JOIN conversations v ON v.conv_id = c.conv_id AND v.turn = c.idx),
  g AS (SELECT conv_id, count(strict) > 0 AND min(strict) IN (0, 1) AND max(strict) - min(strict) + 1 = count(strict) AND count(DISTINCT strict) = count(strict) AND count(strict) >= 3 AS ok, count(strict) > 0 AS numbered,
    min(idx) FILTER (WHERE strict IS NOT NULL) AS f1, max(idx) FILTER (WHERE strict IS NOT NULL) AS l1, min(idx) FILTER (WHERE label <> '') AS f2, max(idx) FILTER (WHERE label <> '') AS l2 FROM n GROUP BY 1)
  SELECT conv_id, ok AS strict_contiguous FROM g""")
def universes_contiguous(spark, sf):
    own = talk(spark, sf).withColumn("strict", F.when((F.col("label") != "") & (F.col("idx") % 4 != 2), F.floor(F.col("idx") / 2) + 1))
    return numbering.contiguous_run(own, "conv_id", "strict").select("conv_id", F.col("contiguous").alias("strict_contiguous"))


@query()
def universes_built(spark, sf):
    """Conversations as books: users' turns are labelled, some of them with numbers. A test holds the operator against worked cases."""
    own = talk(spark, sf).drop("number").withColumn("strict", F.when((F.col("label") != "") & (F.col("conv_id") % 2 == 0), (F.floor(F.col("idx") / 2) + 1).cast("int"))).withColumn("loose", F.lit(None).cast("int"))
    return numbering.build_universe(own, "conv_id", ["part 0"], [])
