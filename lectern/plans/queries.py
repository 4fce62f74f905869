"""Registered queries: the operators over the driver's tables. oracle.py has the SQL of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import experiments as X
from ..operators import identity, intervals, ledger, numbering, qa, ranking, spelling
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The rules and vocabularies that the queries check.
RULES = [{"pattern": "the ([a-z]+ing)", "replacement": "a $1"}, {"pattern": "and ", "replacement": "& "}, {"pattern": "zzqx+", "replacement": "z"}, {"pattern": "a ([a-z]+ing) of", "replacement": "$1 for"}]
NAMES = ["ring", "bolt", "the ing", "of the", "and the", "widget", "is the"]
PRICES = [("A", "F", 2.0, 8.0, 0.5), ("A", "*", 1.0, 4.0, 0.2), ("N", "*", 3.0, 9.0, 0.3)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Transcript QA ---------------------------------------------------------------------------------


@query
def doc_loop_top_gram(spark, sf):
    return qa.cross_loops(S.chapters(spark, sf))


@query
def line_loop_top_gram(spark, sf):
    return qa.within_loops(S.segments(spark, sf))


@query
def doc_multi_loop_dedup(spark, sf):
    return qa.multi_loops(S.chapters(spark, sf))


@query
def doc_rate_outliers(spark, sf):
    return qa.rate_outliers(S.chapters(spark, sf)).select("chapter", "words", "minutes", "rate", "z")


@query
def line_repeat_runs(spark, sf):
    return qa.repeat_runs(S.segments(spark, sf), S.chapters(spark, sf))


@query
def loop_located(spark, sf):
    return qa.locate_phrase(qa.cross_loops(S.chapters(spark, sf)), S.segments(spark, sf)).select("chapter", "phrase", "at", "until")


@query
def low_quality_worst5(spark, sf):
    d, labels = S.table(spark, sf, "documents"), S.table(spark, sf, "labels")
    words = labels.join(d.select("doc_id", "source"), "doc_id").select(F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("chapter"), F.col("quality").cast("double").alias("p"))
    return qa.low_confidence(words).withColumn("rate", F.round("rate", 6))


def _flagged(spark, sf):
    return qa.union_of(qa.cross_loops(S.chapters(spark, sf)), qa.rate_outliers(S.chapters(spark, sf)))


def _planned(spark, sf):
    return S.table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("chapter"))


@query
def flagged_union(spark, sf):
    return _flagged(spark, sf)


@query
def plan_missing(spark, sf):
    return qa.missing(_flagged(spark, sf), _planned(spark, sf))


@query
def plan_unexpected(spark, sf):
    return qa.unexpected(_planned(spark, sf), _flagged(spark, sf))


@query
def clean_verdict(spark, sf):
    found = qa.is_clean({"loops": qa.cross_loops(S.chapters(spark, sf)), "outliers": qa.rate_outliers(S.chapters(spark, sf))})
    return found.select(F.col("counts")["loops"].alias("loops"), F.col("counts")["outliers"].alias("outliers"), "clean")


@query
def tail_burst(spark, sf):
    e = S.table(spark, sf, "events")
    day = (F.floor(S.seconds("ts")) - 1704067200) / 86_400  # a day of events is a second of words; views are blank
    word = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    words = e.select(F.col("user_id").alias("chapter"), F.col("event_id").alias("pos"), word.alias("word"), day.alias("start"), day.alias("end"))
    return qa.tail_rates(words).select("chapter", "words", "tail", (F.col("rate") > 0).alias("fast"))


# Ledger ----------------------------------------------------------------------------------------


@query
def ledger_cost(spark, sf):
    return ledger.cost_by_book(S.runs(spark, sf)).withColumn("cost", F.round("cost", 4))


@query
def ledger_total(spark, sf):
    return ledger.total_or_zero(S.runs(spark, sf), "tokens_in")


@query
def ledger_first_start(spark, sf):
    return ledger.first_start(S.runs(spark, sf)).select("book_id", F.unix_micros("first_start").alias("first_start"))


@query
def ledger_budget(spark, sf):
    return ledger.budget_cost(S.runs(spark, sf), "book_id").withColumn("cost", F.round("cost", 4))


@query
def ledger_successes(spark, sf):
    return ledger.count_successes(S.runs(spark, sf))


@query
def ledger_open_runs(spark, sf):
    return ledger.open_runs(S.runs(spark, sf)).select("id", "book_id", "stage")


@query
def ledger_succeeded_stages(spark, sf):
    return ledger.succeeded_stages(S.runs(spark, sf)).select("book_id", F.array_join("stages", ",").alias("stages"))


@query
def ledger_timing(spark, sf):
    users = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    out = ledger.timings(users, S.runs(spark, sf), S.now())
    return out.select("book_id", *[F.round(c, 3).alias(c) for c in ("elapsed_s", "active_s", "asr_s")], "open")


@query
def active_rollup(spark, sf):
    return ledger.active_counts(S.runs(spark, sf).withColumn("active", ~F.col("ok")))


@query
def child_rollup(spark, sf):
    li = S.table(spark, sf, "lineitem")
    children = li.select(
        F.col("l_orderkey").alias("stage_run_id"), F.col("l_partkey").alias("id"), F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out"), F.lit(0).cast("long").alias("tokens_cached"),
        F.col("l_extendedprice").alias("cost_usd"), (F.col("l_returnflag") != "N").alias("cost_reported"), (F.col("l_linestatus") == "F").alias("estimate_complete"),
        F.when(F.col("l_partkey") < 1000, F.concat(F.lit("m"), F.col("l_partkey").cast("string"))).otherwise("").alias("model"), (F.col("l_returnflag") == "R").alias("active"), F.unix_micros(S.wall("l_shipdate")).alias("heartbeat_at"),
    )
    orders = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("stage_run_id"))
    out = orders.join(ledger.child_rollup(children), "stage_run_id", "left")
    return out.select("stage_run_id", "tokens_in", "tokens_out", F.round("cost_usd", 2).alias("cost_usd"), F.coalesce("estimate_complete", F.lit(True)).alias("estimate_complete"), "model", F.coalesce("active", F.lit(False)).alias("active"), "heartbeat_at")


@query
def semi_unresolved(spark, sf):
    notes = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.lit("core").alias("kind"), F.when(F.col("l_returnflag") == "R", "merged").otherwise("open").alias("status"), F.when(F.col("l_linestatus") == "F", "x").otherwise("").alias("note"))
    return ledger.unresolved_books(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), notes)


@query
def keyset_page(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return ledger.page(e, before=5000, limit=100)


@query
def incident_family_count(spark, sf):
    e = S.table(spark, sf, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("incident_key"))
    return ledger.incident_family(e, "error:", "7")


@query
def batch_cost_summary(spark, sf):
    c, o = S.table(spark, sf, "customer"), S.table(spark, sf, "orders")
    batches = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("batch_id"))
    work = o.select(F.col("o_custkey").alias("book_id"), F.col("o_totalprice").alias("cost_usd"), (F.col("o_orderstatus") == "F").alias("cost_reported"), (F.col("o_totalprice") / 2).alias("estimated_cost"), (F.col("o_orderstatus") == "O").alias("estimate_complete"), F.lit(1).cast("long").alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"), F.lit(0).cast("long").alias("tokens_cached"))
    s = o.join(batches.withColumnRenamed("id", "o_custkey"), "o_custkey").select("batch_id", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey")).alias("book_id"), F.when(F.col("o_orderpriority") != "5-LOW", F.lit(0.25)).alias("provider_cost_usd"))
    out = ledger.batch_costs(batches, work, s)
    return out.select("batch_id", *[F.round(x, 2).alias(x) for x in ("work_cost", "book_supervision", "batch_supervision")], "unknown")


@query
def latest_per_key(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return ledger.latest(e, "user_id", "event_type")


@query
def superseded_successes(spark, sf):
    r = S.runs(spark, sf)
    retries = r.where("stage = 'click' AND cost_usd > 100").select("book_id", "stage", F.col("started_at").alias("ts"))
    return ledger.supersede(r, retries).groupBy("stage").agg(F.count_if("superseded").alias("superseded"), F.round(F.sum("cost_usd"), 2).alias("cost"))


@query
def pruned_events(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ledger.prune(e, S.NOW, days=10).select("event_id")


@query
def contribution_upsert(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_type").alias("kind"), F.col("value").alias("note"), F.col("event_id").alias("seq"), F.col("event_id").alias("created_at"))
    return ledger.upsert_contributions(e)


# Ranking and incidents -------------------------------------------------------------------------


@query
def rolling_recoveries(spark, sf):
    errors = S.table(spark, sf, "events").where("event_type = 'error'")
    return errors.select("event_id", "user_id", ranking.rolling_count(errors, "user_id", "ts", 86_400).alias("n")).where("n >= 2")


@query
def trailing_error_run(spark, sf):
    return ranking.trailing_run(S.table(spark, sf, "events"), "user_id", "event_id", "event_type")


@query
def non_converging3(spark, sf):
    return ranking.non_converging(S.table(spark, sf, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query
def ewma_rate(spark, sf):
    return ranking.ewma(S.table(spark, sf, "events"), "user_id", "value", "event_id").withColumn("rate", F.round("rate", 4))


@query
def running_best(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "user_id", "value")
    return ranking.running_best(e, "user_id", "event_id", "value")


@query
def state_changes(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ranking.changes(e, "user_id", "event_id", "event_type")


@query
def series_rank(spark, sf):
    return ranking.series_rank(S.books(spark, sf)).select("id", "series", "rank")


@query
def lock_owner(spark, sf):
    return ranking.lock_owners(S.books(spark, sf), F.col("status") == "F")


@query
def blocked_by(spark, sf):
    return ranking.blocked_by(S.books(spark, sf), F.col("status") == "F")


@query
def predecessor_asof(spark, sf):
    return ranking.predecessor(S.books(spark, sf))


@query
def queue_snapshot(spark, sf):
    out = ranking.queue_snapshot(S.books(spark, sf).withColumn("n", F.col("id")), F.concat_ws("/", "series", "status"), "n")
    return out.select("id", "bucket", "place")


@query
def lane_fill(spark, sf):
    e = S.books(spark, sf).withColumn("lane", F.col("status"))
    return ranking.fill_lanes(e, {"O": 3, "P": 2}, "id").select("id", "lane")


@query
def finding_counts(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.when(F.col("event_type") == "error", "blocker").when(F.col("event_type") == "click", "fix").otherwise("nit").alias("severity"))
    return ranking.finding_counts(e)


@query
def audit_acceptance(spark, sf):
    fixes = F.pmod(F.floor("value"), F.lit(8)).cast("int")
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("round"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("blockers"), fixes.alias("fixes"), (F.col("event_type") != "view").alias("clean"), F.pmod("event_id", F.lit(6)).cast("int").alias("fixes_done"))
    return ranking.audit_accepted(e).groupBy("book_id").agg(F.count_if("accepted").alias("accepted"))


# Intervals and numbering -----------------------------------------------------------------------


@query
def interval_merge(spark, sf):
    return intervals.merge(S.spans(spark, sf), "book")


@query
def interval_gaps(spark, sf):
    own = S.spans(spark, sf)
    return intervals.gaps(own, S.totals(spark, sf), "book")


@query
def map_complete(spark, sf):
    own = S.spans(spark, sf)
    totals = S.totals(spark, sf)
    return intervals.complete_maps(intervals.gaps(own, totals, "book"), totals, "book")


@query
def snap_back(spark, sf):
    points = S.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("book"), "event_id", (F.floor(S.seconds("ts")) - 1704067200).cast("double").alias("point"))
    return intervals.snap_back(points, S.spans(spark, sf), "book").select("event_id", "snapped")


@query
def chunk_plan(spark, sf):
    own = S.chapters(spark, sf).select(F.floor(F.col("chapter") / 100).cast("long").alias("book"), "chapter", F.size(T.tokens(F.col("text"))).alias("words"))
    return numbering.chunk_plan(own, "book", budget=5000, least=2000)


@query
def cumulative_offsets(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long").alias("size"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "size"]
    return numbering.cumulative(li, "l_orderkey", order, "size").select("l_orderkey", "l_linenumber", "l_partkey", "start", "end")


@query
def fold_forward_backward(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "user", "x").otherwise("").alias("label"), F.when(F.col("role") == "assistant", F.col("turn")).alias("number"))
    return numbering.fill_numbers(c, "conv_id").select("conv_id", "idx", "chapter")


@query
def section_ordinals(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "user", "x").alias("label"))
    return numbering.ordinals(c, "conv_id").select("conv_id", "idx", "ordinal")


@query
def contiguous_turns(spark, sf):
    return numbering.is_contiguous(S.table(spark, sf, "conversations"), "conv_id", "turn")


@query
def size_outliers(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.size(T.tokens(F.col("text"))).alias("words"))
    return numbering.size_outlier(c, "conv_id")


@query
def edge_turns(spark, sf):
    return numbering.edge_files(S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx")), "conv_id", depth=1)


# Text ------------------------------------------------------------------------------------------


@query
def fuzzy_reference(spark, sf):
    return spelling.reference_matches(S.forms(spark, sf), S.names(spark, sf), S.COMMON)


@query
def rule_cascade(spark, sf):
    out = spelling.apply_rules(S.chapters(spark, sf), RULES)
    return out.select("chapter", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def dead_rules(spark, sf):
    return spelling.dead_rules(S.chapters(spark, sf), RULES)


@query
def first_use(spark, sf):
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    return spelling.first_use(S.chapters(spark, sf), names, "chapter")


@query
def shingle_overlap(spark, sf):
    sources = S.table(spark, sf, "benchmark").select("item_id", "text")
    return spelling.overlap(S.chapters(spark, sf), sources, "chapter", "item_id").select("chapter", "item_id", "first", "words")


@query
def error_fingerprint(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", T.error_fingerprint(F.col("url")).alias("fingerprint"))


@query
def name_slugs(spark, sf):
    return S.table(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" - ", "p_name", "p_brand")).alias("slug"), T.normalise_name(F.col("p_brand")).alias("plain"), T.normalise_ascii(F.col("p_brand")).alias("ascii"))


@query
def token_search(spark, sf):
    return X.token_search(S.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "ring brand#1", "p_name", "p_brand").select("p_partkey")


# Experiments -----------------------------------------------------------------------------------


@query
def price_estimate(spark, sf):
    usage = S.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("backend"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out"), F.lit(1).cast("long").alias("tokens_cached"))
    prices = spark.createDataFrame(PRICES, "backend string, model string, input double, output double, cached double")
    return X.price(usage, prices).groupBy("backend", "model", "known").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query
def history_groups(spark, sf):
    r = S.runs(spark, sf).select("stage", F.lit("b").alias("backend"), F.when(F.col("cost_usd") > 50, "large").otherwise("small").alias("model"), "ok", F.col("cost_usd").alias("seconds"))
    return X.history(r).withColumn("mean_seconds", F.round("mean_seconds", 4))


@query
def profile_report(spark, sf):
    r = S.runs(spark, sf)
    own = r.select(F.col("book_id").alias("profile"), F.col("cost_usd").alias("wall_seconds"), F.col("ok").alias("completed"), (F.col("cost_usd") / 500).alias("recall"), F.lit(True).alias("clean"), F.lit(1).alias("holdouts"), F.when(F.col("cost_usd") < 400, 1).otherwise(0).alias("passed"), F.array(F.struct("tokens_in", "tokens_out", F.col("cost_usd").alias("cost"), F.col("ok").alias("known"))).alias("invocations"))
    out = X.profile_report(own)
    return out.select("profile", "runs", "completed", F.round("median_wall", 4).alias("median_wall"), F.round("mean_recall", 6).alias("mean_recall"), F.round("tokens_in", 0).alias("tokens_in"), F.round("cost", 2).alias("cost"), "cost_complete", "hard_gate")


@query
def set_jaccard(spark, sf):
    """The first line of each document against the rest of it, as sets of words."""
    d = S.chapters(spark, sf).withColumn("_a", F.element_at(F.split("text", "\n"), 1))
    a, b = F.array_distinct(T.tokens(F.lower("_a"))), F.array_distinct(T.tokens(F.lower("text")))
    return d.select("chapter", F.round(X.jaccard(a, b), 6).alias("jaccard"), F.round(X.recall(a, b), 6).alias("recall"))


@query
def pareto_front(spark, sf):
    p = S.table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    p = p.withColumn("p_retailprice", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")))
    return X.pareto(p, ["p_retailprice"], ["p_size", "p_partkey"], block="p_brand", gate=F.col("p_partkey") % 3 != 0, unknown="p_retailprice").select("p_partkey", "p_brand")


@query
def rule_violations(spark, sf):
    c = S.table(spark, sf, "conversations")
    rules = {"role_unknown": ~F.col("role").isin("user", "assistant"), "text_too_long": F.length("text") > 1500, "text_blank": F.trim("text") == "", "turn_out_of_range": ~X.chapter_in_range(F.col("turn"), F.lit(5))}
    return X.violations(c, rules, ["conv_id", "turn"])


@query
def cost_summary(spark, sf):
    return X.cost_summary(S.runs(spark, sf)).withColumn("cost", F.round("cost", 4))


@query
def series_gap(spark, sf):
    p = S.table(spark, sf, "part").select(F.col("p_brand").alias("series"), F.col("p_size").alias("pos"), "p_type")
    return X.series_gaps(p, F.col("p_type") == "ECONOMY")


@query
def contribution_summary(spark, sf):
    li = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.when(F.col("l_returnflag") == "A", "merged").when(F.col("l_returnflag") == "R", "rejected").otherwise("open").alias("status"), F.when(F.col("l_linestatus") == "O", "n").alias("note"))
    return identity.contribution_summary(li)


@query
def coverage_ladder(spark, sf):
    p = S.table(spark, sf, "part")
    scanned = p.select(F.col("p_partkey").cast("string").alias("path"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.when(F.col("p_size") < 10, F.col("p_brand")).alias("asin"), F.when(F.col("p_size") < 20, F.col("p_type")).alias("isbn"))
    s = S.table(spark, sf, "supplier")
    recordings = s.select(F.concat(F.lit("w"), F.col("s_suppkey").cast("string")).alias("work_id"), F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("asin"), F.when(F.col("s_nationkey") == 3, "SMALL").alias("isbn"))
    works = spark.createDataFrame([("t1", "blue bolt economy"), ("t2", "red ring small"), ("t3", "large gear standard")], "work_id string, title string")
    return identity.coverage(scanned, recordings, works).select("path", "work_id", "matched_by")


# Rows only: sequential or Python-backed operators; tests hold them against models -----------------


@query
def candidates(spark, sf):
    common = spark.createDataFrame([("the",), ("and",), ("of",)], "w string")
    return spelling.name_candidates(S.chapters(spark, sf), "chapter", common)


@query
def narrated_numbering(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("idx"), F.when(F.col("event_type") != "view", F.floor(F.col("value") / 50) + 1).alias("announced"))
    return numbering.narrated(e, "book")


@query
def adjudicate(spark, sf):
    """Chapters whose tail is a loop: the loop from its first word to the end, against the whole text (no second transcript is at hand)."""
    own = intervals.tail_runs(S.chapters(spark, sf).select("chapter", T.tokens(F.col("text")).alias("tokens")), "chapter")
    loop = F.expr("slice(tokens, first_pos + 1, size(tokens))")
    d = own.select("chapter", "phrase", F.array_join(loop, " ").alias("looped"), F.array_join("tokens", " ").alias("fresh"))
    return intervals.adjudicate(d, "chapter")


@query
def queue_makespan(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("id"), F.col("event_id").alias("place"), F.array(F.struct(F.when(F.col("event_type") == "view", "asr").otherwise("agent").alias("lane"), F.col("value").alias("seconds"))).alias("segments"))
    return ranking.makespan(e)


@query
def tail_run_located(spark, sf):
    words = S.chapters(spark, sf).select("chapter", F.posexplode(T.tokens(F.col("text"))).alias("pos", "text"))
    return intervals.locate_tail_run(words, "chapter")


# More operators over the same stand-ins ---------------------------------------------------------


@query
def gram_word_sets(spark, sf):
    own = S.table(spark, sf, "part").select("p_partkey", T.word_set(F.col("p_name")).alias("words"))
    return own.groupBy("words").agg(F.count(F.lit(1)).alias("n"))


@query
def repeated_suffixes(spark, sf):
    own = S.chapters(spark, sf).select("chapter", T.tokens(F.col("text")).alias("t"))
    return own.where(intervals.repeated_suffix(F.col("t"))).select("chapter")


@query
def plan_problems(spark, sf):
    d = S.chapters(spark, sf)
    planned = _planned(spark, sf).join(d.select("chapter", "duration"), "chapter").select("chapter", F.lit(10.0).alias("start"), F.lit(20.0).alias("end"), "duration")
    return qa.plan_problems(planned, _flagged(spark, sf), _flagged(spark, sf))


@query
def success_baseline(spark, sf):
    out = ranking.success_baseline(S.runs(spark, sf))
    return out.select("stage", F.round("seconds", 3).alias("seconds"), "tokens", F.round("cost", 4).alias("cost"))


@query
def not_improving(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", "user_id", F.floor(F.col("value") / 10).alias("found"), (F.col("event_type") == "purchase").alias("passed"))
    return ranking.not_improving(e, "user_id", "event_id", "found", "passed").select("event_id")


@query
def remaining_units(spark, sf):
    p = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("done"), (F.col("l_linenumber") * 8).alias("total"))
    return ranking.remaining_units(p).groupBy("l_orderkey").agg(F.sum("remaining").alias("remaining"))


@query
def lock_holders(spark, sf):
    b = S.books(spark, sf).withColumn("series", F.when(F.col("status") == "P", F.lit("")).otherwise(F.col("series")))
    return ranking.lock_holders(b, F.col("status") == "F")


@query
def seeded_ewma(spark, sf):
    out = ranking.ewma(S.table(spark, sf, "events"), "user_id", "value", "event_id", seed=F.lit(10.0))
    return out.withColumn("rate", F.round("rate", 4))


@query
def rewind_stage(spark, sf):
    r = S.runs(spark, sf)
    stages = spark.createDataFrame([("signup", 0), ("view", 1), ("click", 2), ("purchase", 3)], "stage string, stage_order int")
    done = r.where("ok").select("book_id", "stage").distinct()
    present = r.where("cost_usd > 120").select("book_id", "stage").distinct()
    return ranking.rewind_to(stages, done, present)


@query
def span_titles(spark, sf):
    own = S.spans(spark, sf)
    holes = intervals.gaps(own, S.totals(spark, sf), "book")
    marks = own.where(F.col("end") > F.col("start")).select("book", (F.col("start") - 300).alias("start"), (F.col("start") + 100).alias("end"), F.when(F.col("start") % 2 == 0, "m").otherwise(" ").alias("title"))
    return intervals.span_titles(holes, marks, "book").select("book", "start", F.size("titles").alias("n"))


@query
def spans_described(spark, sf):
    own = S.spans(spark, sf)
    holes = intervals.gaps(own, S.totals(spark, sf), "book")
    marks = own.where(F.col("end") > F.col("start")).select("book", (F.col("start") - 300).alias("start"), (F.col("start") + 100).alias("end"), F.format_string("t%.0f", "start").alias("title"))
    return intervals.describe(intervals.span_titles(holes, marks, "book"), "book")


@query
def shift_runs(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "system", F.col("turn")).otherwise(F.col("turn") + 1).alias("chapter"))
    return numbering.shift_runs(c, "conv_id")


@query
def constant_shift(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.when(F.col("role") == "system", F.col("turn")).otherwise(F.col("turn") + 1).alias("chapter"))
    return numbering.constant_shift(c, "conv_id")


@query
def edge_classes(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("idx"), F.size(T.tokens(F.col("text"))).alias("words"), F.lit(None).cast("double").alias("duration"))
    return numbering.classify_edges(c, "conv_id").select("conv_id", "idx", "edge")


@query
def collected_chapters(spark, sf):
    li = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("book"), F.col("l_partkey").alias("idx"), F.col("l_linenumber").alias("chapter"), F.col("l_partkey").cast("string").alias("file"), F.col("l_quantity").cast("long").alias("words"), F.lit("t").alias("label"))
    return numbering.collect_chapters(li.distinct(), "book").select("book", "chapter", F.array_join("files", ",").alias("files"), "words", "title")


@query
def known_forms(spark, sf):
    forms = spark.createDataFrame([("Rings",), ("ring",), ("bolt's",), ("BLUE",), ("gizmos",), ("smalls",), ("Blue ox",), ("Blue whale",)], "form string")
    names = S.table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("folded"))
    return spelling.known_forms(forms, names)


@query
def top_names(spark, sf):
    return spelling.top_counts(S.table(spark, sf, "part"), "p_name", 10)


@query
def series_glossary(spark, sf):
    books = S.books(spark, sf).select("id", "series", F.col("series_pos").cast("int").alias("pos"))
    names = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    return spelling.glossary(books, names).select("id", F.array_join("names", ",").alias("names"))


@query
def override_view(spark, sf):
    p = S.table(spark, sf, "part").select(F.col("p_partkey").alias("source_path"))
    o = S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_path"), (F.col("s_acctbal") < 0).alias("hidden"), (F.col("s_nationkey") == 1).alias("force_audio"))
    return identity.apply_overrides(p, o)


@query
def epub_pairs(spark, sf):
    books = S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("dir"))
    epubs = S.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("dir"), F.col("s_suppkey").alias("path"), (F.col("s_acctbal") > 5000).alias("readable"))
    return identity.pair_epubs(books, epubs)


@query
def newest_snapshot(spark, sf):
    e = S.table(spark, sf, "events").select("user_id", "value", F.col("event_id").alias("generation"))
    return identity.newer(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "generation")


@query
def timeline_places(spark, sf):
    stages = S.table(spark, sf, "region").select(F.col("r_name").alias("stage"), F.col("r_regionkey").alias("stage_order"))
    return X.timeline(stages, 2)


@query
def result_tally(spark, sf):
    e = S.table(spark, sf, "events").select(F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "click", "duplicate").when(F.col("event_type") == "error", "failed").alias("status"))
    return X.tally(e)


@query
def log_lines(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.col("event_type").alias("type"), F.concat(F.lit('{"message":'), F.get_json_object("props", "$.k"), F.lit("}")).alias("payload"))
    return X.log_line(e).select("event_id", "line")


@query
def spend_runs(spark, sf):
    return X.spend_runs(S.runs(spark, sf)).select("id")


@query
def run_seconds(spark, sf):
    return S.runs(spark, sf).select("id", F.round(X.run_seconds(F.col("started_at"), F.col("finished_at")), 3).alias("seconds"))


# Streams: each runs over the events table to its end, and what it has then is what the batch form has ------------


def _stream(spark, sf, again: bool = False):
    """The events as a stream of six files, two a micro-batch, so that state is carried; with `again`, a few events come twice."""
    from ..sources.shared import shared_path
    from ..streaming import events as stream

    batch = S.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("key"), F.col("event_type").alias("type"), "value")
    if again:
        batch = batch.unionByName(batch.where("event_id % 10 = 0"))
    path = shared_path(spark, "events")
    batch.repartition(6, F.col("event_id") % 6).write.parquet(path)
    return stream, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query
def stream_last_write(spark, sf):
    stream, own = _stream(spark, sf)
    out = stream.run_to_end(stream.last_write(own, "key", "type"))
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select(F.col("key").alias("user_id"), F.col("type").alias("event_type"), "value", F.col("event_id").alias("seq"))


@query
def stream_counts(spark, sf):
    stream, own = _stream(spark, sf)
    out = stream.run_to_end(stream.counts(own, "key", "type"))
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select(F.col("key").alias("user_id"), F.col("type").alias("event_type"), "n")


def _ordered(spark, sf, value: str):
    """The events as a stream of three files that follow each other by event id, one a micro-batch: folds that depend on order
    carry each user's state from one to the next."""
    from ..sources.shared import shared_path
    from ..streaming import events as stream

    batch = S.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col(value).alias("value"))
    last, path = batch.agg(F.max("event_id")).first()[0] or 0, shared_path(spark, "in-order")
    for part in range(3):
        batch.where(F.floor(F.col("event_id") * 3 / (last + 1)) == part).coalesce(1).write.mode("append").parquet(path)
    return stream, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_moving_average(spark, sf):
    stream, own = _ordered(spark, sf, "value")
    out = stream.run_to_end(stream.moving_average(own), "update")
    return out.groupBy(F.col("key").alias("user_id")).agg(F.round(F.max_by("rate", "n"), 4).alias("rate"))


@query
def stream_deduplicated(spark, sf):
    stream, own = _stream(spark, sf, again=True)
    return stream.run_to_end(stream.dedupe(own, "400 days"), "append").select("event_id", F.col("key").alias("user_id"))


@query
def stream_changes(spark, sf):
    stream, own = _ordered(spark, sf, "event_type")
    return stream.run_to_end(stream.changed(own), "append").select("event_id", F.col("key").alias("user_id"), F.col("value").alias("event_type"))


@query
def stream_rolling(spark, sf):
    stream, own = _stream(spark, sf)
    out = stream.run_to_end(stream.rolling(own, "key", "1 day", "1 day", "400 days"))
    last = out.agg(F.max("batch").alias("batch"))
    # Days of the session's clock, which shows the events' own.
    return out.join(F.broadcast(last), "batch").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), F.col("key").alias("user_id"), "n")


@query
def stream_replayed(spark, sf):
    stream, own = _stream(spark, sf)
    return stream.run_to_end(stream.replay(own, 400), "append").select("event_id")
