"""Ranking, scheduling and incident analytics over books (id, series, series_pos, state, status) and runs."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.text import error_fingerprint, first_class, leading_number

_PLACE = ("pos", "id")


def with_position(books: DataFrame) -> DataFrame:
    return books.withColumn("pos", leading_number(F.col("series_pos").cast("string"), C.POSITION_UNKNOWN))


def series_rank(books: DataFrame) -> DataFrame:
    """Adds rank: 0-based place in the series; 0 without one. Books without a series are each a group of their own."""
    alone = F.coalesce("series", F.lit("")) == ""
    order = Window.partitionBy("series", F.when(alone, F.col("id"))).orderBy(*_PLACE)
    return with_position(books).withColumn("rank", F.when(alone, F.lit(0)).otherwise(F.row_number().over(order) - 1))


def lock_owners(books: DataFrame, finished: Column) -> DataFrame:
    """(series, owner): the first unfinished book of each series."""
    left = with_position(books).where(~finished & (F.coalesce("series", F.lit("")) != ""))
    return left.groupBy("series").agg(F.min_by("id", F.struct(*_PLACE)).alias("owner"))


def lock_holders(books: DataFrame, finished: Column) -> DataFrame:
    alone = books.where(~finished & (F.coalesce("series", F.lit("")) == "")).select("id")
    return lock_owners(books, finished).select(F.col("owner").alias("id")).unionByName(alone)


def blocked_by(books: DataFrame, finished: Column) -> DataFrame:
    """(id, owner) of unfinished books that wait for another of their series."""
    return books.where(~finished).join(lock_owners(books, finished), "series").where("id <> owner").select("id", "owner")


def predecessor(books: DataFrame, partition: str = "series") -> DataFrame:
    """(id, previous): the book at the greatest position strictly below, the higher id of equals.

    Equal positions are one group, so the group before it is a lag and no book meets another.
    """
    own = with_position(books)
    groups = own.groupBy(partition, "pos").agg(F.max("id").alias("last"))
    groups = groups.withColumn("previous", F.lag("last").over(Window.partitionBy(partition).orderBy("pos")))
    return own.join(groups.select(partition, "pos", "previous"), [partition, "pos"], "left").select("id", "previous")


def queue_snapshot(books: DataFrame, bucket: Column, *order) -> DataFrame:
    """Adds bucket and place, dense within the bucket."""
    return books.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))


def fill_lanes(waiting: DataFrame, free: dict[str, int], *order) -> DataFrame:
    """The first rows of each lane, as many as it has room for: a top-k of each of the few lanes, so that no task sorts one."""
    out = waiting.limit(0)
    for lane, room in free.items():
        out = out.unionByName(waiting.where(F.col("lane") == lane).orderBy(*order).limit(max(room, 0)))
    return out


def rewind_to(stages: DataFrame, done: DataFrame, present: DataFrame) -> DataFrame:
    """(book_id, stage_order): the earliest completed stage whose evidence is missing. stages: (stage, stage_order)."""
    return done.join(present, ["book_id", "stage"], "left_anti").join(stages, "stage").groupBy("book_id").agg(F.min("stage_order").alias("stage_order"))


def ewma(samples: DataFrame, key: str, value: str, order: str, alpha: float = C.EWMA_ALPHA, seed: Column | None = None) -> DataFrame:
    """(key, rate): each key's samples folded in order; the first stands alone unless there is a seed; samples <= 0 are skipped.

    The fold has a closed form: a sample's weight is alpha (1 - alpha) ** (samples after it), so it needs places only.
    """
    own = samples.where(F.col(value) > 0)
    back = Window.partitionBy(key).orderBy(F.desc(order))
    front = Window.partitionBy(key).orderBy(order)
    own = own.withColumn("_k", F.row_number().over(back) - 1).withColumn("_i", F.row_number().over(front))
    weight = F.pow(F.lit(1 - alpha), "_k") * (F.lit(alpha) if seed is not None else F.when(F.col("_i") == 1, F.lit(1.0)).otherwise(F.lit(alpha)))
    rate = F.sum(weight * F.col(value))
    return own.groupBy(key).agg((rate + seed * F.pow(F.lit(1 - alpha), F.count(F.lit(1)))).alias("rate") if seed is not None else rate.alias("rate"))


def remaining_units(progress: DataFrame) -> DataFrame:
    return progress.withColumn("remaining", F.greatest(F.coalesce("total", F.lit(0)) - F.coalesce("done", F.lit(0)), F.lit(0)))


def redo_units(units: Column) -> Column:
    return F.greatest(F.round(units * C.REDO_SHARE), F.lit(1.0))


def book_eta(paths: DataFrame, rates: DataFrame, lanes: Column) -> DataFrame:
    """(book_id, eta_s): waves of the remaining stages times their rates. paths: (book_id, stage, units); rates: (stage, rate, seed)."""
    rate = F.coalesce(F.when(F.col("rate") > 0, F.col("rate")), F.col("seed"))
    own = paths.join(rates, "stage").withColumn("s", F.ceil(F.col("units") / lanes) * rate)
    return own.groupBy("book_id").agg(F.greatest(F.round(F.sum("s") / 10) * 10, F.lit(0.0)).alias("eta_s"))


def makespan(jobs: DataFrame, lanes: dict[str, int] | None = None, group: str = "queue") -> DataFrame:
    """(group, id, start, finish): a simulation of each queue. jobs: (group, id, place, segments: array of (lane, seconds)).

    Admission is sequential by nature; a group is one queue of waiting books, not a table.
    """
    room = dict(lanes or C.LANES)

    def run(key, table):
        import pyarrow as pa

        jobs_ = sorted(table.select(["place", "id", "segments"]).to_pylist(), key=lambda r: (r["place"], r["id"]))
        free, waiting, running, now = dict(room), {lane: [] for lane in room}, [], 0.0
        start, finish = {}, {}

        def ready(j, at):
            if at < len(jobs_[j]["segments"]):
                heapq.heappush(waiting[jobs_[j]["segments"][at]["lane"]], (j, at))
            else:
                finish[j] = now

        for j in range(len(jobs_)):
            ready(j, 0)
        while True:
            for lane, queue in waiting.items():
                while queue and free[lane]:
                    j, at = heapq.heappop(queue)
                    free[lane] -= 1
                    start.setdefault(j, now)
                    heapq.heappush(running, (now + jobs_[j]["segments"][at]["seconds"], j, at))
            if not running:
                break
            now, j, at = heapq.heappop(running)
            free[jobs_[j]["segments"][at]["lane"]] += 1
            ready(j, at + 1)
        out = [(key[0].as_py(), r["id"], start.get(j, 0.0), finish.get(j, 0.0)) for j, r in enumerate(jobs_)]
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(cols[0], table.schema.field(group).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=[group, "id", "start", "finish"])

    kind = jobs.schema[group].dataType.simpleString()
    return jobs.select(group, F.col("id").cast("long").alias("id"), "place", "segments").groupBy(group).applyInArrow(run, f"{group} {kind}, id long, start double, finish double")


def changes(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Rows that differ from the one before of their key."""
    w = Window.partitionBy(key).orderBy(order)
    differs = F.row_number().over(w) == 1
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    return df.withColumn("_d", differs).where("_d").drop("_d")


def next_states(books: DataFrame, transitions: DataFrame) -> DataFrame:
    """books with `next` by (state, outcome); a table of the states' few edges."""
    return books.join(transitions, ["state", "outcome"], "left")


def primary_incident(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("book_id").agg(F.max_by("kind", F.struct("priority", -F.col("pos"))).alias("kind"))


def trailing_run(runs: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value, n): the run of equal values that each key ends with."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    own = runs.withColumn("_last", F.first(value).over(back)).withColumn("_off", F.sum((~F.col(value).eqNullSafe(F.col("_last"))).cast("int")).over(back))
    return own.where("_off = 0").groupBy(key).agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def non_converging(rounds: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value equals that of the two rows before."""
    w = Window.partitionBy(key).orderBy(order)
    own = rounds.withColumn("_a", F.lag(value, 1).over(w)).withColumn("_b", F.lag(value, 2).over(w))
    return own.where((F.col(value) == F.col("_a")) & (F.col(value) == F.col("_b"))).drop("_a", "_b")


def rolling_count(df: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Rows of the key in the `seconds` up to each row, itself included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(micros).rangeBetween(-seconds * 1_000_000, 0))


def running_best(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds best_before: the least value of the rows before."""
    return df.withColumn("best_before", F.min(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))


def audit_accepted(rounds: DataFrame, max_fixes: int = 4) -> DataFrame:
    """Adds accepted: whether a round's few fixes are the last that are needed. rounds: (book_id, round, blockers, fixes, clean,
    fixes_done).

    Accepted are rounds from the second on, without blockers, with 1 to AUDIT_MAX_FIX fixes, at most AUDIT_SLACK findings above
    the best round before, after a clean validation, while fixing rounds are left.
    """
    own = running_best(rounds.withColumn("_found", F.col("blockers") + F.col("fixes")), "book_id", "round", "_found")
    few = (F.col("blockers") == 0) & F.col("fixes").between(1, C.AUDIT_MAX_FIX) & F.coalesce(F.col("_found") <= F.col("best_before") + C.AUDIT_SLACK, F.lit(False))
    return own.withColumn("accepted", few & (F.col("round") >= 2) & F.col("clean") & (F.col("fixes_done") < max_fixes)).drop("_found")


# What error messages say of their class, in order, and the states that an incident speaks of.
ERROR_CUES = [
    ("authentication_failure", ["not logged in", "authentication", "unauthorized", "invalid api key", "401"]),
    ("rate_limit", ["rate limit", "rate_limit", "too many requests", "429", "overloaded", "usage limit"]),
    ("backend_unavailable", ["backend unavailable", "cli not found", "not found on path", "connection refused", "service unavailable", "503"]),
]
QA_STATES, AUDIT_STATES, SAFE_STATES = ["qa_sweep", "qa_adjudicating", "retranscribing"], ["auditing", "fixing"], ["ready", "contributing", "done"]
GROWTH_FLOOR, GROWTH_LEAST = 20 * 60, 60

#: Limits that classify_incidents takes; 0 sets no limit. Times are seconds.
POLICY = {"stale_after": 900, "no_progress_after": 3600, "max_seconds": 14_400, "max_tokens": 0, "max_cost": 0.0, "growth": 0.0, "max_repeats": 3}


def open_run_incidents(runs: DataFrame, books: DataFrame, now: Column, policy: dict) -> DataFrame:
    """(book_id, kind, stage, run) of each book's first open run: no process, no heartbeat, no progress, or beyond a limit, be it a
    fixed one or what the stage's successes ever needed, times the growth factor."""
    p = POLICY | policy
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    cost = F.when(F.col("cost_reported"), F.struct(F.col("cost_usd").alias("cost"), F.lit("reported").alias("kind"))).when(F.col("estimate_complete") & F.col("estimated_cost").isNotNull(), F.struct(F.col("estimated_cost").alias("cost"), F.lit("estimated").alias("kind")))
    own = runs.withColumn("_cost", cost)
    first = own.where("finished_at IS NULL").groupBy("book_id").agg(F.min_by(F.struct("id", "stage", "started_at", "heartbeat_at", "progress_at", "tokens", "_cost"), "id").alias("o")).select("book_id", "o.*")
    good = own.where("finished_at IS NOT NULL AND ok")
    long, many = good.groupBy("book_id", "stage").agg(F.max(seconds(F.col("started_at"), F.col("finished_at"))).alias("s0"), F.max("tokens").alias("t0")), good.where("_cost IS NOT NULL").groupBy("book_id", "stage", F.col("_cost.kind").alias("kind0")).agg(F.max("_cost.cost").alias("c0"))
    both = first.withColumn("kind0", F.col("_cost.kind")).join(long, ["book_id", "stage"], "left").join(many, ["book_id", "stage", "kind0"], "left")
    both = both.join(books.select(F.col("id").alias("book_id"), "runtime_active", "process_alive"), "book_id")
    elapsed, grown = seconds(F.col("started_at"), now), lambda x, base: F.lit(p["growth"] > 1) & (x > base * p["growth"])
    late = lambda ts, limit: F.lit(limit > 0) & (seconds(F.col(ts), now) > limit)
    rules = {
        "missing_process": ~F.col("runtime_active") | (F.col("process_alive") == F.lit(False)),
        "stale_heartbeat": late("heartbeat_at", p["stale_after"]),
        "no_progress": late("progress_at", p["no_progress_after"]),
        "duration_limit": late("started_at", p["max_seconds"]) | ((F.col("s0") >= GROWTH_LEAST) & (elapsed >= GROWTH_FLOOR) & grown(elapsed, F.col("s0"))),
        "token_limit": (F.lit(p["max_tokens"] > 0) & (F.col("tokens") >= p["max_tokens"])) | ((F.col("t0") > 0) & grown(F.col("tokens"), F.col("t0"))),
        "cost_limit": (F.lit(p["max_cost"] > 0) & (F.col("_cost.cost") >= p["max_cost"])) | ((F.col("c0") > 0) & grown(F.col("_cost.cost"), F.col("c0"))),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return both.select("book_id", F.explode(found).alias("kind"), "stage", F.col("id").alias("run"))


def failure_incidents(runs: DataFrame, books: DataFrame, repeats: int) -> DataFrame:
    """(book_id, kind, stage, run) where the last run of the book's stage failed with a message: its class, else a repeated error if
    the runs before it failed with the same fingerprint, else unclassified."""
    own = runs.where("NOT superseded").join(books.select(F.col("id").alias("book_id"), F.col("state").alias("stage")), ["book_id", "stage"])
    own = own.withColumn("_f", F.when(F.coalesce("error", F.lit("")) != "", error_fingerprint(F.col("error"))))
    last = own.groupBy("book_id").agg(F.max_by(F.struct("id", "stage", "error", "ok"), "id").alias("l")).where("l.ok = false AND coalesce(l.error, '') <> ''")
    tail = trailing_run(own, "book_id", "id", "_f")
    known = first_class(F.col("l.error"), ERROR_CUES, "")
    kind = F.when(known != "", known).when(F.col("n") >= repeats, "repeated_error").otherwise("unclassified")
    return last.join(tail, "book_id").select("book_id", kind.alias("kind"), F.col("l.stage").alias("stage"), F.col("l.id").alias("run"))


def convergence_incidents(runs: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, kind, stage, run): sweeps whose last three findings are equal, and audits since the last pass whose last findings
    are no fewer and no milder than those before."""
    done = runs.where("NOT superseded AND ok").join(books.select(F.col("id").alias("book_id"), "state"), "book_id")
    sweeps = done.where((F.col("stage") == "qa_sweep") & F.col("state").isin(*QA_STATES))
    same = trailing_run(sweeps, "book_id", "id", "findings").where("n >= 3").join(sweeps.groupBy("book_id").agg(F.max("id").alias("run")), "book_id")
    audits = done.where((F.col("stage") == "auditing") & F.col("state").isin(*AUDIT_STATES))
    passed = audits.where("passed").groupBy("book_id").agg(F.max("id").alias("_p"))
    since_pass = audits.where("NOT coalesce(passed, false) AND fix IS NOT NULL").join(passed, "book_id", "left").where("_p IS NULL OR id > _p")
    w = Window.partitionBy("book_id").orderBy("id")
    before = since_pass.withColumn("_b", F.lag(F.struct("blocker", "fix")).over(w)).withColumn("_r", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("id")))).where("_r = 1 AND _b IS NOT NULL")
    flat = before.where((F.col("blocker") >= F.col("_b.blocker")) & (F.col("blocker") + F.col("fix") >= F.col("_b.blocker") + F.col("_b.fix")))
    return same.select("book_id", F.lit("qa_non_converging").alias("kind"), F.lit("qa_sweep").alias("stage"), "run").unionByName(flat.select("book_id", F.lit("audit_non_converging").alias("kind"), F.lit("auditing").alias("stage"), F.col("id").alias("run")))


def parked_incidents(runs: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, kind, stage, run) of books that need attention for a known reason, with the last run of their stage, 0 if none."""
    parked = books.where("status = 'needs_attention' AND coalesce(park_code, '') <> ''").select(F.col("id").alias("book_id"), F.col("state").alias("stage"))
    last = runs.where("NOT superseded").groupBy("book_id", "stage").agg(F.max("id").alias("run"))
    return parked.join(last, ["book_id", "stage"], "left").select("book_id", F.lit("parked_recovery").alias("kind"), "stage", F.coalesce("run", F.lit(0)).alias("run"))


def idle_incidents(books: DataFrame) -> DataFrame:
    """(book_id, kind, stage, run) of books beside which agents idle: fewer books than slots while others wait, or fewer calls than
    the book may make while it has work for more."""
    slots = (F.col("agent_capacity") > 0) & (F.col("agent_active") < F.col("agent_capacity")) & (F.col("eligible_books") > 0)
    calls = F.col("fans_out") & F.col("runtime_active") & (F.col("book_calls") > 0) & (F.col("book_calls") < F.col("most_book_calls")) & (F.col("calls") < F.col("call_capacity")) & (F.col("remaining_units") > F.col("book_calls"))
    return books.where(slots | calls).select(F.col("id").alias("book_id"), F.lit("slot_inefficiency").alias("kind"), F.lit("").alias("stage"), F.lit(0).cast("long").alias("run"))


def classify_incidents(books: DataFrame, runs: DataFrame, artifacts: DataFrame, now: Column, policy: dict | None = None) -> DataFrame:
    """(book_id, kind, stage, run, protected): all sixteen kinds, each once for a book, stage and run.

    books: (id, state, status, park_code, runtime_active, process_alive, agent_active, agent_capacity, eligible_books, fans_out,
    book_calls, most_book_calls, calls, call_capacity, remaining_units); runs: (id, book_id, stage, started_at, finished_at, ok,
    superseded, error, heartbeat_at, progress_at, tokens, cost_usd, cost_reported, estimated_cost, estimate_complete, findings,
    blocker, fix, passed); artifacts: (book_id, stage, run, valid). Incidents of paused books, and artifacts of finished ones, are
    protected.
    """
    policy = POLICY | (policy or {})
    found = open_run_incidents(runs, books, now, policy).unionByName(failure_incidents(runs, books, policy["max_repeats"])).unionByName(convergence_incidents(runs, books)).unionByName(parked_incidents(runs, books))
    found = found.unionByName(artifacts.where("NOT valid").select("book_id", F.lit("artifact_invalid").alias("kind"), "stage", "run")).unionByName(idle_incidents(books))
    own = found.distinct().join(books.select(F.col("id").alias("book_id"), "status", "state"), "book_id")
    protected = (F.col("status") == "paused") | ((F.col("kind") == "artifact_invalid") & F.col("state").isin(*SAFE_STATES))
    return own.select("book_id", "kind", "stage", "run", protected.alias("protected"))


# What to do about a kind of incident, and about a parked book by the code it was parked with.
ACTIONS = {
    "missing_process": "terminate_requeue", "stale_heartbeat": "terminate_requeue", "duration_limit": "stop_budget", "token_limit": "stop_budget", "cost_limit": "stop_budget", "rate_limit": "readmit",
    "slot_inefficiency": "reallocate", "qa_non_converging": "observe", "audit_non_converging": "observe", "authentication_failure": "park_escalate", "repeated_error": "park_escalate",
}
PARK_ACTIONS = {
    "agent_unavailable": "readmit", "agent_rate_limited": "readmit", "qa_no_converge": "retry", "fix_loop_exhausted": "retry", "agent_validation_exhausted": "retry", "spelling_gate_failure": "retry", "supervisor_budget": "retry",
}
CAPPED, RECOVERIES = ["retry", "readmit", "requeue", "terminate_requeue", "supersede_rerun"], ["retry", "readmit", "supersede_rerun", "requeue", "fallback_backend"]


def decisions(incidents: DataFrame, most: int, automatic: bool = True, model_assisted: bool = False, failover: bool = False) -> DataFrame:
    """Adds action, approval and automatic to incidents (kind, stage, park_code, protected, attempts, recoveries).

    After `most` attempts, and after as many recoveries of a book within the window, an action that would run paid work again gives
    way to parking, which happens at once while readmission waits for a person.
    """
    kind, code, asked = F.col("kind"), F.col("park_code"), F.lit(model_assisted)
    table = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    parked = kind == "parked_recovery"
    ask = F.when(asked, "ask_model").otherwise("park_escalate")
    of_park = F.coalesce(table(PARK_ACTIONS, code), F.when(code == "supervisor_escalated", F.when(asked, "ask_model").otherwise("retry")).when(code.isin("markers_not_confident", "manifest_changed"), ask).otherwise("observe"))
    contained = (F.col("stage") == "contributing") | F.col("protected")
    of_kind = F.coalesce(table(ACTIONS, kind), F.when(kind == "backend_unavailable", F.lit("fallback_backend" if failover else "park_escalate")).when(kind == "artifact_invalid", F.when(contained, "park_escalate").otherwise("supersede_rerun")).otherwise(ask))
    out = incidents.withColumn("_a", F.when(parked, of_park).otherwise(of_kind))
    approval = (F.col("_a") == "park_escalate") | (parked & (F.col("_a") == "observe"))
    spent = (F.col("attempts") >= most) & F.when(parked, F.col("_a") != "observe").otherwise(F.col("_a").isin(*CAPPED))
    capped = F.lit(most > 0 and automatic) & (F.col("recoveries") >= most) & F.col("_a").isin(*RECOVERIES) & ~F.col("protected")
    out = out.withColumn("_s", spent | capped).withColumn("approval", approval | F.col("_s")).withColumn("action", F.when(F.col("_s"), "park_escalate").otherwise(F.col("_a")))
    at_once = ~F.col("approval") | ((F.col("action") == "park_escalate") & (kind != "no_progress"))
    return out.withColumn("automatic", F.lit(automatic) & ~F.col("protected") & ~F.col("action").isin("observe", "ask_model") & at_once).drop("_a", "_s")


def decide(incidents: DataFrame, table: DataFrame, recoveries: DataFrame, cap: int, *keep: str) -> DataFrame:
    """(book_id, kind, action): the table's action for the kind, or "escalate" where the book's recoveries reach the cap."""
    own = incidents.join(table, "kind", "left").join(recoveries, "book_id", "left")
    action = F.when(F.coalesce("recoveries", F.lit(0)) >= cap, F.lit("escalate")).otherwise(F.coalesce("action", F.lit("observe")))
    return own.select(*keep, "book_id", "kind", action.alias("action"))


def finding_counts(findings: DataFrame, key: str = "book_id") -> DataFrame:
    return findings.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("blocker", "fix", "nit")])


def restart_recoverable(code: Column, message: Column, codes: list[str], cues: list[str]) -> Column:
    return F.coalesce(code.isin(*codes), F.lit(False)) | F.exists(F.array(*map(F.lit, cues or ["\0"])), lambda c: F.contains(F.lower(F.coalesce(message, F.lit(""))), c))


def chapters_of(progress: DataFrame, stages: list[str]) -> DataFrame:
    return progress.where(F.col("stage").isin(*stages)).groupBy("book_id").agg(F.max("total").alias("chapters"))


def total_units(kind: Column, total: Column, chapters: Column, hours: Column) -> Column:
    """Units of a stage by kind, through the fallbacks that it has."""
    return F.coalesce(F.when(total > 0, total.cast("double")), F.when(kind == "chapter", F.coalesce(chapters, F.lit(C.DEFAULT_CHAPTERS))).when(kind == "chunk", F.lit(C.DEFAULT_CHUNKS)).when(kind == "hour", hours).cast("double"), F.lit(1.0))


def success_baseline(runs: DataFrame) -> DataFrame:
    """(stage, seconds, tokens, cost): high-water marks of successes; cost where it is comparable."""
    from .ledger import known_cost

    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return runs.where("ok AND NOT superseded").groupBy("stage").agg(F.max(seconds).alias("seconds"), F.max(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.max(known_cost()).alias("cost"))


def not_improving(rounds: DataFrame, key: str, order: str, found: str, passed: str) -> DataFrame:
    """Rows whose count is no lower than the one before, counted anew after each pass."""
    w = Window.partitionBy(key).orderBy(order)
    own = rounds.withColumn("_p", F.sum(F.col(passed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    v = Window.partitionBy(key, F.coalesce("_p", F.lit(0))).orderBy(order)
    return own.withColumn("_b", F.lag(found).over(v)).where(F.col(found) >= F.col("_b")).drop("_p", "_b")


def asr_order(books: DataFrame, retranscribing: str = "retranscribing") -> DataFrame:
    """Waiting books in the order of their turn: repairs first, then by place in the series, then by id."""
    return series_rank(books).orderBy(F.col("state") != retranscribing, "rank", "id")


def asr_partition(books: DataFrame, retranscribing: str = "retranscribing") -> tuple[DataFrame, DataFrame]:
    """(books whose repairs wait, books that wait for their first transcript)."""
    again = F.col("state") == retranscribing
    return books.where(again), books.where(~again)


def queue_payload(snapshot: DataFrame, buckets: list[str]) -> DataFrame:
    """A snapshot (bucket, place, lane, id) in the order in which it is shown."""
    return snapshot.orderBy(F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket")), "lane", "place", "id")


def can_start(status: Column, owns_lock: Column, lane_free: Column) -> Column:
    return (status == "queued") & owns_lock & (lane_free > 0)


def remaining_path(books: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, stage, step): the stages ahead of each book's state. paths: (state, stage, step), a walk of the state table done once."""
    return books.select("id", "state").join(paths, "state").select("id", "stage", "step")


def mainline(transitions: DataFrame) -> DataFrame:
    """(state, next): the last successor declared. transitions: (state, outcome, next, pos)."""
    return transitions.groupBy("state").agg(F.max_by("next", "pos").alias("next"))


def earliest_finish(running: DataFrame, lane: str = "lane") -> DataFrame:
    return running.groupBy(lane).agg(F.min("finish_at").alias("finish_at"))
