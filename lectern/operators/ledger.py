"""Reads, roll-ups and mutations of a run ledger.

Runs have (id, book_id, stage, started_at, finished_at, ok, superseded, cost_usd, cost_reported, estimated_cost, estimate_complete,
tokens_in, tokens_out, tokens_cached, model). Tables are append-only: a change is a new row with a higher seq, and the state of
a key is its latest row. Scheduling reads leave superseded runs out; money reads keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C

# Reads ---------------------------------------------------------------------------------------


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def listed(df: DataFrame, *order, **equal) -> DataFrame:
    """The rows whose columns have the given values (any of a list), in order: point reads and lists of every ledger table."""
    for column, value in equal.items():
        df = df.where(F.col(column).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(column).eqNullSafe(value))
    return df.orderBy(*order) if order else df


def tracking(books: DataFrame) -> DataFrame:
    """What a scan needs of the queue: (source_path, id, state, status)."""
    return books.select("source_path", "id", "state", "status")


def attach_tracking(scanned: DataFrame, books: DataFrame) -> DataFrame:
    """Scanned books with the queue's row of their path, null where they are not queued."""
    return scanned.join(tracking(books), "source_path", "left")


def calls_since(calls: DataFrame, ts: str, cutoff, column: str = "calls") -> DataFrame:
    """One row: the calls from the cutoff on, 0 without any."""
    return total_or_zero(since(calls, ts, cutoff), column)


def supervisor_spend(runs: DataFrame, **equal) -> DataFrame:
    """One row (cost, unknown) of runs with the given columns: provider cost, else a complete estimate; unknown counts those that
    called a model and have neither."""
    own = listed(runs, **equal)
    cost = F.coalesce("provider_cost_usd", F.when(F.col("estimate_complete"), F.col("estimated_cost_usd")))
    return own.agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.count_if(cost.isNull() & (F.coalesce("calls", F.lit(0)) > 0)).alias("unknown"))


def insert_event(events: DataFrame) -> DataFrame:
    """Events as they are stored: a book 0 is none."""
    return events.withColumn("book_id", F.nullif("book_id", F.lit(0)))


def set_status(books: DataFrame, where: Column, status: str, error: str = "", park_code: str = "", retry_at=None) -> DataFrame:
    """UPDATE of the status with what belongs to it: an error and a park code stay only with a book that needs attention, and a
    retry time only with one that waits for it."""
    attention, parked = status == "needs_attention", status == "parked"
    return rewrite(books, where, status=F.lit(status), error=F.lit(error if attention or parked else ""), park_code=F.lit(park_code if attention else ""), retry_at=F.lit(retry_at if parked else None).cast(books.schema["retry_at"].dataType))


def total_or_zero(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def due_for_retry(books: DataFrame, now) -> DataFrame:
    return books.where((F.col("status") == "parked") & F.col("retry_at").isNotNull() & (F.col("retry_at") <= F.lit(now)))


def cost_by_book(runs: DataFrame) -> DataFrame:
    return runs.groupBy("book_id").agg(F.sum("cost_usd").alias("cost"))


def known_cost() -> Column:
    """Reported cost, else a complete estimate, else null."""
    return F.when(F.col("cost_reported"), F.col("cost_usd")).when(F.col("estimate_complete"), F.col("estimated_cost"))


def budget_cost(runs: DataFrame, *keys: str) -> DataFrame:
    """cost, unknown and complete: a run with tokens and no known cost makes a total incomplete; one without tokens doesn't."""
    used = F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0)) + F.coalesce("tokens_cached", F.lit(0)) > 0
    cost, unknown = F.coalesce(F.sum(F.coalesce(known_cost(), F.lit(0.0))), F.lit(0.0)), F.count_if(known_cost().isNull() & used)
    return runs.groupBy(*keys).agg(cost.alias("cost"), unknown.alias("unknown")).withColumn("complete", F.col("unknown") == 0)


def first_start(runs: DataFrame) -> DataFrame:
    return runs.groupBy("book_id").agg(F.min("started_at").alias("first_start"))


def count_successes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("book_id", "stage").agg(F.count_if(F.col("ok") & ~F.col("superseded")).alias("successes"), F.count(F.lit(1)).alias("runs"))


def open_runs(runs: DataFrame) -> DataFrame:
    return runs.where("finished_at IS NULL")


def runs_grouped(runs: DataFrame) -> DataFrame:
    """(book_id, runs): each book's runs in order of id."""
    return runs.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in runs.columns if c not in ("id", "book_id")]))).alias("runs"))


def succeeded_stages(runs: DataFrame) -> DataFrame:
    return runs.where("ok AND NOT superseded").groupBy("book_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))


def active_counts(invocations: DataFrame) -> DataFrame:
    """(book_id, active), and the grand total under a null book_id."""
    return invocations.where("active").rollup("book_id").agg(F.count(F.lit(1)).alias("active"))


def child_rollup(children: DataFrame, parent: str = "stage_run_id") -> DataFrame:
    """One row a parent: sums of tokens, cost only if every child reported one, completeness, the last model named, activity,
    the last heartbeat. Completeness of no children is true, by the join that follows."""
    every = F.bool_and("cost_reported")
    return children.groupBy(parent).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("tokens_cached").alias("tokens_cached"),
        F.when(every, F.sum("cost_usd")).alias("cost_usd"), F.bool_and("estimate_complete").alias("estimate_complete"),
        F.max_by("model", F.when(F.col("model") != "", F.col("id"))).alias("model"), F.bool_or("active").alias("active"), F.max("heartbeat_at").alias("heartbeat_at"),
    )


def oldest_heartbeat(children: DataFrame, parent: str = "stage_run_id") -> DataFrame:
    return children.where("active").groupBy(parent).agg(F.min("heartbeat_at").alias("oldest"))


def timings(books: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Each book's elapsed, active and ASR seconds; open runs end now, spans below 0 count 0, books without runs have 0."""
    seconds = lambda a, b: F.greatest(F.unix_micros(b) - F.unix_micros(a), F.lit(0)) / 1e6
    end = F.coalesce("finished_at", F.lit(now).cast("timestamp"))
    own = runs.groupBy("book_id").agg(
        F.min("started_at").alias("first"), F.max(end).alias("last"), F.sum(seconds(F.col("started_at"), end)).alias("active_s"),
        F.coalesce(F.sum(F.when(F.col("stage") == "asr", seconds(F.col("started_at"), end))), F.lit(0.0)).alias("asr_s"), F.count_if(F.col("finished_at").isNull()).alias("open"),
    )
    out = books.select(F.col("id").alias("book_id")).join(own, "book_id", "left")
    return out.select("book_id", F.coalesce(seconds(F.col("first"), F.col("last")), F.lit(0.0)).alias("elapsed_s"), F.coalesce("active_s", F.lit(0.0)).alias("active_s"), F.coalesce("asr_s", F.lit(0.0)).alias("asr_s"), F.coalesce("open", F.lit(0)).alias("open"))


def incident_family(runs: DataFrame, prefix: str, suffix: str) -> DataFrame:
    return runs.where(F.startswith("incident_key", F.lit(prefix)) & F.endswith("incident_key", F.lit(suffix))).agg(F.count(F.lit(1)).alias("n"))


def since(df: DataFrame, ts: str, cutoff) -> DataFrame:
    return df.where(F.col(ts) >= (cutoff if isinstance(cutoff, Column) else F.lit(cutoff)))


def batch_costs(books: DataFrame, runs: DataFrame, supervisor: DataFrame) -> DataFrame:
    """(batch_id, work_cost, book_supervision, batch_supervision, unknown): runs by book, supervisor runs with and without one."""
    work = budget_cost(runs.join(books.select(F.col("id").alias("book_id"), "batch_id"), "book_id"), "batch_id").withColumnRenamed("cost", "work_cost")
    own = supervisor.groupBy("batch_id", F.col("book_id").isNull().alias("whole")).agg(F.sum(F.coalesce("provider_cost_usd", F.lit(0.0))).alias("cost"), F.count_if(F.col("provider_cost_usd").isNull()).alias("unknown"))
    wide = own.groupBy("batch_id").agg(F.sum(F.when(~F.col("whole"), F.col("cost"))).alias("book_supervision"), F.sum(F.when(F.col("whole"), F.col("cost"))).alias("batch_supervision"), F.sum("unknown").alias("u2"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return work.join(wide, "batch_id", "full").select("batch_id", zero("work_cost").alias("work_cost"), zero("book_supervision").alias("book_supervision"), zero("batch_supervision").alias("batch_supervision"), (zero("unknown") + zero("u2")).alias("unknown"))


def unresolved_books(books: DataFrame, contributions: DataFrame) -> DataFrame:
    """Books with a merged core contribution that still carries a note."""
    left = contributions.where("kind = 'core' AND status = 'merged' AND note <> ''").select(F.col("book_id").alias("id"))
    return books.join(left, "id", "left_semi")


def page(events: DataFrame, before: int | None = None, limit: int = 100, key: str = "id") -> DataFrame:
    """The newest events before a cursor: a top-k, not a sort."""
    own = events if before is None else events.where(F.col(key) < before)
    return own.orderBy(F.desc(key)).limit(min(max(limit, 1), C.PAGE_LIMIT))


# Mutations, as derivations from appended rows ------------------------------------------------


def latest(df: DataFrame, *keys: str, seq: str = "seq") -> DataFrame:
    """The last row of each key. It combines before the shuffle, so a hot key costs no more than a cold one."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_x")).select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def append_new(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the table with the rows whose key is new, the duplicates)."""
    fresh = rows.join(table.select(key), key, "left_anti").dropDuplicates([key])
    return table.unionByName(fresh, allowMissingColumns=True), rows.join(table.select(key), key, "left_semi")


def rewrite(df: DataFrame, where: Column, **columns: Column) -> DataFrame:
    """UPDATE ... SET columns WHERE where."""
    return df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in columns.items()})


def delete_cascade(tables: dict[str, DataFrame], ids: DataFrame, parent: str = "books", key: str = "book_id") -> dict[str, DataFrame]:
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    return {n: t.join(gone, t["id" if n == parent else key] == gone["_gone"], "left_anti") for n, t in tables.items()}


def finish_runs(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """Runs with the outcome of their last finish event; without one they stay open."""
    return starts.join(latest(finishes, "id").drop("seq"), "id", "left")


def accumulate_usage(usage: DataFrame) -> DataFrame:
    """Per run: sums, sticky incompleteness, and the last model named."""
    return usage.groupBy("id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("tokens_cached").alias("tokens_cached"), F.sum("cost_usd").alias("cost_usd"), F.bool_and("estimate_complete").alias("estimate_complete"), F.max_by("model", F.when(F.col("model") != "", F.col("seq"))).alias("model"))


def touch(heartbeats: DataFrame) -> DataFrame:
    return heartbeats.groupBy("id").agg(F.max("ts").alias("heartbeat_at"), F.max(F.when(F.col("progress"), F.col("ts"))).alias("progress_at"))


def supersede(runs: DataFrame, retries: DataFrame) -> DataFrame:
    """Marks successes that began no later than the stage's last retry; their cost stays."""
    last = retries.groupBy("book_id", "stage").agg(F.max("ts").alias("_retry"))
    return runs.join(last, ["book_id", "stage"], "left").withColumn("superseded", F.col("superseded") | F.coalesce(F.col("ok") & (F.col("started_at") <= F.col("_retry")), F.lit(False))).drop("_retry")


def prune(events: DataFrame, now, days: int = C.RETENTION_DAYS) -> DataFrame:
    return events.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def meaningful_overrides(overrides: DataFrame) -> DataFrame:
    """The latest override of each path, if it says anything."""
    return latest(overrides, "source_path").where("hidden OR force_audio OR coalesce(work_id, '') <> ''")


def upsert_contributions(rows: DataFrame) -> DataFrame:
    """The latest row of each (book_id, kind), with the first created_at."""
    first = rows.groupBy("book_id", "kind").agg(F.min("created_at").alias("created_at"))
    return latest(rows.drop("created_at"), "book_id", "kind").join(first, ["book_id", "kind"])


def attach_open_run(invocations: DataFrame, runs: DataFrame) -> DataFrame:
    """Invocations with the latest open run of their book and stage."""
    open_ = runs.where("finished_at IS NULL").groupBy("book_id", "stage").agg(F.max("id").alias("stage_run_id"))
    return invocations.join(open_, ["book_id", "stage"], "left")
