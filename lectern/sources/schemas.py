"""The ledger's tables: their columns by version, and how an older table is read as a newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that each version added to a table, in order.
VERSIONS: dict[str, list[str]] = {
    "books": ["id long, source_path string, title string, author string, series string, series_pos string, state string, status string, created_at timestamp", "error string, park_code string, retry_at timestamp", "batch_id long, work_id string"],
    "runs": ["id long, book_id long, stage string, attempt int, started_at timestamp, finished_at timestamp, ok boolean", "tokens_in long, tokens_out long, tokens_cached long, cost_usd double, cost_reported boolean, model string", "estimated_cost double, estimate_complete boolean, superseded boolean, heartbeat_at timestamp, progress_at timestamp"],
    "progress": ["book_id long, stage string, done int, total int, updated_at timestamp"],
    "rates": ["stage string, rate double, updated_at timestamp"],
    "settings": ["key string, value string"],
    "events": ["id long, ts timestamp, book_id long, type string, payload string"],
    "invocations": ["id long, book_id long, stage_run_id long, stage string, work_unit string, backend string, model string, status string, active boolean, heartbeat_at timestamp", "tokens_in long, tokens_out long, tokens_cached long, cost_usd double, cost_reported boolean, estimate_complete boolean"],
    "contributions": ["id long, book_id long, kind string, status string, pr_number int, pr_url string, note string, created_at timestamp, updated_at timestamp"],
    "overrides": ["source_path string, hidden boolean, force_audio boolean, work_id string"],
    "batches": ["id long, name string, created_at timestamp"],
}


def schema_of(table: str, version: int | None = None) -> str:
    """The columns of a table as of a version; the newest without one."""
    return ", ".join(VERSIONS[table][:version])


def migrate(df: DataFrame, table: str) -> DataFrame:
    """df with the newest version's columns, in order and type: those that it lacks are null, and those that no version has are an
    error. Migrating twice changes nothing."""
    wanted = df.sparkSession.createDataFrame([], schema_of(table)).schema
    if extra := set(df.columns) - set(wanted.names):
        raise ValueError(f"{table}: unknown columns {sorted(extra)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def open_ledger(spark: SparkSession, root: str, *tables: str) -> dict[str, DataFrame]:
    """The tables below root, Parquet folders that files of several versions may lie in, each as its newest version."""
    return {t: migrate(spark.read.option("mergeSchema", True).parquet(f"{root}/{t}"), t) for t in tables}
