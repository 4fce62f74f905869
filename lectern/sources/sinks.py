"""Writers of layers, reports and logs. The raw layer is never written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW_LAYER = "raw"


def guard(path: str) -> str:
    if path.rstrip("/").rsplit("/", 1)[-1] == RAW_LAYER:
        raise ValueError("the raw layer is read-only")
    return path


def write_normalised(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").json(guard(path))


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder a chapter, written by as many tasks as there are partitions of chapters."""
    texts.select("chapter", F.col("text").alias("value")).write.mode("overwrite").partitionBy("chapter").text(guard(path))


def write_atomic(spark, path: str, data: bytes) -> None:
    """A small file from the driver, in any store that Spark reads: written beside its place and renamed, so that nobody sees half
    of it. Tables are written by Spark's own committer."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    final, part = hadoop.Path(guard(path)), hadoop.Path(path + ".tmp")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(data)
    out.close()
    fs.delete(final, False)
    if not fs.rename(part, final):
        raise OSError(f"could not publish {path}")


def write_plan(plan, path: str) -> None:
    """The entries of a repair plan (chapter, action, start, end, ...) as JSON."""
    plan.write.mode("overwrite").json(guard(path))


def write_history(groups, path: str) -> None:
    """A report of past runs: its rows as JSON and, beside them, a table to read."""
    groups.write.mode("overwrite").json(f"{guard(path)}/history")
    markdown_table(groups, *groups.columns[:3]).write.mode("overwrite").text(f"{path}/history.md")


def append_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def merge_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Verdicts by chapter, the new ones in place of the old."""
    both = old.withColumn("_s", F.lit(0)).unionByName(new.withColumn("_s", F.lit(1)))
    rest = [c for c in old.columns if c != "chapter"]
    return both.groupBy("chapter").agg(F.max_by(F.struct(*rest), "_s").alias("x")).select("chapter", "x.*").orderBy("chapter")


def python_repr(text: Column) -> Column:
    """A text as Python quotes it; exact by construction."""
    import pandas as pd

    def own(s):
        return s.map(lambda x: None if x is None else repr(x))

    own.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(own, "string")(text)


def bullet_list(findings: DataFrame, key: str, line: Column) -> DataFrame:
    """(key, markdown): the findings of a key as a list, in order of their lines."""
    return findings.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat(F.lit("- "), x)), "\n").alias("markdown"))


def report_json(findings: dict[str, DataFrame]) -> DataFrame:
    """(detector, finding): every finding as JSON, to be written by detector."""
    out = None
    for name, df in findings.items():
        one = df.select(F.lit(name).alias("detector"), F.to_json(F.struct(*df.columns)).alias("finding"))
        out = one if out is None else out.unionByName(one)
    return out


def write_report(findings: dict[str, DataFrame], path: str) -> None:
    report_json(findings).write.mode("overwrite").partitionBy("detector").text(guard(path))


def validation_report(problems: DataFrame) -> DataFrame:
    """One row: clean, errors and warnings of (severity, text)."""
    take = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.col("text"))))
    return problems.agg((F.count_if(F.col("severity") == "error") == 0).alias("clean"), take("error").alias("errors"), take("warning").alias("warnings"))


def canonical_json(df: DataFrame) -> Column:
    """JSON of all columns with keys in order."""
    return F.to_json(F.struct(*sorted(df.columns)))


def sse_frame(id_col: str = "id", type_col: str = "type", data_col: str = "data", durable: Column | None = None) -> Column:
    """An event as a server-sent frame; only durable ones carry an id."""
    head = F.when(durable if durable is not None else F.lit(True), F.concat(F.lit("id: "), F.col(id_col).cast("string"), F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("event: "), F.col(type_col), F.lit("\ndata: "), F.col(data_col), F.lit("\n\n"))


def persist_snapshot(jobs: DataFrame, path: str) -> None:
    """The newest finished job's rows."""
    newest = jobs.where("status = 'done'").agg(F.max("seq").alias("seq"))
    jobs.join(F.broadcast(newest), "seq").write.mode("overwrite").parquet(guard(path))


def markdown_table(df: DataFrame, *order: str) -> DataFrame:
    """One row: a table of all rows in order. For reports, whose rows are few."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    lines = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], cells.alias("_line")))), lambda x: x["_line"]), "\n").alias("l"))
    return lines.select(F.concat(F.lit(head), "l").alias("markdown"))


def correction_log(totals: DataFrame) -> DataFrame:
    """One row: rules with their counts, most used first."""
    line = F.concat(F.col("count").cast("string"), F.lit("\t"), F.col("pattern"))
    return totals.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("pattern").alias("p"), line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))


def sheets(shown: DataFrame) -> DataFrame:
    """(end, markdown): a sheet for each chunk end from (end, name)."""
    return bullet_list(shown, "end", F.col("name"))
