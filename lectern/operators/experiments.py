"""Prices, experiment reports, quality scores, sidecar rules, and the views a client derives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost and known: the price of (backend, model), else of (backend, "*"), per million tokens; unknown without one.

    prices: (backend, model, input, output, cached), a table of a few rows.
    """
    p = prices.select("backend", "model", F.struct("input", "output", "cached").alias("p"))
    exact, any_ = p.withColumnRenamed("p", "p1"), p.where("model = '*'").select("backend", F.col("p").alias("p2"))
    own = usage.join(exact, ["backend", "model"], "left").join(any_, "backend", "left").withColumn("_p", F.coalesce("p1", "p2"))
    cost = (F.col("tokens_in") * F.col("_p.input") + F.col("tokens_out") * F.col("_p.output") + F.col("tokens_cached") * F.col("_p.cached")) / 1e6
    return own.withColumn("cost", cost).withColumn("known", F.col("_p").isNotNull()).drop("p1", "p2", "_p")


def elapsed(start: Column, finish: Column) -> Column:
    """Seconds between two timestamp texts; 0 if either is missing, malformed or the span negative."""
    return F.coalesce(F.greatest(F.unix_micros(F.try_to_timestamp(finish)) - F.unix_micros(F.try_to_timestamp(start)), F.lit(0)) / 1e6, F.lit(0.0))


def profile_report(runs: DataFrame) -> DataFrame:
    """One row a profile of runs (profile, wall_seconds, completed, recall, clean, holdouts, passed, invocations: array of
    (tokens_in, tokens_out, cost, known)): medians, means, sums, completeness and the hard gate."""
    inv = F.col("invocations")
    sum_ = lambda f: F.aggregate(inv, F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))
    own = runs.withColumns({"_in": sum_(lambda x: x["tokens_in"].cast("double")), "_out": sum_(lambda x: x["tokens_out"].cast("double")), "_cost": sum_(lambda x: x["cost"]), "_known": F.forall(inv, lambda x: F.coalesce(x["known"], F.lit(False)) | (F.coalesce(x["tokens_in"], F.lit(0)) + F.coalesce(x["tokens_out"], F.lit(0)) == 0))})
    return own.groupBy("profile").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("completed").alias("completed"), F.median(F.when(F.col("completed"), F.col("wall_seconds"))).alias("median_wall"), F.avg("recall").alias("mean_recall"),
        F.sum("_in").alias("tokens_in"), F.sum("_out").alias("tokens_out"), F.when(F.bool_and("_known"), F.sum("_cost")).alias("cost"), F.bool_and("_known").alias("cost_complete"),
        (F.bool_and(F.col("completed") & F.col("clean")) & (F.sum("holdouts") > 0) & (F.sum("passed") == F.sum("holdouts"))).alias("hard_gate"),
    )


def _skyline(block: str, signs: dict[str, int]):
    """A function from a table of points to those that none of their block dominates."""
    import numpy as np

    def of(pdf):
        kept = []
        for _, own in pdf.groupby(block, dropna=False, sort=False):
            x = np.stack([own[c].to_numpy(dtype=float) * s for c, s in signs.items()], axis=1)
            best: list[int] = []
            for i in np.argsort(x.sum(axis=1), kind="stable"):  # what dominates a point comes before it
                front = x[best]
                if not len(best) or not ((front <= x[i]).all(axis=1) & (front < x[i]).any(axis=1)).any():
                    best.append(i)
            kept.append(own.iloc[best])
        import pandas as pd

        return pd.concat(kept) if kept else pdf

    return of


def pareto(points: DataFrame, low: list[str], high: list[str], block: str | None = None, gate: Column | None = None, unknown: str | None = None) -> DataFrame:
    """The points that none dominates, that is, as good in every measure and better in one. Only points that pass the gate count.

    unknown: a measure that may be null. A point that has it is compared with such points only; one that lacks it is compared with
    all, in the other measures. Points with another null measure are left out. Partitions keep their own skylines, which are
    few points, before a block's skylines meet; then points are looked up by their measures.
    """
    name = block or "_block"
    own = points if gate is None else points.where(F.coalesce(gate, F.lit(False)))
    own = own if block else own.withColumn("_block", F.lit(0))
    signs = {c: 1 for c in low} | {c: -1 for c in high}
    own = own.where(" AND ".join(f"{c} IS NOT NULL" for c in signs if c != unknown))

    def front(rows: DataFrame, measures: dict[str, int]) -> DataFrame:
        values = rows.select(name, *measures).distinct()
        local = values.mapInPandas(lambda batches: map(_skyline(name, measures), batches), values.schema)
        return local.groupBy(name).applyInPandas(_skyline(name, measures), values.schema)

    def kept(rows: DataFrame, best: DataFrame, measures: dict[str, int]) -> DataFrame:
        return rows.join(best.distinct(), [name, *measures], "left_semi")

    known = own if unknown is None else own.where(F.col(unknown).isNotNull())
    out = kept(known, front(known, signs), signs)
    if unknown is not None:
        rest = {c: s for c, s in signs.items() if c != unknown}
        out = out.unionByName(kept(own.where(F.col(unknown).isNull()), front(own, rest), rest))
    return out if block else out.drop("_block")


def history(runs: DataFrame) -> DataFrame:
    """(stage, backend, model): runs, completed, failed, mean seconds of completed ones."""
    return runs.groupBy("stage", "backend", "model").agg(F.count(F.lit(1)).alias("runs"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"), F.avg(F.when(F.col("ok"), F.col("seconds"))).alias("mean_seconds"))


def recall(found: Column, reference: Column) -> Column:
    """0 on an empty reference."""
    return F.coalesce(F.size(F.array_intersect(found, reference)) / F.nullif(F.size(F.array_distinct(reference)), F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """1 on two empty sets."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(1.0))


def unique_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def quality(found_names: Column, names: Column, found_recaps: Column, recaps: Column) -> Column:
    """struct(names, recall, jaccard, recap_jaccard): how near a result's names and recaps come to the accepted ones."""
    return F.struct(F.size(F.array_distinct(found_names)).alias("names"), recall(found_names, names).alias("recall"), jaccard(found_names, names).alias("jaccard"), jaccard(found_recaps, recaps).alias("recap_jaccard"))


def done_books(books: DataFrame) -> DataFrame:
    """Finished books, the last finished first."""
    return books.where("status = 'done'").orderBy(F.desc_nulls_last("finished_at"), F.desc("id"))


def experiment_plan(profiles: DataFrame, cases: DataFrame, repeats: int, seed: int) -> DataFrame:
    """(profile, case, repeat, place): every combination of a suite, a few dozen rows, in an order drawn by the seed."""
    plan = profiles.select("profile").join(F.broadcast(cases.select("case")), F.lit(True)).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return plan.withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), "profile", "case", "repeat"), "profile", "case", "repeat")))


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of (path, content) rows, in order of path."""
    own = files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    return own.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat(x["path"], F.lit("\0"), x["h"])), "\n"), 256).alias("digest"))


def violations(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """(key, rule): each rule that a row breaks."""
    found = F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("rule"))


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key)


def chapter_in_range(chapter: Column, n: Column) -> Column:
    return chapter.between(F.lit(0), n)


def merge_views(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "full")


# Client-side views -----------------------------------------------------------------------------


def token_search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose columns, together, contain every word of the query."""
    hay = F.lower(F.concat_ws(" ", *columns))
    for token in query.lower().split():
        rows = rows.where(F.contains(hay, F.lit(token)))
    return rows


def series_gaps(books: DataFrame, selected: Column) -> DataFrame:
    """(series,) where an unselected position lies below the first selected one."""
    own = books.where(F.coalesce("series", F.lit("")) != "").groupBy("series").agg(F.min(F.when(selected, F.col("pos"))).alias("a"), F.min(F.when(~selected, F.col("pos"))).alias("b"))
    return own.where(F.col("b") < F.col("a")).select("series")


def tally(results: DataFrame) -> DataFrame:
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("created", "duplicate", "failed")])


def coverage_state(work: Column, covered: Column, failed: Column) -> Column:
    return F.when(failed, "unknown").when(work.isNull(), "unmatched").when(covered, "covered").otherwise("missing")


def coverage_filter(books: DataFrame, exclude_covered: bool, include_hidden: bool = False) -> DataFrame:
    """Books to choose from (hidden, state): hidden ones only if asked for, covered ones unless they are not."""
    own = books if include_hidden else books.where("NOT coalesce(hidden, false)")
    return own.where("state <> 'covered'") if exclude_covered else own


def series_sort(books: DataFrame) -> DataFrame:
    return books.orderBy(F.coalesce("series", F.lit("")) == "", F.lower("series"), F.asc_nulls_last("pos"), F.lower("title"), "path")


def run_seconds(started: Column, finished: Column) -> Column:
    s = (F.unix_micros(finished) - F.unix_micros(started)) / 1e6
    return F.when(s >= 0, s)


def total_cost(runs: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, cost): finite costs summed."""
    return cost_summary(runs, key).select(key, "cost")


def cost_summary(runs: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, cost, estimated, incomplete): finite costs summed; flags stick."""
    finite = F.when(~F.isnan("cost_usd"), F.col("cost_usd"))
    return runs.groupBy(key).agg(F.coalesce(F.sum(finite), F.lit(0.0)).alias("cost"), F.bool_or(~F.col("cost_reported")).alias("estimated"), F.bool_or(F.col("cost_usd").isNull() & (F.coalesce("tokens_in", F.lit(0)) > 0)).alias("incomplete"))


def spend_runs(runs: DataFrame) -> DataFrame:
    return runs.where("coalesce(cost_usd, 0) > 0 OR coalesce(tokens_in, 0) > 0 OR coalesce(tokens_out, 0) > 0")


def timeline(stages: DataFrame, at: int) -> DataFrame:
    """stages (stage, stage_order) with place: done, current or ahead."""
    return stages.withColumn("place", F.when(F.col("stage_order") < at, "done").when(F.col("stage_order") == at, "current").otherwise("ahead"))


def sections(books: DataFrame, order: list[str]) -> DataFrame:
    """(section, ids) in the fixed order of sections."""
    own = books.groupBy("section").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return own.withColumn("_o", F.array_position(F.array(*map(F.lit, order)), F.col("section"))).where("_o > 0").orderBy("_o").drop("_o")


def board_sort(books: DataFrame, statuses: list[str]) -> DataFrame:
    return books.orderBy(F.array_position(F.array(*map(F.lit, statuses)), F.col("status")), F.lower("series"), F.asc_nulls_last("pos"), "id")


def story_rows(recaps: DataFrame, summary: DataFrame, ending: DataFrame) -> DataFrame:
    """(place, chapter, text): the summary, recaps by chapter, the ending."""
    own = lambda df, place, chapter: df.select(F.lit(place).alias("place"), chapter.alias("chapter"), "text")
    return own(summary, 0, F.lit(None).cast("int")).unionByName(own(recaps, 1, F.col("chapter").cast("int"))).unionByName(own(ending, 2, F.lit(None).cast("int"))).orderBy("place", "chapter")


def log_line(events: DataFrame) -> DataFrame:
    """Adds line: one text an event by its type, from its JSON payload."""
    get = lambda k: F.get_json_object("payload", f"$.{k}")
    line = F.when(F.col("type") == "state", F.format_string("state %s", get("state"))).when(F.col("type") == "progress", F.format_string("%s %s/%s", get("stage"), get("done"), get("total"))).when(F.col("type") == "error", F.format_string("error: %s", get("message"))).otherwise(F.col("type"))
    return events.withColumn("line", line)


def verified_rows(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'verified'").select("pos", "canonical", "type", "variants").orderBy("pos")


# What sidecar files must hold. Caps are in code points.
DESCRIPTION_CAP, RECAP_CAP, SHORT_CAP, ENDING_CAP = 1500, 3000, 1500, 2000
SIDECAR_LICENSE, SIDECAR_SOURCES = "CC-BY-SA-3.0", ["community"]
ROLES, SCOPES = ["protagonist", "antagonist", "supporting", "minor"], ["book", "series"]
DASH = "\u2014"


def is_slug(column: Column) -> Column:
    """Lower-case words and digits with single hyphens between."""
    return F.coalesce(column, F.lit("")).rlike("^[a-z0-9]+(-[a-z0-9]+)*$")


def _blank(column: str) -> Column:
    return F.trim(F.coalesce(column, F.lit(""))) == ""


def _later(rows: DataFrame, column: str, name: str, key: str, where: Column) -> DataFrame:
    """(key, rule) of rows that repeat the value of one before them."""
    again = F.row_number().over(Window.partitionBy(column).orderBy(key)) > 1
    return rows.where(where).withColumn("_again", again).where("_again").select(key, F.lit(name).alias("rule"))


def character_problems(characters: DataFrame, chapters: int, key: str = "pos") -> DataFrame:
    """(key, rule) of a file's characters (id, name, role, description, reveal, aliases, wikidata)."""
    rules = {
        "id_slug": ~is_slug(F.col("id")),
        "name_blank": _blank("name"),
        "role_unknown": (F.col("role") != "") & ~F.col("role").isin(*ROLES),
        "reveal_range": ~chapter_in_range(F.col("reveal"), F.lit(chapters)),
        "description_blank": _blank("description"),
        "description_long": F.length("description") > DESCRIPTION_CAP,
        "description_dash": F.contains(F.col("description"), F.lit(DASH)),
        "alias_blank": F.exists("aliases", lambda a: F.trim(a) == ""),
        "wikidata_id": (F.col("wikidata") != "") & ~F.col("wikidata").rlike("^Q[0-9]+$"),
    }
    return violations(characters, rules, [key]).unionByName(_later(characters, "id", "id_repeated", key, is_slug(F.col("id"))))


def recap_problems(recaps: DataFrame, chapters: int, key: str = "pos") -> DataFrame:
    """(key, rule) of a file's recaps (through, text, scope)."""
    rules = {
        "through_range": ~chapter_in_range(F.col("through"), F.lit(chapters)),
        "text_blank": _blank("text"),
        "text_long": F.length("text") > RECAP_CAP,
        "text_dash": F.contains(F.col("text"), F.lit(DASH)),
        "scope_unknown": (F.col("scope") != "") & ~F.col("scope").isin(*SCOPES),
    }
    return violations(recaps, rules, [key]).unionByName(_later(recaps, "through", "through_repeated", key, F.lit(True)))


def sidecar_file_problems(files: DataFrame, key: str = "pos") -> DataFrame:
    """(key, rule) of files (work, license, sources, entries, in_short, ending, opener, series_recap): what holds for a file as a
    whole. series_recap_missing is a warning, the others are errors."""
    rules = {
        "work_slug": ~is_slug(F.col("work")),
        "license": ~F.col("license").eqNullSafe(F.lit(SIDECAR_LICENSE)),
        "sources": ~F.col("sources").eqNullSafe(F.array(*map(F.lit, SIDECAR_SOURCES))),
        "empty": F.col("entries") == 0,
        "in_short_long": F.length("in_short") > SHORT_CAP,
        "in_short_dash": F.contains(F.col("in_short"), F.lit(DASH)),
        "ending_long": F.length("ending") > ENDING_CAP,
        "ending_dash": F.contains(F.col("ending"), F.lit(DASH)),
        "opener_has_series_recap": F.col("opener") & F.col("series_recap"),
        "series_recap_missing": ~F.col("opener") & ~F.col("series_recap"),
    }
    return violations(files, rules, [key])
