"""Operators on hand-made rows, where their definition and not a query's SQL says what comes out."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import experiments, identity, intervals, ledger, numbering, qa, ranking, spelling
from lectern.sources import sinks, transcripts
from lectern.streaming import events as stream


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize(("words", "n"), [("twenty-one", 21), ("one hundred and five", 105), ("two thousand three hundred", 2300), ("zero", 0), ("twenty frogs", None), ("", None)])
def test_number_words(spark, words, n):
    assert spark.createDataFrame([(words,)], "t string").select(T.number_words(F.col("t")).alias("n")).first().n == n


def test_labels(spark):
    labels = ["Chapter 7: The Sea", "12. Dawn", "3", "Chapter Twenty One", "Prologue", "chapter 4"]
    got = spark.createDataFrame([(x,) for x in labels], "t string").select(T.label_number(F.col("t")).alias("n"), T.spoken_chapter(F.col("t")).alias("s")).collect()
    assert [r.n for r in got] == [7, 12, 3, 21, None, 4]
    assert got[3].s == 21 and got[5].s == 4 and got[4].s is None


def test_runs_skip_empty_segments(spark):
    texts = [(1, "Hi there"), (1, ""), (1, "hi, there!"), (1, "HI THERE"), (1, "bye"), (0, "x"), (0, "x"), (0, "x"), (2, "a"), (2, "a"), (3, "Amen."), (3, "amen"), (3, "Amen")]
    seg = spark.createDataFrame([(c, i, 10.0 * i, t) for i, (c, t) in enumerate(texts)], "chapter int, pos int, start double, text string")
    whole = spark.createDataFrame([(1, 100.0), (3, 115.0)], "chapter int, duration double")
    assert rows(qa.repeat_runs(seg, whole), "chapter", "first_pos", "last_pos", "n", "text", "kind") == [(1, 0, 3, 3, "Hi there", "mid"), (3, 10, 12, 3, "Amen.", "end_fade")]
    assert rows(qa.repeat_runs(seg, whole.where("chapter = 1")), "chapter", "kind") == [(1, "mid"), (3, "mid")]


def test_a_chapter_without_a_duration_counts_as_rate_0(spark):
    df = spark.createDataFrame([(i, "a b c", 60.0 if i < 12 else 0.0) for i in range(1, 13)], "chapter int, text string, duration double")
    assert rows(qa.rate_outliers(df), "chapter", "rate", "z") == [(12, 0.0, -3.18)]
    # Exactly at the bound is no outlier: eleven values, ten equal, lie 3.0151 deviations off.
    df = df.where("chapter > 1")
    z = abs(qa.rate_outliers(df, 0.0).where("chapter = 12").first().z)
    assert round(z, 2) == 3.02 and qa.rate_outliers(df, 10 / 11**0.5).count() in (0, 1)


def test_blank_words_are_not_in_the_tail(spark):
    words = [(1, i, " " if i % 2 else f"x{i}", i / 20, i / 20) for i in range(40)] + [(2, i, "slow", float(i), float(i)) for i in range(40)] + [(3, i, "few", 0.0, 0.0) for i in range(16)]
    df = spark.createDataFrame(words, "chapter int, pos int, word string, start double, end double")
    assert rows(qa.tail_rates(df), "chapter", "words", "span", "rate", "tail") == [(1, 12, 1.1, 10.9, " ".join(f"x{i}" for i in range(16, 40, 2))[:52])]


def test_constant_rates_have_no_outliers(spark):
    df = spark.createDataFrame([(i, "a b c", 60.0) for i in range(5)], "chapter int, text string, duration double")
    assert qa.rate_outliers(df).count() == 0 and qa.rate_outliers(df.where("chapter = 1")).count() == 0


def test_gram_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, ("a b c d e f " * 3 + "g h i j k l " * 3).split())], "k int, t array<string>")
    top = T.with_gram_counts(df, "t", 6, "g", 2).select(T.top_of("g").alias("x")).first().x
    assert (top["count"], top["first"], top.gram) == (3, 0, "a b c d e f")


def test_plan_problems(spark):
    plan = spark.createDataFrame([(1, 0.0, 5.0, 10.0), (1, 0.0, 5.0, 10.0), (3, 9.5, 12.0, 10.0), (4, 0.0, 1.0, None)], "chapter int, start double, end double, duration double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chapter int")
    assert rows(qa.plan_problems(plan, ids(1, 2), ids(1, 2, 3)), "chapter", "problem") == [(1, "duplicate"), (2, "missing"), (3, "range"), (4, "unexpected")]


def test_located_at_zero_is_not_located(spark):
    loops = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "chapter int, phrase string")
    seg = spark.createDataFrame([(1, 0, 0.0, "A b c d e f g"), (2, 0, 0.0, "x"), (2, 1, 5.0, "a b c d e f")], "chapter int, pos int, start double, text string")
    out = intervals_at = qa.locate_loop(loops, seg, spark.createDataFrame([(1, 10.0), (2, 10.0)], "chapter int, duration double"))
    assert rows(intervals_at, "chapter", "at", "mid") == [(1, None, False), (2, 5.0, True)] and out.count() == 2


def test_ledger_costs(spark):
    runs = spark.createDataFrame([(1, 1.0, True, 0.0, False, 5), (1, None, False, 2.0, True, 5), (1, None, False, None, False, 0), (2, None, False, None, False, 3)], "book_id int, cost_usd double, cost_reported boolean, estimated_cost double, estimate_complete boolean, tokens_in long")
    runs = runs.withColumn("tokens_out", F.lit(0)).withColumn("tokens_cached", F.lit(0))
    assert rows(ledger.budget_cost(runs, "book_id"), "book_id", "cost", "unknown", "complete") == [(1, 3.0, 0, True), (2, 0.0, 1, False)]
    assert ledger.total_or_zero(runs.where("false"), "tokens_in").first().total == 0


def test_mutations(spark):
    table = spark.createDataFrame([(1, "a")], "id int, v string")
    new, twice = ledger.append_new(table, spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), "id")
    assert rows(new, "id", "v") == [(1, "a"), (2, "c")] and rows(twice, "id", "v") == [(1, "b")]
    assert rows(ledger.rewrite(table, F.col("id") == 1, v=F.lit("z")), "v") == [("z",)]
    kids = spark.createDataFrame([(1, 10), (2, 20)], "book_id int, x int")
    left = ledger.delete_cascade({"books": table, "runs": kids}, spark.createDataFrame([(1,)], "id int"))
    assert left["books"].count() == 0 and rows(left["runs"], "x") == [(20,)]
    over = spark.createDataFrame([("p", True, None, False, 1), ("p", False, "", False, 2), ("q", False, "w", False, 1)], "source_path string, hidden boolean, work_id string, force_audio boolean, seq int")
    assert rows(ledger.meaningful_overrides(over), "source_path") == [("q",)]


def test_ewma_with_a_seed(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 0.0), ("a", 3, 20.0)], "k string, i int, v double")
    assert ranking.ewma(df, "k", "v", "i", seed=F.lit(5.0)).first().rate == pytest.approx(0.3 * 20 + 0.7 * (0.3 * 10 + 0.7 * 5))


def test_makespan(spark):
    jobs = spark.createDataFrame([("q", 1, 1, [("asr", 10.0), ("agent", 5.0)]), ("q", 2, 2, [("asr", 10.0), ("agent", 5.0)]), ("q", 3, 3, [("agent", 1.0)])], "queue string, id int, place int, segments array<struct<lane:string,seconds:double>>")
    assert rows(ranking.makespan(jobs), "id", "start", "finish") == [(1, 0.0, 15.0), (2, 10.0, 25.0), (3, 0.0, 1.0)]


RUN = "id long, book_id long, stage string, started_at timestamp, finished_at timestamp, ok boolean, superseded boolean, error string, heartbeat_at timestamp, progress_at timestamp, tokens long, cost_usd double, cost_reported boolean, estimated_cost double, estimate_complete boolean, findings string, blocker int, fix int, passed boolean"
BOOK = "id long, state string, status string, park_code string, runtime_active boolean, process_alive boolean, agent_active int, agent_capacity int, eligible_books int, fans_out boolean, book_calls int, most_book_calls int, calls int, call_capacity int, remaining_units int"


def test_incidents(spark):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)

    def run(i, book, stage, begin, end=None, ok=None, error="", gone=False, tokens=0, cost=None, **more):
        m = {"findings": None, "blocker": None, "fix": None, "passed": None} | more
        return (i, book, stage, at(begin), None if end is None else at(end), ok, gone, error, at(begin), at(begin), tokens, cost, cost is not None, None, False, m["findings"], m["blocker"], m["fix"], m["passed"])

    book = lambda i, state, status="running", code="", active=True, alive=None: (i, state, status, code, active, alive, 1, 1, 0, False, 0, 1, 0, 1, 0)
    runs = [
        run(1, 1, "fixing", 0, 10, True, tokens=100, cost=1.0), run(2, 1, "fixing", 100, None, tokens=301, cost=3.5),  # three times what it ever needed
        run(3, 2, "asr", 0, 5, False, "disk 17 full"), run(4, 2, "asr", 6, 7, False, "disk 18 full"), run(5, 2, "asr", 8, 9, False, "disk 19 full"),
        run(6, 3, "asr", 0, 5, False, "disk full"), run(7, 3, "asr", 6, 7, False, "HTTP 429"),
        *[run(8 + i, 4, "qa_sweep", i, i + 1, True, findings="same") for i in range(3)],
        run(11, 5, "auditing", 0, 1, True, blocker=1, fix=2), run(12, 5, "auditing", 2, 3, True, passed=True), run(13, 5, "auditing", 4, 5, True, blocker=0, fix=2), run(14, 5, "auditing", 6, 7, True, blocker=0, fix=2),
        run(15, 6, "auditing", 0, 1, True, blocker=1, fix=2), run(16, 6, "auditing", 2, 3, True, blocker=0, fix=3),  # milder, so no incident
        run(17, 7, "asr", 139, None), run(18, 8, "asr", 0, 5, False, "odd"), run(19, 8, "asr", 6, 7, True, gone=True),
    ]
    books = [book(1, "fixing"), book(2, "asr"), book(3, "asr", "paused"), book(4, "qa_sweep"), book(5, "fixing"), book(6, "auditing"), book(7, "asr", active=False), book(8, "asr"), book(9, "done", "needs_attention", "supervisor_budget")]
    artifacts = spark.createDataFrame([(9, "splitting", 0, False), (8, "splitting", 0, True)], "book_id long, stage string, run long, valid boolean")
    got = ranking.classify_incidents(spark.createDataFrame(books, BOOK), spark.createDataFrame(runs, RUN), artifacts, F.lit("2024-01-01 02:20:00").cast("timestamp"), {"growth": 3.0, "max_seconds": 0})
    want = [(1, "cost_limit", 2, False), (1, "duration_limit", 2, False), (1, "stale_heartbeat", 2, False), (1, "token_limit", 2, False), (2, "repeated_error", 5, False), (3, "rate_limit", 7, True), (4, "qa_non_converging", 10, False), (5, "audit_non_converging", 14, False), (7, "missing_process", 17, False), (8, "unclassified", 18, False), (9, "artifact_invalid", 0, True), (9, "parked_recovery", 0, False)]
    assert rows(got, "book_id", "kind", "run", "protected") == want
    asked = got.withColumn("park_code", F.lit("supervisor_budget")).withColumn("attempts", F.lit(0)).withColumn("recoveries", F.when(F.col("book_id") == 9, 3).otherwise(0))
    done = {(r.book_id, r.kind): (r.action, r.approval, r.automatic) for r in ranking.decisions(asked, 3).collect()}
    assert done[1, "cost_limit"] == ("stop_budget", False, True) and done[2, "repeated_error"] == ("park_escalate", True, True) and done[3, "rate_limit"] == ("readmit", False, False)
    assert done[9, "parked_recovery"] == ("park_escalate", True, True) and done[9, "artifact_invalid"] == ("park_escalate", True, False) and done[4, "qa_non_converging"] == ("observe", False, False)
    table = spark.createDataFrame([("rate_limit", "resume"), ("missing_process", "restart")], "kind string, action string")
    recoveries = spark.createDataFrame([(7, 5)], "book_id long, recoveries int")
    assert rows(ranking.decide(got.where("book_id IN (3, 4, 7)"), table, recoveries, 3), "book_id", "action") == [(3, "resume"), (4, "observe"), (7, "escalate")]


def test_gaps_of_a_book_without_spans(spark):
    spans = spark.createDataFrame([("a", 10.0, 50.0), ("a", 40.0, 60.0), ("a", 200.0, 300.0)], "book string, start double, end double")
    totals = spark.createDataFrame([("a", 600.0), ("b", 100.0), ("c", 0.0)], "book string, duration double")
    got = intervals.gaps(spans, totals, "book")
    assert rows(got, "book", "start", "end", "place") == [("a", 0.0, 10.0, "leading"), ("a", 300.0, 600.0, "trailing"), ("a", 60.0, 200.0, "interior"), ("b", 0.0, 100.0, "interior")]
    assert rows(intervals.complete_maps(got, totals, "book"), "book", "complete") == [("a", False), ("b", False), ("c", True)]
    short = intervals.gaps(spans.limit(0), spark.createDataFrame([("d", 0.5), ("e", 59.0), ("f", 61.0)], "book string, duration double"), "book")
    assert rows(intervals.complete_maps(short, short.select("book"), "book"), "book", "complete") == [("d", True), ("e", True), ("f", False)]
    markers = spark.createDataFrame([("a", 70.0, 90.0, "m"), ("a", 190.0, 260.0, "n"), ("a", 95.0, 99.0, " ")], "book string, start double, end double, title string")
    assert [r.titles for r in intervals.span_titles(got.where("place = 'interior' AND book = 'a'"), markers, "book").collect()] == [["m"]]
    assert rows(intervals.describe(intervals.span_titles(got, markers, "book"), "book"), "book", "text") == [("a", "2.3 min at 60-200s (interior; m); 5.0 min at 300-600s (trailing)"), ("b", "1.7 min at 0-100s (interior)")]


def test_half_even_and_repr(spark):
    df = spark.createDataFrame([(2.675, "it's \"é\"\n"), (None, None)], "x double, t string")
    got = intervals.half_even(df, "x", 2).withColumn("r", sinks.python_repr(F.col("t"))).collect()
    assert [(r.x, r.r) for r in got] == [(2.67, repr("it's \"é\"\n")), (None, None)]


def test_adjudicate(spark):
    df = spark.createDataFrame([(1, "we go on " * 8, "then we go on we go on home"), (2, "we go on " * 8, "on we go home"), (3, "we go on " * 8, "nothing here")], "chapter int, looped string, fresh string")
    assert rows(intervals.adjudicate(df, "chapter"), "chapter", "period", "verdict") == [(1, 3, "real"), (2, 3, "reduced"), (3, 3, "gone")]


def test_splices_and_snaps(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 10.0, "a b"), (1, 1, 10.0, 20.0, "c d"), (1, 2, 20.0, 30.0, "e f")], "chapter int, pos int, start double, end double, text string")
    tail = intervals.splice_tail(seg, spark.createDataFrame([(1, 20.0, "new end")], "chapter int, point double, text string"), "chapter").first()
    assert (tail.text, tail.before, tail.after) == ("a b c d new end", 6, 6)
    window = intervals.splice_window(seg, spark.createDataFrame([(1, 12.0, 18.0, "X")], "chapter int, start double, end double, text string"), "chapter").first()
    assert window.text == "a b X e f"
    points = spark.createDataFrame([(1, 25.0), (1, 5.0)], "chapter int, point double")
    assert rows(intervals.snap_back(points, seg, "chapter"), "point", "snapped") == [(25.0, 20.0), (5.0, 0.0)]
    assert intervals.tail_start(seg, points.where("point = 25"), "chapter").first()["from"] == 0.0


def test_clip_health(spark):
    df = spark.createDataFrame([("a b c d e f g a b c d e f",), ("one two three go go go",), ("all is well here today",), ("",)], "text string")
    assert [r.healthy for r in intervals.clip_healthy(df).collect()] == [False, False, True, True]


def test_chunk_plan_merges_a_small_end(spark):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate([10, 15, 30, 3])] + [("b", 0, 2)], "book string, chapter int, words int")
    assert rows(numbering.chunk_plan(df, "book", budget=25, least=5), "book", "chunk", "first", "last", "words") == [("a", 0, 0, 1, 25), ("a", 1, 2, 3, 33), ("b", 0, 0, 0, 2)]


def test_narrated(spark):
    said = [None, 1, 9, 2, 3, 4, None, 6, 5, None]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(said)] + [("b", 0, 1)], "book string, idx int, announced int")
    got = dict(((r.book, r.idx), r.chapter) for r in numbering.narrated(df, "book").collect())
    assert [got["a", i] for i in range(10)] == [1, 1, 2, 2, 3, 4, 6, 6, None, None] and got["b", 0] is None


def test_sections(spark):
    s = spark.createDataFrame([("a", 0, "Cover", None, 5, "x"), ("a", 1, "One", 1, 900, "y"), ("a", 2, "", None, 800, "y"), ("a", 3, "Two", 2, 950, "z"), ("a", 4, None, None, 10, "z"), ("a", 5, "Ads", None, 10, "q")], "book string, idx int, label string, number int, words int, spine string")
    assert rows(numbering.story_span(s, "book"), "first", "last") == [(1, 4)]
    assert [r.place for r in numbering.quarantine(s, numbering.story_span(s, "book"), "book").orderBy("idx").collect()] == ["front", "story", "story", "story", "story", "back"]
    assert numbering.size_outlier(s, "book").first().outlier
    zero = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "book string, number int")
    assert rows(numbering.shift_zero(zero, "book"), "book", "number") == [("a", 1), ("a", 2), ("b", 1)]
    files = spark.createDataFrame([("a", 0, 5, 10.0), ("a", 1, 900, 999.0), ("a", 2, 5, None), ("b", 0, 1, 1.0)], "book string, idx int, words int, duration double")
    assert [r.edge for r in numbering.classify_edges(files, "book").orderBy("book", "idx").collect()] == ["leading", None, "trailing", None]


def test_rules(spark):
    assert spelling.check_rules([{"pattern": ""}, {"pattern": "("}, {"pattern": "a", "replacement": "x $2"}, {"pattern": "a", "replacement": "$1 b"}]) == ["rule 0: empty pattern", "rule 1: missing ), unterminated subpattern at position 0", "rule 2: reference in replacement"]
    texts = spark.createDataFrame([(1, "Jon met Jon and Bob"), (2, None)], "chapter int, text string")
    rules = [{"pattern": r"\bJon\b", "replacement": "John"}, {"pattern": "John met", "replacement": "John saw"}]
    out = spelling.apply_rules(texts, rules)
    assert rows(out.where("chapter = 1"), "text", "fired") == [("John saw John and Bob", [2, 1])]
    assert rows(spelling.rule_totals(out.where("chapter = 1"), rules), "pattern", "count") == [("John met", 1), (r"\bJon\b", 2)]
    bad = spelling.gates(texts, spark.createDataFrame([("nobody",)], "text string"), rules[:1])
    assert rows(bad, "problem") == [("left_remains",), ("right_missing",), ("right_unattested",)]


def test_tokens_and_candidates(spark):
    texts = spark.createDataFrame([(1, "He met Ann Lee. Then Ann Lee and d'Artagnan’s Bob left. Ann Lee ran. So did Ann Lee."), (2, "They saw Ann Lee.")], "chapter int, text string")
    tok = spelling.token_table(texts, "chapter")
    for r in tok.where("chapter = 1").collect():
        assert texts.first().text.replace("’", "'")[r.start : r.start + len(r.token)] == r.token
    assert [r.token for r in tok.where("chapter = 1 AND initial").orderBy("i").collect()] == ["He", "Then", "Ann", "So"]
    got = spelling.candidates(texts, "chapter", spark.createDataFrame([("the",)], "w string"), least_single=1)
    assert ("Ann Lee", 4, 2, "phrase") in [tuple(r[c] for c in ("form", "count", "chapters", "kind")) for r in got.collect()]


def test_first_use_claims(spark):
    claims = spark.createDataFrame([("Ann", 1), ("Bob", 1), ("Cy", 9), ("Di", 2), ("Ed", None)], "name string, claimed int")
    heard = spark.createDataFrame([("Ann", 1), ("Bob", 3), ("Cy", 2), ("Ed", 1)], "name string, first int")
    assert rows(spelling.first_use_claims(claims, heard), "name", "verdict") == [("Ann", "ok"), ("Bob", "early"), ("Cy", "late"), ("Di", "unheard"), ("Ed", "unknown")]


def test_overlap_that_measures_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        spelling.overlap(spark.createDataFrame([(1, "short")], "k int, text string"), spark.createDataFrame([(1, "short")], "s int, text string"), "k", "s")


def test_reset_time(spark):
    now = dt.datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([("limit|1704117600", now), ("resets at 3pm", now), ("resets 9:30 am", now), ("none", now)], "m string, now timestamp")
    got = [r.t for r in df.select(spelling.reset_time(F.col("m"), F.col("now")).alias("t")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 14), dt.datetime(2024, 1, 1, 15), dt.datetime(2024, 1, 2, 9, 30), None]


def test_errors(spark):
    df = spark.createDataFrame([("open /a/b/c failed: 429 Too many requests 12345",), ("open /x/y failed: 429 too many requests 9",)], "m string")
    assert len({r.f for r in df.select(T.error_fingerprint(F.col("m")).alias("f")).collect()}) == 1
    assert {r.c for r in df.select(spelling.error_class(F.col("m")).alias("c")).collect()} == {"rate_limit"}


def test_identity(spark):
    books = spark.createDataFrame([("p1", "The Long Winter", "A1", None), ("p2", "The Long Wintr", None, None), ("p3", "Zebra", None, "I1")], "path string, title string, asin string, isbn string")
    rec = spark.createDataFrame([("w1", "A1", None), ("w3", None, "I1")], "work_id string, asin string, isbn string")
    works = spark.createDataFrame([("w2", "the long winter"), ("w9", "short summer")], "work_id string, title string")
    assert rows(identity.coverage(books, rec, works), "path", "work_id", "matched_by") == [("p1", "w1", "asin"), ("p2", "w2", "title"), ("p3", "w3", "isbn")]
    c = spark.createDataFrame([("p", "r1", ["a"], ["a", "b"], 100, 100), ("p", "r2", ["c"], ["a"], 100, 500), ("q", "r3", ["x"], ["y"], 1, 9), ("s", "r4", ["x"], ["x"], 1, 1), ("s", "r5", ["x"], ["x"], 1, 1)], "path string, recording_id string, narrators array<string>, own_narrators array<string>, runtime int, own_runtime int")
    assert rows(identity.best_recording(c), "path", "recording_id") == [("p", "r1"), ("q", "r3")]
    epubs = spark.createDataFrame([("d1", "a.epub", True), ("d2", "b.epub", True), ("d2", "c.epub", True)], "dir string, path string, readable boolean")
    paired = identity.pair_epubs(spark.createDataFrame([("d1",), ("d2",), ("d3",)], "dir string"), epubs)
    assert rows(paired, "dir", "epub", "note") == [("d1", "a.epub", None), ("d2", None, "several epubs"), ("d3", None, "no epub")]
    assert rows(identity.unclaimed(epubs, paired), "path") == [("b.epub",), ("c.epub",)]


def test_sets_and_fronts(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = df.select(experiments.jaccard(F.col("a"), F.col("b")).alias("j"), experiments.recall(F.col("a"), F.col("b")).alias("r")).collect()
    assert [(r.j, r.r) for r in got] == [(1.0, 0.0), (0.0, 0.0), (1 / 3, 0.5)]
    p = spark.createDataFrame([("a", 1.0, 5.0, True), ("b", 2.0, 9.0, True), ("c", 3.0, 9.0, True), ("d", None, 8.0, True), ("e", 1.0, 5.0, True), ("f", 0.1, 99.0, False), ("g", None, 9.5, True)], "k string, cost double, quality double, ok boolean")
    # What costs nobody knows is dominated by any better one, but dominates none whose cost is known; what fails the gate counts for nothing.
    assert rows(experiments.pareto(p, ["cost"], ["quality"], gate=F.col("ok"), unknown="cost"), "k") == [("a",), ("b",), ("e",), ("g",)]
    assert rows(experiments.pareto(p, ["cost"], ["quality"]), "k") == [("f",)]
    assert experiments.pareto(p.limit(0), ["cost"], ["quality"]).count() == 0


def test_experiment_plan_is_reproducible(spark):
    p, c = spark.createDataFrame([("x",), ("y",)], "profile string"), spark.createDataFrame([("c1",), ("c2",)], "case string")
    one, two = (rows(experiments.experiment_plan(p, c, 2, s), "place", "profile", "case", "repeat") for s in (1, 1))
    assert one == two and len(one) == 8 and rows(experiments.experiment_plan(p, c, 2, 2), "place", "profile", "case", "repeat") != one


def test_raw_transcripts(spark, tmp_path):
    (tmp_path / "ch001.json").write_text('{"text":"x","language":"en","segments":[{"id":0,"start":0,"end":1.5,"text":" hi ","words":[{"word":" hi","start":0,"end":1,"probability":NaN},{"word":"you","start":1,"end":1.5,"probability":0.25}]}]}')
    (tmp_path / "ch002.json").write_text(json.dumps({"result": {"language": " "}, "params": {"language": "fr"}, "transcription": [{"offsets": {"from": 500, "to": 1500}, "text": " salut", "tokens": [{"text": "[_BEG_]", "offsets": {"from": 0, "to": 0}, "p": 1.0}, {"text": " salut", "offsets": {"from": 500, "to": 1500}, "p": 0.9}]}]}))
    out = transcripts.normalise(transcripts.read_raw(spark, str(tmp_path)))
    assert rows(out, "chapter", "language") == [(1, "en"), (2, "fr")]
    assert rows(transcripts.word_rows(out), "chapter", "w", "start", "p") == [(1, "hi", 0.0, None), (1, "you", 1.0, 0.25), (2, "salut", 0.5, 0.9)]
    sinks.write_normalised(out, str(tmp_path / "json"))
    with pytest.raises(ValueError):
        sinks.write_normalised(out, str(tmp_path / "raw"))
    again = spark.read.schema(transcripts.NORMALISED).json(str(tmp_path / "json"))
    assert rows(transcripts.segment_rows(again), "chapter", "text") == rows(transcripts.segment_rows(out), "chapter", "text")


def test_wrong_tag_and_missing_duration_are_errors(spark, tmp_path):
    (tmp_path / "ch001.json").write_text(json.dumps({"schema": "other", "chapter": 1, "segments": []}))
    with pytest.raises(Exception, match="schema tag other"):
        transcripts.read_normalised(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no duration for chapter 1"):
        transcripts.load_chapters(spark, str(tmp_path), spark.createDataFrame([(2, 5.0)], "chapter int, duration double"), "other").collect()


def test_layers_and_strict_json(spark):
    base, fixed = (spark.createDataFrame(x, "chapter int, text string") for x in ([(1, "a"), (2, "b")], [(2, "B")]))
    layer = transcripts.prefer(fixed, base)
    assert rows(layer, "chapter", "text", "layer") == [(1, "a", "base"), (2, "B", "repaired")] and transcripts.whole_text(layer).first().text == "a B"
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"z":2}',), ("nope",)], "j string")
    assert [r.error for r in transcripts.strict_decode(df, "j", "a int", ["a"]).collect()] == [None, "unknown: z", "malformed"]


def test_epub_metadata(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "good.epub", "w") as z:
        z.writestr("c.opf", "<package><dc:title>Sea</dc:title><dc:creator>Ann</dc:creator></package>")
    (tmp_path / "bad.epub").write_bytes(b"nothing")
    got = transcripts.epub_metadata(spark.read.format("binaryFile").load(str(tmp_path)))
    assert rows(got, "title", "author", "readable") == [("Sea", "Ann", True), ("bad", None, False)]
    assert transcripts.list_files(spark, str(tmp_path), "*.epub").count() == 2


EVENTS = "event_id long, ts timestamp, key string, type string, value double"


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    data = [(i, t + dt.timedelta(minutes=i), "ab"[i % 2], "x", float(i % 3)) for i in range(1, 21)]
    spark.createDataFrame([*data, data[3]], EVENTS).repartition(2).write.parquet(str(tmp_path / "in"))
    source = lambda: stream.read_events(spark, str(tmp_path / "in"), EVENTS)
    stream.to_table(stream.dedupe(source()), str(tmp_path / "d"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 20
    stream.to_table(stream.last_write(source(), "key"), str(tmp_path / "l"), str(tmp_path / "c2"), "complete").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "l")).orderBy(F.desc("batch")).dropDuplicates(["key"])
    assert rows(got, "key", "event_id") == [("a", 20), ("b", 19)]
    stream.to_table(stream.moving_average(stream.dedupe(source())), str(tmp_path / "m"), str(tmp_path / "c3"), "update").awaitTermination()
    rate = None
    for _, _, k, _, v in data:
        if k == "a" and v > 0:
            rate = v if rate is None else 0.3 * v + 0.7 * rate
    last = spark.read.parquet(str(tmp_path / "m")).where("key = 'a'").orderBy(F.desc("n")).first()
    assert last.rate == pytest.approx(rate)
    stream.to_table(stream.changed(source()), str(tmp_path / "h"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "h")).where("key = 'a'").count() == 10
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert stream.cursor(batch).first().cursor == 20 and stream.replay(batch, 18).count() == 2


@pytest.mark.parametrize("few", [0, 5000])
def test_two_settled_names_are_no_slips_of_each_other(spark, monkeypatch, few):
    monkeypatch.setattr(spelling, "FEW_NAMES", few)
    names = [("Tersa", "verified", 1), ("Terra", "verified", 2), ("Torrin", "carryover", 3), ("Toren", "verified", 4), ("Laken Godart", "verified", 5), ("Flos", "verified", 6), ("the Ana", "verified", 7)]
    said = [("Tersa", 9), ("Tersas", 2), ("Torrin", 40), ("Goddard", 3), ("Floss", 5), ("Laken", 2), ("Godarts", 1), ("Godart", 1), ("Terra's", 1), ("Flos I", 1), ("floss", 7), ("Lakem", 3)]
    got = spelling.reference_matches(spark.createDataFrame(said, "form string, count int"), spark.createDataFrame(names, "name string, authority string, pos int"), ["the"])
    assert [(r.form, r.name, r.distance, r.truncated) for r in got.collect()] == [("Torrin", "Toren", 2, 0), ("Floss", "Flos", 1, 0), ("Goddard", "Godart", 2, 0), ("Lakem", "Laken", 1, 0)]
    cut = spelling.reference_matches(spark.createDataFrame(said, "form string, count int"), spark.createDataFrame(names, "name string, authority string, pos int"), ["the"], cap=2)
    assert [(r.form, r.truncated) for r in cut.collect()] == [("Torrin", 2), ("Floss", 2)]


def test_rounds_are_accepted_on_few_last_fixes(spark):
    cases = [(1, 5, 0, True, 0), (2, 3, 0, True, 0), (3, 3, 1, True, 0), (4, 0, 0, True, 0), (5, 2, 0, False, 0), (6, 2, 0, True, 4), (7, 2, 0, True, 3), (8, 3, 0, True, 0), (9, 4, 0, True, 0)]
    rounds = spark.createDataFrame([("b", *c) for c in cases], "book_id string, round int, fixes int, blockers int, clean boolean, fixes_done int")
    assert [r.accepted for r in ranking.audit_accepted(rounds).orderBy("round").collect()] == [False, True, False, False, False, False, True, False, False]
