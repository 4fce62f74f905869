"""Sheets, sidecars, suites, reports and lookups on hand-made rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import experiments, intervals, numbering, qa, ranking, spelling
from lectern.sources import sinks, transcripts


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_sheets(spark):
    heard = spark.createDataFrame([("Ann", 1), ("Bob", 5), ("Cy", 0), ("Di", 9)], "name string, first int")
    ends = spark.createDataFrame([(2,), (6,), (9,)], "end int")
    ledger = spark.createDataFrame([("Ann", "sister of Bob and Di"), ("Bob", "knows Ann"), ("Cy", None)], "name string, note string")
    assert rows(spelling.sheet_gates(ledger, ends, heard), "name", "other", "end") == [("Ann", "Bob", 2), ("Ann", "Di", 2)]
    shown = spelling.sheet_rows(ledger, ends, heard)
    assert rows(shown, "end", "name") == [(2, "Ann"), (2, "Cy"), (6, "Ann"), (6, "Bob"), (6, "Cy"), (9, "Ann"), (9, "Bob"), (9, "Cy")]
    assert rows(sinks.sheets(shown.where("end = 2")), "markdown") == [("- Ann\n- Cy",)]
    lines = spark.createDataFrame([(0, "Ann and Bob travel"), (1, "nobody")], "pos int, line string")
    assert rows(spelling.preamble_leaks(lines, heard, 2), "line", "name") == [("Ann and Bob travel", "Bob")]
    led = spark.createDataFrame([("Ann", True), ("Zed", True), ("Bob", False)], "name string, carryover boolean")
    assert rows(spelling.carryover_gate(led, spark.createDataFrame([("Ann",)], "canonical string")), "name") == [("Zed",)]


def test_names(spark):
    df = spark.createDataFrame([("Anna of York",), ("Ann Lee",), ("ann Lee",), ("Al",), ("Anna went home",)], "n string")
    assert [r.ok for r in df.select(spelling.glossary_name(F.col("n")).alias("ok")).collect()] == [True, True, False, False, False]
    tok = spark.createDataFrame([("D'Artagnan",), ("I'll",), ("word",)], "t string")
    assert [r.ok for r in tok.select(spelling.proper_shape(F.col("t"), ["i"]).alias("ok")).collect()] == [True, False, False]


def test_sidecar_rules(spark):
    good = ("ann", "Ann", "minor", "kind", 3, ["A"], "Q1")
    bad = [("Ann", "x", "minor", "d", 0, [], ""), ("ann", " ", "boss", "", 11, ["A", " "], "P1"), ("bob", "Bob", "", "x" * 1501, 10, [], ""), ("cid", "Cid", None, "a — b", -1, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([good, *bad])], "pos int, id string, name string, role string, description string, reveal int, aliases array<string>, wikidata string")
    want = [(1, "id_slug"), (2, "alias_blank"), (2, "description_blank"), (2, "id_repeated"), (2, "name_blank"), (2, "reveal_range"), (2, "role_unknown"), (2, "wikidata_id"), (3, "description_long"), (4, "description_dash"), (4, "reveal_range")]
    assert rows(experiments.character_problems(df, 10), "pos", "rule") == want
    recaps = spark.createDataFrame([(0, 1, "fine", "book"), (1, 1, "", "world"), (2, 99, "a — b", ""), (3, 2, "y" * 3001, "series")], "pos int, through int, text string, scope string")
    assert rows(experiments.recap_problems(recaps, 10), "pos", "rule") == [(1, "scope_unknown"), (1, "text_blank"), (1, "through_repeated"), (2, "text_dash"), (2, "through_range"), (3, "text_long")]


def test_suites(spark, tmp_path):
    good = {"cases": [{"name": "c", "path": "c/1", "digest": "0" * 64}], "profiles": [{"name": "p", "stages": {"asr": "m"}}]}
    (tmp_path / "s.json").write_text(json.dumps(good))
    cases, profiles = transcripts.load_suite(spark, str(tmp_path / "s.json"), ["asr"])
    assert cases.count() == profiles.count() == 1
    bad = {"cases": [{"name": "c", "path": "../x", "digest": "z"}], "profiles": [{"name": "p", "stages": {}}], "odd": 1}
    assert transcripts.check_suite(bad, ["asr"]) == ["unknown field: odd", "case c: path leaves the suite", "case c: digest", "profile p: no stage asr"]


def test_reports(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert sinks.markdown_table(df, "k").first().markdown == "| k | v |\n|---|---|\n| 1 |  |\n| 2 | b |"
    totals = spark.createDataFrame([("a", 1), ("b", 5)], "pattern string, count long")
    assert sinks.correction_log(totals).first().log == "5\tb\n1\ta"
    v = sinks.validation_report(spark.createDataFrame([("warning", "w"), ("error", "e")], "severity string, text string")).first()
    assert (v.clean, v.errors, v.warnings) == (False, ["e"], ["w"])
    old, new = (spark.createDataFrame(x, "chapter int, verdict string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert rows(sinks.merge_verdicts(old, new), "chapter", "verdict") == [(1, "a"), (2, "c")]
    ev = spark.createDataFrame([(7, "state", "{}", True), (8, "tick", "{}", False)], "id int, type string, data string, keep boolean")
    assert [r.f for r in ev.select(sinks.sse_frame(durable=F.col("keep")).alias("f")).collect()] == ["id: 7\nevent: state\ndata: {}\n\n", "event: tick\ndata: {}\n\n"]
    assert qa.is_clean({"a": df, "low_confidence": df}).first().clean is False and qa.is_clean({"a": df.limit(0), "low_confidence": df}).first().clean is True


def test_lookups(spark):
    r = spark.createDataFrame([("b", 1), ("b", 2)], "book string, idx int")
    m = spark.createDataFrame([("b", 1, 10)], "book string, idx int, chapter int")
    s = spark.createDataFrame([("b", 3)], "book string, shift int")
    assert rows(numbering.position_of(r, m, s, "book"), "idx", "chapter") == [(1, 10), (2, 5)]
    sec = spark.createDataFrame([("b", "x", 1), ("b", "y", 2)], "book string, file string, chapter int")
    assert rows(numbering.apply_map(sec, spark.createDataFrame([("b", "y", 9)], "book string, file string, chapter int"), "book"), "file", "chapter") == [("x", 1), ("y", 9)]
    books = spark.createDataFrame([(1, "a")], "id int, state string")
    paths = spark.createDataFrame([("a", "s1", 0), ("a", "s2", 1), ("z", "s2", 0)], "state string, stage string, step int")
    assert rows(ranking.remaining_path(books, paths), "stage", "step") == [("s1", 0), ("s2", 1)]
    t = spark.createDataFrame([("a", "x", "b", 0), ("a", "y", "c", 1)], "state string, outcome string, next string, pos int")
    assert rows(ranking.mainline(t), "state", "next") == [("a", "c")]
    u = spark.createDataFrame([("chapter", 0, None, None), ("chunk", None, 5, None), ("hour", None, None, 2.5), ("x", 7, None, None), ("x", None, None, None)], "kind string, total int, chapters int, hours double")
    assert [x.n for x in u.select(ranking.total_units(*(F.col(c) for c in u.columns)).alias("n")).collect()] == [60.0, 8.0, 2.5, 7.0, 1.0]
    audio = spark.createDataFrame([("d",), ("d",), ("e",)], "dir string")
    epub = spark.createDataFrame([("e", True), ("f", True)], "dir string, readable boolean")
    assert rows(transcripts.scan_library(audio, epub), "dir", "files", "layout", "epubs") == [("d", 2, "files", 0), ("e", 1, "single", 1), ("f", 0, None, 1)]


def test_windows(spark):
    v = spark.createDataFrame([("c", 10.0, 20.0)], "chapter string, start double, end double")
    w = spark.createDataFrame([("c", 10.5, 20.9), ("c", 10.5, 22.0), ("d", 10.0, 20.0)], "chapter string, start double, end double")
    assert rows(intervals.known_failed(w, v, "chapter"), "end") == [(20.9,)]
    assert rows(intervals.not_excluded(w, v, "chapter"), "chapter", "end") == [("c", 22.0), ("d", 20.0)]
    words = spark.createDataFrame([("c", i, t) for i, t in enumerate(("x y z " + "a b c d e f " * 4).split())] + [("d", i, t) for i, t in enumerate(("a b c d e f " * 4 + "q " * 30).split())], "chapter string, pos int, text string")
    assert rows(intervals.locate_tail_run(words, "chapter"), "chapter", "phrase", "first_pos", "uses") == [("c", "a b c d e f", 3, 4), ("d", "q q q q q q", 24, 25)]
    wpm = spark.createDataFrame([(150.0, 20.0), (20.0, 150.0), (150.0, 160.0), (1.0, 1.0)], "old double, new double")
    assert [r.a for r in wpm.select(intervals.adopt(F.col("old"), F.col("new")).alias("a")).collect()] == ["keep", "adopt", "prefer_longer", "review"]
    p = spark.createDataFrame([(1, "loop here", "a loop  here b"), (2, "loop here", "fine")], "chapter int, phrase string, text string")
    assert rows(intervals.resolved(p.select("chapter", "phrase"), p.select("chapter", "text")), "chapter") == [(2,)]


def test_a_due_or_stale_row(spark):
    from lectern.streaming import events as stream

    import datetime as dt

    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9)), (3, None)], "id int, retry_at timestamp")
    assert rows(stream.due(df, "2024-01-05"), "id") == [(1,)]
    assert rows(stream.stale(df.withColumnRenamed("retry_at", "updated_at"), "2024-01-10"), "id") == [(1,)]
    with pytest.raises(ValueError):
        sinks.guard("/x/raw/")


def test_patches(spark):
    from lectern.streaming import events as stream

    state = spark.createDataFrame([(1, "queued", 5), (2, "done", 6)], "id int, status string, eta int")
    changes = spark.createDataFrame([(1, 1, "running"), (1, 2, "failed"), (3, 1, "new")], "id int, event_id int, status string")
    assert rows(stream.patch(state, changes, "id"), "id", "status", "eta") == [(1, "failed", 5), (2, "done", 6), (3, "new", None)]
    assert rows(stream.replace(state, spark.createDataFrame([(2, 9)], "id int, eta int"), "id"), "id", "status", "eta") == [(1, "queued", None), (2, "done", 9)]


def test_seeded_ewma_folds_the_whole_table(spark, tmp_path):
    from lectern.plans.queries import QUERIES

    events = [(i, i % 3, float(i * 7 % 50 - 5)) for i in range(1990, 2030)] + [(5000, 9, 20.0)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for _, user, value in events:
        if value > 0:
            want[user] = 0.3 * value + 0.7 * want.get(user, 10.0)
    got = {r.user_id: r.rate for r in QUERIES["seeded_ewma"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_adjudicate_reads_whole_texts(spark, tmp_path):
    from lectern.plans.queries import QUERIES

    head = " ".join(f"w{i}" for i in range(300))
    texts = [(1, head + " we go on" * 12), (2, head), (3, head + " a b c d e f" * 6 + " " + head)]
    spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(QUERIES["adjudicate"](spark, str(tmp_path)), "chapter", "period", "uses", "verdict") == [(1, 3, 12, "real")]
    words = spark.createDataFrame([("c", "x y z " + "a b c d e f " * 4), ("d", "a b c d e f " * 4 + "q " * 30), ("e", "a b c d e f " * 4 + "p o n m l k j i h g " * 3 + "z"), ("f", "few words")], "chapter string, text string")
    runs = intervals.tail_runs(words.select("chapter", F.split(F.trim("text"), " ").alias("tokens")), "chapter")
    same = intervals.locate_tail_run(words.select("chapter", F.posexplode(F.split(F.trim("text"), " ")).alias("pos", "text")), "chapter")
    assert rows(runs, "chapter", "phrase", "first_pos", "uses") == rows(same, "chapter", "phrase", "first_pos", "uses") == [("c", "a b c d e f", 3, 4), ("d", "q q q q q q", 24, 25)]
    loops = spark.createDataFrame([(1, "a b c d e f g h", "a b c d e f", "x a b c y a b c"), (2, "a b c d e f g h", "a b c d e f", "none")], "k int, looped string, phrase string, fresh string")
    assert rows(intervals.adjudicate(loops, "k"), "k", "period", "uses", "verdict") == [(1, 0, 2, "real"), (2, 0, 0, "gone")]


def test_name_candidates(spark, monkeypatch):
    texts = [
        (1, "Kael, wait. The Night Market and a night  market, one night\nmarket. Mr. Ashford met Nightblades; so did Nightblades."),
        (2, "Kael! Ashford ran. Then night blades came. Kael. Ashford. the zorb, a zorb: zorb kael"),
        (3, "The Old Iron Gate Keeper saw Rose, Thorn. old iron"),
    ]
    df = spark.createDataFrame(texts, "chapter int, text string")
    common = spark.createDataFrame([(w,) for w in "the then a and one so did met ran came saw wait mr old rose night market".split()], "w string")
    got = spelling.name_candidates(df, "chapter", common)
    want = [
        ("Iron Gate", 1, 1, 1, "phrase"), ("Gate Keeper", 1, 1, 1, "phrase"), ("Old Iron", 1, 1, 1, "phrase"), ("Night Market", 1, 1, 1, "phrase"),
        ("night market", 1, 1, 1, "phrase"), ("night blades", 1, 1, 1, "phrase"), ("old iron", 1, 1, 1, "phrase"),
        ("Kael", 3, 0, 2, "single"), ("Ashford", 3, 0, 2, "single"), ("Nightblades", 2, 2, 1, "single"), ("zorb", 3, 3, 1, "single"), ("kael", 1, 1, 1, "single"),
    ]
    assert rows(got, "form", "count", "non_initial", "chapters", "kind") == sorted(want, key=str)
    assert {r.truncated for r in got.collect()} == {0}
    monkeypatch.setattr(spelling.C, "PHRASE_CAP", 2)
    monkeypatch.setattr(spelling.C, "SINGLE_CAP", 1)
    assert rows(spelling.name_candidates(df, "chapter", common), "kind", "rank", "form", "truncated") == [("phrase", 1, "Gate Keeper", 9), ("phrase", 2, "Iron Gate", 9), ("single", 1, "Ashford", 9)]


def test_names_of_any_shape_are_found(spark):
    long = "Order of the Very Old and Quiet Iron Gate"
    heard = spark.createDataFrame([("Ann", 1), ("Ann Lee", 5), ("D'Aston", 6), ("Renée", 7), (long, 8)], "name string, first int")
    ledger = spark.createDataFrame([("Ann", f"meets Ann Lee, then D'Aston's men and Renée of the {long}")], "name string, note string")
    ends = spark.createDataFrame([(2,), (6,)], "end int")
    assert rows(spelling.sheet_gates(ledger, ends, heard), "other", "end") == sorted([("Ann Lee", 2), ("D'Aston", 2), ("Renée", 2), (long, 2)], key=str)
    lines = spark.createDataFrame([(0, "By Renée and D'Aston"), (1, long), (2, "Annabel Ann")], "pos int, line string")
    assert rows(spelling.preamble_leaks(lines, heard, 2), "line", "name") == sorted([("By Renée and D'Aston", "Renée"), ("By Renée and D'Aston", "D'Aston"), (long, long)], key=str)
    texts = spark.createDataFrame([(1, "Ann"), (2, "Rene Ann Lee Renées"), (3, f"D’Aston, Renée; {long}.")], "chapter int, text string")
    assert rows(spelling.first_use(texts, heard.select("name"), "chapter"), "name", "first") == sorted([("Ann", 1), ("Ann Lee", 2), ("D'Aston", 3), ("Renée", 3), (long, 3)], key=str)


def test_universe(spark):
    """A book with numbers and an excerpt behind, one of ambiguous numbers that agree, one that counts from 0, one of titles only,
    one of titles with a divider in front, and one too short."""
    def book(key, *rows):
        return [(key, i, label, spine, words, strict, loose) for i, (label, spine, words, strict, loose) in enumerate(rows)]

    data = book("numbers", ("Title", 0, 9, None, None), ("1", 1, 900, 1, None), ("", 1, 50, None, None), ("2", 2, 900, 2, None), ("3", 3, 900, 3, None), ("", 3, 10, None, None), ("Bonus", 4, 800, None, None))
    data += book("loose", ("I Start", 0, 900, None, 1), ("2", 1, 900, 2, None), ("III End", 2, 900, None, 3))
    data += book("gap", ("1", 0, 900, 1, None), ("2", 1, 900, 2, None), ("V Five", 2, 900, None, 5), ("3", 3, 900, 3, None))
    data += book("zero", ("0", 0, 900, 0, None), ("1", 1, 900, 1, None), ("2", 2, 900, 2, None))
    data += book("titles", ("Copyright", 0, 90, None, None), ("Dawn", 1, 900, None, None), ("", 1, 40, None, None), ("Noon", 2, 950, None, None), ("Dusk", 3, 990, None, None), ("Copyright", 4, 9, None, None))
    data += book("divider", ("Part", 0, 3, None, None), ("Dawn", 1, 900, None, None), ("Noon", 2, 950, None, None), ("Dusk", 3, 990, None, None))
    data += book("short", ("1", 0, 900, 1, None), ("2", 1, 900, 2, None))
    df = spark.createDataFrame(data, "book string, idx int, label string, spine int, words int, strict int, loose int")
    got: dict = {}
    for r in numbering.build_universe(df, "book", ["copyright"], []).orderBy("book", "idx").collect():
        got.setdefault(r.book, []).append((r.chapter, r.place[0], r.source, r.contiguous))
    chapters = {k: [x[0] for x in v] for k, v in got.items()}
    assert chapters == {"numbers": [None, 1, 1, 2, 3, 3, None], "loose": [1, 2, 3], "gap": [1, 2, 3, 3], "zero": [1, 2, 3], "titles": [None, 1, 1, 2, 3, None], "divider": [1, 2, 3, 4], "short": [1, 2]}
    assert {k: v[0][3] for k, v in got.items()} == {"numbers": True, "loose": True, "gap": True, "zero": True, "titles": True, "divider": False, "short": False}
    assert "".join(x[1] for x in got["numbers"]) == "fsssssb" and [x[2] for x in got["titles"]] == ["", "ordinal", "", "ordinal", "ordinal", ""]


def test_orders(spark):
    books = spark.createDataFrame([(1, "S", "2", "transcribing"), (2, "S", "1", "transcribing"), (3, "", "9", "retranscribing"), (4, "S", "x", "transcribing"), (5, None, None, "transcribing")], "id int, series string, series_pos string, state string")
    assert [r.id for r in ranking.asr_order(books).collect()] == [3, 2, 5, 1, 4]
    again, first = ranking.asr_partition(books)
    assert (rows(again, "id"), rows(first, "id")) == ([(3,)], [(1,), (2,), (4,), (5,)])
    shelf = spark.createDataFrame([("b", 2.0, "x", "1"), ("", 1.0, "a", "2"), ("B", 1.0, "y", "3"), ("a", None, "z", "4"), ("a", 3.0, "q", "5")], "series string, pos double, title string, path string")
    assert [r.path for r in experiments.series_sort(shelf).collect()] == ["5", "4", "3", "1", "2"]
    done = spark.createDataFrame([(1, "done", 5), (2, "open", 9), (3, "done", None), (4, "done", 7), (5, "done", 7)], "id int, status string, finished_at int")
    assert [r.id for r in experiments.done_books(done).collect()] == [5, 4, 1, 3]
    board = spark.createDataFrame([(1, "F", "a", 1), (2, "P", "b", 2), (3, "P", "a", None), (4, "P", "a", 1)], "id int, status string, series string, pos int")
    assert [r.id for r in experiments.board_sort(board, ["P", "F"]).collect()] == [4, 3, 2, 1]
    queue = spark.createDataFrame([("run", 1, "b", 1), ("wait", 1, "a", 2), ("run", 2, "a", 3)], "bucket string, place int, lane string, id int")
    assert [r.id for r in ranking.queue_payload(queue, ["wait", "run"]).collect()] == [2, 3, 1]


def test_status_codes(spark):
    known = {"HTTP 401": "authentication_failure", "HTTP/1.1 429 slow down": "rate_limit", "open x failed: 503": "backend_unavailable", "status=429": "rate_limit", "401": "authentication_failure"}
    other = ["boom 382429", "boom 429", "job 4011 gone", "503rd try", "error 401.5", "", None]
    df = spark.createDataFrame([(m,) for m in [*known, *other]], "m string")
    got = {r.m: r.c for r in df.select("m", T.first_class(F.col("m"), ranking.ERROR_CUES, "").alias("c")).collect()}
    assert got == known | dict.fromkeys(other, "")


def test_incidents_with_numbers_in_messages(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    con, at = duckdb.connect(), "TIMESTAMP '2024-01-02'"
    con.sql(f"CREATE TABLE events AS SELECT unnest([429, 382429, 14017, 7]) AS event_id, {at} AS ts, unnest([5, 20, 40, 60]) AS user_id, 'error' AS event_type, 2.5::DOUBLE AS value")
    con.sql("CREATE TABLE customer AS SELECT unnest([5, 20, 40, 60])::BIGINT AS c_custkey")
    for t in ("events", "customer"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for name in ("incidents_classified", "incidents_handled"):
        want = con.sql(entry.oracle_sql()[name])
        assert rows(entry.queries()[name](spark, str(tmp_path)), *want.columns) == sorted(want.fetchall(), key=str)


def test_name_candidates_of_repeated_and_missing_keys(spark):
    common = spark.createDataFrame([("the",)], "w string")
    df = spark.createDataFrame([(None, "We saw Anna Bell. The Anna Bell saw x'Anna Bell, and anna bell  again."), (1, "…Zoë Zoë"), (1, "Zoë " + "— " * 9)], "chapter int, text string")
    got = rows(spelling.name_candidates(df, "chapter", common, least_novel=2), "form", "count", "non_initial", "chapters")
    assert got == sorted([("Anna", 2, 2, 0), ("Bell", 3, 3, 0), ("Zoë", 3, 1, 1), ("saw", 2, 2, 0), ("Anna Bell", 2, 2, 0), ("x'Anna Bell", 1, 1, 0), ("anna bell", 1, 1, 0), ("Zoë Zoë", 1, 1, 1), ("anna", 1, 1, 0), ("bell", 1, 1, 0)], key=str)


def test_mentions_in_repeated_lines(spark):
    heard = spark.createDataFrame([("Ann", 5), ("An", 6), ("a name of many words", 7), ("a name of many letters", 8), ("Cy", 0), ("", 9), (None, 9)], "name string, first int")
    lines = spark.createDataFrame([(i, x) for i in range(3) for x in ("By Ann, a name of many words", "Cy", "", None)], "pos int, line string")
    leaks = spelling.preamble_leaks(lines, heard, 2)
    assert rows(leaks, "line", "name") == [("By Ann, a name of many words", n) for n in ("An", "Ann", "a name of many words") for _ in range(3)]
    none = spelling.preamble_leaks(lines, heard, 9)
    assert none.collect() == [] and none._jdf.queryExecution().optimizedPlan().nodeName() == "LocalRelation"  # lines aren't read
    ledger = spark.createDataFrame([("Cy", "met Ann")] * 2, "name string, note string")
    assert rows(spelling.sheet_gates(ledger, spark.createDataFrame([(2,)], "end int"), heard), "name", "other", "end") == [("Cy", "An", 2), ("Cy", "Ann", 2)]


def test_sheet_audit_reads_lines_once(spark):
    heard = spark.createDataFrame([("Ann", 1), ("Bob", 5)], "name string, first int")
    ends, prior = spark.createDataFrame([(2,), (6,)], "end int"), spark.createDataFrame([("Ann",)], "canonical string")
    ledger = spark.createDataFrame([("Ann", "sister of Bob", True), ("Bob", "knows Ann", True)], "name string, note string, carryover boolean")
    lines = spark.createDataFrame([(0, "by Bob"), (1, "by Bob"), (2, "by Ann")], "pos int, line string")
    got = spelling.sheet_audit(ledger, ends, heard, prior, lines)
    assert rows(got, "gate", "name", "other") == sorted([("note", "Ann", "Bob"), ("carryover", "Bob", ""), ("preamble", "Bob", "by Bob"), ("preamble", "Bob", "by Bob")], key=str)
    early = spelling.sheet_audit(ledger, ends, heard.where("first < 2"), prior, lines)
    assert rows(early, "gate", "name") == [("carryover", "Bob")] and "Generate" not in early._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_of_many_names_move_few_starts(spark, monkeypatch):
    plans, kept = {}, spelling._written
    monkeypatch.setattr(spelling, "_written", lambda df, name: plans.setdefault(name, df) and kept(df, name))
    monkeypatch.setattr(spelling.C, "BROADCAST_ROWS", 0)
    names = ["a", "ring 1", "ring 12", "large ring of gold 1", "large ring of gold 12", "ünder"]
    heard = spark.createDataFrame([(n, 5) for n in names], "name string, first int")
    texts = ["On the large ring of gold 12 of old", "ring 1, ring 1", "ünde", "xünder", "", None]
    ledger = spark.createDataFrame([("ring 1", t, False) for t in texts], "name string, note string, carryover boolean")
    lines = spark.createDataFrame(list(enumerate(texts)), "pos int, line string")
    ends, prior = spark.createDataFrame([(2,), (6,)], "end int"), spark.createDataFrame([], "canonical string")
    for heads in (2, 50_000):  # heads of names as short as can be, and whole prefixes
        monkeypatch.setattr(spelling, "MENTION_HEADS", heads, raising=False)
        assert rows(spelling.preamble_leaks(lines, heard, 2), "line", "name") == sorted([(t, n) for t in texts for n in names if t and n in t], key=str)
    assert "strategy=broadcast" in plans["mentions"]._jdf.queryExecution().optimizedPlan().toString()  # heads come first
    assert "SortMergeJoin" in plans["mentions"]._jdf.queryExecution().sparkPlan().toString()  # places aren't broadcast to names
    early = heard.withColumn("first", F.when(F.col("name") == "ring 1", 1).otherwise(F.col("first")))
    audit = spelling.sheet_audit(ledger, ends, early, prior, lines)
    want = [("note", "ring 1", n) for n in names[:1] + names[2:] if any(t and n in t for t in texts)] + [("preamble", n, t) for t in texts for n in names[:1] + names[2:] if t and n in t]
    assert rows(audit, "gate", "name", "other") == sorted(want, key=str) and {"ledger", "heard"} <= set(plans)  # made once
