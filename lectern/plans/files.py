"""Registered queries of readers and writers: each writes stand-ins made of the driver's tables and reads them back."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from ..operators import experiments as X
from ..operators import qa
from ..sources import schemas, sinks, transcripts
from ..sources.shared import shared_path
from ..streaming import events as stream
from . import standins as S
from .more import events, orders, query


def nations(spark, sf) -> list[tuple[int, str, int]]:
    """(key, name, region) of the nations, a fixed handful, for files that carry a name of their own."""
    return [(r[0], r[1], r[2]) for r in S.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]


def put(spark, root: str, files: dict[str, str | bytes]) -> str:
    for name, data in files.items():
        sinks.write_atomic(spark, f"{root}/{name}", data if isinstance(data, bytes) else data.encode())
    return root


# Transcripts -------------------------------------------------------------------------------------


def raw_layer(spark, sf) -> str:
    """ch<n>.json in both raw formats, and of neither."""
    files = {}
    for n, name, _ in nations(spark, sf):
        p = "NaN" if n % 2 else "0.5"
        a = f'{{"text": "x", "language": "en", "segments": [{{"id": 7, "start": 0.5, "end": {n}.0, "text": " {name} ", "words": [{{"word": " {name}", "start": 0.5, "end": 1.0, "probability": {p}}}, {{"word": "b", "start": 1.0, "end": 2.0, "probability": Infinity}}]}}]}}'
        b = f'{{"result": {{"language": "{" " if n % 2 else "fr"}"}}, "params": {{"language": "de"}}, "transcription": [{{"offsets": {{"from": 500, "to": {n}000}}, "text": " {name}", "tokens": [{{"text": "[_BEG_]", "offsets": {{"from": 0, "to": 0}}, "p": 0.9}}, {{"text": " {name}", "offsets": {{"from": 500, "to": 900}}, "p": {p}}}]}}]}}'
        files[f"ch{n:03d}.json"] = (a, b, '{"text": "cut off"}')[n % 3]
    return put(spark, shared_path(spark, "layer-raw"), files | {"notes.json": "{}"})


@query("SELECT n_nationkey AS chapter, ['a', 'b', 'unknown'][n_nationkey % 3 + 1] AS format, n_nationkey % 3 < 2 AS complete FROM nation")
def raw_formats(spark, sf):
    own = transcripts.read_raw(spark, raw_layer(spark, sf)).where("chapter IS NOT NULL")
    return own.select("chapter", transcripts.raw_format().alias("format"), transcripts.is_complete().alias("complete"))


@query("""SELECT n_nationkey AS chapter, CASE WHEN n_nationkey % 3 = 0 THEN 'en' WHEN n_nationkey % 2 = 1 THEN 'de' ELSE 'fr' END AS language, CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE 0 END AS segment, n_nationkey::DOUBLE AS "end", w, a AS start, CASE WHEN w <> 'b' AND n_nationkey % 2 = 0 THEN 0.5 END AS p
  FROM nation, (SELECT 1 AS k UNION ALL SELECT 2), LATERAL (SELECT CASE WHEN k = 1 THEN n_name ELSE 'b' END AS w, CASE WHEN k = 1 THEN 0.5 ELSE 1.0 END AS a) WHERE n_nationkey % 3 < 2 AND (k = 1 OR n_nationkey % 3 = 0)""")
def raw_normalised(spark, sf):
    own = transcripts.normalise(transcripts.read_raw(spark, raw_layer(spark, sf)).where("chapter IS NOT NULL"))
    words = own.select("chapter", "language", F.explode("segments").alias("s")).select("chapter", "language", F.col("s.id").alias("segment"), "s.end", F.explode("s.words").alias("x"))
    return words.select("chapter", "language", "segment", "end", "x.w", F.col("x.start").alias("start"), "x.p")


def normalised(spark, sf):
    turns = S.table(spark, sf, "conversations").select(F.col("conv_id").cast("int").alias("chapter"), "turn", "text")
    word = F.transform(F.slice(F.split("text", " "), 1, 3), lambda w, i: F.struct(w.alias("w"), i.cast("double").alias("start"), (i + 0.5).cast("double").alias("end"), F.lit(0.5).alias("p")))
    segment = F.struct(F.col("turn").cast("int").alias("id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text", word.alias("words"))
    own = turns.withColumn("s", segment).groupBy("chapter").agg(F.array_sort(F.collect_list("s")).alias("segments"))
    return own.select(F.lit("transcript/v1").alias("schema"), "chapter", F.lit("b").alias("backend"), F.lit("m").alias("model"), F.lit("en").alias("language"), "segments")


@query("SELECT conv_id::INT AS chapter, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, turn::INT AS id, md5(text) AS digest, (conv_id * 2.0 + 5)::DOUBLE AS duration FROM conversations")
def transcripts_loaded(spark, sf):
    path = shared_path(spark, "layer-json")
    sinks.write_normalised(normalised(spark, sf), path)
    manifest = normalised(spark, sf).select("chapter", (F.col("chapter") * 2.0 + 5).alias("duration"))
    own = transcripts.load_chapters(spark, path, manifest, lines=True)
    return transcripts.segment_rows(own).join(own.select("chapter", "duration"), "chapter").select("chapter", "pos", "id", F.md5("text").alias("digest"), "duration")


@query("SELECT conv_id::INT AS chapter, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS segment, unnest(string_split(text, ' ')[1:3]) AS w FROM conversations")
def transcript_words(spark, sf):
    path = shared_path(spark, "layer-json")
    sinks.write_normalised(normalised(spark, sf), path)
    return transcripts.word_rows(transcripts.read_normalised(spark, path, lines=True)).select("chapter", "segment", "w")


# Layers of texts ---------------------------------------------------------------------------------


def layers(spark, sf) -> tuple[str, str]:
    own = nations(spark, sf)
    base = put(spark, shared_path(spark, "layer-text"), {f"ch{n:03d}.txt": f"the tale of {name}" for n, name, _ in own} | {"notes.txt": "none", "chx.txt": "none"})
    return base, put(spark, shared_path(spark, "layer-repaired"), {f"ch{n:03d}.txt": f"{name} mended" for n, name, _ in own if n % 4 == 0})


@query("SELECT n_nationkey AS chapter, CASE WHEN n_nationkey % 4 = 0 THEN n_name || ' mended' ELSE 'the tale of ' || n_name END AS text, CASE WHEN n_nationkey % 4 = 0 THEN 'repaired' ELSE 'base' END AS layer FROM nation")
def layers_preferred(spark, sf):
    base, repaired = layers(spark, sf)
    return transcripts.prefer(transcripts.read_texts(spark, repaired), transcripts.read_texts(spark, base))


@query("SELECT md5(string_agg('the tale of ' || n_name, ' ' ORDER BY n_nationkey)) AS digest FROM nation")
def layer_whole(spark, sf):
    return transcripts.whole_text(transcripts.read_texts(spark, layers(spark, sf)[0])).select(F.md5("text").alias("digest"))


@query("SELECT n_regionkey AS chapter, 'x ' || n_regionkey AS text FROM (SELECT DISTINCT n_regionkey FROM nation)")
def layer_written(spark, sf):
    path = shared_path(spark, "layer-out")
    sinks.write_texts(S.table(spark, sf, "nation").select(F.col("n_regionkey").alias("chapter")).distinct().withColumn("text", F.concat(F.lit("x "), F.col("chapter").cast("string"))), path)
    return spark.read.text(path).select(F.col("chapter").cast("long").alias("chapter"), F.col("value").alias("text"))


@query("SELECT 'r' || n_nationkey || '.txt' AS path, 'it' || chr(39) || 's ' || n_name AS text, row_number() OVER (ORDER BY n_nationkey) AS place FROM nation")
def references_read(spark, sf):
    """Reference files in natural order: r2 before r10."""
    root = put(spark, shared_path(spark, "refs"), {f"r{n}.txt": f"it’s {name}" for n, name, _ in nations(spark, sf)})
    own = transcripts.read_reference(spark, [root])
    listed = own.select(F.collect_list(F.struct(F.regexp_replace("path", ".*/", "").alias("path"), "text")).alias("l"))
    return listed.select(F.posexplode("l").alias("place", "x")).select("x.path", "x.text", (F.col("place") + 1).alias("place"))


@query("SELECT 'chapter ' || n_nationkey AS origin, 'the tale of ' || n_name AS text FROM nation UNION ALL SELECT 'r.txt', 'one more'")
def references_united(spark, sf):
    root = put(spark, shared_path(spark, "refs"), {"r.txt": "one more"})
    refs = transcripts.read_reference(spark, [root]).withColumn("path", F.regexp_replace("path", ".*/", ""))
    return transcripts.reference_union(transcripts.read_texts(spark, layers(spark, sf)[0]), refs)


# Manifests, markers, folders ---------------------------------------------------------------------


@query("SELECT 'Atlas' AS title, n_nationkey::INT AS chapter, n_name AS chapter_title, n_nationkey * 10.0::DOUBLE AS start, 10.0::DOUBLE AS chapter_duration FROM nation")
def manifest_read(spark, sf):
    chapters = [{"chapter": n, "title": name, "start": n * 10.0, "end": n * 10.0 + 10, "duration": 10.0, "words": 3} for n, name, _ in nations(spark, sf)]
    root = put(spark, shared_path(spark, "book"), {"manifest.json": json.dumps({"source": "a.m4b", "title": "Atlas", "duration": 250.0, "chapters": chapters}, indent=1)})
    return transcripts.read_manifest(spark, f"{root}/manifest.json").select("title", "chapter", "chapter_title", "start", "chapter_duration")


@query("SELECT n_name AS title, CASE WHEN n_nationkey % 5 = 0 THEN 0.0 ELSE n_nationkey * 1.5 END::DOUBLE AS start, n_nationkey + 0.25::DOUBLE AS \"end\" FROM nation")
def markers_read(spark, sf):
    chapters = [{"start_time": "n/a" if n % 5 == 0 else f"{n * 1.5:.6f}", "end_time": f"{n}.250000", "tags": {"title": name}} for n, name, _ in nations(spark, sf)]
    root = put(spark, shared_path(spark, "book"), {"probe.json": json.dumps({"chapters": chapters})})
    return transcripts.read_markers(spark, f"{root}/probe.json")


def library(spark, sf) -> str:
    """A folder a region: audio files, epubs, one of which can't be read, and what a scan passes over."""
    files: dict[str, str | bytes] = {}
    for n, name, region in nations(spark, sf):
        files[f"r{region}/{n}.mp3"] = "x" * (n + 1)
        if n % 2 == 0:
            book = io.BytesIO()
            with zipfile.ZipFile(book, "w") as z:
                z.writestr("a/content.opf", f"<package><dc:title>{name}</dc:title><dc:creator>Author {n % 3}</dc:creator></package>")
            files[f"r{region}/{n}.epub"] = book.getvalue() if n % 6 else b"no zip"
        files[f".hidden/{n}.mp3"] = "y"
    return put(spark, shared_path(spark, "library"), files)


def _short(path):
    return F.element_at(F.split(path, "/"), -1)


@query("SELECT 'r' || n_regionkey AS dir, count(*) AS files, sum(n_nationkey + 1)::BIGINT AS bytes, string_agg(n_nationkey || '.mp3', ',' ORDER BY n_nationkey || '.mp3') AS paths, CASE WHEN count(*) = 1 THEN 'single' ELSE 'files' END AS layout FROM nation GROUP BY 1")
def folders_listed(spark, sf):
    own = transcripts.list_files(spark, library(spark, sf), "*.mp3")
    sizes, by = transcripts.folder_sizes(own), transcripts.by_dir(own)
    out = sizes.join(by, "dir").join(transcripts.source_layout(own), "dir")
    return out.select(_short("dir").alias("dir"), "files", "bytes", F.array_join(F.array_sort(F.transform("paths", _short)), ",").alias("paths"), "layout")


@query("SELECT n_nationkey || '.epub' AS path, CASE WHEN n_nationkey % 6 = 0 THEN n_nationkey::VARCHAR ELSE n_name END AS title, CASE WHEN n_nationkey % 6 <> 0 THEN 'Author ' || n_nationkey % 3 END AS author, n_nationkey % 6 <> 0 AS readable FROM nation WHERE n_nationkey % 2 = 0")
def epubs_described(spark, sf):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(library(spark, sf))
    return transcripts.epub_metadata(files).select(_short("path").alias("path"), "title", "author", "readable")


@query("SELECT 'r' || n_regionkey AS dir, count(*) AS files, count(*) FILTER (WHERE n_nationkey % 2 = 0 AND n_nationkey % 6 <> 0) AS epubs FROM nation GROUP BY 1")
def library_scanned(spark, sf):
    root = library(spark, sf)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(root)
    epubs = transcripts.epub_metadata(found).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    out = transcripts.scan_library(transcripts.list_files(spark, root, "*.mp3"), epubs)
    return out.select(_short("dir").alias("dir"), "files", "epubs")


# Catalogues and reports --------------------------------------------------------------------------


@query("SELECT p_partkey AS id FROM part WHERE p_size = 7")
def snapshot_restored(spark, sf):
    path = shared_path(spark, "snapshot")
    S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("version")).write.partitionBy("version").parquet(path)
    return transcripts.snapshot(spark, path, 7).select("id")


@query("SELECT user_id AS id FROM events WHERE event_type = 'view' AND floor(value) = (SELECT max(floor(value)) FROM events WHERE event_type = 'view')")
def snapshot_persisted(spark, sf):
    path = shared_path(spark, "snapshot")
    sinks.persist_snapshot(events(spark, sf).select(F.col("user_id").alias("id"), F.floor("value").alias("seq"), F.when(F.col("event_type") == "view", "done").otherwise("failed").alias("status")), path)
    return spark.read.parquet(path).select("id")


@query("SELECT p_partkey AS id, p_brand || ',' || p_type AS authors FROM part WHERE p_size % 2 = 0")
def works_searched(spark, sf):
    hits = S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "work").otherwise("person").alias("kind"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("authors"))
    return transcripts.works_of_search(hits).select("id", F.array_join("authors", ",").alias("authors"))


@query("SELECT n_regionkey AS series_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS place, n_nationkey AS work_id FROM nation")
def series_listed(spark, sf):
    s = S.table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("members"))
    return transcripts.series_members(s)


@query("SELECT n_nationkey::INT AS run, n_name AS profile FROM nation")
def results_read(spark, sf):
    files = {f"{n}/result.json": json.dumps({"run": n, "profile": name}) for n, name, _ in nations(spark, sf)}
    return transcripts.read_results(spark, put(spark, shared_path(spark, "results"), files | {"x/other.json": "{}"}), "run int, profile string")


@query("SELECT 'case ' || n_nationkey AS \"case\", 'c/' || n_nationkey AS path, 'fast' AS profile, 'm' || n_nationkey AS model FROM nation")
def suites_loaded(spark, sf):
    cases = [{"name": f"case {n}", "path": f"c/{n}", "digest": f"{n:064x}"} for n, *_ in nations(spark, sf)]
    suite = {"cases": cases, "profiles": [{"name": "fast", "stages": {"asr": "m"}}], "repeats": 2, "seed": 1}
    root = put(spark, shared_path(spark, "suite"), {"suite.json": json.dumps(suite)})
    own, profiles = transcripts.load_suite(spark, f"{root}/suite.json", ["asr"])
    return own.crossJoin(F.broadcast(profiles)).select("case", "path", "profile", F.concat(F.col("stages")["asr"], F.regexp_extract("path", "([0-9]+)$", 1)).alias("model"))


@query("SELECT problem FROM (VALUES ('case a: path leaves the suite'), ('case a: digest'), ('profile p: no stage asr'), ('unknown field: extra')) v(problem)")
def suites_checked(spark, sf):
    bad = {"cases": [{"name": "a", "path": "../x", "digest": "zz"}], "profiles": [{"name": "p", "stages": {}}], "extra": 1}
    return spark.createDataFrame([(p,) for p in transcripts.check_suite(bad, ["asr"])], "problem string")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 1 THEN 'unknown: more' WHEN 2 THEN 'malformed' END AS error, CASE WHEN p_partkey % 3 < 2 THEN p_size::INT END AS size FROM part")
def sidecars_decoded(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"size": '), size, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"size": '), size, F.lit(', "more": 1}'))).otherwise("{cut")
    own = transcripts.strict_decode(S.table(spark, sf, "part").select(k.alias("id"), text.alias("t")), "t", "size int", ["size"])
    return own.select("id", "error", F.col("value.size").alias("size"))


@query("SELECT n_regionkey AS work, string_agg(DISTINCT lower(n_name), ',' ORDER BY lower(n_name)) AS names, string_agg(DISTINCT n_nationkey % 2, ',' ORDER BY n_nationkey % 2) AS chapters FROM nation GROUP BY 1")
def sidecars_shaped(spark, sf):
    n = S.table(spark, sf, "nation")
    chars = n.groupBy(F.col("n_regionkey").alias("work")).agg(F.collect_list(F.struct(F.concat(F.lit(" "), "n_name").alias("name"), F.array("n_name").alias("aliases"))).alias("characters"))
    recaps = n.groupBy(F.col("n_regionkey").alias("work")).agg(F.collect_list(F.struct(F.struct((F.col("n_nationkey") % 2).alias("chapter")).alias("through"))).alias("recaps"))
    return transcripts.sidecar_shape(chars, recaps).select("work", F.array_join("names", ",").alias("names"), F.array_join(F.transform("chapters", lambda c: c.cast("string")), ",").alias("chapters"))


@query("SELECT DISTINCT 'Old ' || upper(p_type[1]) || lower(p_type[2:]) AS name FROM part WHERE p_type <> 'PROMO' UNION SELECT 'Blue'")
def names_from_titles(spark, sf):
    p = S.table(spark, sf, "part").where("p_type <> 'PROMO'").select(F.concat(F.lit("Old "), F.initcap("p_type"), F.lit(" and Blue\nThe\n"), F.repeat(F.lit("Very Long "), 10)).alias("text"))
    return transcripts.title_names(p, ["the"])


@query("SELECT DISTINCT p_name AS canonical FROM part")
def canonicals_prior(spark, sf):
    path = shared_path(spark, "prior")
    S.table(spark, sf, "part").select(F.concat(F.lit(" "), "p_name").alias("canonical")).unionByName(spark.createDataFrame([(" ",)], "canonical string")).write.json(path)
    return transcripts.prior_canonicals(spark, path)[0]


@query("SELECT n_regionkey::INT AS chapter, arg_max(n_name, n_nationkey) AS verdict, max(n_nationkey)::INT AS pos FROM nation GROUP BY 1")
def verdicts_loaded(spark, sf):
    rows = [{"chapter": region, "pos": n, "verdict": name, "text": ""} for n, name, region in nations(spark, sf)]
    root = put(spark, shared_path(spark, "book"), {"verdicts.json": json.dumps(rows)})
    none = transcripts.load_verdicts(spark, f"{root}/absent.json")
    return transcripts.verdicts_by_chapter(transcripts.load_verdicts(spark, f"{root}/verdicts.json").unionByName(none)).select("chapter", "verdict", "pos")


@query("SELECT doc_id AS chapter, CASE WHEN toxic = 1 THEN 'new' ELSE 'old' END AS verdict FROM labels")
def verdicts_merged(spark, sf):
    v = S.table(spark, sf, "labels").select(F.col("doc_id").alias("chapter"), "toxic")
    return sinks.merge_verdicts(v.select("chapter", F.lit("old").alias("verdict")), v.where("toxic = 1").select("chapter", F.lit("new").alias("verdict")))


@query("SELECT 'repair ' || n_nationkey AS line FROM nation UNION ALL SELECT 'again ' || r_regionkey FROM region")
def repairs_logged(spark, sf):
    path = shared_path(spark, "log")
    sinks.append_log(S.table(spark, sf, "nation").select(F.concat(F.lit("repair "), F.col("n_nationkey").cast("string"))), path)
    sinks.append_log(S.table(spark, sf, "region").select(F.concat(F.lit("again "), F.col("r_regionkey").cast("string"))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '\"' || p_name || chr(39) || 's\"' ELSE chr(39) || p_name || '\\n' || chr(39) END AS quoted FROM part")
def texts_quoted(spark, sf):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("'s"))).otherwise(F.concat("p_name", F.lit("\n")))
    return S.table(spark, sf, "part").select("p_partkey", sinks.python_repr(text).alias("quoted"))


@query("SELECT n_regionkey AS chapter, string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS markdown FROM nation GROUP BY 1")
def findings_bulleted(spark, sf):
    return sinks.bullet_list(S.table(spark, sf, "nation").select(F.col("n_regionkey").alias("chapter"), "n_name"), "chapter", F.col("n_name"))


@query("SELECT 'nations' AS detector, '{\"n_nationkey\":' || n_nationkey || '}' AS finding FROM nation UNION ALL SELECT 'regions', '{\"r_name\":\"' || r_name || '\"}' FROM region")
def reports_written(spark, sf):
    path = shared_path(spark, "report")
    sinks.write_report({"nations": S.table(spark, sf, "nation").select("n_nationkey"), "regions": S.table(spark, sf, "region").select("r_name")}, path)
    return spark.read.text(path).select("detector", F.col("value").alias("finding"))


@query("SELECT doc_id AS chapter, 'retranscribe' AS action FROM labels WHERE quality = 0")
def plans_written(spark, sf):
    path = shared_path(spark, "plan")
    sinks.write_plan(S.table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("chapter"), F.lit("retranscribe").alias("action")), path)
    return qa.non_accept(spark.read.schema("chapter long, action string").json(path))


@query("SELECT count(*) FILTER (WHERE s_acctbal < 0) = 0 AS clean, string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal < 0) AS errors, string_agg(s_name, ',' ORDER BY s_name) FILTER (WHERE s_acctbal >= 9000) AS warnings FROM (VALUES (false), (true)) v(c) LEFT JOIN supplier ON (s_acctbal >= 0) = c GROUP BY c")
def validations_reported(spark, sf):
    """One report of the suppliers in debt, one of the others."""
    out = None
    for clean in (False, True):
        own = S.table(spark, sf, "supplier").where((F.col("s_acctbal") >= 0) == clean)
        one = sinks.validation_report(own.select(F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") >= 9000, "warning").otherwise("none").alias("severity"), F.col("s_name").alias("text")))
        out = one if out is None else out.unionByName(one)
    return out.select("clean", F.nullif(F.array_join("errors", ","), F.lit("")).alias("errors"), F.nullif(F.array_join("warnings", ","), F.lit("")).alias("warnings"))


@query("SELECT n_nationkey AS id, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")
def json_canonical(spark, sf):
    n = S.table(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name")
    return n.select(F.col("n_nationkey").alias("id"), sinks.canonical_json(n).alias("json"))


@query("SELECT event_id, CASE WHEN event_type <> 'view' THEN 'id: ' || event_id || chr(10) ELSE '' END || 'event: ' || event_type || chr(10) || 'data: ' || user_id || chr(10) || chr(10) AS frame FROM events")
def frames_sent(spark, sf):
    e = events(spark, sf).select("event_id", F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("data"))
    return e.select("event_id", sinks.sse_frame("event_id", "type", "data", durable=F.col("type") != "view").alias("frame"))


_TABLE = "'| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey)"


@query(f"SELECT {_TABLE} AS markdown FROM region")
def tables_rendered(spark, sf):
    return sinks.markdown_table(S.table(spark, sf, "region").select("r_regionkey", "r_name"), "r_regionkey")


@query(f"SELECT 'json' AS kind, count(*) AS n FROM region UNION ALL SELECT 'lines', count(*) + 2 FROM region")
def histories_written(spark, sf):
    path = shared_path(spark, "history")
    sinks.write_history(S.table(spark, sf, "region").select("r_regionkey", "r_name"), path)
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(spark.read.json(f"{path}/history"), "json").unionByName(n(spark.read.text(f"{path}/history.md"), "lines"))


@query("SELECT string_agg(n || chr(9) || p_type, chr(10) ORDER BY n DESC, p_type) AS log FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)")
def corrections_logged(spark, sf):
    return sinks.correction_log(S.table(spark, sf, "part").groupBy(F.col("p_type").alias("pattern")).count())


@query("SELECT n_regionkey AS \"end\", string_agg('- ' || n_name, chr(10) ORDER BY n_name) AS markdown FROM nation GROUP BY 1")
def sheets_written(spark, sf):
    return sinks.sheets(S.table(spark, sf, "nation").select(F.col("n_regionkey").alias("end"), F.col("n_name").alias("name")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS error, NULL::BIGINT AS batch_id FROM orders")
def ledger_migrated(spark, sf):
    """A table that holds files of two versions, opened as the newest."""
    root = shared_path(spark, "ledger")
    o = orders(spark, sf)
    o.where("id % 2 = 1").select("id", "status").write.mode("append").parquet(f"{root}/books")
    o.where("id % 2 = 0").select("id", "status", F.col("note").alias("error")).write.mode("append").parquet(f"{root}/books")
    return schemas.open_ledger(spark, root, "books")["books"].select("id", "error", "batch_id")


# Streams' batch forms ----------------------------------------------------------------------------


@query("SELECT max(event_id) AS cursor FROM events")
def cursor_read(spark, sf):
    return stream.cursor(events(spark, sf))


_PATCH = "p AS (SELECT user_id AS id, arg_max(CASE WHEN event_type <> 'error' THEN event_type END, event_id) AS keep, arg_max([CASE WHEN event_type <> 'error' THEN event_type END], event_id)[1] AS status FROM events WHERE value > 20 GROUP BY 1)"


@query(f"WITH {_PATCH} SELECT coalesce(c.id, p.id) AS id, coalesce(p.status, c.status) AS status, c.seg FROM (SELECT c_custkey AS id, 'idle' AS status, c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) c FULL JOIN p ON p.id = c.id")
def states_patched(spark, sf):
    state = S.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit("idle").alias("status"), F.col("c_mktsegment").alias("seg"))
    changes = events(spark, sf).where("value > 20").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"), "event_id")
    return stream.patch(state, changes, "id")


@query("SELECT c_custkey AS id, v AS eta FROM customer LEFT JOIN (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) ON user_id = c_custkey")
def etas_replaced(spark, sf):
    state = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(1.0).alias("eta"))
    return stream.replace(state, events(spark, sf).where("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("eta")), "id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1996-01-01'")
def retries_due(spark, sf):
    return stream.due(orders(spark, sf).select("id", F.when(F.col("status") != "F", F.col("at")).alias("retry_at")), S.at("1996-01-01 00:00:00")).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate + INTERVAL 7 DAYS <= TIMESTAMP '1996-01-01'")
def issues_stale(spark, sf):
    return stream.stale(orders(spark, sf).select("id", F.col("at").alias("updated_at")), S.at("1996-01-01 00:00:00")).select("id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def ticks_counted(spark, sf):
    """A ticking stream that is let run until it has seen all there is; what each batch saw is added up."""
    path, out = shared_path(spark, "events"), shared_path(spark, "ticks")
    S.table(spark, sf, "events").select("event_id", "user_id").repartition(3).write.parquet(path)
    source = spark.readStream.schema("event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(path)
    running = stream.ticking(source, lambda df, n: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batch={n}"), every="0 seconds")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(out).groupBy("user_id").agg(F.sum("n").alias("n"))


@query("SELECT event_type AS stage, 'b' AS backend, count(*) AS runs FROM events GROUP BY 1")
def events_persisted(spark, sf):
    path = shared_path(spark, "events")
    S.table(spark, sf, "events").select("event_id", F.col("event_type").alias("stage")).repartition(2).write.parquet(path)
    out = stream.run_to_end(spark.readStream.schema("event_id long, stage string").option("maxFilesPerTrigger", 1).parquet(path), "append")
    return X.history(out.withColumn("backend", F.lit("b")).withColumn("model", F.lit("m")).withColumn("ok", F.lit(True)).withColumn("seconds", F.lit(1.0))).select("stage", "backend", "runs")
