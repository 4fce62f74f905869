"""Readers of transcripts, layers, manifests, markers, results and library listings. Schemas are fixed, never inferred."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import quote

WORD = "struct<w:string,start:double,end:double,p:double>"
SEGMENTS = f"array<struct<id:int,start:double,end:double,text:string,words:array<{WORD}>>>"
NORMALISED = f"schema string, chapter int, backend string, model string, language string, segments {SEGMENTS}"
RAW = (
    "text string, language string, segments array<struct<id:int,start:double,end:double,text:string,words:array<struct<word:string,start:double,end:double,probability:double>>>>, "
    "result struct<language:string>, params struct<language:string>, transcription array<struct<offsets:struct<`from`:bigint,`to`:bigint>,text:string,tokens:array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>,p:double>>>>"
)
MANIFEST = "source string, title string, style string, duration double, chapter_count int, chapters array<struct<chapter:int,title:string,marker_title:string,start:double,end:double,duration:double,file_path:string,words:int>>"


def chapter_of(name: Column) -> Column:
    """The number in ch<digits>.<extension>, else null."""
    return F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"^ch(\d+)\.", 1).try_cast("int")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents of either format with their chapter; NaN and infinities are read as such and become null in normalise()."""
    own = spark.read.schema(RAW).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)
    return own.withColumn("chapter", chapter_of(F.col("_metadata.file_path")))


def raw_format() -> Column:
    return F.when(F.col("transcription").isNotNull(), "b").when(F.col("segments").isNotNull(), "a").otherwise("unknown")


def is_complete() -> Column:
    return F.coalesce("transcription", F.lit(None)).isNotNull() | F.col("segments").isNotNull()


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def normalise(raw: DataFrame, schema_tag: str = C.TRANSCRIPT_SCHEMA, backend: str = "", model: str = "") -> DataFrame:
    """Either raw format as NORMALISED. Format b counts milliseconds, numbers segments by place and drops control tokens ([_...)."""
    word_a = lambda w: F.struct(F.trim(w["word"]).alias("w"), w["start"].alias("start"), w["end"].alias("end"), finite(w["probability"]).alias("p"))
    a = F.transform("segments", lambda s: F.struct(s["id"].alias("id"), s["start"].alias("start"), s["end"].alias("end"), F.trim(s["text"]).alias("text"), F.transform(F.coalesce(s["words"], F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>")), word_a).alias("words")))
    word_b = lambda t: F.struct(F.trim(t["text"]).alias("w"), (t["offsets"]["from"] / 1000).alias("start"), (t["offsets"]["to"] / 1000).alias("end"), finite(t["p"]).alias("p"))
    tokens = lambda s: F.filter(F.coalesce(s["tokens"], F.array().cast("array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>,p:double>>")), lambda t: ~F.startswith(t["text"], F.lit("[_")))
    b = F.transform("transcription", lambda s, i: F.struct(i.cast("int").alias("id"), (s["offsets"]["from"] / 1000).alias("start"), (s["offsets"]["to"] / 1000).alias("end"), F.trim(s["text"]).alias("text"), F.transform(tokens(s), word_b).alias("words")))
    language = F.when(F.col("transcription").isNotNull(), F.coalesce(F.nullif(F.trim("result.language"), F.lit("")), F.nullif(F.trim("params.language"), F.lit("")))).otherwise(F.col("language"))
    segments = F.when(F.col("transcription").isNotNull(), b.cast(SEGMENTS)).otherwise(a.cast(SEGMENTS))
    return raw.where(is_complete()).select(F.lit(schema_tag).alias("schema"), "chapter", F.lit(backend).alias("backend"), F.lit(model).alias("model"), language.alias("language"), segments.alias("segments"))


def read_normalised(spark: SparkSession, path: str, schema_tag: str = C.TRANSCRIPT_SCHEMA, lines: bool = False) -> DataFrame:
    """Normalised documents, one a file or, as write_normalised leaves them, one a line; a wrong schema tag is an error of the row
    that is read."""
    own = spark.read.schema(NORMALISED).option("multiLine", not lines).json(path)
    bad = F.raise_error(F.concat(F.lit("schema tag "), F.coalesce("schema", F.lit("null"))))
    return own.withColumn("schema", F.when(F.col("schema") == schema_tag, F.col("schema")).otherwise(bad))


def load_chapters(spark: SparkSession, path: str, manifest: DataFrame, schema_tag: str = C.TRANSCRIPT_SCHEMA, lines: bool = False) -> DataFrame:
    """Transcripts with their durations from a manifest's chapters; a transcript without one stops the sweep."""
    own = read_normalised(spark, path, schema_tag, lines).join(manifest.select("chapter", "duration"), "chapter", "left")
    return own.withColumn("duration", F.coalesce("duration", F.raise_error(F.concat(F.lit("no duration for chapter "), F.col("chapter").cast("string"))).cast("double")))


def segment_rows(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("chapter", F.posexplode("segments").alias("pos", "s")).select("chapter", "pos", "s.id", "s.start", "s.end", "s.text", "s.words")


def word_rows(transcripts: DataFrame) -> DataFrame:
    own = segment_rows(transcripts).select("chapter", F.col("pos").alias("segment"), F.posexplode("words").alias("at", "x"))
    return own.select("chapter", "segment", "at", "x.w", "x.start", "x.end", "x.p")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(chapter, text) of ch<digits>.txt files; other names are passed over."""
    own = spark.read.option("wholetext", True).text(path).select(chapter_of(F.col("_metadata.file_path")).alias("chapter"), F.col("value").alias("text"))
    return own.where("chapter IS NOT NULL")


def prefer(layer: DataFrame, base: DataFrame) -> DataFrame:
    """(chapter, text, layer): the repaired text of a chapter where there is one, else the base."""
    own = base.select("chapter", F.col("text").alias("_b")).join(layer.select("chapter", F.col("text").alias("_r")), "chapter", "full")
    return own.select("chapter", F.coalesce("_r", "_b").alias("text"), F.when(F.col("_r").isNotNull(), "repaired").otherwise("base").alias("layer"))


def whole_text(layer: DataFrame) -> DataFrame:
    """One row: all chapters of one book in order."""
    return layer.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "text"))), lambda x: x["text"]), " ").alias("text"))


def read_reference(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, text) of reference files, apostrophes folded, in natural order of path."""
    own = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(paths).select(F.col("_metadata.file_path").alias("path"), F.translate("value", "’", "'").alias("text"))
    natural = F.regexp_replace("path", r"(?<![0-9])([0-9]{1,12})(?![0-9])", "000000000000$1")
    return own.orderBy(F.regexp_replace(natural, r"0+([0-9]{12})", "$1"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path).select("title", "duration", F.inline("chapters").alias("chapter", "chapter_title", "marker_title", "start", "end", "chapter_duration", "file_path", "words"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """(title, start, end) of a probe's chapter list, whose times are texts, in order of start."""
    own = spark.read.schema("chapters array<struct<start_time:string,end_time:string,tags:struct<title:string>>>").option("multiLine", True).json(path)
    number = lambda c: F.coalesce(F.regexp_extract(c, r"^(-?[0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double"), F.lit(0.0))
    return own.select(F.explode("chapters").alias("c")).select(F.col("c.tags.title").alias("title"), number(F.col("c.start_time")).alias("start"), number(F.col("c.end_time")).alias("end")).orderBy("start")


def list_files(spark: SparkSession, root: str, glob: str, depth: int = 6) -> DataFrame:
    """(path, dir, length) of files below root, not under dot folders and at most `depth` folders down."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    base = quote(re.sub("^file:/+", "/", root.rstrip("/")) + "/")
    rest = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("^" + base), F.lit(""))
    return own.where(~rest.rlike(r"(^|/)\.") & (F.size(F.split(rest, "/")) <= depth)).withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))


def epub_metadata(files: DataFrame) -> DataFrame:
    """(path, title, author, readable, error) of epub files, read where the partitions are. Unreadable ones say why."""

    def run(batches):
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = re.sub(r"\.epub$", "", path.rsplit("/", 1)[-1])
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        opf = next(n for n in z.namelist() if n.endswith(".opf"))
                        text = z.read(opf).decode("utf-8", "replace")
                    get = lambda tag, text=text: next(iter(re.findall(rf"<dc:{tag}[^>]*>([^<]*)<", text)), None)
                    rows.append((path, get("title") or name, get("creator"), True, None))
                except Exception as e:
                    rows.append((path, name, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "title", "author", "readable", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, author string, readable boolean, error string")


def by_dir(files: DataFrame) -> DataFrame:
    return files.groupBy("dir").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def source_layout(files: DataFrame) -> DataFrame:
    """(dir, layout): one chaptered file, or one file a chapter."""
    return files.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).select("dir", F.when(F.col("n") == 1, "single").otherwise("files").alias("layout"))


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every result.json below root; none at all is an error."""
    own = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").option("multiLine", True).json(root)
    if own.isEmpty():
        raise ValueError(f"no result.json below {root}")
    return own


def strict_decode(df: DataFrame, column: str, schema: str, allowed: list[str]) -> DataFrame:
    """Adds value and error: JSON with keys that the schema lacks, or that doesn't parse, is an error."""
    extra = F.array_except(F.json_object_keys(column), F.array(*map(F.lit, allowed)))
    own = df.withColumn("value", F.from_json(column, schema))
    return own.withColumn("error", F.when(F.json_object_keys(column).isNull(), "malformed").when(F.size(extra) > 0, F.concat(F.lit("unknown: "), F.array_join(extra, ", "))))


def snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version") == version)


def works_of_search(hits: DataFrame) -> DataFrame:
    return hits.where("kind = 'work'").select("id", "title", F.transform("authors", lambda a: a["name"]).alias("authors"))


def series_members(series: DataFrame) -> DataFrame:
    return series.select(F.col("id").alias("series_id"), F.posexplode("members").alias("place", "work_id"))


def title_names(texts: DataFrame, common: list[str]) -> DataFrame:
    """(name,) of capitalised runs in title lines, common words left out."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("l")).where(F.length("l") <= 80)
    runs = F.regexp_extract_all("l", F.lit(r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"), F.lit(1))
    return lines.select(F.explode(runs).alias("name")).where(~F.lower("name").isin(*common)).distinct()


def reference_union(layer: DataFrame, references: DataFrame) -> DataFrame:
    """(origin, text): a text layer and the reference files as one vocabulary source."""
    own = layer.select(F.concat(F.lit("chapter "), F.col("chapter").cast("string")).alias("origin"), "text")
    return own.unionByName(references.select(F.col("path").alias("origin"), "text"))


def sidecar_shape(characters: DataFrame, recaps: DataFrame) -> DataFrame:
    """(work, names, chapters): lower-cased distinct names and aliases, and the chapters that recaps run through."""
    a = characters.select("work", F.explode_outer("characters").alias("c")).select("work", F.explode(F.concat(F.array("c.name"), F.coalesce("c.aliases", F.array().cast("array<string>")))).alias("n"))
    a = a.select("work", F.lower(F.trim("n")).alias("n")).where("n <> ''").groupBy("work").agg(F.array_sort(F.collect_set("n")).alias("names"))
    b = recaps.select("work", F.explode_outer("recaps").alias("r")).groupBy("work").agg(F.array_sort(F.collect_set("r.through.chapter")).alias("chapters"))
    return a.join(b, "work", "full")


def prior_canonicals(spark: SparkSession, path: str | None, schema: str = "canonical string") -> tuple[DataFrame, bool]:
    """(names, whether there is a file): an absent ledger isn't an empty one."""
    if path is None:
        return spark.createDataFrame([], schema), False
    return spark.read.schema(schema).json(path).select(F.trim("canonical").alias("canonical")).where("canonical <> ''").distinct(), True


VERDICTS = "chapter int, pos int, verdict string, text string"


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of tail verdicts, a JSON array; without a file it is empty."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], VERDICTS)
    return spark.read.schema(VERDICTS).option("multiLine", True).json(path)


def verdicts_by_chapter(verdicts: DataFrame) -> DataFrame:
    """The last verdict of each chapter, by pos."""
    rest = [c for c in verdicts.columns if c != "chapter"]
    return verdicts.groupBy("chapter").agg(F.max_by(F.struct(*rest), "pos").alias("x")).select("chapter", "x.*")


def folder_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("dir").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))


def check_suite(suite: dict, stages: list[str]) -> list[str]:
    """Problems of an experiment suite {cases: [{name, path, digest}], profiles: [{name, stages: {...}}]}."""
    out = [f"unknown field: {k}" for k in suite if k not in ("cases", "profiles", "repeats", "seed")]
    for c in suite.get("cases", []):
        if ".." in c.get("path", "").split("/") or c.get("path", "").startswith("/"):
            out.append(f"case {c.get('name')}: path leaves the suite")
        if not re.fullmatch(r"[0-9a-f]{64}", c.get("digest", "")):
            out.append(f"case {c.get('name')}: digest")
    for p in suite.get("profiles", []):
        out += [f"profile {p.get('name')}: no stage {s}" for s in stages if s not in p.get("stages", {})]
    return out


def load_suite(spark: SparkSession, path: str, stages: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cases, profiles) of a JSON suite; a problem is an error."""
    import json

    suite = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))  # a suite is one small file
    if problems := check_suite(suite, stages):
        raise ValueError("; ".join(problems))
    cases = spark.createDataFrame([(c["name"], c["path"], c["digest"]) for c in suite["cases"]], "case string, path string, digest string")
    profiles = spark.createDataFrame([(p["name"], p["stages"]) for p in suite["profiles"]], "profile string, stages map<string,string>")
    return cases, profiles


def scan_library(audio: DataFrame, epubs: DataFrame) -> DataFrame:
    """(dir, files, layout, epubs): each folder's audio files with the number of its readable epubs."""
    own = audio.groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    books = epubs.groupBy("dir").agg(F.count_if("readable").alias("epubs"))
    out = own.join(books, "dir", "full")
    return out.select("dir", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("files") == 1, "single").when(F.col("files") > 1, "files").alias("layout"), F.coalesce("epubs", F.lit(0)).alias("epubs"))
