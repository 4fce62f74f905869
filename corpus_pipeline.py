"""The corpus pipeline: raw documents to packed training sequences, one operator a stage.

Each stage works on all that the one before it kept. All but the last return the columns of `documents`; other columns of a
table are not read, so their names can't clash. An empty table passes every stage as an empty one. Rows may repeat and ids may
be null or repeat: until near duplicates go, each row is judged on its own. Texts move between tasks in no stage, unless what
has to meet them is too large for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import ship, spread
from lectern.llm import minhash, packing, pii, quality_classifier, quality_rules
from lectern.llm.common import Tables, few, new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text; n_chars follows it."""
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: failing lines go, and so do documents that fail.

    Null, empty and blank texts have no words and go. A text of any length is judged whole; texts that repeat fare alike.
    """
    judged = quality_rules.judge(spread(docs), carry=("lang", "source"))
    return _with_text(judged.where("kept"), "cleaned")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it scores as bad go. Weak labels and scorer come from the documents at hand.

    Null, empty and blank texts go. A score of exactly the bound stays; texts that repeat fare alike.
    """
    ship(spark)
    model = quality_classifier.fit(docs)
    judged = quality_classifier.classify(docs, model, carry=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at 0.8: the smallest id of each group stays.

    Rows that repeat an id and its text become one; different texts of one id share its fate. Null, empty and blank texts are
    alike with nothing and stay. Rows without an id stay, one of each text. Only ids meet what is decided: they are broadcast
    where they are few, and texts move only for ids that repeat.
    """
    ship(spark)
    tables = Tables(spark)
    gone = tables.write(minhash.near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id").distinct(), "gone")
    left = docs.select(COLUMNS).join(F.broadcast(gone) if few(gone) else gone.hint("merge"), "doc_id", "left_anti")
    twice = tables.write(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    twice = F.broadcast(twice) if few(twice) else twice.hint("merge")
    again = left.join(twice, "doc_id", "left_semi").unionByName(left.where("doc_id IS NULL")).dropDuplicates(["doc_id", "text"])
    return left.where("doc_id IS NOT NULL").join(twice, "doc_id", "left_anti").unionByName(again)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans give way to tags, disclosing terms are generalised or removed.

    Null texts stay null and empty ones empty; rows that repeat fare alike; no row goes.
    """
    return _with_text(pii.find(docs, carry=("lang", "source")), "sanitised")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 8192 bytes.

    Null and empty texts are an end mark each; longer texts than a sequence are cut; rows that repeat are packed each.
    """
    ship(spark)
    return packing.pack_documents(docs, capacity=8192)


STAGES = [
    ("quality_rules", clean_lines),
    ("quality_classifier", classify_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", sanitise),
    ("best_fit_packing", pack),
]

#: SQL can't express the classifier's training; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
