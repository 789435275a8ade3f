"""From raw documents to a mix: five stages, each written as Parquet and reread as the next one's input.

A stage takes a table with the columns of documents (COLUMNS must be there; others go) and returns these columns, the
last one its own. All columns may hold nulls, ids may be null or repeated, rows may be repeated, texts may be empty or of
any length, and a table may be empty: an empty table gives an empty table. What each case means stands at the stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontam, jaccard, ledger, mixing, substring
from vellum.llm.kit import cut_lineage, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, as ids may be null or repeated; written once, so that it stays the same."""
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the policy rejects.

    Row by row, so repeated rows and ids go or stay alike; a null or wordless text has too few words and goes.
    """
    return ledger.apply_policy(ledger.ledger(docs.select(*COLUMNS)), "v1").where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows with a null or wordless text are copies of nothing and stay. Groups are groups of rows: a null id takes part like any other, and rows with one doc_id are copies only if
    their texts are. The row with the least doc_id stays, null last; among equal ids the least hash of the text, then any.
    """
    rows = _numbered(docs)
    groups = jaccard.jaccard_components(rows, size=5, percent=80, key="row").select("row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("h"), "row")
    keep = rows.select("row", order.alias("order")).join(groups, "row").groupBy("component_id").agg(F.min("order").alias("least")).select("least.row")
    return rows.join(keep, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 25 words or more that an earlier document has; a text that loses all its words goes, one that loses none stays as it is.

    Rows with a null id or with equal ids have no order, so they aren't compared: the first lose nothing, the others nothing to each other.
    """
    found = substring.substring_dedup(docs.select(*COLUMNS), window=25, phrase=16)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.where("n_removed < n_words or n_words = 0").select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows with a passage that aligns with a benchmark item, whatever their id.

    Null and empty texts hold none and stay; repeated rows go or stay alike. Null, empty and very short items find nothing.
    """
    rows = _numbered(docs)
    found = decontam.find_contamination(rows, table(spark, sf_dir, "benchmark"), key="row")
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken, and the words this gives.

    The partial epoch prefers documents of quality: the share of words outside repeated windows, over 1 + repeated lines.
    Null and repeated ids are drawn by row; a null text has size 0 and takes nothing; an empty table gives no rows.
    """
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    rows = ledger.ledger(docs.select(*COLUMNS)).select("doc_id", "source", "text", ((1 + n - repeated) / ((1 + n) * (1 + F.col("n_dup_lines")))).alias("quality"))
    return mixing.mix_sources(rows, quality="quality").select("doc_id", "source", "size", "source_size", "target", "times", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Word hashing, tree joins and alignments have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between goes to the shared checkpoint folder, and goes from there once the next stage is written."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            folder = f"{base}/{i}-{name}"
            docs.write.parquet(folder)
            if before:
                _drop(spark, before)
            docs, before = spark.read.parquet(folder), folder
    return docs
