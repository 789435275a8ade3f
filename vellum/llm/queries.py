"""The queries of the operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import alignment, chat, decontam, jaccard, langid, ledger, licenses, mixing, ordinal, runs, substring, toxicity, urls
from vellum.llm.kit import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 13-word windows that a document with a smaller id has. Nulls, ties, repeats: as substring_dedup says."""
    found = substring.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each license notice in each document. Nulls, ties, repeats: as scan_licenses says."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a passage of a test item, with the best one. Nulls, ties, repeats: as find_contamination says."""
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.contaminated(found)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict. Nulls, ties, repeats: as filter_urls says."""
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good. Nulls, ties, repeats: as fit and grade say."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade")), "grade", 3)
    return ordinal.grade(docs, model, 3)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from those that aren't held out; a null id is neither held out nor learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out, "text", "lang")
    model = langid.fit(docs.where("not held_out and doc_id is not null"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records of messages, and conversation -1 as a prompt and its response: one table of two layouts."""
    records = chat.rows_to_records(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    told = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), told.alias("prompt"), told.alias("response"))
    return chat.read_back(chat.render(chat.to_turns(records.unionByName(added, allowMissingColumns=True))))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.stored(ledger.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements and the verdict of policy v1, read from the stored ledger."""
    rows = ledger.apply_policy(_ledger(spark, sf_dir))
    failed = F.col("fail_bits").bitwiseAND(F.lit(ledger.mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"), "fail_bits")


def op8_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, and what would be kept without it, from the stored ledger's bits."""
    return ledger.ablation(_ledger(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a larger share of prose come earlier in their source's partial epoch. Nulls, ties and repeats: as mix_sources says."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality=mixing.prose_share()).select("doc_id", "size", "source_size", "target", "taken")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component. Nulls, ties, repeats: as jaccard_components says."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=85)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies, groups and links, and their counts over all documents. Nulls, ties, repeats: as align says."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of the label toxic, learned from the labels that aren't held out. Nulls, ties, repeats: as toxicity says."""
    out = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", out(F.col("doc_id")).alias("held_out"), "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~out(F.col("doc_id"))))
    found = toxicity.score(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments")


def _repeats_from(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) of the tenth of the ids whose texts are read as repeating p words from word a on; a null id is none of them."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of four periods and six words or more. Nulls, ties, repeats: as find_runs says."""
    found = runs.find_runs(table(spark, sf_dir, "documents"), _repeats_from).withColumn("best", runs.longest(F.col("runs")))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent, runs.digest(F.col("runs")).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_decontamination, op4_url_filter, op5_quality, op6_language_id, op7_chat_format, op8_quality_rules, op8_ablation, op9_source_mix, op10_jaccard_join, op11_token_alignment, op12_toxicity, op13_periodic_runs, pipeline)}
