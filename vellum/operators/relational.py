"""Filters, set operations and joins on ids. Sides are joined by plain equi-joins: the optimizer broadcasts what is small by its own measured size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.metrics import error_rate
from vellum.operators.lineage import cut_lineage


def size_bucket(length: Column, kilobytes: int = 100) -> Column:
    """FIL1"""
    return F.when(length < kilobytes * 1024, "blank").otherwise("content")


def valid_response_v1(c: Column) -> Column:
    """FIL4: no refusal; a short one needs math."""
    return ~X.any_of(F.lower(c), X.REFUSALS) & ((F.length(c) >= 200) | X.any_of(c, ("$", "\\[", "\\begin{")))


def valid_response(c: Column) -> Column:
    """FIL5: no refusal and no reasoning, class and end there."""
    return ~X.any_of(F.lower(c), (*X.REFUSALS, "<think>")) & F.contains(c, F.lit("\\documentclass")) & F.contains(c, F.lit("\\end{document}"))


def skip_reason(c: Column, excluded: Column, has_image: Column) -> Column:
    """FIL6: why a page isn't built into a sample, the first reason that fits; null: it is built."""
    s = X.strip(c)
    return F.when(excluded, "excluded").when(~has_image, "no_image").when((s == "") | F.contains(s, F.lit("YOUR TRANSCRIPTION BELOW")), "empty").when(F.length(s) < 200, "too_short").when(X.any_of(F.lower(s), X.BUILD_REFUSALS), "refusal")


def safe_id(c: Column) -> Column:
    """FIL8"""
    return F.regexp_like(c, F.lit(r"\A[A-Za-z0-9_.\-]+\z")) & ~F.contains(c, F.lit(".."))


def fresh(at: Column, now: Column, seconds: int) -> Column:
    """FIL9"""
    return now.cast("double") - at.cast("double") < seconds


def complete_row(hyp: Column, model: Column, compile_checked: Column) -> Column:
    """FIL10: a hypothesis, and a compile check or no need for one."""
    return hyp.isNotNull() & ((model == "base") | compile_checked)


def done_output(length: Column, least: int = 50) -> Column:
    """FIL11"""
    return length >= least


def unreviewed(c: Column) -> Column:
    """FIL12"""
    return ~F.contains(c, F.lit(X.REVIEWED))


def since(mtime: Column, cutoff: Column, slack: int = 5) -> Column:
    """FIL13"""
    return mtime.cast("double") >= cutoff.cast("double") - slack


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """FIL14"""
    return df.orderBy(*order).limit(n)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """FIL15: n rows without replacement; reruns agree. One top-n per partition."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def prefiltered(verdict: Column, output: Column, latency: Column) -> tuple[Column, Column]:
    """FIL17: NO gives an empty output at once; an unknown verdict lets it through."""
    no = F.coalesce(verdict == "NO", F.lit(False))
    return F.when(no, "").otherwise(output), F.when(no, 0.0).otherwise(latency)


def uploads(df: DataFrame, name: str = "name") -> DataFrame:
    """FIL18"""
    return df.where(F.startswith(name, F.lit("upload_"))).orderBy(F.desc(name))


def require_rows(df: DataFrame, least: int) -> DataFrame:
    """FIL19: raises where fewer rows than needed are there."""
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows")
    return df


def check_config(threshold: int = 210, percent: float = 10.0, ratios: tuple[float, ...] = (0.9, 0.05)) -> None:
    """FIL16"""
    if not 1 <= threshold <= 255 or not 0 < percent <= 100 or min(ratios) < 0 or sum(ratios) > 1:
        raise ValueError("threshold 1 to 255, percent above 0 to 100, ratios of 1 in all at most")


def pending(inputs: DataFrame, *outputs: DataFrame, key: str = "id") -> DataFrame:
    """JOI1 and JOI2: inputs without an output in any of the tables."""
    done = reduce(DataFrame.unionByName, [o.select(key) for o in outputs])
    return inputs.join(done, key, "left_anti")


def with_partner(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """JOI3, JOI8 and JOI15: the rows that have a partner."""
    return left.join(right.select(key), key, "left_semi")


def without(df: DataFrame, excluded: DataFrame, key: str = "id") -> DataFrame:
    """JOI4"""
    return df.join(excluded.select(key), key, "left_anti")


def blank_members(samples: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """JOI5: the assistant's text goes where the id is in the set."""
    marked = samples.join(ids.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    blank = F.transform("conversations", lambda m: F.when(m["role"] == "assistant", m.withField("content", F.lit(""))).otherwise(m))
    return marked.withColumn("conversations", F.when(F.col("_in"), blank).otherwise(F.col("conversations"))).drop("_in")


def lookup(df: DataFrame, table: DataFrame, value: str, default, key: str = "id") -> DataFrame:
    """JOI6: each row with its value, the default where there is none."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def score_pairs(refs: DataFrame, hyps: DataFrame, key: str = "id") -> DataFrame:
    """JOI7"""
    return refs.join(hyps, key)


def page_by_model(outputs: DataFrame, models: list[str], key: str = "id") -> DataFrame:
    """JOI9: a row for each page, columns for each model; the models are given, so that no job looks for them."""
    last = F.max(F.struct("latency_s", "tex", "pdf"))  # of repeated rows always the same one
    wide = outputs.groupBy(key).pivot("model", models).agg(last.alias("r"), F.lit(1).alias("_"))
    return wide.select(key, *(F.col(f"{m}_r.{c}").alias(f"{m}_{c}") for m in models for c in ("tex", "pdf", "latency_s")))


def resume_stage(stages: list[tuple[str, DataFrame, list[DataFrame]]], key: str = "id") -> DataFrame:
    """JOI10: (ord, stage, missing, resume): of each stage the ids that should have come out of it, in any of its outputs, and didn't; resume is true for the first stage that lacks some."""
    rows = [pending(needed, *outputs, key=key).agg(F.count("*").alias("missing")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "missing") for i, (name, needed, outputs) in enumerate(stages)]
    counts = reduce(DataFrame.unionByName, rows)
    first = counts.where("missing > 0").agg(F.min("ord").alias("_first"))  # one row
    return counts.crossJoin(F.broadcast(first)).select("ord", "stage", "missing", F.coalesce(F.col("ord") == F.col("_first"), F.lit(False)).alias("resume"))


def all_ids(*tables: DataFrame, key: str = "id") -> DataFrame:
    """JOI11: the distinct ids of all tables."""
    return reduce(DataFrame.unionByName, [t.select(key) for t in tables]).distinct()


def merged_exclusions(*tables: DataFrame, key: str = "id") -> DataFrame:
    """JOI12: the distinct ids of all tables that aren't null, in order."""
    return all_ids(*tables, key=key).where(F.col(key).isNotNull()).orderBy(key)


def requested_only(verdicts: DataFrame, requested: DataFrame, key: str = "id") -> DataFrame:
    """JOI16: cached verdicts of the ids that are asked for."""
    return verdicts.join(requested.select(key), key, "left_semi")


def requeue_status(rejected: DataFrame, sources: DataFrame, key: str = "id", text: str = "latex") -> DataFrame:
    """JOI13: rescued where only the old check rejects; else requeue where the source exists, else missing."""
    have = sources.select(key).distinct().withColumn("_have", F.lit(True))
    rescued = X.looks_truncated(F.col(text), 1) & ~X.looks_truncated(F.col(text), 2)
    told = rejected.select(key, rescued.alias("_rescued"))  # no text goes through the join
    return told.join(have, key, "left").select(key, F.when(F.col("_rescued"), "rescued").when(F.col("_have"), "requeue").otherwise("missing").alias("status"))


def split_leaks(splits: DataFrame, key: str = "id", split: str = "split") -> DataFrame:
    """JOI14: ids in more than one split, and how often beyond the first."""
    return splits.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(split).alias("n_splits")).where("n > 1").select(key, "n_splits", (F.col("n") - 1).alias("dup"))


def self_consistent(pairs: DataFrame, key: str = "id", most: float = 0.10) -> DataFrame:
    """MET16: two outputs agree where the unrounded error rate is small; a missing one rejects with no rate."""
    rate = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), error_rate(X.normalize(F.col("a")), X.normalize(F.col("b"))))
    return pairs.select(key, F.when(rate <= most, "keep").otherwise("reject").alias("verdict"), F.round(rate, 4).alias("cer"))


def last_wins(rows: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """U1: the last row of each id; a partial aggregate instead of a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def replace_by_spec(doc: DataFrame, new: DataFrame, spec: str = "spec") -> DataFrame:
    """U2 and ARR6: rows of the new specs go, then the new rows come."""
    return doc.join(new.select(spec).distinct(), spec, "left_anti").unionByName(new)


def insert_or_refresh(doc: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """U3"""
    return doc.join(new.select(key), key, "left_anti").unionByName(new)


def merge_progress(old: Column, new: Column) -> Column:
    """SNK8: a map with the new entries over the old ones."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.map_contains_key(new, e["key"])), F.map_entries(new)))


def duplicate_of(rows: DataFrame, key: str = "id", text: str = "latex") -> DataFrame:
    """WIN1: the least id with the same text; null for that one itself. An aggregate and a join, no sort of a hot group."""
    hashed = rows.withColumn("_md5", X.content_hash(F.col(text)))
    first = hashed.groupBy("_md5").agg(F.min(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return hashed.join(first, "_md5", "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col(key), F.col("_first"))).drop("_md5", "_first", "_n")


def flagged(rows: DataFrame, key: str = "id", text: str = "latex") -> DataFrame:
    """ARR1 with duplicates, and ARR2: (id, issues, passed)."""
    from vellum.functions.arrays import passes, quality_flags

    named = F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("duplicate_of_"), F.col("duplicate_of")))
    issues = F.concat(quality_flags(F.col(text)), F.array_compact(F.array(named)))
    return duplicate_of(rows, key, text).select(key, issues.alias("issues")).withColumn("passed", passes(F.col("issues")))


def latest_by(df: DataFrame, group: list[str], value: str, order: Column) -> DataFrame:
    """SRC13: the value of the greatest order in each group."""
    return df.groupBy(*group).agg(F.max_by(value, order).alias(value))


def numbered(df: DataFrame, *order) -> DataFrame:
    """A global 1-based number in the given order, without a single-task sort of whole rows.

    The rows are dealt by range and sorted once, and written: counts and numbers must see the same
    partitions, and a range partitioning that is planned twice draws its own bounds each time. The
    counts are one row a partition. Ties get different numbers, in no set order.
    """
    part = df.repartitionByRange(*order) if order else df
    part = part.sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    part = cut_lineage(part.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return part.join(F.broadcast(offsets), "_p").withColumn("rn", F.col("_off") + F.col("_i") + 1).drop("_p", "_i", "_off")
