"""Summaries: each one partial aggregate and one shuffle of its groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MEANS = (("cer", "mean_cer"), ("ncer", "norm_cer"), ("charsim", "charsim"), ("tok_err", "tok_err"), ("bleu", "bleu"), ("rouge_l", "rouge_l"), ("math_f1", "math_f1"), ("chrf", "chrf"), ("len_rate", "len_rate"))


def _percent(test: Column) -> Column:
    return F.round(100.0 * F.sum(F.when(test, 1).otherwise(0)) / F.count("*"), 1)


def summarize(scores: DataFrame, *by: str) -> DataFrame:
    """AGG1: the summary of score rows; a compile rate over the rows that were compiled only."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("samples"),
        *(F.round(F.avg(c), 4).alias(name) for c, name in _MEANS),
        F.round(F.median("cer"), 4).alias("median_cer"),
        _percent(F.col("struct")).alias("struct_pct"),
        F.round(100.0 * F.sum(F.col("compile_ok").cast("int")) / F.count("compile_ok"), 1).alias("compile_rate"),
        _percent(F.col("cer") < 0.10).alias("cer_under_10pct"),
        _percent(F.col("cer") < 0.30).alias("cer_under_30pct"),
        F.round(F.avg("latency_s"), 2).alias("avg_latency_s"),
    )


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """AGG2 and AGG12"""
    return df.groupBy(status).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, c: Column, *by: str) -> DataFrame:
    """AGG3: the mean is cut to an integer."""
    n = F.length(c)
    return df.groupBy(*by).agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.floor(F.sum(n) / F.count(n)).cast("long").alias("avg_len"))


def histogram(df: DataFrame, items: str, name: str = "issue") -> DataFrame:
    """AGG4: how often each element of an array occurs."""
    return df.select(F.explode(items).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def verdict_tally(df: DataFrame, verdict: str = "verdict", group: tuple[str, ...] = ()) -> DataFrame:
    """AGG5: yes, no, errors and the share of no; the pages with one verdict are listed()."""
    v = F.col(verdict)
    yes, no = F.count_if(v == "YES"), F.count_if(v == "NO")
    return df.groupBy(*group).agg(yes.alias("n_yes"), no.alias("n_no"), F.count_if(F.startswith(v, F.lit("ERR")) | (v == "?")).alias("n_err"), F.round(no / F.greatest(F.lit(1), yes + no), 4).alias("no_share"))


def listed(df: DataFrame, verdict: str, *columns: str, by: str = "verdict", key: str = "id") -> DataFrame:
    """AGG5, AGG6 and AGG11: the rows with a verdict in the order of their ids, as rows and not as one array, since such a list grows with the table."""
    return df.where(F.col(by) == verdict).select(key, *columns).orderBy(key)


def agreement(df: DataFrame) -> DataFrame:
    """AGG6: kept and rejected pages and the median error rate; the lists are listed()."""
    return df.agg(F.count_if(F.col("verdict") == "keep").alias("kept"), F.count_if(F.col("verdict") == "reject").alias("rejected"), F.median("cer").alias("median_cer"))


def annotation_progress(done: Column, total: Column) -> dict[str, Column]:
    """AGG7"""
    return {"remaining": total - done, "pct": F.round(100.0 * done / F.greatest(total, F.lit(1)), 1), "bar": F.floor(done * 40 / F.greatest(total, F.lit(1))).cast("int")}


def dry_run_projection(df: DataFrame, items: int) -> DataFrame:
    """AGG8: means over the successes, and what so many items would take."""
    ok = F.col("status") == "success"
    seconds = F.avg(F.when(ok, F.col("seconds")))
    return df.agg(F.count_if(ok).alias("n_ok"), F.round(seconds, 3).alias("avg_seconds"), F.round(F.avg(F.when(ok, F.col("chars"))), 1).alias("avg_chars"), F.round(seconds * items, 1).alias("projected_seconds"))


def improvement(summaries: DataFrame, base: str, key: str = "model", order: str = "ord") -> DataFrame:
    """AGG9: the model with the least mean error and its gain over the base in percent; the first of equal ones."""
    rate = F.coalesce(F.col("mean_cer"), F.lit(1e9))
    best = F.min(F.struct(rate.alias("cer"), F.col(order).alias("ord"), F.col(key).alias("key")))
    b = F.max(F.when(F.col(key) == base, F.col("mean_cer")))
    return summaries.agg(best.alias("best"), b.alias("base_cer")).select(F.col("best.key").alias("best_model"), F.round(100 * (F.col("base_cer") - F.col("best.cer")) / F.greatest(F.lit(1e-9), F.col("base_cer")), 1).alias("improvement_pct"))


def split_sizes(df: DataFrame, blanked: Column, split: str = "split") -> DataFrame:
    """AGG10"""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.count_if(blanked).alias("n_blanked"))


def char_counts(df: DataFrame, c: Column, held_out: Column) -> DataFrame:
    """AGG11: characters, blank and filled pages, all of them and those held out."""
    blank = F.trim(c) == ""
    return df.agg(F.sum(F.length(c)).alias("chars"), F.count_if(blank).alias("n_blank"), F.count_if(~blank).alias("n_filled"), F.count_if(held_out).alias("n_held_out"), F.count_if(held_out & blank).alias("n_held_out_blank"))


def by_chars(df: DataFrame, c: Column, *columns: str) -> DataFrame:
    """AGG11's lists: each page with its characters and whether it is blank, the longest first."""
    return df.select(*columns, F.length(c).alias("chars"), F.when(F.trim(c) == "", "blank").otherwise("filled").alias("verdict")).orderBy(F.desc("chars"), *columns)


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """AGG13: rows of each stage and their share of the first's."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("ord"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages)])
    first = counts.where("ord = 0").select(F.col("n").alias("_n0"))
    return counts.crossJoin(F.broadcast(first)).select("ord", "stage", "n", F.round(100.0 * F.col("n") / F.greatest(F.col("_n0"), F.lit(1)), 1).alias("pct"))


def mean_loss(df: DataFrame, loss: str = "loss") -> DataFrame:
    """AGG14: over finite values, and how many these are; null if there is none."""
    c = F.when(~F.isnan(loss) & (F.abs(loss) != float("inf")), F.col(loss))
    return df.agg(F.round(F.avg(c), 6).alias("val_loss"), F.count(c).alias("n"))
