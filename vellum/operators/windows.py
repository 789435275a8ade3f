"""Ranking, running and sequential numerics over ordered rows.

The running ones are column functions over a window or an array, for keys whose rows fit into a task; ``scans`` has the same
for keys of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.relational import numbered


def manifest_ids(new: DataFrame, manifest: DataFrame, name: str = "name") -> DataFrame:
    """WIN2: new names get the numbers behind the greatest that is taken, in the order of the names."""
    top = manifest.agg(F.coalesce(F.max("num"), F.lit(0)).alias("_top"))
    fresh = new.join(manifest.select(name), name, "left_anti")
    out = numbered(fresh, name).crossJoin(F.broadcast(top))  # one row, by construction
    return out.select(name, (F.col("rn") + F.col("_top")).alias("num")).withColumn("id", page_id(F.col("num")))


def page_id(n: Column) -> Column:
    """WIN3"""
    return F.format_string("page_%05d", n)


def split_exact(df: DataFrame, key: str = "id", train: float = 0.90, val: float = 0.05, seed: int = 42) -> DataFrame:
    """WIN4: exact sizes int(n * train), int(n * val), the rest; the order is that of a seeded hash."""
    n = df.count()
    a, b = int(n * train), int(n * val)
    ranked = numbered(df.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))), "_h", key)
    return ranked.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "val").otherwise("test")).drop("_h", "rn")


def ema(values: Column, decay: float = 0.8) -> Column:
    """WIN5 over an ordered array: the first value, then decay * before + (1 - decay) * value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda e, x: F.when(e.isNull(), x).when(x.isNull(), e).otherwise(decay * e + (1 - decay) * x))


def step_seconds(at: Column, step: Column, window) -> Column:
    """WIN6: seconds for a step since the row before."""
    return (at - F.lag(at).over(window)) / F.greatest(F.lit(1), step - F.lag(step).over(window))


def running_best(value: Column, window) -> Column:
    """WIN7"""
    return F.min(value).over(window.rowsBetween(Window.unboundedPreceding, 0))


def loss_trend(value: Column, window) -> Column:
    """WIN8: the last three against the three before; null below six values."""
    new, old = F.avg(value).over(window.rowsBetween(-2, 0)), F.avg(value).over(window.rowsBetween(-5, -3))
    six = F.count(value).over(window.rowsBetween(-5, 0)) == 6
    return F.when(six, F.when(new < old, "down").when(new > old, "up").otherwise("flat"))


def last_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """WIN9: the last n rows of each group; Spark keeps a top-n per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def early_stop(values: Column, patience: int, least: float = 1e-4) -> Column:
    """WIN10 over an ordered array: the 1-based step at which patience ends, null if it doesn't; with the best value."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(0).alias("step"), F.lit(None).cast("int").alias("stop"))

    def fold(s, x):
        better = s["best"].isNull() | (x < s["best"] - least)
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        new = F.struct(F.when(better, x).otherwise(s["best"]).alias("best"), bad.alias("bad"), (s["step"] + 1).alias("step"), F.when(bad >= patience, s["step"] + 1).cast("int").alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(new)

    return F.aggregate(values, start, fold)


def progress(processed: Column, baseline: Column, total: Column, elapsed: Column) -> dict[str, Column]:
    """WIN11: rate, seconds left and percent; null where nothing is known yet."""
    rate = F.when((elapsed > 0) & (processed > baseline), (processed - baseline) / elapsed)
    return {"items_per_sec": F.round(rate, 2), "eta_seconds": F.round((total - processed) / rate, 0), "pct": F.when(total > 0, F.round(100.0 * processed / total, 1)).otherwise(0.0)}


def batch_id(rn: Column, size: int = 4) -> Column:
    """WIN12"""
    return F.floor((rn - 1) / size)


def round_robin(rn: Column, n: int) -> Column:
    """WIN13"""
    return F.pmod(rn - 1, F.lit(n))


def by_size(df: DataFrame, size: str = "length") -> DataFrame:
    """WIN14"""
    return df.orderBy(F.desc(size))


def free_letter(keys: list[str]) -> str:
    """WIN15: the first letter that no column has."""
    taken = {k[:1] for k in keys}
    return next(chr(c) for c in range(97, 123) if chr(c) not in taken)


def column_letter(rn: Column) -> Column:
    return F.char(F.lit(96) + rn)


def backoff_seconds(step: Column) -> Column:
    """WIN16"""
    return F.least(60 * F.pow(F.lit(2.0), F.least(step, F.lit(4)) - 1), F.lit(300.0))


def http_backoff_seconds(attempt: Column) -> Column:
    return F.pow(F.lit(2.0), attempt) + 1


def running_eta(seconds: Column, remaining: Column, window) -> Column:
    """WIN17"""
    return F.avg(seconds).over(window.rowsBetween(Window.unboundedPreceding, 0)) * remaining


def warmup_steps(total: int) -> int:
    """WIN18"""
    return min(max(20, int(0.1 * total)), total - 1)


def steps_per_epoch(rows: int, batch: int, accumulate: int, floor: bool = False) -> int:
    return max(1, rows // (batch * accumulate)) if floor else math.ceil(rows / (batch * accumulate))
