"""In which order DuckDB adds up the doubles of a window, and how it rounds: for queries whose SQL rounds so near to a half that the last bit decides.

As seen in version 2.0.0, whatever its threads, its memory and the order of the rows: a window's rows fall into groups by bits of the hash of their partition's
key, a group is ordered by that key, and running sums come from a tree of sums over the whole group, 16 at a time (scans.BlockMean). So where a key's rows begin
in its group, and with it the last bits of its sums, depends on the other keys in the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups are split by two more bits of the hash where they would have more rows on average.
_GROUP_ROWS = 122_880
_NULL_HASH = 0xBF58476D1CE4E5B9


def _hash(x: np.ndarray) -> np.ndarray:
    """DuckDB's hash of 64-bit integers."""
    x, by, half = x.astype(np.int64).view(np.uint64), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
    for _ in range(2):
        x = (x ^ (x >> half)) * by
    return x ^ (x >> half)


def group_bits(rows: int) -> int:
    bits = 4
    while rows >> bits > _GROUP_ROWS:
        bits += 2
    return bits


def places(df: DataFrame, key: str) -> DataFrame:
    """(key, place): each key, a 64-bit integer or null, with the rows of the keys before it in its group."""
    bits = group_bits(df.count())

    @F.arrow_udf("int")
    def group(keys: pa.Array) -> pa.Array:
        h = np.where(keys.is_null().to_numpy(zero_copy_only=False), np.uint64(_NULL_HASH), _hash(pc.fill_null(keys, 0).to_numpy()))
        return pa.array(((h >> np.uint64(48 - bits)) & np.uint64((1 << bits) - 1)).astype(np.int32))

    keys = df.groupBy(F.col(key).cast("long").alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy(F.asc_nulls_first(key)).rowsBetween(Window.unboundedPreceding, -1)
    return keys.withColumn("_g", group(F.col(key))).select(key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("place"))


def rounded(x: Column, digits: int) -> Column:
    """round() of doubles as DuckDB has it: a half of the scaled double goes away from zero, while Spark rounds the decimal that the double is shown as."""
    by = float(10**digits)
    a = F.abs(x * by)
    whole = F.floor(a)
    up = F.when(a - whole >= 0.5, whole + 1).otherwise(whole).cast("double")
    return F.when(a < 2.0**52, F.signum(x) * up / by).when(a < float("inf"), x * by / by).otherwise(x)
