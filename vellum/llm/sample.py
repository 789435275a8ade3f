"""A bounded sample of labelled rows for fitting, even over the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.kit import cut_lineage

#: Bytes of features that a fit brings to the driver, a documented parameter: as many rows are left out, by a hash, as lie beyond.
MOST_BYTES = 128 << 20

#: Labels up to which their counts are broadcast (a few dozen bytes each); beyond, they are joined by shuffle.
BROADCAST_LABELS = 20_000


def balanced(rows: DataFrame, label: str, keys: list[str], n: int) -> DataFrame:
    """rows cut to about n; labels get shares that are as even as their rows allow. Reruns agree.

    A row's key is -ln(u) times its label's rows, u from a hash of the columns ``keys`` (nulls count as values). The
    n-th least key comes off one top-n per partition, so no task sorts a label, and is then a plain filter: nothing is
    joined back. Rows alike in ``keys`` and label have one key and stay or go together, so callers take them once.
    """
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_rows"))
    hint = F.broadcast if counts.count() <= BROADCAST_LABELS else (lambda x: x)
    u = (F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(17)), F.lit(1 << 40)).cast("double") + 1.0) / float((1 << 40) + 1)
    keyed = rows.join(hint(counts), F.col(label) == F.col("_label")).withColumn("_at", -F.log(u) * F.col("_rows"))
    last = keyed.select("_at").orderBy("_at").limit(n).agg(F.max("_at")).first()[0]
    return keyed.where(F.col("_at") <= F.lit(last)).drop("_label", "_rows", "_at")


def within_bytes(rows: DataFrame, blobs: list[str], most: int = MOST_BYTES, keys: tuple[str, ...] = ()) -> DataFrame:
    """rows, written once, or, where their blobs have more than most bytes, about that much of them by a hash of blobs and keys; a row that is larger alone goes. Reruns agree."""
    size = sum((F.octet_length(c) for c in blobs), F.lit(0)).cast("long")
    rows = cut_lineage(rows.withColumn("_bytes", size).where(F.col("_bytes") <= most))
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    if total > most:
        share = F.lit(float(most)) / F.lit(float(total))
        rows = rows.where(F.pmod(F.xxhash64(*blobs, *keys), F.lit(1 << 30)).cast("double") < share * (1 << 30))
    return rows.drop("_bytes")
