"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources by code point, null last, weigh 1, 2, 3, repeating (or as given) and share ``share`` of all
sizes; a target stops at ``most`` times the source's size and the excess goes to the others by weight, until
none is above.

A source takes ``floor(target / size)`` whole epochs; the rest is a sample without replacement in the
order of the exponential keys -ln(u) / quality weight, u from a hash of the row (seed, id, text, and the place among
rows alike), so that reruns agree. The prefix sums are not one sort per source: keys fall into bins, bins are
summed, and only the bin in which the budget ends is cut again, and its last cell is sorted. A hot source thus
costs a partial aggregate, and no window runs over all sources. All of it is native.

Null text: size 0. Documents of size 0 take nothing. A null or repeated id is an id like any other: each row has its
own key, as the text and the place among rows alike belong to it. A quality weight that is null, NaN, 0 or less puts
a row behind all others. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.kit import cut_lineage
from vellum.operators.relational import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of the keys in each of the two cuts.
BINS = 4096
#: Sources up to which the table of targets is broadcast (some 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def n_words(text: str = "text") -> Column:
    """Words of a text: blocks of separators become one space, so the count is that of the spaces."""
    packed = F.trim(F.regexp_replace(F.col(text), r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(F.when(F.length(packed) > 0, F.length(packed) - F.length(F.replace(packed, F.lit(" "), F.lit(""))) + 1).otherwise(0), F.lit(0)).cast("long")


def prose_share(text: str = "text") -> Column:
    """A quality weight in (0, 1]: the share of a text's characters that are neither digits nor any of #*$%&|<>."""
    c = F.coalesce(F.col(text), F.lit(""))
    return (F.length(F.translate(c, "0123456789#*$%&|<>", "")) + 1.0) / (F.length(c) + 1.0)


def source_targets(sizes: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    The sources are numbered by range partitions. Each round shares the rest among those that aren't at their
    cap yet and costs one aggregate over the sources; the capped ones only grow, so the rounds end.
    """
    place = F.pmod(F.col("rn") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place + 1).cast("int"))
    rows = numbered(sizes, F.col("source").asc_nulls_last()).select("source", "source_size", weight.alias("weight"))
    rows = cut_lineage(rows.withColumn("cap", (F.col("source_size") * most).cast("double")))
    over = F.lit(False)
    while True:
        total, at_cap, free, n_capped = rows.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        rest, free = float(total or 0) * share - float(at_cap or 0), float(free or 0)
        above = F.col("cap") * F.lit(free) < F.lit(rest) * F.col("weight")
        if not free or rows.where(over | above).count() == n_capped:
            break
        over = above  # the level rises from round to round, so these hold those of the round before
    target = F.when(over, F.col("cap")).otherwise(F.col("weight") * F.lit(rest) / F.lit(free) if free else F.col("cap"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _keyed(docs: DataFrame, seed: str, quality: Column | None, key: str, source: str, text: str) -> DataFrame:
    """(doc_id, source, size, e, at): the exponential key of each row and its place in [0, 1), which rises with it."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    place = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    w = F.lit(1.0) if quality is None else quality.cast("double")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size"), F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), place, F.lit(":"), digest).alias("draw"), w.alias("w"))
    rows = cut_lineage(rows.withColumn("_p", F.spark_partition_id()).withColumn("_r", F.monotonically_increasing_id()))
    # Rows alike are counted, by partition first, so that each has a place of its own; a running sum over a draw's partitions tells how many come before.
    draws = Window.partitionBy("draw")
    before = F.coalesce(F.sum("here").over(draws.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = rows.groupBy("draw", "_p").agg(F.count("*").alias("here")).withColumns({"rows": F.sum("here").over(draws), "before": before})
    alike = cut_lineage(counted.where("rows > 1").select("draw", "_p", "before"))
    if alike.isEmpty():
        rows = rows.withColumn("place", F.lit(1).cast("long"))
    else:
        offsets = alike.select(F.col("draw").alias("_d"), F.col("_p").alias("p"), "before")
        local = F.row_number().over(Window.partitionBy("draw", "_p").orderBy("_r"))
        found = rows.join(offsets, (F.col("draw") == F.col("_d")) & (F.col("_p") == F.col("p"))).withColumn("place", F.col("before") + local).drop("_d", "p", "before")
        rows = rows.join(alike.select(F.col("draw").alias("_d")).distinct(), F.col("draw") == F.col("_d"), "left_anti").withColumn("place", F.lit(1).cast("long")).unionByName(found)
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), "draw", F.lit(":"), F.col("place").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    late = F.coalesce(F.isnan("w") | (F.col("w") <= 0), F.lit(True))
    e = -F.log(u) / F.when(late, 1.0).otherwise(F.col("w"))
    # The logarithm of the key makes even bins however far the weights lie apart; ln(-ln u) lies within 34 of 0.
    at = F.greatest(F.lit(0.0), F.least(F.lit(0.4999999), (F.log("e") + 64.0) / 256.0)) + F.when(F.col("late"), 0.5).otherwise(0.0)
    rows = rows.withColumn("late", late).withColumn("e", e).withColumn("at", at)
    return rows.select("doc_id", "source", "size", "draw", "place", "late", "e", "at")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, most: int = 3, seed: str = "mix", quality: Column | str | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, epochs, taken, times.

    quality: a column of weights; documents of more weight come earlier in the partial epoch.
    """
    rows = _keyed(docs, seed, F.col(quality) if isinstance(quality, str) else quality, key, source, text)
    # Of each source: the bin and, in it, the cell in which the budget ends, with what comes before.
    bin_ = F.least(F.floor(F.col("at") * BINS), F.lit(BINS - 1)).cast("int")
    cell = F.least(F.floor((F.col("at") * BINS - F.floor(F.col("at") * BINS)) * BINS), F.lit(BINS - 1)).cast("int")
    rows = cut_lineage(rows.withColumn("bin", bin_).withColumn("cell", cell))
    sums = cut_lineage(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))

    def ends(sums: DataFrame, by: str, limit: DataFrame) -> DataFrame:
        run = Window.partitionBy("source").orderBy(by)
        run = sums.withColumn("upto", F.sum("words").over(run))
        found = _match(run, limit).where(F.col("upto") >= F.col("budget"))
        return found.groupBy("source").agg(F.min(F.struct(F.col(by).alias(by), (F.col("upto") - F.col("words")).alias("before"))).alias("end"))

    first = ends(sums, "bin", targets)
    first = _match(targets, first.select("source", "end"), "left").select("source", "source_size", "target", "epochs", "budget", F.when(F.col("budget") > 0, F.col("end.bin")).alias("end_bin"), (F.col("budget") - F.col("end.before")).alias("left"))
    first = cut_lineage(first)
    hint = F.broadcast if first.count() <= BROADCAST_SOURCES else (lambda x: x)
    inside = _match(rows, hint(first.select("source", "end_bin", "left"))).where(F.col("bin") == F.col("end_bin"))
    second = ends(inside.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cell", first.select("source", F.col("left").alias("budget")))
    ending = cut_lineage(_match(first, second, "left").select("source", "source_size", "target", "epochs", "budget", "end_bin", F.col("end.cell").alias("end_cell"), (F.col("left") - F.col("end.before")).alias("last")))
    every = _match(rows, hint(ending), "left")
    in_last = F.coalesce((F.col("bin") == F.col("end_bin")) & (F.col("cell") == F.col("end_cell")), F.lit(False))
    before = F.coalesce((F.col("bin") < F.col("end_bin")) | ((F.col("bin") == F.col("end_bin")) & (F.col("cell") < F.col("end_cell"))), (F.col("budget") > 0) & F.col("end_bin").isNull(), F.lit(False))
    # The last cell, in order: a document is taken while more of it lies below the budget than above.
    order = Window.partitionBy("source").orderBy("late", "e", "draw", "place").rowsBetween(Window.unboundedPreceding, 0)
    last = every.where(in_last).withColumn("more", (F.sum("size").over(order) - F.col("size") / 2 <= F.col("last")).cast("int"))
    out = every.where(~in_last).withColumn("more", before.cast("int")).unionByName(last)
    times = F.least(F.col("epochs") + F.col("more"), F.lit(most).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * times).alias("taken"), times.alias("times"))


def _match(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b on source, null equal to null."""
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, a["source"].eqNullSafe(b["_source"]), how).drop("_source")
