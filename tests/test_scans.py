"""Parallel scans against plain folds, however the rows are dealt."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import scans, windows
from vellum.plans.fixtures import steps
from vellum.plans.queries import QUERIES

FOLDS = {
    "ema": scans.Ema("v"),
    "slow": scans.Ema("v", 0.85),
    "best": scans.Best("v"),
    "mean": scans.Mean("v"),
    "seconds": scans.Seconds("at", "n"),
    "trend": scans.Trend("v"),
    "stop": scans.Patience("v", 3, 0.1),
    "late": scans.Patience("v", 7),
}


def folded(rows, folds):
    """Each fold over the rows of each key, by order."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: r["n"]):
        s = state.setdefault(r["k"], {n: f.start() for n, f in folds.items()})
        told = {}
        for n, f in folds.items():
            s[n], told[n] = f.step(s[n], r)
        out[r["k"], r["n"]] = told
    return out


def alike(a, b):
    if isinstance(a, dict) or isinstance(b, dict):
        return alike(a["best"], b["best"]) and a["stop"] == b["stop"]
    if isinstance(a, float) and isinstance(b, float):
        return (a != a and b != b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def rows_of(r, n, keys):
    out, at = [], 0
    for i in range(n):
        at += r.randrange(1, 5)
        out.append({"k": r.choice(keys), "n": i, "at": float(at) if r.random() > 0.05 else None, "v": r.choice([None, float("nan")]) if r.random() < 0.06 else round(r.uniform(0, 3) + 30 / (1 + i), 2)})
    return out


def test_summaries_compose_like_rows():
    """Any cut of any rows into pieces gives the state of the fold."""
    r = random.Random(5)
    for _ in range(3000):
        rows = rows_of(r, r.randrange(1, 30), ["a"])
        for f in FOLDS.values():
            state, want, i = f.start(), f.start(), 0
            while i < len(rows):
                size = r.randrange(0, 8)
                s = f.nothing()
                for x in rows[i : i + size]:
                    s = f.add(s, x)
                    want = f.step(want, x)[0]
                state, i = f.after(state, s), i + size
                told = [f.step(z, {"v": 0.5, "at": 1.0, "n": 99})[1] for z in (state, want)]
                assert alike(*told), (f, rows, state, want)


@pytest.mark.parametrize("pieces", [1, 3, 17])
def test_scan_is_the_fold(spark, pieces):
    r = random.Random(pieces)
    rows = rows_of(r, 600, ["hot"] * 20 + ["b", "c", None, "", "z"])
    df = spark.createDataFrame([(x["k"], x["n"], x["at"], x["v"], "x") for x in rows], "k string, n int, at double, v double, other string").repartition(5)
    want = folded(rows, FOLDS)
    got = scans.scan(df, "k", ["n"], FOLDS, pieces).collect()
    assert len(got) == len(rows) and all(x.other == "x" for x in got)
    for x in got:
        for n in FOLDS:
            told = x[n].asDict() if n in ("stop", "late") else x[n]
            assert alike(told, want[x.k, x.n][n]), (n, x, want[x.k, x.n][n])
    assert scans.scan(df.where("false"), "k", ["n"], FOLDS).count() == 0


def test_patience_is_the_column_function(spark):
    rows = [(u, [x.loss for x in g]) for u, g in _by_user(spark)]
    df = spark.createDataFrame(rows, "u long, v array<double>")
    want = {x.u: (x.e.best, x.e.stop) for x in df.select("u", windows.early_stop(F.col("v"), 3).alias("e")).collect()}
    got = {x.user_id: (x.best, x.stop) for x in QUERIES["win10_early_stop"](spark, "/root/testdata/sf0.001").collect()}
    assert {u: (None if b is None else round(b, 9), s) for u, (b, s) in got.items()} == {u: (None if b is None else round(b, 9), s) for u, (b, s) in want.items()}


def _by_user(spark):
    out = {}
    for x in steps(spark, "/root/testdata/sf0.001").orderBy("user_id", "step").collect():
        out.setdefault(x.user_id, []).append(x)
    return out.items()


def test_one_user_of_all_events_fills_many_tasks(spark):
    n, pieces = 1_000_000, 16
    df = spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias("n"), (F.lit(3.0) / (1 + F.col("id") % 1000) + F.when(F.col("id") % 11 == 0, 1.0).otherwise(0.0)).alias("v"))
    folds = {"ema": scans.Ema("v"), "best": scans.Best("v"), "stop": scans.Patience("v", 2000)}
    out = scans.scan(df, "k", ["n"], folds, pieces)
    sizes = [x["count"] for x in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= pieces - 2 and max(sizes) < 3 * n / pieces
    last = out.where(F.col("n") == n - 1).first()
    state = {k: f.start() for k, f in folds.items()}
    for i in range(n):
        row = {"v": 3.0 / (1 + i % 1000) + (1.0 if i % 11 == 0 else 0.0)}
        for k, f in folds.items():
            state[k], _ = f.step(state[k], row)
    assert math.isclose(last.ema, state["ema"], rel_tol=1e-9) and last.best == state["best"] and (last.stop.best, last.stop.stop) == (state["stop"][0], state["stop"][3])
