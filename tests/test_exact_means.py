"""Sums whose rounding would decide."""

import math

from vellum.operators import scans


def test_a_running_mean_does_not_depend_on_the_order_of_additions(spark):
    values = [round(0.01 * (i * 7919 % 30011), 2) for i in range(600)]
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, at long, x double")
    expected = [math.fsum(values[: i + 1]) / (i + 1) for i in range(len(values))]
    for pieces in (1, 5):
        got = scans.scan(rows, "k", ["at"], {"m": scans.Mean("x")}, pieces=pieces).orderBy("at").collect()
        assert [r.m for r in got] == expected


def test_a_running_mean_of_values_that_are_not_finite(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 1, math.inf), ("a", 2, None), ("a", 3, 2.0), ("b", 0, math.inf), ("b", 1, -math.inf)], "k string, at long, x double")
    got = [r.m for r in scans.scan(rows, "k", ["at"], {"m": scans.Mean("x")}).orderBy("k", "at").collect()]
    assert got[:5] == [1.0, math.inf, math.inf, math.inf, math.inf] and math.isnan(got[5])
