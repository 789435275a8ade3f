"""Running means where the order of the additions decides the last decimal."""

import random

import duckdb
import pytest

from vellum.operators import scans
from vellum.plans import sql_order
from vellum.plans.oracles import ORACLES
from vellum.plans.queries import QUERIES


def by_force(first, values):
    """The running means of values at places from first on: of each stretch the greatest whole blocks, from the left."""

    def total(a, size):
        if size == 1:
            return values[a - first] or 0.0
        t = 0.0
        for i in range(16):
            t += total(a + i * size // 16, size // 16)
        return t

    for end in range(first + 1, first + len(values) + 1):
        t, a = 0.0, first
        while a < end:
            size = 1
            while a % (size * 16) == 0 and a + size * 16 <= end:
                size *= 16
            t, a = t + total(a, size), a + size
        n = sum(v is not None for v in values[: end - first])
        yield t / n if n else None


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_means_of_blocks_by_force(spark, pieces):
    rng = random.Random(1)
    values = {k: [None if rng.random() < 0.05 else round(rng.random() * 300, 2) for _ in range(n)] for k, n in (("a", 700), ("b", 5), ("c", 300))}
    first = {"a": 0, "b": 254, "c": 4091}
    rows = spark.createDataFrame([(k, i, v, first[k]) for k, vs in values.items() for i, v in enumerate(vs)], "k string, at long, x double, place long")
    got = scans.scan(rows, "k", ["at"], {"m": scans.BlockMean("x", "place")}, pieces=pieces).orderBy("k", "at").collect()
    assert [r.m for r in got] == [m for k in sorted(values) for m in by_force(first[k], values[k])]


def test_running_means_round_as_the_sql(spark, tmp_path):
    """At step 256 half of the exact results lie on a half of the sixth decimal."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    user = "CASE WHEN i % 31 = 0 THEN NULL ELSE i % 30 - 3 END"
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, make_timestamp(1700000000000000 + i * 7919) AS ts, {user}::BIGINT AS user_id, (hash(i) % 30000)::BIGINT / 100 AS value FROM range(15000) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    expected = con.execute(f"SELECT * FROM ({ORACLES['win6_running']}) ORDER BY user_id, step").fetchall()
    got = QUERIES["win6_running"](spark, str(tmp_path)).collect()
    assert len(expected) == 15000
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, expected), key=str)


def test_three_losses_are_added_from_the_left(spark):
    """(0.3 + 0.2) + 0.1 is below (0.1 + 0.2) + 0.3, as SQL has it."""
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate((0.1, 0.2, 0.3, 0.3, 0.2, 0.1))], "k string, at long, x double")
    assert [r.t for r in scans.scan(rows, "k", ["at"], {"t": scans.Trend("x")}).orderBy("at").collect()][-1] == "down"


def test_doubles_round_as_the_sql(spark):
    rng = random.Random(2)
    values = [k / 3200 + d * 2**-38 for k in rng.sample(range(10**9), 2000) for d in (-1, 0, 1)] + [-0.0000005, 0.49999999999999994, 1e300, 123066810000000.0, -4.4e14 / 3, 1e305, None]
    con = duckdb.connect()
    got = spark.createDataFrame([(v,) for v in values], "x double").select(sql_order.rounded(sql_order.F.col("x"), 6)).collect()
    assert [r[0] for r in got] == [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in values]


def test_groups_are_split_as_the_table_grows():
    assert [sql_order.group_bits(n) for n in (0, 1_966_081, 1_966_100, 7_850_000, 7_870_000)] == [4, 4, 6, 6, 8]


def test_rows_without_values_are_as_in_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    value = "CASE WHEN hash(i) % 5 < 3 THEN NULL WHEN i % 97 = 0 THEN 'inf'::DOUBLE WHEN i % 89 = 0 THEN 'nan'::DOUBLE ELSE (hash(i) % 700)::BIGINT * 1e9 / 7 END"
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, make_timestamp(1700000000000000 + i * 7919) AS ts, i % 20 AS user_id, {value} AS value FROM range(3000) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    expected = con.execute(f"SELECT * FROM ({ORACLES['win6_running']})").fetchall()
    got = QUERIES["win6_running"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected)))
