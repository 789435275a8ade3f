"""States with timers and expiry, on streams that run."""

import datetime
import time

from pyspark.sql import functions as F

from vellum.operators import scans
from vellum.streaming import live, stateful


class Running:
    """A stream over a folder of rows, whose output is gathered; put() adds rows, until() waits."""

    def __init__(self, spark, tmp_path, schema, operator):
        self.spark, self.schema, self.src, self.got = spark, schema, str(tmp_path / "in"), []
        self.cp = str(tmp_path / "cp")
        spark.createDataFrame([], schema).write.parquet(self.src)
        self.operator = operator
        self.start()

    def start(self):
        out = self.operator(self.spark.readStream.schema(self.schema).parquet(self.src))
        self.query = out.writeStream.foreachBatch(lambda b, _: self.got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", self.cp).trigger(processingTime="300 milliseconds").start()

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.src)

    def until(self, n, seconds=60):
        end = time.time() + seconds
        while len(self.got) < n and time.time() < end and self.query.isActive:
            time.sleep(0.1)
        if not self.query.isActive and self.query.exception():
            raise self.query.exception()
        return self.got

    def stop(self):
        self.query.stop()


def test_a_silent_source_is_told_dead_by_a_timer(spark, tmp_path):
    now, hour = datetime.datetime.now, datetime.timedelta(hours=1)
    run = Running(spark, tmp_path, "source string, at timestamp", lambda s: stateful.liveness(s, seconds=12, forget_s=3600))
    try:
        run.put([("warm", now() - hour)])
        assert [(r[0], r[2]) for r in run.until(1)] == [("warm", False)]
        began = now()
        run.put([("a", began), ("b", began - hour), ("c", None), (None, began)])
        assert {(r[0], r[2]) for r in run.until(4)[1:]} == {("a", True), ("b", False), (None, True)}
        told = run.until(6)  # no further row comes in: the timers tell
        assert {(r[0], r[2]) for r in told[4:]} == {("a", False), (None, False)} and (now() - began).total_seconds() >= 12
        run.stop()
        run.start()  # states are those of the checkpoint
        run.put([("a", now()), ("b", began - 2 * hour)])
        assert [(r[0], r[2]) for r in run.until(7)[6:7]] == [("a", True)]
    finally:
        run.stop()


def test_changes_expire(spark, tmp_path):
    run = Running(spark, tmp_path, "k string, state string, ord long", lambda s: stateful.changes(s, "k", "state", forget_s=8))
    try:
        run.put([("a", "x", 2), ("a", "x", 1), ("b", None, 1), (None, "y", 1)])
        assert sorted(run.until(3), key=str) == sorted([("a", "x", 1), ("b", None, 1), (None, "y", 1)], key=str)
        run.put([("a", "x", 3), ("b", None, 2), ("a", None, 4)])
        assert run.until(4)[3:] == [("a", None, 4)]
        time.sleep(9)
        run.put([("a", None, 5)])
        assert run.until(5)[4:] == [("a", None, 5)]  # its state had expired
    finally:
        run.stop()


def test_pauses_grow_and_end(spark, tmp_path):
    run = Running(spark, tmp_path, "provider string, limited boolean, ord long", lambda s: stateful.pauses(s, first_s=2))
    try:
        run.put([("p", True, 1), ("q", None, 1)])
        assert [(r[0], r[1], r[2] is None) for r in run.until(2)] == [("p", 1, False), ("p", 1, True)]  # begun, and ended by its timer
        run.put([("p", True, 2), ("p", True, 3)])
        assert [(r[0], r[1], r[2] is None) for r in run.until(3)[2:3]] == [("p", 3, False)]
        run.put([("p", False, 4)])
        told = run.until(4)[3:]
        assert ("p", 0, None) in told or (("p", 3, None) in told and ("p", 0, None) in run.until(5)[3:])
    finally:
        run.stop()


def test_pauses_of_tables():
    r = [None, True, True, False, True, None, True, True, True, True, True]
    fold, s, out = scans.Strikes("x"), scans.Strikes("x").start(), []
    for x in r:
        s, n = fold.step(s, {"x": x})
        out.append(n)
    assert out == [0, 1, 2, 0, 1, 1, 2, 3, 4, 4, 4]
    pause, clock = live.Pause(), []
    for n in range(1, 6):
        clock.append(pause.hit(0.0))
    assert clock == [60, 120, 240, 300, 300]


def test_changes_of_a_hot_key_fill_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 100 < 50, "x").alias("state"), F.col("id").alias("ord")).repartition(4)
    got = sorted(tuple(r) for r in live.changes(df, "k", "state").select("ord", F.coalesce("state", F.lit("-"))).collect())
    assert got == [(i, "x" if i % 100 == 0 else "-") for i in range(0, 20_000, 50)]
