"""Tables of versions: no gap for readers, idempotent batches, and only touched buckets are written."""

import os
import threading

import pytest

from vellum.functions.metrics import score
from vellum.sources.snapshots import Conflict, SnapshotTable
from vellum.streaming import live


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_a_reader_never_misses_the_table(spark, tmp_path):
    table, seen, wrong, stop = SnapshotTable(spark, str(tmp_path / "t")), [], [], threading.Event()
    table.replace(spark.range(1))

    def look():
        own = SnapshotTable(spark, str(tmp_path / "t"))
        while not stop.is_set():
            try:
                seen.append(own.read().count())
            except Exception as e:  # noqa: BLE001  the test is that there is none
                wrong.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(2, 51):
        table.replace(spark.range(n).coalesce(1))
    stop.set()
    reader.join()
    assert not wrong and len(seen) > 5 and seen == sorted(seen) and table.read().count() == 50


def test_a_torn_or_taken_version(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(3)) == 1
    (tmp_path / "t/versions" / f"{2:020d}").write_text('{"number": 2, "parts"')  # its writer died
    assert table.read().count() == 3 and table.replace(spark.range(4)) == 3 and table.read().count() == 4
    with pytest.raises(Conflict):
        table._commit({"number": 3})
    assert table.read(1).count() == 3
    table.replace(table.read().where("id > 0"))
    table.vacuum(keep=1)
    assert rows(table) == [(1,), (2,), (3,)] and len(os.listdir(tmp_path / "t/data")) == 1
    with pytest.raises(FileNotFoundError):
        table.read(1)
    table.replace(spark.range(0))
    assert rows(table) == [] and table.read().columns == ["id"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.upsert(spark.range(1000).selectExpr("id", "id * 2 AS v"), buckets=16)
    before = table.current()["parts"]
    assert len(before) == 16
    table.upsert(spark.createDataFrame([(5, -1), (2000, -2)], "id long, v long"))
    after = table.current()["parts"]
    assert sum(before[b] != after[b] for b in before) in (1, 2)
    assert dict(rows(table)) == {**{i: 2 * i for i in range(1000)}, 5: -1, 2000: -2}
    with pytest.raises(ValueError):
        table.upsert(spark.range(1).selectExpr("id AS other"), key="other")


def test_columns_of_writers_meet_in_one_row(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (None, "n", 0), (2, None, 0)], "id long, a string, at int")
    for _ in range(2):
        table.upsert(one, order="at", writer="one", batch=0, buckets=4)
    assert table.current()["number"] == 1
    table.upsert(spark.createDataFrame([(2, 2.5), (3, None), (None, 1.0)], "id long, b double"), writer="two", batch=0)
    assert rows(table) == sorted([(1, "y", 1, None), (2, None, 0, 2.5), (3, None, None, None), (None, "n", 0, 1.0)], key=str)
    table.upsert(spark.createDataFrame([(2, None), (1, "z")], "id long, a string"), writer="one", batch=1)  # nulls count
    assert rows(table) == sorted([(1, "z", 1, None), (2, None, 0, 2.5), (3, None, None, None), (None, "n", 0, 1.0)], key=str)
    table.upsert(spark.createDataFrame([(2, "w")], "id long, a string"), whole=True)
    assert (2, "w", None, None) in rows(table)
    table.upsert(spark.createDataFrame([], "id long, a string"))
    table.vacuum(keep=1)
    assert len(rows(table)) == 4
    table.replace(spark.createDataFrame([(9, "q")], "id long, a string"))  # keeps its key and buckets
    table.upsert(spark.createDataFrame([(9, "r"), (10, "s")], "id long, a string"))
    assert rows(table) == [(10, "s"), (9, "r")]


def test_two_models_score_live_into_one_row(spark, tmp_path):
    refs = spark.createDataFrame([("p1", "ab"), ("p2", "cd")], "id string, ref string")
    table = SnapshotTable(spark, str(tmp_path / "scores"))

    def run(model, hyps, checkpoint):
        outputs = spark.createDataFrame(hyps, "id string, hyp string")
        live.score_live(live.ready_pages(spark, str(tmp_path / model)), lambda: outputs, refs, table, str(tmp_path / checkpoint), model=model).awaitTermination()
        return {r.id: r.asDict() for r in table.read().collect()}

    for m in "xy":
        (tmp_path / m).mkdir()
        (tmp_path / m / "p1.time").write_text("1.5")
    run("x", [("p1", "ab")], "cx")
    got = run("y", [("p1", "aX")], "cy")
    assert set(got) == {"p1"} and (got["p1"]["x_cer"], got["p1"]["y_cer"], got["p1"]["y_latency_s"]) == (0.0, 0.5, 1.5)
    (tmp_path / "x" / "p2.time").write_text("2")
    got = run("x", [("p1", "never read again"), ("p2", "cd")], "cx")
    assert got["p1"]["x_cer"] == 0.0 and got["p2"]["x_cer"] == 0.0 and got["p2"]["y_cer"] is None
    got = run("x", [("p1", "ab"), ("p2", "Xd")], "another")  # a new checkpoint scores all pages again
    assert got["p2"]["x_cer"] == 0.5 and got["p1"]["y_cer"] == 0.5
    assert score(refs.withColumn("hyp", refs.ref).withColumn("latency_s", refs.ref.try_cast("double"))).count() == 2
