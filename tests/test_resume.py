"""Runs that go on after a crash, and connectors that lose no row."""

import threading
import time

import pytest

from vellum.plans.runs import ResumableRun, fingerprint
from vellum.sources import connector


def test_only_what_changed_is_computed_again(spark, tmp_path):
    computed = []

    def stages(fail=False, least=2):
        def b(t):
            computed.append("b")
            if fail:
                raise ValueError("the machine is gone")
            return {"b": t["a"].where(f"id >= {least}"), "b_rest": t["a"].where(f"id < {least}")}

        def plain(name, f):
            return lambda t: computed.append(name) or f(t)

        return {"a": plain("a", lambda t: t["in"].where("id < 6")), "b": b, "c": plain("c", lambda t: t["b"].unionAll(t["other"]) if "other" in t else t["b"]), "d": plain("d", lambda t: t["a"].groupBy().count())}

    def go(tables, fail=False, version="1", start_from=None):
        computed.clear()
        run = ResumableRun(stages(fail), folder=str(tmp_path / "run"), version=version)
        out = run.go(tables, start_from=start_from)
        return "".join(computed), run.status, out

    one = {"in": spark.range(10)}
    done, status, _ = go(dict(one), fail=True)
    assert done == "abcd" and status["b"].startswith("failed") and status["c"].startswith("failed") and status["d"] == "done"
    done, status, out = go(dict(one))  # resumes at the gap
    assert done == "bc" and out["c"].count() == 4 and out["b_rest"].count() == 2 and set(status.values()) == {"done"}
    done, _, out = go(dict(one))
    assert done == "" and out["c"].count() == 4 and out["d"].first()[0] == 6
    done, _, out = go({"in": spark.range(10).repartition(3), "other": spark.range(1)})  # only c looks for it
    assert done == "c" and out["c"].count() == 5
    done, _, out = go({"in": spark.range(20), "other": spark.range(1)})  # a gives the same rows
    assert done == "a"
    done, _, out = go({"in": spark.range(3, 20), "other": spark.range(1)})
    assert done == "abcd" and out["b"].count() == 3
    assert go({"in": spark.range(3, 20), "other": spark.range(1)}, version="2")[0] == "abcd"
    assert go({"in": spark.range(3, 20), "other": spark.range(1)}, version="2", start_from="c")[0] == "cd"
    with pytest.raises(ValueError):
        ResumableRun(stages(True), folder=str(tmp_path / "run"), version="3").go(dict(one), fail_fast=True)
    rows = {r.stage: (r.status, r.error) for r in ResumableRun({}, folder=str(tmp_path / "run")).ledger().collect()}
    assert rows["b"] == ("failed", "the machine is gone") and rows["a"][0] == "done"


def test_fingerprints_are_those_of_rows(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, {"k": 1})], "id long, t string, m map<string,int>")
    assert fingerprint(a) == fingerprint(a.orderBy("id", ascending=False).repartition(2))
    assert len({fingerprint(x)[0] for x in (a, a.unionAll(a), a.where("id = 1"), a.withColumnRenamed("t", "u"), a.where("false"))}) == 5


def test_a_flaky_client_loses_no_row(spark):
    def client():
        asked, lock, flying = {}, threading.Lock(), [0]

        def call(row):
            with lock:
                n = asked[row["id"]] = asked.get(row["id"], 0) + 1
                flying[0] += 1
                assert flying[0] <= 4
            time.sleep(0.001 * (row["id"] % 5))
            with lock:
                flying[0] -= 1
            if row["id"] % 10 == 1 and n < 3 or row["id"] % 10 == 2:
                raise OSError(f"reset {n}")
            if row["id"] % 10 == 3 and n < 3:
                raise RuntimeError("Rate limit")
            return {"answer": row["id"] * 2}

        return call

    policy = connector.Policy(in_flight=4, wait_s=0.001, first_pause_s=0.002)
    out = connector.call(spark.range(200).repartition(3).selectExpr("id", "'x' AS error", "1 AS answer"), "answer long", client, policy)
    got = {r.id: (r.answer, r.status, r.attempts, r.error) for r in out.collect()}
    assert out.columns == ["id", "answer", "status", "attempts", "error"] and len(got) == 200
    for i, told in got.items():
        kind = i % 10
        if kind == 2:
            assert told == (None, "failed", 3, "reset 3")
        else:
            assert told == (2 * i, "success", 3 if kind in (1, 3) else 1, None)
    assert connector.dead_letters(out).count() == 20
    assert connector.call(spark.range(0), "answer long", client, policy).count() == 0


def test_a_fatal_error_ends_a_task_and_names_its_rows(spark):
    def client():
        def call(row):
            if row["id"] == 5:
                raise RuntimeError("402 insufficient credit")
            return {"answer": 1}

        return call

    out = connector.call(spark.range(50).coalesce(1), "answer int", client, connector.Policy(in_flight=1)).collect()
    assert len(out) == 50 and [r.status for r in out] == ["success"] * 5 + ["fatal"] + ["aborted"] * 44
    assert {r.error for r in out[5:]} == {"402 insufficient credit"}


def test_endless_turning_away_ends(spark):
    def client():
        def call(row):
            raise RuntimeError("429")

        return call

    out = connector.call(spark.range(3), "answer int", client, connector.Policy(first_pause_s=0, most_pauses=5)).collect()
    assert {(r.status, r.attempts) for r in out} == {("failed", 6)}
