"""What a Python function holds follows a part of a batch, whatever Spark sends at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vellum.functions import images, metrics
from vellum.functions.batches import parts
from vellum.sources import connector


def test_parts_are_bounded_and_whole():
    column = pa.array(["x" * n for n in (5, 0, 50, 3, 3, 3)] + [None])
    assert list(parts([column], most=10)) == [(0, 2), (2, 1), (3, 4)]
    assert sum(n for _, n in parts([column, column], rows=2)) == 7
    assert list(parts([pa.array([], pa.string())])) == []


def test_metrics_of_a_large_batch_take_little_memory():
    rng = random.Random(1)
    ref, hyp = ([" ".join(rng.choice("abcdefgh") * 4 for _ in range(120)) for _ in range(3000)] for _ in range(2))
    columns = [pa.array([t.split() for t in x]) for x in (ref, hyp)] + [pa.array(ref), pa.array(hyp)]
    compute = metrics.sequence_metrics("chrf", "bleu").func
    tracemalloc.start()
    got = compute(*columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20  # 700 MB where the batch is taken whole
    few = metrics._sequence_metrics(("chrf", "bleu"), [t.split() for t in ref[-9:]], [t.split() for t in hyp[-9:]], ref[-9:], hyp[-9:])
    assert [r["chrf"] for r in got[-9:].to_pylist()] == pytest.approx(few["chrf"].tolist())
    assert [r["bleu"] for r in got[-9:].to_pylist()] == pytest.approx(few["bleu"].tolist())


def test_a_connector_gives_its_rows_in_parts():
    schema = pa.schema([("id", pa.int64()), ("answer", pa.int64()), ("status", pa.string()), ("attempts", pa.int32()), ("error", pa.string())])
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000))})
    got = list(connector.answers([batch], lambda: lambda row: {"answer": row["id"] + 1}, connector.Policy(), lambda s: None, ["answer"], schema))
    assert max(b.num_rows for b in got) <= 256
    assert [x for b in got for x in b.column("answer").to_pylist()] == list(range(1, 1001))


def test_made_pages_come_in_batches_of_bounded_bytes():
    schema = pa.schema([("id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
    page = bytes(range(256)) * 1200  # three bytes a pixel once it is made
    batch = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(40)], "height": [480] * 40, "width": [640] * 40, "data": [page] * 40}, pa.schema([*list(schema)]))
    got = list(images.made_pages([batch], lambda a: a, schema))
    assert max(b.nbytes for b in got) < 6 << 20 and sum(b.num_rows for b in got) == 40
    assert got[0].column("data")[0].as_py() == images.pixels(page, 480, 640, 1).tobytes()


def test_blobs_by_runs_equal_a_flood():
    def flood(m):
        left, sizes = {tuple(x) for x in np.argwhere(m).tolist()}, []
        while left:
            todo, n = [left.pop()], 0
            while todo:
                y, x = todo.pop()
                n += 1
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            sizes.append(n)
        return sorted(sizes)

    rng = np.random.default_rng(1)
    for density in (0, 0.02, 0.2, 0.4, 0.6, 1) * 20:
        m = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < density
        assert sorted(images.blobs(m)) == flood(m)


def test_percents_of_a_page_need_no_blobs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("blobs and lines aren't asked for")

    monkeypatch.setattr(images, "blobs", refuse)
    monkeypatch.setattr(images, "line_angles", refuse)
    page = bytes([0, 205, 255, 255])
    got = images.dark_and_ink.func(pa.array([page]), pa.array([2]), pa.array([2]))
    assert got.to_pylist() == [{"dark": 50.0, "ink": 25.0}]
