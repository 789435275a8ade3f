"""Lines of growing logs: once each, in pieces, across restarts."""

import random

import pytest

from vellum.sources import logs


def plain(data, torn):
    out, at = [], 0
    for line in data.split(b"\n")[: None if torn and data and not data.endswith(b"\n") else -1]:
        out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("piece,step", [(1, 3), (7, 4), (64, 16), (1 << 20, 1 << 16)])
def test_pieces_give_each_line_once(tmp_path, monkeypatch, piece, step):
    monkeypatch.setattr(logs, "PIECE_BYTES", piece)
    monkeypatch.setattr(logs, "_STEP", step)
    r = random.Random(piece)
    for case in range(60):
        data = b"".join(r.choice([b"a", b"\n", b"\r\n", "é".encode(), b"longer words", b"\xff"]) for _ in range(r.randrange(0, 40)))
        path = str(tmp_path / f"f{case}")
        (tmp_path / f"f{case}").write_bytes(data)
        for torn in (False, True):
            end = len(data) if torn else logs._whole_lines_end(path, path, 0, len(data))
            assert end == (len(data) if torn else data.rfind(b"\n") + 1)
            got = [(at, line) for p in logs._pieces(path, 0, end) for _, at, line in logs._lines(p, path, torn)]
            assert got == plain(data, torn), (data, torn)
        for n in (0, 1, 3, 100):
            whole = plain(data, True)
            tail = [(at, line) for p in logs._Whole(path, n).partitions() for _, at, line in logs._Whole(path, n).read(p)]
            assert tail == (whole[-n:] if n else []), (data, n)


def test_appended_lines_come_once_also_after_a_restart(spark, tmp_path):
    folder, got = tmp_path / "logs", []
    folder.mkdir()

    def run():
        out = logs.log_stream(spark, str(folder))
        q = out.writeStream.foreachBatch(lambda b, _: got.extend((r.path.rsplit("/", 1)[1], r.at, r.line) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return sorted(got)

    (folder / "a.log").write_text("one\ntwo\nthr")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with open(folder / "a.log", "a") as f:
        f.write("ee\nfour\n")
    (folder / "b.log").write_text("b1\n")
    (folder / "_hidden").write_text("no\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three"), ("a.log", 14, "four"), ("b.log", 0, "b1")]
    assert run() == want and run() == want
    (folder / "a.log").write_text("anew\n")  # shorter than before: begun anew
    assert run() == sorted([*want, ("a.log", 0, "anew")])
    assert [(r.at, r.line) for r in logs.file_tail(spark, f"{folder}/a*", 5).collect()] == [(0, "anew")]
    assert logs.file_tail(spark, str(tmp_path / "nothing"), 5).count() == 0
    (folder / "c.log").write_text("".join(f"line {i}\n" for i in range(100_000)))
    assert [r.line for r in logs.file_tail(spark, str(folder / "c.log"), 3).collect()] == ["line 99997", "line 99998", "line 99999"]
