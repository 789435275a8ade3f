"""Periodic runs against the definition: every start, every period, every word compared."""

import hashlib
import random
import re
import zlib

from vellum.llm import queries, runs


def runs_by_force(w, exponent=4, words=6):
    """(start, length, period) of each maximal stretch of smallest period q."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(words, exponent * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def row_by_force(doc_id, text):
    """The contract's columns of one document."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_force(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *told, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def text(r):
    letters = "abcdefgh"[: r.choice([1, 2, 3, 8])]
    w = [r.choice(letters) for _ in range(r.choice([0, 1, 5, 6, 40, 90]))]
    for _ in range(r.randrange(4)):
        u = [r.choice(letters) for _ in range(r.randrange(1, 9))]
        at = r.randrange(len(w) + 1)
        w[at:at] = u * r.randrange(2, 7) + u[: r.randrange(len(u) + 1)]
    return w


def test_runs_are_those_of_the_definition():
    r = random.Random(5)
    for _ in range(150):
        docs = [text(r) for _ in range(r.randrange(1, 6))]
        for exponent in (2, 3, 4, 5):
            for w, (n, found, kept) in zip(docs, runs.scan([" ".join(w).encode() for w in docs], None, exponent), strict=True):
                want = runs_by_force(w, exponent)
                gone = {i for s, size, q in want for i in range(s + q, s + size)}
                assert (n, found, kept.decode().split()) == (len(w), want, [x for i, x in enumerate(w) if i not in gone])


def test_classes_touch_few_positions():
    """Smaller halves: a position is moved O(log n) times, however long the run and its classes live."""
    import numpy as np

    n = 1 << 12
    p = runs.Partition(np.concatenate([np.arange(n) % 64, [99]]).astype(np.uint64), np.full(n + 1, n), 2)
    touched = 0
    while len(p.touched):
        touched += len(p.touched)
        p.refine()
    assert p.k > n // 2 and touched < 3 * n * 12


def test_query_is_brute_force_on_whole_tables(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, r.choice([" ", "\n", "\t \x0b"]).join(text(r))) for i in range(300)]
    rows += [(None, "a " * 9), (None, None), (400, None), (401, ""), (402, " \n "), (403, "é ü " * 8), (7, "x y " * 5), (7, "x y " * 5), (404, "a b c " * 30000)]
    spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_runs int, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(x) for x in got.collect()]
    assert sorted(str(x) for x in got if x[0] != 404) == sorted(str(row_by_force(*x)) for x in rows if x[0] != 404)
    long = next(x for x in got if x[0] == 404)
    assert long[1] == 1 and long[4] == 3
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_query_is_brute_force_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 9000")
    short = {x.doc_id for x in docs.collect()}
    got = [tuple(x) for x in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == 200
    assert sorted(x for x in got if x[0] in short) == sorted(row_by_force(x.doc_id, x.text) for x in docs.collect())
