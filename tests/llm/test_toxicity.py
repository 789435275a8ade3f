"""Toxic passages and scores against plain Python over dictionaries, and accuracy on labels that the fit hasn't seen."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm import queries, toxicity


def segments_by_force(s, lo=0, hi=None):
    """The best stretch by trying all, then what lies left and right of it."""
    hi = len(s) if hi is None else hi
    best = max(((sum(s[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[1], -best[2]
    return segments_by_force(s, lo, a) + [(a, b, best[0])] + segments_by_force(s, b, hi)


def test_segments_are_all_maximal_ones():
    r = random.Random(1)
    for _ in range(400):
        s = [r.choice([-1, 1]) * r.random() * r.choice([1, 3]) for _ in range(r.randrange(0, 25))]
        got, want = toxicity.segments(s), segments_by_force(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))
    assert len(toxicity.segments([1.0, -2.0] * 200_000)) == 200_000


def tokens(text):
    return [x.decode().translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())]


def odds_by_force(y1, y0, n1, n0, prior):
    a0, a = prior * (n1 + n0), prior * (y1 + y0)
    d = math.log((y1 + a) / (n1 + a0 - y1 - a)) - math.log((y0 + a) / (n0 + a0 - y0 - a))
    return d, d / math.sqrt(1 / (y1 + a) + 1 / (y0 + a))


def model_by_force(rows, prior, drift, z):
    """Scores of tokens and lambda from (text, toxic) rows."""
    y = [Counter(), Counter()]
    for t, x in rows:
        y[x].update(set(tokens(t)))
    n = [sum(c.values()) for c in y]
    told, p = {}, {}
    for w in {*y[0], *y[1]}:
        d, far = odds_by_force(y[1][w], y[0][w], n[1], n[0], prior)
        if abs(far) >= z:
            told[w] = d - drift
            p[w] = (y[0][w] + prior * (y[1][w] + y[0][w])) / (n[0] + prior * sum(n))
    at = lambda x: sum(p[w] * math.exp(x * told[w]) for w in told) + (1 - sum(p.values())) * math.exp(-x * drift) - 1
    lo, hi = 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid) < 0 else (lo, mid)
    return told, lo


def evidence_by_force(text, told, rate, drift):
    w = tokens(text)
    own = sorted((rate * s - math.log(len(w)) for _, _, s in segments_by_force([told.get(x, -drift) for x in w])), reverse=True)
    best = 0.0
    for r in range(1, len(own) + 1):
        if own[r - 1] <= 0:
            break
        t = sum(own[:r])
        best = max(best, t - (r - 1) * math.log(max(t, 1)) + math.log(math.factorial(r) * math.factorial(r - 1)) - r * math.log(2))
    return best


def corpus(r, n=260):
    plain, bad = [f"word{i}" for i in range(60)], ["vile", "Nasty", "rötten"]
    out = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randrange(8, 26))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w) + r.choice(["", ".", "!\n"]), int(toxic) if r.random() < 0.95 else 1 - int(toxic)))
    return out


def test_fit_and_scores_are_those_of_plain_python(spark):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, cell string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, z=3.0)
    told, rate = model_by_force([(t, x) for _, t, x in rows], 0.1, 0.25, 3.0)
    assert 3 <= len(told) == len(model.weights.tokens) and abs(model.weights.rate - rate) < 1e-6
    assert all(abs(a - b) < 1e-9 for a, b in zip(sorted(told.values()), sorted(model.weights.scores.tolist()), strict=True))
    fold = {x.doc_id: (x.h >> 7) % 3 for x in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    seen = []
    for f in range(3):
        told_f, rate_f = model_by_force([(t, x) for i, t, x in rows if fold[i] != f], 0.1, 0.25, 3.0)
        seen += [(min(evidence_by_force(t, told_f, rate_f, 0.25), 30.0), x) for i, t, x in rows if fold[i] == f]
    # The curve is where the loss's slopes vanish, over evidence from unseen folds; all labels are in the sample, so all weigh alike.
    slopes = [0.0, 0.0]
    for x, y in seen:
        p = 1 / (1 + math.exp(-(model.slope * x + model.offset)))
        slopes[0] += (p - y) * x
        slopes[1] += p - y
    assert abs(slopes[0] + 2e-3 * model.slope) < 1e-4 and abs(slopes[1]) < 1e-4
    got = {x.doc_id: x.score for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    for i, t, _ in rows:
        x = model.slope * min(evidence_by_force(t, told, rate, 0.25), 30.0) + model.offset
        assert abs(got[i] - 1 / (1 + math.exp(-x))) < 1e-6


def test_passages_are_told(spark):
    rows = corpus(random.Random(3), 400)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), labels)
    odd = [(1, "Ä word1 VILE, nasty vile word2 " + "word3 " * 200 + "rötten nasty rötten"), (1, None), (None, "vile nasty vile"), (2, ""), (3, "word1 word2")]
    got = sorted(((x.doc_id or 0, x.first_byte, x.passage) for x in toxicity.passages(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()))
    first = len("Ä word1 ".encode())
    assert got == [(0, 0, "vile nasty vile"), (1, first, "VILE, nasty vile"), (1, len(odd[0][1].encode()) - len("rötten nasty rötten".encode()), "rötten nasty rötten")]


def test_odd_rows_and_labels(spark):
    rows = corpus(random.Random(4), 300)
    odd = [(None, "vile nasty"), (None, None), (1000, ""), (1001, "vile " * 50_000), (1002, "word1 " * 50_000), (7, "another text of 7"), (7, "another text of 7"), (1003, "…!?")]
    docs = spark.createDataFrame([(i, t, 0.5, "y") for i, t in [x[:2] for x in rows] + odd], "doc_id long, text string, score double, x string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, 7), (6, None), (8, 0), (8, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= x.score <= 1 for x in got)
    by_id = {x.doc_id: x.score for x in got if x.doc_id and x.doc_id >= 1000}
    assert by_id[1001] > 0.9 and by_id[1000] == by_id[1003] == by_id[1002] < 0.5
    again = toxicity.fit(docs.repartition(5), labels.repartition(2))
    assert (again.slope, again.offset) == (model.slope, model.offset)
    # Labels of one kind, none, and no documents.
    assert toxicity.fit(docs, labels.where("toxic = 1")).probability([0.0]).tolist()[0] > 0.999
    assert toxicity.fit(docs, labels.where("false")).probability([0.0]).tolist()[0] < 0.001
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels), ["doc_id"]).count() == 0
    assert 0 < toxicity.fit(docs.where("doc_id < 2"), labels).probability([0.0]).tolist()[0] < 1


def test_query_tells_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(x.toxic, x.predicted): x["count"] for x in rows}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
