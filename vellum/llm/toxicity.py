"""Toxicity: passages that score most, from token log-odds, with extreme-value calibration.

Weights: a token's log-odds between toxic and clean documents that hold it, under a Dirichlet prior in proportion to its
share of all documents (``prior`` of all counts). A token whose log-odds are ``z`` deviations from zero scores its log-odds
less ``drift``; every other token scores -drift, so a text without toxic words drifts downwards.

Passages: all maximal scoring segments of the token scores in one pass (Ruzzo and Tompa). A segment of score S in a
text of n tokens has the expectation n exp(-lambda S) by chance, where lambda solves E[exp(lambda s)] = 1 over the clean
documents' tokens (Karlin and Altschul, with their K at its bound 1); it is significant where that is at most ``most_chance``.

Documents: the best of the sums of a text's r best segments, on the scale -log P of its extreme-value distribution, is the
document's evidence. A logistic curve over the evidence, fitted on documents that the weights haven't seen (three folds,
each scored by the weights of the other two) and weighted back to all labels' shares, gives the probability.

The fit takes at most ``sample`` labelled documents, even over the labels (a documented bound); of an id with
several texts one is fitted, equal texts count once, an id labelled both ways is toxic. The driver gets the tokens that tell, at most ``most_tokens``,
and three numbers a fitted document, never a text. Scoring reads every text whole, without a shuffle.

Null or empty text: no tokens, no evidence. Null ids are scored and never learned from; repeated ids and rows are scored row by row.
With labels of one kind only, each score is that kind's (0 without any). An empty table gives no rows. Columns besides those to keep aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.kit import Tokens, cut_lineage, portions, utf8
from vellum.llm.sample import balanced

FOLDS = 3


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, by place, in linear time."""
    held: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum behind, the last one before with a smaller sum before
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, at = i, len(held) - 1
        while True:
            while at >= 0 and held[at][2] >= before:
                at = held[at][4]
            if at < 0 or held[at][3] >= total:
                held.append((first, i + 1, before, total, at))
                break
            first, _, before, _, back = held[at]
            del held[at:]
            at = back
    return [(a, b, r - x) for a, b, x, r, _ in held]


def evidence(scores: list[float], tokens: int, rate: float) -> float:
    """-log of the chance of a text's best segments, at least 0: the best over r of the sum of the r best, each in units of -log of its expectation."""
    best, total = 0.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        own = rate * s - log(max(tokens, 1))
        if own <= 0:
            break
        total += own
        best = max(best, total - (r - 1) * log(max(total, 1.0)) + lgamma(r + 1) + lgamma(r) - r * log(2))
    return best


def log_odds(toxic, clean, all_toxic, all_clean, prior: float, ln=np.log, sqrt=np.sqrt):
    """(log-odds, deviations from zero) of a token that toxic and clean documents hold, of so many counts in all; on arrays or columns."""
    alpha0 = prior * (all_toxic + all_clean)
    alpha = prior * (toxic + clean)
    odds = ln((toxic + alpha) / (all_toxic + alpha0 - toxic - alpha)) - ln((clean + alpha) / (all_clean + alpha0 - clean - alpha))
    return odds, odds / sqrt(1 / (toxic + alpha) + 1 / (clean + alpha))


def chance_rate(p: np.ndarray, s: np.ndarray, drift: float) -> float:
    """lambda: sum p exp(lambda s) + (1 - sum p) exp(-lambda drift) = 1."""
    if not len(s) or s.max() <= 0:
        return 1.0
    rest = max(1.0 - p.sum(), 1e-9)
    at = lambda x: float((p * np.exp(np.minimum(x * s, 600.0))).sum() + rest * np.exp(-x * drift)) - 1.0
    lo, hi = 1e-6, 1.0
    if at(lo) > 0:
        return lo  # the scores don't drift downwards: nothing is significant
    while at(hi) < 0 and hi < 1e3:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if at(mid) < 0 else (lo, mid)
    return lo


@dataclass
class Weights:
    """The tokens that tell, by hash, their scores, and what a segment's score is worth."""

    tokens: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float

    def found(self, texts: list[bytes]):
        """(tokens of the text, its segments, the scanner) of each text; segments are (first token, end, score)."""
        t = Tokens(texts)
        s = np.full(len(t.h), -self.drift)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, t.h), len(self.tokens) - 1)
            hit = self.tokens[at] == t.h
            s[hit] = self.scores[at[hit]]
        some = np.flatnonzero(np.bincount(t.doc[s > 0], minlength=len(texts)))
        told = {int(d): segments(s[t.first[d] : t.first[d + 1]].tolist()) for d in some}
        return t.count.tolist(), [told.get(d, []) for d in range(len(texts))], t

    def evidence(self, texts: list[bytes]) -> tuple[list[float], list[int], list[int]]:
        """(evidence, tokens, segments) of each text."""
        count, told, _ = self.found(texts)
        return [evidence([s for _, _, s in x], n, self.rate) for n, x in zip(count, told, strict=True)], count, [len(x) for x in told]


def weigh(tokens: np.ndarray, toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float, prior: float, drift: float, z: float) -> Weights:
    """tokens: hashes, with the documents of either kind that hold them; all_toxic, all_clean: the sums over all tokens."""
    if not all_toxic or not all_clean:
        return Weights(np.empty(0, np.uint64), np.empty(0), drift, 1.0)
    some = toxic + clean > 0
    tokens, toxic, clean = tokens[some], toxic[some], clean[some]
    odds, far = log_odds(toxic, clean, all_toxic, all_clean, prior)
    told = np.abs(far) >= z
    order = np.argsort(tokens[told])
    tokens, odds, toxic, clean = tokens[told][order], odds[told][order], toxic[told][order], clean[told][order]
    p = (clean + prior * (toxic + clean)) / (all_clean + prior * (all_toxic + all_clean))
    return Weights(tokens, odds - drift, drift, chance_rate(p, odds - drift, drift))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100, l2: float = 1e-3) -> tuple[float, float]:
    """(slope, at least 0, and offset) of the curve through x, by Newton's method with steps cut in half where the loss doesn't fall."""

    def loss(w):
        t = w[0] * x + w[1]
        return float((weight * (np.logaddexp(0, t) - y * t)).sum() + l2 * w[0] ** 2)

    w = np.array([0.0, log((weight[y > 0].sum() + 1e-9) / (weight[y == 0].sum() + 1e-9))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -35, 35)))
        g, v = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 2 * l2 * w[0], g.sum()])
        hess = np.array([[(v * x * x).sum() + 2 * l2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-9]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


#: Evidence beyond this says no more: the curve is fitted and read up to here.
MOST_EVIDENCE = 30.0


@dataclass
class Model:
    weights: Weights
    slope: float
    offset: float

    def probability(self, found: list[float]) -> np.ndarray:
        x = self.slope * np.minimum(np.array(found, float), MOST_EVIDENCE) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _counts(rows: DataFrame) -> DataFrame:
    """(h, n0 .. n5): in how many rows of (cell, text) each token's hash occurs, by cell: fold * 2 + toxic."""

    def count(batches):
        for b in batches:
            cells = b.column(0).to_numpy()
            for at, part in portions(utf8(b.column(1))):
                t = Tokens(part)
                order = np.lexsort((t.doc, t.h))
                h, doc = t.h[order], t.doc[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.empty(0, bool)
                pair, n = np.unique(np.rec.fromarrays([h[once], cells[at : at + len(part)][doc[once]]], names="h,c"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair.h.view(np.int64)), pa.array(pair.c, pa.int32()), pa.array(n, pa.int64())], ["h", "cell", "n"])

    found = rows.select("cell", "text").mapInArrow(count, "h long, cell int, n long").groupBy("h")
    return found.agg(*(F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in range(2 * FOLDS)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 30_000, prior: float = 0.1, drift: float = 0.25, z: float = 2.5, most_tokens: int = 1 << 17, key: str = "doc_id", text: str = "text") -> Model:
    """labels: (doc_id, 0 or 1); rows with other labels or a null id don't count."""
    good = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    share = {x["toxic"]: x["n"] for x in good.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = Weights(np.empty(0, np.uint64), np.empty(0), drift, 1.0)
    if len(share) < 2:
        return Model(none, 0.0, 35.0 if share.get(1) else -35.0)
    chosen = balanced(good, "toxic", ["id"], sample)
    usable = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    picked = usable.join(F.broadcast(chosen), F.col("_id") == F.col("id")).select("id", "toxic", F.xxhash64("text").alias("h"), "text")  # at most sample ids
    one = picked.groupBy("id").agg(F.min(F.struct("h", "toxic", "text")).alias("r")).select("r.*").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = cut_lineage(one.select((F.pmod(F.shiftright("h", 7), F.lit(FOLDS)) * 2 + F.col("toxic")).cast("int").alias("cell"), "text"))
    counts = cut_lineage(_counts(rows))
    n = [float(x or 0) for x in counts.agg(*(F.sum(f"n{c}") for c in range(2 * FOLDS))).first()]
    cells = list(range(2 * FOLDS))
    subsets = [[c for c in cells if c // 2 != f] for f in range(FOLDS)] + [cells]

    def sides(subset, of):
        return sum(of(c) for c in subset if c % 2), sum(of(c) for c in subset if not c % 2)

    def telling(subset) -> Column:
        toxic, clean = sides(subset, lambda c: F.col(f"n{c}").cast("double"))
        some = F.when(toxic + clean > 0, log_odds(toxic, clean, *sides(subset, lambda c: n[c]), prior, F.log, F.sqrt)[1])
        return F.abs(F.coalesce(some, F.lit(0.0)))

    if not all(all(sides(s, lambda c: n[c])) for s in subsets):
        return Model(none, 0.0, log(share[1] / share[0]))  # too few to tell
    far = F.greatest(*(telling(s) for s in subsets))
    told = counts.withColumn("far", far).where(F.col("far") >= z).orderBy(F.desc("far"), "h").limit(most_tokens).toArrow()
    h = told.column("h").to_numpy().view(np.uint64)
    by_cell = [told.column(f"n{c}").to_numpy().astype(float) for c in cells]
    fitted = [weigh(h, *sides(s, lambda c: by_cell[c]), *sides(s, lambda c: n[c]), prior, drift, z) for s in subsets]

    def unseen(batches):
        for b in batches:
            cell = b.column(0).to_numpy()
            for at, part in portions(utf8(b.column(1))):
                c, x = cell[at : at + len(part)], np.zeros(len(part))
                for f in np.unique(c // 2).tolist():
                    own = np.flatnonzero(c // 2 == f)
                    x[own] = fitted[f].evidence([part[i] for i in own])[0]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(x)], ["cell", "x"])

    seen = rows.mapInArrow(unseen, "cell int, x double").toArrow()
    y, x = seen.column("cell").to_numpy() % 2, np.minimum(seen.column("x").to_numpy(), MOST_EVIDENCE)
    order = np.lexsort((x, y))  # sums come out alike whatever the order of the rows
    y, x = y[order], x[order]
    weight = np.where(y > 0, share[1] / max(y.sum(), 1), share[0] / max(len(y) - y.sum(), 1))
    return Model(fitted[-1], *logistic(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep with score (0 to 1) and n_segments of each row. The weights (a bounded number) travel with the tasks."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("score", T.DoubleType()), T.StructField("n_segments", T.LongType())])

    def work(batches):
        for b in batches:
            p, n = [], []
            for _, part in portions(utf8(b.column(len(keep)))):
                x, _, m = model.weights.evidence(part)
                p += model.probability(x).tolist()
                n += m
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64()), pa.array(n, pa.int64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(work, schema)


def passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", most_chance: float = 0.01) -> DataFrame:
    """(key, first_byte, end_byte, score, chance, passage) of every significant passage; chance: how many so good ones a clean text of that length has."""
    schema = T.StructType([docs.schema[key], T.StructField("first_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("chance", T.DoubleType()), T.StructField("passage", T.StringType())])

    def work(batches):
        for b in batches:
            for at, part in portions(utf8(b.column(1))):
                count, told, t = model.weights.found(part)
                at_row, out = [], []
                for d, x in enumerate(told):
                    for first, end, s in x:
                        chance = count[d] * float(np.exp(-model.weights.rate * s))
                        if chance <= most_chance:
                            lo, hi = (int(v - t.base[d]) for v in (t.start[t.first[d] + first], t.end[t.first[d] + end - 1]))
                            at_row.append(at + d)
                            out.append((lo, hi, s, chance, part[d][lo:hi].decode("utf-8", "replace")))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at_row, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True))], names=schema.names)

    return docs.select(key, text).mapInArrow(work, schema)
