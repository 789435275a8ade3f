"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector over hashed tokens and ordered
thresholds. x marks the presence of tokens (words, runs of punctuation, words in capitals, a word said twice in a row).
Fitted on a bounded balanced sample of the labelled documents (``sample`` rows, a documented parameter): a token gets a
weight only if its documents' grades differ from those of all by more than chance would have it, as the thousands of others
would only be learned by heart; the weights then come from adaptive gradient steps with an L2 penalty, in which rare grades
count more. Every document is then scored: expected grade, and the probability of reaching ``select_from``, by which
``selected`` decides.

Null or empty text: no tokens, so its score comes from the thresholds alone. Without ratings the
scores are null and everything is selected; an empty table gives no rows. Of an id with several ratings the least counts;
of a repeated id one text is fitted. Ratings of a null id or out of range don't count. Texts are
read whole. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.kit import U64, Tokens, portions, utf8
from vellum.llm.sample import MOST_BYTES, balanced, within_bytes

BUCKETS = 1 << 18


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, bucket) of the distinct tokens of each text, sorted by text."""
    t = Tokens(texts, punctuation=True)
    said_twice = (t.h[1:] == t.h[:-1]) & (t.doc[1:] == t.doc[:-1])
    capital = (t.raw[t.start] >= 65) & (t.raw[t.start] <= 90) if len(t.start) else np.empty(0, bool)
    if len(t.start):
        second = t.raw[np.minimum(t.start + 1, len(t.raw) - 1)]
        capital &= (second >= 65) & (second <= 90)
    h = np.where(capital, U64(77), t.h)  # capitals tell more than the word they write
    h = np.concatenate((h, np.full(int(said_twice.sum()), 78, U64)))
    doc = np.concatenate((t.doc, t.doc[1:][said_twice])).astype(np.int64)
    pair = np.unique(doc * BUCKETS + (h & U64(BUCKETS - 1)).astype(np.int64))
    return pair // BUCKETS, pair % BUCKETS


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, texts: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text, for each threshold k."""
        doc, f = features(texts)
        s = np.bincount(doc, self.weights[f], minlength=len(texts))
        return _sigmoid(s[:, None] - self.thresholds[None, :])


def telling(rows: list[np.ndarray], grades: np.ndarray, levels: int, least_docs: int = 3, z: float = 3.5) -> np.ndarray:
    """Which buckets tell grades apart: in least_docs rows, of which at some threshold the share above it is z standard deviations from that of all rows."""
    by_grade = np.zeros((levels, BUCKETS))
    for f, y in zip(rows, grades, strict=True):
        by_grade[y, f] += 1
    total, above = by_grade.sum(axis=0), np.bincount(grades, minlength=levels)
    far = np.zeros(BUCKETS)
    for k in range(1, levels):
        q = above[k:].sum() / above.sum()
        spread = np.sqrt(np.maximum(total * q * (1 - q), 1e-9))
        far = np.maximum(far, np.abs(by_grade[k:].sum(axis=0) - total * q) / spread)
    return (total >= least_docs) & (far >= z)


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 8, rate: float = 0.15, l2: float = 0.02, z: float = 3.5, seed: int = 3) -> Model:
    """rows: buckets of each text; grades 0 to levels - 1. The first threshold and the gaps' logarithms are learned, so that the order holds."""
    used = telling(rows, grades, levels, z=z)
    rows = [f[used[f]] for f in rows]
    count = np.bincount(grades, minlength=levels)
    cost = np.sqrt(len(rows) / (levels * np.maximum(count, 1)))
    w, gw = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    cut = np.zeros(levels - 1)
    gc = np.full(levels - 1, 1e-3)
    rng, order = np.random.default_rng(seed), np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            f, y = rows[r], grades[r]
            theta = np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:]))))
            s = w[f].sum()
            below = np.concatenate(([0.0], _sigmoid(theta - s), [1.0]))
            slope = below * (1 - below)
            p = max(below[y + 1] - below[y], 1e-9)
            ds = (slope[y + 1] - slope[y]) / p  # of the loss, by the score
            dt = np.zeros(levels - 1)
            if y < levels - 1:
                dt[y] -= slope[y + 1] / p
            if y > 0:
                dt[y - 1] += slope[y] / p
            dc = cost[y] * np.cumsum(dt[::-1])[::-1]
            dc[1:] *= np.exp(cut[1:])
            g = cost[y] * ds + l2 * w[f]
            gw[f] += g * g
            w[f] -= rate * g / np.sqrt(gw[f])
            gc += dc * dc
            cut -= rate * dc / np.sqrt(gc)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:])))))


def fit(docs: DataFrame, ratings: DataFrame, grade: str, levels: int, sample: int = 12_000, most_bytes: int = MOST_BYTES, key: str = "doc_id", text: str = "text") -> Model | None:
    """ratings: (doc_id, grade from 0 to levels - 1). None if no rated document has a text. sample, most_bytes: rows that are fitted and the bytes of their features, which the driver holds."""
    good = ratings.where(F.col(grade).between(0, levels - 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(grade).cast("int")).alias("grade"))
    chosen = balanced(good, "grade", ["id"], sample)
    usable = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    picked = usable.join(F.broadcast(chosen), F.col("_id") == F.col("id")).select("grade", "text", "id")  # at most sample ids

    def counted(batches):
        for b in batches:
            out = []
            for at, part in portions(utf8(b.column(1))):
                doc, f = features(part)
                edge = np.searchsorted(doc, np.arange(len(part) + 1))
                out += [{"grade": b.column(0)[at + i].as_py(), "id": b.column(2)[at + i].as_py(), "f": f[edge[i] : edge[i + 1]].astype(np.uint32).tobytes()} for i in range(len(part))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("grade", pa.int32()), ("id", pa.int64()), ("f", pa.binary())]))

    # An id may have many rows, of which the one with the least hash is fitted: the driver gets no more than the sample.
    found = picked.mapInArrow(counted, "grade int, id long, f binary").groupBy("id").agg(F.min(F.struct(F.xxhash64("f"), "f", "grade")).alias("r")).select("id", "r.grade", "r.f")
    rows = sorted((r["id"], r["grade"], bytes(r["f"])) for r in within_bytes(found, ["f"], most_bytes, ("id",)).collect())
    if not rows:
        return None
    return fit_rows([np.frombuffer(f, np.uint32).astype(np.int64) for _, _, f in rows], np.array([g for _, g, _ in rows]), levels)


def grade(docs: DataFrame, model: Model | None, levels: int, select_from: int = 2, least: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, expected_grade, p_tail, selected) of every document. The weights (a fixed size) travel with the task."""

    def score(batches):
        for b in batches:
            e, p = [], []
            for _, part in portions(utf8(b.column(1))):
                if model:
                    above = model.above(part)
                    e += above.sum(axis=1).tolist()
                    p += above[:, select_from - 1].tolist()
                else:
                    e += [None] * len(part)
                    p += [None] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e, pa.float64()), pa.array(p, pa.float64())], ["doc_id", "expected_grade", "p_tail"])

    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, "doc_id long, expected_grade double, p_tail double")
    return out.withColumn("selected", F.coalesce(F.col("p_tail") >= least, F.lit(True)))
