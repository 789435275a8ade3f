"""Language ID: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 letters of the lower-cased text, a run of other characters counting as
one gap; a feature's value is its share of the text's n-grams times its inverse document frequency.
Document frequencies are counted over all learnable documents. The weights come from follow-the-
regularised-leader with elastic-net penalties, on a bounded balanced sample (``sample`` rows, a
documented parameter); a part of the sample that training leaves out then sets the temperature.

Null text or a text without a letter: ``und``, score 0. Without a learnable document everything is ``und``, so an empty
table gives no rows. Null and repeated ids are sampled by id and text; rows alike are fitted once. Texts of any length are
counted whole. Of columns besides those to keep only the text is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.kit import U64, mix, portions, utf8
from vellum.llm.sample import MOST_BYTES, balanced, within_bytes

#: Hash buckets of n-grams: a power of two.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter; beyond it all count as letters if Python says so."""
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its text's index, whether each text has a letter)."""
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    is_letter = _letters()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    is_letter[far] = [chr(p).isalpha() for p in points[far].tolist()]
    keep = is_letter | np.concatenate(([False], is_letter[:-1]))  # of a run of others the first behind a letter, wherever the text stands
    points, doc = np.where(is_letter, points, 0)[keep], doc[keep]
    some = np.bincount(doc[points > 0], minlength=len(texts)) > 0
    h = mix(points.astype(U64) + U64(1))
    buckets, owner = [], []
    for n in ORDERS:
        m = len(h) - n + 1
        if m <= 0:
            continue
        g = h[:m].copy()
        for j in range(1, n):
            g = g * U64(0x9E3779B97F4A7C15) + h[j : m + j]
        ok = doc[:m] == doc[n - 1 :]
        if n == 1:
            ok &= points > 0
        buckets.append((mix(g + U64(n)) & U64(BUCKETS - 1)).astype(np.int64)[ok])
        owner.append(doc[:m][ok])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64), some
    return np.concatenate(buckets), np.concatenate(owner), some


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents: each task counts its own, the sums are native and at most BUCKETS + 1 rows."""

    def count(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for _, part in portions(utf8(b.column(0))):
                f, owner, _ = features(part)
                for lo in range(0, len(part), 128):
                    seen = np.zeros((min(128, len(part) - lo), BUCKETS), bool)
                    own = (owner >= lo) & (owner < lo + 128)
                    seen[owner[own] - lo, f[own]] = True
                    total[:BUCKETS] += seen.sum(axis=0)
                total[BUCKETS] += len(part)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    found = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-6, seed: int = 5) -> np.ndarray:
    """Weights (buckets, classes) by FTRL-proximal with L1 and L2 penalties; rows are (buckets, values)."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            i, x = rows[r]
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[r]] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(BUCKETS))


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores under which the held-back labels are most likely."""
    best, at = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 121):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(labels)), labels] - np.log(np.exp(s).sum(axis=1))).mean()
        if loss < best:
            best, at = loss, float(t)
    return at


@dataclass
class Model:
    """languages, and for each bucket the contribution of one n-gram to each language's score over the temperature."""

    languages: list[str]
    table: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        f, owner, some = features(texts)
        total = np.stack([np.bincount(owner, self.table[f, k], minlength=len(texts)) for k in range(len(self.languages))], axis=1)
        s = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, p.max(axis=1), 0.0).tolist()


def fit(labelled: DataFrame, sample: int = 6000, most_bytes: int = MOST_BYTES, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the rows with a text and a language; None if there is none. sample, most_bytes: rows that are fitted and the bytes of their sparse counts, which the driver holds."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    df, n = document_frequencies(usable, text)
    if not n:
        return None
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0

    def counted(batches):
        for b in batches:
            out = []
            for at, part in portions(utf8(b.column(1))):
                f, owner, _ = features(part)
                f, edge = f[np.argsort(owner, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(part)))))
                for i in range(len(part)):
                    x, c = np.unique(f[edge[i] : edge[i + 1]], return_counts=True)
                    out.append({"lang": b.column(0)[at + i].as_py(), "f": x.astype(np.uint32).tobytes(), "c": c.astype(np.uint32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("f", pa.binary()), ("c", pa.binary())]))

    # Rows alike in language and counts are fitted once: copies teach nothing, and a repeated row can't fill the driver.
    chosen = balanced(usable.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")), "lang", ["id", "h"], sample)
    rows = within_bytes(chosen.select("lang", "text").mapInArrow(counted, "lang string, f binary, c binary").distinct(), ["f", "c"], most_bytes).collect()
    rows = sorted(((r["lang"], bytes(r["f"]), bytes(r["c"])) for r in rows if len(r["f"])))
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    labels = np.array([languages.index(r[0]) for r in rows])
    data = []
    for _, f, c in rows:
        i, c = np.frombuffer(f, np.uint32).astype(np.int64), np.frombuffer(c, np.uint32).astype(np.float64)
        data.append((i, c / c.sum() * idf[i] * 10.0))
    aside = np.arange(len(rows)) % 5 == 4
    train, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    w = ftrl([data[i] for i in train], labels[train], len(languages))
    t = temperature(np.stack([data[i][1] @ w[data[i][0]] for i in held]), labels[held]) if len(held) else 1.0
    return Model(languages, (idf[:, None] * w * (10.0 / t)).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of docs with lang_pred and score; the text alone decides. The model (a fixed size per language) travels with the task."""
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches):
        for b in batches:
            lang, score = [], []
            for _, part in portions(utf8(b.column(b.num_columns - 1))):
                a, s = model.predict(part) if model else (["und"] * len(part), [0.0] * len(part))
                lang += a
                score += s
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(predict, schema)
