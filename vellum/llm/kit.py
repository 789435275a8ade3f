"""Shared tools of the operators: a byte-level word scanner, rolling word hashes and message blobs.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. In UTF-8 these separators never
occur inside a longer character, so scanning bytes gives the same words as the pattern
``[^\\x20\\x09-\\x0D]+`` does on code points. All arithmetic is on numpy arrays over small batches of
texts, so memory follows the batch and not the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.lineage import cut_lineage, shared_folder  # noqa: F401  the operators take them from here

#: Bytes of text that the scanner handles at once.
BATCH_BYTES = 1 << 20
#: Bytes of text that one shard holds: what a Python worker keeps in memory for a group.
SHARD_BYTES = 16 << 20
#: Shards send messages to each other, so beyond this many (320 GB) the shards grow instead, up to MOST_SHARD_BYTES.
MANY_SHARDS = 20_000
#: The most that a shard is let grow to; a worker needs about eight times this. At 100 TB it makes 200,000 shards, and some 400 hashes a message.
MOST_SHARD_BYTES = 1 << 29

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Words beyond so many bytes are hashed one by one.
_LONG_WORD = 64


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end], eight bytes a step; buf goes on for eight bytes behind the last end."""
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    size = end - start
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(U64) * _MULT))
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < _LONG_WORD:
        h[more] = mix(h[more] * _BASE + (eight[start[more] + k] & _MASK[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Words:
    """The words of a few texts. doc: index of each word's text; start, end: its bytes in buf."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n" * 9, np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        gap = _SEPARATOR[self.buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.base = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.base[1:])
        self.first = np.searchsorted(self.start, self.base)  # of each text: index of its first word
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.gap = gap

    def hashes(self) -> np.ndarray:
        return word_hash(self.buf, self.start, self.end) if len(self.start) else np.empty(0, U64)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; windows across two texts are there too, see within()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _MULT
        out += h[j : n + j]
    return mix(out)


def within(doc: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k words lie in one text."""
    n = len(doc) - k + 1
    return doc[:n] == doc[k - 1 :] if n > 0 else np.empty(0, bool)


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words a window of k words beginning at one of starts covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return np.cumsum(step[:n]) > 0


def portions(texts: Iterable[bytes | None], size: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in portions of about size bytes; null is an empty text."""
    at, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = t or b""
        if held and total + len(t) > size:
            yield at, held
            at, held, total = i, [], 0
        held.append(t)
        total += len(t) + 1
    if held:
        yield at, held


def utf8(column) -> list[bytes | None]:
    """A string column of Arrow as bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            return [x for c in column.chunks for x in utf8(c)]
    return column.cast(pa.large_binary()).to_pylist()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one pass that reads a single column."""
    return docs.select(F.sum(F.octet_length(text))).first()[0] or 0


def shard_count(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES, at_least: int | None = None) -> int:
    """Shards in proportion to the input up to MANY_SHARDS, and at_least so many; None: as many as shuffle partitions."""
    if at_least is None:
        at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = text_bytes(docs, text)
    return max(at_least, min(math.ceil(size / shard_bytes), MANY_SHARDS), math.ceil(size / MOST_SHARD_BYTES))


def shard_of(shards: int, key: str = "doc_id", text: str = "text") -> Column:
    """The shard of a row, by its key and its text: neither a repeated id nor a repeated text fills a shard alone."""
    return F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(shards)).cast("int")


def dealt(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) over sorted hashes: buckets are equal ranges of the hash values."""
    b = ((h >> U64(32)) * U64(buckets)) >> U64(32)
    edge = np.flatnonzero(np.diff(b)) + 1
    for lo, hi in zip([0, *edge], [*edge, len(b)], strict=True):
        if hi > lo:
            yield int(b[lo]), slice(lo, hi)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLASS = np.full(256, 2, np.uint8)  # 0: separator, 1: letter or digit or part of a longer character, 2: punctuation
_CLASS[_SEPARATOR] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1


class Tokens:
    """Lower-cased runs of letters and digits of a few texts and, where asked for, runs of punctuation."""

    def __init__(self, texts: list[bytes], punctuation: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n" * 9, np.uint8)
        kind = _CLASS[raw]
        if not punctuation:
            kind = np.where(kind == 1, kind, 0)
        edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
        some = kind[edge[:-1]] != 0
        start = edge[:-1][some]
        self.h = word_hash(_LOWER[raw], start, edge[1:][some]) if len(start) else np.empty(0, U64)
        self.start, self.end = start, edge[1:][some]
        base = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=base[1:])
        self.first = np.searchsorted(start, base)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.raw, self.base = raw, base
