"""Substring dedup by repeated-phrase automata.

A window is a run of ``window`` words of one document. Each word covered by a window that also
starts in a document with a smaller id goes. Documents are dealt to shards by id and text once; shards and
ranges of hash values then exchange only blobs of hashes:

1. anchors: of every window the phrase of ``phrase`` words with the least hash. Equal windows have
   equal anchors, and neighbouring windows mostly share theirs, so there are few. Each shard sends
   its distinct ones once, and hears which of them two documents have.
2. confirmation: each shard sends the windows whose anchor recurs, with the least id that has them and a bit
   for more than one. Where two documents have a window, its least id goes back to the shards that have
   a document above it. With the windows go the words of the shard's recurring phrases.
3. each shard compiles an Aho-Corasick automaton of the phrases that it was told and streams all of its documents
   through it. What the automaton names are the only positions that are looked at: a window around a hit
   goes if it is a confirmed one with a smaller id.

The automata are sharded by where a phrase occurs: a shard's automaton holds the recurring phrases of its
documents, and these alone can occur there. So each document passes through one automaton of bounded
size however large the table is; dealing phrases to automata without regard to documents would stream each
document through all of them, which is quadratic. A window that a third of all documents share is sent
once by a shard, not once by a document.

Windows are told apart by 96 bits of hash. Null text: no words. Null id: the row is returned as it
is and takes no part. Rows with equal ids don't remove each other's words, and repeated rows are treated alike.
An empty table gives no rows. Columns besides id and text pass through; ``n_words``, ``n_removed`` and ``kept_text``
replace columns of those names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.kit import U64, Words, covered, dealt, mix, portions, shard_count, shard_of, utf8, windows, within

#: Symbols of a digit in the automaton's alphabet: small, since its nodes search their edges in turn.
_RADIX = 64
_NO_ID = np.iinfo(np.int64).max


def anchors_of(h: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of word hashes h: position and hash of its anchor (the first of the least)."""
    g = windows(h, phrase)
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, window - phrase + 1):
        lower = g[j : n + j] < least
        least[lower] = g[j : n + j][lower]
        at[lower] = np.flatnonzero(lower) + j
    return at, least


def window_keys(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and further 32 bits of hash of each window."""
    return windows(h, window), (windows(mix(h ^ U64(0x5851F42D4C957F2D)), window) >> U64(32)).astype(np.uint32)


def _ids(table: pa.Table, key: str) -> np.ndarray:
    return np.array([_NO_ID if x is None else x for x in table.column(key).to_pylist()], np.int64)


def _least(keys: list[np.ndarray], low: np.ndarray, high: np.ndarray):
    """Distinct rows of keys (sorted by the first), least low and greatest high of each, and the group of each row."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(order) else np.empty(0, bool)
    first = np.flatnonzero(new)
    if not len(first):
        return keys, low[:0], high[:0], order, np.empty(0, np.int64)
    return [k[first] for k in keys], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), order, np.cumsum(new) - 1


_MESSAGE = "bucket int, shard int, h binary, h2 binary, low binary, several binary, words binary, starts binary"
_REPLY = "shard int, bucket int, h binary, h2 binary, low binary, words binary, starts binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("h", "h2", "low", "several", "words", "starts"))])
_REPLY_ARROW = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("h", "h2", "low", "words", "starts"))])
_NONE = {c: b"" for c in ("h", "h2", "low", "several", "words", "starts")}
_HALF = U64(0xFFFFFFFF)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _blob(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _flags(column, sizes: list[int]) -> np.ndarray:
    found = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(column.to_pylist(), sizes, strict=True)]
    return np.concatenate([np.empty(0, np.uint8), *found]).astype(bool)


def _by_shard(shard: np.ndarray, rows: np.ndarray):
    """(shard, its rows) of row numbers, in order."""
    rows = rows[np.argsort(shard[rows], kind="stable")]
    edge = np.flatnonzero(np.diff(shard[rows])) + 1
    for a, b in zip([0, *edge], [*edge, len(rows)], strict=True):
        if b > a:
            yield int(shard[rows[a]]), rows[a:b]


def _reply_anchors(table: pa.Table) -> pa.Table:
    """For each shard its anchors of this bucket that two documents have: the lower halves of their hashes."""
    sizes = [len(x) // 4 for x in table.column("h").to_pylist()]
    h = _blob(table.column("h"), np.uint32)
    several = _flags(table.column("several"), sizes)
    shard = np.repeat(np.array(table.column("shard").to_pylist(), np.int32), sizes)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    recurs = np.empty(len(h), bool)
    if len(h):
        recurs[order] = np.repeat((count > 1) | np.logical_or.reduceat(several[order], first), count)
    bucket = table.column("bucket")[0].as_py() if len(table) else 0
    return pa.Table.from_pylist([_NONE | {"shard": k, "bucket": bucket, "h": h[rows].tobytes()} for k, rows in _by_shard(shard, np.flatnonzero(recurs))], _REPLY_ARROW)


def _reply(table: pa.Table) -> pa.Table:
    """For each shard the windows of this bucket that two documents have and of which it has a document above the least; phrases go on as they are."""
    sizes = [len(x) // 8 for x in table.column("h").to_pylist()]
    h, h2, low = (_blob(table.column(c), k) for c, k in (("h", U64), ("h2", np.uint32), ("low", np.int64)))
    several = _flags(table.column("several"), sizes)
    shard = np.repeat(np.array(table.column("shard").to_pylist(), np.int32), sizes)
    _, least, _, order, group = _least([h, h2], low, low)
    at_least = np.empty(len(h), np.int64)
    at_least[order] = least[group]
    bucket = table.column("bucket")[0].as_py() if len(table) else 0
    out = [_NONE | {"shard": k, "bucket": bucket, "h": h[r].tobytes(), "h2": h2[r].tobytes(), "low": at_least[r].tobytes()} for k, r in _by_shard(shard, np.flatnonzero(several | (low > at_least)))]
    out += [_NONE | {"shard": k, "bucket": bucket, "words": w, "starts": x} for k, w, x in zip(*(table.column(c).to_pylist() for c in ("shard", "words", "starts")), strict=True) if w]
    return pa.Table.from_pylist(out, _REPLY_ARROW)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of x in the sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


class Automaton:
    """An Aho-Corasick automaton over words. A word is written as a few digits, each place with symbols of its own."""

    def __init__(self, phrases: np.ndarray):
        """phrases: a row of word hashes for each phrase, no two alike."""
        self.size = phrases.shape[1]
        self.words = np.unique(phrases)
        self.places = 1
        while _RADIX**self.places <= len(self.words):
            self.places += 1
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text, step = self._written(phrases.ravel()).tobytes().decode("latin-1"), self.size * self.places
        for i in range(0, len(text), step):
            self.trie.add_word(text[i : i + step])
        self.trie.make_automaton()

    def _written(self, h: np.ndarray) -> np.ndarray:
        n = _member(h, self.words) + 1  # 0: a word of no phrase
        return np.stack([(n // _RADIX**p % _RADIX + 1 + _RADIX * p * (p < 3)).astype(np.uint8) for p in range(self.places)], axis=1).reshape(-1)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """First words of all occurrences of the phrases in the word hashes h."""
        text = self._written(h).tobytes().decode("latin-1")
        end = np.fromiter((e for e, _ in self.trie.iter(text)), np.int64)
        end = end[(end + 1) % self.places == 0]
        return (end + 1) // self.places - self.size


def _short(h: np.ndarray) -> np.ndarray:
    """Half of each word's hash: enough to name positions, as the windows there are checked."""
    return (h & _HALF).astype(np.uint32)


def _ranged(h: np.ndarray, buckets: int) -> np.ndarray:
    """A hash as those that get messages know it: its bucket and its lower half."""
    return (((h >> U64(32)) * U64(buckets)) >> U64(32)) << U64(32) | (h & _HALF)


def substring_dedup(docs: DataFrame, window: int = 13, phrase: int = 8, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """docs with n_words, n_removed (long) and kept_text: the words left, joined by one space."""
    if not 1 <= phrase <= window:
        raise ValueError("a phrase has 1 to window words")
    n = shards or shard_count(docs, text)
    extra = [f for f in docs.schema.fields if f.name not in (key, text, "n_words", "n_removed", "kept_text")]
    side = docs.select(shard_of(n, key, text).alias("_shard"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), *(F.col(f"`{f.name}`").alias(f"_x{i}") for i, f in enumerate(extra)))
    by_shard = side.groupBy("_shard")

    def portions_of(table: pa.Table):
        ids = _ids(table, "_id")
        for at, texts in portions(utf8(table.column("_text"))):
            w = Words(texts)
            yield w, w.hashes(), ids[at : at + len(texts)]

    def send_anchors(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [(np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64))]
        for w, h, ids in portions_of(table):
            ok = within(w.doc, window)
            _, g = anchors_of(h, window, phrase)
            who = ids[w.doc[: len(ok)]]
            ok &= who != _NO_ID
            keys, low, high, _, _ = _least([g[ok]], who[ok], who[ok])
            parts.append((keys[0], low, high))
        g, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        (g,), low, high, _, _ = _least([g], low, high)
        shard = key_[0].as_py()
        return pa.Table.from_pylist([_NONE | {"bucket": b, "shard": shard, "h": (g[s] & _HALF).astype(np.uint32).tobytes(), "several": _bits(low[s] != high[s])} for b, s in dealt(g, n)], _MESSAGE_ARROW)

    def confirm(key_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        told = zip(right.column("bucket").to_pylist(), right.column("h").to_pylist(), strict=True)
        recurring = np.sort(np.concatenate([np.empty(0, U64), *(np.frombuffer(x, np.uint32).astype(U64) | U64(b) << U64(32) for b, x in told)]))
        if not len(recurring):
            return _MESSAGE_ARROW.empty_table()
        parts, phrases, known, total = [], [], np.empty(0, U64), 0
        for w, h, ids in portions_of(left):
            ok = within(w.doc, window)
            at, g = anchors_of(h, window, phrase)
            who = ids[w.doc[: len(ok)]]
            ok &= (who != _NO_ID) & (_member(_ranged(g, n), recurring) >= 0)
            k, k2 = window_keys(h, window)
            keys, low, high, _, _ = _least([k[ok], k2[ok]], who[ok], who[ok])
            parts.append((*keys, low, high))
            g, first = np.unique(g[ok], return_index=True)
            new = _member(g, known) < 0
            start, known = np.sort(at[ok][first[new]]), np.union1d(known, g[new])
            spelt = covered(start, phrase, len(h))
            place = np.cumsum(spelt) - 1
            phrases.append((_short(h)[spelt], (place[start] + total).astype(np.uint32)))
            total += int(spelt.sum())
        k, k2, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
        (k, k2), low, high, _, _ = _least([k, k2], low, high)
        shard = key_[0].as_py()
        out = [_NONE | {"bucket": b, "shard": shard, "h": k[s].tobytes(), "h2": k2[s].tobytes(), "low": low[s].tobytes(), "several": _bits(low[s] != high[s])} for b, s in dealt(k, n)]
        words, starts = (np.concatenate(x) for x in zip(*phrases, strict=True))
        out.append(_NONE | {"bucket": shard, "shard": shard, "words": words.tobytes(), "starts": starts.tobytes()})
        return pa.Table.from_pylist(out, _MESSAGE_ARROW)

    out_schema = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_text", T.StringType()), *(T.StructField(f"_x{i}", f.dataType) for i, f in enumerate(extra)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def locate(key_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        k, k2, low = (_blob(right.column(c), t) for c, t in (("h", U64), ("h2", np.uint32), ("low", np.int64)))
        order = np.lexsort([k2, k])
        k, k2, low = k[order], k2[order], low[order]
        words, starts = _blob(right.column("words"), np.uint32), _blob(right.column("starts"), np.uint32)
        automaton = Automaton(words[np.unique(starts)[:, None] + np.arange(phrase)]) if len(k) and len(starts) else None
        n_words, n_removed, kept = [], [], []
        for w, h, ids in portions_of(left):
            gone = np.zeros(len(h), bool)
            if automaton is not None and len(h) >= window:
                hits = automaton.hits(_short(h))
                starts = np.unique((hits[:, None] - np.arange(window - phrase + 1)[None, :]).ravel())
                ok = within(w.doc, window)
                starts = starts[(starts >= 0) & (starts < len(ok))]
                starts = starts[ok[starts]]
                wk, wk2 = window_keys(h, window)
                wk, wk2 = wk[starts], wk2[starts]
                at = np.searchsorted(k, wk)
                fit = np.full(len(starts), -1)
                for step in range(3):  # windows alike in the first 64 bits are next to each other
                    i = np.minimum(at + step, len(k) - 1)
                    fit = np.where((fit < 0) & (k[i] == wk) & (k2[i] == wk2), i, fit)
                who = ids[w.doc[starts]]
                starts = starts[(fit >= 0) & (low[fit] < who) & (who != _NO_ID)]
                gone = covered(starts, window, len(h))
            total = np.concatenate(([0], np.cumsum(gone)))
            raw = w.buf.tobytes()
            for i in range(len(ids)):
                a, b = w.first[i], w.first[i + 1]
                removed = int(total[b] - total[a])
                n_words.append(int(b - a))
                n_removed.append(removed)
                left_ = raw[w.base[i] : w.base[i + 1]].split()
                if removed:
                    left_ = [x for x, out in zip(left_, gone[a:b].tolist(), strict=True) if not out]
                kept.append(b" ".join(left_))
        columns = [left.column("_id"), left.column("_text"), *(left.column(f"_x{i}") for i in range(len(extra))), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(columns, names=out_schema.names)

    anchors = by_shard.applyInArrow(send_anchors, _MESSAGE).groupBy("bucket").applyInArrow(_reply_anchors, _REPLY)
    confirmed = by_shard.cogroup(anchors.groupBy("shard")).applyInArrow(confirm, _MESSAGE).groupBy("bucket").applyInArrow(_reply, _REPLY)
    found = by_shard.cogroup(confirmed.groupBy("shard")).applyInArrow(locate, out_schema)
    return found.select(F.col("_id").alias(key), F.col("_text").alias(text), *(F.col(f"_x{i}").alias(f.name) for i, f in enumerate(extra)), "n_words", "n_removed", "kept_text")
