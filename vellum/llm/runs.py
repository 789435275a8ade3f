"""Periodic run detection: Crochemore's partition refinement over the words of each document.

Positions are held in classes of equal factors (so many words from there on are alike). From length k to k + 1 a class is
split by the classes of its members' successors, and only members whose successor lies in a *small* class (every part of
the last split but the largest) are touched, so a position is moved O(log n) times and the work is n log n. Neighbouring
members of a class at distance k start a square of two equal halves of k words with a primitive root; squares of one
period at consecutive places are one run, whose smallest period that is.

Runs that matter here repeat ``least_exponent`` times or more, so a class with fewer than least_exponent - 1 members is left alone (a square
within such a run has as many members in its class), and lengths beyond n / least_exponent aren't looked at. All documents of a portion are
refined together: a step of numpy a length, whatever the number of documents.

Null text: no words. Null and repeated ids and repeated rows are scanned row by row. Texts of any length are scanned
whole: a worker holds one portion (PORTION_BYTES, or one longer text) and some 40 bytes for each byte of it. Ties between runs are the caller's; runs come
by start, then period. An empty table gives no rows. Columns besides the key and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.kit import U64, Words, mix, portions, utf8

#: Bytes of text refined together: more spread a step over more documents, fewer take less memory.
PORTION_BYTES = 3 << 20
_LOW = np.int64((1 << 32) - 1)


def _grouped(keys: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by key and then by themselves, where each key begins among them)."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    packed = (np.cumsum(new) - 1) << 32 | position[order]
    packed.sort()
    return packed & _LOW, np.flatnonzero(new)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[i] .. start[i] + size[i] - 1."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Partition:
    """Classes of equal factors of length k of a sequence of symbols, k = 1 at first.

    The members of class c are perm[start[c] : start[c] + size[c]], in any order; nxt and prv link them by position.
    """

    def __init__(self, symbols: np.ndarray, limit: np.ndarray, least: int):
        """symbols: one that occurs once ends each document. limit: the longest factor that matters at each position. least: members of a class that matters."""
        n = len(symbols)
        self.k, self.limit, self.least = 1, limit, least
        self.perm, self.start = _grouped(symbols, np.arange(n))
        bounds = np.concatenate((self.start, [n]))
        self.size = np.zeros(n, np.int64)
        self.size[: len(self.start)] = np.diff(bounds)
        self.classes = len(self.start)
        self.start = np.concatenate((self.start, np.zeros(n - self.classes, np.int64)))
        self.cls, self.loc = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[self.perm] = np.repeat(np.arange(self.classes), self.size[: self.classes])
        self.loc[self.perm] = np.arange(n)
        self.nxt, self.prv = np.full(n, -1), np.full(n, -1)
        a, b = self.perm[:-1], self.perm[1:]
        alike = self.cls[a] == self.cls[b]
        self.nxt[a[alike]], self.prv[b[alike]] = b[alike], a[alike]
        self.moved = np.zeros(n, bool)
        self.touched = self._matter(np.arange(n - 1))

    def _matter(self, i: np.ndarray) -> np.ndarray:
        """Those of positions i whose class may still hold a run of a period above k."""
        i = i[i >= 0]
        return i[(self.size[self.cls[i]] >= self.least) & (self.limit[i] > self.k)]

    def refine(self) -> np.ndarray:
        """From k to k + 1. The positions whose next member changed."""
        i = self.touched
        members, first = _grouped(self.cls[i] << 32 | self.cls[i + 1], i)
        self.k += 1
        count = np.diff(np.concatenate((first, [len(members)])))
        parent = self.cls[members[first]]
        # Groups of one parent stand together. Of each parent: what isn't touched, and its largest group.
        head = np.concatenate(([True], parent[1:] != parent[:-1]))
        of = np.cumsum(head) - 1
        lo = np.flatnonzero(head)
        old = parent[lo]
        rest = self.size[old] - np.add.reduceat(count, lo)
        largest = np.maximum.reduceat(count, lo)
        at_largest = np.flatnonzero(count == largest[of])
        at_largest = at_largest[np.unique(of[at_largest], return_index=True)[1]]
        # Where nothing is left untouched, the largest group keeps the class.
        moves = np.ones(len(first), bool)
        moves[at_largest[rest == 0]] = False
        group = np.flatnonzero(moves)
        if not len(group):
            self.touched = i[:0]
            return i[:0]
        m, size = members[_ranges(first[group], count[group])], count[group]
        ids = self.classes + np.arange(len(group))
        self.classes += len(group)
        changed = self._unlink(m)
        self._to_tails(m, of[group], old, size, ids)
        self.cls[m] = np.repeat(ids, size)
        alike = np.repeat(np.arange(len(group)), size)
        alike = alike[1:] == alike[:-1]
        self.nxt[m], self.prv[m] = -1, -1
        self.nxt[m[:-1][alike]], self.prv[m[1:][alike]] = m[1:][alike], m[:-1][alike]
        # Small are all parts but each parent's largest; what wasn't touched may be a small one.
        large = np.zeros(len(first), bool)
        large[at_largest[(rest > 0) & (largest > rest)]] = True
        small = [m[np.repeat(~large[group], size)]]
        untouched = old[(rest > 0) & (largest > rest)]
        if len(untouched):
            small.append(self.perm[_ranges(self.start[untouched], self.size[untouched])])
        self.touched = self._matter(np.concatenate(small) - 1)
        return np.concatenate((changed, m[:-1][alike]))

    def _unlink(self, m: np.ndarray) -> np.ndarray:
        """Takes m out of the lists of its classes; the members before what was taken."""
        by_class = np.argsort(self.cls[m] << 32 | m)
        m = m[by_class]
        joined = self.nxt[m[:-1]] == m[1:]
        p = self.prv[m[np.concatenate(([True], ~joined))]]
        q = self.nxt[m[np.concatenate((~joined, [True]))]]
        self.nxt[p[p >= 0]] = q[p >= 0]
        self.prv[q[q >= 0]] = p[q >= 0]
        return p[(p >= 0) & (q >= 0)]

    def _to_tails(self, m: np.ndarray, of: np.ndarray, old: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Moves m to the ends of its classes' slices, which become the slices of the new classes ids."""
        taken = np.bincount(of, size, len(old)).astype(np.int64)
        end = self.start[old] + self.size[old]
        tail = _ranges(end - taken, taken)
        self.moved[m] = True
        there = self.perm[tail]
        stays = there[~self.moved[there]]
        self.moved[m] = False
        inner = np.repeat(np.repeat(end - taken, np.bincount(of, minlength=len(old))), size)
        holes = self.loc[m][self.loc[m] < inner]
        self.perm[holes], self.loc[stays] = stays, holes
        self.perm[tail], self.loc[m] = m, tail
        self.size[old] -= taken
        self.size[ids] = size
        self.start[ids] = tail[np.cumsum(size) - size]


def squares(symbols: np.ndarray, limit: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the squares with a primitive root, of periods up to limit, whose class has least members."""
    p = Partition(symbols, limit, least)
    periods, places = [], []
    alive, ahead, more = np.arange(len(symbols)), {}, {}
    until = 1
    while True:
        if p.k >= until:  # the distances up to twice the length, as they are now; those that change are told by refine()
            until = 2 * p.k
            alive = alive[(p.size[p.cls[alive]] >= least) & (limit[alive] >= p.k)]
            gap = p.nxt[alive] - alive
            near = (gap >= p.k) & (gap < until)
            gap, at = gap[near], alive[near]
            order = np.argsort(gap)
            value, first = np.unique(gap[order], return_index=True)
            ahead, more = dict(zip(value.tolist(), np.split(at[order], first[1:]), strict=True)) if len(value) else {}, {}
        at = [x for x in (ahead.pop(p.k, None), *more.pop(p.k, ())) if x is not None]
        if at:
            at = np.unique(np.concatenate(at))
            at = at[(p.nxt[at] - at == p.k) & (p.size[p.cls[at]] >= least) & (limit[at] >= p.k)]
            periods.append(np.full(len(at), p.k))
            places.append(at)
        if not len(p.touched):
            break
        changed = p.refine()
        gap = p.nxt[changed] - changed
        near = (gap >= p.k) & (gap < until)
        for g in np.unique(gap[near]).tolist():
            more.setdefault(g, []).append(changed[gap == g])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *periods]), np.concatenate([none, *places])


def runs_of(symbols: np.ndarray, doc: np.ndarray, count: np.ndarray, least_exponent: int = 4, least_words: int = 6) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs of least_exponent periods and least_words words or more, by document, start, period.

    symbols: a number for each word of each document, alike only for equal words; doc: the word's document, count: words of each document.
    """
    if least_exponent < 2:
        raise ValueError("a run repeats")
    base = np.concatenate(([0], np.cumsum(count)))
    none = np.empty(0, np.int64)
    if not len(symbols):
        return none, none, none, none
    # One more place behind each document holds a symbol that occurs once.
    place = np.arange(len(symbols)) + doc
    total = len(symbols) + len(count)
    key = np.empty(total, U64)
    key[place] = mix(symbols.astype(U64) + mix(doc.astype(U64) + U64(1)))
    key[base[1:] + np.arange(len(count))] = mix(np.arange(len(count), dtype=U64) + U64(1 << 40))
    limit = np.zeros(total, np.int64)
    limit[place] = (np.where(count >= least_words, count, 0) // least_exponent)[doc]
    q, i = squares(key, limit, max(least_exponent - 1, 2))
    order = np.lexsort((i, q))
    q, i = q[order], i[order]
    if not len(q):
        return none, none, none, none
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (i[1:] != i[:-1] + 1)))
    first, last = np.flatnonzero(new), np.concatenate((np.flatnonzero(new)[1:], [len(q)])) - 1
    period, length = q[first], i[last] - i[first] + 2 * q[first]
    long = length >= np.maximum(least_words, least_exponent * period)
    at, period, length = i[first][long], period[long], length[long]
    of = np.searchsorted(base[1:] + np.arange(1, len(count) + 1), at, "right")
    start = at - base[of] - of
    order = np.lexsort((period, start, of))
    return of[order], start[order], length[order], period[order]


def scan(texts: list[bytes], planted: list[tuple[int, int] | None] | None = None, least_exponent: int = 4, least_words: int = 6):
    """(words, runs as lists of (start, length, period), kept text) of each text. planted: for each text None or (a, p): from word a on, it reads its word a + (i - a) % p in place i."""
    w = Words(texts)
    source = np.arange(len(w.start))
    for d, x in enumerate(planted or ()):
        if x is not None and w.count[d]:
            a, p = int(w.first[d]) + x[0], x[1]
            source[a : w.first[d + 1]] = a + np.arange(w.first[d + 1] - a) % p
    of, start, length, period = runs_of(w.hashes()[source], w.doc, w.count, least_exponent, least_words)
    step = np.zeros(len(source) + 1, np.int64)
    np.add.at(step, w.first[of] + start + period, 1)
    np.add.at(step, w.first[of] + start + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edge = np.searchsorted(of, np.arange(len(texts) + 1))
    found = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    # A text that keeps all its words: its bytes but for the gaps' later ones.
    raw = w.buf.copy()
    raw[w.end] = 32
    keep = ~w.gap
    keep[w.end] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    plain = raw[keep].tobytes()
    raw, out = w.buf.tobytes(), []
    for d in range(len(texts)):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        if edge[d] == edge[d + 1] and not (planted and planted[d]):
            kept = plain[total[w.start[lo]] : total[w.end[hi - 1]]] if hi > lo else b""
        else:
            words = [raw[a:b] for a, b in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist(), strict=True)]
            left = source[lo:hi][~gone[lo:hi]] - lo
            kept = b" ".join([words[j] for j in left.tolist()])
        out.append((hi - lo, found[edge[d] : edge[d + 1]], kept))
    return out


_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_RUN_ARROW = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def find_runs(docs: DataFrame, planted: Callable | None = None, key: str = "doc_id", text: str = "text", least_exponent: int = 4, least_words: int = 6) -> DataFrame:
    """(key, n_words, runs, kept_text) of each row: runs as (start, length, period) by start and period; kept_text without what a run repeats, words joined by one space.

    planted(key, n): (a, p) for texts to be read as if they repeated words a .. a + p - 1 from there to their end, else None.
    """
    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN), T.StructField("kept_text", T.StringType())])

    def work(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, part in portions(utf8(b.column(1)), PORTION_BYTES):
                where = None
                if planted:
                    count = Words(part).count.tolist()
                    where = [planted(ids[at + i], n) for i, n in enumerate(count)]
                found = scan(part, where, least_exponent, least_words)
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r, _ in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array([n for n, _, _ in found], pa.int64()), pa.array(runs, _RUN_ARROW), pa.array([k for _, _, k in found], pa.binary()).cast(pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(work, schema)


def longest(runs: Column) -> Column:
    """The run of the greatest length; of equal ones the first by start, then by period; null if there is none."""
    first = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(F.size(runs) > 0, F.struct(first["start"].alias("start"), (-first["n"]).alias("length"), first["period"].alias("period")))


def digest(runs: Column) -> Column:
    """Hex SHA-256 of a line ``start,length,period`` for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)
