"""Folds over ordered rows of a key as parallel scans: one key's rows may fill any number of tasks.

Rows are dealt by range of key and order and written once. Where a key runs over several pieces, each piece's rows
are first summed up as a function of the state they will be entered with: an affine map for a moving average, a sum, a
minimum, the last few rows, and for patience what becomes of each state that can be met. These summaries, at most two a piece,
are folded by the driver into the state that each piece begins with, and a second pass over all pieces gives the rows' values.

Nulls: a null key is a key; what a null value does stands at each fold. Rows alike in key and order come in the order of a hash
of the whole row. NaN counts as greater than any number, as in Spark. An empty table gives no rows. Memory is a batch of rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.lineage import cut_lineage


def _less(x, y) -> bool:
    """x < y where NaN is the greatest."""
    return x < y or (y != y and x == x)


@dataclass(frozen=True)
class Ema:
    """WIN5: the first value, then decay * before + (1 - decay) * value; nulls leave it."""

    value: str
    decay: float = 0.8
    kind = T.DoubleType()

    def start(self):
        return None

    def step(self, e, row):
        x = row[self.value]
        if x is not None:
            e = x if e is None else self.decay * e + (1 - self.decay) * x
        return e, e

    def nothing(self):
        return (1.0, 0.0, None)  # what the state before is multiplied by, what is added, and the state if there was none

    def add(self, s, row):
        x = row[self.value]
        if x is None:
            return s
        return (s[0] * self.decay, s[1] * self.decay + (1 - self.decay) * x, self.step(s[2], row)[0])

    def after(self, e, s):
        return e if s[2] is None else s[2] if e is None else s[0] * e + s[1]


@dataclass(frozen=True)
class Best:
    """WIN7: the least value so far; nulls don't count."""

    value: str
    kind = T.DoubleType()

    def start(self):
        return None

    def step(self, b, row):
        b = self.after(b, row[self.value])
        return b, b

    nothing = start

    def add(self, s, row):
        return self.after(s, row[self.value])

    def after(self, b, s):
        return b if s is None or (b is not None and not _less(s, b)) else s


@dataclass(frozen=True)
class Mean:
    """WIN17: the mean so far; nulls don't count. Sums keep what rounding takes from them, so the mean depends neither on the pieces nor on the order of the additions."""

    value: str
    kind = T.DoubleType()

    def start(self):
        return (0.0, 0.0, 0)  # the sum, what rounding took from it, and the values

    def step(self, s, row):
        s = self.add(s, row)
        total, lost, n = s
        return s, (total + lost if lost == lost else total) / n if n else None  # infinite sums lose NaN

    nothing = start

    def add(self, s, row):
        x = row[self.value]
        return s if x is None else self.after(s, (x, 0.0, 1))

    def after(self, a, b):
        total = a[0] + b[0]
        part = total - a[0]
        return (total, a[1] + b[1] + ((a[0] - (total - part)) + (b[0] - part)), a[2] + b[2])


#: Rows in a block of BlockMean, and blocks in a block of blocks; and how often that goes on.
_FAN, _LEVELS = 16, 14


@dataclass(frozen=True)
class BlockMean:
    """WIN17 with the additions of an engine that keeps a tree of sums, to the last bit; nulls don't count.

    Rows have places; every 16 from place 0 are a block, every 16 blocks a greater one, and a block's sum is that of its parts from the left. A
    running sum adds what its stretch is made of from the left: the greatest whole blocks in it and the single rows at its ends.
    place: the column with the place of the first row of the row's key.
    """

    value: str
    place: str
    kind = T.DoubleType()
    placed = True

    def start(self):
        return None  # the values, and of each level: parts of the open block, the sum so far, that of the open block, and whether it began with this key

    def _begin(self, place):
        levels = []
        for _ in range(_LEVELS):
            levels.append((place % _FAN, 0.0, 0.0, place % _FAN == 0))
            place = -(-place // _FAN)
        return 0, levels[0], tuple(levels[1:])

    def _push(self, s, level, x, counted):
        n, low, above = s
        if level == 0 and low[0] + 1 < _FAN:
            return n + counted, (low[0] + 1, low[1] + x, low[2] + x, low[3]), above
        levels = [low, *above]
        while True:
            parts, total, block, whole = levels[level]
            parts, total, block = parts + 1, total + x, block + x
            if parts < _FAN:
                levels[level] = (parts, total, block, whole)
                break
            if not whole:  # the parts of a block that other keys began stay single
                levels[level:] = [(0, total, 0.0, True), *((p, total, b, w) for p, _, b, w in levels[level + 1 :])]
                break
            level, x = level + 1, block
        levels[:level] = [(0, total, 0.0, True)] * level
        return n + counted, levels[0], tuple(levels[1:])

    def step(self, s, row):
        x = row[self.value]
        s = self._push(self._begin(row[self.place]) if s is None else s, 0, 0.0 if x is None else x, x is not None)
        return s, s[1][1] / s[0] if s[0] else None

    def nothing(self, before=0):
        return (before, None, 0, 0, (), ((),))  # rows of the key in the pieces before; the first place, the next, the values; the parts at the left end, and those of each level's open block

    def add(self, s, row):
        before, first, at, n, left, levels = s
        x = row[self.value]
        if first is None:
            first = at = row[self.place] + before
        n, at, levels = n + (x is not None), at + 1, [*levels]
        levels[0] = (*levels[0], 0.0 if x is None else x)
        level, place = 0, at
        while place % _FAN == 0:
            parts, levels[level] = levels[level], ()
            if len(parts) < _FAN:
                left += tuple((level, x) for x in parts)
                break
            block = 0.0
            for x in parts:
                block += x
            level, place = level + 1, place // _FAN
            if level == len(levels):
                levels.append(())
            levels[level] = (*levels[level], block)
        return before, first, at, n, left, tuple(levels)

    def after(self, a, b):
        _, first, _, n, left, levels = b
        if first is None:
            return a
        a = self._begin(first) if a is None else a
        for level, x in (*left, *((i, x) for i in reversed(range(len(levels))) for x in levels[i])):
            a = self._push(a, level, x, 0)
        return a[0] + n, *a[1:]


@dataclass(frozen=True)
class Number:
    """The row's number, from 1."""

    kind = T.LongType()

    def start(self):
        return 0

    def step(self, n, row):
        return n + 1, n + 1

    nothing = start

    def add(self, n, row):
        return n + 1

    def after(self, a, b):
        return a + b


@dataclass(frozen=True)
class Seconds:
    """WIN6: time for a step since the row before, in the units of at; null for the first row or where a value is null. number: the column of the steps' numbers; None: a row is a step."""

    at: str
    number: str | None = None
    kind = T.DoubleType()

    def start(self):
        return None

    def step(self, before, row):
        now = self.add(None, row)
        told = None if before is None or None in before or None in now else (now[0] - before[0]) / max(1, now[1] - before[1])
        return now, told

    nothing = start

    def add(self, s, row):
        return (row[self.at], row[self.number] if self.number else 0)

    def after(self, a, b):
        return a if b is None else b


@dataclass(frozen=True)
class Trend:
    """WIN8: the mean of the last three against the three before; null unless the last six rows have values. partial: the means are of the values there are, and one of none is no different."""

    value: str
    partial: bool = False
    kind = T.StringType()

    def start(self):
        return ()

    def step(self, s, row):
        s = self.add(s, row)
        if len(s) < 6 or (None in s and not self.partial):
            return s, None
        old, new = self._mean(s[:3]), self._mean(s[3:])
        if old is None or new is None:
            return s, "flat"
        return s, "down" if _less(new, old) else "up" if _less(old, new) else "flat"

    def _mean(self, values):
        total, n = 0.0, 0
        for x in values:  # as SQL adds; Python's sum makes up for rounding
            if x is not None:
                total, n = total + x, n + 1
        return total / n if n else None

    nothing = start

    def add(self, s, row):
        return (*s, row[self.value])[-6:]

    def after(self, a, b):
        return (*a, *b)[-6:]


@dataclass(frozen=True)
class Patience:
    """WIN10: (best, step at which so many rows in a row weren't better by least, null before); a first null is the best until a value comes.

    A state is (best, rows since, rows, stop). Where a piece is entered with an unknown best, only the least values so far within its first
    ``patience`` rows can be the first to be better: later it has stopped. From each of these on all is settled, so a summary has
    patience + 1 states at most.
    """

    value: str
    patience: int
    least: float = 1e-4
    kind = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("stop", T.IntegerType())])

    def start(self):
        return (None, 0, 0, None)

    def _better(self, x, best) -> bool:
        return x is not None and _less(x, best - self.least)

    def step(self, s, row):
        s = self._next(s, row[self.value])
        return s, {"best": s[0], "stop": s[3]}

    def _next(self, s, x):
        best, bad, n, stop = s
        if stop is not None:
            return s
        if best is None or self._better(x, best):
            return (x, 0, n + 1, None)
        return (best, bad + 1, n + 1, n + 1 if bad + 1 >= self.patience else None)

    def nothing(self):
        return (0, self.start(), ())  # rows, the state if there was no best, and (value, rows before it, state after it) of each that may be the first better one

    def add(self, s, row):
        n, fresh, walks = s
        x = row[self.value]
        walks = tuple((v, at, self._next(w, x)) for v, at, w in walks)
        if n < self.patience and x is not None and (not walks or _less(x, walks[-1][0])):
            walks += ((x, n, (x, 0, 1, None)),)
        return (n + 1, self._next(fresh, x), walks)

    def after(self, state, s):
        best, bad, before, stop = state
        n, fresh, walks = s
        if stop is not None:
            return state
        if best is None:
            return (*fresh[:2], before + fresh[2], None if fresh[3] is None else before + fresh[3]) if n else state
        left = self.patience - bad  # rows that may go by without a better one
        for v, at, w in walks:
            if at >= left:
                break
            if self._better(v, best):
                rows = before + at + w[2]
                return (w[0], w[1], rows, None if w[3] is None else before + at + w[3])
        if n >= left:
            return (best, self.patience, before + left, before + left)
        return (best, bad + n, before + n, None)


@dataclass(frozen=True)
class Differs:
    """STR6: whether the value isn't that of the row before; null is a value, and a first row differs."""

    value: str
    kind = T.BooleanType()

    def start(self):
        return ()

    def step(self, s, row):
        x = row[self.value]
        return (x,), not s or x != s[0]

    nothing = start

    def add(self, s, row):
        return (row[self.value],)

    def after(self, a, b):
        return b or a


@dataclass(frozen=True)
class Strikes:
    """STR10: how many rows in a row are true, most at most; false begins anew, null tells nothing."""

    value: str
    most: int = 4
    kind = T.IntegerType()

    def start(self):
        return (False, 0)  # whether it began anew, and the strikes since

    def step(self, s, row):
        s = self.add(s, row)
        return s, s[1]

    nothing = start

    def add(self, s, row):
        x = row[self.value]
        return s if x is None else (s[0], min(s[1] + 1, self.most)) if x else (True, 0)

    def after(self, a, b):
        return b if b[0] else (a[0], min(a[1] + b[1], self.most))


def scan(df: DataFrame, key: str, order: list[str], folds: dict, pieces: int | None = None) -> DataFrame:
    """df with a column for each of folds (name: fold), as if the rows of each key were folded in order. pieces: into how many the rows are dealt; None: by the session."""
    names = df.columns
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in names)).alias("_tie")
    by = [key, *order, "_tie"]
    dealt = df.select("*", tie)
    dealt = dealt.repartitionByRange(pieces, *by) if pieces else dealt.repartitionByRange(*by)
    rows = cut_lineage(dealt.sortWithinPartitions(*by).drop("_tie").withColumn("_p", F.spark_partition_id()))
    # Keys that run over several pieces end one and begin the next: two rows a piece tell which.
    place = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("k"))
    ends = rows.groupBy("_p").agg(F.min(place).alias("first"), F.max(place).alias("last")).orderBy("_p").collect()
    shared = {b._p for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]}  # pieces that go on with a key
    carry = _carried(rows, key, folds, ends, shared) if shared else {}
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, f.kind) for n, f in folds.items())])
    arrow = pa.schema([(n, _ARROW[f.kind.typeName()]) for n, f in folds.items()])

    def work(batches):
        state, held, begun = {}, None, False
        for b in batches:
            here = b.column(b.num_columns - 1)[0].as_py() if b.num_rows else None
            keys, data = b.column(names.index(key)).to_pylist(), _records(b, names, folds)
            out = {n: [] for n in folds}
            for k, row in zip(keys, data, strict=True):
                if not begun or k != held:
                    state = {n: f.start() for n, f in folds.items()} if begun else carry.get(here) or {n: f.start() for n, f in folds.items()}
                    held, begun = k, True
                for n, f in folds.items():
                    state[n], told = f.step(state[n], row)
                    out[n].append(told)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(out[n], arrow.field(n).type) for n in folds)], names=schema.names)

    return rows.mapInArrow(work, schema)


_ARROW = {"double": pa.float64(), "long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "struct": pa.struct([("best", pa.float64()), ("stop", pa.int32())])}


def _records(batch, names: list[str], folds: dict) -> list[dict]:
    """The values that the folds read, row by row."""
    used = sorted({v for f in folds.values() for c in ("value", "at", "number", "place") if (v := getattr(f, c, None))})
    columns = [batch.column(names.index(c)).to_pylist() for c in used]
    if not used:
        return [{}] * batch.num_rows
    return [dict(zip(used, x, strict=True)) for x in zip(*columns, strict=True)]


def _carried(rows: DataFrame, key: str, folds: dict, ends: list, shared: set[int]) -> dict[int, dict]:
    """For each piece that goes on with a key the states it begins with."""
    spans = {}  # of each piece: the places in ends of the keys that it shares, first and last
    for i, e in enumerate(ends):
        goes_on = i + 1 < len(ends) and ends[i + 1]._p in shared
        if e._p in shared or goes_on:
            spans[e._p] = (e["first"].k if e._p in shared else None, e._p in shared, e["last"].k if goes_on else None, goes_on)
    names = [c for c in rows.columns if c != "_p"]
    at = {k for first, a, last, b in spans.values() for k, some in ((first, a), (last, b)) if some}
    listed = F.col(key).isin([k for k in at if k is not None])
    some = rows.where((listed | F.col(key).isNull()) if None in at else listed)
    before = _before(some, key, ends, shared) if any(getattr(f, "placed", False) for f in folds.values()) else {}

    def summed(batches):
        """(piece, 0 for its first key and 1 for its last, summaries); a key that is both is its first."""
        held, here = {}, None
        for b in batches:
            if not b.num_rows:
                continue
            here = b.column(b.num_columns - 1)[0].as_py()
            first, a, last, z = spans.get(here, (None, False, None, False))
            for k, row in zip(b.column(names.index(key)).to_pylist(), _records(b, names, folds), strict=True):
                which = 0 if a and k == first else 1 if z and k == last else None
                if which is None:
                    continue
                if which not in held:
                    held[which] = {n: f.nothing(0 if which else before.get(here, 0)) if getattr(f, "placed", False) else f.nothing() for n, f in folds.items()}
                s = held[which]
                for n, f in folds.items():
                    s[n] = f.add(s[n], row)
        yield pa.RecordBatch.from_pylist([{"p": here, "which": w, "s": pickle.dumps(s)} for w, s in held.items()], pa.schema([("p", pa.int32()), ("which", pa.int32()), ("s", pa.binary())]))

    found = {(r.p, r.which): pickle.loads(r.s) for r in some.mapInArrow(summed, "p int, which int, s binary").collect()}
    carry, state = {}, None
    for e in ends:
        if e._p in shared:
            carry[e._p] = dict(state)
            whole = e["first"] == e["last"]
            s = found[e._p, 0]
            if whole:
                state = {n: f.after(state[n], s[n]) for n, f in folds.items()}
                continue
        s = found.get((e._p, 1))
        state = {n: f.after(f.start(), s[n]) for n, f in folds.items()} if s else None
    return carry


def _before(some: DataFrame, key: str, ends: list, shared: set[int]) -> dict[int, int]:
    """For each piece that goes on with a key the key's rows in the pieces before; some: the rows of such keys."""
    n = {(r._p, r.k): r.n for r in some.groupBy("_p", F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, passed = {}, {}
    for e in ends:
        if e._p in shared:
            before[e._p] = passed.get(e["first"].k, 0)
        for k in {e["first"].k, e["last"].k}:
            passed[k] = passed.get(k, 0) + n.get((e._p, k), 0)
    return before
