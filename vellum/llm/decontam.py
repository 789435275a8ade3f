"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of the test items are counted in all documents; the rarest half of each item's are its
seeds. A passage that holds two seeds of an item within a span of twice its length (one, where the item
has but one) is aligned with the item word by word; its score is the Smith-Waterman score over that of
the unchanged item, so an edited or paraphrased copy scores by what is left of it; one that keeps no two seeds isn't aligned. An excerpt that scores
like LONG unchanged words counts whatever its share of the item; any LONG words of an item hold two seeds. A passage
is told for each place of the best alignment; what lies before and behind it is aligned anew, so copies that stand
close together are all told. Items are taken in blocks of bounded size, so a large benchmark costs more passes and not
more memory.

Words are lower-cased runs of letters and digits. Null or empty text: no rows; so are an empty table of documents or
items. Items of fewer than SHORTEST words find nothing, as any text may hold them. Repeated items and repeated rows
each find their passages; a null id is told as null. ``contaminated`` takes the best item of each id, of equal scores the least.
Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.kit import U64, Tokens, cut_lineage, dealt, portions, shard_count, shard_of, utf8, windows, within

#: Bytes of test items that travel with the tasks; a larger benchmark is dealt out in blocks of this size.
BLOCK_BYTES = 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Unchanged words of an item that count as a leak on their own.
LONG = 20
#: Items of fewer words are no evidence.
SHORTEST = 4


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(best score, end in b) of a local alignment of two arrays with linear gaps; a row at a time."""
    n = len(b)
    at = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for x in a:
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new + at) - at  # gaps along the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def alignments(item: np.ndarray, words: np.ndarray, enough: float):
    """(score, first, end) in words of each place where the item scores enough: the best one, then those before and behind it."""
    todo = [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        if MATCH * min(len(item), hi - lo) < enough:
            continue
        score, end = smith_waterman(item, words[lo:hi])
        if score < enough:
            continue
        back, length = smith_waterman(item[::-1], words[lo : lo + end][::-1])
        first = lo + end - length if back == score else max(lo, lo + end - len(item))
        yield score, first, lo + end
        todo += [(lo, first), (lo + end, hi)]


class Items:
    """A block of test items as word hashes with their n-grams."""

    def __init__(self, ids: list, texts: list[bytes | None], n: int):
        self.ids, self.n = ids, n
        self.words = [h if len(h) >= max(SHORTEST, n) else h[:0] for h in (Tokens([t or b""]).h for t in texts)]
        self.length = np.array([len(w) for w in self.words], np.int64)
        grams = [np.unique(windows(w, n)) for w in self.words]
        self.gram = np.concatenate([np.empty(0, U64), *grams])
        self.owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        self.known = np.unique(self.gram)

    def choose(self, counts: np.ndarray) -> None:
        """Keeps the rarest half of each item's n-grams, ties included, and the two rarest of any LONG words, as seeds. counts: of each known n-gram."""
        df = counts[np.searchsorted(self.known, self.gram)]
        keep = np.zeros(len(self.gram), bool)
        edge = np.searchsorted(self.owner, np.arange(len(self.words) + 1))
        for o in range(len(self.words)):
            mine = np.arange(edge[o], edge[o + 1])
            if len(mine):
                keep[mine] = df[mine] <= np.sort(df[mine])[(len(mine) - 1) // 2]
                keep[mine] |= np.isin(self.gram[mine], self._rarest(o, counts))
        order = np.argsort(self.gram[keep], kind="stable")
        self.seed, self.seed_owner = self.gram[keep][order], self.owner[keep][order]
        self.seeds = np.bincount(self.seed_owner, minlength=len(self.words))
        self.gram = self.owner = self.known = None

    def _rarest(self, o: int, counts: np.ndarray) -> np.ndarray:
        """The two rarest different n-grams of each LONG words of an item."""
        g = windows(self.words[o], self.n)
        width = LONG - self.n + 1
        if width < 1 or len(g) < width:
            return g[:0]
        df = np.lib.stride_tricks.sliding_window_view(counts[np.searchsorted(self.known, g)], width)
        grams, row = np.lib.stride_tricks.sliding_window_view(g, width), np.arange(len(df))
        one = grams[row, df.argmin(axis=1)]
        two = grams[row, np.where(grams == one[:, None], np.iinfo(np.int64).max, df).argmin(axis=1)]
        return np.unique(np.concatenate((one, two)))


def documents_with(texts: list[bytes], n: int, known: np.ndarray) -> np.ndarray:
    """For each known n-gram: how many of the texts hold it."""
    t = Tokens(texts)
    g, ok = windows(t.h, n), within(t.doc, n)
    if not len(g) or not len(known):
        return np.zeros(len(known), np.int64)
    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
    ok &= known[at] == g
    pair = np.unique(t.doc[: len(g)][ok] * len(known) + at[ok])
    return np.bincount(pair % len(known), minlength=len(known))


def regions(t: Tokens, n: int, seed: np.ndarray, owner: np.ndarray, length: np.ndarray, seeds: np.ndarray):
    """(text's index, item, first word, word behind the last) of each stretch of a text that holds enough seeds of an item.

    seed: sorted n-grams, owner: the item of each; length, seeds: of each item its words and how many seeds it has.
    """
    g, ok = windows(t.h, n), within(t.doc, n)
    lo, hi = np.searchsorted(seed, g, "left"), np.searchsorted(seed, g, "right")
    many = np.where(ok, hi - lo, 0)
    p = np.repeat(np.arange(len(g)), many)
    if not len(p):
        return
    q = np.repeat(lo, many) + np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
    hits = np.stack([t.doc[p], owner[q], p, q], axis=1)
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    far = np.diff(hits[:, 2]) > 2 * length[hits[1:, 1]]
    edge = np.flatnonzero((np.diff(hits[:, 0]) != 0) | (np.diff(hits[:, 1]) != 0) | far) + 1
    for group in np.split(hits, edge):
        d, o = int(group[0, 0]), int(group[0, 1])
        if len(np.unique(group[:, 3])) >= min(2, int(seeds[o])):
            size = int(length[o])
            yield d, o, max(int(t.first[d]), int(group[0, 2]) - size), min(int(t.first[d + 1]), int(group[-1, 2]) + n + size)


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
_DDL = "doc_id long, item_id long, score double, first_word long, end_word long"


def _passages(doc, item, words: np.ndarray, region: np.ndarray, offset: int, least: float):
    """Rows of the result: the places of a region where an item's words score enough."""
    for score, begin, end in alignments(words, region, MATCH * min(least * len(words), LONG)):
        yield {"doc_id": doc, "item_id": item, "score": score / (MATCH * len(words)), "first_word": offset + begin, "end_word": offset + end}


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 3, least: float = 0.6, key: str = "doc_id", text: str = "text", item: str = "item_id", most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of each passage that scores at least so much of an item, or like LONG unchanged words.

    A benchmark of at most most_bytes, as measured, travels with the tasks, and nothing of the documents moves but
    counts; a larger one is dealt out, and seeds and documents meet by shuffle. Both find the same.
    """
    if not 1 <= n <= LONG:
        raise ValueError("n is 1 to LONG")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return _carried(rows, items, n, least) if size <= most_bytes else _dealt_out(rows, items, n, least, math.ceil(size / most_bytes))


def _carried(rows: DataFrame, items: DataFrame, n: int, least: float) -> DataFrame:
    """The way for a benchmark of bounded size: counted in one pass over the documents, looked for in another."""
    held = items.orderBy("item_id", "text").toArrow()
    block = Items(held.column("item_id").to_pylist(), utf8(held.column("text")), n)
    known = block.known

    def count(batches):
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for _, part in portions(utf8(b.column(0))):
                total += documents_with(part, n, known)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    counts = np.zeros(len(known), np.int64)
    seen = rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts[seen.column("gram").to_numpy()] = seen.column("n").to_numpy()
    block.choose(counts)

    def scan(batches):
        for b in batches:
            ids, found = b.column(0).to_pylist(), []
            for at, part in portions(utf8(b.column(1))):
                t = Tokens(part)
                for d, o, first, last in regions(t, n, block.seed, block.seed_owner, block.length, block.seeds):
                    found += _passages(ids[at + d], block.ids[o], block.words[o], t.h[first:last], first - int(t.first[d]), least)
            yield pa.RecordBatch.from_pylist(found, _FOUND)

    return rows.mapInArrow(scan, _DDL)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _dealt_out(rows: DataFrame, items: DataFrame, n: int, least: float, blocks: int) -> DataFrame:
    """The way for a benchmark of any size: documents and items are dealt out, and ranges of n-gram hashes tell each which n-grams both have."""
    shards = shard_count(rows)
    by_shard = rows.select(shard_of(shards).alias("shard"), "doc_id", "text").groupBy("shard")
    items = cut_lineage(items.withColumn("r", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int")))
    by_block = items.groupBy("block")

    def bucket(h: np.ndarray) -> np.ndarray:
        return (((h >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int32)

    def grams_of(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known = Items([], utf8(table.column("text")), n).known
        return pa.table({"bucket": pa.array(bucket(known)), "gram": _signed(known), "block": pa.array(np.full(len(known), key_[0].as_py()), pa.int32())})

    def send(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """The shard's distinct n-grams with the number of its documents that hold them, in blobs."""
        total, kept = np.empty(0, U64), []
        for _, part in portions(utf8(table.column("text"))):
            t = Tokens(part)
            g, ok = windows(t.h, n), within(t.doc, n)
            order = np.lexsort((t.doc[: len(g)][ok], g[ok]))
            g, d = g[ok][order], t.doc[: len(ok)][ok][order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1]))) if len(g) else ok[:0]
            kept.append(g[new])
        every = np.sort(np.concatenate([total, *kept]))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
        h, count = every[first], np.diff(np.append(first, len(every))).astype(np.uint32)
        return pa.Table.from_pylist([{"bucket": k, "shard": key_[0].as_py(), "h": h[s].tobytes(), "n": count[s].tobytes()} for k, s in dealt(h, shards)], pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("h", pa.binary()), ("n", pa.binary())]))

    def unpacked(table: pa.Table):
        h = np.frombuffer(b"".join(table.column("h").to_pylist()), U64)
        size = [len(x) // 8 for x in table.column("h").to_pylist()]
        return h, np.frombuffer(b"".join(table.column("n").to_pylist()), np.uint32).astype(np.int64), np.repeat(np.array(table.column("shard").to_pylist(), np.int32), size)

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        """To each block: how many documents hold its n-grams of this bucket."""
        h, many, _ = unpacked(left)
        gram = right.column("gram").to_numpy().view(U64)
        known, at = np.unique(gram, return_inverse=True)
        total = np.zeros(len(known), np.int64)
        if len(known) and len(h):
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = known[i] == h
            np.add.at(total, i[ok], many[ok])
        return pa.table({"block": right.column("block").cast(pa.int32()), "gram": _signed(gram), "df": pa.array(total[at], pa.int64())})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's seeds, each with its item, and the item's words and number of seeds."""
        block = Items(left.column("r").to_pylist(), utf8(left.column("text")), n)
        gram = right.column("gram").to_numpy().view(U64)
        order = np.argsort(gram)
        block.choose(right.column("df").to_numpy()[order])
        o = block.seed_owner
        return pa.table({"bucket": pa.array(bucket(block.seed)), "gram": _signed(block.seed), "r": pa.array([block.ids[i] for i in o.tolist()], pa.int64()), "length": pa.array(block.length[o], pa.int64()), "seeds": pa.array(block.seeds[o], pa.int64())})

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        """To each shard: the seeds of this bucket that it holds."""
        h, _, shard = unpacked(left)
        seed = right.column("gram").to_numpy().view(U64)
        order = np.argsort(seed, kind="stable")
        lo, hi = np.searchsorted(seed[order], h, "left"), np.searchsorted(seed[order], h, "right")
        many = hi - lo
        q = order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        chosen = right.take(pa.array(q))
        return pa.table({"shard": pa.array(np.repeat(shard, many), pa.int32()), **{c: chosen.column(c) for c in ("gram", "r", "length", "seeds")}})

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        """The stretches of the shard's documents to align, as word hashes."""
        seed = right.column("gram").to_numpy().view(U64)
        order = np.argsort(seed, kind="stable")
        name, owner = np.unique(right.column("r").to_numpy()[order], return_inverse=True)
        length, seeds = np.zeros(len(name), np.int64), np.zeros(len(name), np.int64)
        length[owner], seeds[owner] = right.column("length").to_numpy()[order], right.column("seeds").to_numpy()[order]
        ids, found = left.column("doc_id").to_pylist(), []
        if len(seed):
            for at, part in portions(utf8(left.column("text"))):
                t = Tokens(part)
                found += [{"r": int(name[o]), "doc_id": ids[at + d], "offset": first - int(t.first[d]), "region": t.h[first:last].tobytes()} for d, o, first, last in regions(t, n, seed[order], owner, length, seeds)]
        return pa.Table.from_pylist(found, pa.schema([("r", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("region", pa.binary())]))

    def align(batches):
        for b in batches:
            found = []
            for doc, item, offset, region, text in zip(*(c.to_pylist() for c in b.columns[:4]), utf8(b.column(4)), strict=True):
                found += _passages(doc, item, Tokens([text]).h, np.frombuffer(region, U64), offset, least)
            yield pa.RecordBatch.from_pylist(found, _FOUND)

    sent = by_shard.applyInArrow(send, "bucket int, shard int, h binary, n binary")
    grams = by_block.applyInArrow(grams_of, "bucket int, gram long, block int")
    counts = sent.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(count, "block int, gram long, df long")
    seeds = by_block.cogroup(counts.groupBy("block")).applyInArrow(choose, "bucket int, gram long, r long, length long, seeds long")
    told = sent.groupBy("bucket").cogroup(seeds.groupBy("bucket")).applyInArrow(tell, "shard int, gram long, r long, length long, seeds long")
    stretches = by_shard.cogroup(told.groupBy("shard")).applyInArrow(look, "r long, doc_id long, offset long, region binary")
    return stretches.join(items.select("r", "item_id", F.col("text").alias("item")), "r").select("doc_id", "item_id", "offset", "region", "item").mapInArrow(align, _DDL)


def contaminated(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, score): one row for each document, with its best item."""
    best = F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("best")
    return found.groupBy("doc_id").agg(best, F.sort_array(F.collect_set("item_id")).alias("item_ids")).select("doc_id", "best.item_id", "best.score", "item_ids")
