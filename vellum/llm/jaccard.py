"""N-gram Jaccard join with a prefix tree.

A document's set: its distinct shingles of ``size`` words (A-Z lower-cased); with fewer words the whole
sequence is one shingle. Two documents link where 100 * intersection >= percent * union. The result
names each document's connected component of links; no pairs are written out.

1. one order of all shingles, rarest first: documents are dealt to shards, and each shard sends its distinct
   shingles once to ranges of hash values, which count them and tell each shard how often its own occur, as
   bits and bytes in the order in which they were sent. A shingle that a third of all documents hold costs
   one entry a shard.
2. a set can link only if ``percent`` of its shingles occur elsewhere, which few sets pass. Of two sets that
   link, both hold one of the shingles that both have in their prefix, the first n - ceil(percent * n / 100) + 1
   in that order. Sets that share one are candidates, told as stars, first within a task and then between tasks.
   Nothing is lost: both bounds hold for every linked pair.
3. the candidates' connected components are gathered; equal sets are one member. A component of more than
   ``block`` sets (or 1024 times as many shingles) is cut into blocks, so no task holds an unbounded group. Each
   block is joined on its own first, together with some ``PIVOTS`` sets that go to all blocks of the group: links
   through them hold most of the group together. Then only sets outside the group's largest component so far
   meet the other blocks, as two sets that are known to hang together need no further link.
4. the sets of a task, in the global order with the most common first, are kept in a prefix tree whose
   edges hold runs of shingles. Each set walks the tree once, sharing the overlap of common prefixes; a
   subtree goes where the lengths that remain can't reach the threshold, or where all of its sets are
   known to be in the walker's component already.

Shingles are told apart by 56 bits of hash and their frequency, sets by 64 bits. Null or wordless text: empty set, no links; its
component is its id's. A null id: the row takes no part in links and its component is null. Rows with equal ids
belong together, whatever their texts. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.components import components
from vellum.llm.kit import U64, Words, cut_lineage, dealt, mix, portions, shard_count, shard_of, utf8, windows

#: Sets of a group of several blocks that go to each of them, on average; any number gives the same result.
PIVOTS = 64
#: Prefix shingles that a task gathers before it sends them.
_FLUSH = 4_000_000
_LOW = U64(0xFFFFFFFF)


def shingle_sets(texts, size: int):
    """The sorted distinct shingle hashes of each text, in order."""
    for _, part in portions(texts):
        w = Words(part, lower=True)
        h = w.hashes()
        g = windows(h, size)
        for i in range(len(part)):
            a, n = w.first[i], w.count[i]
            if not n:
                yield np.empty(0, U64)
            elif n < size:
                yield mix(windows(h[a : a + n], n) + U64(n))
            else:
                s = np.sort(g[a : a + n - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]


def prefix_length(n, percent: int):
    """How many of a set's n shingles, the rarest first, hold one that any linked set has among its own."""
    return n - (percent * n + 99) // 100 + 1


def frequency_class(count: np.ndarray) -> np.ndarray:
    """A byte that rises with a count: itself below 100, then 16 steps for each doubling."""
    steep = 100 + 16 * np.log2(np.maximum(count, 100) / 100)
    return np.where(count < 100, count, np.minimum(steep, 255)).astype(np.uint8)


class PrefixTree:
    """A prefix tree of sorted integer arrays, with a union of those that link. Nodes are columns of lists, by number."""

    def __init__(self, percent: int, vocabulary: int):
        self.percent = percent
        self.parent: list[int] = []
        self.size: list[int] = []
        self.mark = np.zeros(vocabulary, bool)
        # Of each node: its run of shingles, children by first shingle, sets that end here, the least size and the most shingles of a set below, and a set of the only component below, or -1: none, -2: several.
        self.run: list[np.ndarray] = [np.empty(0, np.int64)]
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.least, self.most, self.only = [1 << 60], [0], [-1]

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, n: int) -> int:
        """A new set of n shingles, in a component of its own."""
        self.parent.append(len(self.parent))
        self.size.append(n)
        return len(self.parent) - 1

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def _node(self, run, children, ends, least, most, only) -> int:
        for column, value in zip((self.run, self.children, self.ends, self.least, self.most, self.only), (run, children, ends, least, most, only), strict=True):
            column.append(value)
        return len(self.run) - 1

    def insert(self, s: np.ndarray, i: int) -> None:
        node, at, n, size = 0, 0, len(s), self.size[i]
        while True:
            self.least[node], self.most[node] = min(self.least[node], size), max(self.most[node], n)
            only = self.only[node]
            self.only[node] = i if only == -1 else only if only >= 0 and self.find(only) == self.find(i) else -2
            if at == n:
                self.ends[node].append(i)
                return
            child = self.children[node].get(int(s[at]))
            if child is None:
                self.children[node][int(s[at])] = self._node(s[at:], {}, [i], size, n, i)
                return
            run = self.run[child]
            k = min(len(run), n - at)
            differ = np.flatnonzero(run[:k] != s[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(run):
                rest = self._node(run[same:], self.children[child], self.ends[child], self.least[child], self.most[child], self.only[child])
                self.run[child], self.children[child], self.ends[child] = run[:same], {int(run[same]): rest}, []
            node, at = child, at + same

    def link(self, s: np.ndarray, i: int) -> list[int]:
        """Sets in the tree that link with s and weren't in its component yet; joins them."""
        n, mark, found, percent = self.size[i], self.mark, [], self.percent
        mark[s] = True
        stack = [(c, 0, 0) for c in self.children[0].values()]
        while stack:
            node, depth, shared = stack.pop()
            if self.only[node] >= 0 and self.find(self.only[node]) == self.find(i):
                continue
            run = self.run[node]
            shared += int(np.count_nonzero(mark[run]))
            depth += len(run)
            left = len(s) - int(np.searchsorted(s, run[-1], "right"))  # what s has behind this run
            if (shared + min(left, self.most[node] - depth)) * (100 + percent) < percent * (n + self.least[node]):
                continue
            for j in self.ends[node]:
                if shared * (100 + percent) >= percent * (n + self.size[j]) and self.find(j) != self.find(i):
                    self.union(i, j)
                    found.append(j)
            stack.extend((c, depth, shared) for c in self.children[node].values())
        mark[s] = False
        return found


def tree_components(sizes: list[int], sets: list[np.ndarray], percent: int, build: int | None = None, known: list[int] | None = None) -> list[int]:
    """For each set the first set (by place) of its component.

    sets: shingles that may be shared, in any order that is the same for all; sizes: how many each set has in all.
    build: only the first so many go into the tree, the others walk it and don't meet each other. known: sets of
    one value hang together already.
    """
    if not sets:
        return []
    words = np.unique(np.concatenate(sets))
    tree, at, lead = PrefixTree(percent, len(words)), {}, {}
    # Greatest first: the order of the sets' numbers has the rarest first, and common prefixes are shared.
    ranked = [np.sort(len(words) - 1 - np.searchsorted(words, s)) for s in sets]
    build = len(sets) if build is None else build
    order = sorted(range(build), key=lambda i: (sizes[i], i)) + list(range(build, len(sets)))
    for i in order:
        at[i] = tree.add(sizes[i])
        if known is not None:
            tree.parent[at[i]] = tree.find(lead.setdefault(known[i], at[i]))
        if (build == len(sets) or i >= build) and len(ranked[i]):
            tree.link(ranked[i], at[i])
        if i < build:
            tree.insert(ranked[i], at[i])
    first: dict[int, int] = {}
    roots = [tree.find(at[i]) for i in range(len(sets))]
    return [first.setdefault(r, i) for i, r in enumerate(roots)]


def _node(s: np.ndarray) -> int:
    """A set's name."""
    return int(mix(mix(s).sum(dtype=U64, keepdims=True) + U64(len(s)))[0].astype(np.int64)) if len(s) else 0


_ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("name", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("tokens", T.BinaryType())])
_ROWS_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("k", pa.int32()), ("tokens", pa.binary())])
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("h", pa.binary()), ("at", pa.binary()), ("count", pa.binary())])
_SENT = "bucket int, shard int, h binary, at binary, count binary"
_TOLD_ARROW = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("frequency", pa.binary())])
_TOLD = "shard int, bucket int, bits binary, frequency binary"
_LINKS_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_LINKS = "bucket int, kind int, a binary, b binary"
_PAIRS = "a long, b long"


def _blobs(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def counted(table: pa.Table) -> pa.Table:
    """To each shard: a bit for each of its shingles of this bucket that occurs elsewhere, too, and a byte of how often."""
    blobs = table.column("h").to_pylist()
    size = np.array([len(x) // 4 for x in blobs], np.int64)
    start = np.concatenate(([0], np.cumsum(size)))
    h = np.frombuffer(b"".join(blobs), np.uint32)
    count = np.ones(len(h), np.int64)
    for i, (at, c) in enumerate(zip(table.column("at").to_pylist(), table.column("count").to_pylist(), strict=True)):
        count[start[i] + np.frombuffer(at, np.uint32)] = np.frombuffer(c, np.uint32)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.empty(0, np.int64)
    total = np.add.reduceat(count[order], first) if len(first) else first
    each = np.empty(len(h), np.uint8)
    each[order] = np.repeat(frequency_class(total), np.diff(np.append(first, len(h))))
    out = []
    for i, (shard, bucket) in enumerate(zip(table.column("shard").to_pylist(), table.column("bucket").to_pylist(), strict=True)):
        mine = each[start[i] : start[i + 1]]
        if (mine > 1).any():
            out.append({"shard": shard, "bucket": bucket, "bits": np.packbits(mine > 1).tobytes(), "frequency": mine[mine > 1].tobytes()})
    return pa.Table.from_pylist(out, _TOLD_ARROW)


def _stars(token: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, least name of each, links of every other name with it)."""
    order = np.lexsort((name, token))
    token, name = token[order], name[order]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
    lead = np.repeat(name[first], np.diff(np.append(first, len(token))))
    other = name != lead
    return token[first], name[first], np.unique(np.stack([name[other], lead[other]], axis=1), axis=0)


def _links_out(link: np.ndarray, buckets: int) -> list[dict]:
    place = mix(link[:, 0].astype(U64))
    order = np.argsort(place)
    link = link[order]
    return [{"bucket": k, "kind": 1, "a": link[s, 0].tobytes(), "b": link[s, 1].tobytes()} for k, s in dealt(place[order], buckets)]


def told_once(table: pa.Table) -> pa.Table:
    link = np.unique(np.stack([_blobs(table.column("a"), np.int64), _blobs(table.column("b"), np.int64)], axis=1), axis=0)
    return pa.table({"a": pa.array(link[:, 0], pa.int64()), "b": pa.array(link[:, 1], pa.int64())})


def _joined(table: pa.Table, percent: int, key: str, first: list[bool] | None = None, known: list[int] | None = None) -> pa.Table:
    """Stars (a, b) of the components of a task's sets; first: the sets that go into the tree."""
    ids, sizes = table.column(key).to_pylist(), table.column("n").to_pylist()
    sets = [np.frombuffer(x, U64) for x in table.column("tokens").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (first is not None and not first[i], ids[i]))
    roots = tree_components([sizes[i] for i in order], [sets[i] for i in order], percent, None if first is None else sum(first), known and [known[i] for i in order])
    least: dict[int, int] = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, ids[order[k]]), ids[order[k]])
    return pa.table({"a": pa.array([ids[i] for i in order], pa.int64()), "b": pa.array([least[r] for r in roots], pa.int64())})


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, block: int = 2048, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; component_id is the least id reachable by links."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    n = shards or shard_count(docs, text)
    rows = docs.select(shard_of(n, key, text).alias("shard"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    by_shard = rows.groupBy("shard")

    def members(table: pa.Table):
        """ids, and of each row its set and name; sets of rows without an id don't count."""
        ids = table.column("id").to_pylist()
        sets = list(shingle_sets(utf8(table.column("text")), size))
        names = [_node(s) for s in sets]
        lead: dict[int, int] = {}
        for i, name in enumerate(names):
            if ids[i] is not None and len(sets[i]):
                lead.setdefault(name, i)
        return ids, sets, names, list(lead.values())

    def send(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, sets, _, lead = members(table)
        h = np.sort(np.concatenate([np.empty(0, U64), *(sets[i] for i in lead)]))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
        h, count = h[first], np.diff(np.append(first, len(h)))
        out = []
        for k, s in dealt(h, n):
            at = np.flatnonzero(count[s] > 1)
            out.append({"bucket": k, "shard": key_[0].as_py(), "h": (h[s] & _LOW).astype(np.uint32).tobytes(), "at": at.astype(np.uint32).tobytes(), "count": count[s][at].astype(np.uint32).tobytes()})
        return pa.Table.from_pylist(out, _SENT_ARROW)

    def receive(key_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sets, names, lead = members(left)
        k, tokens = [None] * len(ids), [None] * len(ids)
        told = dict(zip(right.column("bucket").to_pylist(), zip(right.column("bits").to_pylist(), right.column("frequency").to_pylist(), strict=True), strict=True))
        if told and lead:
            length = np.array([len(sets[i]) for i in lead])
            every = np.concatenate([sets[i] for i in lead])
            distinct, at = np.unique(every, return_inverse=True)
            frequency = np.zeros(len(distinct), np.uint8)
            for b, s in dealt(distinct, n):
                if b in told:
                    bits, f = told[b]
                    frequency[s.start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=s.stop - s.start))] = np.frombuffer(f, np.uint8)
            f = frequency[at]
            start = np.concatenate(([0], np.cumsum(length)))
            shared = np.add.reduceat(f > 1, start[:-1], dtype=np.int64)
            for j in np.flatnonzero(100 * shared >= percent * length).tolist():
                mine = slice(start[j], start[j + 1])
                token = np.sort((f[mine].astype(U64) << U64(56) | every[mine] >> U64(8))[f[mine] > 1])
                i, alone = lead[j], int(length[j] - shared[j])
                k[i], tokens[i] = int(prefix_length(int(length[j]), percent)) - alone, token.tobytes()
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(k, pa.int32()), pa.array(tokens, pa.binary())], schema=_ROWS_ARROW)

    def prefixes(batches):
        held, total = [], 0

        def out():
            token, lead, link = _stars(np.concatenate([t for t, _ in held]), np.repeat(np.array([x for _, x in held], np.int64), [len(t) for t, _ in held]))
            place = mix(token)
            order = np.argsort(place)
            token, lead = token[order], lead[order]
            found = [{"bucket": b, "kind": 0, "a": token[s].tobytes(), "b": lead[s].tobytes()} for b, s in dealt(place[order], n)]
            return pa.RecordBatch.from_pylist(found + _links_out(link, n), _LINKS_ARROW)

        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((np.frombuffer(t, U64), name))
                total += len(t) // 8
                if total >= _FLUSH:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        _, _, link = _stars(_blobs(table.column("a"), U64), _blobs(table.column("b"), np.int64))
        return pa.Table.from_pylist(_links_out(link, n), _LINKS_ARROW)

    def within_block(table: pa.Table) -> pa.Table:
        return _joined(table, percent, "rep")

    def across(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        one, two = key_[1].as_py(), key_[2].as_py()
        first = None if one == two else [x == one for x in table.column("unit").to_pylist()]
        return _joined(table, percent, "rep", first, table.column("part").to_pylist())

    heard = by_shard.applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(counted, _TOLD)
    measured = cut_lineage(by_shard.cogroup(heard.groupBy("shard")).applyInArrow(receive, _ROWS))
    narrow = measured.select("id", "n", "name")
    classes = narrow.where("n > 0 and id is not null").groupBy("name", "n").agg(F.min("id").alias("rep"))
    sets = measured.where("tokens is not null")
    sent = sets.select("name", F.substring("tokens", F.lit(1), F.col("k") * 8).alias("prefix")).mapInArrow(prefixes, _LINKS)
    links = sent.where("kind = 0").groupBy("bucket").applyInArrow(meet, _LINKS).unionByName(sent.where("kind = 1"))
    coarse = components(links.groupBy("bucket").applyInArrow(told_once, _PAIRS))
    # One member for each set, with its group of candidates; groups are dealt in blocks by rank of a hash.
    gathered = classes.join(coarse.select(F.col("node").alias("name"), F.col("component").alias("group")), "name")
    sizes = gathered.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(block)), F.ceil(F.col("shingles") / F.lit(block * 1024))).cast("int")
    placed = gathered.join(sizes, "group").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    held = placed.join(sets.select("name", "tokens"), "name").dropDuplicates(["name"])  # several shards may hold a set
    held = cut_lineage(held.select("group", "members", "blocks", "block", "name", "rep", "n", "tokens"))
    everywhere = F.pmod(F.xxhash64("name", F.lit(1)), F.col("members")) < PIVOTS
    tasks = held.select("group", "blocks", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("task"), "rep", "n", "tokens")
    stars = cut_lineage(tasks.groupBy("group", "task").applyInArrow(within_block, _PAIRS))
    # Ids with several sets hold these together.
    several = cut_lineage(narrow.where("id is not null").groupBy("id").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select("id"))
    repeated = not several.isEmpty()
    if repeated:
        of_id = narrow.where("n > 0").join(several, "id").join(classes.select("name", "rep"), "name")
        stars = stars.unionByName(of_id.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    cut = held.where("blocks > 1")
    if cut.isEmpty() and not repeated:
        exact = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    else:
        exact = components(stars)
    if not cut.isEmpty():
        exact = _across_blocks(cut, exact, block, across)
    named = classes.join(exact, F.col("rep") == F.col("node"), "left").select("name", F.coalesce("component", "rep").alias("component"))
    with_set = narrow.where("n > 0").join(named, "name", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    empty = narrow.where("n = 0")
    if repeated:  # an empty row of an id that has other sets, too
        empty = empty.join(exact.select("node", "component"), F.col("id") == F.col("node"), "left")
        empty = empty.select("id", "n", F.coalesce("component", "id").alias("component"))
    else:
        empty = empty.select("id", "n", F.col("id").alias("component"))
    return with_set.unionByName(empty).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _across_blocks(cut: DataFrame, exact: DataFrame, block: int, across) -> DataFrame:
    """exact with the links between blocks: sets outside a group's largest component so far meet all other blocks."""
    parts = cut.join(exact, F.col("rep") == F.col("node"), "left").select("group", "name", "rep", "n", "blocks", "block", F.coalesce("component", "rep").alias("part"))
    parts = cut_lineage(parts)
    counted_ = parts.groupBy("group", "part").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    rest = counted_.groupBy("group").agg(F.max(F.struct("members", "part", "shingles")).alias("major"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"))
    units = F.greatest(F.ceil((F.col("members") - F.col("major.members")) / F.lit(block)), F.ceil((F.col("shingles") - F.col("major.shingles")) / F.lit(block * 1024))).cast("int")
    rest = cut_lineage(rest.select("group", F.col("major.part").alias("major"), units.alias("units")).where("units > 0"))
    if rest.isEmpty():
        return exact
    minor = F.col("part") != F.col("major")
    dealt_out = parts.join(rest, "group").withColumn("unit", F.when(minor, F.col("blocks") + F.pmod(F.xxhash64("name"), F.col("units"))).otherwise(F.col("block")).cast("int"))
    others = F.when(minor, F.sequence(F.lit(0), F.col("blocks") + F.col("units") - 1)).otherwise(F.sequence(F.col("blocks"), F.col("blocks") + F.col("units") - 1))
    dealt_out = dealt_out.withColumn("task", F.explode(F.transform(others, lambda j: F.struct(F.least(j, F.col("unit")).alias("one"), F.greatest(j, F.col("unit")).alias("two")))))
    crossing = dealt_out.select("group", "task.one", "task.two", "unit", "part", "name", "rep", "n").join(cut.select("name", "tokens"), "name")
    more = crossing.groupBy("group", "one", "two").applyInArrow(across, _PAIRS)
    return components(exact.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
