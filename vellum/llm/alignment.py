"""Cross-tokenizer alignment: where two tokenizers cut the same bytes, and which of their tokens stand for each other.

Both encodings of a text are laid over its bytes as one string of labels: 0 no token ends here, 1 one of A, 2 one of B,
3 one of both. A regular expression takes spans up to each 3; the labels counted in a span are the tokens of its group.
A token of A and one of B overlap in bytes exactly where a stretch between two neighbouring ends is common to both, so the
links are the places with a label, and no pairs within a group are tried.

``align`` counts each pair of ids over all documents: documents are dealt once to shards as ids, shards count their pairs, the
counts are summed natively and come back to the shards that hold the pair. ``token_groups`` gives the groups with their
bytes, ``pair_counts`` the table of pairs.

Null or empty texts, and texts whose bytes one of the tokenizers doesn't give back, have no tokens: zeros and an empty
digest. Null and repeated ids and repeated rows are rows of their own. Texts of any length are encoded whole. Ties for an id's best pair all
count. An empty table gives no rows. Columns besides key and text aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.kit import portions, shard_count, utf8

#: Where the two vocabularies lie on the driver; their bytes travel with the tasks.
FOLDER = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fixed value: how the byte-level format cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only are merged by the faster of the two libraries; on others their tables of Unicode might differ.
_PLAIN = re.compile("[\t\n\r -~\u00a0-\u024f]*")
_SPAN = re.compile(b"[\x00-\x02]*\x03")


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """A byte-level BPE from its JSON. Special tokens' strings in a text are plain text."""

    def __init__(self, raw: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(raw.decode())
        self.whole.encode_special_tokens = True
        told, alphabet = json.loads(raw), _byte_alphabet()
        vocab, merges = told["model"]["vocab"], told["model"]["merges"]
        spelt = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocab.items()}
        spelt |= {x["id"]: x["content"].encode() for x in told.get("added_tokens", ()) if x["id"] not in spelt}
        self.bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        # Where merges come in the order of their ids, ids are the ranks that the faster library merges by.
        made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        pre = told.get("pre_tokenizer") or {}
        usual = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        ranked = made == sorted(set(made)) and min(made, default=0) >= 256
        added = {x["content"] for x in told.get("added_tokens", ())}
        ranks = {spelt[i]: i for t, i in vocab.items() if t not in added}
        self.quick = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked and usual and all(bytes([b]) in ranks for b in range(256)) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.quick is not None and _PLAIN.fullmatch(t) is not None for t in texts]
        other = iter(self.whole.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if p else next(other).ids for t, p in zip(texts, plain, strict=True)]


class PieceTokenizer:
    """A sentence-piece model; it puts a space before each text."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


@lru_cache(2)
def _tokenizers(byte_file: bytes, piece_file: bytes) -> tuple[ByteTokenizer, PieceTokenizer]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteTokenizer(byte_file), PieceTokenizer(piece_file)


def _sizes(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in tokens], np.int64)


def _same(ids: list[list[int]], spelt: list[bytes], texts: list[bytes]) -> np.ndarray:
    """Of which texts the tokens give back the bytes."""
    return np.array([b"".join([spelt[i] for i in x]) == t for x, t in zip(ids, texts, strict=True)], bool)


def labels_of(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """The label of each byte under tokens a and b, which cover the same bytes."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    labels = np.zeros(int(a_end[-1]) if len(a_end) else 0, np.uint8)
    labels[a_end - 1] = 1
    labels[b_end - 1] += 2
    return labels


def links_of(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the token of A, pair of ids) of each link, in the order of the bytes."""
    end = labels_of(a, b, a_size, b_size)
    end = end[end > 0]
    of_a, of_b = end & 1, end >> 1
    i = np.cumsum(of_a, dtype=np.int64) - of_a
    j = np.cumsum(of_b, dtype=np.int64) - of_b
    return i, a[i].astype(np.int64) << 32 | b[j].astype(np.int64)


class Portion:
    """The tokens and groups of a few texts. n_a, n_b, n_groups, n_links: of each text; a, b: all ids in order; spans, a_of, b_of: bytes and tokens of each group."""

    def __init__(self, texts: list[bytes], one: ByteTokenizer, two: PieceTokenizer):
        self.one, self.two = one, two
        some = [i for i, t in enumerate(texts) if t]
        said = [texts[i].decode("utf-8", "replace") for i in some]
        spaced = [b" " + texts[i] for i in some]
        x, y = one.encode([" " + t for t in said]), two.encode(said)
        ok = _same(x, one.bytes, spaced) & _same(y, two.bytes, spaced)
        n = len(texts)
        self.n_a, self.n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
        kept = np.flatnonzero(ok).tolist()
        for k in kept:
            self.n_a[some[k]], self.n_b[some[k]] = len(x[k]), len(y[k])
        flat = lambda ids: np.array([i for k in kept for i in ids[k]], np.int64)
        self.a, self.b = flat(x), flat(y)
        a_size, b_size = _sizes(one.bytes), _sizes(two.bytes)
        labels = labels_of(self.a, self.b, a_size, b_size)
        spans = np.fromiter(map(len, _SPAN.findall(labels.tobytes())), np.int64)
        start = np.cumsum(spans) - spans
        self.spans = spans
        self.a_of = np.add.reduceat(labels & 1, start, dtype=np.int64) if len(spans) else spans
        self.b_of = np.add.reduceat(labels >> 1, start, dtype=np.int64) if len(spans) else spans
        a_doc = np.repeat(np.arange(n), self.n_a)
        self.n_groups = np.bincount(a_doc[np.cumsum(self.a_of) - self.a_of], minlength=n) if len(spans) else np.zeros(n, np.int64)
        i, self.pairs = links_of(self.a, self.b, a_size, b_size)
        self.n_links = np.bincount(a_doc[i], minlength=n)

    def written(self) -> list[str]:
        """Hex SHA-256 of each text's groups, written ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        a_before, b_before = np.cumsum(self.a_of) - self.a_of, np.cumsum(self.b_of) - self.b_of
        group_a, group_b = np.repeat(np.arange(len(self.spans)), self.a_of), np.repeat(np.arange(len(self.spans)), self.b_of)
        at_a = np.arange(len(self.a)) + b_before[group_a]
        at_b = np.arange(len(self.b)) + (a_before + self.a_of)[group_b]
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[a_before + self.a_of - 1], last_b[b_before + self.b_of - 1] = True, True
        size_a, size_b = len(self.one.bytes), len(self.two.bytes)
        row = np.empty(len(self.a) + len(self.b), np.int64)
        row[at_a] = self.a + size_a * last_a
        row[at_b] = 2 * size_a + self.b + size_b * last_b
        said, at, out = _written(size_a, size_b), 0, []
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256("".join([said[i] for i in row[at : at + n].tolist()])[:-1].encode()).hexdigest() if n else "")
            at += n
        return out


@lru_cache(2)
def _written(size_a: int, size_b: int) -> list[str]:
    """Each id with what may stand behind it."""
    return [f"{i}{c}" for size, marks in ((size_a, ",|"), (size_b, ",;")) for c in marks for i in range(size)]


def _files(folder: str) -> tuple[bytes, bytes]:
    out = []
    for name in (BYTE_FILE, PIECE_FILE):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return out[0], out[1]


def encoded(docs: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER) -> DataFrame:
    """The columns keep with n_a, n_b, n_groups, n_links, groups_sha256 and the ids of both tokenizers, 16 bits each where they fit."""
    files = _files(folder)
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType()), T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def work(batches):
        one, two = _tokenizers(*files)
        for b in batches:
            for at, part in portions(utf8(b.column(len(keep)))):
                p = Portion(part, one, two)
                cut = lambda x, n, kind: [bytes(y.astype(kind).tobytes()) for y in np.split(x, np.cumsum(n)[:-1])]
                columns = [pa.array(x, pa.int64()) for x in (p.n_a, p.n_b, p.n_groups, p.n_links)]
                columns += [pa.array(p.written(), pa.string()), pa.array(cut(p.a, p.n_a, _kind(one.bytes)), pa.binary()), pa.array(cut(p.b, p.n_b, _kind(two.bytes)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(part)) for i in range(len(keep))), *columns], names=schema.names)

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(work, schema)


def _kind(tokens: list[bytes]) -> type:
    return np.uint16 if len(tokens) <= 1 << 16 else np.uint32


def _blocks(table: pa.Table, kinds, rows: int = 1 << 10):
    """(first row, n_a, a, b) of some rows at a time."""
    for lo in range(0, table.num_rows, rows):
        t = table.slice(lo, rows)
        a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), k).astype(np.int64) for c, k in zip(("_a", "_b"), kinds, strict=True))
        yield lo, t.column("n_a").to_numpy(), a, b


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, and the sums of n."""
    order = np.argsort(pairs)
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.empty(0, np.int64)
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


class _Shards:
    """Documents as ids, dealt to shards, and each shard's pairs. Both reads of the shards share one shuffle."""

    def __init__(self, docs: DataFrame, key: str, text: str, folder: str):
        one, two = _tokenizers(*_files(folder))
        sizes, kinds = (_sizes(one.bytes), _sizes(two.bytes)), (_kind(one.bytes), _kind(two.bytes))
        # Rows alike in key and text may be many, so the place in the input has a say too.
        # Each shard asks for its pairs once, so shards follow the bytes and the cores: as many as shuffle partitions would ask for the same pairs over and over.
        shards = shard_count(docs, text, at_least=docs.sparkSession.sparkContext.defaultParallelism)
        shard = F.pmod(F.xxhash64(F.col(key), F.col(text), F.spark_partition_id()), F.lit(shards)).cast("int")
        self.sizes, self.kinds = sizes, kinds
        self.rows = encoded(docs.select(shard.alias("_shard"), F.col(key).alias("_key"), F.col(text).alias("_text_")), ["_shard", "_key"], "_text_", folder)
        self.by_shard = self.rows.groupBy("_shard")

        def count(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
            for _, _, a, b in _blocks(table, kinds):
                p, m = np.unique(links_of(a, b, *sizes)[1], return_counts=True)
                pairs, n = _summed(np.concatenate((pairs, p)), np.concatenate((n, m)))
            return pa.table({"_shard": pa.array(np.full(len(pairs), key_[0].as_py()), pa.int32()), "pair": pairs, "n": n})

        self.pairs = self.by_shard.applyInArrow(count, "_shard int, pair long, n long")
        self.counts = self.pairs.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """(a_id, b_id, n): how many links of all documents hold each pair of ids."""
    found = _Shards(docs, key, text, folder).counts
    return found.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n")


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    n_best: links whose pair is its B id's most frequent one over all documents, ties included; count_sum: the links' counts over all documents, summed.
    """
    s = _Shards(docs, key, text, folder)
    sizes, kinds = s.sizes, s.kinds
    # A B id has at most as many pairs as A has ids, so the window is bounded by the vocabulary.
    by_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    marked = s.counts.select("pair", F.col("n").alias("total"), (F.col("n") == F.max("n").over(by_b)).alias("best"))
    answers = s.pairs.select("_shard", "pair").join(marked, "pair")
    schema = T.StructType([T.StructField("_key", s.rows.schema["_key"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups_sha256", T.StringType())])

    def look_up(key_: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        pair, total, best = (right.column(c).to_numpy() for c in ("pair", "total", "best"))
        order = np.argsort(pair)
        pair, total, best = pair[order], total[order], best[order].astype(np.int64)
        n_best, count_sum = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        for lo, n_a, a, b in _blocks(left, kinds):
            i, p = links_of(a, b, *sizes)
            doc = np.repeat(np.arange(len(n_a)), n_a)[i]
            at = np.searchsorted(pair, p)
            np.add.at(n_best, doc + lo, best[at])
            np.add.at(count_sum, doc + lo, total[at])
        told = {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
        return pa.Table.from_arrays([told[f.name] if f.name in told else left.column(f.name) for f in schema.fields], names=schema.names)

    found = s.by_shard.cogroup(answers.groupBy("_shard")).applyInArrow(look_up, schema)
    return found.withColumnRenamed("_key", key)


def token_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """(key, groups) of each row: the groups in order as (first byte, end byte, A's ids, B's ids), bytes of a space and the text."""
    files = _files(folder)
    group = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([docs.schema[key], T.StructField("groups", T.ArrayType(group))])
    arrow = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]))

    def work(batches):
        one, two = _tokenizers(*files)
        for batch in batches:
            for at, part in portions(utf8(batch.column(1))):
                p, g, i, j = Portion(part, one, two), 0, 0, 0
                out = []
                for n in p.n_groups.tolist():
                    first, groups = 0, []
                    for k in range(g, g + n):
                        size, a_n, b_n = int(p.spans[k]), int(p.a_of[k]), int(p.b_of[k])
                        groups.append({"first": first, "end": first + size, "a_ids": p.a[i : i + a_n].tolist(), "b_ids": p.b[j : j + b_n].tolist()})
                        first, i, j = first + size, i + a_n, j + b_n
                    g += n
                    out.append(groups)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(out, arrow)], names=schema.names)

    return docs.select(key, text).mapInArrow(work, schema)
