"""Two tokenizers side by side, against offsets and dictionaries in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from vellum.llm import alignment, queries


@pytest.fixture(scope="module")
def two():
    """Encoders to (id, bytes) by the files' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.BYTE_FILE}")
    one.encode_special_tokens = True
    # The byte-level alphabet, by its definition: printable bytes stand for themselves, the others follow from 256 on.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    spelt = {i: bytes(letters[c] for c in t) for t, i in one.get_vocab(False).items() if all(c in letters for c in t)}
    model = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.PIECE_FILE}")

    def piece(i):
        p = model.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if model.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: [(i, spelt[i]) for i in one.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in model.encode(t)]


def by_force(docs, two):
    """The contract's rows: every pair of tokens of a document is tried for overlap."""
    count, held = Counter(), []
    for doc_id, t in docs:
        a, b = (f(t) for f in two) if t else ([], [])
        want = b" " + (t or "").encode()
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            held.append((doc_id, [], [], [], []))
            continue
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, lo = [], 0
        for i, s, e in spans[0]:
            while spans[1][lo][2] <= s:
                lo += 1
            for j, s2, e2 in spans[1][lo:]:
                if s2 >= e:
                    break
                links.append((i, j))
        count.update(links)
        both = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        groups, lo = [], 0
        for e in sorted(both):
            groups.append(([i for i, _, x in spans[0] if lo < x <= e], [j for j, _, x in spans[1] if lo < x <= e]))
            lo = e
        held.append((doc_id, spans[0], spans[1], groups, links))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for doc_id, a, b, groups, links in held:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out, count


def texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij éüñß'0189") for _ in range(r.randrange(1, 9)))
    found = [(i, " ".join(word() for _ in range(r.randrange(1, 30)))) for i in range(120)]
    odd = ["", None, " ", "  two  spaces ", "\n\n\tx\r\n", "<|endoftext|> </s> <s> <unk> <0x41>", "▁under▁", "a▁b", "日本語のテキスト", "😀👍🏽 ok", "é ﬁ ½ ①", "\u0085  ", "it's they'll we've", "\x00\x01", "ก็ مرحبا שלום", "a" * 3000, "$$$ ### %%%", "﻿x", "ǅ ʰ ɐ"]
    return found + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "no id"), (None, None), (5, "the same"), (5, "the same")]


def test_query_is_brute_force(spark, tmp_path, two):
    spark.createDataFrame([(i, t, 7, "x") for i, t in texts()], "doc_id long, text string, n_a int, _shard string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_token_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, count = by_force(texts(), two)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    pairs = alignment.pair_counts(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert {(x.a_id, x.b_id): x.n for x in pairs} == count
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_token_alignment(spark, f"{tmp_path}/none").count() == 0


def test_query_is_brute_force_on_given_documents(spark, two):
    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = by_force(docs, two)[0]
    assert Counter(map(tuple, queries.op11_token_alignment(spark, "/root/testdata/sf0.001").collect())) == Counter(want)


def test_groups_cover_the_text(spark):
    docs = spark.createDataFrame([x for x in texts() if x[0] is not None], "doc_id long, text string")
    for (_, groups), (_, t) in zip(sorted(map(tuple, alignment.token_groups(docs.coalesce(1)).collect()), key=lambda x: x[0]), sorted((x for x in texts() if x[0] is not None), key=lambda x: x[0]), strict=True):
        if groups:
            assert groups[0].first == 0 and groups[-1].end == len(t.encode()) + 1
            assert all(x.end == y.first for x, y in zip(groups, groups[1:], strict=False)) and all(g.a_ids and g.b_ids for g in groups)


def test_quick_merging_is_the_library_of_the_file():
    """Every character that the quick way takes, in several neighbourhoods."""
    one = alignment.ByteTokenizer(alignment._files(alignment.FOLDER)[0])
    assert one.quick is not None
    plain = [c for c in map(chr, range(0x250)) if alignment._PLAIN.fullmatch(c)]
    assert len(plain) == 3 + 95 + 0x250 - 0xA0
    said = [f for c in plain for f in (c, f" {c}", f"a{c}b", f"1{c} {c}2", f"{c}{c}{c}", f"  {c}\n{c} ", f"'{c}s{c}", f"é{c}É")]
    r = random.Random(9)
    said += ["".join(r.choice(plain) for _ in range(r.randrange(1, 60))) for _ in range(20000)]
    assert one.encode(said) == [x.ids for x in one.whole.encode_batch_fast(said, add_special_tokens=False)]
