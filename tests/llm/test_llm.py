import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import chat, decontam, jaccard, kit, langid, ledger, licenses, mixing, ordinal, substring, urls
from vellum.llm.oracles import ORACLES
from vellum.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def words(t):
    return (t or "").encode().split()


def corpus(seed=1, n=60):
    """Copies, near copies, shared passages, nulls, empty, short and very long texts, repeated rows."""
    r = random.Random(seed)

    def text(k):
        return " ".join(r.choice("ab bc cd de ef fg gh hi ij jk kl lm mn é ß".split()) + str(r.randrange(40)) for _ in range(k))

    passage, rows = text(60), []
    for i in range(n):
        t = text(r.choice([3, 12, 13, 40, 200]))
        if i % 6 == 1:
            t = rows[-1][1]
        if i % 6 == 2:
            w = rows[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            t = "\t".join(w)
        if i % 7 == 0:
            t = f"{text(5)}\n{passage}  {text(4)}"
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, text(30000)), (n + 4, passage + " " + passage), (5, rows[5][1]), (None, rows[3][1]), (None, None)]
    return [(i, t, ["en", "de", None][(i or 0) % 3], ["s1", "s2", None][(i or 0) % 3], len(t or ""), "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


def removed_by_force(rows, k):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            if i is not None:
                g = tuple(w[j : j + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return Counter(out)


@pytest.mark.parametrize("k,phrase", [(13, 8), (5, 5), (25, 16)])
def test_substring_dedup_is_brute_force(docs, k, phrase):
    got = substring.substring_dedup(docs, window=k, phrase=phrase, shards=5)
    assert "lang" in got.columns and got.columns.count("n_words") == 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == removed_by_force(corpus(), k)


def test_substring_dedup_of_nothing(spark):
    assert substring.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def shingles(t, k):
    w = [x.lower() for x in words(t)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_force(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    up = {i: i for i, _ in sets if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("k,percent,block,pivots", [(4, 85, 2048, 64), (5, 80, 3, 64), (4, 85, 3, 1), (5, 80, 2, 0)])
def test_jaccard_components_are_brute_force(docs, monkeypatch, k, percent, block, pivots):
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    got = jaccard.jaccard_components(docs, size=k, percent=percent, block=block)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components_by_force(corpus(), k, percent)


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_prefix_tree_links_what_brute_force_links():
    r = random.Random(4)
    base = [r.sample(range(400), 60) for _ in range(4)]
    sets = [np.unique(np.array(r.choice(base)[: r.choice([50, 57, 60])] + r.sample(range(400), r.randrange(9)), np.uint64)) for _ in range(120)]

    def groups(links):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in links:
            up[find(a)] = find(b)
        return {frozenset(i for i in range(len(sets)) if find(i) == find(j)) for j in range(len(sets))}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    roots = jaccard.tree_components([len(s) for s in sets], sets, 85)
    assert groups(enumerate(roots)) == groups(every)


def test_linked_sets_share_a_prefix_shingle():
    r = random.Random(8)
    for n in [1, 2, 3, 5, 9, 20, 77, 400]:
        for _ in range(30):
            a = [r.getrandbits(63) for _ in range(n)]
            b = a[r.randrange(n // 4 + 1) :] + [r.getrandbits(63) for _ in range(r.randrange(n // 8 + 1))]
            if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)):
                x, y = (set(sorted(s)[: jaccard.prefix_length(len(s), 80)]) for s in (a, b))
                assert x & y


def test_repeated_ids_hold_their_sets_together(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, b), (7, c), (7, None), (8, c), (9, ""), (None, a), (11, None), (11, "")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(3, 3), (5, 3), (9, 3), (7, 7), (8, 7), (None, None), (11, 11)}
    assert got.count() == len(rows)


def test_word_scanner_is_the_pattern():
    import re

    texts = ["a  b\u00a0c\td", "", "\x1cx\x0by \r\n z", "ü ß\u2003q"]
    w = kit.Words([t.encode() for t in texts])
    assert w.count.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_ledger_measures_by_force(spark, docs):
    got = {(r.doc_id, r.text): r for r in ledger.apply_policy(ledger.ledger(docs)).collect()}
    for i, t, *_ in corpus():
        w = words(t)
        g = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        n, hit = Counter(g), set()
        for j, x in enumerate(g):
            if n[x] > 1:
                hit.update(range(j, j + 8))
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += line in seen and bool(words(line))
            seen.add(line)
        r = got[(i, t)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), dup, len(hit))
        assert bool(r.fail_bits & 1) == (len(w) < 20) and bool(r.fail_bits & 2) == (100 * len(hit) > 30 * len(w))


def test_ablation_counts(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (3,), (4,)], "fail_bits long")
    got = {r.rule: (r.failed, r.only_this, r.kept_without) for r in ledger.ablation(rows, ("few_words", "repeated_windows", "symbols")).collect()}
    assert got == {"few_words": (3, 1, 2), "repeated_windows": (2, 0, 1), "symbols": (1, 1, 2)}


def test_mix_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), None, ["a", "b", "c", None, "tiny"][0 if i % 3 else i % 5], 0, "") for i in range(3000)] + [(None, None, None, "a", 0, "")]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size >= 0
    want, free, left = {}, sorted(size, key=lambda s: (s is None, s)), sum(size.values())
    weight = {s: 1 + k % 3 for k, s in enumerate(free)}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
            free.remove(s)
    want |= share
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 9
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_urls_of_odd_shapes(spark):
    index = urls.RuleIndex(urls.RULES, {})
    for url in [None, "", "x", "http://", "HTTP://A.EXAMPLE.net/EN/x", "http://example.net/en/?a#b", "s://a.example.com/de/x", "http://notexample.net", "http://net", "http://x.org/fr/é", "http://org?/fr/"]:
        host, path, rule, verdict = index.judge(url)
        fits = [r for r in urls.RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert rule == (best.name if best else None) and verdict == (best.verdict if best else "allow" if host else "block")
    pages = spark.createDataFrame([(1, "http://spam-farm.example.org/en/", "x"), (2, None, None)], "page_id long, url string, host string")
    assert [(r.host, r.verdict) for r in urls.filter_urls(pages).orderBy("page_id").collect()] == [("spam-farm.example.org", "block"), ("", "block")]


@given(st.lists(st.tuples(st.text("us<|>[]/INST\\\n"), st.text("<|>s/[]INST\\:\nendturn é")), max_size=5))
@settings(deadline=None, max_examples=300)
def test_chat_round_trip(turns):
    rows = [{"role": r, "text": t} for r, t in turns]
    formatted, _ = chat.write_chat(rows)
    assert chat.parse_chat(formatted) == turns
    body = formatted[len(chat.BEGIN) : -len(chat.FINISH)]
    assert "</s>" not in body and "[INST]" not in body and body.count(chat.END) == len(turns)


def test_chat_layouts(spark):
    def turns(schema, *row):
        return [(t.role, t.text) for t in chat.to_turns(spark.createDataFrame([row], schema)).first().turns]

    assert turns("conv_id long, prompt string, response string", 1, "q", None) == [("user", "q"), ("assistant", "")]
    assert turns("conv_id long, instruction string, input string, output string", 1, "q", "x", "a") == [("user", "q\n\nx"), ("assistant", "a")]
    assert turns("conv_id long, conversations array<struct<from:string,value:string>>", 1, [("human", "q"), ("gpt", "a")]) == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        turns("conv_id long, other string", 1, "q")
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, None, None, "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.to_turns(rows))).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0 and got[None].turns_sha256 == hashlib.sha256(b"user\ny\n").hexdigest()


def test_language_id_learns_and_says_und(spark):
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcde" if i % 2 else "vwxyz") for _ in range(5)) for _ in range(20)), "xx" if i % 2 else "yy") for i in range(200)]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "12 !?", "xx"), (902, "abcab", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs.where("doc_id < 100 or doc_id > 899")), ["doc_id"]).collect()}
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") for i in range(100, 200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx" and got[900].score == 0
    assert langid.fit(docs.where("false")) is None
    assert {r.lang_pred for r in langid.identify(docs, None, ["doc_id"]).collect()} == {"und"}


def test_ordinal_grades_rise(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["fine", "good", "x"] if i % 3 == 2 else ["bad", "idiot", "x"] if i % 3 == 0 else ["so", "so-so", "x"]) for _ in range(15)), i % 3) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, None)], "doc_id long, text string")
    rated = spark.createDataFrame([(i, g) for i, _, g in rows if i < 400], "doc_id long, grade int")
    model = ordinal.fit(docs, rated, "grade", 3)
    assert model.thresholds[0] < model.thresholds[1]
    got = {x.doc_id: x for x in ordinal.grade(docs, model, 3).collect()}
    assert all(got[i].selected == (i % 3 == 2) and abs(got[i].expected_grade - i % 3) < 0.5 for i in range(400, 600)) and 999 in got
    assert ordinal.fit(docs, rated.where("false"), "grade", 3) is None


def test_patience_and_licenses(spark):
    assert licenses.patience(list("axbyc"), list("abzc")) == [(0, 0), (2, 1), (4, 3)]
    docs = spark.createDataFrame([(1, "x y. Released  under\nthe MIT license. z"), (2, None), (3, "nothing"), (4, "licensed UNDER the apache license version 2.0 " * 2)], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.coverage) for r in licenses.scan_licenses(docs).collect())
    assert (1, "MIT", 1.0) in got and sum(r[:2] == (4, "Apache-2.0") for r in got) == 2 and not any(r[0] in (2, 3) for r in got)


def test_contamination_finds_edited_copies(spark):
    r = random.Random(6)
    item = [f"w{r.randrange(900)}" for _ in range(40)]
    edited = [x if k % 7 else "other" for k, x in enumerate(item)]
    clean = [(i, " ".join(f"w{r.randrange(900)}" for _ in range(150))) for i in range(50)]
    docs = spark.createDataFrame(clean + [(100, "a b " + " ".join(item) + " c"), (101, " ".join(edited).upper()), (102, None), (103, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    got = {x.doc_id: x for x in decontam.contaminated(decontam.find_contamination(docs, bench)).collect()}
    assert set(got) == {100, 101} and got[100].score == 1.0 and got[101].item_id == 7
    assert decontam.find_contamination(docs, bench.where("false")).count() == 0


def test_smith_waterman_by_force():
    r = random.Random(9)
    for _ in range(20):
        a, b = [np.array([r.randrange(4) for _ in range(r.randrange(1, 15))]) for _ in range(2)]
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.smith_waterman(a, b)[0] == h.max()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "el", "or", "us", "im")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item, passage, one = text(40), text(60), text(100)
    rows = [(i, text(120)) for i in range(30)] + [(30, one), (31, one), (32, one + " more"), (33, text(50) + " " + passage), (34, text(50) + " " + passage), (35, text(60) + " " + item), (36, "short"), (37, None)]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(35)) - {31, 32} and got[34]["size"] == 50 and got[33]["size"] == 110


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = QUERIES[name](spark, d)
    want = con.sql(ORACLES[name])
    cols = want.columns
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(want.fetchall())
