"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, and what the operators return for them."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from vellum.llm import chat, decontam, langid, ledger, licenses, ordinal, substring, urls

DOCS = "doc_id long, text string, host string, score double, lang string"


def rows():
    r = random.Random(11)
    some = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60))
    mit = "Released under the MIT License."
    return [(1, f"{some} {mit}"), (1, f"{some} {mit}"), (2, None), (None, f"x {mit}"), (None, None), (3, ""), (4, " \n\t "), (5, "license the under released mit " * 20000), (6, f"{mit} {mit}"), (7, "é" * 50000)]


def table(spark, found=None):
    return spark.createDataFrame([(i, t, "clash", 0.5, "en" if t else None) for i, t in (rows() if found is None else found)], DOCS)


def test_licenses_of_odd_rows(spark):
    got = Counter((x.doc_id, x.first_word) for x in licenses.scan_licenses(table(spark)).collect() if x.license == "MIT" and x.doc_id != 5)
    assert got == {(1, 60): 2, (None, 1): 1, (6, 0): 1, (6, 5): 1}
    assert licenses.scan_licenses(table(spark, [])).count() == 0


def test_license_templates_from_a_table(spark):
    found = licenses.templates_from(spark.createDataFrame([("a", "free for any use at all"), ("a", "free for any use at all"), (None, "x"), ("b", None), ("c", " ..")], "name string, text string"))
    assert found == {"a": "free for any use at all"}
    got = licenses.scan_licenses(table(spark, [(1, "it is FREE for any use, at all")]), found).collect()
    assert [(x.license, x.coverage, x.first_word, x.end_word) for x in got] == [("a", 1.0, 2, 8)]
    with pytest.raises(ValueError):
        licenses.templates_from(spark.createDataFrame([("a", "x y"), ("a", "z w")], "name string, text string"))


def test_whole_license_texts_are_found(spark):
    whole = licenses.TEMPLATES["BSD-2-Clause-text"]
    words = whole.split()
    edited = " ".join(w if k % 17 else "changed" for k, w in enumerate(words))
    got = {(x.doc_id, x.license) for x in licenses.scan_licenses(table(spark, [(1, "Copyright 2020 X. " + whole), (2, edited), (3, " ".join(words[: len(words) // 3]))])).collect()}
    assert (1, "BSD-2-Clause-text") in got and (2, "BSD-2-Clause-text") in got and (3, "BSD-2-Clause-text") not in got


def found_by_force(text, items):
    """The items of which a local alignment scores enough."""
    a = re.findall("[a-z0-9]+", (text or "").lower())
    out = set()
    for i, item in items:
        b = re.findall("[a-z0-9]+", (item or "").lower())
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, *new)
        if len(b) >= decontam.SHORTEST and best >= 2 * min(0.6 * len(b), decontam.LONG):
            out.add(i)
    return out


def test_contamination_is_brute_force(spark):
    r = random.Random(21)
    text = lambda n: [f"{r.choice('abcdefgh')}{r.randrange(60)}" for _ in range(n)]
    items = [(i, text(r.choice([5, 20, 45, 70]))) for i in range(12)]
    docs = [(i, text(r.choice([5, 80, 200]))) for i in range(40)]
    for k in range(60):
        item = r.choice(items)[1]
        lo = r.randrange(len(item))
        piece = item if k % 2 else item[lo : lo + r.randrange(10, 50)]
        docs.append((100 + k, text(30) + [w if r.random() > 0.12 * (k % 3) else "z" for w in piece] + text(r.choice([0, 30]))))
    docs = [(i, " ".join(t)) for i, t in docs] + [(None, " ".join(items[3][1])), (300, None), (301, ""), (302, " ".join(text(20000) + items[2][1]))]
    items = [(i, " ".join(t)) for i, t in items] + [(50, None), (51, ""), (52, "yes"), (53, "a1 b2")]
    got = {x.doc_id: set(x.item_ids) for x in decontam.contaminated(decontam.find_contamination(table(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    want = {i: f for i, t in docs if (f := found_by_force(t, items))}
    dealt = decontam.find_contamination(table(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), most_bytes=700)
    carried = decontam.find_contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, dealt.collect())) == Counter(map(tuple, carried.collect()))
    # An edited copy that keeps no two seeds isn't aligned; an unedited one always does.
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert all(i in got for i in want if i is None or i < 100 or i >= 160 or (i - 100) % 3 == 0)
    assert all(got[i] <= want[i] for i in got) and sum(map(len, got.values())) >= 0.9 * sum(map(len, want.values()))


def test_each_passage_is_told(spark):
    r = random.Random(2)
    item = [f"w{r.randrange(900)}" for _ in range(30)]
    doc = ["x"] * 5 + item + ["y"] * 7 + item + item
    docs = [(1, " ".join(doc)), (1, " ".join(doc)), (2, None)]
    got = Counter((x.doc_id, x.first_word, x.end_word) for x in decontam.find_contamination(table(spark, docs), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect())
    assert got == {(1, 5, 35): 2, (1, 42, 72): 2, (1, 72, 102): 2}
    assert decontam.find_contamination(table(spark, []), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).count() == 0


def test_hosts_with_line_breaks_and_many_rules(spark):
    index = urls.RuleIndex(urls.RULES, {})
    assert index.judge("http://a\n.net/x") == ("a\n.net", "/x", "net/", "block")
    assert index.judge("http://a\n.example.net/en/\n")[2:] == ("example.net/en/", "allow")
    many = [urls.Rule("block" if i % 3 else "allow", f"h{i}.example{i % 50}.org", f"/p{i % 7}/") for i in range(100_000)]
    index = urls.RuleIndex(many, Counter(t for r in many for t in r.tokens))
    for i in random.Random(1).sample(range(100_000), 300):
        assert len(index.candidates(f"www.h{i}.example{i % 50}.org", f"/p{i % 7}/x")) <= 3
        assert index.judge(f"s://www.h{i}.example{i % 50}.org/p{i % 7}/x")[2:] == (many[i].name, many[i].verdict)
    assert len(index.compiled) <= 900


def test_url_rules_from_a_table(spark):
    kinds = [("prefix", "block", "Bad.com", None, None), ("prefix", "allow", "good.bad.com", "/ok/", ""), ("pattern", "block", None, r"/ads?/", "")] * 2
    rules, patterns = urls.rules_from(spark.createDataFrame(kinds, "kind string, verdict string, host string, path string, tokens string"))
    pages = spark.createDataFrame([(1, "http://x.bad.com/a", 1), (1, "http://x.bad.com/a", 1), (2, "s://good.bad.com/ok/ads/", 2), (3, "s://c.org/ad/1", 3), (4, None, 4)], "page_id long, url string, verdict int")
    got = Counter((x.page_id, x.rule, x.verdict) for x in urls.filter_urls(pages, rules, patterns).collect())
    assert got == {(1, "bad.com/", "block"): 2, (2, "good.bad.com/ok/", "allow"): 1, (3, None, "block"): 1, (4, None, "block"): 1}
    assert urls.filter_urls(pages.where("false"), rules, patterns).count() == 0
    with pytest.raises(ValueError):
        urls.rules_from(spark.createDataFrame([("prefix", "drop", "x", "/", "")], "kind string, verdict string, host string, path string, tokens string"))


def test_quality_of_odd_rows(spark):
    r = random.Random(3)
    word = lambda g: r.choice(["fine", "good"] if g == 2 else ["bad", "idiot"] if g == 0 else ["so", "soso"])
    found = [(i, " ".join(word(i % 3) for _ in range(12))) for i in range(300)]
    odd = [(None, "fine good"), (None, None), (400, ""), (401, "good " * 200000), *[(7, f"good fine {k}") for k in range(300)]]
    docs = table(spark, found + odd)
    rated = spark.createDataFrame([(i, i % 3) for i in range(200)] + [(None, 2), (7, 0), (5, 9), (401, None)], "doc_id long, grade int")
    model = ordinal.fit(docs, rated, "grade", 3, sample=100)
    got = ordinal.grade(docs, model, 3).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, _ in found + odd)
    held_out = [x for x in got if x.doc_id is not None and 200 <= x.doc_id < 300]
    assert all(x.selected == (x.doc_id % 3 == 2) for x in held_out) and all(0 <= x.p_tail <= 1 for x in got)
    assert ordinal.grade(table(spark, []), model, 3).count() == 0 and ordinal.fit(table(spark, []), rated, "grade", 3) is None
    assert all(x.selected and x.p_tail is None for x in ordinal.grade(docs, None, 3).collect())
    # The score is the sum of the weights of the distinct tokens, each threshold a sigmoid of the difference.
    doc, f = ordinal.features([b"good fine good"])
    s = float(model.weights[f].sum())
    assert np.allclose(model.above([b"good fine good"])[0], 1 / (1 + np.exp(model.thresholds - s)), atol=1e-5)


def test_ordinal_steps_follow_the_likelihood():
    r = np.random.default_rng(0)
    rows_ = [np.unique(r.integers(0, 40, 6)) for _ in range(400)]
    true = r.normal(size=40)
    grades = np.digitize([true[f].sum() for f in rows_], [-1.5, 1.5])
    model = ordinal.fit_rows(rows_, grades, 3, z=0.0)
    score = np.array([model.weights[f].sum() for f in rows_])
    below = 1 / (1 + np.exp(-(model.thresholds[None, :] - score[:, None])))
    p = np.diff(np.concatenate((np.zeros((400, 1)), below, np.ones((400, 1))), axis=1), axis=1)
    assert (p.argmax(axis=1) == grades).mean() > 0.9 and model.thresholds[0] < model.thresholds[1]


def test_tokens_that_tell_nothing_get_no_weight():
    r = np.random.default_rng(1)
    grades = np.arange(600) % 3
    rows_ = [np.unique(np.concatenate((r.integers(100, 400, 30), [g]))) for g in grades]
    used = np.flatnonzero(ordinal.telling(rows_, grades, 3))
    assert set(range(3)) <= set(used.tolist()) and len(used) < 10
    model = ordinal.fit_rows(rows_, grades, 3)
    assert model.weights[2] > model.weights[1] > model.weights[0] and np.count_nonzero(model.weights) == len(used)


def test_language_counts_are_brute_force(spark):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcé ") for _ in range(5)) for _ in range(8)) for _ in range(50)] + ["", "12", "a" * 3000]
    df, n = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4))
    want = Counter()
    for t in texts:
        want.update(set(langid.features([t.encode()])[0].tolist()))
    assert n == len(texts) and {i: c for i, c in enumerate(df.tolist()) if c} == dict(want)


def test_language_of_odd_rows(spark):
    r = random.Random(2)
    found = [(i if i % 5 else None, " ".join("".join(r.choice("abcde" if i % 2 else "vwxyz") for _ in range(5)) for _ in range(20)), "xx" if i % 2 else "yy") for i in range(300)]
    odd = [(900, None, "xx"), (900, "..", "yy"), (901, "abc " * 200000, None), *[(902, "abcde edcba abcab", "xx")] * 500, (None, "vwxyz vvxxyyzz", None)]
    docs = spark.createDataFrame([(i, t, l, "clash") for i, t, l in found + odd], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs, sample=60)
    got = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert Counter(x.doc_id for x in got) == Counter(i for i, *_ in found + odd) and all(0 <= x.score <= 1 for x in got)
    assert {x.lang_pred for x in got if x.doc_id == 900} == {"und"} and {x.lang_pred for x in got if x.doc_id in (901, 902)} == {"xx"}
    assert langid.identify(docs.where("false").select("doc_id", "text"), model, ["doc_id"]).count() == 0


def test_held_out_languages_are_named(spark):
    from vellum.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    got = QUERIES["op6_language_id"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL").collect()
    assert len(got) > 200 and sum(x.lang_pred == x.lang for x in got) >= 0.98 * len(got)


def turns(df):
    return {x.conv_id: None if x.turns is None else [(t.role, t.text) for t in x.turns] for x in df.collect()}


def test_layouts_mixed_row_by_row(spark):
    schema = "conv_id long, meta string, system string, prompt string, response string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, turns int"
    found = [
        (1, "m1", None, "q", "a", None, None, None, None, 0),
        (2, "m2", "s", "q", "a", None, None, None, None, 0),
        (3, None, None, None, None, "do", "it", "done", None, 0),
        (4, "m4", None, None, None, None, None, None, [("human", "q"), ("bot", None), (None, "x")], 0),
        (5, "m5", None, "only", None, None, None, None, None, 0),
        (6, "m6", None, None, None, None, None, None, None, 0),
        (7, "m7", None, None, None, "do", None, "done", None, 0),
        (8, "m8", None, None, None, None, None, None, [], 0),
    ]
    got = chat.to_turns(spark.createDataFrame(found, schema))
    assert got.columns == ["conv_id", "turns", "meta"]
    assert turns(got) == {1: [("user", "q"), ("assistant", "a")], 2: [("system", "s"), ("user", "q"), ("assistant", "a")], 3: [("user", "do\n\nit"), ("assistant", "done")], 4: [("user", "q"), ("assistant", ""), ("", "x")], 5: [("user", "only"), ("assistant", "")], 6: None, 7: [("user", "do"), ("assistant", "done")], 8: []}
    out = {x.conv_id: x for x in chat.render(got).collect()}
    assert out[1].meta == "m1" and out[6].formatted == out[8].formatted == chat.BEGIN + chat.FINISH
    assert chat.render(got.where("false")).count() == 0


def test_rows_by_turn_of_odd_shapes(spark):
    long = "x [INST] </s> \\ " * 50000
    found = [(1, 0, "user", "q", "m"), (1, 1, "assistant", long, "m"), (1, 1, "assistant", long, "m"), (2, None, None, None, None), (None, 0, "assistant", "a", "m"), (None, 0, "user", "b", "m")]
    df = spark.createDataFrame(found, "conv_id long, turn long, role string, text string, meta string").repartition(3)
    got = {x.conv_id: x for x in chat.read_back(chat.render(chat.to_turns(df))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest() and got[1].loss_chars == 2 * len(long)
    assert (got[2].n_turns, got[2].loss_chars, got[None].n_turns, got[None].loss_chars) == (1, 0, 2, 1)
    assert chat.to_turns(df.where("false")).count() == 0


def test_ledger_of_odd_rows(spark):
    found = [(1, "#a *b $c %d &e |f <g >h"), (1, "#a *b $c %d &e |f <g >h"), (None, "SHOUTING LOUD WORDS HERE " * 6), (2, None), (3, "ok " * 300000), (4, "Aé bß")]
    docs = table(spark, found).withColumnRenamed("score", "n_words")
    entries = ledger.stored(ledger.ledger(docs))
    got = {x.doc_id: x for x in ledger.apply_policy(entries).collect()}
    assert entries.count() == len(found) and got[1].n_symbols == 8 and got[1].word_chars == 16
    assert (got[None].n_upper, got[None].n_letters, got[None].kept) == (126, 126, False) and got[None].fail_bits & 64
    assert got[2].fail_bits == 1 and got[3].n_words == got[3].n_repeat_words == 300000 and got[4].word_chars == 4 and got[4].n_letters == 2
    plain = [x for x, in ledger.ledger(docs).select("fail_bits").collect()]
    table_ = {x.rule: x for x in ledger.ablation(entries).collect()}
    m = ledger.mask("v1")
    for i, (name, _) in enumerate(ledger.rules()):
        if m >> i & 1:
            assert table_[name].failed == sum(b >> i & 1 for b in plain) and table_[name].only_this == sum(b & m == 1 << i for b in plain)
            assert table_[name].kept_without == sum(b & m & ~(1 << i) == 0 for b in plain)
    assert ledger.ablation(ledger.ledger(docs.where("false"))).count() == 0


def test_positions_come_from_the_automaton(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = table(spark, [(1, "a b " + passage), (2, passage + " c"), (3, None)])
    r = random.Random(5)
    words = np.array([r.getrandbits(32) for _ in range(300)], np.uint32)
    text = np.array([r.choice(words) for _ in range(4000)], np.uint32)
    phrases = np.unique(np.stack([text[i : i + 4] for i in r.sample(range(3990), 200)]), axis=0)
    wanted = {tuple(p) for p in phrases.tolist()}
    assert sorted(substring.Automaton(phrases).hits(text).tolist()) == [i for i in range(3997) if tuple(text[i : i + 4].tolist()) in wanted]
    assert {x.doc_id: x.n_removed for x in substring.substring_dedup(docs).collect()} == {1: 0, 2: 40, 3: 0}
