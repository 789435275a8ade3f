"""scan_licenses against an alignment at every position."""

import random

import pytest

from vellum.llm import licenses
from vellum.llm.kit import Tokens


def by_force(text, templates, coverage=0.8):
    found = set()
    h = Tokens([(text or "").encode()]).h.tolist()
    for name, t in templates.items():
        w = Tokens([t.encode()]).h.tolist()
        for at in range(len(h)):
            if len(licenses.patience(w, h[at : at + len(w) + len(w) // 4 + 2])) >= coverage * len(w):
                found.add(name)
    return found


def edited(r, words, drops, adds):
    words = list(words)
    for _ in range(drops):
        words.pop(0 if r.random() < 0.4 else r.randrange(len(words)))
    for _ in range(adds):
        words.insert(r.randrange(len(words) + 1), r.choice(["the", "x", "under", "license", "foo"]))
    return words


@pytest.mark.parametrize("text,name", [("Licensed under the MIT License.", "MIT"), ("Distributed under CC BY 4.0", "CC-BY-4.0"), ("Available under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("released a under b the c mit", "MIT")])
def test_a_notice_with_another_opening(spark, text, name):
    docs = spark.createDataFrame([(1, f"some words {text} and more")], "doc_id long, text string")
    assert name in {r.license for r in licenses.scan_licenses(docs).collect()}


def test_scan_is_brute_force(spark):
    r = random.Random(12)
    templates = {n: t for n, t in licenses.TEMPLATES.items()} | {f"t{n}": " ".join(f"v{n}x{i % 9}" for i in range(n)) for n in (1, 2, 7, 11, 15, 26, 27, 33)}
    rows = [(0, None), (1, ""), (2, "the license under the license")]
    for i in range(3, 260):
        w = r.choice(list(templates.values())).split()
        most = max(1, len(w) // 5 + 1)
        text = edited(r, w, r.randrange(min(most + 1, len(w))), r.randrange(most + 2))
        rows.append((i, " ".join(["pad"] * r.randrange(4) + text + ["end"] * r.randrange(4))))
    got = {i: set() for i, _ in rows}
    for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), templates).collect():
        got[x.doc_id].add(x.license)
        assert x.coverage >= 0.8 and 0 <= x.first_word < x.end_word
    assert got == {i: by_force(t, templates) for i, t in rows}
