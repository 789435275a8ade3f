"""The pipeline against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from test_llm import removed_by_force, shingles, words

import corpus_pipeline
from vellum.llm import mixing

VOCABULARY = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("an", "el", "or", "us", "im")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def measures(t):
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
    return len(w), len(hit), dup


def kept_by_rules(t):
    n, repeated, _ = measures(t)
    chars = sum(len(x.decode()) for x in words(t))
    letters = re.findall("[A-Za-z]", t or "")
    capitals = len(letters) >= 20 and 2 * sum(x.isupper() for x in letters) > len(letters)
    return not (n < 20 or 100 * repeated > 30 * n or 10 * len(re.findall(r"[#*$%&|<>]", t or "")) > 3 * n or chars < 2 * n or chars > 20 * n or capitals)


def one_of_each_group(rows):
    sets = [shingles(r[1], 5) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def leaks(t, items):
    """Whether a local alignment of the text scores enough of an item."""
    a = re.findall("[a-z0-9]+", (t or "").lower())
    for item in items:
        b = re.findall("[a-z0-9]+", item.lower())
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
            row, best = new, max(best, *new)
        if b and best >= 2 * min(0.6 * len(b), 20):
            return True
    return False


def fixture(r):
    def text(n):
        return [r.choice(VOCABULARY) + str(r.randrange(9)) for _ in range(n)]

    item, passage, one, two = text(40), text(60), text(100), text(90)
    edited = [x if k % 8 else "other" for k, x in enumerate(item)]
    rows = [(i, text(r.randrange(20, 140))) for i in range(40)]
    rows += [(40, one), (41, one), (42, [*one, "more"]), (43, text(50) + passage), (44, text(50) + passage), (45, text(60) + item), (46, text(30) + edited + text(30)), (47, ["short"])]
    rows += [(None, text(70)), (None, text(80)), (None, two), (None, two[:-1]), (None, [*one, "null"]), (None, text(40) + item), (50, two), (51, text(60)), (51, text(60))]
    again = text(75)
    rows += [(60, again), (60, again), (60, again), (61, passage), (62, ["SHOUT"] * 5 + [x.upper() for x in text(40)]), (63, text(8) * 9)]
    texts = [(i, " ".join(t)) for i, t in rows] + [(70, None), (None, None), (71, ""), (72, "\n".join([*(" ".join(text(9)) for _ in range(8)), *["the same line"] * 4]))]
    return [(i, t, "en", [None, "s0", "s1", "s2"][k % 4], len(t or "")) for k, (i, t) in enumerate(texts)], " ".join(item)


def put(spark, folder, rows, item):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_near_copies_are_told_by_row(spark, tmp_path):
    rows, _ = fixture(random.Random(7))
    got = Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect())
    assert got == Counter(one_of_each_group(rows))
    assert sum(n for r, n in got.items() if r[0] is None) == 4 and sum(n for r, n in got.items() if r[0] == 60) == 1 and sum(n for r, n in got.items() if r[0] == 51) == 2


def test_leaks_go_by_row(spark, tmp_path):
    rows, item = fixture(random.Random(7))
    rows.append((51, "x " + item, "en", "s0", 9))
    put(spark, tmp_path, rows, item)
    got = Counter(tuple(r) for r in corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect())
    assert got == Counter(r for r in rows if not leaks(r[1], [item]))


def mixed_by_force(rows):
    """(doc_id, source, size, source_size, target, times, taken) of rows (id, text, source, quality)."""
    size = Counter()
    for _, t, s, _ in rows:
        size[s] += len(words(t))
    free = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: 1 + k % 3 for k, s in enumerate(free)}, sum(size.values()), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in size:
        epochs = int(target[s] / size[s] + 1e-12) if size[s] else 0
        budget, upto, mine = target[s] - epochs * size[s], 0, []
        alike = Counter()
        for i, t, source, q in rows:
            if source == s:
                draw = f"{'' if i is None else i}{'' if s is None else '=' + s}:{hashlib.md5((t or '').encode()).hexdigest()}"
                alike[draw] += 1
                u = (int(hashlib.md5(f"mix:{draw}:{alike[draw]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                mine.append((not q > 0, -math.log(u) / (q if q > 0 else 1), draw, alike[draw], i, len(words(t))))
        for *_, i, n in sorted(mine):
            upto += n
            times = min(3, epochs + (budget > 0 and upto - n / 2 <= budget))
            out.append((i, s, n, size[s], round(target[s], 6), times, n * times))
    return Counter(out)


def quality(t):
    n, repeated, dup = measures(t)
    return (1 + n - repeated) / ((1 + n) * (1 + dup))


def columns(rows):
    return Counter((r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.times, r.taken) for r in rows)


def test_poor_documents_are_taken_less(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(1, 9)), ["a", "b", None][i % 3], [1.0, 0.02, 1e-4, 8.0][i // 3 % 4]) for i in range(1200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), quality="q").collect()
    assert columns(got) == mixed_by_force(rows)
    more = Counter()
    for x in got:
        more[rows[x.doc_id][3]] += x.times - x.epochs
    assert more[8.0] >= more[1.0] > more[0.02] >= more[1e-4]


def test_repeated_and_null_ids_come_near_the_target(spark):
    rows = [(7, "one two three", "a", 1.0)] * 500 + [(None, f"x{i % 50} y", "b", [1.0, 0.0, None, float("nan")][i % 4]) for i in range(400)] + [(i, "q " * 30, None, -1.0 if i % 2 else 2.0) for i in range(200)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, q double").repartition(5), quality="q", seed="mix").collect()
    assert columns(got) == mixed_by_force([(i, t, s, q if q is not None and q == q else 0) for i, t, s, q in rows])
    for s in ("a", "b", None):
        assert abs(sum(x.taken for x in got if x.source == s) - next(x.target for x in got if x.source == s)) <= 30


def test_many_sources_share_without_a_window_over_all(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 700:04}", 1.0) for i in range(2100)]
    assert columns(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), quality="q").collect()) == mixed_by_force(rows)


def test_mix_of_the_pipeline_prefers_quality(spark):
    rows, _ = fixture(random.Random(7))
    good = [(200 + i, " ".join(r.choice(VOCABULARY) for _ in range(60))) for i, r in enumerate(map(random.Random, range(40)))]
    lines = [(300 + i, t + "\nthe same line" * 9) for i, t in good]
    rows = [x for x in rows if x[1]] + [(i, t, "en", "s1", len(t)) for i, t in good + lines]
    got = corpus_pipeline.source_mix(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert columns(got) == mixed_by_force([(i, t, s, quality(t)) for i, t, _, s, _ in rows])


def test_run_is_brute_force(spark, tmp_path):
    rows, item = fixture(random.Random(7))
    put(spark, tmp_path, rows, item)
    left = one_of_each_group([r for r in rows if kept_by_rules(r[1])])
    cut = []
    for i, t, _, s, _ in left:
        if i is None:
            cut.append((i, t, s))
            continue
        earlier = [(j, x) for j, x, *_ in left if j is not None and j < i]
        ((_, n, gone, text),) = (k for k in removed_by_force([*earlier, (i, t)], 25) if k[0] == i)
        if gone < n or n == 0:
            cut.append((i, text if gone else t, s))
    want = mixed_by_force([(i, t, s, quality(t)) for i, t, s in cut if not leaks(t, [item])])
    assert columns(corpus_pipeline.run(spark, str(tmp_path)).collect()) == want
