import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import arrays, images, metrics
from vellum.functions import text as X
from vellum.operators import relational, windows
from vellum.plans import stages
from vellum.plans.oracles import ORACLES
from vellum.plans.queries import QUERIES
from vellum.sources import files
from vellum.sources.snapshots import SnapshotTable
from vellum.streaming import live

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, DATA), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = Counter(tuple(norm(r[c]) for c in rel.columns) for r in df.collect())
    assert got == Counter(tuple(norm(v) for v in r) for r in rel.fetchall())


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "c string").select(f(F.col("c")).alias("v")).first().v


@pytest.mark.parametrize(
    "f,text,want",
    [
        (X.canonical, "a \\\\\nb", "a\\b"),
        (X.canonical, "a\\\\b \\dfrac{x}{y}", "ab\\frac{x}{y}"),
        (X.normalize, " a\u00a0 b\n", "a b"),
        (X.strip_reasoning, "x<think>y", "y"),
        (X.clean_response, "s ```tex\n\\documentclass{a} x \\end{document} t\n``` e", "\\documentclass{a} x \\end{document}"),
        (X.clean_response, None, ""),
        (X.yes_no, "<think>NO</think> yes it is", "YES"),
        (X.model_label, "out/run7/final", "run7"),
        (X.finish_document, "# T\nx", X.PREAMBLE + "T\nx" + X.POSTAMBLE),
        (X.to_document, "pre<|det|>header [1]<|/det|>H<|det|>text [2]<|/det|>5 of 20\nbody", X.PREAMBLE + "body" + X.POSTAMBLE),
        (X.looks_truncated, "$a$ \\\\[2mm] b", False),
        (lambda c: X.looks_truncated(c, 1), "$a$ \\\\[2mm] b", True),
        (X.auto_fix, "```\n\\cancel{x} \u2460\u2212\n```", "\\documentclass{article}\n\\usepackage{amsmath}\n\\usepackage{amssymb}\n\\usepackage{amsfonts}\n\\usepackage{cancel}\n\n\\begin{document}\n\n\\cancel{x} (1)-\n\n\\end{document}\n"),
    ],
)
def test_text_functions(spark, f, text, want):
    assert one(spark, f, text) == want


def grams(x, n):
    return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))


def bleu_by_force(ref, hyp, variant):
    if not ref or not hyp:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        shared, of_hyp = (grams(hyp, n) & grams(ref, n)).total(), grams(hyp, n).total()
        total += np.log((shared + 1e-9) / (of_hyp + 1e-9)) if variant == 1 else np.log((shared + 1e-4) / (max(1, of_hyp) + 1e-4))
    return min(1.0, np.exp(1 - len(ref) / len(hyp))) * np.exp(total / 4)


def table_by_force(a, b, edit):
    """Edit distance or longest common subsequence by the whole table."""
    row = list(range(len(b) + 1)) if edit else [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i if edit else 0]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)) if edit else row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_sequence_metrics_are_brute_force():
    r = random.Random(3)
    pairs = [([r.choice("abcd") for _ in range(r.randrange(40))], [r.choice("abcd") for _ in range(r.randrange(40))]) for _ in range(150)]
    pairs += [(a, a) for a, _ in pairs[:10]] + [([], []), (["x"], ["x"]), ([], ["x"]), ("a a b".split(), "a b b".split())]
    refs, hyps = [a for a, _ in pairs], [b for _, b in pairs]
    x, y = metrics._coded(refs, hyps)
    assert metrics.bleu(x, y) == pytest.approx([bleu_by_force(a, b, 1) for a, b in pairs])
    assert metrics.bleu(x, y, 2) == pytest.approx([bleu_by_force(a, b, 2) for a, b in pairs])
    shared = [(Counter(a) & Counter(b)).total() for a, b in pairs]
    assert metrics.bag_f1(x, y) == pytest.approx([2 * s / (len(a) + len(b)) if s else 0.0 for s, (a, b) in zip(shared, pairs)])
    for a, b in pairs:
        assert metrics.edit_distance(a, b) == table_by_force(a, b, True) and metrics.lcs_length(a, b) == table_by_force(a, b, False)
    assert metrics.edit_distance("kitten", "sitting") == 3 and metrics.lcs_length("abcbdab", "bdcaba") == 4
    texts = [("".join(a), " ".join(b)) for a, b in pairs] + [(" é\U0001f600b ", "é\U0001f600")]
    want = []
    for a, b in texts:
        p = [((grams(a.strip(), n) & grams(b.strip(), n)).total(), len(b.strip()) - n + 1, len(a.strip()) - n + 1) for n in range(1, 7)]
        p = [(s / h, s / q) for s, h, q in p if h > 0 and q > 0]
        u, v = (np.mean([z[k] for z in p]) if p else 0.0 for k in (0, 1))
        want.append(5 * u * v / (4 * u + v) if u + v else 0.0)
    assert metrics.chrf([a for a, _ in texts], [b for _, b in texts]) == pytest.approx(want)


def test_sequence_functions_in_sql(spark):
    stages.register_functions(spark)
    r = spark.sql("SELECT token_edit_distance(array('a', 'b'), array('b')) AS e, lcs_length(array('a', 'b', 'a'), array('a', 'a')) AS l, lcs_length(NULL, array('a')) AS n").first()
    assert (r.e, r.l, r.n) == (1, 2, 0)


def test_numbers_are_gapless_whatever_the_rows_carry(spark):
    n = 2_000_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("payload"), F.rand(3).alias("noise"))
    got = relational.numbered(rows, "k").select("k", "rn")
    lag = F.lag("k").over(Window.orderBy("rn"))
    assert got.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"), F.count("*")).first()[:] == (1, n, n, n)
    assert got.select("k", lag.alias("before")).where("before > k").isEmpty()
    ties = relational.numbered(spark.range(1000).select((F.col("id") % 3).alias("k"), "id"), F.col("k").desc())
    assert sorted(r.rn for r in ties.collect()) == list(range(1, 1001)) and ties.where("k = 2").agg(F.max("rn")).first()[0] == 333
    assert relational.numbered(spark.range(0), "id").count() == 0


def test_changes_on_a_stream_and_on_a_table(spark, tmp_path):
    schema = "k string, state string, ord long"
    parts = [[("a", "x", 1), ("a", "x", 2), ("b", None, 1)], [("a", None, 3), ("b", None, 2), ("a", None, 4)], [("b", "y", 3), ("a", "x", 5)]]
    src, got = str(tmp_path / "in"), []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        out = live.changes(spark.readStream.schema(schema).parquet(src), "k", "state")
        q = out.writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    live.stop_all(spark)
    want = {tuple(r) for r in live.changes(spark.read.parquet(src), "k", "state").collect()}
    assert sorted(got, key=str) == sorted(want, key=str) and want == {("a", "x", 1), ("b", None, 1), ("a", None, 3), ("b", "y", 3), ("a", "x", 5)}


def test_idle_sessions_of_a_stream(spark, tmp_path):
    rows = [("u", f"2026-01-01 00:00:{s:02}") for s in (0, 20, 50)] + [("u", "2026-01-01 01:00:00"), ("v", "2026-01-01 03:00:00")]
    df = spark.createDataFrame(rows, "k string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = live.idle_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "at")
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("u", 3), ("u", 1)}


def test_score_edges(spark):
    rows = spark.createDataFrame([("", ""), ("", "abc"), ("ab", "abcdef"), ("a  b\n", "a b"), ("é", "e")], "ref string, hyp string")
    got = {(r.ref, r.hyp): r for r in metrics.score(rows).collect()}
    assert got["", ""].exact and got["", ""].charsim == 1 and got["", "abc"].cer == 3
    assert got["ab", "abcdef"].cer == 2 and got["ab", "abcdef"].charsim == 0 and got["a  b\n", "a b"].exact and got["é", "e"].cer == 1


def test_pages(spark):
    a = np.full((60, 80, 3), 250, np.uint8)
    assert images.ink(a) == (0.0, 0) and images.dark_ratio(a) == 0 and images.skew(a) == 0
    a[10:14, 10:30] = 0
    assert images.ink(a)[1] == 1 and images.paper_colour(a) == 250
    assert (images.whiteout(a, 50.0)[:31] == 250).all()
    assert images.resize(a, 30, 40).shape == (30, 40, 3) and images.rotate(a, 3.0).shape[0] > 60
    rows = spark.createDataFrame([("1", 60, 80, bytearray(a.tobytes()))], "id string, height int, width int, data binary")
    assert images.clean_pages(rows).first().png[:4] == b"\x89PNG"


def test_pixels_are_kept_by_resize_and_rotation():
    r = np.random.default_rng(2)
    flat = np.full((40, 30, 3), (10, 120, 200), np.uint8)
    assert (images.resize(flat, 17, 45) == flat[0, 0]).all() and (images.rotate(flat, 2.0) == flat[0, 0]).all()
    a = r.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    assert (images.resize(a, 40, 30) == a).all() and images.rotate(a, 0.5) is a
    smooth = np.repeat(np.linspace(0, 255, 60)[:, None, None], 50, axis=1).repeat(3, axis=2).astype(np.uint8)
    small = images.resize(smooth, 30, 25).astype(int)
    assert np.abs(small[2:-2, 5, 0] - np.linspace(0, 255, 60).reshape(30, 2).mean(axis=1)[2:-2]).max() <= 2
    page = np.zeros((50, 50, 3), np.uint8)
    page[:, :, 2] = 100
    assert tuple(images.rotate(page, 5.0)[0, 0]) == (0, 0, 100) and tuple(images.rotate(page, 5.0, swapped_border=True)[0, 0]) == (100, 0, 0)
    turned = images.rotate(a, 3.0)
    assert turned.shape[0] == int(40 * np.cos(np.radians(3)) + 30 * np.sin(np.radians(3))) and abs(float(turned.mean()) - float(a.mean())) < 4


@pytest.mark.parametrize("angle", [0.0, 1.5, -2.5, 4.0])
def test_skew_of_drawn_lines(angle):
    page = np.full((500, 600, 3), 255, np.uint8)
    r = np.random.default_rng(3)
    for row in range(60, 440, 40):
        for x in range(40, 560):
            if r.random() < 0.8:
                y = int(round(row + np.tan(np.radians(angle)) * (x - 300)))
                page[y : y + 9, x] = 0
    assert images.skew(page) == pytest.approx(angle, abs=0.26)
    straight = images.rotate(page, images.skew(page), back=True)
    assert abs(images.skew(straight)) <= 0.5
    assert images.skew(np.full((50, 50, 3), 255, np.uint8)) == 0.0


def test_finite_at_any_depth(spark):
    df = spark.sql("SELECT array(CAST('NaN' AS DOUBLE), 1.0D) AS a, map('x', CAST('Infinity' AS DOUBLE), 'y', 2.0D) AS m, named_struct('f', CAST('-Infinity' AS FLOAT), 's', 'k', 'd', array(named_struct('z', CAST('NaN' AS DOUBLE)))) AS s, CAST(NULL AS DOUBLE) AS n")
    r = arrays.finite_columns(df).first()
    assert r.a == [None, 1.0] and r.m == {"x": None, "y": 2.0} and r.s.f is None and r.s.s == "k" and r.s.d[0].z is None and r.n is None


def test_png_is_read_back(spark, tmp_path):
    a = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    (tmp_path / "p.png").write_bytes(images.to_png(a))
    r = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    assert (r.height, r.width) == (5, 7) and bytes(r.data) == a.tobytes()
    got = files.list_files(spark, str(tmp_path)).collect()
    assert len(got) == 1 and files.list_files(spark, str(tmp_path / "none")).count() == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","v":1}\n\n{"id":"2","v":2}\n{"id":"1","v":3}\n{"id":"3","v"')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    assert {(r.id, r.v) for r in files.read_json_lines_tolerant(spark, str(tmp_path / "a.jsonl"), schema).collect()} == {("1", 3), ("2", 2)}
    (tmp_path / "d.json").write_bytes(b'\xef\xbb\xbf{"id": "x",\n "v": 9}')
    assert files.read_json_document(spark, str(tmp_path / "d.json"), schema).first().v == 9
    df = spark.createDataFrame([(1, None)], "a long, b string")
    files.write_json_lines(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":null}'


def test_live_scoring(spark, tmp_path):
    ready = tmp_path / "ready"
    ready.mkdir()
    refs = spark.createDataFrame([("p1", "ab"), ("p2", "cd")], "id string, ref string")
    outputs = spark.createDataFrame([("p1", "ab")], "id string, hyp string")

    table = SnapshotTable(spark, str(tmp_path / "scores"))

    def score():
        live.score_live(live.ready_pages(spark, str(ready)), lambda: outputs, refs, table, str(tmp_path / "cp")).awaitTermination()
        return {r.id: r.cer for r in table.read().collect()}

    (ready / "p1.time").write_text("1.5")
    assert score() == {"p1": 0.0}
    (ready / "p2.time").write_text("2")
    assert score() == {"p1": 0.0, "p2": 1.0}
    assert live.finished(True, True, refs.select("id"), refs) and not live.finished(False, True, refs.select("id"), refs)


def test_runner_goes_on_after_a_failure():
    run = stages.Run({"a": lambda t: 1, "b": lambda t: 1 / 0, "c": lambda t: t["a"] + 1})
    assert run.go({})["c"] == 2 and run.status["b"].startswith("failed")
    with pytest.raises(ZeroDivisionError):
        run.go({}, fail_fast=True)


def test_a_stage_that_fails_at_run_time_is_its_own(spark):
    bad = lambda t: t["a"].withColumn("x", F.raise_error(F.lit("broke")))
    run = stages.Run({"a": lambda t: spark.range(3), "b": bad, "c": lambda t: {"c1": t["a"].where("id > 0"), "c2": t["a"].limit(1)}})
    t = run.go({})
    assert "broke" in run.status["b"] and run.status["c"] == "done" and t["c1"].count() == 2 and "b" not in t
    again = stages.Run(run.stages)
    assert again.go({"a": spark.range(9)}, start_from="c")["c1"].count() == 8 and list(again.status) == ["c"]
    assert stages.Run(run.stages).go({}, stop=lambda: True) == {}


def test_review_and_dry_run(spark):
    rows = spark.createDataFrame([(str(i), f"t{i}") for i in range(4)], "id string, latex string")
    decisions = spark.createDataFrame([("0", "approve", None), ("1", "edit", "new"), ("2", "delete", None)], "id string, decision string, edited string")
    assert {r.id: r.latex for r in stages.review(rows, decisions).collect()} == {"0": "t0\n" + X.REVIEWED, "1": "new", "3": "t3"}
    whole = "\\documentclass{a}\\begin{document}x\\end{document}"
    done = stages.dry_run(rows, lambda r: r.withColumn("latex", F.when(F.col("id") == "0", whole).when(F.col("id") == "1", "I cannot see")), 3)
    assert "latex" in done.columns and {r.id: r.status for r in done.collect()} == {"0": "success", "1": "invalid", "2": "failed"}


def test_ten_stages_from_pages_to_splits(spark, tmp_path):
    from vellum.plans import curation, file_queries

    r = random.Random(1)
    text = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    spark.createDataFrame([(i, text(5000)) for i in range(24)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = curation.ten_stages(file_queries.write_up)
    t = run.go({"source": file_queries.pages(spark, str(tmp_path))}, fail_fast=True)
    blank = {r.id for r in t["filter_rejected"].collect()}
    assert {str(i) for i in range(0, 24, 8)} <= blank and t["filter"].count() + len(blank) == 24
    names = sorted({str(i) for i in range(24)} - blank)
    assert {r["name"]: r.num for r in t["manifest"].collect()} == {n: k for k, n in enumerate(names, 1)}
    # The stand-in refuses page numbers of remainder 3 by 7 and breaks off those of remainder 1 by 5.
    valid = {f"page_{k:05}" for k in range(1, len(names) + 1) if k % 7 != 3 and k % 5 != 1}
    assert {r.id for r in t["annotate_invalid"].collect()} == {f"page_{k:05}" for k in range(1, len(names) + 1) if k % 7 == 3}
    assert {r.id for r in t["split"].collect()} == valid == {r.id for r in t["build"].collect()}
    n = len(valid)
    assert Counter(r.split for r in t["split"].collect()) == Counter({"train": int(n * 0.9), "val": int(n * 0.05), "test": n - int(n * 0.9) - int(n * 0.05)})
    assert list(run.status.values()) == ["done"] * 10
    where = {r.stage: (r.missing, r.resume) for r in curation.resume_from(t).collect()}
    assert where["crop"] == (0, False) and where["annotate"] == (t["annotate_invalid"].count(), True)
    got = curation.prefix_batch(t["source"], "1")["convert"]
    assert {r.id for r in got.collect()} == {n for n in names if n.startswith("1")}


def test_small_helpers(spark):
    assert windows.free_letter(["a_x", "c"]) == "b" and windows.warmup_steps(100) == 20 and windows.steps_per_epoch(10, 2, 2) == 3
    assert arrays.choose_models([], ("a", "b")) == ["a", "b"]
    with pytest.raises(ValueError):
        arrays.choose_models(["a", "a"])
    with pytest.raises(ValueError):
        relational.check_config(ratios=(0.9, 0.2))
    with pytest.raises(ValueError):
        relational.require_rows(spark.range(3), 4)
    pause = live.Pause()
    assert [pause.hit(0.0) for _ in range(6)] == [60, 120, 240, 300, 300, 300] and pause.clear() is None and pause.until == 0
    assert stages.Config().max_tokens == 8192 and len(stages.Config.__dataclass_fields__) == 18


def test_a_page_that_fails_is_its_own(spark):
    def call(frame):
        if (frame["id"] == "b").any():
            raise ValueError("no")
        return frame.assign(n=1)[["id", "n"]]

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {r.id: (r.n, r.error) for r in files.call_model(rows, "id string, n long, error string", lambda: files.isolated(call, ["n"])).collect()}
    assert got == {"a": (1, None), "b": (None, "no"), "c": (1, None)}
