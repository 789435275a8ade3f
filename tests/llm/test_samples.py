"""Fits that stay within their bytes, and repeated rows over many partitions."""

import random
from collections import Counter

from pyspark.sql import functions as F

from vellum.llm import langid, mixing, ordinal, sample


def test_rows_stay_within_bytes(spark):
    rows = spark.range(2000).select("id", F.encode(F.repeat(F.col("id").cast("string"), 100), "UTF-8").alias("f"))
    whole = rows.agg(F.sum(F.octet_length("f"))).first()[0]
    assert sample.within_bytes(rows, ["f"], whole).count() == 2000
    some = sample.within_bytes(rows, ["f"], whole // 4)
    kept = {x.id for x in some.collect()}
    assert 400 < len(kept) < 600 and kept == {x.id for x in sample.within_bytes(rows.repartition(7), ["f"], whole // 4).collect()}
    assert sample.within_bytes(rows, ["f"], 1).count() == 0 and sample.within_bytes(rows.where("false"), ["f"], 10).count() == 0


def test_fits_from_few_bytes_still_learn(spark):
    r = random.Random(1)
    words = {"en": ["the", "and", "of", "with"], "de": ["der", "und", "von", "mit"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang, int(lang == "en")) for i in range(600) for lang in [r.choice(["en", "de"])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, grade int")
    model = langid.fit(docs, most_bytes=20_000)
    assert [x.lang_pred for x in langid.identify(spark.createDataFrame([(1, "der und von"), (2, "the and of")], "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()] == ["de", "en"]
    graded = ordinal.grade(docs, ordinal.fit(docs.select("doc_id", "text"), docs.select("doc_id", "grade"), "grade", 2, most_bytes=2_000), 2, select_from=1)
    right = graded.join(docs.select("doc_id", "grade"), "doc_id").where((F.col("p_tail") >= 0.5) == (F.col("grade") == 1)).count()
    assert right > 580


def test_a_row_repeated_in_many_partitions_is_drawn_by_row(spark):
    rows = spark.range(4000).repartition(60).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d").alias("text"), F.when(F.col("id") < 3000, "x").alias("source"))
    keyed = mixing._keyed(rows, "s", None, "doc_id", "source", "text")
    got = Counter((x.draw, x.place) for x in keyed.collect())
    assert len(got) == 4000 and max(got.values()) == 1
    assert Counter(x.draw for x in keyed.collect()).most_common(1)[0][1] == max(p for _, p in got)
    taken = mixing.mix_sources(rows, weights=(1, 2), share=0.5).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(x.t - x.g) <= 4 for x in taken)
