import random

from vellum.llm import decontam


def test_a_long_excerpt_counts_whatever_its_share(spark):
    r = random.Random(8)
    item = [f"w{r.randrange(9000)}" for _ in range(300)]
    common = [" ".join(item[100:260])] * 5  # the rarest half of the n-grams lies elsewhere

    def excerpt(lo, n):
        return " ".join(f"v{r.randrange(9000)}" for _ in range(60)) + " " + " ".join(item[lo : lo + n]) + " tail of words"

    cases = {1: excerpt(5, 20), 2: excerpt(150, 20), 3: excerpt(200, 100), 4: excerpt(150, 15), 5: excerpt(0, 0)}
    docs = spark.createDataFrame([*cases.items(), *((100 + i, t) for i, t in enumerate(common))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[5:60]))], "item_id long, text string")
    got = {x.doc_id for x in decontam.find_contamination(docs, bench).where("item_id = 7").collect()}
    assert got == {1, 2, 3, *range(100, 105)}
