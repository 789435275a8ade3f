"""The messages of the alignment's shards follow the text, not the session's shuffle partitions."""

from vellum.llm import alignment


def test_more_shuffle_partitions_ask_for_no_more_pairs(spark):
    docs = spark.createDataFrame([(i, f"the same words stand here {i % 7}") for i in range(400)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        found = alignment._Shards(docs, "doc_id", "text", alignment.FOLDER).pairs
        assert found.select("_shard").distinct().count() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
