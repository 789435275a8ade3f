"""Numbers of six places, which only large tables have."""

import duckdb

from vellum.operators.windows import manifest_ids
from vellum.plans.oracles import ORACLES
from vellum.plans.queries import QUERIES


def _same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).collect())
    assert got == sorted(con.execute(ORACLES[name]).fetchall())
    return got


def test_pages_beyond_five_places_follow_their_sql(spark, tmp_path):
    spark.range(100_003).selectExpr("id AS doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert _same_as_sql(spark, tmp_path, "win12_batches", "documents")[-1][4] == "page_10000"
    spark.sql("SELECT id AS s_suppkey, concat('s', id) AS s_name FROM range(99990, 100010)").write.parquet(f"{tmp_path}/supplier.parquet")
    _same_as_sql(spark, tmp_path, "win2_manifest_ids", "supplier")


def test_the_operator_keeps_ids_beyond_five_places_apart(spark):
    new, old = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("z", 99_999)], "name string, num long")
    assert [r.id for r in manifest_ids(new, old).orderBy("num").collect()] == ["page_100000", "page_100001"]
