"""A file for each row, written by all tasks without a commit for each file."""

from pyspark.sql import functions as F

from vellum.sources import files


def test_each_row_has_its_file_and_all_tasks_write(spark, tmp_path):
    values = [None, "", "é\nb", *(f"row {i}" for i in range(400)), *["same"] * 3]
    rows = spark.createDataFrame([(v,) for v in values], "value string").coalesce(1)  # one piece, as a small table is read
    folder = files.write_each(rows, f"{tmp_path}/f", "txt")
    found = files.read_texts(spark, folder)
    assert sorted(r.text for r in found.collect()) == sorted(f"{v or ''}\n" for v in values)
    writers = files.list_files(spark, folder, ("txt",)).select(F.regexp_extract("path", r"part-(\d+)-", 1)).distinct().count()
    assert writers == spark.sparkContext.defaultParallelism


def test_no_rows_make_an_empty_folder(spark, tmp_path):
    folder = files.write_each(spark.createDataFrame([], "value string"), f"file:{tmp_path}/f", "txt")
    assert files.list_files(spark, folder, ("txt",)).count() == 0
