"""Sources and sinks: images, texts, JSON lines and documents, listings, logs and checkpoints."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from vellum.operators.lineage import spread

IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
_LISTING = "path string, modificationTime timestamp, length long, content binary"


def stem(path):
    """A file's name without directories and suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def suffix(path):
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def list_files(spark: SparkSession, path: str, suffixes=IMAGES, prefix: str = "", recursive: bool = False) -> DataFrame:
    """SRC1 to SRC3: files by suffix and prefix; a missing folder has none. The prefix is a glob of the listing; contents are read only if selected, and never moved."""
    reader = spark.read.format("binaryFile")
    if prefix:
        reader = reader.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", prefix) + "*")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        df = reader.load(path)
    except AnalysisException:
        return spark.createDataFrame([], _LISTING)
    return df.where(suffix(F.col("path")).isin(*suffixes))


def list_files_or_below(spark: SparkSession, path: str, suffixes=IMAGES) -> DataFrame:
    """SRC2: the folder's files, those below it only where it has none."""
    flat = list_files(spark, path, suffixes)
    return flat if not flat.isEmpty() else list_files(spark, path, suffixes, recursive=True)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: (id, text) of whole files, bytes that are no UTF-8 replaced."""
    return spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("id"), F.col("value").alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """SRC5; strict: a malformed line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_lines_tolerant(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """SRC6: malformed lines are skipped, the last line of an id wins, by file and place."""
    from vellum.operators.relational import last_wins

    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("_pos"))
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "_pos")
    rows = rows.where(F.col("r._corrupt_record").isNull() & F.col(f"r.{key}").isNotNull()).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields), "_pos")
    return last_wins(rows, key, "_pos").drop("_pos")


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SRC7 and SRC8: a JSON document, with or without a byte order mark; a missing or corrupt one has no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.select(F.from_json(F.regexp_replace("value", "^\\uFEFF", ""), bad, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where(F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()).select(*(F.col(f"r.{f.name}").alias(f.name) for f in schema.fields))


def file_totals(files: DataFrame) -> DataFrame:
    """SRC9: number and megabytes."""
    return files.agg(F.count("*").alias("n_files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576.0, 1).alias("size_mb"))


def workspace_inventory(files: DataFrame) -> DataFrame:
    """SRC10: files of each folder by kind."""
    s = suffix(F.col("path"))
    folder = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(folder.alias("folder")).agg(F.count_if(s.isin(*IMAGES)).alias("images"), F.count_if(s == "tex").alias("tex"), F.count_if(s.isin("json", "jsonl")).alias("json"), F.count("*").alias("total"))


def adapters(files: DataFrame, order=("best", "final", "")) -> DataFrame:
    """SRC11: for each run the first of its folders that has an adapter's configuration."""
    inner = F.regexp_extract("path", r"([^/]+)/(?:(best|final)/)?adapter_config\.json$", 2)
    run = F.regexp_extract("path", r"([^/]+)/(?:(?:best|final)/)?adapter_config\.json$", 1)
    rank = F.array_position(F.array(*(F.lit(o) for o in order)), inner)
    return files.where(F.col("path").rlike(r"adapter_config\.json$")).groupBy(run.alias("run")).agg(F.min_by(inner, rank).alias("folder"))


def latest_checkpoint(checkpoints: DataFrame, least_bytes: int = 512 * 1024) -> DataFrame:
    """SRC12: of (name, state_ok, weight_bytes, optimizer_bytes) the valid one with the greatest step; a name without a number counts 0."""
    step = F.coalesce(F.element_at(F.split("name", "-"), -1).try_cast("int"), F.lit(0))
    ok = F.col("state_ok") & (F.col("weight_bytes") > least_bytes) & (F.col("optimizer_bytes") >= least_bytes)
    return checkpoints.where(ok).agg(F.max_by("name", F.struct(step, F.col("name"))).alias("name"))


def newest(files: DataFrame) -> DataFrame:
    """SRC13"""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def log_tail(lines: DataFrame, n: int, order: str = "line") -> DataFrame:
    """SRC14: the last n lines, in order."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def log_after(events: DataFrame, after: int, key: str = "id") -> DataFrame:
    """SRC15"""
    return events.where(F.col(key) > after)


def call_model(rows: DataFrame, schema: str, client: Callable[[], Callable]) -> DataFrame:
    """SRC16: rows through an injected client, built once per task; it maps a pandas frame to one of the schema."""

    def work(frames):
        call = client()
        for f in frames:
            yield call(f)

    return rows.mapInPandas(work, schema)


def isolated(call: Callable, columns: list[str], key: str = "id") -> Callable:
    """ORC4: call for a frame; where that raises, row by row, and a row that raises has nulls and the error's text in ``error``."""

    def one_by_one(frame):
        import pandas as pd

        try:
            return call(frame).assign(error=None)
        except Exception:
            out = []
            for i in range(len(frame)):
                row = frame.iloc[i : i + 1]
                try:
                    out.append(call(row).assign(error=None))
                except Exception as e:
                    out.append(pd.DataFrame({key: row[key].tolist(), **{c: [None] for c in columns}, "error": [str(e)]}))
            return pd.concat(out, ignore_index=True)

    return one_by_one


def write_each(rows: DataFrame, path: str, suffix: str) -> str:
    """A UTF-8 file of its own for each row's ``value``, with a line feed behind it; null is an empty value. path is a folder that pyarrow opens, reachable from all executors.

    Rows are dealt to all cores, and tasks write their files themselves: a file costs its creation, no commit and no rename. Names follow from the
    task and the place in it, so a task that is run again writes the same files again.
    """

    def work(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        system.create_dir(base, recursive=True)
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for value in b.column(0).to_pylist():
                with system.open_output_stream(f"{base}/part-{task:05d}-{n:09d}.{suffix}") as out:
                    out.write(f"{value or ''}\n".encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    spread(rows.select("value")).mapInArrow(work, "n long").agg(F.sum("n")).collect()
    return path


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: nulls are written, other scripts as they are. SNK7: derived folders are rebuilt."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_report(df: DataFrame) -> DataFrame:
    """SNK2: each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def append_rows(df: DataFrame, path: str) -> None:
    """SNK3: Spark's committer makes the appended files visible at once."""
    df.write.mode("append").parquet(path)


def write_routed(df: DataFrame, bucket: str, path: str) -> None:
    """SNK5 and SNK6: a folder for each value of the bucket."""
    df.write.mode("overwrite").partitionBy(bucket).parquet(path)


def stale(files: DataFrame, referenced: DataFrame, key: str = "id") -> DataFrame:
    """SNK12: files that no sample refers to."""
    return files.join(referenced.select(key), key, "left_anti")


#: The report's lines, in order: group, metric, column of the summary, format. Fixed values.
REPORT = (
    ("Character accuracy", "Mean CER", "mean_cer", "%.4f"),
    ("Character accuracy", "Median CER", "median_cer", "%.4f"),
    ("Character accuracy", "Normalized CER", "norm_cer", "%.4f"),
    ("Character accuracy", "Character similarity", "charsim", "%.1f%%"),
    ("Syntax and structure", "Structure validity", "struct_pct", "%.1f%%"),
    ("Syntax and structure", "Compile rate", "compile_rate", "%.1f%%"),
    ("Mathematical semantics", "Math F1", "math_f1", "%.4f"),
    ("Mathematical semantics", "BLEU-4", "bleu", "%.4f"),
    ("Mathematical semantics", "ROUGE-L", "rouge_l", "%.4f"),
    ("Mathematical semantics", "chrF", "chrf", "%.4f"),
    ("Usability", "CER < 10 %", "cer_under_10pct", "%.1f%%"),
    ("Usability", "CER < 30 %", "cer_under_30pct", "%.1f%%"),
    ("Latency", "Average page latency", "avg_latency_s", "%.2fs"),
    ("Latency", "Total runtime", "total_s", "time"),
)


def markdown_report(summary: DataFrame, key: str = "model") -> DataFrame:
    """SNK11: (model, ord, line): a line for each metric of each model, N/A for what is missing; similarity as percent, seconds as hours and minutes."""

    def show(c: str, form: str):
        if c not in summary.columns:
            return F.lit("N/A")
        value = duration(F.col(c)) if form == "time" else F.format_string(form, F.col(c) * 100 if c == "charsim" else F.col(c))
        return F.when(F.col(c).isNull(), "N/A").otherwise(value)

    lines = F.array(*(F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"| {group} | {name} | "), show(c, form), F.lit(" |")).alias("line")) for i, (group, name, c, form) in enumerate(REPORT)))
    return summary.select(key, F.explode(lines).alias("l")).select(key, "l.ord", "l.line")


def duration(seconds):
    s = F.floor(seconds)
    return F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))
