"""Queries of sources, sinks, streams and the stages: each writes files in the shared folder and reads them back through its operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import arrays, images, metrics
from vellum.functions import text as X
from vellum.operators import aggregates, relational, windows
from vellum.operators.lineage import shared_folder
from vellum.plans import curation, runs, stages
from vellum.plans.fixtures import annotations, load, models
from vellum.plans.queries import query
from vellum.sources import connector, files, logs
from vellum.sources.snapshots import SnapshotTable
from vellum.streaming import live


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written through the file system that holds the folder."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    out = Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(Path(path), True)
    out.write(bytearray(data))
    out.close()


def _nations(spark: SparkSession, sf_dir: str) -> list:
    """The 25 rows from which small files are made."""
    return load(spark, sf_dir, "nation").orderBy("n_nationkey").collect()


def _nation_files(spark: SparkSession, sf_dir: str, below: str = "") -> str:
    folder = _folder(spark)
    for r in _nations(spark, sf_dir):
        _put(spark, f"{folder}/{below}{r.n_name}.{'PNG' if r.n_nationkey % 3 else 'txt'}", f"{r.n_name}\n{r.n_regionkey}".encode())
    return folder


def _supplier_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, value): a small text for each supplier."""
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\n", F.col("s_suppkey").cast("string"), "s_name").alias("value"))


@query
def src1_list_files(spark, sf_dir):
    """The texts among texts and JSON files of one folder."""
    texts, folder = _supplier_texts(spark, sf_dir), _folder(spark)
    files.write_each(texts.where("s_suppkey % 3 <> 0"), folder, "txt")
    files.write_each(texts.where("s_suppkey % 3 = 0").select(F.to_json(F.struct("s_suppkey", "value")).alias("value")), folder, "json")
    return files.list_files(spark, folder, ("txt",)).select("length")


@query
def src2_list_below(spark, sf_dir):
    """Texts two folders down, found as the folder itself holds none."""
    folder = _folder(spark)
    files.write_each(_supplier_texts(spark, sf_dir), f"{folder}/deep/er", "txt")
    return files.list_files_or_below(spark, folder, ("txt",)).select("length")


@query
def src3_list_prefix(spark, sf_dir):
    found = files.list_files(spark, _nation_files(spark, sf_dir), ("png", "txt"), prefix="I")
    return found.select(files.stem(F.col("path")).alias("name"), "length")


@query
def src4_read_texts(spark, sf_dir):
    found = files.read_texts(spark, files.write_each(_supplier_texts(spark, sf_dir), _folder(spark), "txt"))
    return found.select(F.substring_index("text", "\n", 1).cast("long").alias("id"), "text")


@query
def src5_json_lines(spark, sf_dir):
    """SNK1 and SRC5: documents as JSON lines and back."""
    folder, docs = _folder(spark), load(spark, sf_dir, "documents")
    files.write_json_lines(docs, folder)
    return files.read_json_lines(spark, folder, docs.schema).select("doc_id", "text", "lang")


@query
def src6_torn_json_lines(spark, sf_dir):
    """Each supplier twice, the second time with another value, in files with lines that are no JSON or break off."""
    one = load(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    line = F.format_string('{"id": "%d", "v": %d}%s', "s_suppkey", F.col("s_suppkey") + 1000 * F.col("k"), F.when(F.col("k") == 0, F.lit("\nno json")).otherwise(F.lit('\n{"id": "TORN", "v')))
    folder = _folder(spark)
    one.repartition(3, "s_suppkey").sortWithinPartitions("k", "s_suppkey").select(line.alias("value")).write.text(folder)
    return files.read_json_lines_tolerant(spark, folder, T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())]))


@query
def src7_json_document(spark, sf_dir):
    """SRC7 and SRC8: documents with and without a byte order mark, corrupt ones and a missing one."""
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("nation", T.LongType())])
    whole = F.format_string('{"name": "%s",\n "nation": %d}', "s_name", "s_nationkey")
    text = F.concat(F.when(F.col("s_suppkey") % 2 == 1, "\ufeff").otherwise(""), F.when(F.col("s_suppkey") % 5 != 0, whole).otherwise('{"name": '))
    folder = files.write_each(load(spark, sf_dir, "supplier").select(text.alias("value")), _folder(spark), "json")
    return files.read_json_document(spark, folder, schema).unionByName(files.read_json_document(spark, f"{folder}/none.json", schema))


@query
def src11_adapters(spark, sf_dir):
    inner = F.element_at(F.array(F.lit(""), F.lit("best/"), F.lit("final/"), F.lit("checkpoint-5/")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    paths = load(spark, sf_dir, "orders").select(F.concat(F.lit("runs/run"), (F.col("o_orderkey") % 50).cast("string"), F.lit("/"), inner, F.lit("adapter_config.json")).alias("path"))
    return files.adapters(paths.where(~F.col("path").contains("checkpoint")))


@query
def src15_log_stream(spark, sf_dir):
    """Events as log files that executors write in two goes; a stream that is started again after the second gives each line once."""
    base = _folder(spark)
    e = load(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("value"))
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(f"{base}/logs")
        stream = logs.log_stream(spark, f"{base}/logs").writeStream.format("parquet").option("path", f"{base}/lines").option("checkpointLocation", f"{base}/checkpoint")
        stream.trigger(availableNow=True).start().awaitTermination()
    lines = F.split("line", " ")
    return spark.read.parquet(f"{base}/lines").select(lines[0].cast("long").alias("id"), lines[1].alias("event_type"))


@query
def src16_call_model(spark, sf_dir):
    """An injected client that fails on some pages: each failure stays its page's own."""

    def client():
        def call(frame):
            if (frame["id"] % 17 == 0).any():
                raise ValueError("refused")
            return frame.assign(answer=frame["text"].fillna("").str.len())[["id", "answer"]]

        return files.isolated(call, ["answer"])

    return files.call_model(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id long, answer long, error string", client)


@query
def src16_connector(spark, sf_dir):
    """A client that is turned away twice for some pages and always fails for others: each page has its answer or its last error."""

    def client():
        asked = {}

        def call(row):
            if row["id"] % 17 == 0:
                raise ValueError("500 refused")
            if row["id"] % 13 == 0 and asked.setdefault(row["id"], 0) < 2:
                asked[row["id"]] += 1
                raise ValueError("HTTP 429: slow down")
            asked.pop(row["id"], None)
            return {"answer": len(row["text"] or "")}

        return call

    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return connector.call(rows, "answer long", client, connector.Policy(wait_s=0, first_pause_s=0)).drop("text")


@query
def orc2_resumed(spark, sf_dir):
    """A run that breaks off in its third stage and then goes on: what each stage gave, and how often it was computed."""
    folder, computed = _folder(spark), []

    def stage(name, f):
        def run(t):
            computed.append(name)
            return f(t)

        return run

    def broken(t):
        raise RuntimeError("broken")

    steps = {"english": stage("english", lambda t: t["documents"].where("lang = 'en'")), "short": stage("short", lambda t: t["english"].where("n_chars < 1000")), "labelled": stage("labelled", broken), "count": stage("count", lambda t: t["documents"].groupBy("lang").count())}
    docs = {"documents": load(spark, sf_dir, "documents")}
    runs.ResumableRun(dict(steps), folder=folder).go(docs)
    steps["labelled"] = stage("labelled", lambda t: t["short"].join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))
    again = runs.ResumableRun(dict(steps), folder=folder)
    again.go(docs)
    times = spark.createDataFrame([(n, computed.count(n)) for n in steps], "stage string, computed int")
    return again.ledger().select("stage", "status", "n_rows").join(times, "stage")


@query
def src18_missing_images(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    there = d.where("id % 3 <> 0").select("id", F.lit(1).alias("height"), F.octet_length(F.coalesce("text", F.lit(""))).alias("width"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return images.or_blank(d, there).select("id", "height", "width", F.octet_length("data").alias("n_bytes"))


@query
def snk3_append(spark, sf_dir):
    folder, o = _folder(spark), load(spark, sf_dir, "orders").select("o_orderkey")
    files.append_rows(o.where("o_orderkey % 2 = 0"), folder)
    files.append_rows(o.where("o_orderkey % 2 = 1"), folder)
    return spark.read.parquet(folder)


@query
def snk4_replace(spark, sf_dir):
    """SNK4: an older table replaced, then replaced by rows read from itself, then older versions dropped."""
    table = SnapshotTable(spark, f"{_folder(spark)}/t")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("v"))
    table.replace(o.where("id % 5 = 0"))
    table.replace(o)
    table.replace(table.read().withColumn("v", F.when(F.col("id") % 4 == 0, "new").otherwise(F.col("v"))))
    table.vacuum(keep=1)
    return table.read()


@query
def snk5_routed(spark, sf_dir):
    """SNK5 and SNK6: a folder for each bucket, read back with the bucket from its name."""
    folder, d = _folder(spark), load(spark, sf_dir, "documents")
    files.write_routed(d.select("doc_id", relational.size_bucket(F.octet_length("text"), 2).alias("bucket")), "bucket", folder)
    return spark.read.schema("doc_id long, bucket string").parquet(folder)


@query
def snk7_rebuild(spark, sf_dir):
    folder, o = _folder(spark), load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    files.write_json_lines(o, folder)
    files.write_json_lines(o.where("o_orderstatus = 'F'"), folder)
    return files.read_json_lines(spark, folder, o.schema)


@query
def snk12_stale(spark, sf_dir):
    return files.stale(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query
def met17_compile(spark, sf_dir):
    """An injected compiler, built once a task."""

    def command():
        return lambda t: t.count("$") % 2 == 0

    return stages.run_compiler(annotations(spark, sf_dir), command)


@query
def agg5_no_pages(spark, sf_dir):
    v = load(spark, sf_dir, "documents").select("source", F.expr("lpad(CAST(doc_id AS STRING), 8, '0')").alias("id"), F.expr("CASE doc_id % 7 WHEN 0 THEN 'NO' ELSE 'YES' END").alias("verdict"))
    return aggregates.listed(v, "NO", "source")


@query
def agg6_reject_list(spark, sf_dir):
    from vellum.plans.queries import met16_self_consistency

    return aggregates.listed(met16_self_consistency(spark, sf_dir), "reject", "cer")


@query
def agg11_by_chars(spark, sf_dir):
    return aggregates.by_chars(load(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query
def joi12_exclusions(spark, sf_dir):
    return relational.merged_exclusions(load(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), load(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id")))


@query
def joi16_requested(spark, sf_dir):
    v = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return relational.requested_only(v, load(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


@query
def win14_by_size(spark, sf_dir):
    return windows.by_size(load(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("length")))


@query
def arr7_read_model(spark, sf_dir):
    return arrays.without_heavy(load(spark, sf_dir, "documents"), "text")


@query
def arr11_whole_labels(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    ids = F.sequence(F.lit(1), (F.col("doc_id") % 9 + 4).cast("int"))
    rows = d.select("doc_id", (F.col("doc_id") % 10).alias("batch"), arrays.whole_labels(ids, (F.col("doc_id") % 4 + 1).cast("int"), 8).alias("labels"))
    return arrays.padded_batch(rows, "batch", ("labels", -100)).select("doc_id", F.array_join("labels", ",").alias("labels"))


@query
def img9_payload(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("x"), F.col("lang")).alias("images"), F.expr("array(named_struct('role', 'user', 'images', array(lang, source)))").alias("messages"))
    out = arrays.fit_payload(d, lambda x: F.upper(x))
    return out.select("doc_id", F.array_join("images", ",", "-").alias("top"), F.array_join(F.element_at("messages", 1)["images"], ",", "-").alias("inner"))


@query
def str1_live_scores(spark, sf_dir):
    """STR1, STR2 and STR4: markers written last make pages ready; two runs score each page once."""
    base, rows = _folder(spark), _nations(spark, sf_dir)
    nation = load(spark, sf_dir, "nation")
    outputs = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("id"), F.lower("n_name").alias("hyp"))
    refs = nation.select(F.col("n_name").alias("id"), F.col("n_name").alias("ref"))
    scores = SnapshotTable(spark, f"{base}/scores")
    for part in (0, 1):
        for r in rows:
            if r.n_nationkey % 3 == part:
                _put(spark, f"{base}/ready/{r.n_name}.time", f"{r.n_nationkey}.5".encode())
        live.score_live(live.ready_pages(spark, f"{base}/ready"), lambda: outputs, refs, scores, f"{base}/checkpoint").awaitTermination()
    return scores.read().select("id", "latency_s", "cer", "exact")


@query
def str4_merged_columns(spark, sf_dir):
    """STR4 and U3: four models' scores of a page in one row; one model's batch comes twice, and some of its pages are scored again."""
    table = SnapshotTable(spark, f"{_folder(spark)}/scores")
    m = models(spark, sf_dir)
    for model in "abcd":
        own = m.where(F.col("model") == model).select("id", F.length("hyp").alias(f"{model}_length"), F.col("latency_s").alias(f"{model}_latency_s"))
        for _ in range(2 if model == "b" else 1):
            table.upsert(own if model != "d" else own.where("id % 2 = 0"), writer=model, batch=0, buckets=8)
    again = m.where("model = 'b' AND id % 3 = 0").select("id", F.lit(-1).alias("b_length"), F.col("latency_s").alias("b_latency_s"))
    table.upsert(again.unionByName(again.withColumn("b_length", F.length(F.lit("ab")))), order="b_length", writer="b", batch=1)
    return table.read()


@query
def ups3_stored_refresh(spark, sf_dir):
    """U3 on a stored table: rows of known ids are replaced whole, others join."""
    table = SnapshotTable(spark, f"{_folder(spark)}/t")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("v"), F.col("o_totalprice").alias("price"))
    table.upsert(o.where("id % 5 <> 0"), buckets=8)
    live.refresh(table, o.where("id % 4 = 0").select("id", F.lit("new").alias("v")))
    return table.read()


@query
def str10_pauses(spark, sf_dir):
    """Events as calls, of which some are turned away and some tell nothing."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 != 0).alias("limited"))
    return live.pauses(e, "user_id", "limited", ["event_id"])


@query
def str3_finished(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    ends = [(s, g, all_, live.finished(s, g, d, d if all_ else d.where("id > 5"))) for s in (True, False) for g in (True, False) for all_ in (True, False)]
    return spark.createDataFrame(ends, "started boolean, done boolean, scored boolean, finished boolean")


@query
def orc4_evaluate(spark, sf_dir):
    """Four models of which one fails while its rows are computed."""
    m = models(spark, sf_dir)
    bad = F.when(F.col("hyp") == "", F.raise_error(F.lit("no output"))).otherwise(F.col("hyp"))
    scores, failed = stages.evaluate({x: m.where(F.col("model") == x).drop("model") for x in "abcd"}, lambda p: p.select("id", metrics.structure_ok(bad.cast("string")).alias("struct")))
    return scores.groupBy("model").agg(F.count("*").alias("n")).unionByName(spark.createDataFrame([(x, None) for x in failed], "model string, n long"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page image for each document: 64 pixels wide, dark where a byte of its whole text is odd; every eighth is white."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", " "), "UTF-8").alias("t"))
    d = d.select("id", "t", F.greatest(F.lit(48), F.ceil(F.octet_length("t") / 64)).cast("int").alias("height"))
    white = F.expr("CASE WHEN CAST(id AS BIGINT) % 8 = 0 THEN unhex(repeat('FF', height * 64)) ELSE rpad(t, height * 64, X'FF') END")
    return d.select("id", "height", F.lit(64).alias("width"), white.alias("data"))  # one channel


@query
def fil2_dark_ratio(spark, sf_dir):
    """Dark and inked parts of the pages in percent."""
    m = pages(spark, sf_dir).select("id", images.dark_and_ink("data", "height", "width").alias("m"))
    return m.select(F.col("id").cast("long").alias("doc_id"), F.round("m.dark", 6).alias("dark"), F.round("m.ink", 6).alias("ink"))


def write_up(rows: DataFrame) -> DataFrame:
    """A stand-in for the model that annotates: a document by the page's number; some answers are refusals, some break off."""
    n = F.substring("id", 6, 10).cast("long")
    body = F.concat(F.lit("```latex\n\\documentclass{article}\n\\usepackage{amsmath}\n\\begin{document}\nPage "), F.col("id"), F.lit(" "), F.repeat(F.lit("$x=1$ and more words "), 20), F.when(n % 5 == 1, "$").otherwise(""), F.lit("\n\\end{document}\n```"))
    return rows.select("id", F.when(n % 7 == 3, "I cannot see the image.").otherwise(body).alias("answer"))


@query
def orc1_ten_stages(spark, sf_dir):
    """From page images to splits, through all ten stages."""
    run = curation.ten_stages(write_up)
    t = run.go({"source": pages(spark, sf_dir)}, fail_fast=True)
    return t["split"].join(t["manifest"].select("id", F.col("name").cast("long").alias("doc_id")), "id").select("doc_id", "id", "split")


@query
def orc10_prefix_batch(spark, sf_dir):
    t = curation.prefix_batch(pages(spark, sf_dir), "1")
    return t["convert"].select("id", "height", "width", F.hex(F.substring("png", 2, 3)).alias("magic"))


ORACLES = {
    "fil2_dark_ratio": "WITH p AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE round(100.0::DOUBLE * n / (64 * greatest(48, ceil(n / 64.0::DOUBLE))), 6) END AS dark, CASE WHEN doc_id % 8 = 0 THEN 0 ELSE round(100.0::DOUBLE * n / (64 * greatest(48, ceil(n / 64.0::DOUBLE))), 6) END AS ink FROM p",
    "src1_list_files": "SELECT length(s_suppkey || s_name) + 2 AS length FROM supplier WHERE s_suppkey % 3 <> 0",
    "src2_list_below": "SELECT length(s_suppkey || s_name) + 2 AS length FROM supplier",
    "src3_list_prefix": "SELECT n_name AS name, length(n_name) + 2 AS length FROM nation WHERE n_name LIKE 'I%'",
    "src4_read_texts": "SELECT s_suppkey::BIGINT AS id, s_suppkey || chr(10) || s_name || chr(10) AS text FROM supplier",
    "src5_json_lines": "SELECT doc_id, text, lang FROM documents",
    "src6_torn_json_lines": "SELECT s_suppkey::VARCHAR AS id, (s_suppkey + 1000)::BIGINT AS v FROM supplier",
    "src7_json_document": "SELECT s_name AS name, s_nationkey::BIGINT AS nation FROM supplier WHERE s_suppkey % 5 <> 0",
    "src11_adapters": "SELECT 'run' || o_orderkey % 50 AS run, CASE min(CASE o_orderkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END) WHEN 0 THEN 'best' WHEN 1 THEN 'final' ELSE '' END AS folder FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1",
    "src15_log_stream": "SELECT event_id AS id, event_type FROM events",
    "src16_call_model": "SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN length(coalesce(text, '')) END::BIGINT AS answer, CASE WHEN doc_id % 17 = 0 THEN 'refused' END AS error FROM documents",
    "src16_connector": "SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN length(coalesce(text, '')) END::BIGINT AS answer, CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 17 = 0 OR doc_id % 13 = 0 THEN 3 ELSE 1 END::INT AS attempts, CASE WHEN doc_id % 17 = 0 THEN '500 refused' END AS error FROM documents",
    "orc2_resumed": """WITH e AS (SELECT * FROM documents WHERE lang = 'en'), s AS (SELECT * FROM e WHERE n_chars < 1000)
SELECT 'english' AS stage, 'done' AS status, (SELECT count(*) FROM e) AS n_rows, 1 AS computed UNION ALL SELECT 'short', 'done', (SELECT count(*) FROM s), 1
UNION ALL SELECT 'labelled', 'done', (SELECT count(*) FROM s WHERE doc_id IN (SELECT doc_id FROM labels)), 2 UNION ALL SELECT 'count', 'done', (SELECT count(DISTINCT coalesce(lang, '-')) FROM documents), 1""",
    "src18_missing_images": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 224 ELSE 1 END AS height, CASE WHEN doc_id % 3 = 0 THEN 224 ELSE octet_length(encode(coalesce(text, ''))) END::INT AS width, CASE WHEN doc_id % 3 = 0 THEN 224 * 224 * 3 ELSE octet_length(encode(coalesce(text, ''))) END::INT AS n_bytes FROM documents",
    "snk3_append": "SELECT o_orderkey FROM orders",
    "snk4_replace": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM orders",
    "snk5_routed": "SELECT doc_id, CASE WHEN octet_length(encode(text)) < 2048 THEN 'blank' ELSE 'content' END AS bucket FROM documents",
    "snk7_rebuild": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "snk12_stale": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "agg5_no_pages": "SELECT lpad(doc_id::VARCHAR, 8, '0') AS id, source FROM documents WHERE doc_id % 7 = 0",
    "agg11_by_chars": "SELECT doc_id, length(text)::INT AS chars, CASE WHEN trim(text) = '' THEN 'blank' ELSE 'filled' END AS verdict FROM documents",
    "joi12_exclusions": "SELECT DISTINCT doc_id AS id FROM labels WHERE toxic = 1 OR quality = 0",
    "joi16_requested": "SELECT doc_id AS id, quality FROM labels WHERE doc_id % 3 = 0",
    "win14_by_size": "SELECT doc_id, octet_length(encode(text))::INT AS length FROM documents",
    "arr7_read_model": "SELECT doc_id, lang, source, n_chars FROM documents",
    "arr11_whole_labels": """WITH l AS (SELECT doc_id, doc_id % 10 AS b, list_concat(list_transform(range(least(doc_id % 4 + 1, doc_id % 9 + 4)), lambda x: -100), range(1, doc_id % 9 + 5)[doc_id % 4 + 2:])[1:8] AS l FROM documents)
SELECT doc_id, array_to_string(list_resize(l, max(len(l)) OVER (PARTITION BY b), -100), ',') AS labels FROM l""",
    "img9_payload": "SELECT doc_id, 'X,' || coalesce(upper(lang), '-') AS top, coalesce(upper(lang), '-') || ',' || coalesce(upper(source), '-') AS inner FROM documents",
    "str1_live_scores": "SELECT n_name AS id, n_nationkey + 0.5::DOUBLE AS latency_s, round(levenshtein(n_name, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE '' END)::DOUBLE / length(n_name), 4) AS cer, false AS exact FROM nation WHERE n_nationkey % 3 < 2",
    "str4_merged_columns": "WITH {pairs}, {models}, m AS (SELECT id, model, length(hyp)::INT AS n, latency_s::DOUBLE AS s FROM models) SELECT id, max(n) FILTER (model = 'a') AS a_length, max(s) FILTER (model = 'a') AS a_latency_s, CASE WHEN id % 3 = 0 THEN 2 ELSE max(n) FILTER (model = 'b') END AS b_length, max(s) FILTER (model = 'b') AS b_latency_s, max(n) FILTER (model = 'c') AS c_length, max(s) FILTER (model = 'c') AS c_latency_s, max(n) FILTER (model = 'd' AND id % 2 = 0) AS d_length, max(s) FILTER (model = 'd' AND id % 2 = 0) AS d_latency_s FROM m GROUP BY id",
    "ups3_stored_refresh": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 4 = 0",
    "str10_pauses": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 <> 0 END AS limited FROM events),
g AS (SELECT *, coalesce(count_if(NOT limited) OVER o, 0) AS g FROM e WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT user_id, event_id, limited, least(4, coalesce(count_if(limited) OVER (PARTITION BY user_id, g ORDER BY event_id), 0))::INT AS strikes FROM g)
SELECT *, CASE WHEN limited THEN least(60 * pow(2, strikes - 1), 300)::DOUBLE END AS pause_s FROM s""",
    "str3_finished": "SELECT s AS started, d AS done, a AS scored, s AND d AND a AS finished FROM (VALUES (true), (false)) x(s), (VALUES (true), (false)) y(d), (VALUES (true), (false)) z(a)",
    "orc4_evaluate": "WITH {pairs}, {models} SELECT model, CASE WHEN count_if(hyp = '') = 0 THEN count(*) END AS n FROM models GROUP BY model",
}
