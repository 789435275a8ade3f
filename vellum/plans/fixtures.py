"""Tables of the domain, derived from the given ones by expressions that mean the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators.lineage import spread


def sql_text(s: str) -> str:
    """A text as an SQL expression without escapes, which the two engines read differently."""
    out, plain = [], ""
    for c in s:
        if c in "\\\n'":
            if plain:
                out.append(f"'{plain}'")
                plain = ""
            out.append(f"chr({ord(c)})")
        else:
            plain += c
    return " || ".join([*out, *([f"'{plain}'"] if plain else [])]) or "''"


_OPEN = "\\documentclass{article}\n\\usepackage{amsmath, amssymb}\n\\begin{document}\n"
_CLOSE = "\n\\end{document}"
#: By doc_id % 16: what stands before and behind the body of a page.
CASES = (
    (_OPEN, "\n$x=1$" + _CLOSE),
    (_OPEN, "\n$x=1$ $" + _CLOSE),
    (_OPEN, "\n\\[ x=1" + _CLOSE),
    (_OPEN, "\n$a$ \\\\[2mm] $b$" + _CLOSE),
    (_OPEN, "\n\\begin{align} x=1" + _CLOSE),
    (_OPEN, "\n$y$ A =" + _CLOSE),
    (_OPEN, "\n$y$ \\\\" + _CLOSE),
    ("Here it is:\n```latex\n" + _OPEN, "\n$x$" + _CLOSE + "\n```\nDone."),
    ("<think>first $x</think>" + _OPEN, "\n$x$" + _CLOSE),
    ("<think>open " + _OPEN, "\n$x$" + _CLOSE),
    ("I cannot see the image. ", ""),
    ("", " and $\\dfrac{1}{2}$"),
    (_OPEN, "\n$\\cancel{x}$ 100\\degree" + _CLOSE),
    (_OPEN, "\n\\textit{[illegible]} $x$" + _CLOSE),
    ("\\require{cancel} \\textcircled{3} ", " $x$"),
    ("<|det|>header [1,2]<|/det|>Head\n<|det|>text [1,2]<|/det|># Title\n5 of 20\n", "\n<|det|>footer [3,4]<|/det|>Foot"),
)
ID = "lpad(CAST(doc_id AS STRING), 8, '0')"
LATEX = "CASE doc_id % 16 " + " ".join(f"WHEN {i} THEN {sql_text(a)} || body || {sql_text(b)}" for i, (a, b) in enumerate(CASES)) + " END"


def body_sql(engine: str) -> str:
    every = ", 'g'" if engine == "duckdb" else ""
    return f"regexp_replace(coalesce(text, ''), '[^ -~]+', ' '{every})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, latex): a page for each document."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.expr(body_sql("spark")).alias("body"))
    return docs.select(F.expr(ID).alias("id"), F.expr(LATEX).alias("latex"))


ANNOTATIONS = f"ann AS (SELECT {ID} AS id, {LATEX} AS latex FROM (SELECT doc_id, {body_sql('duckdb')} AS body FROM documents))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ref, hyp): a user's turn as the hypothesis of the answer to it."""
    c = load(spark, sf_dir, "conversations")

    def fold(x):
        return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "[^!-~]+", " "))

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "turn", "role", fold(F.col("text")).alias("hyp"), fold(F.lead("text").over(w)).alias("ref"), F.lead("role").over(w).alias("next"))
    return rows.where("role = 'user' AND next = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "ref", "hyp")


PAIRS = r"""pairs AS (
  SELECT conv_id * 100 + turn AS id, ref, hyp FROM (
    SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[^!-~]+', ' ', 'g')) AS hyp,
           trim(regexp_replace(coalesce(lead(text) OVER w, ''), '[^!-~]+', ' ', 'g')) AS ref, lead(role) OVER w AS nxt
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nxt = 'assistant')"""

MODELS = "models AS (SELECT m AS model, id, ref, CASE m WHEN 'a' THEN hyp WHEN 'b' THEN substr(ref, 1, CAST(floor(length(ref) * 9 / 10) AS INT)) WHEN 'c' THEN ref ELSE '' END AS hyp, (id * 7 % 50) / 10.0 AS latency_s, CASE WHEN m <> 'a' THEN id % 3 <> 0 END AS compile_ok FROM pairs, (VALUES ('a'), ('b'), ('c'), ('d')) v(m))"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs for four models with latency and compile results."""
    # Scoring costs far more than moving a row, so rows are dealt to all tasks however small they are.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = pairs(spark, sf_dir).repartition(n, "id").withColumn("model", F.explode(F.array(*(F.lit(m) for m in "abcd"))))
    hyp = F.when(F.col("model") == "a", F.col("hyp")).when(F.col("model") == "b", F.expr("substr(ref, 1, CAST(floor(length(ref) * 9 / 10) AS INT))")).when(F.col("model") == "c", F.col("ref")).otherwise("")
    return p.select("model", "id", "ref", hyp.alias("hyp"), (F.col("id") * 7 % 50 / 10.0).alias("latency_s"), F.when(F.col("model") != "a", F.col("id") % 3 != 0).alias("compile_ok"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, us, event_id, loss): each user's events as the telemetry of a run, in the order of us and event_id."""
    return load(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", F.col("value").alias("loss"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, step, at, loss): each user's events as the telemetry of a run; at in seconds."""
    e = load(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", F.row_number().over(w).alias("step"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("loss"))


STEPS = "steps AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS step, epoch_us(ts) AS us, value AS loss FROM events)"
