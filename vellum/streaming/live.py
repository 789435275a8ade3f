"""Incremental scoring as Structured Streaming: ready pages come in, scores are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.functions.metrics import score
from vellum.operators.scans import Differs, Strikes, scan
from vellum.sources.files import stem
from vellum.sources.snapshots import SnapshotTable
from vellum.streaming import stateful


def ready_pages(spark: SparkSession, path: str, suffix: str = "time") -> DataFrame:
    """STR2: a stream of (id, latency_s): a page is ready when its marker, written last, is there."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", f"*.{suffix}").load(path)
    return raw.select(stem(F.col("_metadata.file_path")).alias("id"), F.trim("value").cast("double").alias("latency_s"))


def join_outputs(batch: DataFrame, outputs: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, ref, hyp, latency_s) of a batch of ready pages; a marker without an output is an empty output."""
    return batch.join(outputs, "id", "left").join(refs, "id").select("id", "ref", F.coalesce("hyp", F.lit("")).alias("hyp"), "latency_s")


def score_live(ready: DataFrame, outputs, refs: DataFrame, table: SnapshotTable, checkpoint: str, poll: str | None = None, model: str = "") -> StreamingQuery:
    """STR1, STR4: each micro-batch scores the pages that are new and merges them into the table's rows, one for each page.

    outputs: a function that reads the outputs as they are now. poll: seconds between batches; None takes
    what is there and ends. model: scores become columns ``<model>_<score>``, so several models' streams fill one
    row, one stream at a time. A batch that is run again changes nothing, a page that is scored again its own columns.
    Of two markers of a page in one batch the longer time counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max("latency_s").alias("latency_s"))
        scored = score(join_outputs(last, outputs(), refs))
        if model:
            scored = scored.select("id", *(F.col(c).alias(f"{model}_{c}") for c in scored.columns if c != "id"))
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # a new checkpoint counts its batches anew
        table.upsert(scored, writer=f"{model}:{query}", batch=number)

    writer = ready.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


def refresh(table: SnapshotTable, batch: DataFrame, key: str = "id") -> None:
    """U3 on a stored table: the batch's rows over those of the same ids."""
    table.upsert(batch, key, whole=True)


def finished(started: bool, generator_done: bool, ready: DataFrame, scored: DataFrame) -> bool:
    """STR3: the generator has begun and ended, and no ready page lacks a score."""
    return started and generator_done and ready.join(scored.select("id"), "id", "left_anti").isEmpty()


def resume_plan(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """STR5: what each page still needs: an output, metrics for a kept output, or nothing."""
    rows = pages.join(cache.select("id", "hyp", "cer", "compile_checked"), "id", "left")
    need = F.when(F.col("hyp").isNull(), "generate").when(F.col("cer").isNull() | ~F.coalesce("compile_checked", F.lit(False)), "metrics").otherwise("done")
    return rows.select("id", need.alias("need"))


def changes(events: DataFrame, key: str, state: str, forget_s: int | None = None) -> DataFrame:
    """STR6 on a table or stream of (key, state, ord): the rows whose state differs from the one before; null is a state of its own, and the first row of a key is a change.

    On a stream, each key's last state is kept, until it expires where forget_s is given (stateful.changes); on a table rows are scanned in
    order, whatever the share of one key.
    """
    if events.isStreaming:
        return stateful.changes(events, key, state, forget_s)
    return scan(events, key, ["ord"], {"_b": Differs(state)}).where("_b").drop("_b")


def stop_all(spark: SparkSession) -> None:
    """STR7"""
    for q in spark.streams.active:
        q.stop()


def liveness(heartbeats: DataFrame, now, seconds: int = 180) -> DataFrame:
    """STR8 on a table: whether each source was heard within so many seconds; stateful.liveness tells it on a stream."""
    return heartbeats.groupBy("source").agg(F.max("at").alias("last_at")).withColumn("alive", F.lit(now).cast("double") - F.col("last_at").cast("double") < seconds)


def idle_sessions(events: DataFrame, key: str, at: str, grace: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """STR9: work until it pauses for the grace; on a stream a session is out once its gap is behind the watermark."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.session_window(at, grace), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Pause:
    """STR10: a pause that all calls of the driver share; stateful.pauses is that of a stream."""

    def __init__(self):
        self.until, self.step = 0.0, 0

    def hit(self, now: float) -> float:
        self.step = min(self.step + 1, stateful.MOST_STRIKES)
        self.until = now + stateful.pause_s(self.step)
        return self.until

    def clear(self) -> None:
        self.until, self.step = 0.0, 0


def pauses(outcomes: DataFrame, key: str, limited: str, order: list[str]) -> DataFrame:
    """STR10 on a table: outcomes with strikes (in a row, at most four) and pause_s, the seconds of the pause that each begins; null where none does."""
    out = scan(outcomes, key, order, {"strikes": Strikes(limited, stateful.MOST_STRIKES)})
    seconds = F.least(stateful.FIRST_PAUSE_S * F.pow(F.lit(2.0), F.col("strikes") - 1), F.lit(float(stateful.MOST_PAUSE_S)))
    return out.withColumn("pause_s", F.when(F.col(limited) & (F.col("strikes") > 0), seconds))
