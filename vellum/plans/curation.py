"""ORC1 and ORC10: the ten stages from page images to splits, as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions import arrays, images
from vellum.functions import text as X
from vellum.operators import relational, windows
from vellum.plans.stages import Config, Run, validate

Tables = dict[str, DataFrame]
PROMPT = "Transcribe."


def crop(t: Tables, c: Config) -> DataFrame:
    return images.cropped_pages(t[c.source], c.crop_percent)


def filter_blank(t: Tables, c: Config) -> Tables:
    """Pages of which more than so many percent are dark go on, the others are set aside."""
    rows = t["crop"].withColumn("dark", images.dark_percent(c.dark_threshold)("data", "height", "width"))
    return {name: rows.where(test).drop("dark") for name, test in (("filter", F.col("dark") > c.max_dark_percent), ("filter_rejected", F.col("dark") <= c.max_dark_percent))}


def deskew(t: Tables, c: Config) -> DataFrame:
    return images.straight_pages(t["filter"])


def convert(t: Tables, c: Config) -> DataFrame:
    return images.encoded_pages(t["deskew"], c.max_side)


def prepare(t: Tables, c: Config) -> Tables:
    """Pages get the numbers behind those of the manifest; its old entries stay."""
    pages = t["convert"].withColumnRenamed("id", "name")
    known = t.get("manifest_before")
    if known is None:
        known = pages.select("name", F.lit(0).cast("long").alias("num")).limit(0)
    manifest = known.select("name", "num", windows.page_id(F.col("num")).alias("id")).unionByName(windows.manifest_ids(pages.select("name"), known))
    return {"manifest": manifest, "prepare": pages.join(manifest.select("name", "id"), "name")}


def annotate(annotator: Callable[[DataFrame], DataFrame]) -> Callable[[Tables, Config], Tables]:
    """annotator: from (id, png) to (id, answer); only valid answers go on, others are kept as they came."""

    def stage(t: Tables, c: Config) -> Tables:
        todo = t["prepare"].select("id", "png")
        if "annotate_before" in t:
            todo = relational.pending(todo, t["annotate_before"])
        rows = annotator(todo).withColumn("latex", X.clean_response(F.col("answer")))
        ok = F.coalesce(relational.valid_response(F.col("latex")), F.lit(False))
        done = rows.where(ok).select("id", "latex")
        if "annotate_before" in t:
            done = t["annotate_before"].select("id", "latex").unionByName(done)
        return {"annotate": done, "annotate_invalid": rows.where(~ok).select("id", "answer")}

    return stage


def review(t: Tables, c: Config) -> Tables:
    flags = relational.flagged(t["annotate"])
    return {"review_issues": flags, "review": t["annotate"].join(flags.where("passed").select("id"), "id", "left_semi")}


def validated(t: Tables, c: Config) -> DataFrame:
    return validate(t["review"])


def build(t: Tables, c: Config) -> DataFrame:
    """A sample for each page that is valid or was repaired, isn't excluded and has an image."""
    rows = t["validate"].where(F.col("status").isin("PASS", "FIXED")).select("id", F.col("validated").alias("latex"))
    if "excluded" in t:
        rows = relational.without(rows, t["excluded"])
    rows = rows.join(t["prepare"].select("id"), "id", "left_semi").where(relational.skip_reason(F.col("latex"), F.lit(False), F.lit(True)).isNull())
    return rows.select("id", arrays.conversation(PROMPT, F.col("latex")).alias("conversations"))


def split(t: Tables, c: Config) -> DataFrame:
    return windows.split_exact(t["build"], "id", c.train, c.val, c.seed)


def ten_stages(annotator: Callable[[DataFrame], DataFrame], config: Config | None = None) -> Run:
    """The run over a table of pages (id, height, width, data) named config.source."""
    c = config or Config()
    relational.check_config(c.dark_threshold, c.crop_percent, (c.train, c.val))
    stages = {"crop": crop, "filter": filter_blank, "deskew": deskew, "convert": convert, "prepare": prepare, "annotate": annotate(annotator), "review": review, "validate": validated, "build": build, "split": split}
    return Run({name: (lambda t, f=f: f(t, c)) for name, f in stages.items()})


def resume_from(t: Tables, source: str = "source") -> DataFrame:
    """JOI10 over the tables that are there: where a run goes on."""

    def ids(name: str, column: str = "id") -> DataFrame:
        return t[name].select(F.col(column).alias("id")) if name in t else t[source].select("id").limit(0)

    steps = [
        ("crop", ids(source), [ids("crop")]),
        ("filter", ids("crop"), [ids("filter"), ids("filter_rejected")]),
        ("deskew", ids("filter"), [ids("deskew")]),
        ("convert", ids("deskew"), [ids("convert")]),
        ("prepare", ids("convert"), [ids("manifest", "name")]),
        ("annotate", ids("prepare"), [ids("annotate")]),
    ]
    return relational.resume_stage(steps)


def prefix_batch(pages: DataFrame, prefix: str, config: Config | None = None) -> Tables:
    """ORC10: the four raster stages over the pages whose id begins with a prefix; the cluster's tasks are its workers."""
    run = ten_stages(lambda rows: rows, config)
    run.stages = {k: run.stages[k] for k in ("crop", "filter", "deskew", "convert")}
    return run.go({(config or Config()).source: pages.where(F.startswith("id", F.lit(prefix)))}, fail_fast=True)
