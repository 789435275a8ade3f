"""The curation stages, their runner, and the state machine of validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.metrics import structure_ok
from vellum.operators.lineage import cut_lineage



@dataclass(frozen=True)
class Config:
    """ARR10: the defaults of a run. What a field is good for stands beside it; the last ones are read by connectors and schedulers only."""

    source: str = "source"  # the table of pages to begin with
    crop_percent: float = 10.0
    dark_threshold: int = 210
    max_dark_percent: float = 0.5
    max_side: int = 2048
    train: float = 0.90
    val: float = 0.05
    seed: int = 42
    endpoint: str = ""  # of the model that annotates
    model: str = ""
    max_tokens: int = 8192
    temperature: float = 0.1
    retries: int = 3
    delay: float = 0.0
    annotate_workers: int = 8
    cpu_workers: int = 0  # 0: as many as the cluster has
    validate_workers: int = 4
    most_keys: int = 0  # 0: no limit


def written(df: DataFrame) -> DataFrame:
    """A stage's table, computed now and kept in the shared folder: what fails, fails here, and later stages don't compute it again."""
    return cut_lineage(df)


@dataclass
class Run:
    """ORC2: stages in order; one that fails doesn't stop the later ones unless asked for.

    A stage gives a table or several by name; each is written when its stage runs, so a failure at run time is that
    stage's own. keep: how tables are written.
    """

    stages: dict[str, Callable[[dict[str, DataFrame]], DataFrame | dict[str, DataFrame]]]
    status: dict[str, str] = field(default_factory=dict)
    keep: Callable[[DataFrame], DataFrame] = written

    def run_stage(self, name: str, tables: dict[str, DataFrame]) -> dict:
        """What a stage gives, by name; its tables are written."""
        made = self.stages[name](tables)
        return {k: self.keep(v) if isinstance(v, DataFrame) else v for k, v in (made if isinstance(made, dict) else {name: made}).items()}

    def go(self, tables: dict[str, DataFrame], start_from: str | None = None, fail_fast: bool = False, stop: Callable[[], bool] = lambda: False) -> dict[str, DataFrame]:
        names = list(self.stages)
        for name in names[names.index(start_from) if start_from else 0 :]:
            if stop():
                self.status[name] = "stopped"
                break
            try:
                tables.update(self.run_stage(name, tables))
                self.status[name] = "done"
            except Exception as e:
                self.status[name] = f"failed: {e}"
                if fail_fast:
                    raise
        return tables


def stub_compiler(c: Column) -> Column:
    """MET17's stand-in where no compiler is installed: structure, and no sign of truncation."""
    return structure_ok(c) & ~X.looks_truncated(c, 2)


def validate(rows: DataFrame, text: str = "latex", compiler: Callable[[Column], Column] | None = stub_compiler) -> DataFrame:
    """ORC3: TRUNCATED, PASS, FIXED after repair, FAIL; SKIP without a compiler."""
    c = F.col(text)
    if compiler is None:
        return rows.withColumns({"status": F.when(X.looks_truncated(c, 2), "TRUNCATED").otherwise("SKIP"), "validated": c})

    def told(status: str, latex: Column) -> Column:
        return F.struct(F.lit(status).alias("status"), latex.alias("validated"))

    def repaired(fixed):
        return F.when(compiler(fixed), told("FIXED", fixed)).otherwise(told("FAIL", c))

    # Only what neither breaks off nor compiles is repaired.
    judged = F.when(X.looks_truncated(c, 2), told("TRUNCATED", c)).when(compiler(c), told("PASS", c)).otherwise(X.let(X.auto_fix(c), repaired))
    return rows.withColumn("_v", judged).select(*rows.columns, "_v.status", "_v.validated")


def run_compiler(rows: DataFrame, command: Callable[[], Callable[[str], bool]], key: str = "id", text: str = "latex") -> DataFrame:
    """MET17 with an injected compiler, built once per task."""

    def work(frames):
        call = command()
        for f in frames:
            yield pd.DataFrame({"id": f[key], "compile_ok": [("\\documentclass" in t) and bool(call(t)) for t in f[text].fillna("")]})

    return rows.select(key, text).mapInPandas(work, f"{key} string, compile_ok boolean")


def evaluate(pairs_by_model: dict[str, DataFrame], scorer: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = written) -> tuple[DataFrame | None, dict[str, str]]:
    """ORC4: all models' scores; a model that fails, be it when its rows are computed, is left out and named. Pages that fail on their own: sources.files.isolated."""
    out, failed = None, {}
    for model, pairs in pairs_by_model.items():
        try:
            one = keep(scorer(pairs).withColumn("model", F.lit(model)))
        except Exception as e:
            failed[model] = str(e)
            continue
        out = one if out is None else out.unionByName(one)
    return out, failed


def review(rows: DataFrame, decisions: DataFrame, text: str = "latex") -> DataFrame:
    """ORC9: approved pages get the marker, edited ones their text, deleted ones go, others stay."""
    d = rows.join(decisions.select("id", "decision", "edited"), "id", "left")
    new = F.when(F.col("decision") == "approve", F.concat(F.col(text), F.lit("\n" + X.REVIEWED))).when(F.col("decision") == "edit", F.col("edited")).otherwise(F.col(text))
    return d.where(~F.coalesce(F.col("decision") == "delete", F.lit(False))).withColumn(text, new).drop("decision", "edited")


def dry_run(rows: DataFrame, generate: Callable[[DataFrame], DataFrame], n: int, order: str = "id") -> DataFrame:
    """ORC8: the first n pages without what was annotated before, generated anew; success, invalid or failed. AGG8 projects the rest from it."""
    from vellum.operators.relational import valid_response

    done = generate(rows.drop("latex").orderBy(order).limit(n))
    return done.withColumn("status", F.when(F.col("latex").isNull(), "failed").when(valid_response(F.col("latex")), "success").otherwise("invalid"))


def register_functions(spark) -> None:
    """ORC5: the sequence metrics as SQL functions over arrays of strings, a batch of rows at a time; null is an empty sequence."""
    from vellum.functions import metrics as M

    def over(f):
        def batch(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f([] if x is None else x.tolist(), [] if y is None else y.tolist()) for x, y in zip(a, b, strict=True)], dtype="int32")

        return F.pandas_udf(batch, "int")

    spark.udf.register("token_edit_distance", over(M.edit_distance))
    spark.udf.register("lcs_length", over(M.lcs_length))
