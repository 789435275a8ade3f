"""ORC2 and JOI10: runs that are kept: after a crash, or when something changed, only what must be is computed again.

A ledger in the run's folder holds for each stage its status, what it read and gave, and fingerprints of these tables. A
stage whose version and whose inputs' fingerprints are those of its last good run isn't run: its tables are read. What a stage
reads is seen as it looks into the tables. Failures are kept too, so the status outlives the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.plans.stages import Run
from vellum.sources.snapshots import SnapshotTable

_SCHEMA = "stage string, version string, status string, error string, reads string, gave string, n_rows long"


class _Seen(dict):
    """Tables that remember which of them were looked for."""

    def __init__(self, tables: dict):
        super().__init__(tables)
        self.names: set[str] = set()

    def __getitem__(self, name):
        self.names.add(name)
        return super().__getitem__(name)

    def __contains__(self, name):
        self.names.add(name)
        return super().__contains__(name)

    def get(self, name, default=None):
        self.names.add(name)
        return super().get(name, default)


def fingerprint(df: DataFrame) -> tuple[str, int]:
    """(digest of the schema and the rows, whatever their order, and their number): one pass, no shuffle of rows."""
    row = F.xxhash64(*(F.col(f"`{c}`") if t[:3] != "map" else F.to_json(f"`{c}`") for c, t in df.dtypes))
    n, xor, low = df.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(F.pmod(row, F.lit((1 << 31) - 1))), F.lit(0))).first()
    return f"{df.schema.simpleString()}|{n}|{xor}|{low}", n


@dataclass
class ResumableRun(Run):
    """A run whose tables and ledger are in a folder that driver and executors share. version: of the code and its settings; another one runs all stages again."""

    folder: str = ""
    version: str = ""

    def _ledger(self, spark: SparkSession) -> SnapshotTable:
        return SnapshotTable(spark, f"{self.folder}/ledger")

    def ledger(self) -> DataFrame:
        """(stage, version, status, error, reads, gave, n_rows): one row a stage."""
        return self._ledger(SparkSession.active()).read()

    def _last(self, spark: SparkSession) -> dict:
        table = self._ledger(spark)
        return {r.stage: r.asDict() for r in table.read().collect()} if table.current() else {}  # one row a stage

    def _note(self, spark: SparkSession, name: str, **what) -> None:
        row = {"stage": name, "version": self.version, "error": None, "reads": "{}", "gave": "{}", "n_rows": None} | what
        table = self._ledger(spark)
        table.upsert(spark.createDataFrame([tuple(row[f.split()[0]] for f in _SCHEMA.split(", "))], _SCHEMA), key="stage", buckets=1)
        table.vacuum(keep=2)

    def go(self, tables: dict, start_from: str | None = None, **rest) -> dict:
        """As Run.go. start_from: this stage and the later ones are run in any case, on what the ledger has of those before."""
        spark = SparkSession.active()
        self._known, self._marks, self._forced = self._last(spark), {}, set()
        if start_from:
            names = list(self.stages)
            self._forced = set(names[names.index(start_from) :])
        return super().go(tables, **rest)

    def _mark(self, name: str, tables: dict) -> str | None:
        if not dict.__contains__(tables, name):
            return None
        df = dict.__getitem__(tables, name)
        if not isinstance(df, DataFrame):
            return repr(df)
        if name not in self._marks:
            self._marks[name] = fingerprint(df)[0]
        return self._marks[name]

    def run_stage(self, name: str, tables: dict) -> dict:
        spark, last = SparkSession.active(), self._known.get(name)
        if last and last["status"] == "done" and last["version"] == self.version and name not in self._forced:
            reads, gave = json.loads(last["reads"]), json.loads(last["gave"])
            if all(self._mark(n, tables) == mark for n, mark in reads.items()):
                self._marks.update({k: mark for k, (_, mark) in gave.items()})
                return {k: spark.read.parquet(f"{self.folder}/{path}") for k, (path, _) in gave.items()}
        seen = _Seen(tables)
        try:
            made = self.stages[name](seen)
            out, gave, total = {}, {}, 0
            for k, v in (made if isinstance(made, dict) else {name: made}).items():
                if not isinstance(v, DataFrame):
                    out[k] = v
                    continue
                path = f"tables/{k}-{uuid.uuid4().hex}"
                v.write.parquet(f"{self.folder}/{path}")
                out[k] = spark.read.parquet(f"{self.folder}/{path}")
                self._marks[k], n = fingerprint(out[k])
                gave[k], total = (path, self._marks[k]), total + n
            whole = len(gave) == len(out)  # what isn't a table isn't kept, so such a stage runs each time
            self._note(spark, name, status="done" if whole else "unkept", reads=json.dumps({n: self._mark(n, tables) for n in sorted(seen.names)}), gave=json.dumps(gave), n_rows=total)
            return out
        except Exception as e:
            self._note(spark, name, status="failed", error=str(e)[:1000])
            raise
