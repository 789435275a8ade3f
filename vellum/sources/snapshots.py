"""Tables of versions: a replace without a gap, and keyed upserts that rewrite only the buckets they touch.

A table is a folder. Data files go to ``data/<id>`` and are never changed. A version is one small file in ``versions``: the
schema, the folders that make up the table and the last batch of each writer, with a checksum behind it. It is created
under the next number, which fails if the number is there, and only after all its data: a reader takes the greatest version
that is whole, so at each moment it finds one whole table. Nothing is renamed, so object stores will do.

One writer at a time is meant; of two that race for a number one gets ``Conflict`` and may run again. A reader keeps its
version until ``vacuum`` drops it. Rows with a null key are one key. An empty table has its schema and no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a keyed table: an upsert rewrites whole buckets, so about a gigabyte each is a good size.
BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer took the version's number."""


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class SnapshotTable:
    """The table at a path. key and buckets hold for tables of upserts, and are kept from the first version on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """Numbers of all versions, the newest first, whole or not."""
        folder = self._Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _version(self, number: int) -> dict | None:
        """What a version holds; None where its file isn't whole or is gone."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.open(self._Path(f"{self.path}/versions/{number:020d}"))
            try:
                text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
            finally:
                stream.close()
        except Py4JJavaError:
            return None
        body, _, check = text.rpartition("\n")
        return json.loads(body) if check == hashlib.sha256(body.encode()).hexdigest() else None

    def current(self) -> dict | None:
        """The newest whole version: number, schema, key, buckets, parts, batches; None before the first."""
        return next((v for n in self._numbers() if (v := self._version(n)) is not None), None)

    def _commit(self, version: dict) -> None:
        from py4j.protocol import Py4JJavaError

        body = json.dumps(version, sort_keys=True)
        try:
            out = self._fs.create(self._Path(f"{self.path}/versions/{version['number']:020d}"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version['number']} of {self.path}") from e
            raise
        out.write(bytearray(f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode()))
        out.close()

    def _next(self, now: dict | None, **fields) -> dict:
        number = max(self._numbers(), default=0) + 1
        return {"key": None, "buckets": None, "batches": {}, **(now or {}), **fields, "number": number}

    def _frame(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, number: int | None = None) -> DataFrame:
        """The newest version, or the one of that number while it is kept."""
        now = self.current() if number is None else self._version(number)
        if now is None:
            raise FileNotFoundError(f"no such version of {self.path}")
        return self._frame(T.StructType.fromJson(now["schema"]), sorted(set(now["parts"].values())))

    def replace(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """A version of these rows alone; rows may be read from the table itself. The version's number."""
        now = self.current()
        if now and writer is not None and now["batches"].get(writer, -1) >= (batch or 0):
            return now["number"]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        if now and now["key"]:
            parts = self._write(rows, now["key"], now["buckets"])
        else:
            folder = f"data/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            parts = {"0": folder}
        batches = {**(now["batches"] if now else {}), **({writer: batch or 0} if writer is not None else {})}
        version = self._next(now, schema=schema.jsonValue(), parts=parts, batches=batches)
        self._commit(version)
        return version["number"]

    def _write(self, rows: DataFrame, key: str, buckets: int) -> dict[str, str]:
        """Writes rows by bucket; the folder of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(_BUCKET, _bucket(key, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/{folder}")) if s.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    def upsert(self, rows: DataFrame, key: str = "id", order: str | None = None, writer: str | None = None, batch: int | None = None, whole: bool = False, buckets: int = BUCKETS) -> int:
        """Merges rows by key and gives the version's number.

        Of a key that is there, the columns of rows take the new values, nulls too, and other columns stay (whole: they become
        null); new columns join the table, null elsewhere. Of several rows of a key the one with the greatest order counts (ties, or no order:
        the greatest row). Only buckets with such keys are read and written again. A batch number at or below the writer's last does nothing.
        """
        now = self.current()
        if now and writer is not None and now["batches"].get(writer, -1) >= (batch or 0):
            return now["number"]
        if now and now["key"] != key:
            raise ValueError(f"the table's key is {now['key']}")
        buckets = now["buckets"] if now else buckets
        new_names = [c for c in rows.columns if c != key]
        ranked = F.struct((F.col(order) if order else F.lit(0)).alias("o"), F.struct(*new_names).alias("r")) if new_names else F.lit(0)
        last = rows.groupBy(key).agg(F.max(ranked).alias("_r")).select(F.col(key), *(F.col(f"_r.r.{c}").alias(c) for c in new_names))
        old_schema = T.StructType.fromJson(now["schema"]) if now else T.StructType([rows.schema[key]])
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*old_schema, *(f for f in rows.schema if f.name not in old_schema.names)]])
        parts = dict(now["parts"]) if now else {}
        touched = [str(r[0]) for r in last.select(_bucket(key, buckets)).distinct().collect()]  # at most as many as buckets
        if now:
            old = self._frame(old_schema, sorted(parts[b] for b in touched if b in parts)).withColumn("_old", F.lit(True))
            a, b = old.alias("a"), last.withColumn("_new", F.lit(True)).alias("b")
            both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")

            def merged(name: str):
                if name == key:
                    return F.when(F.col("b._new"), F.col(f"b.{key}")).otherwise(F.col(f"a.{key}")).alias(key)
                theirs = F.col(f"a.{name}") if name in old_schema.names else F.lit(None)
                if name in new_names:
                    return F.when(F.col("b._new"), F.col(f"b.{name}")).otherwise(theirs).cast(schema[name].dataType).alias(name)
                return (F.when(F.col("b._new"), F.lit(None)).otherwise(theirs) if whole else theirs).cast(schema[name].dataType).alias(name)

            last = both.select(*(merged(n) for n in schema.names))
        parts.update(self._write(last, key, buckets))
        batches = {**(now["batches"] if now else {}), **({writer: batch or 0} if writer is not None else {})}
        version = self._next(now, schema=schema.jsonValue(), key=key, buckets=buckets, parts=parts, batches=batches)
        self._commit(version)
        return version["number"]

    def vacuum(self, keep: int = 2) -> None:
        """Drops all versions but the newest whole ones, and data that none of these holds; not while another writer works."""
        numbers, kept = self._numbers(), []
        for n in numbers:
            if len(kept) < keep and (v := self._version(n)) is not None:
                kept.append(v)
        whole = {v["number"] for v in kept}
        for n in numbers:
            if kept and n not in whole and n < kept[0]["number"]:
                self._fs.delete(self._Path(f"{self.path}/versions/{n:020d}"), False)
        held = {p.rstrip("/") for v in kept for p in v["parts"].values()}
        if not kept or not self._fs.exists(self._Path(f"{self.path}/data")):
            return
        for s in self._fs.listStatus(self._Path(f"{self.path}/data")):
            folder = f"data/{s.getPath().getName()}"
            if folder in held:
                continue
            inner = [x.getPath().getName() for x in self._fs.listStatus(s.getPath())]
            used = [x for x in inner if f"{folder}/{x}" in held]
            for x in ([None] if not used else [x for x in inner if x not in used]):
                self._fs.delete(self._Path(f"{self.path}/{folder}" + (f"/{x}" if x else "")), True)
