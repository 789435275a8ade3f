"""SRC16: rows through a remote service: bounded requests in flight, retries by the class of the error, pauses, no row lost.

Each task builds its client once and keeps at most ``in_flight`` calls going, in threads, as they wait and don't compute; results
come in the order of the rows, in parts of PART_ROWS, so memory is a batch of Arrow and PART_ROWS rows as objects. An error whose class is
``backoff`` makes the whole task pause (longer each time in a row) and doesn't count as a failure, until ``most_pauses`` of a row;
a ``fatal`` one ends the task's calls, and its other rows are aborted; any other is tried again up to ``retries`` calls. Every row comes out, with a
status: success, failed, fatal or aborted, the calls made and the last error. Rows that aren't a success are the dead letters.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import error_class_of

#: Rows that are Python objects at once and go back together.
PART_ROWS = 256


@dataclass(frozen=True)
class Policy:
    """How calls are repeated. wait_s: between calls that failed; first_pause_s: a first pause, doubled each time in a row up to five times itself."""

    in_flight: int = 8
    retries: int = 3
    wait_s: float = 2.0
    first_pause_s: float = 60.0
    most_pauses: int = 20


class _Task:
    """What the threads of one task share: the pause and the fatal error."""

    def __init__(self, policy: Policy, sleep: Callable[[float], None]):
        self.policy, self.sleep = policy, sleep
        self.lock, self.strikes, self.until, self.fatal = threading.Lock(), 0, 0.0, None

    def wait(self) -> bool:
        """Waits while the task pauses; whether calls may go on."""
        while self.fatal is None:
            with self.lock:
                left = self.until - time.monotonic()
            if left <= 0:
                return True
            self.sleep(min(left, 1.0))
        return False

    def turned_away(self) -> None:
        with self.lock:
            if time.monotonic() >= self.until:  # others that fail during a pause don't make it longer
                self.strikes = min(self.strikes + 1, 4)
                self.until = time.monotonic() + min(self.policy.first_pause_s * 2 ** (self.strikes - 1), 5 * self.policy.first_pause_s)

    def one(self, call: Callable[[dict], dict], row: dict) -> tuple[dict | None, str, int, str | None]:
        """(answer, status, calls, last error) of a row."""
        calls, failed, pauses, error = 0, 0, 0, None
        while self.wait():
            calls += 1
            try:
                answer = call(row)
            except Exception as e:  # noqa: BLE001  whatever a client raises is this row's own
                error = str(e) or type(e).__name__
                kind = error_class_of(error)
                if kind == "fatal":
                    self.fatal = error
                    return None, "fatal", calls, error
                if kind == "backoff" and pauses < self.policy.most_pauses:
                    pauses += 1
                    self.turned_away()
                    continue
                failed += 1
                if failed >= self.policy.retries or kind == "backoff":
                    return None, "failed", calls, error
                self.sleep(self.policy.wait_s)
            else:
                with self.lock:
                    self.strikes = 0
                return answer, "success", calls, None
        return None, "aborted", calls, error or self.fatal


def answers(batches, client: Callable, policy: Policy, sleep: Callable[[float], None], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's rows with their answers, PART_ROWS at a time."""
    task, ask = _Task(policy, sleep), client()
    with ThreadPoolExecutor(policy.in_flight) as pool:
        for whole in batches:
            for lo in range(0, whole.num_rows, PART_ROWS):
                flying: deque = deque()
                out = []

                def land(flying=flying, out=out):
                    row, future = flying.popleft()
                    found, status, calls, error = future.result()
                    out.append(row | {c: (found or {}).get(c) for c in names} | {"status": status, "attempts": calls, "error": error})

                for row in whole.slice(lo, PART_ROWS).to_pylist():
                    if len(flying) >= policy.in_flight:
                        land()
                    flying.append((row, pool.submit(task.one, ask, row)))
                while flying:
                    land()
                yield pa.RecordBatch.from_pylist(out, schema)


def call(rows: DataFrame, answer: str, client: Callable[[], Callable[[dict], dict]], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows with the columns of answer (a schema), status, attempts and error. client: built once a task; it maps a row to its answer, or raises.

    A column of rows that is named like one of these is replaced. A task that is run again calls again for its rows.
    """
    told = T.StructType.fromDDL(answer)
    extra = [*told.names, "status", "attempts", "error"]
    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in extra))
    schema = T.StructType([*kept.schema.fields, *told.fields, T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    return kept.mapInArrow(lambda batches: answers(batches, client, policy, sleep, told.names, arrow), schema)


def dead_letters(results: DataFrame) -> DataFrame:
    """The rows that have no answer, to be called again or looked at."""
    return results.where("status <> 'success'")
