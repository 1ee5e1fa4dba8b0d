"""Plug-in calls as columns: each row's call has a time limit, and its outcome is data.

A task runs the calls of its rows in a child process. A call that takes too long is ended with its
child, and the next row gets a new one, so nothing hangs on; a call that fails gives its reason. Calls that
wait for something else than the processor can be ``together``: while some wait, the next rows go on. Values,
reasons and seconds are columns; totals of all tasks are in accumulators.
"""

from __future__ import annotations

import contextlib
import multiprocessing as mp
import time
from collections.abc import Callable, Iterator
from multiprocessing import connection

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REASON = "reason"
ENDED = "the call's process ended"


class Timings:
    """Totals over the tasks of one or more runs: calls, seconds, timeouts and failures. A task that Spark
    runs again counts again."""

    def __init__(self, spark: SparkSession):
        count = spark.sparkContext.accumulator
        self.calls, self.timeouts, self.failures, self.seconds = count(0), count(0), count(0), count(0.0)

    def values(self) -> dict[str, float]:
        return {k: v.value for k, v in vars(self).items()}


def _serve(call: Callable, pipe) -> None:
    while True:
        try:
            args = pipe.recv()
        except EOFError:
            return
        try:
            pipe.send((call(*args), None))
        except Exception as e:
            pipe.send((None, f"{type(e).__name__}: {e}"))


class LimitedCaller:
    """call(*args) in a child process, within so many seconds: (value, reason, seconds)."""

    def __init__(self, call: Callable, limit: float):
        self.call, self.limit, self.child, self.pipe = call, limit, None, None

    def _start(self) -> None:
        context = mp.get_context("fork")
        self.pipe, other = context.Pipe()
        self.child = context.Process(target=_serve, args=(self.call, other), daemon=True)
        self.child.start()
        other.close()

    def send(self, args: tuple) -> bool:
        """Hand a call to the child; False if it could not be handed over."""
        if self.child is None:
            self._start()
        try:
            self.pipe.send(args)
        except OSError:
            self.close()
            return False
        return True

    def receive(self) -> tuple:
        """(value, reason) of a call that has ended."""
        try:
            return self.pipe.recv()
        except (EOFError, OSError):
            self.close()
            return None, ENDED

    def __call__(self, *args):
        if self.child is None:
            self._start()
        began = time.perf_counter()
        try:
            self.pipe.send(args)
            if self.pipe.poll(self.limit):
                value, reason = self.pipe.recv()
                return value, reason, time.perf_counter() - began
            reason = f"timeout after {self.limit:g} s"
        except (EOFError, OSError):  # the call ended its own process
            reason = ENDED
        seconds = time.perf_counter() - began
        self.close()
        return None, reason, seconds

    def close(self) -> None:
        if self.child is not None:
            self.pipe.close()
            self.child.kill()
            self.child.join()
            self.child = None


class Together:
    """Calls of rows in order, up to ``most`` at once, each within its limit: (value, reason, seconds) of each. Another
    child is taken only if none that is there answers within a share of the limit, so quick calls have one child."""

    PATIENCE = 0.02

    def __init__(self, call: Callable, limit: float, most: int):
        self.limit, self.callers = limit, [LimitedCaller(call, limit) for _ in range(most)]

    def run(self, rows: list[tuple]) -> list[tuple]:
        out: list = [None] * len(rows)
        idle, busy, at = self.callers[::-1], {}, 0  # pipe -> (caller, row, since)
        while at < len(rows) or busy:
            if at < len(rows) and idle:
                caller = idle.pop()
                began = time.perf_counter()
                if caller.send(rows[at]):
                    busy[caller.pipe] = (caller, at, began)
                else:
                    out[at] = (None, ENDED, time.perf_counter() - began)
                    idle.append(caller)
                at += 1
            now = time.perf_counter()
            wait = max(0.0, min((since for _, _, since in busy.values()), default=now) + self.limit - now)
            if at < len(rows) and idle:
                wait = min(wait, self.limit * self.PATIENCE)
            for pipe in connection.wait(list(busy), wait):
                caller, row, since = busy.pop(pipe)
                out[row] = (*caller.receive(), time.perf_counter() - since)
                idle.append(caller)  # taken first, as it is there
            now = time.perf_counter()
            for pipe, (caller, row, since) in list(busy.items()):
                if now - since >= self.limit and not pipe.poll(0):
                    out[row] = (None, f"timeout after {self.limit:g} s", now - since)
                    caller.close()
                    del busy[pipe]
                    idle.insert(0, caller)
        return out

    def close(self) -> None:
        for caller in self.callers:
            caller.close()


def with_calls(df: DataFrame, call: Callable, inputs: list[str], limit: float, kind: str = "string", out: str = "value", timings: Timings | None = None, together: int = 1) -> DataFrame:
    """df with ``out`` (what call(*inputs) gives for the row, as ``kind``), ``reason`` (null, or why there is no
    value) and ``seconds``. Rows go on in order; a column of df with one of these names is replaced. Up to ``together``
    calls of a task wait at once; for calls that compute, 1 is right, as they would take each other's time."""
    made = [out, REASON, "seconds"]
    kept = [c for c in df.columns if c not in made]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T._parse_datatype_string(kind)), T.StructField(REASON, T.StringType()), T.StructField("seconds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        value_type = to_arrow_type(schema[out].dataType)
        with contextlib.closing(Together(call, limit, together)) as callers:
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)) if inputs else [()] * batch.num_rows
                found = callers.run(rows)
                if timings:
                    timings.calls.add(len(found))
                    timings.seconds.add(sum(s for _, _, s in found))
                    timings.timeouts.add(sum(bool(r) and r.startswith("timeout") for _, r, _ in found))
                    timings.failures.add(sum(bool(r) and not r.startswith("timeout") for _, r, _ in found))
                values, reasons, seconds = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(values, value_type), pa.array(reasons, pa.string()), pa.array(seconds, pa.float64())], [*kept, *made])

    return df.mapInArrow(run, schema)
