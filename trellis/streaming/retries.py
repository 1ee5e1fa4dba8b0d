"""The retry controller as a stream: attempts at questions come in, decided questions go out.

The state of a question (attempts made, last feedback, outcome) is kept in the state store under its
key, so the controller survives a stop or the loss of an executor, holds any number of open questions
at once and never gathers them. A question is answered by its first attempt that passes, given up
after ``most`` attempts that do not, and expired when no attempt comes for ``patience``: a timer in
the state store tells that, when the watermark passes it.

``outcomes`` is a streaming DataFrame with a Python call for each question (some 2 ms and more each, by the
calls to the state store). ``decide_into`` decides the questions of a whole micro-batch with built-in
functions; its state is a table of one row a question, written anew by each micro-batch.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from trellis.session import children, deleted

OUT = "question string, attempts int, outcome string, feedback string, decided timestamp"
_STATE = "attempts int, feedback string, last long, decided boolean"


class Controller(StatefulProcessor):
    """Attempts (ts, passed, feedback) of a question, in order of ts, to at most one outcome."""

    def __init__(self, most: int, patience_ms: int):
        self.most, self.patience = most, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.question = handle, handle.getValueState("question", _STATE)

    def _decide(self, key, attempts: int, outcome: str, feedback: str | None, at: int) -> pd.DataFrame:
        self.question.update((attempts, feedback, at, True))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return pd.DataFrame({"question": [key[0]], "attempts": [attempts], "outcome": [outcome], "feedback": [feedback], "decided": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts, feedback, last, decided = self.question.get() or (0, None, None, False)
        if decided:  # what comes after the decision is not heard
            return
        for r in pd.concat(list(rows)).sort_values(["ts", "passed", "feedback"], kind="stable").itertuples():
            at = int(r.ts.value // 1_000_000)
            if last is not None and at - last > self.patience:
                yield self._decide(key, attempts, "expired", feedback, last + self.patience)
                return
            attempts, last = attempts + 1, at
            if r.passed:
                yield self._decide(key, attempts, "answered", None, at)
                return
            feedback = r.feedback
            if attempts == self.most:
                yield self._decide(key, attempts, "given up", feedback, at)
                return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.patience)
        self.question.update((attempts, feedback, last, False))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, feedback, last, decided = self.question.get()
        if not decided:
            yield self._decide(key, attempts, "expired", feedback, last + self.patience)

    def close(self) -> None:
        pass


def _usable(attempts: DataFrame) -> DataFrame:
    return attempts.select(F.coalesce("question", F.lit("")).alias("question"), "ts", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("feedback", F.lit("")).alias("feedback")).where("ts IS NOT NULL")


def outcomes(attempts: DataFrame, most: int = 3, patience_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """question, attempts, outcome, feedback and decided of the questions that are decided.

    attempts: question (string), ts, passed (null counts as not passed), feedback. Attempts of one time
    that fail come before one that passes. Start the stream within rocksdb_state()."""
    return _usable(attempts).withWatermark("ts", late).groupBy("question").transformWithStateInPandas(Controller(most, patience_ms), OUT, "Append", "EventTime")


@contextlib.contextmanager
def rocksdb_state(spark) -> Iterator[None]:
    """While it holds, streams that start keep their state in RocksDB, which timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


#: State of decide_into(): what is known of a question, and whether this micro-batch decided it.
_KNOWN = "struct<attempts: int, feedback: string, last: bigint, outcome: string, decided: bigint>"
_TABLE = f"question string, known {_KNOWN}, fresh boolean"


def decide_into(attempts: DataFrame, path: str, checkpoint: str, most: int = 3, patience_ms: int = 3_600_000, late_ms: int = 600_000) -> StreamingQuery:
    """Append the outcomes of outcomes() under ``path``, micro-batch by micro-batch: those of a batch are decided
    together. Attempts that come later than ``late_ms`` after the newest of the batches before are dropped, as a
    watermark does. A batch that is run again gives the same; the state of the last two batches stays."""

    def known(attempts_, feedback, last, outcome=None, decided=None):
        return F.struct(attempts_.cast("int"), feedback, last.cast("long"), F.lit(outcome).cast("string"), (F.lit(None) if decided is None else decided).cast("long")).cast(_KNOWN)

    def heard(s, r):
        at, made = F.unix_millis(r["ts"]), s["attempts"] + 1
        return (
            F.when(s["outcome"].isNotNull(), s)
            .when(at - s["last"] > patience_ms, known(s["attempts"], s["feedback"], s["last"], "expired", s["last"] + patience_ms))
            .when(r["passed"], known(made, F.lit(None).cast("string"), at, "answered", at))
            .when(made >= most, known(made, r["feedback"], at, "given up", at))
            .otherwise(known(made, r["feedback"], at))
        )

    def step(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, _usable(batch)
        earlier = [v for v in children(spark, f"{path}/state") if v < number]
        old, before = spark.createDataFrame([], _TABLE), None
        if earlier:
            old, before = spark.read.schema(_TABLE).parquet(f"{path}/state/v={max(earlier)}"), spark.read.schema("newest long").parquet(f"{path}/newest/v={max(earlier)}").first()[0]
        if before is not None:
            rows = rows.where(F.unix_micros("ts") > (before - late_ms) * 1000)
        newest = max((x for x in (before, batch.agg(F.unix_millis(F.max("ts"))).first()[0]) if x is not None), default=None)
        tries = rows.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("ts", "passed", "feedback"))).alias("tries"))
        both = old.drop("fresh").join(tries, "question", "full")
        none = F.lit(None)
        start = F.coalesce("known", known(F.lit(0), none.cast("string"), none))
        now = both.select("question", F.when(F.col("tries").isNull(), F.col("known")).otherwise(F.aggregate("tries", start, heard)).alias("new"), F.col("known.outcome").isNull().alias("open"))
        silent = F.col("new.outcome").isNull() & (F.col("new.last") + patience_ms <= F.lit(newest).cast("long") - late_ms)
        ended = known(F.col("new.attempts"), F.col("new.feedback"), F.col("new.last"), "expired", F.col("new.last") + patience_ms)
        made = now.select("question", F.when(silent, ended).otherwise(F.col("new")).alias("known"), "open")
        made.select("question", "known", (F.col("open") & F.col("known.outcome").isNotNull()).alias("fresh")).write.mode("overwrite").parquet(f"{path}/state/v={number}")
        spark.createDataFrame([(newest,)], "newest long").coalesce(1).write.mode("overwrite").parquet(f"{path}/newest/v={number}")
        fresh = spark.read.schema(_TABLE).parquet(f"{path}/state/v={number}").where("fresh")
        fresh.select("question", "known.attempts", "known.outcome", "known.feedback", F.timestamp_millis("known.decided").alias("decided")).write.mode("overwrite").parquet(f"{path}/out/v={number}")
        for v in sorted({*earlier, number})[:-2]:
            deleted(spark, f"{path}/state/v={v}", f"{path}/newest/v={v}")

    return attempts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_decided(spark, path: str) -> DataFrame:
    """What decide_into() has appended."""
    batches = [f"{path}/out/v={v}" for v in children(spark, f"{path}/out")]
    return spark.read.schema(OUT).parquet(*batches) if batches else spark.createDataFrame([], OUT)
