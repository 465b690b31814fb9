"""Structured Streaming forms: incremental evaluation of a folder of tasks, and conversation memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from evalloom.operators import summary
from evalloom.sources import tables

MESSAGE = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def stream_evaluate(spark: SparkSession, tasks_dir: str, evaluate: Callable[[DataFrame], DataFrame], root: str, run_id: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Evaluates the task files of a folder batch by batch, into the run that `tables` reads like any other.

    evaluate: a batch of tasks -> flat result rows (see `summary`). Each batch brings its outputs, traces, its part of the summary and the summary of all parts so far in one version of the run, so
    that a reader finds them in step after any batch; a batch that is tried again replaces itself. Files that come late are a later batch. The checkpoint resumes after a stop."""

    def one(batch: DataFrame, number: int) -> None:
        where = tables.scratch(spark)
        rows = tables.kept_at(evaluate(batch).withColumn("run_id", F.lit(run_id)), where)
        if not rows.isEmpty():
            tables.add_batch(rows, summary.traces(rows), summary.summary_parts(rows), summary.summary_of_parts, root, run_id, number)
        tables.forget(spark, where)

    source = spark.readStream.schema(tables.TASKS).option("maxFilesPerTrigger", files_per_batch).json(tasks_dir)
    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HISTORY = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("history", MESSAGE)])
TURN = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


class Memory(StatefulProcessor):
    """A conversation's last turns that were given out, and those that wait for an earlier one.

    A turn is given out once the turn before it was, the first being `first`. A conversation is forgotten when the watermark has passed its last arrival by `idle` milliseconds: turns that still wait are given out then, in
    their order, and its state ends. Of turns with one number the first to arrive counts, and a turn whose number was given out is dropped."""

    def __init__(self, most: int, idle: int, first: int):
        self.most, self.idle, self.first = most, idle, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", TURN)
        self.waiting = handle.getMapState("waiting", T.StructType([TURN["turn"]]), T.StructType([TURN["role"], TURN["text"]]))
        self.next = handle.getValueState("next", T.StructType([TURN["turn"]]))

    def _given(self, key: tuple, turns: list[tuple]) -> pd.DataFrame:
        """The rows of turns that come next, and the memory after them."""
        said, out = [tuple(x) for x in self.said.get()], []
        for turn, role, text in turns:
            out.append((key[0], turn, role, text, [{"role": r, "content": t} for _, r, t in said]))
            said = [*said, (turn, role, text)][-self.most :] if self.most else []
        self.said.clear()
        if said:
            self.said.put(said)
        return pd.DataFrame(out, columns=[f.name for f in HISTORY.fields])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.next.get()[0] if self.next.exists() else self.first
        latest = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            latest = max(latest, int(frame["at"].max().timestamp() * 1000))
            for r in frame.itertuples():
                if r.turn >= due and not self.waiting.containsKey((r.turn,)):
                    self.waiting.updateValue((int(r.turn),), (r.role, r.text))
        ready = []
        while self.waiting.containsKey((due,)):
            ready.append((due, *self.waiting.getValue((due,))))
            self.waiting.removeKey((due,))
            due += 1
        self.next.update((due,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(latest + self.idle)
        yield self._given(key, ready)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        left = sorted((k[0], *v) for k, v in self.waiting.iterator())
        out = self._given(key, left)
        for state in (self.said, self.waiting, self.next):
            state.clear()
        yield out

    def close(self) -> None:
        pass


def stream_history(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, max_history: int = 5, idle: str = "1 hour", late: str = "10 minutes", first: int = 0, files_per_batch: int = 1) -> StreamingQuery:
    """conv_id, turn, role, text, at (timestamp) files -> the same without at, with history: the last 2 * max_history messages, as `summary.with_history` gives them, in whatever order turns arrive.

    A turn waits for the one before it. idle: a conversation without arrivals for so long (by the watermark, which lags the latest time by `late`) ends, and what waits is given out. State of a conversation:
    2 * max_history messages, and those that wait. The session needs the RocksDB state store."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).withWatermark("at", late)
    done = rows.groupBy("conv_id").transformWithStateInPandas(Memory(2 * max_history, idle_ms, first), HISTORY, "append", "eventTime")
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
