"""A ledger of model calls: what a model once answered is not asked again, by any stage, run or batch.

An entry's key is a hash of the model's name, the prompt, the temperature and the limit of tokens. `Ledger.call` has the signature of `judging.call_model`: equal prompts are asked once,
prompts with an entry not at all, and the others in waves of `wave` prompts, each committed before the next is asked; so a job that dies loses the answers of one wave at most. Errors are given back but
not kept. If two writers ask the same at once, the earlier answer counts for all readers. Rows get their answers by a join on the key; a prompt that many rows share is one entry, and its rows can be split.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Set
from .tables import forget, kept_at, scratch

ENTRY = "key string, response string, begun timestamp, ended timestamp, nonce string"
WAVE = 100_000


class Ledger(NamedTuple):
    """path: of the ledger; model: names what `call` asks, so that different models don't answer for each other."""

    spark: SparkSession
    path: str
    model: str
    wave: int = WAVE

    def key(self, prompt: Column, temperature: float, max_tokens: int) -> Column:
        parts = F.array(F.lit(self.model), F.lit(repr(float(temperature))), F.lit(str(max_tokens)), prompt)
        return F.when(prompt.isNotNull(), F.sha2(F.to_json(parts), 256))

    def entries(self) -> DataFrame:
        """One entry for each key: of several the earliest."""
        store = Set(self.spark, self.path)
        rows = store.read("entries") if store.tables() else self.spark.createDataFrame([], ENTRY)
        first = F.min(F.struct("ended", "nonce", "response", "begun")).alias("x")
        return rows.groupBy("key").agg(first).select("key", "x.response", "x.begun", "x.ended")

    def call(self, df: DataFrame, fn: Callable, prompt: str = "prompt", temperature: float = 0.1, max_tokens: int = 500, batch_size: int = 32, out: str = "response", times: tuple[str, str] | None = None) -> DataFrame:
        """As `judging.call_model`; times are those of the call that was made, in whichever run. The result may be read again: it asks nothing."""
        from evalloom.operators.judging import call_model

        base = df.drop(out, "error", *(times or ()))
        keyed = base.withColumn("_key", self.key(F.col(prompt), temperature, max_tokens))
        asked = keyed.filter("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.first(prompt).alias("prompt"))
        path = scratch(self.spark)
        todo = kept_at(asked.join(self.entries().select("key"), "key", "left_anti"), path)
        waves, store, failed = math.ceil(todo.count() / self.wave), Set(self.spark, self.path), None
        for i in range(waves):
            some = todo.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == i)
            got_path = scratch(self.spark)
            got = kept_at(call_model(some, fn, "prompt", temperature, max_tokens, batch_size, times=("begun", "ended")), got_path)
            store.commit(add={"entries": got.filter("error is null and response is not null").select("key", "response", "begun", "ended", F.uuid().alias("nonce"))})
            bad = got.filter("error is not null or response is null").select("key", "error", "begun", "ended")
            if bad.isEmpty():
                forget(self.spark, got_path)
            else:
                failed = bad if failed is None else failed.unionByName(bad)
        forget(self.spark, path)
        answers = self.entries().withColumn("error", F.lit(None).cast("string"))
        if failed is not None:  # their keys have no entry
            answers = answers.unionByName(failed.withColumn("response", F.lit(None).cast("string")))
        fields = ["response", "error", "begun", "ended"]
        rows = keyed.join(answers.select(F.col("key").alias("_key"), F.struct(*fields).alias("_answer")), "_key", "left")
        return rows.select(*(F.col(f"`{c}`") for c in base.columns), *(F.col("_answer")[f].alias(n) for f, n in zip(fields, [out, "error", *(times or ())], strict=False)))
