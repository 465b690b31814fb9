"""Reading and writing of corpora, tasks, embeddings, docstores and runs.

Parquet throughout, JSON lines for tasks. A run is a set of tables (outputs, metrics, traces, configs) below <root>/<run_id>, see `commits`: batch and streamed runs
have the same layout, and readers see the last complete version of each.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .commits import Set

TASKS = "example_id string, question string, reference_answer string, ground_truth_chunk_ids array<string>, beir_failure_scale_factor double"
RUN_TABLES = ("outputs", "metrics", "traces", "run_configs")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_corpus(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of JSON lines; a malformed line is an error."""
    return spark.read.schema(TASKS).option("mode", "FAILFAST").json(path)


def write_tasks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def to_examples(df: DataFrame) -> DataFrame:
    """Typed examples; a missing scale factor is 1."""
    return df.select("example_id", "question", "reference_answer", F.coalesce("ground_truth_chunk_ids", F.array().cast("array<string>")).alias("ground_truth_chunk_ids"), F.coalesce("beir_failure_scale_factor", F.lit(1.0)).alias("beir_failure_scale_factor"))


read_embeddings = read_docstore = read_corpus
write_embeddings = write_docstore = write_corpus


def jsonable(kind: T.DataType) -> T.DataType:
    """The type with strings in place of what JSON has no values for (dates, times, decimals, bytes, intervals)."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, jsonable(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(jsonable(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(T.StringType(), jsonable(kind.valueType), kind.valueContainsNull)
    plain = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return kind if isinstance(kind, plain) else T.StringType()


def _run(spark: SparkSession, root: str, run_id: str) -> Set:
    return Set(spark, f"{root}/{run_id}")


def _of_run(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))


def _write_run(df: DataFrame, root: str, table: str, run_id: str) -> None:
    _run(df.sparkSession, root, run_id).commit({table: _of_run(df, run_id)})


def run_names(spark: SparkSession, root: str) -> list[str]:
    """The runs below the root: names alone, which the driver can hold."""
    return [x for x in Set(spark, root).names("") if not x.startswith((".", "_"))]


def _read_run(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> DataFrame:
    """One run, or all that have the table, however they were written."""
    runs = [run_id] if run_id is not None else run_names(spark, root)
    paths = [p for r in runs for p in _run(spark, root, r).paths(table)]
    if not paths:
        raise ValueError(f"{root} has no table {table}" + (f" of run {run_id}" if run_id is not None else ""))
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def outputs_of(df: DataFrame) -> DataFrame:
    """df with strings in place of values that JSON lacks."""
    return df.select(*(F.col(f"`{f.name}`").cast(jsonable(f.dataType)).alias(f.name) for f in df.schema.fields))


def write_outputs(df: DataFrame, root: str, run_id: str) -> None:
    _write_run(outputs_of(df), root, "outputs", run_id)


def read_outputs(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    return _read_run(spark, root, "outputs", run_id)


def write_metrics(df: DataFrame, root: str, run_id: str) -> None:
    _write_run(df, root, "metrics", run_id)


def read_metrics(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    return _read_run(spark, root, "metrics", run_id)


def write_traces(df: DataFrame, root: str, run_id: str) -> None:
    _write_run(df, root, "traces", run_id)


def read_traces(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    return _read_run(spark, root, "traces", run_id)


def save_run(rows: DataFrame, summary: DataFrame, traces: DataFrame, root: str, run_id: str) -> None:
    """The final save of a run: its outputs, traces and metrics, in one version. Nothing of an earlier save of the run is left in it."""
    new = {"outputs": outputs_of(rows), "traces": traces, "metrics": summary}
    _run(rows.sparkSession, root, run_id).commit({t: _of_run(df, run_id) for t, df in new.items()})


def add_batch(rows: DataFrame, traces: DataFrame, parts: DataFrame, summarise: Callable[[DataFrame], DataFrame], root: str, run_id: str, batch: int) -> None:
    """Adds a batch to a run in one version: its outputs and traces, its part of the summary, and the summary of all parts so far. A batch that is added again replaces itself."""
    spark, tag = rows.sparkSession, str(batch)
    run = _run(spark, root, run_id)
    before = [f"{run.path}/{folder}" for folder, t in run.tables().get("parts", []) if t != tag]
    parts = kept(_of_run(parts, run_id))  # one row
    every = parts.unionByName(spark.read.parquet(*before), allowMissingColumns=True) if before else parts
    run.commit({"metrics": _of_run(summarise(every), run_id)}, {"outputs": _of_run(outputs_of(rows), run_id), "traces": _of_run(traces, run_id), "parts": parts}, tag)


def new_run_id(name: str | None = None, at: datetime | None = None) -> str:
    """A given name as it is; else the time, as yyyy-MM-dd_HHmm_eval_run."""
    return name if name is not None else (at or datetime.now()).strftime("%Y-%m-%d_%H%M_eval_run")


def write_config(spark: SparkSession, root: str, run_id: str, evaluation_type: str, num_examples: int, retrieval_k: int, params: dict[str, str] | None = None) -> None:
    row = spark.range(1).select(F.lit(evaluation_type).alias("evaluation_type"), F.lit(num_examples).cast("long").alias("num_examples"), F.lit(retrieval_k).alias("retrieval_k"), F.create_map(*(F.lit(str(x)) for kv in (params or {}).items() for x in kv)).cast("map<string,string>").alias("params"), F.current_timestamp().alias("ts"))
    _write_run(row, root, "run_configs", run_id)


def read_config(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    return _read_run(spark, root, "run_configs", run_id)


def run_ids(configs: DataFrame) -> DataFrame:
    return configs.select("run_id").distinct().orderBy("run_id")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    return run_ids(read_config(spark, root))


def load_results(spark: SparkSession, root: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    return read_outputs(spark, root, run_id), read_metrics(spark, root, run_id)


def complete_runs(configs: DataFrame, metrics: DataFrame, outputs: DataFrame) -> DataFrame:
    """Configs with metrics, for the runs that have all three."""
    return configs.join(metrics, "run_id").join(outputs.select("run_id").distinct(), "run_id", "left_semi")


def load_all_runs(spark: SparkSession, root: str) -> DataFrame:
    """Configs with metrics, for the runs that have configs, outputs and metrics."""
    return complete_runs(read_config(spark, root), read_metrics(spark, root), read_outputs(spark, root))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or, in local mode, one of our own where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR") or "/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once in the shared folder and read again, so that no model is called twice."""
    path = scratch(df.sparkSession)
    out = kept_at(df, path)
    out._kept_at = path
    return out


def done_with(df: DataFrame) -> None:
    """Deletes what `kept` wrote for df, once nothing that is still to be computed reads it; a df from elsewhere stays."""
    if path := getattr(df, "_kept_at", None):
        forget(df.sparkSession, path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `kept_at` wrote, once nothing that is still to be computed reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
