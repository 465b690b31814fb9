"""Retrieval metrics. retrieved: example_id, rank, chunk_id (once per example); truth: example_id, truth (array of chunk ids).

An example without truth or without results has error set and metrics 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("recall_at_k", "precision_at_k", "ndcg_at_k")


def ir_sweep(retrieved: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """example_id, k, the three metrics and error, for every k, from one retrieval."""
    known = truth.select("example_id", F.array_distinct("truth").alias("truth"))
    hit = F.array_contains("truth", F.col("chunk_id")).cast("int")
    judged = known.join(retrieved, "example_id", "left").select("example_id", "rank", F.size("truth").alias("n_truth"), F.coalesce(hit, F.lit(0)).alias("hit"))
    return judged_sweep(judged, ks)


def judged_sweep(judged: DataFrame, ks: list[int]) -> DataFrame:
    """The same from rows of example_id, rank (null where nothing is retrieved), n_truth and hit (0 or 1): for truth that no array should hold."""
    if not ks or min(ks) <= 0:
        raise ValueError("k must be positive")
    gain = F.col("hit") / F.log2(F.col("rank") + 1)
    parts = []
    for k in ks:
        top = F.col("rank") <= k
        parts.append(F.struct(F.lit(k).alias("k"), F.sum(F.when(top, F.col("hit"))).alias("hits"), F.count(F.when(top, F.lit(1))).alias("n"), F.sum(F.when(top, gain)).alias("dcg")))
    rows = judged.groupBy("example_id").agg(F.max("n_truth").alias("n_truth"), F.array(*parts).alias("each")).select("example_id", "n_truth", F.explode("each").alias("x")).select("example_id", "n_truth", "x.*")
    error = F.when(F.coalesce("n_truth", F.lit(0)) <= 0, "empty ground truth").when(F.col("n") == 0, "nothing retrieved")
    ideal = F.least("n_truth", F.col("n"))
    idcg = F.when(ideal > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(ideal, F.lit(1).cast("long"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)))
    value = lambda a, b: F.coalesce(F.when(error.isNull(), F.try_divide(a, b)), F.lit(0.0))
    return rows.select("example_id", "k", value(F.col("hits").cast("double"), F.col("n_truth")).alias(METRICS[0]), value(F.col("hits").cast("double"), F.col("n")).alias(METRICS[1]), value(F.col("dcg"), idcg).alias(METRICS[2]), error.alias("error"))


def ir_metrics(retrieved: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    return ir_sweep(retrieved, truth, [k]).drop("k")


def recall_at_k(retrieved: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    return ir_metrics(retrieved, truth, k).select("example_id", METRICS[0])


def precision_at_k(retrieved: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    return ir_metrics(retrieved, truth, k).select("example_id", METRICS[1])


def ndcg_at_k(retrieved: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    return ir_metrics(retrieved, truth, k).select("example_id", METRICS[2])


def ir_mean(metrics: DataFrame) -> DataFrame:
    valid = metrics.filter(F.col("error").isNull())
    return valid.groupBy("k").agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("n"))


def ir_best_k(means: DataFrame, metric: str = "recall_at_k") -> DataFrame:
    return means.orderBy(F.desc(metric), "k").limit(1).select("k", metric)


def low_recall(metrics: DataFrame, k: int = 5, below: float = 0.5) -> DataFrame:
    return metrics.filter((F.col("k") == k) & (F.col("recall_at_k") < below))


def found_truth(judged: DataFrame, k: int = 5) -> DataFrame:
    """example_id, found: the true chunks among the first k, in rank order. judged: example_id, rank, chunk_id, hit, a row for each retrieved chunk (and none or one without a rank for an example without any)."""
    hits = F.array_sort(F.collect_list(F.when((F.col("hit") == 1) & (F.col("rank") <= k), F.struct("rank", "chunk_id"))))
    return judged.groupBy("example_id").agg(F.transform(hits, lambda x: x["chunk_id"]).alias("found"))
