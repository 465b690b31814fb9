"""Queries of nearest neighbours and retrieval metrics, over the embeddings: the vectors of ids divisible by EVERY search all vectors; in
knn_ivf, knn_lsh and context_of_all, those of ids divisible by 100 do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import ann, lsh
from evalloom.operators import irmetrics as M
from evalloom.operators import vectors as V

KS = [1, 3, 5, 10]
#: The recall that approximate searches are held to.
RECALL = 0.9
#: Vectors whose ids it divides are the queries.
EVERY = 50


def vectors(spark: SparkSession, sf_dir: str, every: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """queries, corpus, docstore (without every seventeenth chunk), truth (a row for each label and chunk)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = F.col("vec_id") % every == 0
    queries = rows.filter(asked).select(F.col("vec_id").alias("example_id"), "embedding", "label")
    corpus = rows.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    docstore = corpus.filter("chunk_id % 17 <> 0").select("chunk_id", F.concat(F.lit("text "), F.col("chunk_id").cast("string")).alias("text"), F.col("label").alias("document_id"))
    truth = corpus.select("label", "chunk_id").distinct()
    return queries, corpus, docstore, truth


def _top(spark, sf_dir, k=10):
    q, c, _, _ = vectors(spark, sf_dir, EVERY)
    return V.knn(q, c, k)


def _retrieved(spark, sf_dir, every=EVERY, **more):
    q, c, d, _ = vectors(spark, sf_dir, every)
    return V.retrieve(q, c, d, 5, **more)


def _judged(spark, sf_dir, k):
    """example_id, rank, chunk_id, n_truth, hit: a row for each of the k nearest (one without a rank where there is none)."""
    q, c, _, truth = vectors(spark, sf_dir, EVERY)
    asked = q.select("example_id", "label").join(truth.groupBy("label").agg(F.count("*").alias("n_truth")), "label", "left")
    found = asked.join(V.knn(q, c, k), "example_id", "left")
    judged = found.join(truth.withColumn("hit", F.lit(1)), ["label", "chunk_id"], "left")
    return judged.select("example_id", "rank", "chunk_id", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("hit", F.lit(0)).alias("hit"))


def _sweep(spark, sf_dir, ks=KS):
    return M.judged_sweep(_judged(spark, sf_dir, max(ks)), ks)


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def knn_exact(spark, sf_dir):
    return _rounded(_top(spark, sf_dir), "d2")


def ir_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.ir_mean(_sweep(spark, sf_dir)), *M.METRICS)


def ir_found(spark, sf_dir):
    found = M.found_truth(_judged(spark, sf_dir, 5), 5)
    return found.select("example_id", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"))


def passages(spark, sf_dir):
    """Benchmark passages as questions; truth is the fixed-size chunks that hold them."""
    from evalloom.operators.chunking import chunk_fixed

    from .text_queries import corpus

    chunks = chunk_fixed(corpus(spark, sf_dir))
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.col("text").alias("question"))
    return V.holding(chunks, questions).select("item_id", "chunk_id")


def _recalled(spark, sf_dir, search, ks):
    """Of an approximate search: how many neighbours it had to find, and whether it found RECALL of them, for each k."""
    q, c, _, _ = vectors(spark, sf_dir)
    rows = ann.recall(search(q, c, max(ks)), V.knn(q, c, max(ks)), ks)
    return rows.select("k", "n_queries", "n_true", (F.col("recall") >= RECALL).alias("recalled"))


def knn_ivf(spark, sf_dir):
    return _recalled(spark, sf_dir, ann.knn_ivf, KS)


def knn_lsh(spark, sf_dir):
    return _recalled(spark, sf_dir, lsh.knn_lsh, [1, 5])


LETTERS = "etaoinsh"


def embed_letters(spark, sf_dir):
    """Embeddings of documents by their length and counts of letters, as a stand-in for a caller's model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = V.embed(docs, letter_counts)
    return made.select("doc_id", F.size("embedding").alias("dimension"), F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


def letter_counts(texts):
    import numpy as np

    return np.array([[len(t), *map(t.count, LETTERS)] for t in texts], np.float32).reshape(len(texts), -1)


QUERIES = {
    "embedding_check": lambda s, d: V.check_embeddings(s.read.parquet(f"{d}/embeddings.parquet"), 64).select("vec_id"),
    "index_info": lambda s, d: V.index_info(s.read.parquet(f"{d}/embeddings.parquet")),
    "embed_documents": embed_letters,
    "knn_exact": knn_exact,
    "knn_ivf": knn_ivf,
    "knn_lsh": knn_lsh,
    "retrieve": lambda s, d: _rounded(_retrieved(s, d), "similarity_score"),
    "retrieve_distance": lambda s, d: _rounded(_retrieved(s, d, score="distance"), "score"),
    "score_stats": lambda s, d: _rounded(V.score_stats(_retrieved(s, d)), "avg", "min", "max", "variance"),
    "context_joined": lambda s, d: V.assemble_context(_retrieved(s, d), "paragraph"),
    "context_labelled": lambda s, d: V.assemble_context(_retrieved(s, d), "labelled"),
    "context_spaced": lambda s, d: V.assemble_context(_retrieved(s, d)),
    "context_of_all": lambda s, d: V.assemble_context(_retrieved(s, d, 100), "labelled", vectors(s, d)[0]),
    "retrieved_ids": lambda s, d: V.retrieved_ids(_retrieved(s, d)).withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ",")),
    "passage_truth": passages,
    "ir_at_k": lambda s, d: _rounded(_sweep(s, d, [5]).drop("k"), *M.METRICS),
    "ir_sweep": lambda s, d: _rounded(_sweep(s, d), *M.METRICS),
    "ir_mean": ir_mean,
    "ir_best_k": lambda s, d: _rounded(M.ir_best_k(M.ir_mean(_sweep(s, d))), "recall_at_k"),
    "ir_low_recall": lambda s, d: M.low_recall(_sweep(s, d)).select("example_id"),
    "ir_found": ir_found,
}


def _knn_sql(k: int, every: int = EVERY) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY d2, chunk_id) AS rank FROM (
  SELECT q.vec_id AS example_id, c.vec_id AS chunk_id, c.label, q.label = c.label AS hit,
    list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE))) AS d2
  FROM embeddings q JOIN embeddings c ON q.vec_id % {every} = 0) QUALIFY rank <= {k})"""


def _top5_sql(every: int = EVERY) -> str:
    return f"(SELECT example_id, CAST(rank AS INT) AS rank, chunk_id, label AS document_id, 'text ' || chunk_id AS chunk_text, d2 FROM {_knn_sql(5, every)} WHERE chunk_id % 17 <> 0)"


#: Of the queries of context_of_all and agent_answers.
_TOP5 = _top5_sql(100)
_SWEEP = f"""(SELECT example_id, CAST(k AS INT) AS k, hits / n_truth::DOUBLE AS recall_at_k, hits / n::DOUBLE AS precision_at_k,
  dcg / list_sum(list_transform(range(1, least(n_truth, n) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_at_k, CAST(NULL AS VARCHAR) AS error
FROM (SELECT example_id, k, n_truth, count(*) AS n, count(*) FILTER (hit) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg
  FROM {_knn_sql(10)} r JOIN (SELECT unnest([1, 3, 5, 10]) AS k) ON rank <= k
  JOIN (SELECT q.vec_id AS example_id, count(*) AS n_truth FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id % {EVERY} = 0 GROUP BY 1) t USING (example_id) GROUP BY 1, 2, 3))"""
_R = "round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(ndcg_at_k, 6) AS ndcg_at_k"
_MEAN = f"(SELECT k, avg(recall_at_k) AS recall_at_k, avg(precision_at_k) AS precision_at_k, avg(ndcg_at_k) AS ndcg_at_k, count(*) AS n FROM {_SWEEP} GROUP BY k)"


def _passage_sql() -> str:
    from .text_queries import SQL as text

    return f"SELECT item_id, chunk_id FROM ({text['chunk_fixed']}) c JOIN benchmark b ON contains(c.text, b.text)"


def _recalled_sql(ks: list[int]) -> str:
    return f"SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS n_queries, count(*) FILTER (rank <= k) AS n_true, TRUE AS recalled FROM {_knn_sql(max(ks), 100)}, (SELECT unnest({ks}) AS k) GROUP BY k"


SQL = {
    "embedding_check": "SELECT vec_id FROM embeddings WHERE coalesce(len(embedding), -1) <> 64",
    "embed_documents": f"SELECT doc_id, {len(LETTERS) + 1} AS dimension, concat_ws(',', length(text), " + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in LETTERS) + ") AS embedding FROM documents",
    "context_of_all": f"SELECT e.vec_id AS example_id, coalesce(c.context, '[No retrieved context available]') AS context FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) e LEFT JOIN (SELECT example_id, string_agg('[Chunk ID: ' || chunk_id || '] ' || chunk_text, chr(10) ORDER BY rank) AS context FROM {_TOP5} GROUP BY 1) c ON c.example_id = e.vec_id",
    "context_spaced": f"SELECT example_id, string_agg(chunk_text, ' ' ORDER BY rank) AS context FROM {_top5_sql()} GROUP BY 1",
    "index_info": "SELECT count(embedding) AS n_vectors, CAST(max(len(embedding)) AS INT) AS dimension FROM embeddings",
    "knn_ivf": _recalled_sql(KS),
    "knn_lsh": _recalled_sql([1, 5]),
    "knn_exact": f"SELECT example_id, chunk_id, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM {_knn_sql(10)}",
    "retrieve": f"SELECT example_id, rank, chunk_id, document_id, chunk_text, round(-d2, 6) AS similarity_score FROM {_top5_sql()}",
    "retrieve_distance": f"SELECT example_id, rank, chunk_id, document_id, chunk_text, round(d2, 6) AS score FROM {_top5_sql()}",
    "score_stats": f'SELECT count(*) AS n, round(avg(-d2), 6) AS avg, round(min(-d2), 6) AS min, round(max(-d2), 6) AS max, round(var_pop(-d2), 6) AS variance FROM {_top5_sql()}',
    "context_joined": f"SELECT example_id, string_agg(chunk_text, chr(10) || chr(10) ORDER BY rank) AS context FROM {_top5_sql()} GROUP BY 1",
    "context_labelled": f"SELECT example_id, string_agg('[Chunk ID: ' || chunk_id || '] ' || chunk_text, chr(10) ORDER BY rank) AS context FROM {_top5_sql()} GROUP BY 1",
    "retrieved_ids": f"SELECT example_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids, count(*) AS n_chunks FROM {_top5_sql()} GROUP BY 1",
    "passage_truth": _passage_sql(),
    "ir_at_k": f"SELECT example_id, {_R}, error FROM {_SWEEP} WHERE k = 5",
    "ir_sweep": f"SELECT example_id, k, {_R}, error FROM {_SWEEP}",
    "ir_mean": f"SELECT k, {_R}, n FROM {_MEAN}",
    "ir_best_k": f"SELECT k, round(recall_at_k, 6) AS recall_at_k FROM {_MEAN} ORDER BY recall_at_k DESC, k LIMIT 1",
    "ir_low_recall": f"SELECT example_id FROM {_SWEEP} WHERE k = 5 AND recall_at_k < 0.5",
    "ir_found": f"SELECT example_id, coalesce(string_agg(chunk_id, ',' ORDER BY rank) FILTER (hit), '') AS found FROM {_knn_sql(5)} GROUP BY 1",
}
