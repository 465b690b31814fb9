"""Approximate nearest neighbours: recall against exact search, edges, hot cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import ann, vectors
from evalloom.plans import retrieval_queries as R


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_search(spark, sf):
    q, c, _, _ = R.vectors(spark, f"/root/testdata/{sf}")
    rows = ann.recall(ann.knn_ivf(q, c, 10), vectors.knn(q, c, 10), [1, 5, 10]).collect()
    assert ann.NPROBE <= 8 and all(r.recall >= 0.9 for r in rows) and {r.n_true for r in rows} == {rows[0].n_queries * k for k in (1, 5, 10)}


def table(spark, rows, names="chunk_id string, embedding array<float>"):
    return spark.createDataFrame(rows, names).repartition(3)


def test_codes_find_their_vectors_in_any_block(spark):
    r = np.random.default_rng(1)
    rows = [(f"c{i}", [float(x) for x in r.normal(size=16)]) for i in range(300)]
    corpus = table(spark, rows)
    queries = table(spark, rows[:20], "example_id string, embedding array<float>")
    index = ann.build(corpus, cells=5, parts=4, entries=16, copies=2)
    assert index.codes.count() == 600 and {len(x.code) for x in index.codes.collect()} == {4}
    one, many = (sorted(ann.search(index, queries, corpus, 3, nprobe=3, query_bytes=b).collect()) for b in (1 << 20, 16 * 8 * 3))
    assert one == many and {(x.example_id, x.chunk_id) for x in one if x.rank == 1} == {(i, i) for i, _ in rows[:20]}
    exact = {(x.example_id, x.chunk_id, x.rank) for x in vectors.knn(queries, corpus, 3).collect()}
    everywhere = ann.search(index, queries, corpus, 3, nprobe=5, shortlist=300)  # all cells, all rows: exact
    assert {(x.example_id, x.chunk_id, x.rank) for x in everywhere.collect()} == exact


def test_odd_vectors_and_hot_cells(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(f"same{i:03}", [1.0, 1.0, 0.0, 0.0]) for i in range(200)] + [("far", [-1.0, 0.0, 0.0, 0.0]), ("null", None), ("short", [1.0]), ("hole", [1.0, None, 0.0, 0.0]), ("nan", [nan] * 4), ("inf", [inf, 0.0, 0.0, 0.0]), ("", [])]
    corpus = table(spark, rows)
    queries = table(spark, [("a", [1.0, 1.0, 0.0, 0.0]), ("none", None), ("nan", [nan] * 4), ("short", [1.0])], "example_id string, embedding array<float>")
    found = ann.knn_ivf(queries, corpus, 3, cells=3, parts=2, nprobe=3).collect()
    assert sorted((r.example_id, r.chunk_id, r.d2, r.rank) for r in found) == [("a", f"same{i:03}", 0.0, i + 1) for i in range(3)]
    assert ann.knn_ivf(queries, corpus.limit(0), 3).count() == 0
    assert ann.knn_ivf(queries, corpus.filter("chunk_id in ('null', 'nan')"), 3, parts=2).count() == 0
    assert ann.knn_ivf(queries.limit(0), corpus, 3, cells=3, parts=2).count() == 0
    with pytest.raises(ValueError):
        ann.build(corpus, parts=3)


def test_codebooks_do_not_depend_on_the_order_of_rows(spark):
    rows = [(f"c{i}", [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(200)]
    residuals = [table(spark, rows).repartition(n).select(F.col("embedding").cast("array<double>").alias("r")) for n in (1, 5)]
    a, b = (ann.fit_books(r, 2, 8, 0) for r in residuals)
    assert (a == b).all() and a.shape == (2, 8, 2)


def test_only_probed_cells_are_read(spark):
    q, c, _, _ = R.vectors(spark, "/root/testdata/sf0.001")
    index = ann.build(c)
    one = q.limit(1)
    plan = ann.search(index, one, c, 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan
