"""Random projections: recall at a set length, clusters, edges, repeated vectors, blocks."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from evalloom.operators import ann, lsh, vectors
from evalloom.plans import retrieval_queries as R

from .test_ann import table
from .test_retrieval import Schema, Sent, Task

QUERY = "example_id string, embedding array<float>"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_join(spark, sf):
    q, c, _, _ = R.vectors(spark, f"/root/testdata/{sf}")
    rows = ann.recall(lsh.knn_lsh(q, c, 5), vectors.knn(q, c, 5), [1, 5]).collect()
    assert all(r.recall >= 0.9 for r in rows) and {r.n_true for r in rows} == {rows[0].n_queries * k for k in (1, 5)}


def clustered(n, clusters=40, dim=16):
    r = np.random.default_rng(3)
    centres = r.normal(size=(clusters, dim))
    return np.float64(np.float32(centres[np.arange(n) % clusters] + 0.1 * r.normal(size=(n, dim))))


def pairs_of(x, hashes, rows):
    """Rows by brute force: the tables in which each query meets each row."""
    return np.stack([lsh.agreeing(hashes, np.repeat(x[i : i + 1], len(x), 0), x, lsh.PROBES) for i in rows])


def test_candidates_are_the_pairs_that_agree_and_few_of_them_among_clusters():
    x = clustered(800)
    near = np.argsort(((x[:60, None] - x) ** 2).sum(2), axis=1)[:, :5]
    drawn = lsh.draw(16, lsh.TABLES, 1.0, 0)
    length = lsh.fit_length(drawn, x[np.repeat(np.arange(60), 5)], x[near.ravel()], lsh.PROBES, lsh.AGREE, 0.95)
    hashes = drawn._replace(length=length)
    times = pairs_of(x, hashes, range(60))
    assert np.take_along_axis(times >= lsh.AGREE, near, 1).mean() >= 0.95 and (times >= lsh.AGREE).mean() < 0.1
    tables, met = [], []
    for t in range(lsh.TABLES):
        keys = hashes.probed(x[:60], t, lsh.PROBES)
        order = np.argsort(keys, axis=None, kind="stable")
        tables.append((keys.ravel()[order], order // lsh.PROBES))
        a = np.searchsorted(tables[t][0], hashes.keys(x, t), "left")
        met.append((a, np.searchsorted(tables[t][0], hashes.keys(x, t), "right") - a))
    for start, end in ((0, 800), (37, 38), (100, 700)):
        i, j = lsh._candidates(met, tables, start, end, 60, lsh.AGREE)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in np.argwhere(times >= lsh.AGREE).tolist() if start <= b < end}


def test_probes_begin_with_the_own_bucket_and_are_distinct():
    x = clustered(50)
    hashes = lsh.draw(16, 3, 0.7, 1)
    for t in range(3):
        keys = hashes.probed(x, t, lsh.PROBES)
        assert (keys[:, 0] == hashes.keys(x, t)).all() and all(len(set(row)) == lsh.PROBES for row in keys.tolist())


def test_blocks_give_the_same_rows(spark):
    x = clustered(300)
    rows = [(f"c{i}", [float(v) for v in r]) for i, r in enumerate(x)]
    corpus, queries = table(spark, rows), table(spark, rows[:40], QUERY)
    one = sorted(lsh.knn_lsh(queries, corpus, 3).collect())
    blocks = sorted(lsh.knn_lsh(queries, corpus, 3, query_bytes=16 * 8 * 9).collect())
    exact = {(r.example_id, r.chunk_id, r.d2) for r in vectors.knn(queries, corpus, 3).collect()}
    assert one == blocks and len(exact & {(r.example_id, r.chunk_id, r.d2) for r in one}) >= 0.9 * len(exact)
    assert {(r.example_id, r.chunk_id) for r in one if r.rank == 1} == {(i, i) for i, _ in rows[:40]}
    near = lsh.knn_lsh(queries, corpus, 3, radius=1e-9).collect()
    assert {(r.example_id, r.chunk_id) for r in near} == {(i, i) for i, _ in rows[:40]} and len(near) == 40


def test_odd_vectors_and_one_vector_repeated(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(f"same{i:03}", [1.0, 1.0, 0.0, 0.0]) for i in range(500)] + [("far", [-1.0, 0.0, 0.0, 0.0]), ("null", None), ("short", [1.0]), ("hole", [1.0, None, 0.0, 0.0]), ("nan", [nan] * 4), ("inf", [inf, 0.0, 0.0, 0.0]), ("", [])]
    corpus = table(spark, rows)
    queries = table(spark, [("a", [1.0, 1.0, 0.0, 0.0]), ("b", [1.0, 1.0, 0.0, 0.0]), ("none", None), ("nan", [nan] * 4), ("short", [1.0])], QUERY)
    found = lsh.knn_lsh(queries, corpus, 3).collect()
    assert sorted((r.example_id, r.chunk_id, r.d2, r.rank) for r in found) == [(e, f"same{i:03}", 0.0, i + 1) for e in "ab" for i in range(3)]
    assert lsh.knn_lsh(queries, corpus.limit(0), 3).count() == 0
    assert lsh.knn_lsh(queries, corpus.filter("chunk_id in ('null', 'nan')"), 3).count() == 0
    assert lsh.knn_lsh(queries.limit(0), corpus, 3).count() == 0


def test_runs_keep_their_places_and_edges_come_closer():
    x = np.zeros((200, 16))
    tables = [(np.zeros(30, np.int64), np.arange(30))]
    met = [(np.zeros(200, np.int64), np.full(200, 30))]
    i, j = lsh._candidates(met, tables, 10, 12, 30, 1)
    assert len(i) == 60 and set(j.tolist()) == {10, 11}
    edge = np.full(30, np.inf)
    found = lsh._nearest(x[:30], x, i, j, edge, 1, pa.array(range(200)))
    assert len(found) == 30 and set(found["c"]) == {10} and (edge == 0).all()


def test_task_of_the_join_holds_little():
    r = np.random.default_rng(0)
    q, c = (x / np.linalg.norm(x, axis=1)[:, None] for x in (r.normal(size=(1500, 16)), r.normal(size=(6000, 16))))
    hashes = lsh.draw(16, lsh.TABLES, 1.0, 0)  # long buckets, so that most pairs are candidates
    task = Task(range(len(c)), c, len(c))
    task.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: Sent(*value)))
    tracemalloc.start()
    rows = lsh._found_in(task, pa.array(range(len(q))), q, hashes, 3, lsh.PROBES, lsh.AGREE, np.inf, Schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {x["example_id"] for x in rows} == set(range(len(q)))
    assert peak < 50 << 20  # with four times as many meetings at once it has 95 MB
