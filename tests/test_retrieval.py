"""Retrieval queries on small tables of their own, and how much a task holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from evalloom.operators import vectors as V
from evalloom.plans import registry

from .oracle import check

VECTORS = "vec_id long, embedding array<float>, label int"


def test_context_of_all_gives_every_query_its_chunks(spark, tmp_path):
    rows = [(i, [float(j == i % 64) for j in range(64)], i % 3) for i in (0, 1, 2, 3, 4, 100, 101, 102, 103, 200)] + [(300, None, 0)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.example_id: r.context for r in registry.QUERIES["context_of_all"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 100, 200, 300]
    assert got[300] == "[No retrieved context available]"
    assert all("[Chunk ID: " in got[i] for i in (0, 100, 200))


#: What a query over `four_groups` shows of the vectors 0, 50, 100 and 150 that search, by name.
ASKED = {
    "knn_exact": lambda rows: {r.example_id: r.chunk_id for r in rows if r["rank"] == 10} == {0: 9, 50: 59, 100: 109, 150: 159},
    "retrieve": lambda rows: {r.example_id: r.chunk_id for r in rows if r["rank"] == 5} == {0: 4, 50: 54, 100: 104, 150: 154},
    "retrieve_distance": lambda rows: {(r.example_id, r.score) for r in rows if r["rank"] == 5} == {(0, 16), (50, 16), (100, 16), (150, 16)},
    "score_stats": lambda rows: [r.n for r in rows] == [16],
    "context_joined": lambda rows: {r.example_id: r.context for r in rows if r.example_id % 100} == {i: "\n\n".join(f"text {j}" for j in ids) for i, ids in FOUND.items()},
    "context_labelled": lambda rows: {r.example_id: r.context for r in rows if r.example_id % 100} == {i: "\n".join(f"[Chunk ID: {j}] text {j}" for j in ids) for i, ids in FOUND.items()},
    "context_spaced": lambda rows: {r.example_id: r.context for r in rows if r.example_id % 100} == {i: " ".join(f"text {j}" for j in ids) for i, ids in FOUND.items()},
    "retrieved_ids": lambda rows: {r.example_id: r.chunk_ids for r in rows if r.example_id % 100} == {i: ",".join(map(str, ids)) for i, ids in FOUND.items()},
    "ir_at_k": lambda rows: {r.example_id: r.recall_at_k for r in rows} == {0: 0.5, 50: 0.25, 100: 0.5, 150: 0.25},
    "ir_sweep": lambda rows: {r.example_id: r.recall_at_k for r in rows if r.k == 10} == {0: 1, 50: 0.5, 100: 1, 150: 0.5},
    "ir_mean": lambda rows: {r.k: (r.n, r.recall_at_k) for r in rows if r.k > 3} == {5: (4, 0.375), 10: (4, 0.75)},
    "ir_best_k": lambda rows: [(r.k, r.recall_at_k) for r in rows] == [(10, 0.75)],
    "ir_low_recall": lambda rows: sorted(r.example_id for r in rows) == [50, 150],
    "ir_found": lambda rows: {r.example_id: r.found for r in rows if r.example_id % 100} == {50: "50,51,52,53,54", 150: "150,151,152,153,154"},
}
#: Of two of them, the five nearest that the docstore has.
FOUND = {50: [50, 52, 53, 54], 150: [150, 151, 152, 154]}


@pytest.fixture(scope="module")
def four_groups(tmp_path_factory):
    """Vectors on a line, in groups of ten; the second and the fourth group have one label, so none of their searches finds all that is true."""
    ids = [i + j for i in (0, 50, 100, 150) for j in range(10)]
    rows = {"vec_id": ids, "embedding": pa.array([[float(i)] + [0.0] * 63 for i in ids], pa.list_(pa.float32())), "label": pa.array([i // 50 % 2 or i // 50 + 2 for i in ids], pa.int32())}
    folder = tmp_path_factory.mktemp("groups")
    pq.write_table(pa.table(rows), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ASKED)
def test_every_fiftieth_vector_searches(spark, four_groups, name):
    assert ASKED[name](registry.QUERIES[name](spark, four_groups).collect())
    check(spark, registry.QUERIES[name], registry.SQL[name], four_groups)


class Task:
    """Stands for a table of one partition, whose rows a function of a task gets here."""

    def __init__(self, ids, vectors, size):
        self.batches = [pa.RecordBatch.from_arrays([pa.array(ids[a : a + size]), pa.array(list(vectors[a : a + size]))], names=["chunk_id", "embedding"]) for a in range(0, len(ids), size)]

    def mapInArrow(self, run, schema):
        return [x for b in run(iter(self.batches)) for x in b.to_pylist()]

    def mapInPandas(self, run, schema):
        return [x for b in run(b.to_pandas() for b in self.batches) for x in b.to_dict("records")]


class Sent:
    def __init__(self, *value):
        self.value = value


class Schema:
    names = ["example_id", "chunk_id", "d2"]


def found(q, task, k):
    return V._nearest_in(task, Sent(pa.array(range(len(q))), q), k, Schema)


def test_task_of_exact_search_holds_little():
    r = np.random.default_rng(0)
    q, task = r.normal(size=(4000, 8)), Task(range(10_000), r.normal(size=(10_000, 8)), 10_000)
    tracemalloc.start()
    found(q, task, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # one table of all distances has 305 MB


@pytest.mark.parametrize("k", [1, 4, 700])
def test_task_of_exact_search_keeps_the_nearest(k, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 64)
    monkeypatch.setattr(V, "TILE", 320)
    monkeypatch.setattr(V, "COMPARED", 50)
    r = np.random.default_rng(1)
    c = r.normal(size=(500, 6)) * 1000
    c[100:300] = c[100]  # many copies
    c[7, 2] = np.nan
    ids = [f"c{i}" for i in r.permutation(500)]
    q = np.concatenate([c[[100, 150, 3]], r.normal(size=(20, 6)) * 1000, np.full((1, 6), np.nan)])
    got = {}
    for x in found(q, Task(ids, c, 130), k):
        got.setdefault(x["example_id"], []).append((x["d2"], x["chunk_id"]))
    for i, v in enumerate(q):
        all_ = sorted((((v - y) ** 2).cumsum()[-1], n) for y, n in zip(c, ids, strict=True) if not np.isnan(y - v).any())
        assert sorted(got.get(i, []))[:k] == all_[:k]
