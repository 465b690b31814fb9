"""Approximate nearest neighbours by product quantisation over coarse cells.

The index: CELLS centres of k-means; of each vector, for each of its `copies` nearest cells, a row of the cell and a code of `parts` bytes, which names for each part of the
residual (vector less centre) the nearest entry of that part's codebook. Centres and codebooks are fitted to a bounded sample (SAMPLE rows, chosen by a hash of their
ids); every row is indexed. Rows are ordered by cell over the files, so that a large cell lies in many of them and a search reads those of the probed cells alone.

The search: the nprobe nearest cells of each query; look-up tables of the distances from its residual to all entries, by which a task sums up a row's distance from its code; the
`shortlist` best by that distance meet their vectors, and exact distances decide. Codes are never joined: blocks of queries (QUERY_BYTES) go to the tasks that read them, and only shortlists are shuffled.

A vector that is null, of another dimension, or holds a null, nan or infinity, is never found, and such a query finds nothing. Equal distances are ordered by chunk_id. ids may be of any type that has an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.sources.tables import kept

from .vectors import QUERY_BYTES, ranked, squared_distance

CELLS, PARTS, ENTRIES, COPIES, NPROBE, SHORTLIST = 31, 16, 256, 4, 8, 200
SAMPLE, STEPS = 1 << 16, 12
#: Queries whose look-up tables a task holds at once, and rows that it scores together.
TILE, ROWS = 256, 8192


class Index(NamedTuple):
    """centres: a row for each cell; books: part, entry, component; codes: cell, chunk_id, code."""

    centres: np.ndarray
    books: np.ndarray
    codes: DataFrame


def usable(dim: int) -> Column:
    return (F.size("embedding") == dim) & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T


def _sample(rows: DataFrame, key: str) -> DataFrame:
    """All rows, or about SAMPLE of them."""
    n = rows.count()
    return rows if n <= SAMPLE else rows.filter(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < int(SAMPLE / n * (1 << 30)))


def fit_books(residuals: DataFrame, parts: int, entries: int, seed: int) -> np.ndarray:
    """residuals: r (array<double>), of a sample. Each part's codebook by Lloyd's steps in a task of its own."""
    width = len(residuals.select("r").first()[0]) // parts

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["v"].tolist(), np.float64)
        x = x[np.lexsort(x.T)]  # the same codebook in whatever order the rows arrive
        book = x[np.random.default_rng(seed).choice(len(x), min(entries, len(x)), replace=False)]
        for _ in range(STEPS):
            at = np.concatenate([_squared(x[a : a + ROWS], book).argmin(1) for a in range(0, len(x), ROWS)])
            n = np.bincount(at, minlength=len(book))
            sums = np.stack([np.bincount(at, c, len(book)) for c in x.T], axis=1)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "book": [book.ravel()]})

    each = residuals.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("r", p * width + 1, width))).alias("part", "v"))
    found = each.groupBy("part").applyInPandas(fit, "part int, book array<double>").toPandas().sort_values("part")  # of fixed size
    return np.stack([np.array(b).reshape(-1, width) for b in found["book"]])


def build(corpus: DataFrame, cells: int = CELLS, parts: int = PARTS, entries: int = ENTRIES, copies: int = COPIES, seed: int = 0) -> Index | None:
    """corpus: chunk_id, embedding. None if no row has a usable vector; the dimension is that of the longest vector, and parts must divide it."""
    dim = corpus.agg(F.max(F.size("embedding"))).first()[0] or 0
    if dim <= 0:
        return None
    if dim % parts:
        raise ValueError(f"{parts} parts don't divide {dim} components")
    rows = corpus.filter(usable(dim)).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sample = _sample(rows, "chunk_id")
    if sample.isEmpty():
        return None
    centres = np.array(KMeans(k=cells, seed=seed, featuresCol="v").fit(sample.select(array_to_vector("embedding").alias("v"))).clusterCenters())
    copies = min(copies, len(centres))
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x = batch.column("embedding").flatten().to_numpy().reshape(-1, dim)
                yield batch, x, np.argsort(_squared(x, shared.value), axis=1, kind="stable")[:, :copies]

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, near in assigned(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(x - shared.value[near[:, 0]]))], names=["r"])

    books = fit_books(sample.mapInArrow(residuals, "r array<double>"), parts, entries, seed)
    sent = corpus.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), rows.schema["chunk_id"], T.StructField("code", T.BinaryType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        width = books.shape[2]
        for batch, x, near in assigned(batches):
            for c in range(copies):
                r = x - shared.value[near[:, c]]
                code = np.stack([_squared(r[:, p * width : (p + 1) * width], b).argmin(1) for p, b in enumerate(books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(near[:, c].astype(np.int32)), batch.column("chunk_id"), pa.array([r.tobytes() for r in code], pa.binary())], names=schema.names)

    n = max(1, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    codes = rows.mapInArrow(coded, schema).repartitionByRange(n, "cell", "chunk_id").sortWithinPartitions("cell", "chunk_id")
    return Index(centres, books, kept(codes))


def _near_codes(index: Index, asked: pd.DataFrame, nprobe: int, shortlist: int, id_field: T.StructField) -> DataFrame:
    """example_id, chunk_id: those of the least distance by codes; a chunk of several probed cells may come several times."""
    q = np.array(asked["embedding"].tolist(), np.float64).reshape(len(asked), -1)
    probes = np.argsort(_squared(q, index.centres), axis=1, kind="stable")[:, :nprobe]
    spark = index.codes.sparkSession
    shared = spark.sparkContext.broadcast((pa.array(asked["example_id"]), q, probes, index.centres, index.books))
    schema = T.StructType([id_field, index.codes.schema["chunk_id"], T.StructField("about", T.FloatType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, probes, centres, books = shared.value
        parts, _, width = books.shape
        edge = np.full(len(q), np.inf, np.float32)  # no further row is among the best of a query
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                cells = batch.column("cell").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                bounds = np.append(np.flatnonzero(np.diff(cells, prepend=-1)), len(cells))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    mine = np.flatnonzero((probes == cells[a]).any(axis=1))
                    for t in range(0, len(mine), TILE):
                        some = mine[t : t + TILE]
                        r = (q[some] - centres[cells[a]]).reshape(len(some), parts, width)
                        about = np.zeros((len(some), b - a), np.float32)
                        for p in range(parts):
                            about += _squared(r[:, p], books[p]).astype(np.float32)[:, codes[a:b, p]]
                        if b - a > shortlist:
                            edge[some] = np.minimum(edge[some], np.partition(about, shortlist - 1, axis=1)[:, shortlist - 1])
                        i, j = np.nonzero(about <= edge[some][:, None])
                        if len(i):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[i])), batch.column("chunk_id").take(pa.array(a + j)), pa.array(about[i, j])], names=schema.names)

    probed = [int(c) for c in np.unique(probes)]
    found = index.codes.filter(F.col("cell").isin(probed)).mapInArrow(run, schema)
    return ranked(found.withColumnRenamed("about", "d2"), shortlist).select("example_id", "chunk_id")


def search(index: Index | None, queries: DataFrame, corpus: DataFrame, k: int, nprobe: int = NPROBE, shortlist: int = SHORTLIST, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries: example_id, embedding. example_id, chunk_id, d2, rank, as `vectors.knn` gives them; corpus: what the index was built from."""
    spark = queries.sparkSession
    dim = index.centres.shape[1] if index else 0
    queries = queries.filter(usable(dim)).select("example_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = T.StructType([queries.schema["example_id"], corpus.schema["chunk_id"]])
    listed = None
    if index:
        blocks = max(1, math.ceil(queries.count() * dim * 8 / query_bytes))
        for i in range(blocks):
            mine = queries.filter(F.pmod(F.xxhash64("example_id"), F.lit(blocks)) == i).toPandas()
            if len(mine):
                near = _near_codes(index, mine, nprobe, max(k, shortlist), queries.schema["example_id"])
                near = kept(near) if blocks > 1 else near
                listed = near if listed is None else listed.unionByName(near)
    if listed is None:
        listed = spark.createDataFrame([], schema)
    pairs = listed.distinct().join(queries.withColumnRenamed("embedding", "q"), "example_id").join(corpus.select("chunk_id", "embedding"), "chunk_id")
    return ranked(pairs.select("example_id", "chunk_id", squared_distance(F.col("q"), F.col("embedding")).alias("d2")), k)


def knn_ivf(queries: DataFrame, corpus: DataFrame, k: int, nprobe: int = NPROBE, shortlist: int = SHORTLIST, **build_options: int) -> DataFrame:
    """Builds an index and searches it."""
    return search(build(corpus, **build_options), queries, corpus, k, nprobe, shortlist)


def recall(found: DataFrame, exact: DataFrame, ks: list[int]) -> DataFrame:
    """k, n_queries, n_true, recall: the share of the exact k nearest that are among the k found. Queries are those of `exact`."""
    true = exact.select("example_id", "chunk_id", F.col("rank").alias("true_rank"))
    met = true.join(found.select("example_id", "chunk_id", "rank"), ["example_id", "chunk_id"], "left")
    each = [F.struct(F.lit(k).alias("k"), F.count_if(F.col("true_rank") <= k).alias("n_true"), F.count_if((F.col("true_rank") <= k) & (F.col("rank") <= k)).alias("n_found")) for k in ks]
    rows = met.agg(F.count_distinct("example_id").alias("n_queries"), F.array(*each).alias("each")).select("n_queries", F.inline("each"))
    return rows.select("k", "n_queries", "n_true", F.coalesce(F.try_divide("n_found", "n_true"), F.lit(1.0)).alias("recall"))
