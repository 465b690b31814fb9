"""Nearest neighbours of many queries by random projections: a similarity join with several probes and counts of collisions.

Each of `tables` hash functions cuts WIDTH random projections into buckets of one length. A query lies in its own bucket and in those `probes` - 1 around it whose borders are
nearest; a corpus row looks up one bucket of each table. A pair that meets in `agree` tables or more is a candidate, and candidates are compared exactly, where they meet.

The length is set from distances: the exact neighbours of ASKED queries, chosen by a hash of their ids, are hashed with ever smaller lengths, and the least one is taken that still makes
`wanted` of those pairs candidates (pairs at distance 0 always are and don't count). So the wanted recall fixes how much is compared: little among clusters, and most pairs where all distances are
alike.

Blocks of queries (`query_bytes` of vectors) go to the tasks that read the corpus, which is not shuffled, so a bucket is spread over all of them, however many rows it holds. Within a task rows are
taken in runs that meet PAIRS times at most (a single row meets each query once a table), and each run keeps k rows a query; only those are shuffled.

Vectors that are null, of another dimension than the longest of the corpus, or hold a null, nan or infinity are never found, and such queries find nothing. Equal distances are ordered by chunk_id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.sources.tables import kept

from .ann import usable
from .vectors import knn, ranked

TABLES, WIDTH, PROBES, AGREE = 12, 4, 16, 2
#: Queries whose exact neighbours set the length of buckets, and the share of those neighbours that must become candidates.
ASKED, WANTED = 128, 0.95
#: Bytes of query vectors that are sent to the workers at once (their keys take some four times as much), and queries that are hashed together.
QUERY_BYTES, HASHED = 8 << 20, 4096
#: Meetings that a task counts at once, and pairs whose vectors it compares at once.
PAIRS, COMPARED = 1 << 19, 1 << 14
STEPS = np.array(list(itertools.product((0, -1, 1), repeat=WIDTH)))


class Hashes(NamedTuple):
    """directions: table, place, component; shifts: table, place (0 to 1); mixers: place."""

    directions: np.ndarray
    shifts: np.ndarray
    mixers: np.ndarray
    length: float

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        """The projections of rows in units of the length."""
        return x @ self.directions[table].T / self.length + self.shifts[table]

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        return self._mixed(np.floor(self.places(x, table)))

    def probed(self, q: np.ndarray, table: int, probes: int) -> np.ndarray:
        """A row of `probes` keys for each query, that of its own bucket first."""
        at = self.places(q, table)
        low = at - np.floor(at)
        far = np.where(STEPS[:, None] < 0, low, np.where(STEPS[:, None] > 0, 1 - low, 0.0)).transpose(1, 0, 2)  # query, step, place
        order = np.argsort((far * far).sum(2), axis=1, kind="stable")[:, :probes]
        return self._mixed(np.floor(at)[:, None] + STEPS[order])

    def _mixed(self, buckets: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (buckets.astype(np.int64) * self.mixers).sum(-1)


def draw(dim: int, tables: int, length: float, seed: int) -> Hashes:
    r = np.random.default_rng(seed)
    return Hashes(r.normal(size=(tables, WIDTH, dim)), r.random((tables, WIDTH)), r.integers(1 << 61, 1 << 62, WIDTH) | 1, length)


def agreeing(hashes: Hashes, q: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """In how many tables each row of q meets the same row of c."""
    return sum((hashes.probed(q, t, probes) == hashes.keys(c, t)[:, None]).any(axis=1).astype(int) for t in range(len(hashes.directions)))


def fit_length(hashes: Hashes, q: np.ndarray, c: np.ndarray, probes: int, agree: int, wanted: float) -> float:
    """The least length, to within a hundredth, that makes `wanted` of the pairs (row by row) candidates."""
    d = np.sqrt(((q - c) ** 2).sum(1))
    q, c, d = q[d > 0], c[d > 0], d[d > 0]
    if not len(d):
        return 1.0
    enough = lambda length: (agreeing(hashes._replace(length=length), q, c, probes) >= agree).mean() >= wanted
    low, high = d.min() / 64, d.max()
    while not enough(high):
        high *= 2
    while high / low > 1.01:
        middle = math.sqrt(low * high)
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def _found_in(base: DataFrame, ids: pa.Array, q: np.ndarray, hashes: Hashes, k: int, probes: int, agree: int, limit: float, schema: T.StructType) -> DataFrame:
    shared = base.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        tables = []
        for t in range(len(hashes.directions)):
            keys = np.concatenate([hashes.probed(q[a : a + HASHED], t, probes) for a in range(0, len(q), HASHED)])
            order = np.argsort(keys, axis=None, kind="stable")
            tables.append((keys.ravel()[order], (order // keys.shape[1]).astype(np.int32)))
        edge = np.full(len(q), limit)  # no further row is among the k nearest of a query
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
            met = []
            for t, (keys, _) in enumerate(tables):
                mine = hashes.keys(c, t)
                a = np.searchsorted(keys, mine, "left")
                met.append((a, np.searchsorted(keys, mine, "right") - a))
            upto = np.cumsum(sum(n for _, n in met))
            start = 0
            while start < batch.num_rows:
                done = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
                i, j = _candidates(met, tables, start, end, len(q), agree)
                found = _nearest(q, c, i, j, edge, k, batch.column("chunk_id"))
                if len(found):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(found["q"].to_numpy())), batch.column("chunk_id").take(pa.array(found["c"].to_numpy())), pa.array(found["d2"].to_numpy())], names=schema.names)
                start = end

    return base.mapInArrow(run, schema)


def _candidates(met: list, tables: list, start: int, end: int, n: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of rows start to end that meet in `agree` tables."""
    pairs = []
    for (a, counts), (_, queries) in zip(met, tables, strict=True):
        counts = counts[start:end]
        first = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(a[start:end] - first, counts)
        pairs.append(np.repeat(np.arange(end - start) * n, counts) + queries[at])
    pairs = np.concatenate(pairs)
    if (end - start) * n <= 4 * max(len(pairs), PAIRS):
        pairs = np.flatnonzero(np.bincount(pairs, minlength=1) >= agree)
    else:
        pairs, times = np.unique(pairs, return_counts=True)
        pairs = pairs[times >= agree]
    return pairs % n, start + pairs // n


def _nearest(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, edge: np.ndarray, k: int, chunk: pa.Array) -> pd.DataFrame:
    """q, c, d2: of the candidates, the k nearest of each query that lie within its edge; edges come closer."""
    near = []
    for a in range(0, len(i), COMPARED):
        x, y = i[a : a + COMPARED], j[a : a + COMPARED]
        about = ((q[x] - c[y]) ** 2).sum(1)
        inside = about <= edge[x] + 1e-6
        x, y = x[inside], y[inside]
        near.append(pd.DataFrame({"q": x, "c": y, "d2": ((q[x] - c[y]) ** 2).cumsum(axis=1)[:, -1]}))
    if not near:
        return pd.DataFrame()
    found = pd.concat(near)
    found["chunk"] = chunk.take(pa.array(found["c"].to_numpy())).to_pandas().to_numpy()
    found = found.sort_values(["q", "d2", "chunk"]).groupby("q").head(k)
    full = found.groupby("q")["d2"].agg(["size", "max"]).query("size == @k")
    edge[full.index] = np.minimum(edge[full.index], full["max"])
    return found


def knn_lsh(queries: DataFrame, corpus: DataFrame, k: int, radius: float | None = None, wanted: float = WANTED, tables: int = TABLES, probes: int = PROBES, agree: int = AGREE, seed: int = 0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """queries: example_id, embedding; corpus: chunk_id, embedding. example_id, chunk_id, d2, rank, as `vectors.knn` gives them, of neighbours within the radius, if one is given."""
    spark = queries.sparkSession
    dim = corpus.agg(F.max(F.size("embedding"))).first()[0] or 0
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    queries = queries.filter(usable(dim)).select("example_id", as_double)
    base = corpus.filter(usable(dim)).select("chunk_id", as_double)
    schema = T.StructType([queries.schema["example_id"], base.schema["chunk_id"], T.StructField("d2", T.DoubleType())])
    n = queries.count() if dim > 0 else 0
    if not n:
        return ranked(spark.createDataFrame([], schema), k)
    asked = queries.orderBy(F.xxhash64("example_id", F.lit(seed)), "example_id").limit(ASKED)
    true = knn(asked, base, k).join(asked.withColumnRenamed("embedding", "q"), "example_id").join(base, "chunk_id").select("q", "embedding").toPandas()  # ASKED * k pairs at most
    hashes = draw(dim, tables, 1.0, seed)
    sides = (np.array(true[c].tolist(), np.float64).reshape(len(true), dim) for c in ("q", "embedding"))
    hashes = hashes._replace(length=fit_length(hashes, *sides, probes, agree, wanted))
    limit = math.inf if radius is None else radius * radius
    blocks = max(1, math.ceil(n * dim * 8 / query_bytes))
    out = None
    for b in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("example_id"), F.lit(blocks)) == b).toPandas()
        if len(mine):
            found = _found_in(base, pa.array(mine["example_id"]), np.array(mine["embedding"].tolist(), np.float64), hashes, k, probes, agree, limit, schema)
            near = ranked(found.filter(F.col("d2") <= limit), k)
            near = kept(near) if blocks > 1 else near
            out = near if out is None else out.unionByName(near)
    return out
