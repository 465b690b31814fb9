"""Hard negatives: for each anchor and each of its best positives, the best rows of other labels whose score lies in a window below the positive's.

A row's components are integers, floor(scale * x), and a score is an inner product of two rows. Each row is stored with its norm and its angles to some reference
directions. By the triangle inequality for angles, two rows' angle lies between |s - t| and min(s + t, 2 pi - s - t) for every reference to which they have the angles s and t; the
cosines of these bounds, multiplied by the norms and widened beyond all rounding, bound the score. Rows lie ordered by nearest reference and angle, and are looked at
in windows of WINDOW consecutive ones, with the ranges of their angles and norms: a window gets integer scores for those anchors alone whose wanted scores (from the least that would still count,
which rises as better rows are found, to the greatest allowed) overlap the window's bounds. So the result is that of scoring all pairs.

The rows are read once for positives and once for negatives for each block of ANCHOR_BYTES of anchors, and are not shuffled: tasks keep the best of each anchor, and only
those meet by anchor. A block is on the driver at a time, and its results are written before the next one is fetched. References are the mean directions of all rows by label (labels hashed to REFERENCES groups); they
decide how much is skipped, never what is found.

Rows with a null label or vec_id, a null vector, or a null or non-finite component take no part. vec_id names a row: of rows that share one, that of the least label and, then,
vector counts. Vectors shorter than the longest one count as if zeros followed; those of zeros alone score 0. Labels are taken as long. Empty tables give no rows. Other columns are neither read nor returned.
A scaled component of 2^20 or more is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import folder, forget, partitions, read, written
from .integers import added, finite, floored, longest, packed, unpacked

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
REFERENCES, WINDOW = 32, 512
#: Bytes of anchors on the workers at once; those scored together.
ANCHOR_BYTES, TILE = 16 << 20, 1024
#: Angles and scores are widened by so much: far above the error of the arc cosine near 1 (1e-8) and of its cosine times norms.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-6
ROW = "vec_id long, label long, q binary, norm double, angles binary, cell int, angle double, anchor boolean"


def references(base: DataFrame, scale: int, width: int) -> np.ndarray:
    """Directions: the mean of all rows of each group of labels. Rows of length 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((REFERENCES, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                np.add.at(sums, batch.column("bucket").to_numpy(), floored(batch.column("embedding"), scale, width))
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed(sums[some])], names=["key", "sums"])

    rows = base.select(F.pmod(F.xxhash64("label"), F.lit(REFERENCES)).cast("int").alias("bucket"), "embedding")
    found = added(rows.mapInArrow(run, "key int, sums binary"))
    sums = np.array([found[k] for k in sorted(found)], np.float64).reshape(-1, width)
    norms = np.sqrt((sums * sums).sum(1))
    directions = sums[norms > 0] / norms[norms > 0, None]
    return directions if len(directions) else np.eye(1, width)


def prepared(df: DataFrame, anchors: Column, scale: int) -> tuple[DataFrame, int, int]:
    """The rows that take part, each id once, with integers, norms and angles, ordered by nearest reference and angle over the partitions; the width; how many references."""
    spark = df.sparkSession
    base = df.withColumn("_anchor", F.coalesce(anchors.cast("boolean"), F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", F.col("_anchor").alias("anchor"))
    base = base.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite("embedding"))
    width = max(1, longest(base, "embedding"))
    directions = references(base, scale, width)
    shared = spark.sparkContext.broadcast(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toward = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = floored(batch.column("embedding"), scale, width)
            x = q.astype(np.float64)
            norm = np.sqrt((x * x).sum(1))
            angles = np.arccos(np.clip(x @ toward.T / np.maximum(norm, 1)[:, None], -1, 1))
            cell = angles.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(q.astype(np.int32)), pa.array(norm), packed(angles), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(q)), cell]), batch.column("anchor")], names=[x.split()[0] for x in ROW.split(", ")])

    once = base.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("x")).select("vec_id", "x.*")
    rows = once.mapInArrow(run, ROW).repartitionByRange(partitions(df), "cell", "angle", "vec_id").sortWithinPartitions("cell", "angle", "vec_id")
    return rows, width, len(directions)


class Bounds(NamedTuple):
    """Rows or anchors as arrays."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norms: np.ndarray
    angles: np.ndarray


def _arrays(table: pa.Table | pa.RecordBatch, width: int, n: int) -> Bounds:
    return Bounds(*(table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label")), unpacked(table.column("q"), np.int32, width).astype(np.float64), table.column("norm").to_numpy(zero_copy_only=False), unpacked(table.column("angles"), np.float64, n))


def score_bounds(anchors: Bounds, rows: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and greatest score that any of the rows can have."""
    low, high = rows.angles.min(0), rows.angles.max(0)
    t = anchors.angles
    least = np.maximum(np.maximum(low - t, t - high).max(1), 0) - ANGLE_SLACK
    most = np.minimum(np.minimum(t + high, 2 * np.pi - t - low).min(1), np.pi) + ANGLE_SLACK
    # the angle of a row without length is no angle, but its score, 0, lies between all bounds of such a window
    top, bottom = np.cos(np.clip(least, 0, np.pi)), np.cos(np.clip(most, 0, np.pi))
    small, large = rows.norms.min(), rows.norms.max()
    if not small:
        top, bottom = np.ones(len(t)), -np.ones(len(t))
    slack = 1 + SCORE_SLACK * anchors.norms * large
    return anchors.norms * np.where(bottom > 0, small, large) * bottom - slack, anchors.norms * np.where(top > 0, large, small) * top + slack


class Best:
    """The k best rows of each query so far: those of greatest score, and of equals those of smallest id."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = np.full(n, -np.inf)  # a score below this can't come among the k best

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        old = np.isin(self.query, query)
        q, s, i = np.append(self.query[old], query), np.append(self.score[old], score), np.append(self.id[old], ids)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        full = place == self.k - 1
        self.least[q[full]] = s[full]
        top = place < self.k
        self.query, self.score, self.id = np.append(self.query[~old], q[top]), np.append(self.score[~old], s[top]), np.append(self.id[~old], i[top])


def _found(rows: Bounds, anchors: Bounds, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, best: Best) -> None:
    """Adds one window's rows to the best of each query. of: the query's anchor; low, high: the scores that it allows; same: of the anchor's label, or of others."""
    bottom, top = score_bounds(anchors, rows)
    asks = np.flatnonzero((np.maximum(low, best.least) <= top[of]) & (high >= bottom[of]))
    for a in range(0, len(asks), TILE):
        query = asks[a : a + TILE]
        mine, place = np.unique(of[query], return_inverse=True)
        scores = anchors.q[mine] @ rows.q.T
        other = (anchors.labels[mine][:, None] == rows.labels) != same
        if same:
            other |= anchors.ids[mine][:, None] == rows.ids
        scores[other] = -np.inf
        scores = scores[place]
        scores[(scores > high[query][:, None]) | (scores < np.maximum(low, best.least)[query][:, None])] = -np.inf
        if scores.shape[1] > best.k:  # only what can come among the k best of the window
            edge = -np.partition(-scores, best.k - 1, axis=1)[:, best.k - 1]
            scores[scores < edge[:, None]] = -np.inf
        i, j = np.nonzero(scores > -np.inf)
        best.add(query[i], scores[i, j].astype(np.int64), rows.ids[j])


def _searched(rows: DataFrame, anchors: pa.Table, width: int, n: int, same: bool, k: int, wanted: tuple[np.ndarray, np.ndarray, np.ndarray], names: tuple[str, ...]) -> DataFrame:
    """Of each task, the k best rows of each query; wanted: of, low, high of `_found`; names: of the result's query number, id and score."""
    shared = rows.sparkSession.sparkContext.broadcast((_arrays(anchors, width, n), *wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, of, low, high = shared.value
        best = Best(len(of), k)
        for batch in batches:
            for start in range(0, batch.num_rows, WINDOW):
                _found(_arrays(batch.slice(start, WINDOW), width, n), mine, of, low, high, same, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.id), pa.array(best.score)], names=list(names))

    found = rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    order = Window.partitionBy(names[0]).orderBy(F.desc(names[2]), names[1])
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(df: DataFrame, anchors: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """df: vec_id, embedding, label; anchors: which rows are anchors. anchor_id, positive_id, rank, negative_id, positive_score, negative_score: see op13.

    low, high: bounds of a negative's score, in hundredths of the positive's."""
    spark = df.sparkSession
    rows, width, n = prepared(df, anchors, scale)
    rows = written(rows, "rows")
    count = rows.filter("anchor").count()
    blocks = max(1, math.ceil(count * (8 * width + 8 * n + 80 * positives) / anchor_bytes))
    out, names = None, [x.split()[0] for x in ROW.split(", ")]
    for b in range(blocks):
        mine = rows.filter("anchor").filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select(*names[:5]).toArrow().combine_chunks()
        ids = mine.column("vec_id").to_numpy()
        every = np.arange(len(ids)), np.full(len(ids), -np.inf), np.full(len(ids), np.inf)
        path = folder(spark, "positives")
        found = written(_searched(rows, mine, width, n, True, positives, every, ("place", "positive_id", "positive_score")), "positives", path).toArrow().sort_by([("place", "ascending"), ("rank", "ascending")])  # a few for each anchor of the block
        forget(spark, path)
        of, positive, score = (found.column(c).to_numpy() for c in ("place", "positive_id", "positive_score"))
        window = of, -(-score * low // 100).astype(np.float64), (score * high // 100).astype(np.float64)
        near = _searched(rows, mine, width, n, False, negatives, window, ("query", "negative_id", "negative_score"))
        asked = spark.createDataFrame(pa.table({"query": np.arange(len(of)), "anchor_id": ids[of], "positive_id": positive, "positive_score": score}), "query long, anchor_id long, positive_id long, positive_score long")
        near = near.join(F.broadcast(asked), "query").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")  # asked: of one block
        near = written(near, "negatives") if blocks > 1 else near
        out = near if out is None else out.unionByName(near)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


SQL_TEXT = """WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {"op13_hard_negatives": SQL_TEXT}
