"""Compression of vectors to codes: each of PARTS equal parts of a vector becomes the number of its nearest codebook entry.

Codebooks are learned by k-means on integers, over all vectors, with the assignments of ball k-means. An entry and the parts that it holds are a ball.
With d the distance of a part to its present entry, an entry that is as near lies within 2 d of that entry; so the ball's radius tells which entries
are its neighbours at all; parts nearer to the entry than half way to its closest neighbour are its stable core and stay without a comparison; the others lie in rings,
by how many neighbours are within their 2 d, and are compared with those alone. All comparisons are of exact integers, so the result is that of comparing everything.

A round is one narrow pass: its tasks assign their vectors, write them with their codes, and add up their parts by entry; the sums of all tasks
(some thousand numbers an entry and part, whatever the corpus) make the next codebooks on the driver. A round's table is deleted when the next one is written.

Vectors that are null or hold a null or non-finite component are dropped. A vector shorter than the longest one (or than a multiple of PARTS) counts as if
zeros followed. Rows that repeat a vec_id are rows like others; a null vec_id begins no codebook; with fewer vectors than entries, codebooks are as small. Empty
tables give no rows. Other columns are neither read nor returned. A scaled component of 2^20 or more is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import folder, forget, read, written
from .integers import added, finite, floored, longest, packed, unpacked

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Ends of the rings, as numbers of neighbours: each four times the one before.
RINGS = 4
#: Labels up to so many are sent to all tasks; more are joined by a shuffle that splits hot ones.
BROADCAST_LABELS = 100_000
#: Vectors that a worker looks at together.
STEP = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b: exact, as all are integers below 2^53."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


def all_compared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each row, of equals the first."""
    return squared(x, book).argmin(1)


def by_balls(x: np.ndarray, book: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The same, from entries that the rows were in before; see the module."""
    between = squared(book, book)
    order = np.argsort(between, axis=1, kind="stable")
    near = np.take_along_axis(between, order, 1)  # each entry's distances to all, itself among the first
    own = ((x - book[now]) ** 2).sum(1).astype(np.float64)
    reach = 4 * own
    out = now.copy()
    np.fill_diagonal(between, np.inf)
    moving = np.flatnonzero(reach >= between.min(1)[now])  # outside of the stable cores; at equality the other entry may be as near
    moving = moving[np.argsort(now[moving], kind="stable")]
    bounds = np.append(np.flatnonzero(np.diff(now[moving], prepend=-1)), len(moving))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine, entry = moving[a:b], int(now[moving[a]])
        neighbours = order[entry, : np.searchsorted(near[entry], reach[mine].max(), "right")]  # within the ball's reach
        ring = np.searchsorted(near[entry, : len(neighbours)], reach[mine], "right")
        low, size = 0, RINGS
        while low < len(neighbours):
            these = mine[(ring > low) & (ring <= size)]
            if len(these):
                some = np.sort(neighbours[:size])
                out[these] = some[squared(x[these], book[some]).argmin(1)]
            low, size = size, size * RINGS
    return out


def _passed(rows: DataFrame, books: list[np.ndarray], first: bool, kind: T.DataType) -> DataFrame:
    """One pass: rows with their codes and errors, and, in rows of their own (with a key), the tasks' sums by part and entry."""
    parts, width = len(books), books[0].shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("q", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("key", T.IntegerType()), T.StructField("sums", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, sums = shared.value, {}
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                some = batch.slice(start, STEP)
                x = unpacked(some.column("q"), np.int32, parts * width).astype(np.int64)
                codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                before = None if first else unpacked(some.column("code"), np.uint8, parts).astype(np.int64)
                for p, book in enumerate(books):
                    mine = x[:, p * width : (p + 1) * width]
                    found = all_compared(mine, book) if first else by_balls(mine, book, before[:, p])
                    codes[:, p] = found
                    error += ((mine - book[found]) ** 2).sum(1)
                    order = np.argsort(found, kind="stable")
                    begins = np.flatnonzero(np.diff(found[order], prepend=-1))
                    counts = np.diff(np.append(begins, len(order)))
                    for entry, total, n in zip(found[order[begins]].tolist(), np.add.reduceat(mine[order], begins), counts.tolist(), strict=True):
                        key = p * ENTRIES + entry
                        sums[key] = sums.get(key, 0) + np.append(total, n)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), some.column("q"), packed(codes), pa.array(error), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary())], names=schema.names)
        if sums:
            none = [pa.nulls(len(sums), kind) for kind in (pa.int64(), batch.schema.field("label").type, pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(list(sums), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in sums.values()], pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def encode(df: DataFrame, scale: int = SCALE, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """df: vec_id, embedding, label. vec_id, label, code (a byte for each part), error; and the codebooks (a row for each entry). entries: 256 at most."""
    if not 0 < entries <= ENTRIES:
        raise ValueError("entries is 1 to 256")
    spark = df.sparkSession
    base = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").filter(finite("embedding"))
    size = longest(base, "embedding")
    size = max(PARTS, -(-size // PARTS) * PARTS)
    kind = base.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("q", T.BinaryType())])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed(floored(batch.column("embedding"), scale, size).astype(np.int32))], names=schema.names)

    rows = base.mapInArrow(scaled, schema)
    begin = rows.filter("vec_id is not null").orderBy("vec_id", "q").limit(entries).select("q").toArrow().column("q").combine_chunks()  # a codebook's worth
    vectors = unpacked(begin, np.int32, size).astype(np.int64) if len(begin) else np.zeros((1, size), np.int64)
    books, old = np.split(vectors, PARTS, axis=1), None
    for i in range(rounds + 1):
        path = folder(spark, f"codes-{i}")
        table = written(_passed(rows, books, i == 0, kind), "codes", path)
        if old:
            forget(spark, old)
        old, rows = path, table.filter("key is null").drop("key", "sums")
        if i < rounds:
            books = [b.copy() for b in books]
            for key, s in added(table.filter("key is not null").select("key", "sums")).items():
                books[key // ENTRIES][key % ENTRIES] = s[:-1] // s[-1]
    return rows.drop("q"), books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the errors of all rows of the label, added up; nulls are one label."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    few = coded.select("label").distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(read(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    distance = "CAST(list_inner_product(p.v, p.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(p.v, c.v) AS BIGINT)"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, label, pos, v[pos * 16 + 1 : pos * 16 + 16] AS v FROM k, (SELECT unnest(range(4)) AS pos))",
        "c0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 256)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.pos, p.v, min({{'d': {distance}, 'entry': c.entry}}) AS best FROM p JOIN c{r} c USING (pos) GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"m{r} AS MATERIALIZED (SELECT pos, entry, list(m ORDER BY i) AS v FROM (SELECT pos, best.entry AS entry, i, floor(sum(v[i]) / count(*)) AS m FROM a{r}, (SELECT unnest(range(1, 17)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.pos, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON c.pos = m.pos AND c.entry = m.entry)")
    last = ROUNDS
    return f"""WITH {", ".join(steps)},
e AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best.entry), '' ORDER BY pos) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{last} GROUP BY 1, 2),
b AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM c{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, b"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
