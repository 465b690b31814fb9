"""Embedding tables and nearest neighbours.

queries: example_id, embedding; corpus: chunk_id, embedding. Results: example_id, chunk_id, d2 (squared distance, in double), rank from 1;
equal distances are ordered by chunk_id. Rows with a null embedding are never found and find nothing; nor do those with a null or nan component.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evalloom.functions.text import let
from evalloom.sources.commits import Set
from evalloom.sources.tables import forget, kept, kept_at, scratch

from .chunking import build_docstore, chunk_corpus
from .judging import NO_CONTEXT

#: Bytes of query vectors that are sent to the workers at once; more queries are searched block by block.
QUERY_BYTES = 32 << 20
#: Rows that a task compares at once, distances that it holds at once (of some queries to those rows), and pairs whose vectors it holds at once.
ROWS, TILE, COMPARED = 8192, 1 << 19, 1 << 15


def embed(df: DataFrame, fn: Callable[[list[str]], np.ndarray], batch_size: int = 32, text: str = "text", out: str = "embedding") -> DataFrame:
    """df with the array<float> column `out`, by fn on batches of texts. A null text has a null embedding."""
    base = df.drop(out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), batch_size):
                part = frame.iloc[a : a + batch_size].copy()
                there = part[text].notna()
                vectors = iter(np.asarray(fn(part.loc[there, text].tolist()), np.float32)) if there.any() else iter(())
                part[out] = [next(vectors) if x else None for x in there]
                yield part

    return base.mapInPandas(run, schema)


def check_embeddings(df: DataFrame, dim: int) -> DataFrame:
    """The rows whose embedding is null or of another dimension."""
    return df.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)


def index_info(df: DataFrame) -> DataFrame:
    return df.agg(F.count("embedding").alias("n_vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k rows of least d2 for each example_id; equal ones by chunk_id."""
    order = Window.partitionBy("example_id").orderBy("d2", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k nearest of the corpus for each query, exactly. The corpus is read once for each block of queries and not shuffled: its
    tasks keep the k nearest of some rows at a time, and only those meet by query. With several blocks, each one's result is written before the next
    one's vectors are fetched, so that driver and workers hold one block at a time."""
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    queries = queries.filter(F.col("embedding").isNotNull()).select("example_id", as_double)
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, math.ceil(n * (dim or 1) * 8 / query_bytes))
    id_type = corpus.schema["chunk_id"].dataType
    schema = T.StructType([queries.schema["example_id"], T.StructField("chunk_id", id_type), T.StructField("d2", T.DoubleType())])
    base = corpus.filter(F.col("embedding").isNotNull()).select("chunk_id", as_double)
    found = None
    for i in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("example_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        ids, q = (mine.column(c).combine_chunks() for c in ("example_id", "embedding"))
        shared = queries.sparkSession.sparkContext.broadcast((ids, matrix(q, dim or 0)))
        near = ranked(_nearest_in(base, shared, k, schema), k)
        if blocks > 1:
            near = kept(near)
            shared.destroy()
        found = near if found is None else found.unionByName(near)
    return found


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A row for each vector; a null component is nan."""
    if len(vectors) and pc.min_max(pc.list_value_length(vectors)).as_py() != {"min": dim, "max": dim}:
        raise ValueError(f"not all vectors have {dim} components")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dim)


def _nearest_in(base: DataFrame, shared, k: int, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        norms = (q * q).sum(1)
        best = np.full((len(q), k), np.inf)  # of each query so far: no further row is among its nearest
        for whole in batches if len(q) else ():
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                c, chunk = matrix(batch.column("embedding"), q.shape[1]), batch.column("chunk_id")
                place = np.empty(len(c), np.int64)
                place[pc.sort_indices(chunk, null_placement="at_start").to_numpy()] = np.arange(len(c))
                step = max(1, TILE // len(c))
                tiles = [_nearest(q[a : a + step], norms[a : a + step], best[a : a + step], c, place, k) for a in range(0, len(q), step)]
                i = np.concatenate([t * step + x[0] for t, x in enumerate(tiles)])
                j, d2 = (np.concatenate([x[y] for x in tiles]) for y in (1, 2))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), chunk.take(pa.array(j)), pa.array(d2)], names=schema.names)

    return base.mapInArrow(run, schema)


def _nearest(q: np.ndarray, norms: np.ndarray, best: np.ndarray, c: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in q and c, and d2: for each query the k nearest rows, less those that its best ones rule out; these come closer. place: the order of the rows' ids."""
    sizes = (c * c).sum(1)
    about = q @ c.T
    about *= -2
    about += norms[:, None]
    about += sizes
    about[np.isnan(about)] = np.inf
    edge = best.max(1)
    if len(c) > k and np.isinf(edge).any():
        edge = np.minimum(edge, np.partition(about, k - 1, axis=1)[:, k - 1])
    with np.errstate(invalid="ignore"):
        slack = 1e-6 + 1e-10 * (norms + sizes.max())  # more than the error of `about`
    i, j = np.nonzero(about <= np.where(np.isfinite(slack), edge + slack, np.inf)[:, None])
    d2 = np.empty(len(i))
    for a in range(0, len(i), COMPARED):
        d2[a : a + COMPARED] = ((q[i[a : a + COMPARED]] - c[j[a : a + COMPARED]]) ** 2).cumsum(axis=1)[:, -1] if q.shape[1] else 0.0
    order = np.lexsort((place[j], d2, i))
    order = order[~np.isnan(d2[order])]
    i, j, d2 = i[order], j[order], d2[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    few = nth < k
    i, j, d2, nth = i[few], j[few], d2[few], nth[few]
    new = np.full(best.shape, np.inf)
    new[i, nth] = d2
    best[:] = np.partition(np.concatenate([best, new], axis=1), k - 1, axis=1)[:, :k]
    return i, j, d2


def retrieve(queries: DataFrame, corpus: DataFrame, docstore: DataFrame, k: int = 5, score: str = "similarity") -> DataFrame:
    """The k nearest with their texts; a chunk that the docstore lacks is dropped. score: similarity (-d2) or distance."""
    if score not in ("similarity", "distance"):
        raise ValueError("score is similarity or distance")
    value = (-F.col("d2")).alias("similarity_score") if score == "similarity" else F.col("d2").alias("score")
    texts = docstore.select("chunk_id", F.col("text").alias("chunk_text"), "document_id")
    return knn(queries, corpus, k).join(texts, "chunk_id").select("example_id", "rank", "chunk_id", "document_id", "chunk_text", value)


def missing_chunks(index: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new whose chunk_id the index lacks, each id once."""
    return new.join(index.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])


def _index_of(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return index_info(Set(spark, path).read("embeddings", version))


def read_index(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Docstore and embeddings of one version of an index, the last complete one by default."""
    store = Set(spark, path)
    version = store.versions()[-1] if version is None else version
    return store.read("docstore", version), store.read("embeddings", version)


def build_index(docs: DataFrame, fn: Callable[[list[str]], np.ndarray], path: str, method: str = "fixed_size", **params: int) -> DataFrame:
    """Chunks documents (document_id, text), commits docstore and embeddings below path as one version, and gives the index's info. No chunk at all is an error."""
    spark = docs.sparkSession
    where = scratch(spark)
    store = kept_at(build_docstore(chunk_corpus(docs, method, **params)), where)
    if store.isEmpty():
        raise ValueError("no chunks to index")
    Set(spark, path).commit({"docstore": store, "embeddings": embed(store.select("chunk_id", "text"), fn).select("chunk_id", "embedding")})
    forget(spark, where)
    return _index_of(spark, path)


def append_index(docs: DataFrame, fn: Callable[[list[str]], np.ndarray], path: str, method: str = "fixed_size", **params: int) -> DataFrame:
    """Adds the documents' chunks that the index below path lacks, in one version, so that doing it again adds nothing; gives the index's info."""
    spark = docs.sparkSession
    where = scratch(spark)
    old = Set(spark, path).read("embeddings")
    new = kept_at(embed(missing_chunks(old, build_docstore(chunk_corpus(docs, method, **params))), fn), where)
    if not new.isEmpty():
        Set(spark, path).commit(add={"docstore": new.select("chunk_id", "text", "document_id", "metadata"), "embeddings": new.select("chunk_id", "embedding")})
    forget(spark, where)
    return _index_of(spark, path)


INSIDE, GRAM = 3, 6
#: Bytes of questions that are sent to all tasks; more are joined by a shuffle.
ASKED_BYTES = 8 << 20


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    letters = F.split(text, "")
    starts = F.when(F.size(letters) >= size, F.sequence(F.lit(1), F.size(letters) - size + 1))
    return F.array_distinct(let(letters, lambda x: F.transform(starts, lambda i: F.array_join(F.slice(x, i, size), ""))))


def _holding_short(chunks: DataFrame, short: DataFrame) -> DataFrame:
    """Pairs for questions that have no inner words to be found by. Questions below GRAM characters are themselves what chunks are looked through for; longer ones meet the chunks that hold
    their rarest run of GRAM characters."""
    sizes = [r[0] for r in short.select(F.least(F.char_length("question"), F.lit(GRAM)).alias("n")).filter("n > 0").distinct().collect()]  # GRAM numbers at most
    out = None
    few = (short.agg(F.sum(F.octet_length("question") + 16)).first()[0] or 0) <= ASKED_BYTES
    sent = F.broadcast if few else (lambda df: df)
    for size in sizes:
        mine = short.filter(F.least(F.char_length("question"), F.lit(GRAM)) == size)
        held = chunks.withColumn("_gram", F.explode(_grams(F.col("text"), size)))
        if size < GRAM:
            asked = mine.withColumn("_gram", F.col("question"))
        else:
            each = mine.select("question").distinct().select("question", F.explode(_grams(F.col("question"), size)).alias("_gram"))
            counts = held.join(sent(each.select("_gram").distinct()), "_gram", "left_semi").groupBy("_gram").agg(F.count("*").alias("n"))
            rarest = each.join(counts, "_gram", "left").groupBy("question").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "_gram")).alias("x")).select("question", F.col("x._gram").alias("_gram"))
            asked = mine.join(rarest, "question")
        met = held.join(sent(asked), "_gram").drop("_gram").filter(F.contains("text", "question"))
        out = met if out is None else out.unionByName(met)
    return out


def holding(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """The pairs of chunks (text) and questions (question) whose text holds the question as it stands.

    The pieces of a question between spaces, but for its first and last, are pieces of any text that holds it; so the pairs meet by the hash of the
    first INSIDE of those, and are then compared. Questions with fewer pieces meet chunks by runs of characters. An empty question is held by every text, and a null one by none."""
    pieces = F.split("question", " ", -1)
    long = F.size(pieces) >= INSIDE + 2
    asked = questions.filter(long).withColumn("_key", F.xxhash64(F.array_join(F.slice(pieces, 2, INSIDE), " ")))
    words = F.split("text", " ", -1)
    starts = F.when(F.size(words) >= INSIDE, F.sequence(F.lit(1), F.size(words) - INSIDE + 1))
    keys = let(words, lambda w: F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, INSIDE), " "))))
    met = chunks.withColumn("_key", F.explode(F.array_distinct(keys))).join(asked, "_key").drop("_key").filter(F.contains("text", "question"))
    short = questions.filter(~long)
    if short.isEmpty():
        return met
    n = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = chunks.filter("text is not null").withColumn("_deal", F.pmod(F.xxhash64("text"), F.lit(n)))
    every = dealt.join(short.filter("question = ''").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), "_deal").drop("_deal")
    near = _holding_short(chunks, short.filter("question <> ''"))
    return met.unionByName(every) if near is None else met.unionByName(near).unionByName(every)


def score_stats(df: DataFrame, column: str = "similarity_score", by: list[str] | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*(by or [])).agg(F.count(column).alias("n"), zero(F.avg(column)).alias("avg"), zero(F.min(column)).alias("min"), zero(F.max(column)).alias("max"), zero(F.var_pop(column)).alias("variance"))


STYLES = {"space": " ", "paragraph": "\n\n", "labelled": "\n"}


def assemble_context(retrieved: DataFrame, style: str = "space", examples: DataFrame | None = None) -> DataFrame:
    """example_id, context: the retrieved texts in rank order; labelled ones are trimmed and name their chunk.

    examples: all example_ids; those for which nothing was retrieved get an empty context, or the line for none if labelled."""
    text = F.regexp_replace("chunk_text", r"^\s+|\s+$", "")
    text = F.concat(F.lit("[Chunk ID: "), F.col("chunk_id").cast("string"), F.lit("] "), text) if style == "labelled" else F.col("chunk_text")
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("t"))))
    found = retrieved.groupBy("example_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), STYLES[style]).alias("context"))
    if examples is None:
        return found
    none = NO_CONTEXT if style == "labelled" else ""
    return examples.select("example_id").distinct().join(found, "example_id", "left").select("example_id", F.coalesce("context", F.lit(none)).alias("context"))


def retrieved_ids(retrieved: DataFrame) -> DataFrame:
    """example_id, chunk_ids in rank order, n_chunks."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return retrieved.groupBy("example_id").agg(F.transform(listed, lambda x: x["chunk_id"]).alias("chunk_ids"), F.count("*").alias("n_chunks"))
