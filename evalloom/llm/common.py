"""What the operators share: words, tables, shared-folder tables and document-wise Arrow maps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the space and U+0009 to U+000D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: str) -> str:
    """A-Z lower-cased, all other characters unchanged."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's; in local mode, where all is one machine, one of our own if it names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR") or "/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The same rows as a Parquet table in the shared folder; path: one that `folder` gave, for who wants to delete it later."""
    spark = df.sparkSession
    path = path or folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `written` made, once nothing that is still to be computed reads it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions: what a cluster sets in proportion to its data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about SLICE_BYTES of text, one document at least."""
    for batch in batches:
        at, n = 0, batch.num_rows
        lengths = batch.column(text).nbytes if n else 0
        if lengths <= SLICE_BYTES:
            if n:
                yield batch
            continue
        column = batch.column(text)
        measured = pc.binary_length(column) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) else pc.list_value_length(column)
        sizes = np.cumsum(pc.fill_null(measured, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < n:
            start = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, start + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A narrow Arrow map over slices of documents; df has a column named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield fn(part)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of a word, remembered while the table is small."""

    MOST = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


def all_word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of several texts in one array, and the number of words of each."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(texts)), U64, int(sizes.sum())), sizes


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a public finaliser of multiply and shift)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_ODD = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def windows(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each run of `length` consecutive word hashes; empty if there are fewer.

    Doubles prefix fingerprints, so that a window of n words costs about log2(n) array steps; long inputs go in pieces."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    piece = max(1 << 15, 4 * length)
    if n <= piece:
        return _windows(h, length, seed)
    out = np.empty(n, U64)
    for a in range(0, n, piece):
        out[a : a + piece] = _windows(h[a : a + piece + length - 1], length, seed)
    return out


def _windows(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    n = len(h) - length + 1
    out, have, power, width, need = None, 0, mix(h + _ODD[seed % 256]), 1, length
    level = 0
    while need:
        if need & 1:
            part = power[have : have + n]
            out = part if out is None else mix(out * _ODD[(level + 1) % 256] + part)
            have += width
        need >>= 1
        level += 1
        if need:
            power = mix(power[: len(power) - width] * _ODD[(level + 101) % 256] + power[width:])
            width *= 2
    return mix(out + U64(length))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def doc_columns(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, and no other columns but those named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
