"""Questions of documents to the whole corpus, by way of blocks of documents.

A block is all documents whose id (without one: whose text) has the same hash modulo n. A block asks about keys (64-bit fingerprints): it sends
each key once, however many of its documents hold it, so that a key has as many rows as there are blocks, and none is hot. The keys of a
block that belong to one part of the key space travel as one row of packed arrays; numpy sorts a part at a time; what the blocks need to
know returns to them by block, packed likewise.

n is the session's number of shuffle partitions, or more where blocks would hold more than BLOCK_BYTES of text: so blocks and parts stay
a few megabytes, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, doc_columns, partitions

BLOCK_BYTES = 12 << 20


def block_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return max(partitions(docs), math.ceil(size / BLOCK_BYTES))


def in_blocks(docs: DataFrame, *more: str) -> tuple[DataFrame, int]:
    """block, doc_id, text, and the columns named; the number of blocks."""
    n = block_count(docs)
    found = doc_columns(docs, *more)
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return found.withColumn("block", F.pmod(own, F.lit(n)).cast("int")), n


def per_block(blocks: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on the documents of each block."""
    return blocks.groupBy("block").applyInArrow(fn, schema)


def per_block_with(blocks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on the documents of each block and the answers that it got; both may be without rows, but not both at once."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, schema)


def part_of(key: np.ndarray, n: int) -> np.ndarray:
    """The part of the key space (of n, in the order of keys) that an unsigned 64-bit key is in."""
    return ((key >> U64(32)) * U64(n) >> U64(32)).astype(np.int32)


def _pieces(data: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """The bytes of data[bounds[i] : bounds[i + 1]] for each i."""
    width = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    data = np.ascontiguousarray(data).reshape(-1)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64).tobytes()), pa.py_buffer(data.view(np.uint8).data)]).cast(pa.binary())


def asked(n: int, block: int, key: np.ndarray, send_key: bool = True, **columns: np.ndarray) -> pa.Table:
    """Rows of part, block, and packed arrays; key: unsigned, sorted; without send_key, the columns hold what is needed of it."""
    part = part_of(key, n)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = np.append(first, len(key))
    return pa.table({"part": part[first], "block": np.full(len(first), block, np.int32)} | {k: _pieces(v, bounds) for k, v in (({"key": key} if send_key else {}) | columns).items()})


def answered(block: np.ndarray, level: int, **columns: np.ndarray) -> pa.Table:
    """Rows of block, level, and packed arrays; block: of each value, in any order."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.diff(block, prepend=-1))
    bounds = np.append(first, len(block))
    return pa.table({"block": block[first].astype(np.int32), "level": np.full(len(first), level, np.int32)} | {k: _pieces(v[order], bounds) for k, v in columns.items()})


def unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    """The values of a packed column, row after row."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def blocks_of(table: pa.Table, name: str, width: int) -> np.ndarray:
    """The block of each value of a packed column whose values have `width` bytes."""
    sizes = np.array([len(x) // width for x in table.column(name).to_pylist()], np.int64)
    return np.repeat(column(table, "block"), sizes)


def resolve(rows: DataFrame, n: int, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on whole parts of the key space, some of them together; rows: what `asked` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            yield from fn(pa.Table.from_batches(got)).to_batches()

    return rows.repartitionById(n, "part").mapInArrow(run, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the keys, and for each place of that order the number of its run of equal keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.empty(len(k), bool)
    new[:1] = True
    new[1:] = k[1:] != k[:-1]
    return order, np.cumsum(new) - 1
