"""Substring dedup by level-wise doubling: word windows repeated at one length alone are extended to twice that length.

Removed is each word that lies in a window of `window` words whose words also start, in that order, in a document of smaller id;
windows are judged on the input. The lengths are `window`, and its halves down to about `seed` words: 13 gives 6 and 13, 52 gives
6, 13, 26 and 52.

First level: not every window is sent, but one of each run of neighbours that a window of the next length holds, that of the smallest
fingerprint. Two equal windows of the next length hold the same neighbours, so they choose the same one, and no repeat is lost.
Next levels: a window is a candidate if the window that it was extended from was found in two documents or more; all others are
dropped. The levels end when no candidate is left or the full length is reached. At the full length a block learns which windows
an earlier document of another block holds.

A window's fingerprint has 64 bits; at the full length 96 bits are compared across blocks, and 128 within one. Words are found and hashed as bytes,
and the kept ones joined as bytes; no list of words is made.

Nulls: a null text has no words and keeps the empty text; rows with a null doc_id are never earlier than others, and each of them
loses what a row with an id holds. Rows that share a doc_id are the same document to each other: they do not make each other lose words. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answered, asked, blocks_of, column, in_blocks, per_block, per_block_with, resolve, unpacked
from .common import U64, mix, read, windows
from .wordbytes import Words

WINDOW, SEED = 13, 6
NO_ID = np.iinfo(np.int64).max
SPACE = 0x20
_ODD = U64(0xD6E8FEB86659FD93)


def lengths(window: int = WINDOW, seed: int = SEED) -> list[int]:
    out = [window]
    while out[0] >= 2 * seed:
        out.insert(0, out[0] // 2)
    return out


def smallest_of_runs(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the smallest."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    low, have = h, 1
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[width - have : width - have + n])


def members(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values known."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Block:
    """The documents of a block: their words' hashes, in one array, and their ids."""

    def __init__(self, table: pa.Table):
        self.number = table.column("block")[0].as_py()
        self.ids = table.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = Words(table.column("text"))

    def check(self, at: np.ndarray, length: int) -> np.ndarray:
        """A further 64-bit fingerprint of the windows that begin at these words."""
        h, out = self.words.hashes, np.zeros(len(at), U64)
        for j in range(length):
            out = out * _ODD + h[at + j]
        return mix(out)

    def anchors(self, first: int, after: int) -> np.ndarray:
        """For each window of `after` words, by its first: the smallest fingerprint of its windows of `first` words."""
        return smallest_of_runs(windows(self.words.hashes, first), after - first + 1)

    def candidates(self, levels: list[int], level: int, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of levels[level] that are candidates, and those windows' fingerprints.
        found: the repeated fingerprints of each level before, sorted."""
        low = self.anchors(levels[0], levels[1])
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        at = np.flatnonzero(self.words.whole(levels[1]) & members(low[new], found[0])[np.cumsum(new) - 1])
        for i in range(1, level):
            h = windows(self.words.hashes, levels[i])
            good = np.zeros(len(h) + 1, bool)
            good[at] = members(h[at], found[i])
            at = at[good[at] & good[np.minimum(at + levels[i + 1] - levels[i], len(h))]]
            whole = self.words.whole(levels[i + 1])
            at = at[at < len(whole)]
            at = at[whole[at]]
        return at, windows(self.words.hashes, levels[level])[at]


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and whether several documents hold it."""
    order = np.argsort(key)
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at) if len(at) else np.empty(0, bool)
    return key[at], several


def _firsts(key: np.ndarray, check: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key, check and id, and which places of it are the first of their key and check."""
    order = np.argsort(key)
    k = key[order]
    tied = np.zeros(len(k), bool)
    tied[1:] = k[1:] == k[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)  # only those of equal keys need the rest of the order
    own = order[at]
    order[at] = own[np.lexsort((ids[own], check[own], key[own]))]
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


ASKED, LAST = "part int, block int, key binary, several binary", "part int, block int, key binary, check binary, first binary"
ANSWER = "block int, level int, key binary"


def removed_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words, joined by a space) for each row of docs."""
    levels = lengths(window, seed)
    if len(levels) < 2:
        levels = [max(1, window // 2), window] if window > 1 else [1, 1]
    blocks, n = in_blocks(docs)
    none = np.empty(0, U64)
    last = len(levels) - 1

    def ask_first(table: pa.Table) -> pa.Table:
        block = Block(table)
        low, whole = block.anchors(levels[0], levels[1]), block.words.whole(levels[1])
        doc = block.words.of[: len(low)]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        new &= whole
        key, several = _distinct(low[new], block.ids[doc[new]])
        return asked(n, block.number, key, several=several)

    def repeated(level: int):
        def find(table: pa.Table) -> pa.Table:
            """The keys of two blocks, or of two documents of a block, to each block that asked."""
            key, several, block = unpacked(table, "key", U64), unpacked(table, "several", bool), blocks_of(table, "key", 8)
            order = np.argsort(key)
            k = key[order]
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            back = order[same[1:] | same[:-1] | several[order]]
            return answered(block[back], level, key=key[back])

        return find

    def ask_level(level: int):
        def ask(table: pa.Table, known: pa.Table) -> pa.Table:
            if not table.num_rows or not known.num_rows:
                return asked(n, 0, none, several=np.empty(0, bool))
            block = Block(table)
            at, key = block.candidates(levels, level, _found(known, level))
            key, several = _distinct(key, block.ids[block.words.of[at]])
            return asked(n, block.number, key, several=several)

        return ask

    def ask_last(table: pa.Table, known: pa.Table) -> pa.Table:
        """Each full window once, with the block's smallest id that holds it."""
        if not table.num_rows or not known.num_rows:
            return asked(n, 0, none, check=none.astype(np.uint32), first=np.empty(0, np.int64))
        block = Block(table)
        at, key = block.candidates(levels, last, _found(known, last))
        check, ids = block.check(at, window).astype(np.uint32), block.ids[block.words.of[at]]
        order, new = _firsts(key, check, ids)
        one = order[new]
        return asked(n, block.number, key[one], check=check[one], first=ids[one])

    def earlier(table: pa.Table) -> pa.Table:
        """To each block of which all documents with the window are later than another block's: the window."""
        key, check, ids = unpacked(table, "key", U64), unpacked(table, "check", np.uint32), unpacked(table, "first", np.int64)
        block = blocks_of(table, "key", 8)
        order, new = _firsts(key, check, ids)
        back = order[ids[order] > ids[order[new]][np.cumsum(new) - 1]]
        return answered(block[back], last, key=key[back])

    def remove(table: pa.Table, known: pa.Table) -> pa.Table:
        block = Block(table)
        words = block.words
        gone = np.zeros(len(words.hashes) + 1, np.int32)
        if known.num_rows:
            at, key = block.candidates(levels, last, _found(known, last))
            ids = block.ids[words.of[at]]
            order, new = _firsts(key, block.check(at, window), ids)
            low = np.empty(len(key), np.int64)
            low[order] = ids[order[new]][np.cumsum(new) - 1]
            late = at[(ids > low) | members(key, _found(known, last + 1)[last])]
            np.add.at(gone, late, 1)
            np.add.at(gone, late + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        removed = np.bincount(words.of, gone, minlength=len(block.ids)).astype(np.int64)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": words.sizes.astype(np.int64), "n_removed": removed, "kept": joined(words, ~gone)})

    answers = resolve(per_block(blocks, ask_first, ASKED), n, repeated(0), ANSWER)
    for i in range(1, last):
        answers = answers.unionByName(resolve(per_block_with(blocks, answers, ask_level(i), ASKED), n, repeated(i), ANSWER))
    told = answers.unionByName(resolve(per_block_with(blocks, answers, ask_last, LAST), n, earlier, ANSWER))
    return per_block_with(blocks, told, remove, "doc_id long, n_words long, n_removed long, kept string")


def _found(known: pa.Table, below: int) -> list[np.ndarray]:
    level = column(known, "level")
    return [np.sort(unpacked(known.filter(pa.array(level == i)), "key", U64)) for i in range(below)]


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space: on bytes, as every word is copied with one byte after it, which becomes the space."""
    starts, lengths, of = words.starts[keep], words.lengths[keep], words.of[keep]
    n = len(words.sizes)
    last = np.ones(len(of), bool)
    last[:-1] = of[1:] != of[:-1]
    sizes = lengths + ~last
    ends = np.cumsum(sizes)
    edge = np.concatenate(([0], ends[np.cumsum(np.bincount(of, minlength=n)) - 1])) if len(of) else np.zeros(n + 1, np.int64)
    if len(of):
        edge[1:][np.cumsum(np.bincount(of, minlength=n)) == 0] = 0
    raw = np.frombuffer(words.data, np.uint8)
    out = np.empty(int(ends[-1]) if len(of) else 0, np.uint8)
    step = 1 << 18  # words at a time
    for a in range(0, len(of), step):
        size, base = sizes[a : a + step], int(ends[a - 1]) if a else 0
        local = ends[a : a + step] - base
        at = np.arange(int(local[-1])) + np.repeat(starts[a : a + step] - (local - size), size)
        piece = raw[np.minimum(at, len(raw) - 1)]
        piece[local[~last[a : a + step]] - 1] = SPACE
        out[base : base + len(piece)] = piece
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(edge.astype(np.int64).tobytes()), pa.py_buffer(out.data)).cast(pa.string())


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_words(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d),
h AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS x FROM s),
m AS (SELECT x, min(doc_id) AS first FROM h GROUP BY x),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS i FROM h JOIN m USING (x) WHERE m.first < h.doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""
}
