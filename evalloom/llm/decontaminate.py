"""Benchmark decontamination: SimHash of item-sized windows, Hamming search by blocks, exact weighted-shingle similarity.

Words are runs of letters and digits, lower-cased; shingles are five words (a text with fewer is one shingle). A shingle weighs
ln(1 + items / items that hold it), one that no item holds ln(1 + items). The similarity of a window and an item is the sum of the lesser
weighted counts over the sum of the greater ones; from SIMILAR on the item has leaked into the document.

A window has as many shingles as the item (or the whole document, if that is shorter). As a window without any shingle of an item has similarity
0, windows are laid at all places that cover such a shingle, and at no others. Each gets a 64-bit SimHash. Fingerprints are
cut into BLOCKS blocks; two fingerprints within RADIUS bits differ in at most RADIUS / BLOCKS bits in some block, so the index of each block, which lists
the items under all values that near, guarantees all items within the radius (of random fingerprints, 4 % meet in some block). Those are then compared
exactly. The radius is set for SIMILAR: of windows of a similarity from 0.8 on, 97 % lie within it (a test holds it to 0.9).

The benchmark is sent to the workers in parts of about PART_CHARS characters, one narrow pass over the documents for each; the documents are never
shuffled. Items and holders are counted once, over the whole benchmark, and each part gets the counts of its shingles. With several parts, passes over
LOOKED_UP of them at once come before, in which documents collect the counts of those of their shingles that some item holds, so that weights don't
depend on the parts. The documents are then written after each pass and the table before is deleted, so one part is in memory at a time.

Nulls: null or wordless texts have no leak; null or wordless items are not searched for. Repeated rows and items are treated each for itself. An
empty benchmark leaves all documents clean, an empty table gives no rows. Further columns are kept, however
named; `with_leaks` replaces those of the names that the caller gives its results, `clean` none.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, doc_columns, folder, forget, read, signed, slices, windows, word_hashes, written

TOKEN = re.compile(r"\w+")
SHINGLE, SIMILAR = 5, 0.8
BLOCKS, RADIUS = 4, 15
#: Characters of the benchmark in a part; a part's index takes about 40 times as many bytes.
PART_CHARS = 1 << 20
#: Parts whose counts of shingles are sent at once: some 3 MB each.
LOOKED_UP = 16
#: Windows that are looked up together.
TOGETHER = 1 << 13
BIT = np.arange(64, dtype=np.uint64)
NONE: dict = {}
#: What `with_leaks` calls its results, unless the caller says otherwise.
NAMES = ("leaked_items", "leak_similarity")


def shingles(text: str | None) -> np.ndarray:
    """Fingerprints of the shingles in order."""
    words = TOKEN.findall((text or "").lower())
    return windows(word_hashes(words), min(SHINGLE, max(1, len(words))))


def near_masks(flips: int, width: int) -> np.ndarray:
    """All numbers of `width` bits with at most so many ones."""
    x = np.arange(1 << width)
    return x[np.bitwise_count(x) <= flips].astype(np.uint16)


class HammingIndex:
    """Fingerprints by blocks: each is listed, for each block, under all values of the block that are near enough."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray, blocks: int = BLOCKS, radius: int = RADIUS):
        self.prints, self.sizes, self.blocks, self.radius, self.width = prints, sizes, blocks, radius, 64 // blocks
        masks = near_masks(radius // blocks, self.width)
        self.starts, self.lists = [], []
        for b in range(blocks):
            values = self.block(prints, b)[:, None] ^ masks[None, :]
            order = np.argsort(values, axis=None, kind="stable")
            self.lists.append((order // len(masks)).astype(np.int32))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(values.ravel(), minlength=1 << self.width)))))

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> U64(b * self.width) & U64((1 << self.width) - 1)).astype(np.uint16)

    def near(self, prints: np.ndarray, size: int) -> np.ndarray:
        """(place in prints, listed fingerprint of that size) pairs within the radius, all of them, each once."""
        found = []
        for b in range(self.blocks):
            value = self.block(prints, b).astype(np.int64)
            start, n = self.starts[b][value], self.starts[b][value + 1] - self.starts[b][value]
            at = np.repeat(np.arange(len(prints)), n)
            item = self.lists[b][np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + start[at]]
            fits = self.sizes[item] == size
            at, item = at[fits], item[fits]
            fits = np.bitwise_count(prints[at] ^ self.prints[item]) <= self.radius
            found.append(at[fits] * len(self.prints) + item[fits])
        return np.stack(np.divmod(np.unique(np.concatenate(found)), max(1, len(self.prints))), axis=1)


class Items:
    """A part of the benchmark, indexed."""

    def __init__(self, rows: list[tuple[int, str]], similar: float = SIMILAR, total: int | None = None, holders: dict[int, int] | None = None):
        """total, holders: items of the whole benchmark and how many of them hold a shingle; without them, rows are the whole."""
        self.similar = similar
        found = [(i, s) for i, text in rows if len(s := shingles(text))]
        self.words = [n for _, text in rows if (n := len(TOKEN.findall((text or "").lower())))]
        self.short_lengths = sorted({n for n in self.words if n < SHINGLE})
        self.ids = [i for i, _ in found]
        self.total = len(found) if total is None else total
        self.most = math.log1p(self.total)
        self.weight = self.weighed(Counter(x for _, s in found for x in set(s.tolist())) if holders is None else holders)
        self.counts = [Counter(s.tolist()) for _, s in found]
        self.size = [len(s) for _, s in found]
        self.items: dict[int, list[int]] = defaultdict(list)
        for k, (_, s) in enumerate(found):
            for x in set(s.tolist()):
                self.items[x].append(k)
        self.known = np.sort(np.fromiter(self.items, U64, len(self.items)))
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.known & U64(0xFFFF)).astype(np.int64)] = True
        prints = [self.fingerprints(x, len(x)) for _, x in found]
        self.index = HammingIndex(np.concatenate(prints) if prints else np.empty(0, U64), np.array(self.size, np.int64))

    def weighed(self, holders: dict[int, int]) -> dict[int, float]:
        return {x: math.log1p(self.total / n) for x, n in holders.items()}

    def weights(self, s: np.ndarray, others: dict[int, float]) -> np.ndarray:
        return np.array([self.weight.get(x) or others.get(x, self.most) for x in s.tolist()])

    def fingerprints(self, s: np.ndarray, m: int, others: dict[int, float] = NONE) -> np.ndarray:
        """The SimHash of each window of m shingles; others: weights of shingles that other parts hold."""
        signs = np.where(s[:, None] >> BIT & U64(1), 1.0, -1.0) * self.weights(s, others)[:, None]
        sums = np.concatenate((np.zeros((1, 64)), np.cumsum(signs, axis=0)))
        votes = sums[m:] - sums[:-m] > 1e-7  # a tie is no vote, in whatever order it was added up
        return (votes.astype(U64) << BIT).sum(axis=1, dtype=U64)

    def similarity(self, window: Counter, k: int, others: dict[int, float] = NONE) -> float:
        item, least, most = self.counts[k], 0.0, 0.0
        for x, n in item.items():
            w, c = self.weight[x], window.get(x, 0)
            least += w * min(n, c)
            most += w * max(n, c)
        most += sum((self.weight.get(x) or others.get(x, self.most)) * c for x, c in window.items() if x not in item)
        return least / most

    def search(self, text: str | None, holders: dict[int, int] = NONE) -> dict[int, float]:
        """Leaked items (by number) with their best similarity; holders: the counts of the text's shingles in the whole benchmark."""
        words = TOKEN.findall((text or "").lower())
        hashes = word_hashes(words)
        best: dict[int, float] = {}
        s = windows(hashes, min(SHINGLE, max(1, len(words))))
        at = np.flatnonzero(self.gate[(s & U64(0xFFFF)).astype(np.int64)])
        if len(at):
            place = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
            self._around(s, at[self.known[place] == s[at]], best, self.weighed(holders))
        self._short(hashes, best)
        return best

    def _short(self, hashes: np.ndarray, best: dict[int, float]) -> None:
        """Items of fewer words than a shingle are found as they stand."""
        for length in self.short_lengths:
            s = windows(hashes, length)
            for x in np.intersect1d(s, self.known).tolist():
                for k in self.items[x]:
                    if self.size[k] == 1 and self.words[k] == length:
                        best[k] = 1.0

    def _around(self, s: np.ndarray, at: np.ndarray, best: dict[int, float], others: dict[int, float]) -> None:
        starts: dict[int, set[int]] = defaultdict(set)  # size of window -> first shingles
        for p in at.tolist():
            for k in self.items[int(s[p])]:
                m = min(self.size[k], len(s))
                starts[self.size[k]].update(range(max(0, p - m + 1), min(p, len(s) - m) + 1))
        for m, places in starts.items():
            places = np.array(sorted(places))
            width = min(m, len(s))
            runs = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
            for run in (x[i : i + TOGETHER] for x in runs for i in range(0, len(x), TOGETHER)):
                region = s[run[0] : run[-1] + width]
                for i, k in self.index.near(self.fingerprints(region, width, others), m).tolist():
                    x = self.similarity(Counter(region[i : i + width].tolist()), k, others)
                    if x >= self.similar and x > best.get(k, 0.0):
                        best[k] = x


_BUILT: dict = {}


def _built(key: str, rows: list[tuple[int, str]], similar: float, total: int, keys: np.ndarray, n: np.ndarray) -> Items:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(rows, similar, total, _counts(keys, n))
    return _BUILT[key]


def _counts(keys: np.ndarray, n: np.ndarray) -> dict[int, int]:
    return dict(zip(np.asarray(keys, np.int64).view(U64).tolist(), np.asarray(n).tolist(), strict=True))


def held_shingles(items: DataFrame, path: str) -> tuple[DataFrame, int]:
    """key, n (items that hold it), parts (those of them), written to path; and the number of items that have a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys = np.unique(shingles(text))
                if len(keys):
                    first = np.arange(len(keys)) == 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(signed(keys)), pa.array(first)], names=["part", "key", "first"])

    held = items.select("part", "text").mapInArrow(run, "part int, key long, first boolean")
    found = written(held.groupBy("key").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts"), F.sum(F.col("first").cast("long")).alias("firsts")), "held", path)
    return found, found.agg(F.coalesce(F.sum("firsts"), F.lit(0))).first()[0]


def with_leaks(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, part_chars: int = PART_CHARS, names: tuple[str, str] = NAMES) -> DataFrame:
    """docs with the ids of leaked items (an array, in order) and the greatest similarity (null without one), under the given names."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and item_id is not null")
    parts = math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / part_chars)
    base = docs.drop(*names).withColumns({names[0]: F.array().cast("array<long>"), names[1]: F.lit(None).cast("double")})
    if not parts:
        return base
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    known, last = folder(spark, "held"), None
    held, total = held_shingles(items, known)

    def counted(some: list[int]) -> Broadcast:
        """The shingles of some parts, and how many items hold each."""
        mine = held.filter(F.arrays_overlap("parts", F.array(*map(F.lit, some)))).select("key", "n").toArrow().to_pydict()
        return share((np.array(mine["key"], np.int64), np.array(mine["n"], np.int64)))

    def passed(df: DataFrame, *shared: Broadcast) -> DataFrame:
        """df as a table in place of the last one; what was sent for it is let go."""
        nonlocal last
        before, last = last, folder(spark, "leaks")
        df = written(df, "leaks", last)
        for x in shared:
            x.destroy()
        if before:
            forget(spark, before)
        return df

    # names that no column of docs has
    found = (f"held_{uuid.uuid4().hex}", f"holders_{uuid.uuid4().hex}") if parts > 1 else ()
    if found:
        base = base.withColumns({c: F.array().cast("array<long>") for c in found})
        for i in range(0, parts, LOOKED_UP):
            counts = counted([*range(i, min(parts, i + LOOKED_UP))])
            base = passed(_looked_up(base, counts, *found), counts)
    sent: tuple[Broadcast, ...] = ()
    for i in range(parts):
        rows = [tuple(x) for x in items.filter(F.col("part") == i).select("item_id", "text").collect()]
        if rows:
            if sent:
                base = passed(base, *sent)
            sent = share((uuid.uuid4().hex, rows, similar, total)), counted([i])
            base = _searched(base, *sent, names, found)
    forget(spark, known)
    return base.drop(*found)


def _looked_up(df: DataFrame, counts: Broadcast, keys_name: str, holders_name: str) -> DataFrame:
    """Adds the counts of some parts to the two columns of each document."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = counts.value
        order = np.argsort(known.view(U64))
        known, n = known.view(U64)[order], n[order]
        for part in slices(batches):
            keys, holders = [], []
            for text, old, more in zip(part.column("text").to_pylist(), part.column(keys_name).to_pylist(), part.column(holders_name).to_pylist(), strict=True):
                s = np.setdiff1d(shingles(text), np.array(old, np.int64).view(U64))
                at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                there = known[at] == s if len(known) else np.zeros(len(s), bool)
                keys.append(old + signed(s[there]).tolist())
                holders.append(more + n[at[there]].tolist())
            new = {keys_name: pa.array(keys, pa.list_(pa.int64())), holders_name: pa.array(holders, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in columns], names=columns)

    return df.mapInArrow(run, df.schema)


def _searched(df: DataFrame, shared: Broadcast, counts: Broadcast, names: tuple[str, str], held: tuple[str, ...]) -> DataFrame:
    """Adds what one part finds to the results; held: the columns of the documents' held shingles, if there are other parts."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _built(*shared.value, *counts.value)
        for part in slices(batches):
            holders = [_counts(k, n) for k, n in zip(*(part.column(c).to_pylist() for c in held), strict=True)] if held else [NONE] * part.num_rows
            found = [items.search(x, h) for x, h in zip(part.column("text").to_pylist(), holders, strict=True)]
            ids = [sorted({*old, *(items.ids[k] for k in f)}) for old, f in zip(part.column(names[0]).to_pylist(), found, strict=True)]
            best = [max((x for x in (old, *f.values()) if x is not None), default=None) for old, f in zip(part.column(names[1]).to_pylist(), found, strict=True)]
            new = {names[0]: pa.array(ids, pa.list_(pa.int64())), names[1]: pa.array(best, pa.float64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in columns], names=columns)

    return df.mapInArrow(run, df.schema)


def clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, part_chars: int = PART_CHARS) -> DataFrame:
    """The documents without a leak, with their own columns."""
    names = (f"items_{uuid.uuid4().hex}", f"similarity_{uuid.uuid4().hex}")
    return with_leaks(docs, benchmark, similar, part_chars, names).filter(F.size(names[0]) == 0).select(*docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_leaks(doc_columns(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.size("leaked_items").cast("long").alias("n_items"), "leaked_items", F.round("leak_similarity", 6).alias("leak_similarity"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {}
