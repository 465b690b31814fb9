"""A quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of a text (STATISTICS) are computed on its bytes and words, for all texts of a slice at once, and written once. Random Fourier features, cosines of
random projections of the standardised statistics, approximate a Gaussian kernel, so that ridge regression on them is kernel regression; its normal equations are sums over
documents, which tasks add up and Spark adds over tasks. Features are rounded to 1/4096 and standardised statistics to 1/256, so all sums are of integers and the same however rows are dealt out. For calibration the labelled documents
are split in two halves by their ids; each half is scored by the equations of the other one, and isotonic regression on these scores (counted in STEPS bins) gives probabilities.

What is learned comes from labelled documents that `learned_from` selects: all of them, without a sample. Their number decides the cost of one narrow pass; what the driver holds is of fixed size:
FEATURES^2 numbers, and counts of STEPS bins.

Nulls: a null text is empty; a null doc_id has no label and isn't held out. Labels other than 0 and 1 don't count; a document of several labels counts once for each. Without labelled documents of both
classes every score is the share of 1 among labels, 0.5 if there are none. Empty texts have statistics (zeros) and a score. Rows that repeat a doc_id are scored each for itself. Empty tables: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, doc_columns, map_texts, mix, read, written
from .integers import added, packed, unpacked
from .wordbytes import Words

FOLDS, HELD = 3, 1
FEATURES, RIDGE, SEED = 256, 1e-3, 11
#: Standardised statistics are cut off here, and rounded to 1 / FINE; features are rounded to 1 / ROUNDED.
EDGE, FINE, ROUNDED = 6.0, 256, 4096
#: Bins of scores from -0.5 to 1.5, for calibration.
STEPS = 4096
#: Kinds of bytes: share of each in the text.
KINDS = ("lower", "upper", "digit", "blank", "line end", "stop", "bar", "shout", "symbol", "control", "other")
STATISTICS = (*KINDS, "bytes", "words", "word length", "spread of word length", "long words", "distinct words", "repeated neighbours", "most frequent word", "repeated windows", "words with capital", "words that end in a stop", "words that end in a symbol", "words without letters", "line length", "repeated lines")


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, KINDS.index("other"))
    for c in range(128):
        x = chr(c)
        if x.islower():
            name = "lower"
        elif x.isupper():
            name = "upper"
        elif x.isdigit():
            name = "digit"
        elif x in " \t":
            name = "blank"
        elif x in "\n\r\v\f":
            name = "line end"
        elif c < 32 or c == 127:
            name = "control"
        else:
            name = {"|": "bar", "!": "shout"}.get(x, "stop" if x in ".,;:?'\"()-" else "symbol")
        kind[c] = KINDS.index(name)
    return kind.astype(np.uint8)


_KIND = _kinds()
STOP, BAR, SHOUT, SYMBOL, UPPER = (KINDS.index(x) for x in ("stop", "bar", "shout", "symbol", "upper"))
LETTERS = np.isin(np.arange(len(KINDS)), [KINDS.index(x) for x in ("lower", "upper", "other")])


def _per_text(of: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of distinct keys, and how often the most frequent one occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, of))
    k, o = key[order], of[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
    most = np.zeros(n)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(k))))
    return np.bincount(o[first], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    words = Words(texts)
    raw, ends = np.frombuffer(words.data, np.uint8), words.ends
    kinds = _KIND[raw]
    size = np.diff(ends)
    out = np.zeros((n, len(STATISTICS)))
    put = lambda name, x: out.__setitem__((slice(None), STATISTICS.index(name)), x)
    of_text = np.repeat(np.arange(n, dtype=np.int64), size)
    out[:, : len(KINDS)] = np.bincount(of_text * len(KINDS) + kinds, minlength=n * len(KINDS)).reshape(n, -1) / np.maximum(size, 1)[:, None]
    of, some = words.of, np.maximum(words.sizes, 1)
    count = lambda which: np.bincount(of, which, minlength=n)
    length = words.lengths.astype(float)
    mean = count(length) / some
    put("bytes", np.log1p(size))
    put("words", np.log1p(words.sizes))
    put("word length", mean)
    put("spread of word length", np.sqrt(np.maximum(count(length * length) / some - mean * mean, 0)))
    put("long words", count(length > 20) / some)
    h = words.hashes
    distinct, most = _per_text(of, h, n)
    put("distinct words", np.log1p(distinct) / np.maximum(np.log1p(words.sizes), 1))
    put("most frequent word", most / some)
    beside = np.append(False, (h[1:] == h[:-1]) & (of[1:] == of[:-1])) if len(h) else np.empty(0, bool)
    put("repeated neighbours", count(beside) / some)
    whole = words.whole(3)
    window = mix(mix(h[:-2] * U64(3) + h[1:-1]) * U64(5) + h[2:])[whole] if len(h) > 2 else np.empty(0, U64)
    inside = of[: len(whole)][whole]
    windows = np.bincount(inside, minlength=n)
    put("repeated windows", 1 - np.where(windows, _per_text(inside, window, n)[0] / np.maximum(windows, 1), 1))
    last = kinds[words.starts + words.lengths - 1] if len(h) else kinds[:0]
    put("words with capital", count(kinds[words.starts] == UPPER) / some)
    put("words that end in a stop", count(last == STOP) / some)
    put("words that end in a symbol", count((last == SYMBOL) | (last == BAR) | (last == SHOUT)) / some)
    letters = np.append(0, np.cumsum(LETTERS[kinds]))
    put("words without letters", count(letters[words.starts + words.lengths] == letters[words.starts]) / some)
    # lines: of which word their hashes begin, so that a line is the sum of its words' hashes by place
    breaks = np.append(0, np.cumsum(raw == 10))
    line = breaks[words.starts] + of  # texts part lines too
    begins = np.flatnonzero(np.diff(line, prepend=-1))
    place = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
    prints = np.add.reduceat(mix(h + place.astype(U64)), begins) if len(h) else h
    lines = np.bincount(of[begins], minlength=n)
    put("line length", np.log1p(size / np.maximum(lines, 1)))
    put("repeated lines", 1 - np.where(lines, _per_text(of[begins], prints, n)[0] / np.maximum(lines, 1), 1))
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats: the statistics' bytes (32-bit floats)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), packed(statistics(part.column("text")).astype(np.float32))], names=["doc_id", "stats"])

    return map_texts(doc_columns(docs), run, "doc_id long, stats binary")


class Features(NamedTuple):
    """Standardisation, projection and phases."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        """Features in units of 1 / ROUNDED, the constant last."""
        x = np.round(np.clip((stats - self.mean) / self.scale, -EDGE, EDGE) * FINE) / FINE
        z = np.round(ROUNDED * np.cos(x @ self.projection + self.phase))
        return np.concatenate((z, np.full((len(z), 1), ROUNDED)), axis=1).astype(np.int64)


class Model(NamedTuple):
    features: Features
    weights: np.ndarray
    bounds: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights / ROUNDED

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.bounds, self.values), 0, 1)


WIDTH = len(STATISTICS)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return unpacked(batch.column("stats"), np.float32, WIDTH).astype(np.float64)


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each statistic, from sums of integers (units of 1 / 1024)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, WIDTH), np.int64)
        for batch in batches:
            x = np.round(_stats(batch) * 1024).astype(np.int64)
            sums += np.stack([np.full(WIDTH, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(3), pa.int32()), packed(sums)], names=["key", "sums"])

    found = added(rows.mapInArrow(run, "key int, sums binary"))
    n, one, two = (found[k].astype(float) for k in range(3)) if found else np.zeros((3, WIDTH))
    n = np.maximum(n, 1)
    mean = one / n / 1024
    return mean, np.sqrt(np.maximum(two / n / 1024**2 - mean * mean, 1e-6))


def _equations(rows: DataFrame, features: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each half: the features' products, and those with the label. A task adds up its own and sends them once."""
    shared, size = rows.sparkSession.sparkContext.broadcast(features), len(features.phase) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shared.value
        sums = np.zeros((2, size, size + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                some = batch.slice(start, 8192)
                z, y, half = make(_stats(some)), some.column("quality").to_numpy(), some.column("half").to_numpy()
                for i in (0, 1):
                    mine = z[half == i].astype(np.float64)  # products of 24 bits: exact for 8192 rows
                    sums[i, :, :size] += (mine.T @ mine).astype(np.int64)
                    sums[i, :, size] += (mine.T @ y[half == i]).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=2).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed(sums.reshape(-1, size + 1)[some])], names=["key", "sums"])

    sums = np.zeros((2 * size, size + 1))
    for key, x in added(rows.mapInArrow(run, "key int, sums binary")).items():
        sums[key] = x
    sums = sums.reshape(2, size, size + 1)
    return [(s[:, :size] / ROUNDED**2, s[:, size] / ROUNDED) for s in sums]


def _solved(equations: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    products, answers = (sum(x) for x in zip(*equations, strict=True))
    n = max(1.0, products[-1, -1])  # the constant's own product is the number of documents
    ridge = np.full(len(answers), RIDGE * n)
    ridge[-1] = 1e-6 * n
    return np.linalg.solve(products + np.diag(ridge), answers)


def fit(spark: SparkSession, stats: DataFrame, labels: DataFrame, learned_from: Column) -> Model:
    """stats: with_statistics; labels: doc_id, quality; learned_from: which rows of stats count."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = written(stats.filter(learned_from).join(known, "doc_id").select("stats", "quality", half.alias("half")), "labelled")
    mean, scale = _moments(rows)
    r = np.random.default_rng(SEED)
    features = Features(mean, scale, r.standard_normal((WIDTH, FEATURES)) / np.sqrt(WIDTH), r.uniform(0, 2 * np.pi, FEATURES))
    classes = {q: n for q, n in rows.groupBy("quality").count().collect()}
    if len(classes) < 2:
        share = 0.5 if not classes else float(1 in classes)
        return Model(features, np.zeros(FEATURES + 1), np.zeros(1), np.array([share]))
    equations = _equations(rows, features)
    other = spark.sparkContext.broadcast((features, [_solved([equations[1 - i]]) for i in (0, 1)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, weights = other.value
        for batch in batches:
            if batch.num_rows:
                half = batch.column("half").to_numpy()
                both = make(_stats(batch)) @ np.stack(weights, axis=1) / ROUNDED
                step = np.clip(np.floor((both[np.arange(len(half)), half] + 0.5) * STEPS / 2), 0, STEPS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int32)), batch.column("quality")], names=["step", "quality"])

    bins = rows.mapInArrow(run, "step int, quality int").groupBy("step").agg(F.avg("quality").alias("label"), F.count("*").cast("double").alias("weight"))
    bins = bins.select(((F.col("step") + 0.5) * 2 / STEPS - 0.5).alias("feature"), "label", "weight")
    calibration = IsotonicRegression(featuresCol="feature", labelCol="label", weightCol="weight").fit(bins)
    return Model(features, _solved(equations), np.array(calibration.boundaries), np.array(calibration.predictions))


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, raw_score (before calibration)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _stats(batch)
                held = [held_out(d) for d in batch.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(model.score(x)), pa.array(model.raw(x))], names=["doc_id", "held_out", "score", "raw_score"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, raw_score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, raw_score of each document. Labels of held-out documents are not read into anything."""
    stats = written(with_statistics(docs), "statistics")
    learned_from = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD
    return scored(stats, fit(docs.sparkSession, stats, labels, learned_from))


def op11_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw_score")


QUERIES = {"op11_quality_model": op11_quality_model}
SQL: dict[str, str] = {}
