"""The quality classifier, vector codes and hard negatives: brute force, held-out accuracy, edges."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.llm import common, hard_negatives, quality_model, vector_codes

from ..oracle import SF
from .test_operators import ODD, prose

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, q string, code string, key int, anchor string, cell double"


def vectors(spark, rows, parts=3):
    """With columns that clash with the operators' own."""
    return spark.createDataFrame([(i, v, y, "x", "y", 7, "no", 0.5) for i, v, y in rows], VECTORS).repartition(parts)


def some_vectors(n, dim, seed, clusters=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % clusters] + r.normal(size=dim) * 0.2], int(r.integers(3))) for i in range(n)]


BAD = [(9001, None, 1), (9002, [1.0, None, 2.0, 3.0], 1), (9003, [NAN] * 4, 1), (9004, [INF, 0.0, 0.0, 0.0], 2)]


def good(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_codes(rows, scale=1024, entries=256, rounds=4):
    rows = good(rows)
    width = max(4, -(-max((len(v) for _, v, _ in rows), default=0) // 4) * 4)
    q = {k: [math.floor(scale * x) for x in v] + [0] * (width - len(v)) for k, (_, v, _) in enumerate(rows)}
    order = sorted((k for k in q if rows[k][0] is not None), key=lambda k: (rows[k][0], np.array(q[k], np.int32).tobytes()))[:entries]
    w = width // 4
    books = [[q[k][p * w : p * w + w] for k in order] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for step in range(rounds + 1):
        found = {k: [nearest(x[p * w : p * w + w], books[p]) for p in range(4)] for k, x in q.items()}
        if step < rounds:
            for p in range(4):
                held = defaultdict(list)
                for k, f in found.items():
                    held[f[p][1]].append(q[k][p * w : p * w + w])
                for e, xs in held.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    by_label = defaultdict(int)
    for k, f in found.items():
        by_label[rows[k][2]] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(rows[k][0]), "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[rows[k][2]]) for k, f in found.items()), sha


@pytest.mark.parametrize(
    "rows",
    [
        some_vectors(300, 8, 1) + BAD,
        [(i, [float(i % 3), 0.0, -1.0, 0.5, 0.25, 2.0], None if i % 2 else 5) for i in range(40)] + BAD,  # ties, and six components in four parts
        [(i // 2, [0.5 * (i % 5), 1.0][: 1 + i % 2], 1) for i in range(30)] + [(None, [1.0, 2.0], None)],  # repeated ids, vectors of several lengths
        BAD,
        [],
    ],
)
def test_codes_brute_force(spark, rows):
    coded, books = vector_codes.encode(vectors(spark, rows))
    found = vector_codes.with_label_error(coded).collect()
    assert all(f.vec_id is not None or any(r[0] is None for r in rows) for f in found)
    want, sha = brute_codes(rows)
    assert sorted((str(f.vec_id), bytes(f.code).hex(), f.error, f.label_error) for f in found) == want
    if want:
        assert vector_codes.books_sha256(books) == sha


def test_codes_of_few_entries_and_many_rounds(spark):
    rows = some_vectors(120, 8, 2)
    coded, books = vector_codes.encode(vectors(spark, rows), entries=7, rounds=6)
    want, sha = brute_codes(rows, entries=7, rounds=6)
    assert vector_codes.books_sha256(books) == sha and coded.count() == len(want)


@pytest.mark.parametrize("seed", range(6))
def test_balls_equal_comparing_all(seed):
    """Small integers, so that many distances tie; from right and from wrong entries before."""
    r = np.random.default_rng(seed)
    span = (3, 60)[seed % 2]
    x, book = r.integers(-span, span, (500, 4)), r.integers(-span, span, (1 + 50 * seed, 4))
    for now in (r.integers(0, len(book), len(x)), vector_codes.all_compared(x, book)):
        assert (vector_codes.by_balls(x, book, now) == vector_codes.all_compared(x, book)).all()


def test_balls_skip_work(monkeypatch):
    """Of well separated balls the cores are not compared at all, and others with their ring alone."""
    r = np.random.default_rng(3)
    book = r.integers(-(10**5), 10**5, (200, 4))
    now = r.integers(0, 200, 5000)
    x = book[now] + r.integers(-50, 50, (5000, 4))
    pairs, plain = [], vector_codes.squared
    monkeypatch.setattr(vector_codes, "squared", lambda a, b: pairs.append(len(a) * len(b)) or plain(a, b))
    assert (vector_codes.by_balls(x, book, now) == now).all()
    assert sum(pairs) - 200 * 200 < 5000


def test_a_component_too_large_is_named(spark):
    with pytest.raises(Exception, match="must lie below"):
        vector_codes.encode(vectors(spark, [(1, [1e9, 1.0, 1.0, 1.0], 1)]))


def brute_negatives(rows, anchors, scale=256, positives=5, negatives=3, low=50, high=95):
    best = {}
    for i, v, y in good(rows):
        if i is not None and y is not None:
            best[i] = min(best.get(i, (y, v)), (y, v))
    width = max((len(v) for _, v in best.values()), default=0)
    q = {i: [math.floor(scale * x) for x in v] + [0] * (width - len(v)) for i, (_, v) in best.items()}
    out = []
    for a in filter(anchors, best):
        score = {i: sum(x * y for x, y in zip(q[a], q[i], strict=True)) for i in best if i != a}
        same = sorted((i for i in score if best[i][0] == best[a][0]), key=lambda i: (-score[i], i))[:positives]
        for p in same:
            good_ones = sorted((i for i in score if best[i][0] != best[a][0] and low * score[p] <= 100 * score[i] <= high * score[p]), key=lambda i: (-score[i], i))[:negatives]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(good_ones)]
    return sorted(out)


@pytest.mark.parametrize(
    "rows",
    [
        some_vectors(400, 6, 4) + BAD,
        [(i, [float(i % 4), 1.0, 0.0], i % 2) for i in range(80)] + [(i, [0.0, 0.0, 0.0], 1) for i in range(100, 110)],  # ties, vectors of zeros
        [(i // 2, [0.1 * i, 1.0, -0.2 * i][: 2 + i % 2], i % 3) for i in range(60)] + [(None, [1.0, 1.0], 1), (70, [1.0, 1.0], None)],  # repeated ids, null ids and labels
        BAD,
        [],
    ],
)
def test_negatives_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(hard_negatives, "WINDOW", 16)
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    for size in (hard_negatives.ANCHOR_BYTES, 2000):  # in one block, and in several
        found = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 5 == 0, anchor_bytes=size).collect()
        assert sorted(map(tuple, found)) == want


def test_bounds_hold_and_windows_are_skipped():
    """No score leaves its bounds; of clustered rows most windows need no scores."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 32)) * 200
    q = np.floor(np.repeat(centres, 64, axis=0) + r.normal(size=(512, 32)) * 20)
    toward = centres / np.sqrt((centres**2).sum(1))[:, None]
    norms = np.sqrt((q**2).sum(1))
    angles = np.arccos(np.clip(q @ toward.T / norms[:, None], -1, 1))
    every = hard_negatives.Bounds(np.arange(512), np.zeros(512), q, norms, angles)
    part = lambda at: hard_negatives.Bounds(*(x[at] for x in every))
    skipped = 0
    for a in range(0, 512, 64):
        rows = part(slice(a, a + 64))
        low, high = hard_negatives.score_bounds(every, rows)
        scores = q @ rows.q.T
        assert (scores >= low[:, None]).all() and (scores <= high[:, None]).all()
        skipped += int((high < 0.5 * norms**2).sum())
    assert skipped > 512 * 8 * 0.6


def test_quality_of_held_out_documents(spark):
    """Held-out labels are predicted; they are never read: turned round, they change no score."""
    sf = SF.replace("0.001", "0.01")
    docs, labels = common.read(spark, sf, "documents"), common.read(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    found = {r.doc_id: r for r in quality_model.quality_scores(docs, labels).collect()}
    again = {r.doc_id: r for r in quality_model.quality_scores(docs.repartition(5), turned).collect()}
    assert found == again and len(found) == docs.count()
    held = [(found[r.doc_id], r.quality) for r in labels.collect() if found[r.doc_id].held_out]
    assert all(f.held_out == quality_model.held_out(d) for d, f in found.items())
    assert sum((f.score >= 0.5) == (y == 1) for f, y in held) >= 0.98 * len(held)
    for y in (0, 1):
        mine = [f for f, z in held if y == z]
        assert sum((f.score >= 0.5) == (y == 1) for f in mine) >= 0.9 * len(mine) > 5
    assert all(0 <= f.score <= 1 for f in found.values())
    by_raw = sorted(found.values(), key=lambda f: f.raw_score)
    assert all(a.score <= b.score + 1e-12 for a, b in zip(by_raw, by_raw[1:], strict=False))


def test_quality_takes_odd_rows_and_labels(spark, docs):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, stats string")
    rows = [*enumerate(ODD), (0, ""), (6, ODD[-1]), (None, ODD[-1]), (None, None)]
    none = quality_model.quality_scores(docs(rows), labels([])).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    one = quality_model.quality_scores(docs(rows), labels([(i, 1, "x") for i in range(7)] + [(None, 0, ""), (3, None, ""), (4, 7, "")])).collect()
    assert {r.score for r in one} == {1.0}
    both = quality_model.quality_scores(docs(rows), labels([(i, i % 2, "x") for i in range(7)] * 2)).collect()
    assert len(both) == len(rows) and all(0 <= r.score <= 1 for r in both)
    assert quality_model.quality_scores(docs([]), labels([(1, 1, "")])).count() == 0


def test_statistics_of_plain_texts():
    texts = ["The cat. the cat. the cat.\nTHE | dog!\nTHE | dog!", "", None, "é" * 30 + " 1 2 3", prose(400, 1)]
    got = quality_model.statistics(pa.array(texts))
    name = {s: i for i, s in enumerate(quality_model.STATISTICS)}
    words = texts[0].split()
    assert got[0, name["most frequent word"]] == pytest.approx(3 / len(words))  # "cat."
    assert got[0, name["words with capital"]] == pytest.approx(3 / len(words))
    assert got[0, name["repeated lines"]] == pytest.approx(1 / 3)
    assert got[0, name["words that end in a symbol"]] == pytest.approx(4 / len(words))
    assert got[0, name["bar"]] == pytest.approx(2 / len(texts[0]))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert got[0, name["repeated windows"]] == pytest.approx(1 - len(set(windows)) / len(windows))
    assert not got[1].any() and not got[2].any()
    assert got[3, name["words without letters"]] == pytest.approx(3 / 4) and got[3, name["long words"]] == pytest.approx(1 / 4)
    # a text's statistics don't hang on its neighbours, nor on where slices are cut
    assert all(np.allclose(quality_model.statistics(pa.array([t])), got[i]) for i, t in enumerate(texts))


def test_quality_of_a_text_above_one_slice(docs, spark):
    long = " ".join([prose(5000, 9)] * 200)
    assert len(long) > common.SLICE_BYTES
    r = random.Random(3)
    rows = [(i, prose(r.randint(50, 200), i) if i % 2 else "buy " * r.randint(50, 200)) for i in range(60)] + [(99, long)]
    found = quality_model.quality_scores(docs(rows), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")).collect()
    assert len(found) == 61 and sum((f.score >= 0.5) == (f.doc_id % 2 == 1) for f in found if f.doc_id < 60) >= 58
