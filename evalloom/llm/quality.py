"""Quality rules: counts of each document, and how far its histograms are from those of its nearest language.

A language's reference is summed over all documents of that label: a histogram of character classes and one of common
words (the words of the lists below, and one class for all others). Only listed languages have one, so text of unknown language does not vouch for itself. A document's verdict is the Jensen-Shannon
distance (base 2, square root; 0 to 1) of each histogram to the nearest reference; a histogram counts only from a
minimum length on, as short ones are far from any reference by chance. Without any reference all distances are 1.

A text whose label is null or not listed has no words to be compared with: its common-word distance is null, and its character classes are
compared with all kinds of letters as one class, so that prose of any alphabet that parts its words is as near as that of a listed language.

Nulls: a null text has no words (all counts 0, base rules failed); a null or unlisted label adds to no reference; without a column lang all labels are null.
Empty tables: no rows. Rows that repeat a doc_id are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, doc_columns, read, slices

#: Frequent words of four languages.
COMMON = {
    "en": "the of and to in a is that it for was on are as with be by this from at or an have not which you he but they his had were has their one we can all there been if more when will would who so no".split(),
    "fr": "le la les de des du et un une est en que qui dans pour au sur par pas il elle on ce se ne plus avec son sa sont aux mais ou nous vous".split(),
    "de": "der die das und in den von zu mit ist ein eine des dem auf für nicht im sich als auch es an werden aus er hat dass sie nach wird bei einer um".split(),
    "es": "de la el que en y a los del se las por un para con no una su al es lo como más pero sus le ya o este sí porque esta entre".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "stop", "bar", "symbol", "letter")
#: Classes that are one for texts of unlisted languages.
LETTER_CLASSES = ("lower", "upper", "letter")
LISTED = sorted({w for words in COMMON.values() for w in words})
PLACE = {w: i for i, w in enumerate(LISTED)}
SYMBOLS = "#*$%&|<>"
REPEAT = 8


@dataclass(frozen=True)
class Limits:
    """Production limits. Those of the distances were set on the 3,980 labelled documents of sf0.1: of those of quality 1 that pass the base rules they
    keep 99.7 %, of those of quality 0 4 %; of texts of menus ("word | word") 4 %."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_class_chars: int = 200
    max_class_distance: float = 0.20
    min_common_words: int = 100
    max_common_distance: float = 0.36


def _class_table() -> np.ndarray:
    """Class of the code points below 128."""
    kind = np.full(128, CLASSES.index("symbol"))
    for c in range(128):
        x = chr(c)
        if x.islower():
            kind[c] = 0
        elif x.isupper():
            kind[c] = 1
        elif x.isdigit():
            kind[c] = 2
        elif x == " " or 9 <= c <= 13:
            kind[c] = 3
        elif x in ".,;:!?'\"()-":
            kind[c] = 4
        elif x == "|":  # what parts the entries of menus and tables
            kind[c] = 5
    return kind


_KIND = _class_table()
EDGE = ".,;:!?'\"()-" + SYMBOLS


def class_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_part = points[points < 128]
    out = np.bincount(_KIND[ascii_part], minlength=len(CLASSES))
    out[-1] += len(points) - len(ascii_part)
    return out


def folded(histograms: np.ndarray) -> np.ndarray:
    """Class histograms (the last axis) with all kinds of letters as one class, the first."""
    letters = [CLASSES.index(c) for c in LETTER_CLASSES]
    return np.concatenate([histograms[..., letters].sum(axis=-1, keepdims=True), np.delete(histograms, letters, axis=-1)], axis=-1)


def common_histogram(words: dict[str, int]) -> np.ndarray:
    """words: the distinct words with their counts."""
    out = np.zeros(len(LISTED) + 1, np.int64)
    for word, n in words.items():
        out[PLACE.get(word.strip(EDGE).lower(), -1)] += n
    return out


def js_distances(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a histogram to each row of references; 1 if either is empty."""
    totals = references.sum(axis=1, keepdims=True)
    if not x.sum() or not len(references):
        return np.ones(max(1, len(references)))
    p, q = x / x.sum(), references / np.maximum(totals, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=1)
    return np.where(totals[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def _counted(words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Distinct words with counts, and each word's number among them."""
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return dict(zip(numbers, np.bincount(ids, minlength=len(numbers)).tolist(), strict=True)), ids


def n_repeat_words(ids: np.ndarray, length: int = REPEAT) -> int:
    """Words within windows of `length` (a power of two) words that occur twice or more. Exact: windows are ranked by doubling."""
    have = 1
    while have < length:
        if len(ids) <= have:
            return 0
        ids = np.unique(ids[:-have] * (int(ids.max()) + 1) + ids[have:], return_inverse=True)[1]
        have *= 2
    if not len(ids):
        return 0
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edges = np.zeros(len(ids) + length, np.int64)
    edges[at] += 1
    edges[at + length] -= 1
    return int((np.cumsum(edges) > 0).sum())


def fit_references(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class and common-word histograms, a row per language of COMMON, over all documents of that label.

    Each task sums its batches; what comes to the driver is one row per label and histogram class, of fixed number."""
    labels = [*COMMON]
    width = len(CLASSES) + len(LISTED) + 1
    base = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isin(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(labels), width), np.int64)
        for part in slices(batches):
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                row = sums[labels.index(lang)]
                row[: len(CLASSES)] += class_histogram(text or "")
                row[len(CLASSES) :] += common_histogram(_counted(WORD.findall(text or ""))[0])
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at])], names=["cell", "n"])

    sums = np.zeros(len(labels) * width, np.int64)
    for cell, n in base.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        sums[cell] = n
    sums = sums.reshape(len(labels), width)
    return sums[:, : len(CLASSES)], sums[:, len(CLASSES) :]


MEASURES = tuple((m, pa.int64(), "long") for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) + (
    ("base_failed", pa.bool_(), "boolean"),
    ("class_distance", pa.float64(), "double"),
    ("common_distance", pa.float64(), "double"),
    ("kept", pa.bool_(), "boolean"),
)


def _judge(by_class: np.ndarray, by_word: np.ndarray, limits: Limits) -> Callable[[pa.RecordBatch], list[tuple]]:
    """The measures of each text of a batch, in the order of MEASURES."""
    by_class, by_word = by_class[by_class.sum(axis=1) > 0], by_word[by_word.sum(axis=1) > 0]
    by_letters = folded(by_class)

    def one(text: str, lang: object) -> tuple:
        words = WORD.findall(text)
        counts, ids = _counted(words)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n, repeated = len(words), n_repeat_words(ids)
        chars = sum(map(len, words))
        failed = n < limits.min_words or 100 * repeated > limits.max_repeat_percent * n
        listed, kinds, commons = lang in COMMON, None, None
        if chars >= limits.min_class_chars:
            classes = class_histogram(text)
            kinds = float((js_distances(classes, by_class) if listed else js_distances(folded(classes), by_letters)).min())
        if listed and n >= limits.min_common_words:
            commons = float(js_distances(common_histogram(counts), by_word).min())
        kept = not failed and (kinds is None or kinds <= limits.max_class_distance) and (commons is None or commons <= limits.max_common_distance)
        return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, kinds, commons, kept

    def batch(part: pa.RecordBatch) -> list[tuple]:
        texts = part.column("text").to_pylist()
        langs = part.column("lang").to_pylist() if "lang" in part.schema.names else [None] * len(texts)
        return [one(t or "", x) for t, x in zip(texts, langs, strict=True)]

    return batch


def judge(docs: DataFrame, references: tuple[np.ndarray, np.ndarray] | None = None, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the counts, base_failed, both distances (null below the minimum length; that of words also for an unlisted language), and kept."""
    measures = _judge(*(references if references is not None else fit_references(docs)), limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = zip(*measures(part), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, (_, k, _) in zip(rows, MEASURES, strict=True))], names=["doc_id", *(m for m, _, _ in MEASURES)])

    lang = [F.col("lang").cast("string").alias("lang")] if "lang" in docs.columns else []
    return doc_columns(docs, *lang).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} {t}" for m, _, t in MEASURES))


def keep(docs: DataFrame, references: tuple[np.ndarray, np.ndarray] | None = None, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    measures = _judge(*(references if references is not None else fit_references(docs)), limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array([m[-1] for m in measures(part)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def _sql(limits: Limits = Limits()) -> str:
    """The same in SQL. Characters of each class are counted by what is left without the others."""
    letters = ", ".join(str(CLASSES.index(c)) for c in LETTER_CLASSES)
    own = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": r".,;:!?''\"()\-", "bar": "|"}
    left = lambda kept: f"length(regexp_replace(t, '[^{kept}]', '', 'g'))"
    classes = [left(x) for x in own.values()] + [f"length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) - length(regexp_replace(t, '[^{''.join(own.values())}]', '', 'g'))", "length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))"]
    listed = ", ".join(f"'{w}'" for w in LISTED)
    langs = ", ".join(f"'{x}'" for x in COMMON)
    edge = EDGE.replace("'", "''")
    distance = lambda kind: f"""(SELECT doc_id, min(sqrt(greatest(0, least(1, s / 2)))) AS x FROM (SELECT doc_id, lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS s
  FROM (SELECT a.doc_id, r.lang, r.q, coalesce(h.n, 0) / a.total::DOUBLE AS p FROM (SELECT doc_id, sum(n) AS total FROM {kind} GROUP BY 1) a JOIN ref_{kind} r ON true LEFT JOIN {kind} h ON h.doc_id = a.doc_id AND h.cell = r.cell WHERE a.total > 0) GROUP BY 1, 2) GROUP BY 1)"""  # noqa: E731
    reference = lambda kind: f"""ref_{kind} AS (SELECT c.lang, c.cell, coalesce(n, 0) / c.total::DOUBLE AS q FROM (SELECT lang, cell, total FROM (SELECT lang, sum(n) AS total FROM {kind} JOIN d USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1 HAVING sum(n) > 0) JOIN (SELECT DISTINCT cell FROM {kind}) ON true) c
  LEFT JOIN (SELECT lang, cell, sum(n) AS n FROM {kind} JOIN d USING (doc_id) GROUP BY 1, 2) s ON s.lang = c.lang AND s.cell = c.cell)"""  # noqa: E731
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang END AS lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
chars AS (SELECT doc_id, unnest(range({len(classes)})) AS cell, unnest([{', '.join(classes)}]) AS n FROM d),
commons AS (SELECT doc_id, CASE WHEN x IN ({listed}) THEN x ELSE '' END AS cell, count(*) AS n FROM (SELECT doc_id, lower(trim(unnest(w), '{edge}')) AS x FROM d) GROUP BY 1, 2),
folded AS (SELECT doc_id, CASE WHEN cell IN ({letters}) THEN -1 ELSE cell END AS cell, sum(n) AS n FROM chars GROUP BY 1, 2),
{reference('chars')}, {reference('commons')}, {reference('folded')},
win AS (SELECT doc_id, i, array_to_string(w[i:i+{REPEAT - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {REPEAT - 2})) AS i FROM d WHERE len(w) >= {REPEAT})),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {REPEAT})) AS j FROM win JOIN (SELECT doc_id, x FROM win GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, x)) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, d.lang, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CASE WHEN d.lang IS NULL THEN c.x ELSE a.x END AS ca, b.x AS co
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN {distance('chars')} a ON a.doc_id = d.doc_id LEFT JOIN {distance('commons')} b ON b.doc_id = d.doc_id LEFT JOIN {distance('folded')} c ON c.doc_id = d.doc_id),
f AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed, CASE WHEN word_chars >= {limits.min_class_chars} THEN ca END AS class_distance, CASE WHEN lang IS NOT NULL AND n_words >= {limits.min_common_words} THEN co END AS common_distance FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(class_distance, 6) AS class_distance, round(common_distance, 6) AS common_distance,
  NOT base_failed AND coalesce(class_distance <= {limits.max_class_distance}, true) AND coalesce(common_distance <= {limits.max_common_distance}, true) AS kept FROM f"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL = {"op1_quality_rules": _sql()}
