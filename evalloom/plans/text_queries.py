"""Queries of chunking and of text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import chunking as C

from .fixtures import COST, QA, duck_rows, spark_rows

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "text")


def _chunks(**params):
    return lambda spark, sf_dir: C.chunk_corpus(corpus(spark, sf_dir), **params)


def _mapped(fixture: str, column):
    """doc_id and one column; column() makes it, as columns need a session."""
    return lambda spark, sf_dir: spark_rows(spark, sf_dir, fixture).select("doc_id", column())


def docstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return C.build_docstore(C.chunk_fixed(corpus(spark, sf_dir))).withColumn("metadata", F.array_join(entries, ";"))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("document_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_rows(spark, sf_dir, QA).select("doc_id", T.keywords(F.col("answer")).alias("a"), T.keywords(F.col("reference")).alias("b"))
    return rows.select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


def numeric_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_rows(spark, sf_dir, COST).groupBy(T.numeric_cost(F.col("extracted_money")).alias("money"), T.numeric_cost(F.col("extracted_time")).alias("days")).agg(F.count("*").alias("n"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_rows(spark, sf_dir, COST).select(F.array_join(T.claims(F.col("answer")), "|").alias("claims"))
    return rows.groupBy("claims").agg(F.count("*").alias("n"))


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.round(T.clip(F.col("value") / 100 - 0.5), 6).alias("clipped"))


QUERIES = {
    "chunk_fixed": _chunks(method="fixed_size"),
    "chunk_fixed_tail": _chunks(method="fixed_tail"),
    "chunk_sentences": _chunks(method="sentence"),
    "split_sentences": split_sentences,
    "chunk_stats": lambda s, d: C.chunk_stats(C.chunk_fixed(corpus(s, d))).withColumn("avg_length", F.round("avg_length", 6)),
    "chunks_per_doc": lambda s, d: C.chunks_per_doc(C.chunk_fixed(corpus(s, d), 500, 100)),
    "docstore": docstore,
    "normalize": _mapped(QA, lambda: T.normalize(F.col("reference")).alias("normalized")),
    "keywords": _mapped(QA, lambda: F.array_join(T.keywords(F.col("answer")), " ").alias("keywords")),
    "claims": claims,
    "generic_answer": _mapped(QA, lambda: F.coalesce(T.is_generic(F.col("context")), F.lit(False)).alias("generic")),
    "numeric_cost": numeric_cost,
    "token_estimate": _mapped(QA, lambda: T.token_estimate(F.col("answer")).alias("tokens")),
    "jaccard": jaccard,
    "clip": clipped,
    "input_validity": _mapped(QA, lambda: T.input_error(question=F.col("answer"), reference=F.col("reference"), context=F.col("context")).alias("error")),
}

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def keywords_sql(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"


def claims_sql(c: str) -> str:
    numbers = ", ".join(f"regexp_extract_all({c}, '(?i){p}')" for p in T.CLAIM_PATTERNS)
    s = STRIP.format("s")
    told = rf"list_filter(list_transform(string_split_regex({c}, '[.!?]+'), lambda s: {s}), lambda t: length(t) > 10 AND length(t) < 100 AND (regexp_matches(t, '[0-9]') OR regexp_matches(lower(t), '{'|'.join(T.CLAIM_TERMS)}')))"
    return f"list_concat({numbers}, {told})[1:5]"


def numeric_sql(c: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract(replace({c}, ',', ''), '([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE)"


def normalize_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '\s+', ' ', 'g'))"


def generic_sql(c: str) -> str:
    return f"regexp_matches(lower({c}), '" + "|".join(T.GENERIC_PHRASES).replace("'", "''") + "')"


def _fixed_sql(size: int, step: int) -> str:
    return f"""SELECT doc_id::VARCHAR || '_chunk_' || i AS chunk_id, doc_id::VARCHAR AS document_id, CAST(i AS INT) AS chunk_index, substring(text, i * {step} + 1, {size}) AS text,
  CAST(i * {step} AS INT) AS start, CAST(least(i * {step} + {size}, n) AS INT) AS "end", 'fixed_size' AS method
FROM (SELECT doc_id, text, length(text) AS n, unnest(range(CASE WHEN length(text) <= {size} THEN 1 ELSE CAST(ceil((length(text) - {size}) / {step}.0) AS INT) + 1 END)) AS i FROM documents WHERE length(text) > 0)"""


_FIXED = _fixed_sql(1000, 800)
_PIECES = f"""(SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s, i: CASE WHEN {STRIP.format('s')} = '' THEN NULL
  WHEN i < len(string_split_regex(text, '[.!?]+')) THEN {STRIP.format('s')} || '. ' ELSE {STRIP.format('s')} END), lambda s: s IS NOT NULL) AS pieces FROM documents)"""
_DONE = f"CASE WHEN {STRIP.format('acc.cur')} <> '' THEN list_append(acc.done, {STRIP.format('acc.cur')}) ELSE acc.done END"
SQL = {
    "chunk_fixed": _FIXED,
    "chunk_fixed_tail": f"""SELECT doc_id::VARCHAR || '_chunk_' || (k - 1) AS chunk_id, doc_id::VARCHAR AS document_id, CAST(k - 1 AS INT) AS chunk_index, t AS text, CAST(s AS INT) AS start, CAST(least(s + 512, n) AS INT) AS "end", 'fixed_tail' AS method
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT doc_id, n, s, {STRIP.format('substring(text, s + 1, 512)')} AS t
  FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 462)) AS s FROM documents)) WHERE t <> '')""",
    "chunk_sentences": f"""SELECT doc_id::VARCHAR || '_chunk_' || i AS chunk_id, doc_id::VARCHAR AS document_id, CAST(i AS INT) AS chunk_index, t AS text, CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS "end", 'sentence' AS method
FROM (SELECT doc_id, unnest(range(len(chunks))) AS i, unnest(chunks) AS t FROM (SELECT doc_id, {_DONE} AS chunks FROM (SELECT doc_id, list_reduce(
  list_prepend({{'done': CAST([] AS VARCHAR[]), 'cur': ''}}, list_transform(pieces, lambda p: {{'done': CAST([] AS VARCHAR[]), 'cur': p}})),
  lambda acc, x: CASE WHEN length(acc.cur) + length(x.cur) <= 500 THEN {{'done': acc.done, 'cur': acc.cur || x.cur}} ELSE {{'done': {_DONE}, 'cur': x.cur}} END) AS acc FROM {_PIECES})))""",
    "split_sentences": f"SELECT doc_id::VARCHAR AS document_id, CAST(i AS INT) AS i, sentence FROM (SELECT doc_id, unnest(range(len(pieces))) AS i, unnest(pieces) AS sentence FROM {_PIECES})",
    "chunk_stats": f"SELECT count(*) AS total_chunks, round(coalesce(avg(length(text)), 0), 6) AS avg_length, coalesce(min(length(text)), 0) AS min_length, coalesce(max(length(text)), 0) AS max_length, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_length FROM ({_FIXED})",
    "chunks_per_doc": f"SELECT document_id, count(*) AS n_chunks FROM ({_fixed_sql(500, 400)}) GROUP BY document_id",
    "docstore": f"""SELECT chunk_id, text, document_id, 'end=' || "end" || ';method=' || method || ';start=' || start AS metadata FROM ({_FIXED})""",
    "normalize": f"SELECT doc_id, {normalize_sql('reference')} AS normalized FROM {duck_rows(QA)}",
    "keywords": f"SELECT doc_id, array_to_string({keywords_sql('answer')}, ' ') AS keywords FROM {duck_rows(QA)}",
    "claims": f"SELECT array_to_string({claims_sql('answer')}, '|') AS claims, count(*) AS n FROM {duck_rows(COST)} GROUP BY 1",
    "generic_answer": f"SELECT doc_id, coalesce({generic_sql('context')}, false) AS generic FROM {duck_rows(QA)}",
    "numeric_cost": f"SELECT {numeric_sql('extracted_money')} AS money, {numeric_sql('extracted_time')} AS days, count(*) AS n FROM {duck_rows(COST)} GROUP BY 1, 2",
    "token_estimate": rf"SELECT doc_id, CAST(len(list_filter(string_split_regex(answer, '\s+'), lambda w: w <> '')) AS INT) AS tokens FROM {duck_rows(QA)}",
    "jaccard": f"""SELECT doc_id, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 6) AS jaccard
FROM (SELECT doc_id, list_distinct({keywords_sql('answer')}) AS a, CASE WHEN reference IS NOT NULL THEN list_distinct({keywords_sql('reference')}) END AS b FROM {duck_rows(QA)}) WHERE b IS NOT NULL UNION ALL SELECT doc_id, NULL FROM {duck_rows(QA)} WHERE reference IS NULL""",
    "clip": "SELECT event_id, round(greatest(0, least(1, value / 100 - 0.5)), 6) AS clipped FROM events",
    "input_validity": "SELECT doc_id, CASE "
    + " ".join(f"WHEN coalesce({STRIP.format(c)}, '') = '' THEN 'missing {n}'" for n, c in (("question", "answer"), ("reference", "reference"), ("context", "context")))
    + f" END AS error FROM {duck_rows(QA)}",
}
