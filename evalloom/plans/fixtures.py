"""Inputs of the registered queries, derived from the given tables by SQL that runs unchanged in Spark and DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QA = """
SELECT d.doc_id, d.text AS answer,
  CASE WHEN d.doc_id % 3 = 0 THEN concat(' ', replace(d.text, ' ', '  '))
       WHEN d.doc_id % 3 = 1 THEN substring(d.text, 1, CAST(floor(d.n_chars * 0.7) AS INT))
       ELSE n.text END AS reference,
  n.text AS context, l.quality = 1 AS judged_correct, l.toxic = 1 AS judged_hallucination
FROM {documents} d LEFT JOIN {documents} n ON n.doc_id = d.doc_id + 1 LEFT JOIN {labels} l ON l.doc_id = d.doc_id"""

COST = """
SELECT *, concat('The copay is ', coalesce(extracted_money, 'unknown'), '. It takes ', coalesce(extracted_time, 'unknown'), ' overall.') AS answer,
  CASE WHEN l_orderkey % 3 = 0 THEN concat('Plan copay is ', coalesce(extracted_money, 'unknown'), ' and it takes ', coalesce(extracted_time, 'unknown'), '.')
       ELSE concat('Plan copay is ', coalesce(actual_money, 'unknown'), ' and it takes ', coalesce(actual_time, 'unknown'), '.') END AS context
FROM (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_orderkey % 10 <> 0 THEN concat('$', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)) END AS extracted_money,
  CASE WHEN l_orderkey % 10 <> 0 THEN concat('$', CAST(CAST(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * (0.7 + (l_orderkey % 7) * 0.1)) AS BIGINT) AS STRING)) END AS actual_money,
  CASE WHEN l_orderkey % 30 <> 0 THEN concat(CAST(l_linenumber AS STRING), ' days') END AS extracted_time,
  CASE WHEN l_orderkey % 30 <> 0 THEN concat(CAST(l_orderkey % 5 + 1 AS STRING), ' days') END AS actual_time,
  CASE WHEN l_orderkey % 60 <> 0 THEN concat(CAST(l_linenumber AS STRING), ' steps') END AS extracted_steps,
  concat(CAST(l_orderkey % 4 + 1 AS STRING), ' steps') AS actual_steps,
  CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS judged_direction,
  CAST(l_orderkey % 4 AS INT) AS judged_impact, l_linestatus = 'F' AS judged_correct
FROM {lineitem}) x"""

VERDICT = """
SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 11 <> 0 THEN l.quality = 1 END AS truth,
  d.n_chars BETWEEN 300 AND 6000 AS verdict, l.toxic = 1 AS toxic
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id"""

RUNS = """
SELECT concat(CAST(CAST(ts AS DATE) AS STRING), '_0000_eval') AS run_id, event_id AS example_id, event_type = 'error' AS failed,
  CASE WHEN event_type = 'error' THEN 'evaluation_error' WHEN event_id % 9 = 0 THEN 'Incorrect Copay' END AS failure_mode,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE (event_id % 5) / CAST(4.0 AS DOUBLE) END AS recall_at_k,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE (user_id % 5) / CAST(4.0 AS DOUBLE) END AS precision_at_k,
  CASE WHEN event_type = 'error' THEN 0.0 ELSE least(value / 100, 1.0) END AS ndcg_at_k,
  event_type IN ('purchase', 'signup') AS correctness, event_type IN ('click', 'error') AS hallucination,
  CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(event_id % 3 - 1 AS INT) END AS risk_direction,
  CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(event_id % 4 AS INT) END AS risk_impact,
  user_id % 3 <> 0 AND event_type <> 'error' AS judge_correct, value / 100 AS duration_seconds,
  concat('j', CAST(user_id % 2 AS STRING)) AS judge, concat('c', CAST(user_id % 3 AS STRING)) AS chunker, ts
FROM {events}"""

#: Raw model responses: fenced with and without a language, bare, of a wrong type, with a missing field, an array, blank.
RESPONSE = """
SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 1 THEN concat('```', chr(10), body, chr(10), '```') WHEN 2 THEN concat('  ', body, chr(10))
  WHEN 3 THEN '{{"correctness_binary": "yes", "reasoning": "quoted"}}' WHEN 4 THEN '{{"reasoning": "no verdict"}}'
  WHEN 5 THEN '[1, 2]' ELSE '   ' END AS response,
  CASE doc_id % 5 WHEN 0 THEN '{{"risk_direction": -1, "reasoning": "over"}}' WHEN 1 THEN '{{"risk_direction": 0}}' WHEN 2 THEN '{{"risk_direction": 1, "reasoning": "under"}}'
    WHEN 3 THEN '{{"risk_direction": 2}}' ELSE '{{"risk_direction": "1"}}' END AS direction_response,
  CASE doc_id % 4 WHEN 0 THEN '{{"risk_impact": 2}}' WHEN 1 THEN '{{"risk_impact": 2.7, "reasoning": "large"}}' WHEN 2 THEN '{{"risk_impact": 5}}' ELSE '{{"risk_impact": "high"}}' END AS impact_response,
  CASE doc_id % 3 WHEN 0 THEN '{{"money": "$50", "time": null, "reasoning": "one amount"}}' WHEN 1 THEN '{{"time": "2 weeks", "steps": "3 steps", "reasoning": "times"}}' ELSE '{{"money": "$5"}}' END AS cost_response
FROM (SELECT doc_id, concat('{{"correctness_binary": ', CASE WHEN quality = 1 THEN 'true' ELSE 'false' END, CASE WHEN toxic = 1 THEN '' ELSE ', "reasoning": "checked"' END, '}}') AS body FROM {labels}) b"""

VECTORS = """SELECT vec_id, embedding, label FROM {embeddings}"""


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: where its scan gives fewer tasks than there are, its rows are dealt out anew; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spark_rows(spark: SparkSession, sf_dir: str, sql: str, dealt: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    return spark.sql(sql, **{n: dealt(spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in names})


def duck_rows(sql: str) -> str:
    """The same text for DuckDB, as a sub-query."""
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    return f"({sql.format(**{n: n for n in names})})"
