"""Queries whose rows went through written runs, indexes, ledgers and whole evaluations, with deterministic stand-ins for models."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import judging as J
from evalloom.operators import summary as S
from evalloom.operators import vectors as V
from evalloom.sources import tables
from evalloom.sources.ledger import Ledger

from . import retrieval_queries, run_queries
from .fixtures import QA, duck_rows, spark_rows
from .judge_queries import _QA, _Z, _prompt_size, stub
from .retrieval_queries import LETTERS, letter_counts, vectors
from .run_queries import _R, _all, _r, runs, trace_rows
from .text_queries import SQL as TEXT_SQL
from .text_queries import corpus

OUTPUT = ["example_id", "correctness", "hallucination", "risk_direction", "risk_impact", "failure_mode", "judge_correct", *S.IR]


def _saved(s, d):
    """All runs of the events, saved together and read back."""
    root = tables.scratch(s)
    rows = runs(s, d)
    day = lambda df: df.withColumnRenamed("run_id", "day")
    tables.save_run(day(rows.select("run_id", *OUTPUT)), day(S.run_summary(rows)), day(trace_rows(s, d)), root, "all")
    return root


def saved_outputs(s, d):
    return _all(tables.read_outputs(s, _saved(s, d), "all").select("run_id", "day", *OUTPUT))


def saved_metrics(s, d):
    return _all(tables.load_results(s, _saved(s, d), "all")[1])


def saved_traces(s, d):
    return _all(tables.read_traces(s, _saved(s, d)).select("day", "example_id", "success", "duration_seconds"))


def summary_merged(s, d):
    """The summaries of all runs, from parts of them."""
    return _all(S.summary_of_parts(S.summary_parts(runs(s, d), ["run_id", "judge"])))


def count_summary_corrected(s, d):
    return _all(S.count_summary(runs(s, d).withColumn("gt_correctness", F.col("example_id") % 4 != 0), ["run_id"]).select("run_id", "n", "correctness", *S.INTERVAL))


def _embedded(index):
    docstore, embeddings = index
    rows = docstore.join(embeddings, "chunk_id")
    return rows.select("chunk_id", "document_id", F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


def index_built(s, d):
    path = tables.scratch(s)
    V.build_index(corpus(s, d), letter_counts, path)
    return _embedded(V.read_index(s, path))


def index_appended(s, d):
    """Of half of the documents, then all of them added, twice."""
    path = tables.scratch(s)
    V.build_index(corpus(s, d).filter("CAST(document_id AS BIGINT) % 2 = 0"), letter_counts, path)
    for _ in range(2):
        V.append_index(corpus(s, d), letter_counts, path)
    return _embedded(V.read_index(s, path))


def lengths(prompts, temperature, max_tokens):
    return [str(len(p)) for p in prompts]


def ledger_answers(s, d):
    """Every turn's text as a prompt, asked through a ledger, and again."""
    book = Ledger(s, tables.scratch(s), "lengths")
    rows = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("prompt"))
    book.call(rows, lengths)
    return book.call(rows, lengths).select("conv_id", "turn", "response", "error")


def odd_or_even(prompts, temperature, max_tokens):
    return ["That is incorrect." if len(p) % 2 else "Yes, it is correct." for p in prompts]


def keyword_judge(s, d):
    rows = spark_rows(s, d, QA).select("doc_id", F.lit("what?").alias("question"), F.col("answer").alias("generated_answer"), F.col("reference").alias("reference_answer"), "context")
    for stage in ("correctness", "hallucination"):
        rows = J.keyword_judge(rows, odd_or_even, stage)
    return rows.select("doc_id", "correctness", "hallucination", F.coalesce("correctness_error", "hallucination_error").alias("error"))


def five(prompts, temperature, max_tokens):
    return ["it costs $5" for _ in prompts]


def _evaluated(s, d, **options):
    docs = s.read.parquet(f"{d}/documents.parquet")
    truth = F.when(F.col("doc_id") % 5 == 0, F.array()).otherwise(F.array(F.col("doc_id").cast("string"))).cast("array<string>")
    examples = docs.select(F.col("doc_id").alias("example_id"), F.lit("what?").alias("question"), F.col("source").alias("reference_answer"), truth.alias("ground_truth_chunk_ids"))
    found = docs.select(F.col("doc_id").alias("example_id"), F.lit(1).alias("rank"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("chunk_text"))
    rows = S.evaluate(examples, found, five, stub, tables.kept, "r", **options)
    return rows.select("example_id", "model_answer", "correctness", "hallucination", "risk_direction", F.col("risk_impact").cast("int").alias("risk_impact"), "failure_mode", "recall_at_k", "error")


def agent_answers(s, d):
    q, c, store, _ = vectors(s, d)
    asked = q.select("example_id", F.concat(F.lit("what is "), F.col("example_id").cast("string")).alias("question"), "embedding")
    answers = tables.kept(S.answer_queries(asked, c, store, five, 5))
    return S.agent_results(answers, asked).select("example_id", "question", "expected_answer", "response", "n_chunks", (F.col("duration_seconds") >= 0).alias("timed"))


QUERIES = {
    "saved_outputs": saved_outputs,
    "saved_metrics": saved_metrics,
    "saved_traces": saved_traces,
    "summary_merged": summary_merged,
    "count_summary_corrected": count_summary_corrected,
    "impact_counts": lambda s, d: S.value_counts(runs(s, d), "risk_impact"),
    "failure_mode_compat": lambda s, d: spark_rows(s, d, QA).select("doc_id", J.failure_mode(F.col("answer"), compat=True).alias("mode")),
    "index_built": index_built,
    "index_appended": index_appended,
    "ledger_answers": ledger_answers,
    "keyword_judge": keyword_judge,
    "evaluate": _evaluated,
    "evaluate_dropping": lambda s, d: _evaluated(s, d, on_error="drop"),
    "agent_answers": agent_answers,
}

_INDEX = "SELECT chunk_id, document_id, concat_ws(',', length(text), " + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in LETTERS) + f") AS embedding FROM ({TEXT_SQL['chunk_fixed']})"
_PARTS = f"""(SELECT run_id, count(*) AS n, count(*) FILTER (correctness) AS correctness, avg(coalesce(correctness, false)::INT) AS raw,
  count(*) FILTER (NOT truth) AS m0, count(*) FILTER (truth) AS m1, count(*) FILTER (NOT truth AND NOT correctness) AS tn, count(*) FILTER (truth AND correctness) AS tp FROM (SELECT *, example_id % 4 <> 0 AS truth FROM {_R}) GROUP BY run_id)"""
_ASKED = f"(SELECT *, CASE WHEN m0 > 0 THEN (tn + 1) / (m0 + 2)::DOUBLE ELSE 0.5 END AS q0, CASE WHEN m1 > 0 THEN (tp + 1) / (m1 + 2)::DOUBLE ELSE 0.5 END AS q1 FROM {_PARTS})"
_FIXED = f"(SELECT *, greatest(0, least(1, CASE WHEN abs(q0 + q1 - 1) < 1e-12 THEN raw ELSE (raw + q0 - 1) / (q0 + q1 - 1) END)) AS c, {_Z} * sqrt(raw * (1 - raw) / n) AS w FROM {_ASKED})"


def _keyword_size(stage, *columns):
    fixed = len(J.KEYWORD_TEMPLATES[stage].replace("{question}", "what?").replace("{reference_answer}", "").replace("{generated_answer}", "").replace("{context}", ""))
    return f"({fixed} + " + " + ".join(f"coalesce(length({c}), 0)" for c in columns) + ")"


def _evaluated_sql(keep: str, truth: str) -> str:
    answer = "'it costs $5'"
    impact = len(J.TEMPLATES["risk_impact"]) - sum(len(p) + 2 for p in J.REQUIRED["risk_impact"]) + 2 * len('{"money":"$5"}')
    c = f"{_prompt_size('correctness', repr('what?'), answer, 'source')} % 3 <> 0"
    h = f"{_prompt_size('hallucination', 'text', answer)} % 5 = 0"
    direction = f"{_prompt_size('risk_direction', answer, 'text')} % 3 - 1"
    fine = lambda value, bad: f"CASE WHEN {truth} THEN {value} ELSE {bad} END"
    return f"""SELECT doc_id AS example_id, 'it costs $5' AS model_answer, {fine('c', 'FALSE')} AS correctness, {fine('h', 'TRUE')} AS hallucination, CAST({fine('CASE WHEN c THEN d END', 'NULL')} AS INT) AS risk_direction,
  CAST({fine(f'CASE WHEN c THEN {impact % 4} END', 'NULL')} AS INT) AS risk_impact, {fine('CAST(NULL AS VARCHAR)', "'evaluation_error'")} AS failure_mode, {fine('1.0::DOUBLE', '0')} AS recall_at_k, {fine('CAST(NULL AS VARCHAR)', "'empty ground truth'")} AS error
FROM (SELECT *, {c} AS c, {h} AS h, {direction} AS d FROM documents) WHERE {keep}"""


SQL = {
    "saved_outputs": f"SELECT 'all' AS run_id, run_id AS day, {', '.join(c if c not in S.IR else _r(c, c) for c in OUTPUT)} FROM {_R}",
    "saved_metrics": f"SELECT 'all' AS run_id, run_id AS day, * EXCLUDE (run_id) FROM ({run_queries.SQL['run_summary']})",
    "saved_traces": f"SELECT run_id AS day, example_id, success, duration_seconds FROM ({run_queries.SQL['traces']})",
    "summary_merged": run_queries.SQL["run_summary"],
    "count_summary_corrected": f"SELECT run_id, n, correctness, {_r('raw', 'raw')}, {_r('c', 'corrected')}, {_r('greatest(0, c - w)', 'ci_lo')}, {_r('least(1, c + w)', 'ci_hi')} FROM {_FIXED}",
    "impact_counts": f"SELECT risk_impact, count(*) AS n FROM {_R} WHERE risk_impact IS NOT NULL GROUP BY 1",
    "failure_mode_compat": "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(answer), '{p}') THEN '{n}'" for p, n in J.FAILURE_MODES[: [p for p, _ in J.FAILURE_MODES].index("hallucination")]) + f" ELSE 'Hallucination' END AS mode FROM {_QA}",
    "index_built": _INDEX,
    "index_appended": _INDEX,
    "ledger_answers": "SELECT conv_id, turn, CAST(length(text) AS VARCHAR) AS response, CAST(NULL AS VARCHAR) AS error FROM conversations",
    "keyword_judge": f"SELECT doc_id, {_keyword_size('correctness', 'reference', 'answer')} % 2 = 0 AS correctness, {_keyword_size('hallucination', 'context', 'answer')} % 2 = 0 AS hallucination, CAST(NULL AS VARCHAR) AS error FROM {duck_rows(QA)}",
    "evaluate": _evaluated_sql("TRUE", "doc_id % 5 <> 0"),
    "evaluate_dropping": _evaluated_sql("doc_id % 5 <> 0", "TRUE"),
    "agent_answers": f"SELECT e.vec_id AS example_id, 'what is ' || e.vec_id AS question, '' AS expected_answer, 'it costs $5' AS response, CAST(coalesce(n, 0) AS INT) AS n_chunks, TRUE AS timed FROM embeddings e LEFT JOIN (SELECT example_id, count(*) AS n FROM {retrieval_queries._TOP5} GROUP BY 1) c ON c.example_id = e.vec_id WHERE e.vec_id % 100 = 0",
}
