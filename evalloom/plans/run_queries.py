"""Queries of run summaries and run analysis, over runs derived from the events: one a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import summary as S
from evalloom.sources import tables

from .fixtures import RUNS, duck_rows, spark_rows


def runs(s, d):
    return spark_rows(s, d, RUNS)


def summaries(s, d):
    return S.run_summary(runs(s, d))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _all(df):
    return _round(df, *(c for c, t in df.dtypes if t == "double"))


def flat(s, d):
    return _all(S.flatten_results(S.nest_results(runs(s, d))))


def errors(s, d):
    rows = runs(s, d).withColumn("failure_mode", F.lit(None).cast("string")).withColumn("hallucination", F.col("example_id") % 2 == 0)
    return _all(S.error_rows(rows, F.col("failed")).select("example_id", "failure_mode", "correctness", "hallucination", "risk_direction", "risk_impact", "judge_correct", *S.IR))


def trace_rows(s, d):
    rows = runs(s, d).withColumn("start_time", F.col("ts")).withColumn("end_time", F.timestamp_add("MICROSECOND", F.round(F.col("duration_seconds") * 1_000_000).cast("int"), F.col("ts")))
    rows = rows.withColumn("error", F.when(F.col("failed"), "failed"))
    return _all(S.traces(rows)).select("run_id", "example_id", "duration_seconds", "success")


def configs(s, d):
    return runs(s, d).select("run_id").distinct().withColumn("evaluation_type", F.when(F.substring("run_id", 10, 1) != "1", "judge"))


def history(s, d):
    rows = S.with_history(s.read.parquet(f"{d}/conversations.parquet"), 2)
    from evalloom.operators.judging import messages_to_prompt

    return rows.select("conv_id", "turn", messages_to_prompt(F.col("history")).alias("history"))


def run_list(s, d):
    return tables.run_ids(configs(s, d))


def complete(s, d):
    """Runs of odd days have no metrics, those of every seventh no outputs."""
    day = F.substring("run_id", 9, 2).cast("int")
    metrics, outputs = summaries(s, d).filter(day % 2 == 0).select("run_id", "total_examples"), runs(s, d).filter(day % 7 != 0).select("run_id", "example_id")
    return tables.complete_runs(configs(s, d), metrics, outputs).select("run_id", "evaluation_type", "total_examples")


def examples(s, d):
    tasks = s.read.parquet(f"{d}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("example_id"), F.col("source").alias("question"), F.col("text").alias("reference_answer"), F.when(F.col("doc_id") % 3 != 0, F.array(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_0")))).alias("ground_truth_chunk_ids"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") / 4).alias("beir_failure_scale_factor")
    )
    return tables.to_examples(tasks).withColumn("ground_truth_chunk_ids", F.array_join("ground_truth_chunk_ids", ","))


METRICS = ("recall_at_k", "precision_at_k", "ndcg_at_k", "duration_seconds")
QUERIES = {
    "to_examples": examples,
    "list_runs": run_list,
    "load_all_runs": complete,
    "error_rows": errors,
    "flatten_results": flat,
    "run_summary": lambda s, d: _all(summaries(s, d)),
    "risk_analysis": lambda s, d: _all(S.risk_analysis(runs(s, d))),
    "traces": trace_rows,
    "count_summary": lambda s, d: _all(S.count_summary(runs(s, d), ["run_id"])),
    "conversation_history": history,
    "agent_throughput": lambda s, d: _all(S.agent_summary(runs(s, d), ["judge"])),
    "run_comparison": lambda s, d: _all(S.compare_runs(summaries(s, d), configs(s, d))),
    "run_order": lambda s, d: S.order_runs(summaries(s, d)).select("run_id", "position"),
    "run_trend": lambda s, d: _all(S.run_trend(summaries(s, d))),
    "best_run": lambda s, d: _all(S.best_run(summaries(s, d))),
    "latest_run": lambda s, d: S.latest_run(summaries(s, d)),
    "metric_corr": lambda s, d: _all(S.metric_corr(runs(s, d), METRICS)),
    "strong_corr": lambda s, d: _all(S.strong_corr(runs(s, d), METRICS)),
    "fail_split": lambda s, d: S.fail_split(runs(s, d)),
    "group_quartiles": lambda s, d: _all(S.group_quartiles(runs(s, d), "judge", "ndcg_at_k")),
    "failed_details": lambda s, d: _all(S.failed_details(runs(s, d))),
    "risk_counts": lambda s, d: S.value_counts(runs(s, d), "risk_direction"),
    "risk_stats": lambda s, d: _all(S.risk_stats(runs(s, d))),
    "kpi_bands": lambda s, d: _all(S.kpi_bands(runs(s, d), ["run_id"])),
    "insights": lambda s, d: _all(S.insights(runs(s, d), ["run_id"])),
    "metric_long": lambda s, d: _all(S.metric_long(runs(s, d))),
    "component_grid": lambda s, d: _all(S.component_grid(runs(s, d), ["judge", "chunker"])),
    "component_durations": lambda s, d: _all(S.component_durations(runs(s, d), ["chunker"])),
}

_R = duck_rows(RUNS)
_OK = "(failure_mode IS NULL OR failure_mode <> 'evaluation_error')"


def _share(condition, among="true"):
    return f"coalesce(count(*) FILTER (({condition}) AND {among}) / nullif(count(*) FILTER ({among}), 0)::DOUBLE, 0)"


def _r(e, name):
    return f"round({e}, 6) AS {name}"


_IR = [_r(f"{f}({m}) FILTER ({_OK})", f"{m}_{n}") for m in S.IR for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"))]
_SUMMARY = f"""(SELECT run_id, count(*) AS total_examples, count(*) FILTER ({_OK}) AS valid_examples, {_share(f'NOT {_OK}')} AS error_rate,
  {', '.join(f"{f}({m}) FILTER ({_OK}) AS {m}_{n}" for m in S.IR for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))},
  {_share('correctness', _OK)} AS correctness_rate, {_share('hallucination', _OK)} AS hallucination_rate, {_share('risk_direction IS NOT NULL', _OK)} AS risk_direction_coverage, {_share('risk_impact IS NOT NULL', _OK)} AS risk_impact_coverage,
  {_share('judge_correct', _OK)} AS judge_accuracy FROM {_R} GROUP BY run_id)"""
_SOME_D, _SOME_I = f"risk_direction IS NOT NULL AND {_OK}", f"risk_impact IS NOT NULL AND {_OK}"
_TIME = r"nullif(regexp_extract(run_id, '(\d{4}-\d{2}-\d{2}_\d{4})', 1), '')"
_PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {_r(f'corr({a}, {b})', 'r')} FROM {_R}" for a, b in _PAIRS)
_KPI = f"(SELECT run_id, avg(correctness::INT) AS correctness_rate, avg(hallucination::INT) AS hallucination_rate, avg(judge_correct::INT) AS judge_accuracy, avg(recall_at_k) AS avg_recall, {_share('risk_direction = -1', 'risk_direction IS NOT NULL')} AS care_avoidance_rate, {_share('risk_direction = 1', 'risk_direction IS NOT NULL')} AS unexpected_cost_rate FROM {_R} GROUP BY run_id)"
_RISK = [("risk_direction = -1", "care_avoidance_rate"), ("risk_direction = 0", "neutral_rate"), ("risk_direction = 1", "unexpected_cost_rate")]
_GRID = f"(SELECT judge, chunker, avg(recall_at_k) AS recall_at_k, avg(precision_at_k) AS precision_at_k, avg(ndcg_at_k) AS ndcg_at_k, count(*) AS n FROM {_R} GROUP BY 1, 2)"
_DAY = "CAST(substring(run_id, 9, 2) AS INT)"
SQL = {
    "to_examples": "SELECT CAST(doc_id AS VARCHAR) AS example_id, source AS question, text AS reference_answer, CASE WHEN doc_id % 3 <> 0 THEN doc_id || '_chunk_0' ELSE '' END AS ground_truth_chunk_ids, CASE WHEN doc_id % 2 = 0 THEN doc_id / 4.0::DOUBLE ELSE 1.0 END AS beir_failure_scale_factor FROM documents",
    "list_runs": f"SELECT DISTINCT run_id FROM {_R}",
    "load_all_runs": f"SELECT run_id, CASE WHEN substring(run_id, 10, 1) <> '1' THEN 'judge' END AS evaluation_type, total_examples FROM {_SUMMARY} WHERE {_DAY} % 2 = 0 AND {_DAY} % 7 <> 0",
    "error_rows": f"""SELECT example_id, CASE WHEN failed THEN 'evaluation_error' END AS failure_mode, NOT failed AND correctness AS correctness, failed OR example_id % 2 = 0 AS hallucination,
  CASE WHEN NOT failed THEN risk_direction END AS risk_direction, CASE WHEN NOT failed THEN risk_impact END AS risk_impact, NOT failed AND judge_correct AS judge_correct, {', '.join(_r(f'CASE WHEN failed THEN 0 ELSE {m} END', m) for m in S.IR)} FROM {_R}""",
    "flatten_results": f"SELECT run_id, example_id, correctness AS judge_correctness, hallucination AS judge_hallucination, risk_direction AS judge_risk_direction, risk_impact AS judge_risk_impact, failure_mode AS judge_failure_mode, judge_correct AS meta_judge_correct, {', '.join(_r(m, 'beir_' + m) for m in S.IR)} FROM {_R}",
    "run_summary": f"SELECT run_id, total_examples, valid_examples, {', '.join(_r(c, c) for c in ['error_rate', *(f'{m}_{n}' for m in S.IR for n in ('mean', 'min', 'max')), 'correctness_rate', 'hallucination_rate', 'risk_direction_coverage', 'risk_impact_coverage', 'judge_accuracy'])} FROM {_SUMMARY}",
    "risk_analysis": f"""SELECT run_id, {_r(f'avg(risk_direction) FILTER ({_SOME_D})', 'direction_mean')}, {', '.join(_r(_share(f'risk_direction = {v}', _SOME_D), n) for v, n in ((-1, 'care_avoidance_rate'), (1, 'unexpected_cost_rate'), (0, 'neutral_rate')))},
  {_r(f'avg(risk_impact) FILTER ({_SOME_I})', 'impact_mean')}, {', '.join(_r(_share(f'risk_impact = {v}', _SOME_I), n) for v, n in enumerate(('low_0', 'moderate_1', 'high_2', 'critical_3')))} FROM {_R} GROUP BY run_id""",
    "traces": f"SELECT run_id, example_id, round(round(duration_seconds * 1000000) / 1000000, 6) AS duration_seconds, NOT failed AS success FROM {_R}",
    "count_summary": f"""SELECT run_id, count(*) AS n, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in ('correctness', 'hallucination', 'judge_correct'))}, {', '.join(f'count(*) FILTER (risk_direction = {v}) AS {n}' for v, n in ((-1, 'care_avoidance'), (0, 'no_clear_direction'), (1, 'unexpected_cost')))},
  {', '.join(f'count(*) FILTER (risk_impact = {v}) AS impact_{v}' for v in range(4))}, {', '.join(_r(f'avg({m})', m) for m in S.IR)} FROM {_R} GROUP BY run_id""",
    "conversation_history": "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), '') AS history FROM conversations",
    "agent_throughput": f"SELECT judge, count(*) AS n, {_r('sum(duration_seconds)', 'total_seconds')}, {_r('avg(duration_seconds)', 'avg_seconds')}, {_r('count(*) / sum(duration_seconds)', 'examples_per_second')} FROM {_R} GROUP BY judge",
    "run_comparison": f"SELECT run_id, CASE WHEN substring(run_id, 10, 1) <> '1' THEN 'judge' ELSE 'unknown' END AS evaluation_type, total_examples, {', '.join(_r(c, c) for c in ('error_rate', 'recall_at_k_mean', 'precision_at_k_mean', 'ndcg_at_k_mean', 'correctness_rate', 'hallucination_rate', 'judge_accuracy'))} FROM {_SUMMARY}",
    "run_order": f"SELECT run_id, CAST(row_number() OVER (ORDER BY {_TIME} NULLS LAST, run_id) AS INT) AS position FROM {_SUMMARY}",
    "run_trend": f"SELECT {_r('m', 'mean_change')}, CASE WHEN m > 0.01 THEN 'improving' WHEN m < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM (SELECT avg(step) AS m FROM (SELECT recall_at_k_mean - lag(recall_at_k_mean) OVER (ORDER BY {_TIME} NULLS LAST, run_id) AS step FROM {_SUMMARY}))",
    "best_run": f"SELECT run_id, {_r('recall_at_k_mean', 'recall_at_k_mean')} FROM (SELECT * FROM {_SUMMARY} x ORDER BY x.recall_at_k_mean DESC, run_id LIMIT 1)",
    "latest_run": f"SELECT max(run_id) AS run_id FROM {_SUMMARY}",
    "metric_corr": _CORR,
    "strong_corr": f"SELECT * FROM ({_CORR}) WHERE abs(r) > 0.5",
    "fail_split": f"SELECT correctness, count(*) AS n FROM {_R} GROUP BY 1",
    "group_quartiles": f"SELECT judge, {', '.join(_r(f'quantile_cont(ndcg_at_k, {q})', n) for q, n in ((0, 'min'), (0.25, 'q1'), (0.5, 'median'), (0.75, 'q3'), (1, 'max')))}, {_r('avg(ndcg_at_k)', 'mean')} FROM {_R} GROUP BY 1",
    "failed_details": f"SELECT run_id, example_id, failure_mode, {_r('recall_at_k', 'recall_at_k')}, hallucination FROM {_R} WHERE NOT correctness",
    "risk_counts": f"SELECT risk_direction, count(*) AS n FROM {_R} WHERE risk_direction IS NOT NULL GROUP BY 1",
    "risk_stats": f"SELECT {', '.join(_r(_share(c, 'risk_direction IS NOT NULL'), n) for c, n in _RISK)}, {_r('avg(risk_impact)', 'mean_impact')}, {_r(_share('risk_impact >= 2', 'risk_impact IS NOT NULL'), 'high_impact_rate')} FROM {_R}",
    "kpi_bands": f"""SELECT run_id, {', '.join(_r(c, c) for c in ('correctness_rate', 'hallucination_rate', 'judge_accuracy', 'avg_recall'))}, CASE WHEN correctness_rate >= 0.8 THEN 'strong' WHEN correctness_rate >= 0.6 THEN 'moderate' ELSE 'low' END AS correctness_band,
  CASE WHEN hallucination_rate <= 0.2 THEN 'low' WHEN hallucination_rate <= 0.4 THEN 'moderate' ELSE 'high' END AS hallucination_band, CASE WHEN judge_accuracy >= 0.8 THEN 'high' ELSE 'could be improved' END AS judge_band FROM {_KPI}""",
    "insights": " UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, {_r(m, 'value')}, '{t}' AS recommendation FROM {_KPI} WHERE {m} {op} {x}" for m, op, x, t in S.INSIGHTS),
    "metric_long": " UNION ALL ".join(f"SELECT run_id, example_id, '{m}' AS metric, {_r(m, 'value')} FROM {_R}" for m in S.IR),
    "component_grid": f"SELECT judge, chunker, {', '.join(_r(m, m) for m in S.IR)}, n, row_number() OVER (ORDER BY g.recall_at_k DESC, judge, chunker) = 1 AS best FROM {_GRID} g",
    "component_durations": f"SELECT chunker, {_r('avg(duration_seconds)', 'mean')}, {_r('min(duration_seconds)', 'min')}, {_r('max(duration_seconds)', 'max')} FROM {_R} GROUP BY 1",
}
