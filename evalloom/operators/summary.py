"""Evaluation of task tables, run summaries, agents and run analysis.

A flat result row has run_id, example_id, failure_mode, recall_at_k, precision_at_k, ndcg_at_k, correctness, hallucination, risk_direction,
risk_impact, judge_correct and duration_seconds. A row is valid unless its failure_mode is evaluation_error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.sources import tables

from . import irmetrics, judging, metaeval, vectors

ERROR = "evaluation_error"
IR = ("recall_at_k", "precision_at_k", "ndcg_at_k")


def is_valid() -> Column:
    return ~F.col("failure_mode").eqNullSafe(ERROR)


def error_rows(df: DataFrame, failed: Column) -> DataFrame:
    """df with the fixed values of a failed example where `failed` holds."""
    fixed = {"correctness": F.lit(False), "hallucination": F.lit(True), "risk_direction": F.lit(None).cast("int"), "risk_impact": F.lit(None).cast("int"), "judge_correct": F.lit(False), "failure_mode": F.lit(ERROR), **{m: F.lit(0.0) for m in IR}}
    return df.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in fixed.items() if c in df.columns})


NESTED = {"judge_output": ("correctness", "hallucination", "risk_direction", "risk_impact", "failure_mode"), "meta_eval_output": ("judge_correct",), "beir_metrics": IR}
PREFIX = {"judge_output": "judge_", "meta_eval_output": "meta_", "beir_metrics": "beir_"}


def nest_results(df: DataFrame) -> DataFrame:
    return df.select("run_id", "example_id", *(F.struct(*cs).alias(k) for k, cs in NESTED.items()))


def flatten_results(df: DataFrame) -> DataFrame:
    return df.select("run_id", "example_id", *(F.col(f"{k}.{c}").alias(PREFIX[k] + c) for k, cs in NESTED.items() for c in cs))


def _share(condition: Column, among: Column) -> Column:
    """Share of rows with the condition among those others; 0 if there are none."""
    return F.coalesce(F.try_divide(F.count_if(condition & among).cast("double"), F.count_if(among)), F.lit(0.0))


def summary_parts(df: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts, sums and extremes of some rows, from which `summary_of_parts` makes the summary of all rows: parts of disjoint rows just add up."""
    ok = is_valid()
    aggs = [F.count("*").alias("n"), F.count_if(ok).alias("n_valid")]
    for m in IR:
        v = F.when(ok, F.col(m))
        aggs += [F.sum(v).alias(f"{m}_sum"), F.count(v).alias(f"{m}_n"), F.min(v).alias(f"{m}_min"), F.max(v).alias(f"{m}_max")]
    aggs += [F.count_if(F.col(c) & ok).alias(f"n_{c}") for c in ("correctness", "hallucination", "judge_correct")]
    aggs += [F.count_if(F.col(c).isNotNull() & ok).alias(f"n_{c}") for c in ("risk_direction", "risk_impact")]
    return df.groupBy(*by).agg(*aggs)


def summary_of_parts(parts: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The columns of `run_summary`."""
    sums = [c for c in parts.columns if c == "n" or c.startswith("n_") or c.endswith(("_sum", "_n"))]
    rows = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *(f(c).alias(c) for m in IR for c, f in ((f"{m}_min", F.min), (f"{m}_max", F.max))))
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), F.col(whole)), F.lit(0.0))
    columns = [F.col("n").alias("total_examples"), F.col("n_valid").alias("valid_examples"), share(F.col("n") - F.col("n_valid"), "n").alias("error_rate")]
    for m in IR:
        columns += [F.try_divide(f"{m}_sum", f"{m}_n").alias(f"{m}_mean"), F.col(f"{m}_min"), F.col(f"{m}_max")]
    columns += [share(F.col(f"n_{c}"), "n_valid").alias(f"{c}_rate") for c in ("correctness", "hallucination")]
    columns += [share(F.col(f"n_{c}"), "n_valid").alias(f"{c}_coverage") for c in ("risk_direction", "risk_impact")]
    return rows.select(*by, *columns, share(F.col("n_judge_correct"), "n_valid").alias("judge_accuracy"))


def run_summary(df: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    ok = is_valid()
    aggs = [F.count("*").alias("total_examples"), F.count_if(ok).alias("valid_examples"), _share(~ok, F.lit(True)).alias("error_rate")]
    for m in IR:
        aggs += [f(F.when(ok, F.col(m))).alias(f"{m}_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    aggs += [_share(F.col("correctness"), ok).alias("correctness_rate"), _share(F.col("hallucination"), ok).alias("hallucination_rate")]
    aggs += [_share(F.col(c).isNotNull(), ok).alias(f"{c}_coverage") for c in ("risk_direction", "risk_impact")]
    return df.groupBy(*by).agg(*aggs, _share(F.col("judge_correct"), ok).alias("judge_accuracy"))


def risk_analysis(df: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    d, i = F.col("risk_direction"), F.col("risk_impact")
    some_d, some_i = d.isNotNull() & is_valid(), i.isNotNull() & is_valid()
    rates = [_share(d == v, some_d).alias(n) for v, n in ((-1, "care_avoidance_rate"), (1, "unexpected_cost_rate"), (0, "neutral_rate"))]
    levels = [_share(i == v, some_i).alias(n) for v, n in enumerate(("low_0", "moderate_1", "high_2", "critical_3"))]
    return df.groupBy(*by).agg(F.avg(F.when(some_d, d)).alias("direction_mean"), *rates, F.avg(F.when(some_i, i)).alias("impact_mean"), *levels)


def traces(df: DataFrame) -> DataFrame:
    """start_time and end_time -> with duration_seconds and success."""
    return df.select("run_id", "example_id", "start_time", "end_time", (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))).cast("double").__truediv__(1e6).alias("duration_seconds"), F.col("error").isNull().alias("success"))


#: What `count_summary` adds where the truth is known.
INTERVAL = ["raw", "corrected", "ci_lo", "ci_hi"]


def count_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of verdicts and of every level of direction and impact, zero ones too, and mean metrics. With the truth (gt_correctness) in df, also the
    share of correct answers, raw and corrected for the judge's errors, with its interval (`metaeval.bias_corrected`)."""
    levels = [F.count_if(F.col("risk_direction") == v).alias(n) for v, n in ((-1, "care_avoidance"), (0, "no_clear_direction"), (1, "unexpected_cost"))]
    levels += [F.count_if(F.col("risk_impact") == v).alias(f"impact_{v}") for v in range(4)]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(c)).alias(c) for c in ("correctness", "hallucination", "judge_correct")), *levels, *(F.avg(m).alias(m) for m in IR))
    if "gt_correctness" not in df.columns:
        return out
    share = metaeval.bias_corrected(df, by=list(by)).select(*(F.col(c).alias(f"_{c}") for c in by), *INTERVAL)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
    return out.join(share if by else F.broadcast(share), same, "left").drop(*(f"_{c}" for c in by))  # without groups it is one row


def generate_answers(examples: DataFrame, retrieved: DataFrame, generate_fn: Callable, keep: Callable[[DataFrame], DataFrame], k: int = 5, call: Callable = judging.call_model) -> DataFrame:
    """examples with context, model_answer, generation_error and the times of the call, from the k best retrieved texts of each."""
    top = retrieved.filter(F.col("rank") <= k)
    texts = top.groupBy("example_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))), lambda x: x["chunk_text"]).alias("texts"))
    rows = examples.join(texts, "example_id", "left").withColumn("prompt", judging.rag_prompt(F.col("question"), F.col("texts"), refuse=False))
    return keep(call(rows, generate_fn, out="model_answer", times=("start_time", "generated_at")).withColumnRenamed("error", "generation_error").withColumn("context", F.array_join("texts", " ")).drop("prompt", "texts"))


def judge_answers(rows: DataFrame, retrieved: DataFrame, judge_fn: Callable, keep: Callable[[DataFrame], DataFrame], run_id: str, k: int = 5, on_error: str = "row", with_costs: bool = False, gate: str = "correct", with_ir: bool = True, call: Callable = judging.call_model) -> DataFrame:
    """Flat result rows from those of `generate_answers`; see `evaluate`."""
    if on_error not in ("row", "drop"):
        raise ValueError("on_error is row or drop")
    judged = judging.judge(rows.filter("generation_error is null"), judge_fn, keep, gate=gate, call=call)
    judged = judged.withColumnRenamed("model_cost", "extracted_costs").withColumnRenamed("actual_cost", "actual_costs")
    meta = metaeval.meta_evaluate(judged.withColumn("risk_impact", F.col("risk_impact").cast("int")), with_costs).withColumn("judge_correct", F.col("meta_eval_output.judge_correct"))
    mine = ["correctness", "hallucination", "risk_direction", "risk_impact", "failure_mode", "judge_error", "judge_correct", "meta_eval_output", "judged_at"]
    out = rows.select("example_id", "start_time", "generated_at", "model_answer", "generation_error").join(meta.select("example_id", *mine), "example_id", "left")
    if with_ir:
        truth = rows.select("example_id", F.col("ground_truth_chunk_ids").alias("truth"))
        out = out.join(irmetrics.ir_metrics(retrieved.filter(F.col("rank") <= k), truth, k).withColumnRenamed("error", "ir_error"), "example_id", "left")
    else:
        out = out.withColumns({m: F.lit(None).cast("double") for m in IR} | {"ir_error": F.lit(None).cast("string")})
    out = out.withColumn("error", F.coalesce("generation_error", "judge_error", "ir_error")).withColumn("run_id", F.lit(run_id)).withColumn("end_time", F.greatest("generated_at", "judged_at")).drop("generated_at", "judged_at")
    if on_error == "drop":
        out = keep(out)
        n, failed = out.agg(F.count("*"), F.count("error")).first()
        if n and n == failed:
            raise ValueError(f"all {n} examples failed")
        return out.filter("error is null")
    return error_rows(out, F.col("error").isNotNull())


def evaluate(examples: DataFrame, retrieved: DataFrame, generate_fn: Callable, judge_fn: Callable, keep: Callable[[DataFrame], DataFrame], run_id: str, k: int = 5, generate_call: Callable = judging.call_model, judge_call: Callable = judging.call_model, **options) -> DataFrame:
    """Flat result rows of a task table, with the times at which each row's first call began and its last one ended.

    examples: example_id, question, reference_answer, ground_truth_chunk_ids; retrieved: example_id, rank, chunk_id, chunk_text. Of the options, on_error: a failed
    example becomes an error row, or is dropped; if all of several are dropped, that is an error. with_costs: extracted costs check the risk verdicts. without with_ir, retrieval
    metrics are null, and no truth is needed. keep(df) writes a stage and gives it back. generate_call, judge_call: `call_model`, or the `call` of a ledger, with which no prompt is asked twice."""
    if options.get("on_error", "row") not in ("row", "drop"):
        raise ValueError("on_error is row or drop")
    rows = generate_answers(examples, retrieved, generate_fn, keep, k, generate_call)
    return judge_answers(rows, retrieved, judge_fn, keep, run_id, k, call=judge_call, **options)


def evaluate_and_save(root: str, run_id: str, **arguments) -> DataFrame:
    """evaluate(), saved as a run: outputs, traces and the summary. Gives the outputs back."""
    keep = arguments["keep"]
    rows = keep(evaluate(run_id=run_id, **arguments))
    tables.save_run(rows, run_summary(rows), traces(rows), root, run_id)
    return rows


# agents


def numbered(df: DataFrame, prefix: str, column: str = "example_id") -> DataFrame:
    """df with ids for the rows that have none: the prefix and a number, unique in the table.

    Rows have no order that Spark keeps, so the numbers are distinct but not consecutive. Write the result before it is read twice."""
    own = F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string"))
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), own) if column in df.columns else own)


def answer_queries(queries: DataFrame, corpus: DataFrame, docstore: DataFrame, fn: Callable, k: int = 5, prompt_version: str = "v1", keep: Callable[[DataFrame], DataFrame] = tables.kept) -> DataFrame:
    """queries: question, embedding, and example_id (default batch_query_<number>) -> with response, error, chunk_ids, n_chunks, prompt_version, begun, ended."""
    if "example_id" not in queries.columns:
        queries = keep(numbered(queries, "batch_query_"))
    found = vectors.retrieve(queries, corpus, docstore, k)
    texts = found.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "chunk_text"))).alias("c"))
    rows = queries.drop("embedding").join(texts, "example_id", "left").withColumn("prompt", judging.rag_prompt(F.col("question"), F.transform("c", lambda x: x["chunk_text"])))
    rows = rows.withColumn("chunk_ids", F.coalesce(F.transform("c", lambda x: x["chunk_id"].cast("string")), F.array().cast("array<string>"))).drop("c")
    return judging.call_model(rows, fn, times=("begun", "ended")).withColumn("n_chunks", F.size("chunk_ids")).withColumn("prompt_version", F.lit(prompt_version))


def with_history(df: DataFrame, max_history: int = 5) -> DataFrame:
    """conv_id, turn, role, text rows with history: the last 2 * max_history messages before the turn."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * max_history, -1)
    return df.withColumn("history", F.transform(F.collect_list(F.struct("turn", "role", "text")).over(before), lambda x: judging.message(x["role"], x["text"])))


def agent_results(answers: DataFrame, examples: DataFrame) -> DataFrame:
    """A row for each example, with its answer and how long that took. examples without ids get them from `numbered`(examples, "example_") before they are asked."""
    rows = examples.join(answers.drop("question"), "example_id", "left")
    seconds = (F.unix_micros("ended") - F.unix_micros("begun")) / 1e6
    expected = F.col("expected_answer") if "expected_answer" in examples.columns else F.lit(None).cast("string")
    return rows.select("example_id", "question", F.coalesce(expected, F.lit("")).alias("expected_answer"), "response", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), seconds.alias("duration_seconds"), F.col("ended").alias("timestamp"))


def agent_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.coalesce(F.sum("duration_seconds"), F.lit(0.0))
    return df.groupBy(*by).agg(F.count("*").alias("n"), total.alias("total_seconds"), F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_seconds"), F.coalesce(F.try_divide(F.count("*"), F.nullif(total, F.lit(0.0))), F.lit(0.0)).alias("examples_per_second"))


# run analysis; summaries are the rows of run_summary


def compare_runs(summaries: DataFrame, configs: DataFrame) -> DataFrame:
    named = configs.select("run_id", F.coalesce("evaluation_type", F.lit("unknown")).alias("evaluation_type"))
    zero = ["error_rate", "recall_at_k_mean", "precision_at_k_mean", "ndcg_at_k_mean", "correctness_rate", "hallucination_rate", "judge_accuracy"]
    return named.join(summaries, "run_id").select("run_id", "evaluation_type", "total_examples", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in zero))


def _run_time() -> Column:
    return F.nullif(F.regexp_extract("run_id", r"(\d{4}-\d{2}-\d{2}_\d{4})", 1), F.lit(""))


def order_runs(summaries: DataFrame) -> DataFrame:
    """With position: by the time in the name, nameless last, then by name. One row a run, so one small window."""
    return summaries.withColumn("position", F.row_number().over(Window.orderBy(_run_time().asc_nulls_last(), "run_id")))


def run_trend(summaries: DataFrame, metric: str = "recall_at_k_mean") -> DataFrame:
    step = F.col(metric) - F.lag(metric).over(Window.orderBy(_run_time().asc_nulls_last(), "run_id"))
    mean = summaries.select(step.alias("step")).agg(F.avg("step").alias("mean_change"))
    return mean.withColumn("trend", F.when(F.col("mean_change") > 0.01, "improving").when(F.col("mean_change") < -0.01, "declining").otherwise("stable"))


def best_run(summaries: DataFrame, metric: str = "recall_at_k_mean") -> DataFrame:
    return summaries.orderBy(F.desc(metric), "run_id").limit(1).select("run_id", metric)


def latest_run(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.max("run_id").alias("run_id"))


def metric_corr(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """metric_a, metric_b, r for each pair; rows with a null in either are left out of it."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    row = df.agg(*(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))


def strong_corr(df: DataFrame, metrics: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return metric_corr(df, metrics).filter(F.abs("r") > threshold).orderBy(F.desc(F.abs("r")))


def fail_split(df: DataFrame) -> DataFrame:
    return df.groupBy("correctness").agg(F.count("*").alias("n"))


QUARTILES = (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))
#: Distinct values of a group that one task may sort; sketches have so many steps, and an error of a tenth of one; below SMALL values nothing is narrowed.
BOUND, GRID, SMALL = 100_000, 256, 4096
_INNER = [p for _, p in QUARTILES if 0 < p < 1]


def _with_brackets(rows: DataFrame, held: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(held) if held.count() <= BOUND else held, F.col("g").eqNullSafe(F.col("h")))


def _narrowed(some: DataFrame, held: DataFrame) -> DataFrame:
    """held: h, n, most and, for each inner quartile, lo<i> and hi<i>, between which its ranks lie: narrower ones, by quantile sketches of the values between them. most: how many values lie between at most."""
    aggs = []
    for i in range(len(_INNER)):
        inside = F.col("v").between(F.col(f"lo{i}"), F.col(f"hi{i}"))
        grid = F.percentile_approx(F.when(inside, F.col("v")), [x / GRID for x in range(GRID + 1)], 10 * GRID)
        aggs += [F.count_if(F.col("v") < F.col(f"lo{i}")).alias(f"b{i}"), F.count_if(inside).alias(f"m{i}"), grid.alias(f"q{i}"), F.first(f"lo{i}").alias(f"lo{i}"), F.first(f"hi{i}").alias(f"hi{i}")]
    found = _with_brackets(some, held).groupBy("h").agg(F.first("n").alias("n"), *aggs)
    columns, most = [], []
    for i, p in enumerate(_INNER):
        step = F.floor((F.floor((F.col("n") - 1) * p) - F.col(f"b{i}")) * GRID / F.greatest(F.col(f"m{i}") - 1, F.lit(1))).cast("int")
        small = F.col(f"m{i}") <= SMALL
        lo = F.when(small, F.col(f"lo{i}")).otherwise(F.get(f"q{i}", F.greatest(step - 1, F.lit(0))))
        hi = F.when(small, F.col(f"hi{i}")).otherwise(F.get(f"q{i}", F.least(step + 2, F.lit(GRID))))
        columns += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}")]
        most.append(F.when(small, F.col(f"m{i}")).when(lo == hi, F.lit(1)).otherwise(F.floor(F.col(f"m{i}") * 4 / GRID)))
    return found.select("h", "n", reduce(Column.__add__, most).alias("most"), *columns)


def group_quartiles(df: DataFrame, group: str, metric: str, bound: int = BOUND) -> DataFrame:
    """Quartiles of each group, exact and interpolated, and the mean. Nulls are left out; a group of nulls alone has null quartiles.

    Equal values are counted first. In a group of more than `bound` values, brackets around the wanted ranks are narrowed by quantile sketches until they hold fewer; values outside of them are
    counted by the gap that they lie in. So what is sorted for a group, its bracketed values and gaps, stays below the bound, whatever outliers or repeats it has."""
    bound = max(bound, 3 * SMALL)  # narrower brackets than these are not made
    rows = df.select(F.col(group).alias("g"), F.col(metric).cast("double").alias("v"))
    some = rows.filter("v is not null")
    counted = some.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    if (counted.agg(F.max("n")).first()[0] or 0) <= bound:
        t = rows.groupBy("g", "v").agg(F.count("v").alias("c"), F.first("v").alias("low"), F.sum("v").alias("s"))
    else:
        ends = [F.col(c).alias(f"{name}{i}") for i in range(len(_INNER)) for c, name in (("low", "lo"), ("high", "hi"))]
        held, old = counted.select(F.col("g").alias("h"), "n", F.col("n").alias("most"), *ends), None
        while True:
            held, path = _narrowed(some, held), tables.scratch(df.sparkSession)
            held = tables.kept_at(held, path)
            if old:
                tables.forget(df.sparkSession, old)
            old = path
            if (held.agg(F.max("most")).first()[0] or 0) <= bound:
                break
        v = F.col("v")
        inside = reduce(Column.__or__, (v.between(F.col(f"lo{i}"), F.col(f"hi{i}")) for i in range(len(_INNER))))
        gap = reduce(Column.__add__, ((v > F.col(f"hi{i}")).cast("int") for i in range(len(_INNER))))
        t = _with_brackets(some, held).groupBy("g", gap.alias("gap"), F.when(inside, v).alias("u")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.sum("v").alias("s"), F.min("v").alias("first"), F.max("v").alias("last"))
        # the least and the greatest value may lie in a gap, but are its ends
        t = t.select("g", F.col("u").alias("v"), "c", "low", "s", "last").unionByName(rows.groupBy("g").agg(F.count("v").alias("n")).filter("n = 0").select("g", F.lit(None).cast("double").alias("v"), F.lit(0).cast("long").alias("c"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("s"), F.lit(None).cast("double").alias("last")))
    whole = Window.partitionBy("g")
    before = whole.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    placed = t.withColumns({"first": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(whole)})
    aggs = [F.min("low").alias("min"), F.max("last" if "last" in t.columns else "low").alias("max"), F.try_divide(F.sum("s"), F.max("n")).alias("mean")]
    for i, p in enumerate(_INNER):
        r = (F.col("n") - 1) * p
        holds = lambda rank: (F.col("first") <= rank) & (rank < F.col("first") + F.col("c"))
        aggs += [F.max(F.when(holds(F.floor(r)), F.col("v"))).alias(f"a{i}"), F.max(F.when(holds(F.ceil(r)), F.col("v"))).alias(f"z{i}"), F.max(r - F.floor(r)).alias(f"f{i}")]
    found = placed.groupBy("g").agg(*aggs)
    between = {}
    for i, p in enumerate(_INNER):
        a, z, f = (F.col(f"{x}{i}") for x in "azf")
        name = next(n for n, q in QUARTILES if q == p)
        between[name] = F.when((a == z) | (f == 0), a).otherwise(a + (z - a) * f)
    return found.withColumns(between).select(F.col("g").alias(group), *(n for n, _ in QUARTILES), "mean")


def failed_details(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("correctness")).select("run_id", "example_id", "failure_mode", "recall_at_k", "hallucination")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def risk_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    d, i = F.col("risk_direction"), F.col("risk_impact")
    rates = [_share(d == v, d.isNotNull()).alias(n) for v, n in ((-1, "care_avoidance_rate"), (0, "neutral_rate"), (1, "unexpected_cost_rate"))]
    return df.groupBy(*by).agg(*rates, F.avg(i).alias("mean_impact"), _share(i >= 2, i.isNotNull()).alias("high_impact_rate"))


def kpi_bands(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rate = lambda c: F.avg(F.col(c).cast("int"))
    k = df.groupBy(*by).agg(rate("correctness").alias("correctness_rate"), rate("hallucination").alias("hallucination_rate"), rate("judge_correct").alias("judge_accuracy"), F.avg("recall_at_k").alias("avg_recall"))
    c, h, j = F.col("correctness_rate"), F.col("hallucination_rate"), F.col("judge_accuracy")
    bands = {"correctness_band": F.when(c >= 0.8, "strong").when(c >= 0.6, "moderate").otherwise("low"), "hallucination_band": F.when(h <= 0.2, "low").when(h <= 0.4, "moderate").otherwise("high"), "judge_band": F.when(j >= 0.8, "high").otherwise("could be improved")}
    return k.withColumns(bands)


#: Column, comparison, threshold, recommendation.
INSIGHTS = (
    ("avg_recall", "<", 0.7, "Improve retrieval"),
    ("hallucination_rate", ">", 0.3, "Reduce hallucinations"),
    ("correctness_rate", "<", 0.7, "Improve generation quality"),
    ("care_avoidance_rate", ">", 0.3, "Review cost estimation accuracy"),
    ("unexpected_cost_rate", ">", 0.3, "Use conservative cost estimates"),
)


def insights(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row for each rule that holds: metric, value, recommendation."""
    d = F.col("risk_direction")
    rates = df.groupBy(*by).agg(F.avg("recall_at_k").alias("avg_recall"), F.avg(F.col("hallucination").cast("int")).alias("hallucination_rate"), F.avg(F.col("correctness").cast("int")).alias("correctness_rate"), _share(d == -1, d.isNotNull()).alias("care_avoidance_rate"), _share(d == 1, d.isNotNull()).alias("unexpected_cost_rate"))
    rules = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.col(m) < t if op == "<" else F.col(m) > t).alias("holds"), F.lit(text).alias("recommendation")) for m, op, t, text in INSIGHTS))
    return rates.select(*by, F.inline(rules)).filter("holds").drop("holds")


def metric_long(df: DataFrame, metrics: Sequence[str] = IR) -> DataFrame:
    return df.unpivot(["run_id", "example_id"], list(metrics), "metric", "value")


def component_grid(df: DataFrame, components: Sequence[str], metric: str = "recall_at_k") -> DataFrame:
    """Mean metrics of each combination, and which is best by the metric (the first in order of names among equals)."""
    rows = df.groupBy(*components).agg(*(F.avg(m).alias(m) for m in IR), F.count("*").alias("n"))
    best = rows.orderBy(F.desc(metric), *components).limit(1).select(*components, F.lit(True).alias("best"))
    return rows.join(F.broadcast(best), list(components), "left").withColumn("best", F.coalesce("best", F.lit(False)))


def component_durations(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("duration_seconds").alias("mean"), F.min("duration_seconds").alias("min"), F.max("duration_seconds").alias("max"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
