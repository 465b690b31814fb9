"""Deterministic checks of a judge's verdicts, and how reliable the judge is.

The checks are Column functions; meta_evaluate is one narrow select. The reliability operators are one aggregation each, per group of `by`.
Costs are struct columns of strings: money, time, steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import blank, claims, clip, is_generic, jaccard, keyword_set, keywords, let, normalize, numeric_cost, strip

SIMILAR, SUPPORTED, SHORT = 0.7, 0.5, 50
DIRECTIONS, IMPACTS = (-1, 0, 1), (0, 1, 2, 3)


def _similar(a: Column, b: Column) -> Column:
    """Of two sets of keywords."""
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (jaccard(a, b) >= SIMILAR), F.lit(False))


def _unsupported(claims: Column, text: Column, words: Column) -> Column:
    """Whether one of the claims is unsupported: looked for one after another, and cut into keywords only where the text does not hold it. text: normalised; words: its set of keywords."""

    def alone(own: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(own, words)), F.size(own)), F.lit(0.0)) < SUPPORTED

    return F.exists(F.transform(claims, normalize), lambda c: ~F.contains(text, c) & let(F.array_distinct(keywords(c)), alone))


def _vague(answer: Column) -> Column:
    return (F.length(strip(answer)) < SHORT) | is_generic(answer)


def gt_correctness(answer: Column, reference: Column) -> Column:
    """Equal after normalisation, or similar by keywords."""

    def alike(n: Column) -> Column:
        similar = let(F.struct(keyword_set(n["a"]).alias("a"), keyword_set(n["b"]).alias("b")), lambda w: _similar(w["a"], w["b"]))
        return F.when(n["a"] == n["b"], True).when(n["a"].isNotNull() & n["b"].isNotNull(), similar)

    return let(F.struct(normalize(answer).alias("a"), normalize(reference).alias("b")), alike)


def gt_hallucination(answer: Column, context: Column) -> Column:
    """Whether a claim of the answer is unsupported; without context always, without claims unless short or generic.

    The context is normalised and cut into keywords once for a row, whatever its number of claims."""

    def some_unsupported(found: Column) -> Column:
        known = let(normalize(context), lambda n: F.struct(n.alias("text"), F.array_distinct(keywords(n)).alias("words")))
        return let(known, lambda k: _unsupported(found, k["text"], k["words"]))

    return F.when(blank(context), True).otherwise(let(claims(answer), lambda found: F.when(F.size(found) == 0, ~_vague(answer)).otherwise(some_unsupported(found))))


def with_truths(df: DataFrame, answer: str, reference: str, context: str, correctness: str, hallucination: str) -> DataFrame:
    """df with gt_correctness and gt_hallucination as columns of these names.

    The same as the two expressions, in steps: each text is normalised once and cut into its set of keywords once, in generated code; claims are looked at until one is unsupported."""
    texts = {"_of_a": F.col(answer), "_of_r": F.col(reference), "_of_c": F.col(context)}
    out = df.withColumns({k: normalize(c) for k, c in texts.items()} | {"_of_claims": claims(F.col(answer))})
    out = out.withColumns({f"{k}w": keyword_set(F.col(k)) for k in texts})
    correct = F.when(F.col("_of_a") == F.col("_of_r"), True).when(F.col("_of_a").isNotNull() & F.col("_of_r").isNotNull(), _similar(F.col("_of_aw"), F.col("_of_rw")))
    some = _unsupported(F.col("_of_claims"), F.col("_of_c"), F.col("_of_cw"))
    of_claims = F.when(F.size("_of_claims") == 0, ~_vague(F.col(answer))).when(F.col("_of_claims").isNotNull(), some)
    out = out.withColumns({correctness: correct, hallucination: F.when(blank(F.col(context)), True).otherwise(of_claims)})
    return out.drop(*texts, *(f"{k}w" for k in texts), "_of_claims")


FIELDS = ("money", "time", "steps")


def numeric_costs(costs: Column) -> Column:
    """The numbers of a struct of costs, as a struct of doubles."""
    return F.struct(*(numeric_cost(costs[f].cast("string")).alias(f) for f in FIELDS))


def _direction(extracted: Column, actual: Column) -> Column:
    out = F.lit(None).cast("int")
    for field, up, down in (("steps", 1.0, 1.0), ("time", 1.1, 0.9), ("money", 1.1, 0.9)):
        e, a = extracted[field], actual[field]
        out = F.when(e.isNotNull() & a.isNotNull(), F.when(e > a * up, -1).when(e < a * down, 1).otherwise(0)).otherwise(out)
    return out


def _impact(extracted: Column, actual: Column) -> Column:
    differences = []
    for field in ("money", "time"):
        e, a = extracted[field], actual[field]
        differences.append(F.coalesce(F.when(a > 0, F.abs(e - a) / a), F.lit(0.0)))
    return let(F.greatest(*differences), lambda most: F.when(most < 0.05, 0).when(most < 0.20, 1).when(most < 0.50, 2).otherwise(3))


def _both(extracted: Column, actual: Column, fn) -> Column:
    return let(F.struct(numeric_costs(extracted).alias("e"), numeric_costs(actual).alias("a")), lambda x: fn(x["e"], x["a"]))


def gt_risk_direction(extracted: Column, actual: Column) -> Column:
    """-1 if the first comparable cost is overestimated, 1 if underestimated, 0 if neither; null if none is comparable."""
    return _both(extracted, actual, _direction)


def gt_risk_impact(extracted: Column, actual: Column) -> Column:
    """0 to 3 by the greater relative difference of money and time."""
    return _both(extracted, actual, _impact)


def direction_valid(verdict: Column, truth: Column) -> Column:
    """truth: gt_risk_direction; a missing verdict is valid."""
    return verdict.isNull() | (F.coalesce(truth, F.lit(0)) == verdict)


def impact_valid(verdict: Column, truth: Column) -> Column:
    """truth: gt_risk_impact; one level off is valid."""
    return verdict.isNull() | (F.abs(verdict - truth) <= 1)


#: The sentences of an explanation.
def explanation(correct: Column, hallucination: Column, direction: Column, impact: Column) -> Column:
    named = (("Correctness verdict", correct), ("Hallucination verdict", hallucination), ("Risk direction", direction), ("Risk impact", impact))
    parts = [F.concat(F.lit(n), F.when(c, " validated").otherwise(" mismatch")) for n, c in named]
    overall = F.when(correct & hallucination & direction & impact, "All validations passed").otherwise("Some validations failed")
    return F.concat(overall, F.lit(". "), F.concat_ws("; ", *parts), F.lit("."))


def meta_evaluate(df: DataFrame, with_costs: bool = False) -> DataFrame:
    """df (model_answer, reference_answer, context, correctness, hallucination, risk_direction, risk_impact; with_costs: extracted_costs,
    actual_costs) with the struct meta_eval_output. Risk checks hold only for answers judged correct with both costs; else they pass."""
    out = with_truths(df, "model_answer", "reference_answer", "context", "_gc", "_gh")
    if with_costs:
        gate = F.coalesce(F.col("correctness"), F.lit(False)) & F.col("extracted_costs").isNotNull() & F.col("actual_costs").isNotNull()
        risk = _both(F.col("extracted_costs"), F.col("actual_costs"), lambda e, a: F.struct(_direction(e, a).alias("d"), _impact(e, a).alias("i")))
        out = out.withColumn("_gate", gate).withColumn("_risk", F.when(F.col("_gate"), risk)).withColumns({"_gd": F.col("_risk.d"), "_gi": F.col("_risk.i")})
        out = out.withColumns({"_od": ~F.col("_gate") | direction_valid(F.col("risk_direction"), F.col("_gd")), "_oi": ~F.col("_gate") | impact_valid(F.col("risk_impact"), F.col("_gi"))}).drop("_gate", "_risk")
    else:
        none = F.lit(None).cast("int")
        out = out.withColumns({"_gd": none, "_gi": none, "_od": F.lit(True), "_oi": F.lit(True)})
    oc, oh = F.coalesce(F.col("correctness") == F.col("_gc"), F.lit(False)), F.coalesce(F.col("hallucination") == F.col("_gh"), F.lit(False))
    od, oi = F.col("_od"), F.col("_oi")
    made = F.struct((oc & oh & od & oi).alias("judge_correct"), explanation(oc, oh, od, oi).alias("explanation"), F.col("_gc").alias("ground_truth_correctness"), F.col("_gh").alias("ground_truth_hallucination"), F.col("_gd").alias("ground_truth_risk_direction"), F.col("_gi").alias("ground_truth_risk_impact"))
    return out.withColumn("meta_eval_output", made).drop("_gc", "_gh", "_gd", "_gi", "_od", "_oi")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _confusion(pred: Column, actual: Column) -> list[Column]:
    return [F.count_if(pred & actual).alias("tp"), F.count_if(~pred & ~actual).alias("tn"), F.count_if(pred & ~actual).alias("fp"), F.count_if(~pred & actual).alias("fn"), F.count_if(pred.isNotNull() & actual.isNotNull()).alias("total")]


def _scored(df: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumn("precision", p).withColumn("recall", r)
    return df.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary_metrics(df: DataFrame, pred: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, tp, tn, fp, fn, total; pairs with a null count nowhere."""
    return _scored(df.groupBy(*by).agg(*_confusion(F.col(pred), F.col(actual))))


def macro_metrics(df: DataFrame, pred: str, actual: str, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """One against the rest for each class of the fixed list, averaged; counts are summed, total is the number of pairs."""
    each = [F.struct(*_confusion(F.col(pred) == c, F.col(actual) == c)) for c in classes]
    pairs = F.count_if(F.col(pred).isNotNull() & F.col(actual).isNotNull()).alias("pairs")
    rows = df.groupBy(*by).agg(F.array(*each).alias("each"), pairs).select(*by, "pairs", F.explode("each").alias("x")).select(*by, "pairs", "x.*")
    rows = _scored(rows)
    sums = [F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]
    return rows.groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), *sums, F.max("pairs").alias("total"))


SCORE = ["metric", "precision", "recall", "f1", "tp", "tn", "fp", "fn", "total"]


def judge_scorecard(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A row per metric, for columns correctness, gt_correctness and so on; risk metrics without pairs are left out. One aggregation for all."""
    named = [("correctness", None), ("hallucination", None), ("risk_direction", DIRECTIONS), ("risk_impact", IMPACTS)]
    each = []
    for name, classes in named:
        p, a = F.col(name), F.col(f"gt_{name}")
        for c in classes or (None,):
            counts = _confusion(p, a) if c is None else _confusion(p == c, a == c)
            each.append(F.struct(F.lit(name).alias("metric"), F.lit(classes is not None).alias("macro"), *counts))
    rows = _scored(df.groupBy(*by).agg(F.array(*each).alias("each")).select(*by, F.inline("each")))
    means = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    sums = [F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")]
    return rows.groupBy(*by, "metric", "macro").agg(*means, *sums, F.max("total").alias("total")).filter("not macro or total > 0").select(*by, *SCORE)


def calibration(df: DataFrame, pred: str = "correctness", actual: str = "gt_correctness", by: Sequence[str] = ()) -> DataFrame:
    """q0 (specificity), q1 (sensitivity), smoothed; 0.5 for a class without rows; m0, m1, and n and raw over all rows."""
    p, a = F.col(pred), F.col(actual)
    rows = df.groupBy(*by).agg(F.count_if(~a).alias("m0"), F.count_if(a).alias("m1"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & p).alias("tp"), F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce(p, F.lit(False)).cast("int")), F.lit(0.0)).alias("raw"))
    q0 = F.when(F.col("m0") > 0, (F.col("tn") + 1) / (F.col("m0") + 2)).otherwise(0.5)
    q1 = F.when(F.col("m1") > 0, (F.col("tp") + 1) / (F.col("m1") + 2)).otherwise(0.5)
    return rows.select(*by, "raw", q0.alias("q0"), q1.alias("q1"), "n", "m0", "m1")


def rogan_gladen(p: Column, q0: Column, q1: Column) -> Column:
    return clip(F.when(F.abs(q0 + q1 - 1) < 1e-12, p).otherwise(F.try_divide(p + q0 - 1, q0 + q1 - 1)))


def bias_corrected(df: DataFrame, alpha: float = 0.05, pred: str = "correctness", actual: str = "gt_correctness", by: Sequence[str] = ()) -> DataFrame:
    """raw, corrected, ci_lo, ci_hi, level, q0, q1, n, m0, m1. The interval's width follows from the raw rate alone."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    rows = calibration(df, pred, actual, by).withColumn("corrected", rogan_gladen(F.col("raw"), F.col("q0"), F.col("q1")))
    width = z * F.sqrt(F.coalesce(F.try_divide(F.col("raw") * (1 - F.col("raw")), F.col("n")), F.lit(0.0)))
    return rows.select(*by, "raw", "corrected", clip(F.col("corrected") - width).alias("ci_lo"), clip(F.col("corrected") + width).alias("ci_hi"), F.lit(1 - alpha).alias("level"), "q0", "q1", "n", "m0", "m1")
