"""How much the checks of claims do for a row, and that they still find the same."""

from pyspark.sql import functions as F

from evalloom.functions import text as X
from evalloom.operators import metaeval as V


def test_claims_are_cut_into_keywords_one_by_one(spark):
    df = spark.createDataFrame([("Copay is $5 and STEP 2 takes 3 Days, 4 PERCENT or 5%.", "The copay is $5.", "copay is\u000b $5 and  step 2 takes 3 days, 4 percent or 5%."), ("It takes 3 days.", None, "nothing else"), (None, "x", "y")], "a string, r string, c string")
    rows = V.with_truths(df, "a", "r", "c", "correct", "hallucinated")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except") <= 3  # one for each text, not for claims
    plain = df.select(V.gt_correctness(F.col("a"), F.col("r")).alias("correct"), V.gt_hallucination(F.col("a"), F.col("c")).alias("hallucinated"))
    assert [(r.correct, r.hallucinated) for r in rows.collect()] == [(r.correct, r.hallucinated) for r in plain.collect()]
    assert [r[0] for r in df.select(X.claims(F.col("a"))).collect()][0] == ["$5", "3 Days", "STEP 2", "4 PERCENT", "5%"]
    assert [r[0] for r in df.select(X.normalize(F.col("c"))).collect()][0] == "copay is $5 and step 2 takes 3 days, 4 percent or 5%."
