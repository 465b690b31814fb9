"""What a model call takes to Python (the prompts alone, whatever else a row holds), and how often a judge writes the texts."""

from pyspark.sql import functions as F

from evalloom.operators import judging as J
from evalloom.operators import summary as S
from evalloom.plans.judge_queries import stub
from evalloom.sources import tables


def lengths(prompts, temperature, max_tokens):
    return [str(len(p)) for p in prompts]


def test_only_prompts_go_to_python(spark):
    df = spark.range(70).select("id", F.when(F.col("id") % 7 != 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("prompt"), F.expr("make_interval(1)").alias("own"))
    rows = J.call_model(df, lengths, times=("begun", "ended"))  # Arrow has no intervals of months, days and seconds together
    got = {r.id: r.response for r in rows.filter("error is null and (response <> '3' or begun is null)").select("id", "response").collect()}
    assert got == {i: str(i) if i % 7 else None for i in range(70) if i != 3}
    assert rows.columns == ["id", "prompt", "own", "response", "error", "begun", "ended"]


def test_several_prompts_go_to_one_process(spark):
    df = spark.range(50).select("id", *(F.when(F.col("id") % n != 0, F.repeat(F.lit("x"), (F.col("id") + n).cast("int"))).alias(f"p{n}") for n in (2, 3, 5)))
    rows = J.call_models(df, lengths, ["p2", "p3", "p5"])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    for r in rows.collect():
        assert [r[f"p{n}{J.ANSWERED}"].response for n in (2, 3, 5)] == [str(r.id + n) if r.id % n else None for n in (2, 3, 5)]


def test_judge_writes_texts_once(spark):
    texts = ["question", "model_answer", "reference_answer", "context"]
    df = spark.range(90).select(F.col("id").alias("example_id"), *(F.repeat(F.lit(f"{t} "), (F.col("id") % (i + 3)).cast("int")).alias(t) for i, t in enumerate(texts)))
    written = []

    def keep(rows):
        written.append(rows.columns)
        return tables.kept(rows)

    def one_by_one(*args, **more):
        return J.call_model(*args, **more)

    for gate in ("correct", "hallucination"):
        written.clear()
        got = J.judge(df, stub, keep, gate=gate).drop("judged_at")
        assert sum(bool({*texts} & {*columns}) for columns in written) == 1
        other = J.judge(df, stub, tables.kept, gate=gate, call=one_by_one).drop("judged_at")
        assert sorted(got.collect(), key=str) == sorted(other.select(got.columns).collect(), key=str) and got.filter("risk_impact is not null").count() > 0


def test_evaluate_writes_texts_twice(spark):
    docs = spark.range(40).select(F.col("id").alias("example_id"), F.lit("what?").alias("question"), F.lit("this").alias("reference_answer"), F.array(F.col("id").cast("string")).alias("ground_truth_chunk_ids"))
    found = docs.select("example_id", F.lit(1).alias("rank"), F.col("example_id").cast("string").alias("chunk_id"), F.repeat(F.lit("text "), F.col("example_id").cast("int")).alias("chunk_text"))
    written = []

    def keep(rows):
        written.append(rows.columns)
        return tables.kept(rows)

    rows = S.evaluate(docs, found, lengths, stub, keep, "r").collect()
    assert len(rows) == 40 and not any(r.error for r in rows)
    assert sum("context" in columns for columns in written) == 2  # with the answers, and with the first verdicts
