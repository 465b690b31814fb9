"""Formulas worked by hand, edges, and jobs with stand-in models."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import chunking as C
from evalloom.operators import irmetrics as M
from evalloom.operators import judging as J
from evalloom.operators import metaeval as V
from evalloom.operators import summary as S
from evalloom.operators import vectors as X
from evalloom.plans.judge_queries import stub
from evalloom.sources import tables


def test_chunks_cover_the_text(spark):
    rows = [(str(n), "".join(chr(97 + i % 26) for i in range(n))) for n in (0, 1, 5, 9, 10, 11, 37)]
    df = spark.createDataFrame(rows, "document_id string, text string")
    got = {}
    for r in C.chunk_fixed(df, 10, 3).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r)
    for key, text in rows:
        parts = got.get(key, [])
        joined = "".join(p.text if i == 0 else p.text[3:] for i, p in enumerate(parts))
        assert joined == text and all(text[p.start : p.end] == p.text for p in parts)
    with pytest.raises(ValueError):
        C.chunk_fixed(df, 10, 10)


def test_ndcg_worked_example(spark):
    retrieved = spark.createDataFrame([("q", 1, "c1"), ("q", 2, "c2")], "example_id string, rank int, chunk_id string")
    truth = spark.createDataFrame([("q", ["c1", "c3"]), ("e", [])], "example_id string, truth array<string>")
    got = {r.example_id: r for r in M.ir_metrics(retrieved, truth, 2).collect()}
    assert (got["q"].recall_at_k, got["q"].precision_at_k) == (0.5, 0.5)
    assert math.isclose(got["q"].ndcg_at_k, 0.613147, abs_tol=1e-6)
    assert got["e"].error == "empty ground truth" and got["e"].ndcg_at_k == 0
    with pytest.raises(ValueError):
        M.ir_metrics(retrieved, truth, 0)


def test_knn_in_blocks_equals_one_block(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(40)], "chunk_id long, embedding array<float>")
    queries = rows.filter("chunk_id < 7").withColumnRenamed("chunk_id", "example_id")
    a, b = X.knn(queries, rows, 4), X.knn(queries, rows, 4, query_bytes=32)
    assert sorted(a.collect()) == sorted(b.collect())
    native = queries.crossJoin(rows.withColumnRenamed("embedding", "e")).withColumn("d2", X.squared_distance(F.col("embedding"), F.col("e")))
    best = {}
    for r in native.collect():
        best.setdefault(r.example_id, []).append((r.d2, r.chunk_id))
    assert {(r.example_id, r.rank, r.chunk_id) for r in a.collect()} == {(q, i + 1, c) for q, x in best.items() for i, (_, c) in enumerate(sorted(x)[:4])}


def test_truth_of_a_label_is_rows(spark):
    from evalloom.plans import retrieval_queries as R

    truth = R.vectors(spark, "/root/testdata/sf0.001")[3]
    assert not any(c.startswith("array") for _, c in truth.dtypes) and truth.groupBy("label").count().filter("count > 1").count() > 0


def test_reliability_edges(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, None)], "correctness boolean, gt_correctness boolean")
    r = V.calibration(df).first()
    assert (r.m0, r.m1, r.n) == (1, 1, 3) and math.isclose(r.q0, 1 / 3) and math.isclose(r.q1, 2 / 3)
    empty = df.limit(0)
    assert V.binary_metrics(empty, "correctness", "gt_correctness").first().f1 == 0
    one = spark.range(1).select(V.rogan_gladen(F.lit(0.4), F.lit(0.5), F.lit(0.5)).alias("x"), V.rogan_gladen(F.lit(0.1), F.lit(0.7), F.lit(0.9)).alias("y")).first()
    assert one.x == 0.4 and one.y == 0


def test_prompt_values_are_not_expanded_again(spark):
    df = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert J.render_prompt(df, "x {a} y {b} {c}", {"a": "a", "b": "b"}).first().prompt == "x {b} y  {c}"
    with pytest.raises(ValueError):
        J.render_prompt(df, "x {a}", {"a": "a", "b": "b"})


def test_model_errors_stay_with_their_row(spark):
    def fn(prompts, temperature, max_tokens):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string").coalesce(1)
    got = {r.prompt: (r.response, r.error) for r in J.call_model(df, fn).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no"), None: (None, None)}


def _examples(spark):
    return spark.createDataFrame([(f"e{i}", "what?" + "x" * i, "answer", ["c1"] if i else []) for i in range(6)], "example_id string, question string, reference_answer string, ground_truth_chunk_ids array<string>")


def test_evaluate_with_stand_ins(spark):
    found = spark.createDataFrame([(f"e{i}", 1, "c1", "a context") for i in range(5)], "example_id string, rank int, chunk_id string, chunk_text string")

    def generate(prompts, temperature, max_tokens):
        return ["it costs $5" for _ in prompts]

    rows = S.evaluate(_examples(spark), found, generate, stub, tables.kept, "r", with_costs=True).cache()
    got = {r.example_id: r for r in rows.collect()}
    assert len(got) == 6 and got["e0"].failure_mode == S.ERROR and got["e5"].failure_mode == S.ERROR
    assert got["e1"].recall_at_k == 1.0 and got["e1"].error is None
    dropped = S.evaluate(_examples(spark), found, generate, stub, tables.kept, "r", on_error="drop")
    assert {r.example_id for r in dropped.collect()} == {"e1", "e2", "e3", "e4"}


def test_runs_are_written_and_read(spark, tmp_path):
    root = str(tmp_path)
    for run in ("2024-01-01_0000_a", "2024-01-02_0000_b"):
        tables.write_config(spark, root, run, "judge", 2, 5, {"a": "1"})
        tables.write_metrics(spark.createDataFrame([(1.0,)], "x double"), root, run)
        tables.write_traces(spark.createDataFrame([(1.0,)], "x double"), root, run)
    tables.write_outputs(spark.createDataFrame([(1,)], "x int"), root, "2024-01-01_0000_a")
    tables.write_outputs(spark.createDataFrame([(2,)], "x int"), root, "2024-01-01_0000_a")
    assert [r.x for r in tables.load_results(spark, root, "2024-01-01_0000_a")[0].collect()] == [2]
    assert [r.run_id for r in tables.list_runs(spark, root).collect()] == ["2024-01-01_0000_a", "2024-01-02_0000_b"]
    assert tables.load_all_runs(spark, root).count() == 1
    assert tables.new_run_id("x") == "x" and tables.new_run_id().endswith("_eval_run")


def test_tasks_round_trip(spark, tmp_path):
    path = str(tmp_path / "tasks")
    tables.write_tasks(_examples(spark), path)
    got = tables.to_examples(tables.read_tasks(spark, path))
    assert got.count() == 6 and got.filter("beir_failure_scale_factor <> 1.0").count() == 0


def _lengths(texts):
    import numpy as np

    return np.array([[len(t), t.count("a")] for t in texts], np.float32).reshape(len(texts), 2)


def test_index_is_built_and_added_to(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame([("a", "aaaa" * 10), ("b", "bb"), ("none", "")], "document_id string, text string")
    info = X.build_index(docs, _lengths, path, size=20, overlap=5).first()
    assert (info.n_vectors, info.dimension) == (4, 2)
    docstore, embeddings = X.read_index(spark, path)
    store = {r.chunk_id: r for r in docstore.collect()}
    found = {r.chunk_id: list(r.embedding) for r in embeddings.collect()}
    assert found == {c: [float(len(r.text)), float(r.text.count("a"))] for c, r in store.items()}
    more = spark.createDataFrame([("b", "bb"), ("c", "cac")], "document_id string, text string")
    for _ in range(2):
        assert X.append_index(more, _lengths, path, size=20, overlap=5).first().n_vectors == 5
    assert [x.count() for x in X.read_index(spark, path)] == [5, 5] and [x.count() for x in X.read_index(spark, path, 0)] == [4, 4]
    with pytest.raises(ValueError):
        X.build_index(docs.filter("document_id = 'none'"), _lengths, str(tmp_path / "no"))


def test_missing_chunks(spark):
    a = spark.createDataFrame([("c1", [1.0]), ("c2", [2.0]), ("c2", [2.0])], "chunk_id string, embedding array<float>")
    assert [r.chunk_id for r in X.missing_chunks(a.filter("chunk_id = 'c1'"), a).collect()] == ["c2"]


def test_corpora_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([("d", "text")], "document_id string, text string")
    tables.write_corpus(df, str(tmp_path / "corpus"))
    assert tables.read_corpus(spark, str(tmp_path / "corpus")).collect() == df.collect()


def test_questions_are_found_in_chunks(spark):
    chunks = spark.createDataFrame([("x", "so one two three four five six"), ("y", "one  two three four five"), ("z", "one two"), ("w", None)], "chunk_id string, text string")
    questions = spark.createDataFrame([(1, "ne two three four fi"), (2, "one two"), (3, "one  two three four five"), (4, "o"), (5, None), (6, "a b c d e f")], "item_id int, question string")
    want = {(c.chunk_id, q.item_id) for c in chunks.collect() for q in questions.collect() if c.text and q.question and q.question in c.text}
    assert {(r.chunk_id, r.item_id) for r in X.holding(chunks, questions).collect()} == want and len(want) > 5


def test_short_questions_are_found_by_their_rarest_run(spark):
    """Questions of any length, letters and words, without a join that compares all pairs."""
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(["so one two", "onetwo three", "éé x", "", "abcabcabcabc", "one  two", None, "a", "zzzzzzzzone two thr"])], "chunk_id int, text string")
    asked = ["o", "é", "one", "one two", "abcabcab", "zzzzzzz", "nowhere", "x", "", " ", "a", None, "two three", "one two thr", "abcab", "abcabc"]
    questions = spark.createDataFrame(list(enumerate(asked + asked[:4])), "item_id int, question string")
    pairs = X.holding(chunks, questions)
    want = sorted((c.chunk_id, q.item_id) for c in chunks.collect() for q in questions.collect() if c.text is not None and q.question is not None and q.question in c.text)
    assert sorted((r.chunk_id, r.item_id) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert X.holding(chunks, questions.filter("question = 'nothing'")).count() == 0


def test_contexts_of_all_examples(spark):
    found = spark.createDataFrame([("a", 1, "c", " t ")], "example_id string, rank int, chunk_id string, chunk_text string")
    every = spark.createDataFrame([("a",), ("b",)], "example_id string")
    got = lambda style: {r.example_id: r.context for r in X.assemble_context(found, style, every).collect()}
    assert got("labelled") == {"a": "[Chunk ID: c] t", "b": "[No retrieved context available]"} and got("space") == {"a": " t ", "b": ""}


def test_quartiles_equal_the_percentile(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS g", "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST((id * 7919) % 1013 AS DOUBLE) / 3 END AS v")
    rows = rows.unionByName(spark.createDataFrame([("one", 5.0), ("nulls", None), ("same", 2.0), ("same", 2.0)], "g string, v double"))
    want = rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"), F.avg("v").alias("m"))
    want = {r.g: [*(r.q or [None] * 5), r.m] for r in want.collect()}
    got = {r.g: [r["min"], r.q1, r.median, r.q3, r["max"], r["mean"]] for r in S.group_quartiles(rows, "g", "v").collect()}
    assert got.keys() == want.keys() == {"a", "b", None, "one", "nulls", "same"}
    assert all((x is None and y is None) or math.isclose(x, y, abs_tol=1e-9) for g in want for x, y in zip(got[g], want[g], strict=True))


@pytest.mark.parametrize("bound", [S.BOUND, 3 * S.SMALL])
def test_quartiles_of_outliers_repeats_and_infinities(spark, bound):
    """Whatever the values, a task sorts no more than the bound of a group."""
    inf = float("inf")
    one = spark.createDataFrame([("few", 1.0), ("few", 2.0), ("few", inf), ("both", -inf), ("both", inf), ("both", inf), ("none", None), ("outlier", 1e15), ("tails", inf), ("tails", -inf)], "g string, v double")
    rows = spark.range(20_000).selectExpr("'outlier' AS g", "CAST((id * 7919) % 20011 AS DOUBLE) / 7 AS v")
    rows = rows.unionByName(spark.range(20_000).selectExpr("'repeats' AS g", "CAST(CASE WHEN id < 15000 THEN 3 ELSE id END AS DOUBLE) AS v"))
    rows = rows.unionByName(spark.range(9_000).selectExpr("'tails' AS g", "CAST(id AS DOUBLE) AS v")).unionByName(one)
    want = rows.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("x"))
    got = {r.g: [r["min"], r.q1, r.median, r.q3, r["max"]] for r in S.group_quartiles(rows, "g", "v", bound).collect()}
    assert got.keys() == {"few", "both", "none", "outlier", "repeats", "tails"}
    for r in want.collect():
        for p, y in zip((0.0, 0.25, 0.5, 0.75, 1.0), got[r.g], strict=True):
            at = (len(r.x) - 1) * p
            if not r.x:
                assert y is None
                continue
            a, z = r.x[math.floor(at)], r.x[math.ceil(at)]
            assert y == a if a == z or at == int(at) else (y == z if z == inf and a > -inf else math.isnan(y) or math.isclose(y, a + (z - a) * (at % 1))), (r.g, p)


def test_brackets_shrink(spark):
    rows = spark.range(100_000).selectExpr("'g' AS g", "CAST(id * id AS DOUBLE) AS v")
    held = rows.groupBy(F.col("g").alias("h")).agg(F.count("*").alias("n"), F.count("*").alias("most"), *(f("v").alias(f"{x}{i}") for i in range(3) for f, x in ((F.min, "lo"), (F.max, "hi"))))
    for _ in range(2):
        before, held = held.first(), S._narrowed(rows, held)
        after = held.first()
        assert after.most < before.most / 15 or after.most <= 3 * S.SMALL
        for i, p in enumerate((0.25, 0.5, 0.75)):
            rank = 99_999 * p
            assert after[f"lo{i}"] <= math.floor(rank) ** 2 and math.ceil(rank) ** 2 <= after[f"hi{i}"]


def test_short_answer_lists_and_times(spark):
    def short(prompts, temperature, max_tokens):
        return [p.upper() for p in prompts][:1]

    df = spark.createDataFrame([("a",), ("b",), (None,)], "prompt string").coalesce(1)
    got = {r.prompt: r for r in J.call_model(df, short, times=("t0", "t1")).collect()}
    assert (got["a"].response, got["b"].response, got[None].response) == ("A", "B", None)
    assert got["a"].t0 <= got["a"].t1 <= got["b"].t1 and got[None].t0 is None


def test_failed_cost_calls_are_errors(spark):
    def fn(prompts, temperature, max_tokens):
        if any('"money"' in p for p in prompts):
            raise RuntimeError("down")
        return stub(prompts, temperature, max_tokens)

    rows = spark.createDataFrame([(f"e{i}", "what?", "x" * i, "y", "context") for i in range(9)], "example_id string, question string, model_answer string, reference_answer string, context string")
    got = J.judge(rows, fn, tables.kept).collect()
    assert {r.judge_error for r in got if r.correctness} == {"RuntimeError: down"} and {r.risk_impact for r in got} == {None}
    assert all(r.judge_error is None for r in got if not r.correctness) and any(r.correctness for r in got)


@pytest.mark.parametrize("gate", ["correct", "hallucination"])
def test_judged_by_the_gate(spark, gate):
    rows = spark.createDataFrame([(f"e{i}", "what?", "x" * i, "y", "context") for i in range(15)], "example_id string, question string, model_answer string, reference_answer string, context string")
    for r in J.judge(rows, stub, tables.kept, gate=gate).collect():
        assert (r.risk_direction is not None) == (r.correctness if gate == "correct" else r.hallucination) and r.judge_error is None
        assert r.judged_at is not None


def test_judging_by_keywords(spark):
    said = {"correctness": "Yes.", "hallucination": "No.", "risk_direction": "unexpected cost", "risk_impact": "severe"}
    df = spark.createDataFrame([("q", "r", "g", ["c", "d"]), ("q", "r", None, None)], "question string, reference_answer string, generated_answer string, context array<string>")
    for stage, want in (("correctness", True), ("hallucination", False), ("risk_direction", 1), ("risk_impact", 3)):
        got = J.keyword_judge(df, lambda prompts, temperature, max_tokens, stage=stage: [f"{said[stage]}" for _ in prompts], stage).collect()
        assert [r[stage] for r in got] == [want, want] and {r[f"{stage}_error"] for r in got} == {None}
        assert set(got[0].asDict()) == {*df.columns, stage, f"{stage}_error"}


def test_agents_answer_and_are_timed(spark):
    corpus = spark.createDataFrame([("c1", [0.0, 1.0]), ("c2", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    store = corpus.select("chunk_id", F.concat(F.lit("text "), "chunk_id").alias("text"), F.lit("d").alias("document_id"))
    asked = spark.createDataFrame([("one", [0.0, 1.0]), ("two", [1.0, 0.1])], "question string, embedding array<float>")
    fn = lambda prompts, temperature, max_tokens: [p[-30:] for p in prompts]
    got = S.answer_queries(asked, corpus, store, fn, k=1).collect()
    assert all(r.example_id.startswith("batch_query_") for r in got) and len({r.example_id for r in got}) == 2
    assert {r.question: r.chunk_ids for r in got} == {"one": ["c1"], "two": ["c2"]}
    examples = tables.kept(S.numbered(asked, "example_"))
    results = S.agent_results(tables.kept(S.answer_queries(examples, corpus, store, fn, k=2)), examples.drop("embedding")).collect()
    assert all(r.example_id.startswith("example_") and r.n_chunks == 2 and r.duration_seconds >= 0 and r.expected_answer == "" for r in results)
    assert S.agent_summary(S.agent_results(S.answer_queries(examples, corpus, store, fn), examples)).first().n == 2


def test_runs_are_evaluated_and_saved(spark, tmp_path):
    found = spark.createDataFrame([(f"e{i}", 1, "c1", "a context") for i in range(5)], "example_id string, rank int, chunk_id string, chunk_text string")

    def generate(prompts, temperature, max_tokens):
        return ["it costs $5" for _ in prompts]

    S.evaluate_and_save(str(tmp_path), "r1", examples=_examples(spark), retrieved=found, generate_fn=generate, judge_fn=stub, keep=tables.kept)
    outputs, metrics = tables.load_results(spark, str(tmp_path), "r1")
    assert outputs.count() == 6 and metrics.first().total_examples == 6
    traces = tables.read_traces(spark, str(tmp_path), "r1").collect()
    assert len(traces) == 6 and all(r.duration_seconds > 0 for r in traces if r.success) and sum(r.success for r in traces) == 4
    plain = S.evaluate(_examples(spark).drop("ground_truth_chunk_ids"), found, generate, stub, tables.kept, "r", with_ir=False)
    assert {r.recall_at_k for r in plain.collect()} == {None}

    def broken(prompts, temperature, max_tokens):
        raise RuntimeError("down")

    with pytest.raises(ValueError, match="all 6"):
        S.evaluate(_examples(spark), found, broken, stub, tables.kept, "r", on_error="drop")


def test_sentences_grow_in_proportion(spark):
    """A sentence is cut once, whatever the text's number of them: ten times the text takes far less than a hundred times the time."""
    import time

    def took(n):
        df = spark.range(1).select(F.lit("a").alias("document_id"), F.repeat(F.lit("some words here. "), n).alias("text"))
        start = time.time()
        assert C.chunk_sentences(df).agg(F.sum(F.length("text"))).first()[0] > 15 * n
        return time.time() - start

    took(2000)
    assert took(40_000) < 20 * max(0.5, took(4000))


def test_strip_and_sentences(spark):
    r = spark.createDataFrame([(" a\n b!  c?? ",)], "t string").select(T.strip(F.col("t")).alias("s"), T.sentences(F.col("t")).alias("p"), T.token_estimate(F.col("t")).alias("n")).first()
    assert (r.s, r.p, r.n) == ("a\n b!  c??", ["a\n b. ", "c. "], 3)
