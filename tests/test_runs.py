"""Commits of sets of tables, the ledger of model calls, runs in batches and streams, grids of components."""

import datetime
import decimal
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from evalloom.operators import grid
from evalloom.operators import judging as J
from evalloom.operators import summary as S
from evalloom.plans.judge_queries import stub
from evalloom.sources import tables
from evalloom.sources.commits import Set
from evalloom.sources.ledger import Ledger


def numbers(spark, *x):
    return spark.createDataFrame([(v,) for v in x], "x long")


def values(df):
    return sorted(r[0] for r in df.collect())


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    store = Set(spark, str(tmp_path / "set"))
    assert store.versions() == [] and store.tables() == {}
    with pytest.raises(ValueError, match="no table"):
        store.read("a")
    assert store.commit({"a": numbers(spark, 1), "b": numbers(spark, 10)}) == 0
    assert store.commit({"a": numbers(spark, 2)}, {"b": numbers(spark, 20)}) == 1
    assert (values(store.read("a")), values(store.read("b"))) == ([2], [10, 20])
    assert (values(store.read("a", 0)), values(store.read("b", 0))) == ([1], [10])

    failing = numbers(spark, 1).select(F.raise_error(F.lit("killed")).cast("long").alias("x"))
    with pytest.raises(Exception, match="killed"):  # a writer that dies between its tables
        store.commit({"a": numbers(spark, 3), "b": failing})
    assert store.versions() == [0, 1] and values(store.read("a")) == [2]
    store.commit(add={"b": numbers(spark, 30)}, tag="7")
    store.commit(add={"b": numbers(spark, 31)}, tag="7")  # the batch again
    assert values(store.read("b")) == [10, 20, 31]
    assert store.vacuum(keep=1) == 4 and store.versions() == [3]
    assert (values(store.read("a")), values(store.read("b"))) == ([2], [10, 20, 31])


def test_of_two_writers_of_a_version_both_changes_count(spark, tmp_path, monkeypatch):
    store = Set(spark, str(tmp_path / "set"))
    store.commit({"a": numbers(spark, 1)})
    claim, seen = Set._claimed, []

    def late(self, version, tables):
        if not seen:  # another writer is faster
            seen.append(version)
            Set(spark, self.path).commit(add={"a": numbers(spark, 2)})
        return claim(self, version, tables)

    monkeypatch.setattr(Set, "_claimed", late)
    assert store.commit(add={"a": numbers(spark, 3)}) == 2
    assert seen == [1] and values(store.read("a")) == [1, 2, 3] and values(store.read("a", 1)) == [1, 2]


def test_values_that_json_lacks_become_strings(spark, tmp_path):
    row = (1, decimal.Decimal("1.50"), datetime.date(2024, 1, 2), {datetime.date(2024, 1, 3): [decimal.Decimal("2.00")]}, bytearray(b"ab"), (datetime.date(2024, 1, 4), 0.5))
    df = spark.createDataFrame([row], "id int, d decimal(5,2), t date, m map<date,array<decimal(5,2)>>, b binary, `s.x` struct<t: date, v: double>")
    tables.write_outputs(df, str(tmp_path), "r")
    got = tables.read_outputs(spark, str(tmp_path), "r").drop("run_id").first()
    assert tuple(got)[:5] == (1, "1.50", "2024-01-02", {"2024-01-03": ["2.00"]}, "ab") and tuple(got["s.x"]) == ("2024-01-04", 0.5)


def counting(path, fn=stub):
    """A stand-in that writes down every prompt it is asked."""

    def call(prompts, temperature, max_tokens):
        with open(path, "a") as f:
            f.writelines(json.dumps(p) + "\n" for p in prompts)
        return fn(prompts, temperature, max_tokens)

    return call


def asked(path):
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def test_a_model_is_asked_once(spark, tmp_path):
    path, told = str(tmp_path / "ledger"), str(tmp_path / "calls")
    df = spark.createDataFrame([(i, None if i == 9 else f"p{i % 4}", "x") for i in range(12)], "id int, prompt string, key string").repartition(3)
    upper = counting(told, lambda ps, t, n: [p.upper() for p in ps])
    book = Ledger(spark, path, "m", wave=2)
    for _ in range(2):
        got = {r.id: (r.answer, r.error, r.key, r.a is not None and r.a <= r.b) for r in book.call(df, upper, out="answer", times=("a", "b")).collect()}
        assert got == {i: (None if i == 9 else f"P{i % 4}", None, "x", i != 9) for i in range(12)}
        assert sorted(asked(told)) == ["p0", "p1", "p2", "p3"]  # equal prompts once, a second run not at all
    book.call(df, upper, temperature=0.7).count()
    Ledger(spark, path, "other").call(df, upper).count()
    assert len(asked(told)) == 12  # another temperature, another model


def test_a_job_that_dies_loses_one_wave(spark, tmp_path):
    path, told = str(tmp_path / "ledger"), str(tmp_path / "calls")
    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string")

    def dying(prompts, temperature, max_tokens):
        if len(asked(told)) > 8:
            raise KeyboardInterrupt
        return prompts

    book = Ledger(spark, path, "m", wave=3)
    with pytest.raises(Exception):  # noqa: B017  the worker's death, as Spark tells it
        book.call(df, counting(told, dying)).count()
    kept = values(book.entries().select("response"))
    before = len(asked(told))
    assert 0 < len(kept) < 20
    assert book.call(df, counting(told, lambda ps, t, n: ps)).filter("response = prompt").count() == 20
    again = asked(told)[before:]
    assert sorted(again + kept) == sorted(f"p{i}" for i in range(20))


def test_errors_are_told_and_asked_again(spark, tmp_path):
    path, down = str(tmp_path / "ledger"), str(tmp_path / "down")
    open(down, "w").close()
    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")

    def model(prompts, temperature, max_tokens):
        if os.path.exists(down) and "bad" in prompts:
            raise RuntimeError("down")
        return prompts

    book = Ledger(spark, path, "m")
    got = {r.prompt: (r.response, r.error) for r in book.call(df, model).collect()}
    assert got["good"] == ("good", None) and got["bad"][0] is None and "down" in got["bad"][1]
    os.remove(down)
    assert {(r.response, r.error) for r in book.call(df, model).collect()} == {("good", None), ("bad", None)}


def examples(spark, n=6):
    return spark.createDataFrame([(f"e{i}", f"question {i % 3}?", "it costs $5", ["c1"] if i else [], 1.0) for i in range(n)], tables.TASKS)


def found(spark, n=6, text="a context of $5"):
    return spark.createDataFrame([(f"e{i}", 1, "c1", text) for i in range(n)], "example_id string, rank int, chunk_id string, chunk_text string")


def generate(prompts, temperature, max_tokens):
    return ["it costs $5" for _ in prompts]


def result(df):
    mine = ["example_id", "correctness", "hallucination", "risk_direction", "risk_impact", "failure_mode", "judge_correct", "error", *S.IR]
    return sorted(map(repr, df.select(*mine).collect()))


def test_another_gate_asks_nothing_again(spark, tmp_path):
    told = str(tmp_path / "calls")
    book = Ledger(spark, str(tmp_path / "ledger"), "judge")
    rows = examples(spark).withColumns({"model_answer": F.concat("question", F.lit(" it costs $5")), "context": F.lit("a context of $5")})
    plain = {g: J.judge(rows, stub, tables.kept, gate=g).drop("judged_at").collect() for g in ("correct", "hallucination")}
    first = J.judge(rows, counting(told), tables.kept, call=book.call).drop("judged_at").collect()
    n = len(asked(told))
    assert sorted(map(repr, first)) == sorted(map(repr, plain["correct"])) and n == len(set(asked(told)))
    other = J.judge(rows, counting(told), tables.kept, gate="hallucination", call=book.call).drop("judged_at").collect()
    assert sorted(map(repr, other)) == sorted(map(repr, plain["hallucination"]))
    assert len(asked(told)) == len(set(asked(told)))


def parts(told=None):
    chunk = lambda size: lambda docs: docs.select(F.concat("document_id", F.lit(f"_{size}")).alias("chunk_id"), F.substring("text", 1, size).alias("chunk_text"))

    def first(chunks, examples):
        return examples.crossJoin(chunks).select("example_id", F.lit(1).alias("rank"), F.lit("c1").alias("chunk_id"), "chunk_text")

    count = (lambda fn, name: counting(f"{told}-{name}", fn)) if told else (lambda fn, name: fn)
    return grid.Components(
        {"short": chunk(5), "long": chunk(12)},
        {"first": first, "last": lambda c, e: first(c, e).withColumn("chunk_text", F.reverse("chunk_text"))},
        {"five": count(generate, "five"), "six": count(lambda ps, t, n: ["it costs $6, " + p[:5] for p in ps], "six")},
        {"a": count(stub, "a"), "b": count(lambda ps, t, n: stub([p + "!" for p in ps], t, n), "b")},
    )


def test_a_grid_equals_a_run_for_each_configuration(spark, tmp_path):
    told = str(tmp_path / "calls")
    docs = spark.createDataFrame([("d", "a context of $5 and more")], "document_id string, text string")
    configs = [c for c in grid.all_configs(parts()) if c["retriever"] == "first" or c["generator"] == "five"]
    configs.append({**configs[0], "config": "again"})
    rows = grid.evaluate_grid(configs, examples(spark), docs, parts(told), with_costs=True)
    rows = tables.kept(rows)
    assert rows.count() == 6 * len(configs)
    p = parts()
    for c in (configs[0], configs[5], configs[-1]):
        chunks = p.chunkers[c["chunker"]](docs)
        one = S.evaluate(examples(spark), p.retrievers[c["retriever"]](chunks, examples(spark)), p.generators[c["generator"]], p.judges[c["judge"]], tables.kept, "r", with_costs=True)
        assert result(rows.filter(F.col("config") == c["config"])) == result(one)
    generated = {c[:3] for c in (tuple(x[s] for s in grid.STEPS) for x in configs)}
    for name in ("five", "six"):  # one call for each example and beginning of a configuration
        assert len(asked(f"{told}-{name}")) == 6 * sum(g[2] == name for g in generated)
    best = [r for r in grid.compare_grid(rows).collect() if r.best]
    assert len(best) == 1 and sum(r.n for r in grid.compare_grid(rows).collect()) == 6 * len(configs)
    with pytest.raises(ValueError, match="no judge"):
        grid.evaluate_grid([{**configs[0], "judge": "none"}], examples(spark), docs, parts())
    with pytest.raises(ValueError):
        grid.evaluate_grid([configs[0], configs[0]], examples(spark), docs, parts())


def rounded(row):
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.asDict().items()}


def test_streamed_runs_are_runs(spark, tmp_path):
    """After any number of files the summary is that of their rows; a batch done twice counts once; batch and streamed runs are read together."""
    from evalloom.streaming import jobs

    root, source = str(tmp_path / "runs"), str(tmp_path / "tasks")
    tables.write_config(spark, root, "2024-01-01_0000_batch", "judge", 6, 5)
    assert tables.read_config(spark, root).first().params == {}
    S.evaluate_and_save(root, "2024-01-01_0000_batch", examples=examples(spark), retrieved=found(spark), generate_fn=generate, judge_fn=stub, keep=tables.kept)

    def evaluate(batch):
        return S.evaluate(batch, found(spark, 20), generate, stub, tables.kept, "")

    run = "2024-01-02_0000_stream"
    tables.write_config(spark, root, run, "judge", 12, 5)
    more = examples(spark, 12)
    for k, some in enumerate((more.filter("example_id in ('e0', 'e1', 'e2')"), more.filter("example_id in ('e3')"), more.filter("example_id > 'e3' or example_id in ('e10', 'e11')"))):
        some.coalesce(1).write.mode("append").json(source)
        jobs.stream_evaluate(spark, source, evaluate, root, run, str(tmp_path / "cp")).awaitTermination(180)
        outputs, metrics = tables.load_results(spark, root, run)
        assert outputs.count() == (3, 4, 12)[k] and tables.read_traces(spark, root, run).count() == (3, 4, 12)[k]
        assert [rounded(r) for r in metrics.collect()] == [rounded(r) for r in S.run_summary(outputs).collect()]
    rows = tables.kept(tables.read_outputs(spark, root, run).filter("example_id = 'e3'").drop("batch"))
    for _ in range(2):  # batch 1 again
        tables.add_batch(rows, S.traces(rows), S.summary_parts(rows), S.summary_of_parts, root, run, 1)
    assert tables.read_outputs(spark, root, run).count() == 12 and tables.read_metrics(spark, root, run).first().total_examples == 12
    assert tables.read_outputs(spark, root).count() == 18
    assert values(tables.list_runs(spark, root).select("run_id")) == ["2024-01-01_0000_batch", run]
    assert tables.load_all_runs(spark, root).count() == 2


def test_conversations_of_a_stream_in_any_order(spark, tmp_path):
    from evalloom.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(c, t, "user" if t % 2 else "assistant", f"{c}-{t}") for c in range(5) for t in range(7) if (c, t) != (4, 3)]  # one turn never comes
    random.Random(4).shuffle(rows)
    begin = datetime.datetime(2024, 1, 1)
    at = [(*r, begin + datetime.timedelta(seconds=i)) for i, r in enumerate(rows)]
    schema = "conv_id long, turn long, role string, text string, at timestamp"
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for i in range(0, len(at), 9):
        spark.createDataFrame(at[i : i + 9], schema).coalesce(1).write.mode("append").parquet(source)
    frame = spark.read.parquet(source)

    def run():
        q = jobs.stream_history(spark, source, frame.schema, out, cp, max_history=2, idle="1 hour")
        q.awaitTermination(300)
        return q

    q = run()
    want = {(r.conv_id, r.turn): [m["content"] for m in r.history] for r in S.with_history(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 2).collect()}
    got = lambda: [((r.conv_id, r.turn), [m["content"] for m in r.history]) for r in spark.read.parquet(out).collect()]
    first = got()
    assert len(first) == len(dict(first)) == len(rows) - 3 and all(want[k] == h for k, h in first)  # those behind the missing turn wait
    states = lambda q: q.lastProgress["stateOperators"][0]["numRowsTotal"]
    held = states(q)
    # much later another conversation speaks: the others end, and what waited is given out
    for day in (2, 3):
        spark.createDataFrame([(99, day - 2, "user", "x", datetime.datetime(2024, 1, day))], schema).coalesce(1).write.mode("append").parquet(source)
    q = run()
    found = {k: h for k, h in got() if k[0] != 99}
    assert found == want
    assert states(q) < held / 3
