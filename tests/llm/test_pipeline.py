"""The pipeline's stages against brute force."""

import random
from collections import defaultdict

import corpus_pipeline
from evalloom.llm import decontaminate, jaccard_join, quality

from .test_operators import brute_components, distance, prose


def test_stages_on_planted_documents(spark, tmp_path):
    r = random.Random(2)
    common = "the of and to in a is that it for was on are as with".split()

    def text(seed, n=80):
        words = prose(n, seed).split()
        for i in range(0, n, 3):
            words[i] = r.choice(common)
        return " ".join(words).capitalize() + "."

    item = prose(20, 77)
    rows = [(i, f"{text(i)}\n{text(1000 + i)}") for i in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1].replace("the", "of", 1)), (102, "too short"), (103, f"{text(5000)} {item} {text(5001)}"), (104, f"{rows[5][1].split(chr(10))[0]}\n{text(6000)}")]
    rows += [(105, " ".join(x + "###%%%" for x in text(7000).split()))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {d: t for d, t in rows}

    def now(df):
        return {x.doc_id: x.text for x in df.collect()}

    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality rules"](spark, docs, str(tmp_path))
    left = {d: t for d, t in left.items() if d not in (102, 105)}
    assert now(docs) == left
    docs = stages["line dedup"](spark, docs, str(tmp_path)).cache()
    seen, after = [], defaultdict(list)
    for d in sorted(left):
        for x in left[d].split("\n"):
            near = len(x.encode()) >= 32
            if not any(x == y or near and abs(len(x) - len(y)) < 3 and distance(x[:400], y[:400]) <= 2 for y in seen):
                after[d].append(x)
            seen.append(x)
    left = {d: "\n".join(after[d]) for d in left}
    assert now(docs) == left
    assert docs.filter("n_chars <> length(text)").count() == 0
    docs = stages["n-gram Jaccard join"](spark, docs, str(tmp_path)).cache()
    tops = brute_components(list(left.items()), corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    left = {d: t for d, t in left.items() if tops[d][1] == d}
    assert now(docs) == left
    docs = stages["benchmark decontamination"](spark, docs, str(tmp_path)).cache()
    assert 103 in left
    left.pop(103)
    assert now(docs) == left
    out = stages["byte-level BPE"](spark, docs, str(tmp_path))
    assert {x.doc_id for x in out.filter("exact").collect()} == set(left)
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(left)
    assert quality.Limits().min_words == 20 and decontaminate.SIMILAR == 0.8 and jaccard_join.SHINGLE == 4


def test_stages_take_nulls_and_empty_tables(spark, tmp_path):
    odd = [(1, None, None, None, None), (None, None, "en", "s", 0), (None, "some words\nsome words", "en", "s", 3), (2, "", "xx", None, 0), (2, "a b", "fr", "s", 3), (3, prose(300, 1) + "\n" + prose(300, 1), "en", "s", 1)]
    for k, rows in enumerate((odd, [])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "x")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            n = out.count()
            assert n == len(rows) if name != "quality rules" else n < max(1, len(rows))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            else:
                assert out.filter("not exact").count() == 0
        assert corpus_pipeline.run(spark, folder).filter("not exact").count() == 0
