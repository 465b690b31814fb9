"""The training-data operators against brute force, round trips, planted cases and edges, on small tables."""

import hashlib
import heapq
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from evalloom.llm import byte_bpe, chat, common, components, decontaminate, jaccard_join, line_dedup, lm_score, pii, quality, registry, substring_dedup, url_filter

from ..oracle import check

ODD = ["", None, " \n\t ", "one", "é😀\x00 \x1c", "x" * 5000, "a b c d e f g h i j k l m n o p q"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfgklmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.SQL[name])


def test_every_operator_takes_odd_rows_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g"), (3, "k l m n o p q")], "item_id long, text string")
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(byte_bpe.RANKS))
    for rows in ([], [*enumerate(ODD), (0, ""), (6, ODD[-1]), (None, ODD[-1]), (None, None)]):
        df = docs(rows)
        assert quality.judge(df).count() == len(rows)
        assert quality.keep(df).columns == df.columns
        assert substring_dedup.removed_words(df).count() == len(rows)
        assert jaccard_join.similar_components(df).count() == len(rows)
        assert lm_score.scores(df, lm_score.train(df)).count() == len(rows)
        assert pii.pseudonymised(df).count() == len(rows)
        assert line_dedup.line_verdicts(df).count() == len(rows)
        assert line_dedup.dedup_lines(df).columns == df.columns
        for coded in (bpe.decode(bpe.encode(df)), bpe.round_trip(df)):
            assert coded.count() == len(rows) and coded.filter("decoded <> cast(coalesce(text, '') as binary)").count() == 0
        found = decontaminate.with_leaks(df, bench)
        assert found.count() == len(rows) and decontaminate.clean(df, bench).columns == df.columns
        assert {tuple(r.leaked_items) for r in found.collect()} <= {(), (3,)}


def test_texts_above_one_slice(docs, spark):
    """A text of more than SLICE_BYTES, with a repeat, personal data and a benchmark item at its end."""
    item = prose(30, 31)
    long = prose(60_000, 30)
    long = "\n".join(long[i : i + 2000] for i in range(0, len(long), 2000))
    long = "\n".join([long] * (common.SLICE_BYTES // len(long) + 1)) + f"\n{item}\nwrite to me@example.org"
    assert len(long) > common.SLICE_BYTES
    df = docs([(1, long), (2, item), (3, "short")])
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r.doc_id: r.leaked_items for r in decontaminate.with_leaks(df, bench).collect()} == {1: [7], 2: [7], 3: []}
    assert {r.doc_id: r.n_email for r in pii.pseudonymised(df).collect()} == {1: 1, 2: 0, 3: 0}
    n = len(common.WORD.findall(long))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.removed_words(df).collect()} == {1: (n, 0), 2: (30, 30), 3: (1, 0)}
    assert {r.doc_id: r.n_words for r in quality.judge(df).collect()} == {1: n, 2: 30, 3: 1}
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_components(df).collect()} == {1: 1, 2: 2, 3: 3}
    assert {r.doc_id: r.n_bytes for r in lm_score.scores(df, lm_score.train(df)).collect()} == {1: len(long), 2: len(item), 3: 5}
    lines = long.split("\n")
    assert {r.doc_id: len(r.removed) for r in line_dedup.line_verdicts(df).collect()} == {1: len(lines) - len(set(lines)), 2: 1, 3: 0}
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path(byte_bpe.RANKS))
    assert bpe.round_trip(df).filter("decoded <> cast(text as binary)").count() == 0


def test_pipeline_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")} and "pipeline" in names


# 1


def test_repeat_words_brute_force():
    r = random.Random(1)
    for _ in range(60):
        words = [r.choice("ab") for _ in range(r.randint(0, 60))]
        seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
        assert quality.n_repeat_words(quality._counted(words)[1]) == len(covered)


def test_quality_rejects_junk_and_keeps_prose(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    got = quality.judge(df).join(df.select("doc_id", "text"), "doc_id").join(labels, "doc_id", "left").select("quality", "base_failed", "kept", F.col("text").contains(" | ").alias("menu")).collect()
    share = lambda rows: sum(r.kept for r in rows) / len(rows)
    assert share([r for r in got if r.quality == 1 and not r.base_failed]) > 0.995
    assert share([r for r in got if r.quality == 0]) < 0.05
    assert share([r for r in got if r.menu]) < 0.06
    assert quality.js_distances(np.array([1, 0]), np.array([[0, 5], [3, 0]])).tolist() == [1.0, 0.0]


def test_junk_of_unknown_language_does_not_vouch_for_itself(spark):
    r = random.Random(4)
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-i, " ".join("".join(r.choice("#*$%&<>0123") for _ in range(6)) for _ in range(200)), r.choice((None, "xx"))) for i in range(1, 300)], "doc_id long, text string, lang string")
    assert quality.judge(plain.unionByName(junk)).filter("doc_id < 0 and kept").count() == 0
    assert quality.judge(junk).filter("kept").count() == 0


#: Plain prose of languages without a list, a paragraph each.
ITALIAN = (
    "La mattina presto il mercato era ancora vuoto, ma i primi venditori avevano già acceso le luci sotto i portici. Una donna anziana portava due ceste di arance "
    "e salutava tutti per nome, mentre il figlio sistemava le cassette vicino alla fontana. Più tardi arrivarono i turisti, che chiedevano il prezzo di ogni cosa e "
    "scattavano fotografie davanti alla chiesa. Nessuno aveva fretta: il sole scaldava le pietre, i bambini correvano dietro ai piccioni e il profumo del pane usciva "
    "dal forno all'angolo. Quando la campana suonò mezzogiorno, i banchi erano quasi vuoti e la piazza tornò tranquilla, come se nulla fosse successo. Soltanto un cane "
    "dormiva all'ombra, accanto a una cassetta dimenticata, e il vecchio barista raccontava ancora una volta la storia del terremoto a chi voleva ascoltarla."
)
RUSSIAN = (
    "Ранним утром рынок был ещё пуст, но первые торговцы уже зажгли огни под навесами. Пожилая женщина несла две корзины с яблоками и здоровалась со всеми по имени, "
    "а её сын расставлял ящики возле старого колодца. Позже пришли покупатели, которые спрашивали цену каждой вещи и долго выбирали. Никто не спешил: солнце грело камни, "
    "дети бегали за голубями, и запах свежего хлеба шёл из пекарни на углу. Когда колокол пробил полдень, прилавки почти опустели, и площадь снова стала тихой."
)


def test_prose_of_unlisted_languages_is_kept(spark):
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    digits = " ".join(str(x * x + 10_000) for x in range(200))
    more = spark.createDataFrame([(-1, ITALIAN, "it"), (-2, ITALIAN, None), (-3, RUSSIAN, "ru"), (-4, digits, "it"), (-5, ITALIAN, "en")], "doc_id long, text string, lang string")
    both = plain.unionByName(more)
    got = {r.doc_id: r for r in quality.judge(both).filter("doc_id < 0").collect()}
    assert {k: r.kept for k, r in got.items()} == {-1: True, -2: True, -3: True, -4: False, -5: False}
    assert got[-1].n_words >= 100 and got[-1].common_distance is None and got[-5].common_distance > quality.Limits().max_common_distance
    assert {r.doc_id for r in quality.keep(both).filter("doc_id < 0").collect()} == {-1, -2, -3}
    references = quality.fit_references(plain)
    assert quality.judge(more.drop("lang"), references).filter("kept").count() == 4  # labels are null
    # the SQL, over a table that holds such texts
    con = duckdb.connect()
    con.register("documents", both.toPandas())
    want = con.execute(quality.SQL["op1_quality_rules"]).df().set_index("doc_id")
    for k, r in got.items():
        assert bool(want.kept[k]) == r.kept and abs(want.class_distance[k] - r.class_distance) < 1e-5


# 2


def brute_substrings(rows, window):
    first = {}
    words = {d: common.WORD.findall(t or "") for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {i + j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(window)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window", [5, 13, 52])
def test_substring_dedup_brute_force(docs, window):
    r = random.Random(window)
    shared = [prose(60, i) for i in range(3)]
    rows = [(i, " ".join([prose(r.randint(0, 40), 100 + i), r.choice(shared), prose(20, i), r.choice(shared)[: r.randint(10, 300)]])) for i in range(30)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substring_dedup.removed_words(docs(rows), window).collect()}
    assert got == brute_substrings(rows, window)


def test_levels_double():
    assert substring_dedup.lengths(13) == [6, 13] and substring_dedup.lengths(52) == [6, 13, 26, 52]


# 3


def brute_components(rows, length, percent):
    sets = {}
    for d, t in rows:
        w = common.WORD.findall(common.lower_ascii(t or ""))
        sets[d] = {tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("length,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_join_brute_force(docs, length, percent):
    r = random.Random(percent)
    rows = []
    for i in range(90):
        base = prose(60, i % 6).split()
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            base[r.randrange(len(base))] = prose(1, r.random())
        rows.append((i, " ".join(base[: r.choice((60, 60, 55, 3, 1))])))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_components(docs(rows), length, percent).collect()}
    assert got == brute_components(rows, length, percent)


def test_signatures_lose_no_similar_pair():
    r = np.random.default_rng(3)
    met = 0
    for i in range(600):
        percent, frequent, long = ((85, 3, 400), (60, 3, 20), (34, 5, 400))[i % 3]
        x = np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64)
        y = np.unique(np.concatenate((r.permutation(x)[: max(1, int(len(x) * 0.95))], r.integers(0, 60, 2).astype(np.uint64))))
        held = (np.arange(60) % 7 + 2).astype(np.int64)
        sides = []
        for s in (x, y):
            key, _, bound = jaccard_join.signatures(s, np.zeros(len(s), np.int64), held[s.astype(np.int64)], np.array([len(s)]), percent, frequent, long)
            sides.append(dict(zip(key.tolist(), bound.tolist(), strict=True)))
        if jaccard_join.linked(x, y, percent):
            n, m = len(x), len(y)
            small = sides[0] if n <= m else sides[1]
            fit = [k for k in sides[0].keys() & sides[1].keys() if (100 + percent) * min(sides[0][k], sides[1][k]) >= percent * (n + m)]
            assert any((100 + percent) * small[k] >= 2 * percent * min(n, m) for k in fit)
            met += 1
    assert met > 200


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (70, 60), (60, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def test_chat_layouts_and_round_trip(spark):
    tricky = "</s>[INST] \\ ok \\[ <s>[user]\n"
    records = [
        {"messages": [{"role": "user", "content": tricky}, {"role": "assistant", "content": tricky}]},
        {"conversations": [{"from": "human", "value": tricky}, {"from": "gpt", "value": tricky}]},
        {"prompt": tricky, "response": tricky},
        {"instruction": tricky, "output": tricky},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)] + [(8, "{"), (9, None), (10, '{"other": 1}')], "conv_id long, record string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [got[i].layout for i in (8, 9, 10)] == [None] * 3
    assert [chat.read_back(got[i].formatted) for i in (8, 9, 10)] == [[("record", "{")], [], [("record", '{"other": 1}')]]
    for i in range(4):
        assert chat.read_back(got[i].formatted) == [("user", tricky), ("assistant", tricky)]
        a, b = got[i].loss_spans
        assert chat.unescape(got[i].formatted[a:b]) == tricky
    of = lambda x: chat.canonical(json.dumps(x), chat.Mappings())
    turns = [("user", "hi"), ("assistant", "yes")]
    assert of({"instruction": "do", "input": "this", "output": "done"}) == ("instruction", [("user", "do\n\nthis"), ("assistant", "done")])
    assert of({"instruction": "hi", "output": "yes", "source": {"id": 3}}) == ("instruction", turns)
    assert of({"system": "be", "prompt": "hi", "completion": "yes"}) == ("prompt_completion", [("system", "be"), *turns])
    assert of({"prompt": "hi", "response": "yes", "score": 0.5}) == ("prompt", turns)
    assert of({"id": 1, "messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "model", "content": "yes"}]}) == ("messages", turns)
    assert of({"prompt": "", "messages": [{"role": "user", "content": "hi"}, {"role": "gpt", "content": "yes"}]}) == ("messages", turns)
    assert of({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes", "weight": 1}]}) == ("from_value", turns)
    assert of({"turns": [{"role": "human", "text": "hi"}, {"role": None, "text": None}]}) == ("turns", [("human", "hi"), ("", "")])
    assert of({"messages": []}) == ("messages", []) and of([1]) == (None, [("record", "[1]")])
    assert of({"messages": [{"role": "user", "content": [{"text": "a"}]}]}) == ("messages", [("user", '[{"text": "a"}]')])


def test_chat_mappings_lose_no_text():
    of = lambda x: chat.canonical(json.dumps(x), chat.Mappings())
    turns = [("user", "hi"), ("assistant", "yes")]
    talk = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes"}]
    assert of({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yes"}], "system": "be nice"}) == ("from_value", [("system", "be nice"), *turns])
    assert of({"messages": talk, "system": "be nice"}) == ("messages", [("system", "be nice"), *turns])
    assert of({"history": [["a", "b"], {"role": "human", "content": "c"}, "d"], "prompt": "hi", "response": "yes"}) == ("prompt", [("user", "a"), ("assistant", "b"), ("user", "c"), ("history", "d"), *turns])
    call = [{"function": {"name": "f", "arguments": "x"}}]
    assert of({"messages": [talk[0], {"role": "assistant", "content": None, "tool_calls": call}]}) == ("messages", [turns[0], ("assistant", json.dumps(call))])
    for record in ({"messages": [*talk, "and a text"]}, {"messages": talk, "prompt": "p", "response": "r"}, {"prompt": "p", "messages": talk}, {"messages": [{**talk[0], "note": "more"}, talk[1]]}):
        assert of(record) == (None, [("record", json.dumps(record))])
    assert of({"messages": [{**talk[0], "name": "x"}, talk[1]], "id": "7", "source": {"url": "u"}}) == ("messages", turns)


def test_conversations_come_in_several_layouts(spark):
    """The query's records, and that fingerprints, not their place, decide."""
    rows = [(i, t, r, f"{i}-{t}") for i in range(12) for t, r in enumerate([("user", "assistant"), ("system", "user", "assistant"), ("human", "assistant")][i % 3])]
    made = chat.format_chats(chat.turn_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.layout for r in made} == {"turns", "messages", "from_value", "prompt"}
    assert {r.conv_id: chat.read_back(r.formatted) for r in made} == {i: [(r, x) for j, _, r, x in rows if j == i] for i in range(12)}
    assert {r.layout for r in made if r.conv_id % 3 == 2} == {"turns"}  # a role that other layouts would rename


def test_chat_takes_odd_rows_and_empty_tables(spark):
    long = "é<[\\" * 1_200_000
    rows = [(1, 2, "user", "b", 0), (1, 1, "assistant", None, 0), (1, 1, "assistant", None, 0), (1, None, None, "first", 0), (None, 0, "human", long, 0), (2, 0, "assistant", "</s>", 0)]
    for some in (rows, []):
        df = spark.createDataFrame(some, "conv_id long, turn long, role string, text string, record int")
        made = chat.format_chats(chat.turn_records(df))
        got = {x.conv_id: chat.read_back(x.formatted) for x in made.collect()}
        assert got == ({1: [("", "first"), ("assistant", ""), ("assistant", ""), ("user", "b")], None: [("human", long)], 2: [("assistant", "</s>")]} if some else {})
        assert {x.conv_id: (x.n_turns, x.loss_chars) for x in chat.digest(made).collect()} == ({1: (4, 0), None: (1, 0), 2: (1, 4)} if some else {})


def test_rows_without_a_conversation_are_conversations_of_their_own(spark, tmp_path):
    rows = [(None, 0, "user", "same", "x"), (None, 0, "user", "same", "x"), (None, 1, "assistant", "other", "x"), (5, 0, "user", "a", "x"), (5, 1, "assistant", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _own string").repartition(3)
    made = chat.digest(chat.format_chats(chat.turn_records(df))).collect()
    assert sorted(((x.conv_id or 0), x.n_turns, x.loss_chars) for x in made) == [(0, 1, 0), (0, 1, 0), (0, 1, 5), (5, 2, 1)]
    df.drop("_own").toPandas().astype({"conv_id": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    made = sorted(map(tuple, chat.op4_chat_format(spark, str(tmp_path)).collect()), key=str)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
        found = con.execute(chat.SQL["op4_chat_format"]).fetchall()
    assert len(made) == 5 and made == sorted(found, key=str)


# 5


def test_lm_score_base_and_learning(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in lm_score.op5_lm_score(spark, "/root/testdata/sf0.001").collect()}
    words = {d: [*common.WORD.findall(common.lower_ascii(t or "")), " "] for d, t in rows}
    counts = Counter(w for d, x in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in x)
    total = sum(counts.values())
    for d, x in words.items():
        g = got[d]
        assert (g.n_tokens, g.n_known, g.train_tokens, g.held_out) == (len(x), sum(w in counts for w in x), total, zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(g.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in x), rel_tol=1e-9)
    held = [g for g in got.values() if g.held_out]
    none = np.zeros((256, 256), np.int64)
    untaught = lm_score.Model(lm_score.prefix_codes(none), tuple(np.zeros(1 << b, np.int8) for b in (16, *lm_score.TABLE_BITS)), lm_score.TABLE_BITS)
    untrained = lm_score.scores(df, untaught).filter("held_out").agg(F.sum("bits")).first()[0]
    assert -sum(g.score for g in held) / math.log10(2) < 0.7 * untrained


FULL = (1 << 64) - 1


def scalar_mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & FULL
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & FULL
    return x ^ x >> 33


def scalar_word_hash(word):
    part = [int.from_bytes(word[i : i + 8], "little") for i in range(0, len(word), 8)]
    h = scalar_mix(part[0] ^ len(word) * 0x9E3779B97F4A7C15 & FULL)
    for x in part[1:]:
        h = scalar_mix(h * 0x9E3779B97F4A7C15 + x & FULL)
    return h


def scalar_code(pairs, before):
    """byte -> the nodes and bits of its path, of a Huffman tree."""
    anywhere = pairs.sum(axis=0) / max(1, pairs.sum())
    heap = [(float(w), b, {b: []}) for b, w in enumerate(pairs[before] + 0.05 * anywhere + 1e-9)]
    heapq.heapify(heap)
    for node in range(255):
        v, _, left = heapq.heappop(heap)
        w, _, right = heapq.heappop(heap)
        paths = {b: [(256 * before + node, bit), *p] for bit, side in ((0, left), (1, right)) for b, p in side.items()}
        heapq.heappush(heap, (v + w, 256 + node, paths))
    return heap[0][2]


def scalar_bits(rows, anchor=lm_score.ANCHOR):
    """Bits of each text by the definition, one decision after the other; of the module it takes constants alone."""
    full = (1 << 32) - 1
    learned = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    pairs = np.zeros((256, 256), np.int64)
    for t in learned:
        for x, y in zip([0, *t.encode()], [*t.encode(), 255], strict=True):
            pairs[x, y] += 1
    codes = {}

    def slots(data):
        """byte, depth, bit and slots of each decision."""
        for i, byte in enumerate(data):
            one, two, three = (data[i - k] if i >= k else 0 for k in (1, 2, 3))
            word = next(j for j in range(i, -1, -1) if j == 0 or data[j - 1] <= 32)
            spelled = sum((x + 7) * pow(0x4F6CDD1D, k + 1, 1 << 32) for k, x in enumerate(data[word:i]))
            out = []
            for c in ((one | two << 8 | three << 16) + (1 << 24), spelled * 0x85EBCA6B):
                c = c * 0xC2B2AE35 & full
                out.append(c ^ c >> 15)
            if one not in codes:
                codes[one] = scalar_code(pairs, one)
            for depth, (node, y) in enumerate(codes[one][byte]):
                yield i, depth, y, [node] + [((c ^ node * 0x9E3779B1 & full) * 0x27D4EB2F & full) >> (32 - b) for c, b in zip(out, lm_score.TABLE_BITS, strict=True)]

    def segments(text):
        """context, start, end, the segment (with whether it is the last), from what a decoder has seen at its start."""
        data = text.encode()
        words = [(m.start(), m.end(), scalar_word_hash(m.group().lower())) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        starts = [(e + 1, (g, h)) for (_, _, g), (_, e, h) in zip(words, words[1:], strict=False) if e < len(data) and scalar_mix(g * 3 + h & FULL) % anchor == 0]
        for k, (start, context) in enumerate(starts):
            end = starts[k + 1][0] if k + 1 < len(starts) else len(data)
            yield context, start, end, (data[start:end], k + 1 == len(starts))

    counts, follow = defaultdict(lambda: [0, 0]), defaultdict(Counter)
    for t in learned:
        for _, _, y, s in slots([*t.encode(), 255]):
            for k in enumerate(s):
                counts[k][y] += 1
        for c, _, _, x in segments(t):
            follow[c][x] += 1
    odds = {k: float(np.clip(np.round(8 * np.log((b + 0.4) / (a + 0.4))), -127, 127)) / 8 for k, (a, b) in counts.items()}
    out = {}

    def walk(stream, gates, begin, rate, step):
        weights, cost, at = [list(begin) for _ in range(gates)], 0.0, None
        for r, g, y, inputs in stream:
            if r // step != at:
                at, now = r // step, [list(w) for w in weights]
            z = sum(w * x for w, x in zip(now[g], [*inputs, 1.0], strict=True))
            cost += math.log1p(math.exp(-abs(z))) + max(z, 0) - y * z
            error = y - 1 / (1 + math.exp(-z))
            for i, x in enumerate([*inputs, 1.0]):
                weights[g][i] += rate * error * x
        return cost, weights

    for d, t in rows:
        flags, skip = [], set()
        for c, start, end, x in segments(t):
            most = max(follow[c].values(), default=0)
            best = min((y for y, n in follow[c].items() if n == most), key=lambda y: xxhash.xxh3_64_intdigest(y[0], y[1]), default=None)
            if most > 1:
                flags.append((len(flags), 0, float(best == x), [math.log((most + 0.4) / (sum(follow[c].values()) - most + 0.4))]))
                skip |= set(range(start, end)) if best == x else set()
        left = {i: k for k, i in enumerate(i for i in range(len(t.encode()) + 1) if i not in skip)}
        stream = [(left[i], min(g, lm_score.GATES - 1), float(y), [odds.get(k, 0.0) for k in enumerate(s)]) for i, g, y, s in slots([*t.encode(), 255]) if i in left]
        cost, weights = walk(stream, lm_score.GATES, lm_score.BEGIN, lm_score.RATE, lm_score.STEP)
        out[d] = (cost + walk(flags, 1, lm_score.SEGMENT_BEGIN, lm_score.SEGMENT_RATE, lm_score.SEGMENT_STEP)[0]) / math.log(2), weights, len(flags)
    return out


@pytest.mark.parametrize("learned", [["ab11 cd tail"] * 40 + ["ab11 cdx"] * 40, ["a b a", "a b b", "a b  a b", "b a b", "a a a a", "ab a "] * 9])
def test_lm_probabilities_of_all_texts_add_up_to_one_at_most(docs, learned):
    """All texts of three letters up to a length, and two whose difference is where a word ends; every pair of words begins a segment."""
    texts = ["ab11 cd tail", "ab11 cdx", *("".join(t) for n in range(8) for t in itertools.product("ab ", repeat=n))]
    ids = (i for i in itertools.count() if zlib.crc32(str(i).encode()) % 7 == 2)
    train = (i for i in itertools.count() if zlib.crc32(str(i).encode()) % 7 != 2)
    df = docs([(next(train), t) for t in learned] + [(next(ids), t) for t in texts])
    found = [r.bits for r in lm_score.scores(df, lm_score.train(df), anchor=1).filter("held_out").collect()]
    assert len(found) == len(texts)
    total = sum(2.0**-b for b in found)
    assert 0.5 < total <= 1 + 1e-6


def test_lm_score_brute_force(docs):
    r = random.Random(6)
    base = [prose(120, i) for i in range(8)]
    rows = [(i, " ".join(r.choice(base).split()[: r.choice((5, 60, 120))]) if i % 3 else prose(r.randint(0, 50), i + 99)) for i in range(40)] + [(50, ""), (51, "É\n b")]
    want = scalar_bits(rows)
    df = docs(rows)
    got = {x.doc_id: x.bits for x in lm_score.scores(df, lm_score.train(df)).collect()}
    assert all(math.isclose(got[d], want[d][0], rel_tol=1e-4, abs_tol=1e-3) for d, _ in rows)
    assert sum(n > 0 for _, _, n in want.values()) > 5
    for d, t in rows:
        if 100 <= len(t) <= 400 and not want[d][2]:  # weights move within a short text
            assert max(abs(w - b) for g in want[d][1] for w, b in zip(g, lm_score.BEGIN, strict=True)) > 0.02


def test_lm_weights_refined_online_beat_fixed_ones(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = lm_score.train(common.doc_columns(rows))
    held = [lm_score._bytes(t) for d, t in rows.collect() if lm_score.held_out(d)]
    online = lm_score.mixed_bits(held, model).sum()
    monkeypatch.setattr(lm_score, "RATE", 0.0)
    assert online < 0.99 * lm_score.mixed_bits(held, model).sum()


def test_lm_code_is_a_probability():
    pairs = np.random.default_rng(2).integers(0, 50, (256, 256)) ** 3
    pairs[7] = 0
    place, length, node, bit, gate = lm_score.prefix_codes(pairs)
    for before in (0, 7, 255):
        own = slice(256 * before, 256 * before + 256)
        assert math.isclose(sum(2.0 ** -int(n) for n in length[own]), 1.0)
        assert len({tuple(zip(node[p : p + n].tolist(), bit[p : p + n].tolist(), strict=True)) for p, n in zip(place[own], length[own], strict=True)}) == 256
        assert {int(x) >> 8 for x in node[place[256 * before] : place[256 * before] + 3]} == {before}


# 6


def test_feistel_is_a_permutation():
    for size in (2, 7, 100, 997):
        image = [pii.feistel(x, size, b"k", "t") for x in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.feistel(x, size, b"k", "t", back=True) for x in image] == list(range(size))
        assert size < 100 or image != [pii.feistel(x, size, b"other", "t") for x in range(size)]


def test_addresses_of_any_length_end_and_come_back():
    for n in range(1, 65):
        for local in ("a" * n, "9" * n, ("aZ3." * 16)[: n - 1] + "x"):
            new = pii.pseudonymise(f"{local}@example.org", b"key")[0].split("@")[0]
            kinds = lambda x: ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else c for c in x]
            assert kinds(new) == kinds(local)
            size = 26 ** sum(c.isalpha() for c in local) * 10 ** sum(c.isdigit() for c in local)
            assert pii.feistel(_mixed(new.lower()), size, b"key", "email", back=True) == _mixed(local.lower())
    assert pii.pseudonymise("Bob.Lee@x.com", b"k")[0].lower() == pii.pseudonymise("bob.lee@x.com", b"k")[0]


def _mixed(text):
    """The letters and digits of a lower-case text as one number."""
    x = 0
    for c in text:
        if c.isascii() and c.isalpha():
            x = x * 26 + ord(c) - 97
        elif c.isdigit():
            x = x * 10 + int(c)
    return x


def test_only_validated_numbers_change():
    for x in ("order 1234567890123 of 20240101000000", "4111111111111112", "GB82 WEST 1234 5698 7654 33", "2023-02-29", "256.1.1.1"):
        assert pii.pseudonymise(x, b"key")[0] == x
    for x in ("2125550100", "9998887777", "1234567890", "5551234567"):
        new = pii._nanp(x, b"key")
        assert (new[0] > "1" and new[3] > "1") == (x[0] > "1" and x[3] > "1")
    assert len({pii._nanp(f"21255501{i:02d}", b"key") for i in range(100)}) == 100


def test_pseudonyms_brute_force(spark):
    """Values found by simple means in the given texts, one kind after the other, and their images taken back."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text rlike '[0-9@]'").select("doc_id", "text")
    got = {x.doc_id: x for x in pii.pseudonymised(rows).collect()}
    seen = Counter()
    for d, t in rows.collect():
        g, digits = got[d], lambda x: "".join(filter(str.isdigit, x))
        olds, news = t.split(), g.text.split()
        assert len(olds) == len(news)
        for old, new in zip(olds, news, strict=True):
            a, b = old.strip(".,;:()"), new.strip(".,;:()")
            if "@" in a:
                assert a.split("@")[1] == b.split("@")[1] and pii.feistel(_mixed(b.split("@")[0].lower()), 26 ** sum(map(str.isalpha, a.split("@")[0])) * 10 ** len(digits(a.split("@")[0])), pii.QUERY_KEY, "email", back=True) == _mixed(a.split("@")[0].lower())
                seen["email"] += 1
            elif a.count(".") == 3 and all(x.isdigit() and int(x) < 256 for x in a.split(".")):
                number = lambda x: int.from_bytes(bytes(map(int, x.split("."))), "big")
                assert pii.feistel(number(b), 2**32, pii.QUERY_KEY, "ip", back=True) == number(a)
                seen["ip"] += 1
        if not g.n_secret + g.n_ip + g.n_date:  # the images of the others have as many characters, of the same kinds
            assert all(x == y or x.isdigit() == y.isdigit() and x.isalpha() == y.isalpha() for x, y in zip(t, g.text, strict=True))
        assert (g.n_found > 0) == (t != g.text)
    assert seen["email"] > 20


def test_pseudonyms_keep_formats_and_links():
    card = "411111111111111" + pii.luhn_digit("411111111111111")
    text = f"mail ab.12@mail.example.com, card {card}, 4111-1111-1111-1111, +1 (212) 555-0100, ip 10.0.0.255, on 2024-02-29 or 31/12/1999, GB82 WEST 1234 5698 7654 32, no 2024-02-30, 300.1.1.1, v 1.2"
    new, found = pii.pseudonymise(text, b"key")
    assert found == {"email": 1, "card": 2, "iban": 1, "phone": 1, "ip": 1, "date": 2, "secret": 0}
    assert all(x not in new for x in ("ab.12@", card, "555-0100", "10.0.0.255", "2024-02-29", "31/12/1999", "5698")) and "2024-02-30" in new and "300.1.1.1" in new and "v 1.2" in new
    assert pii.pseudonymise(text, b"key")[0] == new != pii.pseudonymise(text, b"other")[0]
    again, counted = pii.pseudonymise(new, b"key")
    assert counted == found
    plain = pii.pseudonymise(f"x {card} y", b"key")[0].split()[1]
    assert pii.luhn_digit(plain[:-1]) == plain[-1] and plain in new.replace("-", "")


def test_telephone_numbers_and_dates_of_all_forms():
    phones = ["(555) 123-4567", "555-123-4567", "555.123.4567", "1-555-123-4567", "+33 1 23 45 67 89", "0033 1 23 45 67 89", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+49 30 12345678", "+34 612 345 678", "01 23 45 67 89", "01.23.45.67.89", "030/12345678", "(030) 12345678", "612 34 56 78", "+1-555-123-4567"]
    dates = ["12/25/1990", "1/5/1990", "12/5/1990", "5.3.2020", "2024-2-9", "12-25-1990"]
    for kind, values in (("phone", phones), ("date", dates)):
        for x in values:
            new, found = pii.pseudonymise(f"call {x} 2 times, or {x}.", b"key")
            assert (found[kind], sum(found.values())) == (2, 2) and x not in new, (x, new)
            assert pii.pseudonymise(new, b"key")[1] == found, (x, new)
            assert new.count(" 2 times") == 1
    shown = lambda x: "".join(c for c in pii.pseudonymise(x, b"key")[0] if c.isdigit())
    assert shown("(555) 123-4567") == shown("555.123.4567") == shown("+1 555 123 4567")[1:]
    assert shown("+33 1 23 45 67 89")[2:] == shown("01 23 45 67 89")[1:]
    late = {pii.pseudonymise(f"{m}/{d}/1990", b"key")[0] for m in range(1, 13) for d in range(13, 29)}
    assert len(late) == 12 * 16 and all(int(x.split("/")[1]) > 12 for x in late)
    for x in ("+33 1 23 45 67 8", "+1 555 123 456", "13/13/1990", "25.13.1990", "5551234567", "0.5 and 1000000", "pages 100-200"):
        assert pii.pseudonymise(x, b"key")[0] == x


# 7


def test_cascade_is_exact(spark):
    keys = [f"host{i}.example.org" for i in range(3000)]
    listed = set(keys[::7])
    df = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    for most in (url_filter.MOST_BITS, 2000):
        assert (url_filter.part_count(df, most) > 1) == (most == 2000)
        got = {r.key for r in url_filter.with_listed(df.select("key"), df, "key", most_bits=most).filter("is_listed").collect()}
        assert got == listed
    assert url_filter.build_cascade(df.filter("not listed")) == []


def test_urls_against_a_list(spark):
    urls = [(1, "http://A.net/x"), (2, None), (3, "no scheme"), (4, "https://b.net?q"), (4, "https://b.net?q"), (5, "http://sub.example.org/es/x"), (6, "http://example.org/en/1"), (7, "http://x.com/de/"), (None, "ftp://a.net#f"), (8, "http://")]
    want = {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "block", None: "block", 8: "allow"}
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in urls], "page_id long, url string, host string, key int")
    listed = spark.createDataFrame([("a.net",), ("a.net",), (None,), ("unseen.net",), ("",), ("sub.example.org",)], "host string")
    got = url_filter.judge_urls(pages, listed).collect()
    assert len(got) == len(urls) and {r.page_id: r.verdict for r in got} == want
    assert {r.page_id: r.rule for r in got}[5] == "example.org/es/"
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.filter("page_id in (1, 4)"), listed.limit(0)).collect()} == {"allow"}


# 8


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(text, n, r):
    out = list(text)
    for _ in range(n if out else 0):
        i = r.randrange(len(out) or 1)
        out[i : i + r.choice((0, 1))] = r.choice(("", "é", "x"))
    return "".join(out)


def test_bit_parallel_distance(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("ab") for _ in range(r.randint(0, 14)))
        pairs.append((a, edited(a, r.randint(0, 4), r) if a else "x" * r.randint(0, 4)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.col("a").cast("binary").alias("x"), F.col("b").cast("binary").alias("y"))
    for edits in (1, 2, 3):
        for x in df.withColumn("w", line_dedup.within_edits(F.col("x"), F.col("y"), edits)).withColumn("s", F.when(F.col("a") != F.col("b"), line_dedup.similar(F.col("x"), F.col("y"), edits))).collect():
            want = distance(x.a.encode(), x.b.encode()) <= edits
            assert x.w == want and x.s in (None, want)


def test_line_dedup_brute_force(docs):
    r = random.Random(8)
    base = [prose(9, i) for i in range(8)] + ["short", "short line", "a line of sixteen", "a line of some 30 bytes, no more", "a line of 26 bytes, no more", "é", "", " \t"]
    rows = [(i, "\n".join(edited(r.choice(base), r.choice((0, 0, 1, 2, 3, 4)), r) for _ in range(r.randint(1, 8)))) for i in range(40)]
    lines = [(d, n, x.encode()) for d, t in rows for n, x in enumerate(t.split("\n"))]
    want = defaultdict(list)
    for i, (d, n, x) in enumerate(lines):
        near = lambda y: abs(len(x) - len(y)) <= 2 and distance(x, y) <= min(2, len(x) // 16, len(y) // 16)  # noqa: B023, E731
        if x.strip(b" \t\n\x0b\x0c\r") and any(x == y or near(y) for _, _, y in lines[:i]):
            want[d].append(n)
    first = {x: i for i, (_, _, x) in reversed([*enumerate(lines)])}
    assert {min(2, len(x) // 16) for i, (d, n, x) in enumerate(lines) if n in want[d] and first[x] == i} == {1, 2}  # near ones of both budgets
    df = docs(rows)
    assert {x.doc_id: x.removed for x in line_dedup.line_verdicts(df).collect()} == {d: want[d] for d, _ in rows}
    kept = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[d]) for d, t in rows}
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == kept


# 9


def test_byte_bpe_equals_tiktoken(spark):
    ranks = dict(sorted(byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS)).items(), key=lambda x: x[1]))
    coder = byte_bpe.Coder(byte_bpe.model_proto(ranks), np.array([*ranks.values()], np.int32), public_tokenizers.PATTERN, [*ranks])
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(9)
    texts = [x or "" for x in ODD] + ["".join(chr(r.choice((r.randrange(32, 127), r.randrange(32, 0x250), r.randrange(0x400, 0x450), 32, 10))) for _ in range(200)) for _ in range(60)]
    ours = coder.encode(texts).to_pylist()
    assert ours == [theirs.encode_ordinary(t) for t in texts]
    coder.held = byte_bpe.MEMO_BYTES + 1  # begins anew
    assert coder.encode(texts[:9]).to_pylist() == ours[:9] and coder.held < byte_bpe.MEMO_BYTES
    assert [x.as_py() for x in coder.decode(pa.array(ours, pa.list_(pa.int32())))] == [t.encode() for t in texts]
    got = byte_bpe.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    text = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for x in got:
        ids = theirs.encode_ordinary(text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(text[x.doc_id].encode()))


# 10


def test_decontamination_brute_force(spark, docs):
    r = random.Random(10)
    items = [(i, prose(r.randint(6, 40), 1000 + i)) for i in range(12)] + [(50, "solo word"), (51, "")]
    rows = []
    for i in range(60):
        words = items[r.randrange(12)][1].split()
        for _ in range(r.choice((0, 0, 1, 3))):
            words[r.randrange(len(words))] = prose(1, r.random())
        rows.append((i, " ".join([prose(30, i), " ".join(words) if i % 2 else "", prose(30, -i)]).upper() + (" solo word" if i == 7 else "")))
    index = decontaminate.Items(items)
    want = {}
    for d, t in rows:
        s = decontaminate.shingles(t).tolist()
        hit = {50} if d == 7 else set()
        for k, i in enumerate(index.ids):
            m = min(index.size[k], len(s))
            if i != 50 and any(index.similarity(Counter(s[a : a + m]), k) >= 0.8 for a in range(len(s) - m + 1)):
                hit.add(i)
        want[d] = sorted(hit)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (decontaminate.PART_CHARS, 400):
        got = {x.doc_id: x.leaked_items for x in decontaminate.with_leaks(docs(rows), bench, part_chars=chars).collect()}
        assert got == want and sum(map(len, want.values())) > 10


def test_leaks_do_not_depend_on_the_parts(spark, docs):
    r = random.Random(12)
    shared = [prose(12, 2000 + i) for i in range(3)]
    items = [(i, " ".join([prose(r.randint(8, 16), 3000 + i), r.choice(shared), prose(6, 4000 + i)])) for i in range(40)]
    rows = []
    for i in range(80):
        words = items[i % 40][1].split()
        for _ in range(r.choice((0, 1, 1, 2))):
            words[r.randrange(len(words))] = prose(1, r.random())
        if i % 3 == 0:  # a shingle run of other items in place of the item's own end
            words[-6:] = r.choice(shared).split()[:6]
        rows.append((i, " ".join([prose(20, i), *words, prose(20, -i)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **more: {x.doc_id: (x.leaked_items, x.leak_similarity and round(x.leak_similarity, 9)) for x in decontaminate.with_leaks(docs(rows), bench, **more).collect()}
    whole = found()
    assert 10 < sum(len(x) > 0 for x, _ in whole.values()) < 80
    assert found(part_chars=sum(len(t) for _, t in items) // 2) == whole
    # ten parts: one map in the plan, as each pass is written; columns named like results or helpers stay
    odd = docs(rows).withColumns({"leaked_items": F.lit("mine"), "_holders": F.lit(1), "leak_similarity": F.col("doc_id"), "part": F.lit("x")})
    plan = decontaminate.with_leaks(odd, bench, part_chars=sum(len(t) for _, t in items) // 10)
    assert plan._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and plan.filter("_holders = 1 and part = 'x'").count() == 80
    want = {d for d, (x, _) in whole.items() if not x}
    for chars in (decontaminate.PART_CHARS, 1000):
        left = decontaminate.clean(odd, bench, part_chars=chars)
        assert left.columns == odd.columns and {(x.doc_id, x.leaked_items, x.leak_similarity) for x in left.collect()} == {(d, "mine", d) for d in want}


def test_hamming_blocks_miss_nothing():
    r = np.random.default_rng(1)
    prints = r.integers(0, 2**63, 3000, dtype=np.int64).view(np.uint64)
    sizes = np.arange(3000) % 3
    near = prints[:600].copy()
    for i in range(len(near)):
        for b in r.permutation(64)[: r.integers(0, decontaminate.RADIUS + 4)]:
            near[i] ^= np.uint64(1 << int(b))
    index = decontaminate.HammingIndex(prints, sizes)
    for size in range(3):
        want = {(i, j) for i in range(len(near)) for j in np.flatnonzero((np.bitwise_count(near[i] ^ prints) <= decontaminate.RADIUS) & (sizes == size)).tolist()}
        assert {tuple(x) for x in index.near(near, size).tolist()} == want and len(want) > 100
    assert decontaminate.HammingIndex(prints[:0], sizes[:0]).near(near, 1).shape == (0, 2)


def test_radius_reaches_similar_windows():
    """Recall of the index against exact search, for windows of a similarity from 0.8 on, and how little else it lets through."""
    r = random.Random(3)
    items = [(i, prose(r.randint(12, 60), 500 + i)) for i in range(120)]
    index = decontaminate.Items(items)
    reached = []
    for k, (_, text) in enumerate(items):
        for _ in range(12):
            words = text.split()
            for _ in range(r.choice((1, 1, 2))):
                words[r.choice((r.randrange(len(words)), r.choice((0, 1, -1, -2))))] = prose(1, r.random())
            s = decontaminate.shingles(" ".join(words))
            if 0.8 <= index.similarity(Counter(s.tolist()), k) < 1:
                reached.append([0, k] in index.index.near(index.fingerprints(s, len(s)), len(s)).tolist())
    assert len(reached) > 200 and np.mean(reached) >= 0.9
