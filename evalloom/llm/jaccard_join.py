"""N-gram Jaccard join by token-combination prefixes: all pairs of documents whose shingle sets are similar enough, as components.

Tokens are shingles of four words, as fingerprints of TOKEN_BITS bits. The global order of tokens puts those first that the fewest sets
hold (holders are counted over all sets, by the upper COUNTED_BITS bits), equal counts by fingerprint. Two sets of n and m tokens are linked if
they share at least o = ceil(t / (1 + t) * (n + m)) tokens. So if their first shared token has s tokens from it on in one set, it has min(s, s') >= o;
it lies in the first n - ceil(t * n) + 1 tokens of either, and in the smaller set s >= 2 t / (1 + t) * n (the row is "tight"). A token that one set
alone holds is shared with nobody and is not indexed. A rare token of a prefix is a signature as it stands. Tokens of more than FREQUENT sets are
frequent; they come last, so where the first shared token is frequent, so is the second, and a set is indexed under each
pair of frequent tokens of the prefix that is longer by one. As pairs grow with the square of a prefix, sets of over LONG tokens are indexed under
their single frequent tokens, and sets of similar size to LONG under both.

Steps: (1) equal sets are one node; (2) blocks of nodes ask for their tokens' holders; (3) signatures of the nodes; those without a tight row or a
second node are dropped; (4) each node is compared with one hub, the smallest tight node of a signature, that of most of its signatures, and the links
made into components; (5) where a signature still holds several components, its tight rows meet the rows of other components that sizes and places
allow, so that no link is lost; (6) components again. A pair's texts meet in one partition, sorted by hub, and its sets are compared exactly.

Nulls: a null text is an empty set; empty sets are linked with nothing; a row with a null doc_id is returned with a null component and linked with
nothing. Rows that share a doc_id are one node, with the links of all their texts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answered, asked, blocks_of, column, in_blocks, per_block_with, resolve, unpacked
from .common import U64, cut, doc_columns, folder, forget, map_texts, mix, read, slices, windows, written
from .components import components
from .wordbytes import Words

SHINGLE, PERCENT, COMBINED = 4, 85, 2
#: Sets that hold a token from which on it is frequent; tokens of a set from which on frequent ones are indexed one by one.
FREQUENT, LONG = 4096, 400
TOKEN_BITS, COUNTED_BITS = 51, 48
#: Texts whose tokens are sorted together: their number takes the bits that a token leaves.
TOGETHER = 1 << (64 - TOKEN_BITS)
#: Rows of two longs up to which a table of pairs is broadcast (16 MB); larger ones are joined by shuffling.
BROADCAST_ROWS = 1 << 20
_LOW = U64(64 - TOKEN_BITS)


def tokens_of(texts: pa.Array | pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their texts (at most TOGETHER), not yet distinct. A text of fewer words is one shingle; one without words has none."""
    w = Words(texts, lower=True)
    whole = w.whole(length)
    token, doc = [windows(w.hashes, length)[whole]], [w.of[: len(whole)][whole]]
    short = (w.sizes > 0) & (w.sizes < length)
    for size in np.unique(w.sizes[short]).tolist():
        some = np.flatnonzero(w.sizes == size)
        token.append(windows(w.hashes, size)[w.first[some]])
        doc.append(some)
    return np.concatenate(token) >> _LOW, np.concatenate(doc).astype(U64)


def sets_by_token(texts: pa.Array | pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each text, in the order of tokens: token, text."""
    token, doc = tokens_of(texts, length)
    packed = np.sort(token << _LOW | doc)
    packed = packed[_first_of_run(packed)]
    return packed >> _LOW, (packed & U64(TOGETHER - 1)).astype(np.int64)


def sets_by_text(texts: pa.Array | pa.ChunkedArray, length: int) -> list[np.ndarray]:
    """The sorted set of each text."""
    token, doc = tokens_of(texts, length)
    packed = np.sort(doc << U64(TOKEN_BITS) | token)
    packed = packed[_first_of_run(packed)]
    ends = np.searchsorted(packed >> U64(TOKEN_BITS), np.arange(1, len(texts)).astype(U64))
    return np.split(packed & U64((1 << TOKEN_BITS) - 1), ends)


def _first_of_run(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def needed(n, percent: int):
    return -(-percent * n // 100)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(token: np.ndarray, doc: np.ndarray, held: np.ndarray, n: np.ndarray, percent: int = PERCENT, frequent: int = FREQUENT, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their texts, and s: how many tokens at most two texts share whose first shared tokens are this key.

    token, doc, held: each text's tokens and how many sets hold them; tokens that one set alone holds may be left out. n: tokens of each text."""
    order = np.lexsort((token, held, doc))
    token, doc, held = token[order], doc[order], held[order]
    kept = np.bincount(doc, minlength=len(n))
    rank = np.arange(len(doc)) - (np.cumsum(kept) - kept)[doc] + (n - kept)[doc]
    least, often = needed(n, percent), held > frequent
    s = n[doc] - rank
    both_kinds = (least < COMBINED) | (100 * n >= percent * long)  # indexed (also) under single frequent tokens
    single = (s >= least[doc]) & (~often | both_kinds[doc])
    keys, docs, bounds = [mix(token[single] + U64(5))], [doc[single]], [s[single]]
    combine = often & (s + 1 >= least[doc]) & (percent * n <= 100 * long)[doc]
    for i in np.unique(doc[combine]).tolist():
        at = np.arange(*np.searchsorted(doc, (i, i + 1)))
        at = at[combine[at]]
        chosen = np.array(list(combinations(range(len(at)), COMBINED)), np.int64).reshape(-1, COMBINED)
        one, two = token[at[chosen[:, 0]]], token[at[chosen[:, 1]]]
        keys.append(mix(mix(one + U64(3)) + two))
        docs.append(np.full(len(chosen), i))
        bounds.append(s[at[chosen[:, 1]]] + 1)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(bounds)


def set_prints(docs: DataFrame, length: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, and a 128-bit fingerprint of the set (set_a, set_b) for each row."""

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        for at in range(0, part.num_rows, TOGETHER):
            texts = part.column("text").slice(at, TOGETHER)
            token, doc = sets_by_token(texts, length)
            n.append(np.bincount(doc, minlength=len(texts)))
            for sums, seed in ((a, 11), (b, 0x5DEECE66D)):
                x = np.zeros(len(texts), U64)
                np.add.at(x, doc, mix(token * U64(2) + U64(seed)))
                sums.append(x)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.concatenate(n).astype(np.int64)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (a, b))], names=["doc_id", "n_shingles", "set_a", "set_b"])

    return map_texts(docs, one, "doc_id long, n_shingles long, set_a long, set_b long")


def _six(x: np.ndarray) -> np.ndarray:
    """The lower six bytes of each value, which is all of a counted key."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel().astype(U64)


def _node_rows(table: pa.Table, known: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The ids and texts of a block's nodes."""
    nodes = np.sort(known.column("node").drop_null().to_numpy())
    ids = table.column("doc_id").combine_chunks()
    mine = np.flatnonzero(np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), nodes) & ids.is_valid().to_numpy(zero_copy_only=False))
    return ids.to_numpy(zero_copy_only=False)[mine].astype(np.int64), table.column("text").take(pa.array(mine))


ROWS = "key long, node long, n int, s int"


def signature_rows(docs: DataFrame, nodes: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """ROWS of the nodes (doc_id) among docs."""
    blocks, n = in_blocks(docs)
    nodes = nodes.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), F.lit(-1).alias("level"), F.col("doc_id").alias("node"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("held"))

    def ask(table: pa.Table, known: pa.Table) -> pa.Table:
        keys, counts = [np.empty(0, U64)], [np.empty(0, np.int64)]
        if table.num_rows and known.num_rows:
            _, texts = _node_rows(table, known)
            for at in range(0, len(texts), TOGETHER):
                token, _ = sets_by_token(texts.slice(at, TOGETHER), length)
                token >>= U64(TOKEN_BITS - COUNTED_BITS)
                first = np.flatnonzero(_first_of_run(token))
                keys.append(token[first])
                counts.append(np.diff(np.append(first, len(token))))
        key, count = np.concatenate(keys), np.concatenate(counts)
        if len(keys) > 2:
            order = np.argsort(key)
            first = np.flatnonzero(_first_of_run(key[order]))
            key, count = key[order][first], np.add.reduceat(count[order], first) if len(first) else count
        block = table.column("block")[0].as_py() if table.num_rows else 0
        return asked(n, block, key << U64(64 - COUNTED_BITS), False, small=_six(key), count=np.minimum(count, 65535).astype(np.uint16))

    def holders(table: pa.Table) -> pa.Table:
        """The keys of several sets and how many hold them, to each block that asked."""
        key, count = _from_six(unpacked(table, "small", np.uint8)), unpacked(table, "count", np.uint16)
        block = blocks_of(table, "count", 2)
        order = np.argsort(key)
        first = np.flatnonzero(_first_of_run(key[order]))
        sums = np.add.reduceat(count[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        sums = np.repeat(sums, np.diff(np.append(first, len(key))))
        back = order[sums > 1]
        told = answered(block[back], 0, key=_six(key[back]), held=np.minimum(sums[sums > 1], 65535).astype(np.uint16))
        return told.add_column(2, "node", pa.nulls(told.num_rows, pa.int64()))

    def sign(table: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if table.num_rows and known.num_rows:
            ids, texts = _node_rows(table, known)
            told = known.filter(pa.array(column(known, "level") == 0))
            key, held = _from_six(unpacked(told, "key", np.uint8)), unpacked(told, "held", np.uint16)
            order = np.argsort(key)
            key, held = key[order], held[order].astype(np.int64)
            for at in range(0, len(texts) if len(key) else 0, TOGETHER):
                token, doc = sets_by_token(texts.slice(at, TOGETHER), length)
                size = np.bincount(doc, minlength=len(texts.slice(at, TOGETHER)))
                counted = token >> U64(TOKEN_BITS - COUNTED_BITS)
                place = np.minimum(np.searchsorted(key, counted), len(key) - 1)
                shared = key[place] == counted
                # in texts with enough tokens of their own, no prefix holds a shared one
                alone = size - np.bincount(doc[shared], minlength=len(size))
                shared &= (alone <= size - needed(size, percent) + 1)[doc]
                keys, of, s = signatures(token[shared], doc[shared], held[place[shared]], size, percent)
                out.append(pa.table({"key": keys.view(np.int64), "node": ids[at + of], "n": size[of].astype(np.int32), "s": s.astype(np.int32)}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in (("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("s", pa.int32()))})

    known = resolve(per_block_with(blocks, nodes, ask, "part int, block int, small binary, count binary"), n, holders, "block int, level int, node long, key binary, held binary")
    return per_block_with(blocks, known.unionByName(nodes), sign, ROWS)


def may_link(a: str, b: str, percent: int):
    """Whether two rows of a signature, by n and s, can be the first that their sets share."""
    return (100 + percent) * F.least(f"{a}s", f"{b}s").cast("long") >= percent * (F.col(f"{a}n").cast("long") + F.col(f"{b}n"))


def sendable(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small; larger ones are joined by shuffling."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verified(docs: DataFrame, pairs: DataFrame, parts: int, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) that are linked. Texts of b meet that of a in order; a hub of many pairs has a copy of its text for each of its shares."""
    pairs = cut(pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(parts)).cast("int")))
    found = docs.filter("doc_id is not null and text is not null")
    ends = found.withColumnRenamed("doc_id", "b").join(sendable(pairs), "b").select("a", "share", "b", "text")
    hubs = found.withColumnRenamed("doc_id", "a").join(sendable(cut(pairs.select("a", "share").distinct())), "a").select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    rows = hubs.unionByName(ends).repartition(parts, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []
        for big in slices(batches):
            for at in range(0, big.num_rows, TOGETHER):
                part = big.slice(at, TOGETHER)
                out = []
                for a, share, b, x in zip(part.column("a").to_pylist(), part.column("share").to_pylist(), part.column("b").to_pylist(), sets_by_text(part.column("text"), length), strict=True):
                    if (a, share) != hub:
                        hub, sets = (a, share), []
                    if b is None:
                        sets.append(x)
                    elif any(linked(y, x, percent) for y in sets):
                        out.append((a, b))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def similar_components(docs: DataFrame, length: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs."""
    docs = doc_columns(docs)
    prints = written(set_prints(docs, length), "prints")
    sets = prints.filter("n_shingles > 0 and doc_id is not null")
    # cut, so that the join below has an exchange of its own on either side, and Spark can split the rows of a large class
    classes = cut(sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")))
    node_of = cut(sets.join(classes, ["set_a", "set_b"]).groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other")))
    nodes = classes.select(F.col("node").alias("doc_id")).distinct()
    path = folder(docs.sparkSession, "signatures")
    rows = written(signature_rows(docs, nodes, length, percent), "signatures", path)
    tight = (100 + percent) * F.col("s").cast("long") >= 2 * percent * F.col("n").cast("long")
    first = F.min(F.when(tight, F.struct("node", "n", "s")))
    hubs = rows.groupBy("key").agg(first.alias("hub"), F.min("node").alias("low"), F.max("node").alias("high")).filter("hub is not null and low < high")
    rows = cut(rows.join(hubs.select("key", F.col("hub.node").alias("a"), F.col("hub.n").alias("an"), F.col("hub.s").alias("as")), "key"))
    forget(docs.sparkSession, path)
    near = rows.filter("a <> node").filter(may_link("a", "", percent)).groupBy("a", "node").count()
    pairs = cut(near.groupBy("node").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", F.col("node").alias("b")))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    copies = node_of.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = cut(verified(docs, pairs, int(parts), length, percent).unionByName(copies))
    found = cut(components(links))
    placed = rows.select("key", "node", "n", "s").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = cut(placed)
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    rest = cut(placed.join(open_keys, "key", "left_semi"))
    left = rest.filter(tight).select("key", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("s").alias("xs"), F.col("component").alias("cx"))
    right = rest.select("key", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("s").alias("ys"), F.col("component").alias("cy"))
    # the smaller set is tight; of two tight ones of a size, the pair is made once
    more = left.join(right, "key").filter((F.col("cx") != F.col("cy")) & may_link("x", "y", percent) & ((F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y")))))
    more = cut(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not more.isEmpty():
        found = components(links.unionByName(verified(docs, more, int(parts), length, percent)))
    final = node_of.select("doc_id", "node").join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
    return prints.select("doc_id", "n_shingles").join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce(own, "component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+3], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) c USING (doc_id)"""
}
