"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line is removed if an earlier line, by (doc_id, line number), is equal to it or within the edits that the shorter of the two allows: one for each
PER_EDIT bytes, MAX_EDITS at most (so none below 16 bytes, one up to 31, two from 32 on). Lines are judged on the input. Edits are counted on UTF-8 bytes.
Blank lines (of spaces and U+0009 to U+000D) are never removed.

Equal lines are one row, of their first place; 96 bits of hash decide equality. A line that allows e edits is cut into e + 1 even segments; by the pigeonhole principle a
line of its length or more within e edits holds one of them unchanged, at a place that is shifted by no more edits than are left on either side. So each line is
indexed under its own segments (with length and segment number), and probes, for each length from its own down to as many less as that length allows
edits, the substrings at those places. Pairs that meet and whose sketches (counts of sixteen letters) allow so few edits are verified on what remains between
their common prefix and suffix, with a bit vector of the 2 * e + 1 diagonals for each number of edits.

Nulls: a null text has one empty line; a null doc_id comes before all others. Equal lines of the same number in rows that share a doc_id are at one place. Empty tables
give no rows. Further columns, however named, are kept by dedup_lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

MAX_EDITS, PER_EDIT = 2, 16
#: The lowest bits of a key: the edits that its length allows.
EDIT_BITS = 3


def allowed(length: Column, edits: int, per_edit: int) -> Column:
    """Edits within which a line of that many bytes is alike to one that is as long or longer."""
    return F.least(F.lit(edits), (length / per_edit).cast("int"))


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of edits + 1 even segments; the longer ones come last."""
    count = edits + 1
    base, longer = (length / count).cast("int"), length % count
    extra = F.greatest(F.lit(0), F.lit(i - count) + longer)
    return F.lit(i) * base + extra, base + (F.lit(i) >= F.lit(count) - longer).cast("int")


def _key(line: Column, length: Column, edits: int, i: int, start: Column, size: Column) -> Column:
    found = F.xxhash64(length, F.lit(i), F.substring(line, start + 1, size))
    return F.shiftleft(found, EDIT_BITS).bitwiseOR(F.lit(edits))


def index_keys(line: Column, n: Column, edits: int = MAX_EDITS, per_edit: int = PER_EDIT) -> Column:
    """A line's own segments, as many as the edits that it allows and one more."""
    keys = F.array().cast("array<long>")
    for e in range(1, edits + 1):
        keys = F.when(allowed(n, edits, per_edit) == e, F.array(*(_key(line, n, e, i, *segment(n, i, e)) for i in range(e + 1)))).otherwise(keys)
    return keys


def probe_keys(line: Column, n: Column, edits: int = MAX_EDITS, per_edit: int = PER_EDIT) -> Column:
    """All probes but those of the same length and place, which are the line's own index keys; null for lengths that allow another number of edits."""
    keys = []
    for e in range(1, edits + 1):
        for less in range(e + 1):
            length = n - less
            for i in range(e + 1):
                start, size = segment(length, i, e)
                for shift in range(max(-i, less - (e - i)), min(i, less + e - i) + 1):
                    if less or shift:
                        keys.append(F.when(allowed(length, edits, per_edit) == e, _key(line, length, e, i, start + shift, size)))
    return F.array(*keys) if keys else F.array().cast("array<long>")


#: Frequent letters of European texts.
LETTERS = "entairsoludcmpgh"
#: The characters of a blank line.
BLANK = " \t\n\x0b\x0c\r"


def sketch(line: Column, low: Column) -> Column:
    """How often a line holds each of LETTERS, modulo 4, as sixteen times two bits, above the 32 bits of low."""
    n = F.octet_length(line)
    counts = ((n - F.octet_length(F.replace(line, F.lit(c)))).bitwiseAND(F.lit(3)).cast("long") for c in LETTERS)
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(c, 32 + 2 * i) for i, c in enumerate(counts)), low)


def sketches_allow(a: Column, b: Column, edits: Column | int) -> Column:
    """An edit takes away one letter and brings one, at most; differences are taken around 4, so never too large."""
    total = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        up = (F.shiftright(a, 32 + 2 * i) - F.shiftright(b, 32 + 2 * i)).bitwiseAND(F.lit(3))
        total = total + F.least(up, 4 - up)
    return total <= 2 * edits


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value), with value computed once; also keeps the optimiser from copying it to each of its uses."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two different binary columns begin with alike: by halving steps, each one comparison."""
    most = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.transform(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda p: F.call_function("shiftleft", F.lit(1), p))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= most) & (F.substring(a, at + 1, s) == F.substring(b, at + 1, s)), at + s).otherwise(at))


def common_suffix(a: Column, b: Column) -> Column:
    la, lb = F.octet_length(a), F.octet_length(b)
    most = F.least(la, lb)
    steps = F.transform(F.sequence(F.ceil(F.log2(most + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda p: F.call_function("shiftleft", F.lit(1), p))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= most) & (F.substring(a, la - at - s + 1, s) == F.substring(b, lb - at - s + 1, s)), at + s).otherwise(at))


def within_edits(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Whether the edit distance of two binary columns is at most `edits`.

    State after i bytes of a: for each number e of edits a bit vector of the diagonals d = -edits..edits (bit d + edits) that can be
    reached with e edits at most, so that a's first i bytes become b's first i + d. All vectors lie in one long, `width` bits each."""
    width = 2 * edits + 1
    mask = (1 << width) - 1
    la, lb = F.octet_length(a), F.octet_length(b)

    def vector(state: Column, e: int) -> Column:
        return F.shiftright(state, e * width).bitwiseAND(F.lit(mask))

    def matches(i: Column) -> Column:
        """Bit d + edits: whether byte i of a is byte i + d of b."""
        byte = F.substring(a, i, 1)
        return reduce(lambda x, y: x.bitwiseOR(y), (F.when((i + d >= 1) & (i + d <= lb) & (byte == F.substring(b, i + d, 1)), F.lit(1 << (d + edits))).otherwise(F.lit(0)) for d in range(-edits, edits + 1)))

    def step(state: Column, match: Column) -> Column:
        new, before = [], None
        for e in range(edits + 1):
            now = vector(state, e).bitwiseAND(match)
            if e:
                less = vector(state, e - 1)
                now = now.bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(before, 1).bitwiseAND(F.lit(mask)))
            new.append(now)
            before = now
        packed = reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(v.cast("long"), e * width) for e, v in enumerate(new)))
        return F.when(state == 0, state).otherwise(packed)

    # before the first byte: diagonal d >= 0 by d inserted bytes
    begin = sum(sum(1 << (d + edits) for d in range(e + 1)) << (e * width) for e in range(edits + 1))
    places = F.when(la > 0, F.sequence(F.lit(1), la)).otherwise(F.array().cast("array<int>"))
    ended = F.aggregate(F.transform(places, matches), F.lit(begin).cast("long"), step)
    return let(ended, lambda state: _bit(state, edits * width + edits, lb - la, edits))


def similar(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """within_edits of what lies between the common prefix and suffix of two different binary columns."""

    def rest(x: Column, y: Column, front: Column, back: Column | int) -> Column:
        return F.struct(*(F.substring(c, front + 1, F.octet_length(c) - front - back).alias(k) for c, k in ((x, "a"), (y, "b"))))

    def without_suffix(x: Column) -> Column:
        return let(common_suffix(x["a"], x["b"]), lambda back: let(rest(x["a"], x["b"], F.lit(0), back), lambda y: within_edits(y["a"], y["b"], edits)))

    return let(common_prefix(a, b), lambda front: let(rest(a, b, front, 0), without_suffix))


def _bit(state: Column, base: int, offset: Column, edits: int) -> Column:
    """Bit base + offset; false for an offset beyond the band."""
    out = F.lit(False)
    for d in range(-edits, edits + 1):
        out = F.when(offset == d, F.shiftright(state, base + d).bitwiseAND(F.lit(1)) == 1).otherwise(out)
    return out


def similar_pairs(lines: DataFrame, edits: int = MAX_EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """lines: h, c (a line's hashes), place, m (how often it stands), line, each line once. The pairs within the edits that the shorter one allows, as
    hashes and places of both."""
    # place and m are kept, so that all uses of lines share one exchange
    known = lines.filter(F.col("place").isNotNull() & (F.col("m") > 0) & (F.octet_length("line") >= per_edit))
    bytes_, n = F.col("line").cast("binary"), F.octet_length("line")
    drawn = known.withColumn("g", sketch(F.col("line"), F.col("c")))  # before the rows of a line are made, so once for each

    def rows(keys: Column, h: str, g: str) -> DataFrame:
        return drawn.select(F.explode(keys).alias("key"), F.col("h").alias(h), F.col("g").alias(g))

    # alike but for names, so that both share one exchange
    index, again = rows(index_keys(bytes_, n, edits, per_edit), "ha", "ga"), rows(index_keys(bytes_, n, edits, per_edit), "hb", "gb")
    probes = rows(probe_keys(bytes_, n, edits, per_edit), "hb", "gb").filter("key is not null")
    near = sketches_allow(F.col("ga"), F.col("gb"), F.col("key").bitwiseAND(F.lit((1 << EDIT_BITS) - 1)))
    met = probes.join(index.hint("shuffle_hash"), "key").filter((F.col("ha") != F.col("hb")) & near)
    equal_length = again.join(index.hint("shuffle_hash"), "key").filter((F.col("ha") < F.col("hb")) & near)
    low = F.col("ha") < F.col("hb")
    each = [F.when(low, F.col(x)).otherwise(F.col(y)) for x, y in (("ha", "hb"), ("ga", "gb"), ("hb", "ha"), ("gb", "ga"))]
    hash_ = lambda g: g.bitwiseAND(F.lit((1 << 32) - 1))
    pairs = met.unionByName(equal_length).select(each[0].alias("ha"), hash_(each[1]).alias("ca"), each[2].alias("hb"), hash_(each[3]).alias("cb")).distinct()
    # joined on all columns that lines are grouped by, so that lines are not exchanged again
    ends = {x: known.select(F.col("h").alias(f"h{x}"), F.col("c").alias(f"c{x}"), F.col("place").alias(f"place_{x}"), F.col("line").alias(x)) for x in "ab"}
    most = allowed(F.least(F.octet_length("a"), F.octet_length("b")), edits, per_edit)
    both = pairs.join(ends["a"], ["ha", "ca"]).join(ends["b"], ["hb", "cb"]).filter(F.abs(F.octet_length("a") - F.octet_length("b")) <= most)
    verdict = F.lit(False)
    for e in range(1, edits + 1):
        verdict = F.when(most == e, similar(F.col("a").cast("binary"), F.col("b").cast("binary"), e)).otherwise(verdict)
    return both.filter(verdict).drop("a", "b")


def _documents(docs: DataFrame, *more: str) -> DataFrame:
    """d, t: a document's key, with nulls put to values."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"), *more)


def removed_lines(docs: DataFrame, edits: int = MAX_EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """d, t, removed (line numbers from 0, in order) of the documents that lose a line."""
    occurring = (
        _documents(docs)
        .select("d", "t", F.posexplode("lines").alias("no", "line"))
        .filter(F.octet_length(F.btrim("line", F.lit(BLANK))) > 0)
        .select("d", "t", "no", "line", F.xxhash64("line").alias("h"), F.crc32(F.col("line").cast("binary")).alias("c"))
    )
    lines = occurring.groupBy("h", "c").agg(F.min(F.struct("d", "no")).alias("place"), F.first("line").alias("line"), F.count("*").alias("m"))
    pairs = similar_pairs(lines, edits, per_edit)
    later = F.col("place_a") > F.col("place_b")
    late = pairs.select(F.when(later, F.col("ha")).otherwise(F.col("hb")).alias("h"), F.when(later, F.col("ca")).otherwise(F.col("cb")).alias("c")).distinct().withColumn("late", F.lit(True))
    # line is kept, so that this reads the exchange of lines once more. What is cut holds those lines alone of which some place goes; as it has no
    # grouping left, Spark can split the places of a very common line in the join
    firsts = lines.filter(F.col("line").isNotNull()).select("h", "c", "place", "m").join(late, ["h", "c"], "left").filter("late is not null or m > 1")
    gone = occurring.select("d", "t", "no", "h", "c").join(cut(firsts.drop("m")), ["h", "c"]).filter(F.col("late").isNotNull() | (F.struct("d", "no") != F.col("place")))
    return gone.groupBy("d", "t").agg(F.array_sort(F.collect_set("no")).alias("removed"))


def line_verdicts(docs: DataFrame, edits: int = MAX_EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """doc_id, n_lines, removed (array<int>) for each row of docs."""
    rows = _documents(docs, F.col("doc_id").cast("long").alias("doc_id")).select("d", "t", "doc_id", F.size("lines").cast("long").alias("n_lines"))
    return rows.join(removed_lines(docs, edits, per_edit), ["d", "t"], "left").select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """docs with their removed lines taken out of text; a null text stays null. All other columns are unchanged."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = removed_lines(docs, edits, per_edit).select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("removed").alias("_removed"))
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_removed", i)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(rest)
    return docs.join(found, (key[0] == F.col("_d")) & (key[1] == F.col("_t")), "left").select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_verdicts(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
o AS (SELECT doc_id, unnest(range(len(lines))) AS no, unnest(lines) AS line FROM d),
l AS (SELECT line, strlen(line) AS n, min((doc_id, no)) AS place FROM o WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line),
late AS (SELECT DISTINCT b.line FROM l a JOIN l b ON a.n >= {PER_EDIT} AND b.n >= {PER_EDIT} AND a.n BETWEEN b.n - {MAX_EDITS} AND b.n + {MAX_EDITS} AND a.place < b.place AND levenshtein(a.line, b.line) <= least({MAX_EDITS}, least(a.n, b.n) // {PER_EDIT})),
g AS (SELECT o.doc_id, o.no FROM o JOIN l USING (line) WHERE l.place <> (o.doc_id, o.no) OR line IN (SELECT line FROM late)),
r AS (SELECT doc_id, count(*) AS n, string_agg(no, ',' ORDER BY no) AS removed FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, coalesce(r.removed, '') AS removed_lines
FROM d LEFT JOIN r USING (doc_id)"""
}
