"""Language-model scores by online logistic context mixing, beside a unigram score.

The mixing model predicts a text's UTF-8 bytes and an end mark (0xFF, which no text holds), each as the binary decisions of a prefix code, one code for each byte
before, made from the counts of all pairs of bytes in the training documents, so that frequent bytes take few decisions. Three
predictors see contexts: the byte before, and, hashed, the three bytes before and the word's beginning. Each is a
table of counts of zeros and ones, summed over all training documents by the tasks, and sent to the workers as log odds in eighths (one byte a
slot; with the codes some 10 MB in all, whatever the corpus). A decision's log odds and a constant are combined by weights that a gate chooses (how deep in the code
the decision lies). After every STEP bytes each document's own weights take a step along the gradient of its coding error, so that weights depend on the text before
alone. Many documents are walked side by side, so that a step is a few array operations for all of them.

A fourth predictor sees long contexts, and what it knows grows with the corpus. A segment begins after two words and one white space, if the hash of the words is of a
certain kind (one place in ANCHOR), and ends where the next one begins, or with the text. For each such pair of words Spark counts the segments that follow in
training documents. Where one segment was learned twice or more, the most frequent one is predicted: one more decision at its start, with the log odds of its share and weights of its
own, says whether it comes; if so, its bytes need no further decision, and if not, they are coded like others. Where a segment begins is known from the bytes before it, and the decision is
coded there whatever follows, so the probabilities of all texts add up to 1 at most. These counts and the unigram ones stay distributed: a block of documents asks about what it holds and gets that back.

The score is the log10 probability of the whole text; bits_per_byte is the same in bits.

Nulls: a null text is empty (one token, the end); a null doc_id has no remainder and is learned from. Empty texts have a score, that of the end mark.
An empty training set gives counts of zero, an empty table no rows. Repeated rows are learned from as often as they occur.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answered, asked, blocks_of, column, in_blocks, per_block, per_block_with, resolve, unpacked
from .common import U64, doc_columns, mix, partitions, read, slices
from .wordbytes import Words, hash_ranges

FOLDS, HELD = 7, 2
#: Slots of the two hashed tables, as powers of two.
TABLE_BITS = (20, 20)
GATES, STEP, RATE = 6, 32, 0.02
#: Weights that each document begins with: of the predictors, and of the constant.
BEGIN = (0.25, 0.45, 0.45, 0.0)
#: A place in so many begins a segment; the weights and the rate of its predictor, of the share's log odds and of the constant.
ANCHOR, SEGMENT_BEGIN, SEGMENT_RATE, SEGMENT_STEP = 8, (0.7, 0.0), 0.1, 4
PIECE = 1 << 15  # slots in a piece of a table
BUCKETS = 8  # in which the tasks' pieces are added up first
#: Bytes of text whose arrays are held at once.
GROUP = 1 << 20
END_KEY = U64(0x1F0E2D3C4B5A6978)  # the end of a document, counted as a token
def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


class Code(NamedTuple):
    """Prefix codes. place, length: by 256 * byte before + byte, where its decisions lie in the other arrays; node: 256 * byte before + node of its tree."""

    place: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    gate: np.ndarray


def prefix_codes(pairs: np.ndarray) -> Code:
    """The code for each byte before. pairs: counts of (byte before, byte); bytes that never follow get a share of their count anywhere."""
    anywhere = pairs.sum(axis=0) / max(1, pairs.sum())
    nodes, bits, lengths = [], [], []
    for before in range(256):
        weight = (pairs[before] + 0.05 * anywhere + 1e-9).tolist()
        heap = [(w, b) for b, w in enumerate(weight)]
        heapq.heapify(heap)
        above: dict[int, tuple[int, int]] = {}  # bytes are 0 to 255, nodes 256 on
        for node in range(255):
            (v, x), (w, y) = heapq.heappop(heap), heapq.heappop(heap)
            above[x], above[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (v + w, 256 + node))
        for b in range(256):
            path, x = [], b
            while x in above:
                path.append(above[x])
                x = 256 + above[x][0]
            nodes += [256 * before + n for n, _ in reversed(path)]
            bits += [y for _, y in reversed(path)]
            lengths.append(len(path))
    length = np.array(lengths, np.int32)
    depth = np.arange(len(nodes)) - np.repeat(np.cumsum(length) - length, length)
    return Code((np.cumsum(length) - length).astype(np.int32), length, np.array(nodes, np.uint32), np.array(bits, np.uint8), np.minimum(depth, GATES - 1).astype(np.uint8))


def contexts(data: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The byte before each byte (0 where a text begins), and the hashed contexts of the two tables. Some texts at a time, to stay within caches."""
    out = [np.empty(len(data), kind) for kind in (np.uint8, np.uint32, np.uint32)]
    a = 0
    while a < len(begins):
        b = max(a + 1, int(np.searchsorted(begins, begins[a] + (1 << 16))))
        start, end = int(begins[a]), int(begins[b]) if b < len(begins) else len(data)
        for x, c in zip(out, _contexts(data[start:end], begins[a:b] - start), strict=True):
            x[start:end] = c
        a = b
    return out


def _contexts(data: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    here = np.arange(len(data), dtype=np.int32)
    before = np.zeros((3, len(data)), np.uint8)  # the byte before, the one before that, and the third, of the same text
    for k in range(3):
        before[k, k + 1 :] = data[: -k - 1]
        for j in range(k + 1):
            before[k, np.minimum(begins + j, len(data) - 1)] *= begins + j >= len(data)
    one, two, three = (x.astype(np.uint32) for x in before)
    space = before[0] <= 32
    space[begins] = True
    word = np.maximum.accumulate(np.where(space, here, np.int32(0)))  # where the word began
    at = here - word
    powers = _powers(1 << int(at.max(initial=0) + 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint32)
    np.cumsum((data + np.uint32(7)) * powers[at], dtype=np.uint32, out=sums[1:])
    found = [(one | two << np.uint32(8) | three << np.uint32(16)) + np.uint32(1 << 24), (sums[:-1] - sums[word]) * np.uint32(0x85EBCA6B)]
    for c in found:
        c *= np.uint32(0xC2B2AE35)
        c ^= c >> np.uint32(15)
    return [before[0], *found]


def decisions(data: np.ndarray, before: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each decision of these bytes its place in the code's arrays and its byte; and each byte's first decision."""
    symbol = before.astype(np.intp) << 8 | data
    n = code.length.take(symbol)
    first = np.cumsum(n, dtype=np.int32)
    first -= n
    byte = np.repeat(np.arange(len(data)), n)
    at = np.arange(len(byte)) + (code.place.take(symbol) - first).take(byte)
    return at, byte, first


def slots(context: np.ndarray, byte: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Of a hashed table. node: of each decision, multiplied by NODE."""
    x = context.take(byte)
    x ^= node
    x *= np.uint32(0x27D4EB2F)
    x >>= np.uint32(32 - bits)
    return x.astype(np.intp)


NODE = np.uint32(0x9E3779B1)


@lru_cache(32)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x4F6CDD1D, np.uint32), dtype=np.uint32)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with its end mark, and where each begins."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    return np.frombuffer(b"\xff".join([*texts, b""]), np.uint8), np.cumsum(sizes) - sizes


class Model(NamedTuple):
    """Codes, and the log odds in eighths: of the codes' nodes, and of the slots of both tables."""

    code: Code
    odds: tuple[np.ndarray, ...]
    bits: tuple[int, ...]


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.round(8 * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of the documents that are not held out, some at a time, and where each begins."""
    for part in slices(batches):
        ids = part.column("doc_id").to_pylist()
        texts = [_bytes(t) for d, t in zip(ids, part.column("text").to_pylist(), strict=True) if not held_out(d)]
        for a, b in _cuts(texts, GROUP):
            yield joined(texts[a:b])


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each byte follows each (0 where a text begins), in all documents that are not held out. 65,536 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for data, begins in _learned(batches):
            pair = np.empty(len(data), np.uint16)
            pair[1:] = data[:-1]
            pair[begins] = 0
            sums += np.bincount(pair << np.uint16(8) | data, minlength=1 << 16)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["pair", "n"])

    found = docs.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(1 << 16, np.int64)
    sums[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return sums.reshape(256, 256)


def train(docs: DataFrame, bits: tuple[int, ...] = TABLE_BITS) -> Model:
    """The model of short contexts, learned from all documents that are not held out, in two passes.

    A task adds up its documents and sends the pieces of its tables that it used; pieces are added in two rounds, each a stream."""
    n = partitions(docs)
    pairs = pair_counts(docs)
    code = prefix_codes(pairs)
    weight = np.repeat(pairs.ravel(), code.length)
    nodes = np.stack([np.bincount(code.node, weight * (code.bit == y), 1 << 16) for y in (0, 1)])
    shared = docs.sparkSession.sparkContext.broadcast(code)
    first = np.cumsum([0, *(2 << b for b in bits)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        sums = np.zeros(int(first[-1]), np.int64)
        for data, begins in _learned(batches):
            before, *found = contexts(data, begins)
            pair = before.astype(U64) << U64(8) | data
            for c, width, start in zip(found, bits, first.tolist(), strict=False):
                # a context with its byte is expanded once, with its number
                events = np.sort(c.astype(U64) << U64(16) | pair)
                some = np.flatnonzero(np.diff(events, prepend=~events[:1]))
                number, events = np.diff(np.append(some, len(events))), events[some]
                at, byte, _ = decisions((events & U64(255)).astype(np.uint8), (events >> U64(8) & U64(255)).astype(np.uint8), code)
                slot = slots((events >> U64(16)).astype(np.uint32), byte, code.node.take(at) * NODE, width)
                np.add.at(sums, slot * 2 + code.bit.take(at) + start, number.take(byte))
        sums.resize(-(-len(sums) // PIECE) * PIECE)
        flat = sums.reshape(-1, PIECE)
        used = np.flatnonzero(flat.any(axis=1))
        if len(used):
            packed = [_sparse(flat[i]) for i in used]
            bucket = np.full(len(used), xxhash.xxh3_64_intdigest(b"".join(packed)) % BUCKETS, np.int32)  # of the task's own counts, so the same if it runs again
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bucket), pa.array(packed, pa.binary())], names=["piece", "bucket", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in batches:
            for p, b, c in zip(*(part.column(x).to_pylist() for x in ("piece", "bucket", "counts")), strict=True):
                at, x = _dense(c)
                if (p, b) not in sums:
                    sums[p, b] = np.zeros(PIECE, np.int64)
                sums[p, b][at] += x
        for (p, b), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([b], pa.int32()), pa.array([_sparse(x)], pa.binary())], names=["piece", "bucket", "counts"])

    schema = "piece int, bucket int, counts binary"
    rows = docs.mapInArrow(count, schema).repartition(n, "piece", "bucket").mapInArrow(add, schema)
    rows = rows.withColumn("bucket", F.lit(0)).repartition(n, "piece").mapInArrow(add, schema)
    sums = np.zeros(-(-int(first[-1]) // PIECE) * PIECE, np.int64)
    for piece, counts in rows.select("piece", "counts").collect():  # as many numbers as the tables have slots, at most
        at, x = _dense(counts)
        sums[piece * PIECE + at] = x
    tables = [sums[start : start + (2 << b)].reshape(-1, 2) for b, start in zip(bits, first.tolist(), strict=False)]
    return Model(code, (_odds(*nodes), *(_odds(c[:, 0], c[:, 1]) for c in tables)), bits)


def _sparse(x: np.ndarray) -> bytes:
    """The places and values of the counts that are not zero, in as few bytes a value as the greatest needs."""
    at = np.flatnonzero(x)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if x.max(initial=0) <= np.iinfo(k).max)
    return len(at).to_bytes(4, "little") + at.astype(np.uint16).tobytes() + x[at].astype(kind).tobytes()


def _dense(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    width = (len(data) - 4) // n - 2
    return np.frombuffer(data, np.uint16, n, 4).astype(np.int64), np.frombuffer(data, f"<u{width}", n, 4 + 2 * n).astype(np.int64)


class Mixer:
    """The weights of many documents, for each its own: a row for each document and gate, a column for each input."""

    def __init__(self, docs: int, gates: int, begin: tuple[float, ...], rate: float):
        self.weights = [np.full(docs * gates, w, np.float32) for w in begin]
        self.rate, self.cost = np.float32(rate), np.zeros(docs)

    def step(self, row: np.ndarray, doc: np.ndarray, first: np.ndarray, y: np.ndarray, inputs: list[np.ndarray]) -> None:
        """Codes decisions with the present weights, then moves those. doc, first: the documents, each once, and their first decisions; inputs: without the constant."""
        z = self.weights[-1].take(row)
        for w, x in zip(self.weights, inputs, strict=False):
            z += w.take(row) * x
        np.clip(z, -30, 30, out=z)
        e = np.exp(-z)
        e += 1
        cost = np.log(e)  # of a one; a zero costs z more
        z *= 1 - y
        cost += z
        self.cost[doc] += np.add.reduceat(cost, first)
        error = y - 1 / e
        error *= self.rate
        size = len(self.weights[0])
        for w, x in zip(self.weights, inputs, strict=False):
            w += np.bincount(row, error * x, size)
        self.weights[-1] += np.bincount(row, error, size)


def mixed_bits(texts: list[bytes], model: Model, skipped: np.ndarray | None = None, flags: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Bits that each text costs. skipped: which of the joined bytes need no decision; flags: text, whether it came true, and log odds of each predicted segment."""
    n, (code, odds, bits) = len(texts), model
    data, begins = joined(texts)
    sizes = np.diff(np.append(begins, len(data)))
    found = contexts(data, begins)
    keep = np.flatnonzero(~skipped) if skipped is not None else np.arange(len(data))
    text = np.repeat(np.arange(n), sizes)[keep]
    kept = np.bincount(text, minlength=n)
    rounds = (np.arange(len(keep)) - (np.cumsum(kept) - kept)[text]) // STEP
    order = np.argsort(rounds.astype(np.uint16) if rounds.max(initial=0) < 1 << 16 else rounds, kind="stable")
    keep, text = keep[order], text[order]
    bounds = np.append(np.flatnonzero(np.diff(rounds[order], prepend=-1)), len(order))
    data, (before, *found) = data[keep], [c[keep] for c in found]
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    new[bounds[:-1]] = True
    mixer = Mixer(n, GATES, BEGIN, RATE)
    bit, gate, eighth = code.bit.astype(np.float32), code.gate.astype(np.intp), np.float32(0.125)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at, byte, starts = decisions(data[a:b], before[a:b], code)
        own = np.flatnonzero(new[a:b])
        node = code.node.take(at)
        inputs = [odds[0].take(node) * eighth]
        node *= NODE
        inputs += [o.take(slots(c[a:b], byte, node, w)) * eighth for o, c, w in zip(odds[1:], found, bits, strict=True)]
        row = (text[a:b] * GATES).take(byte)
        row += gate.take(at)
        mixer.step(row, text[a:b][own], starts[own], bit.take(at), inputs)
    cost = mixer.cost
    if flags is not None and len(flags[0]):
        of, came, share = flags
        each = np.bincount(of, minlength=n)
        rounds = (np.arange(len(of)) - (np.cumsum(each) - each)[of]) // SEGMENT_STEP
        order = np.argsort(rounds, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(rounds[order], prepend=-1)), len(order))
        mixer = Mixer(n, 1, SEGMENT_BEGIN, SEGMENT_RATE)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            some = order[a:b]
            first = np.flatnonzero(np.diff(of[some], prepend=-1))
            mixer.step(of[some], of[some][first], first, came[some].astype(np.float32), [share[some].astype(np.float32)])
        cost = cost + mixer.cost
    return cost / float(np.log(2))


class Segments:
    """The segments of many texts: context, fingerprint, text, and the bytes (of the words' data) from start to end.

    Where a segment starts hangs on the bytes before it alone, so that who decodes knows that a decision comes."""

    def __init__(self, words: Words, anchor: int = ANCHOR):
        h, of, ends = words.hashes, words.of, words.starts + words.lengths
        pair = mix(h[:-1] * U64(3) + h[1:]) if len(h) > 1 else np.empty(0, U64)
        stop = words.ends[1:]  # of each text
        at = np.flatnonzero((pair % U64(anchor) == 0) & words.whole(2) & (ends[1:] < stop[of[1:]])) + 1
        self.context, self.of, self.start = pair[at - 1], of[at], ends[at] + 1
        last = np.append(self.of[1:] != self.of[:-1], True)[: len(at)]  # no further one starts in its text
        self.end = np.where(last, stop[self.of], np.append(self.start[1:], 0)[: len(at)])
        self.print = np.fromiter((xxhash.xxh3_64_intdigest(words.data[a:b], z) for a, b, z in zip(self.start.tolist(), self.end.tolist(), last.tolist(), strict=True)), U64, len(at))


def _sorted_by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by the keys, the first one first, and which places of it differ from the one before."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    for i, k in enumerate(keys):
        differs = k[order][1:] != k[order][:-1]
        new[1:] = differs if not i else new[1:] | differs
    return order, new


def _counted_up(n: int, block: int, learned: np.ndarray, *keys: np.ndarray, names: tuple[str, ...] = ()) -> pa.Table:
    """Each combination of keys once, with its number of learned ones."""
    order, new = _sorted_by(*keys)
    first = np.flatnonzero(new)
    count = np.add.reduceat(learned[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    one = order[first]
    return asked(n, block, keys[0][one], **{name: k[one] for name, k in zip(names, keys[1:], strict=True)}, c=count.astype(np.uint32))


ANSWER = "block int, level int, key binary, print binary, n binary, total binary"


def scores(docs: DataFrame, model: Model, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, bits and n_bytes of the mixing model, and the unigram sums; see op5. anchor: a place in so many begins a segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    blocks, n = in_blocks(docs)

    def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all tokens, the end of each text included, and their texts."""
        texts = len(words.sizes)
        return np.concatenate((words.hashes, np.full(texts, END_KEY))), np.concatenate((words.of, np.arange(texts, dtype=np.int32)))

    def learned_from(table: pa.Table) -> np.ndarray:
        return np.array([not held_out(d) for d in table.column("doc_id").to_pylist()], bool)

    def ask_words(table: pa.Table) -> pa.Table:
        key, of = tokens(Words(table.column("text"), lower=True))
        return _counted_up(n, table.column("block")[0].as_py(), learned_from(table)[of], key, names=())

    def total(table: pa.Table) -> pa.Table:
        key, count, block = unpacked(table, "key", U64), unpacked(table, "c", np.uint32), blocks_of(table, "c", 4)
        order = np.argsort(key)
        first = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        sums = np.add.reduceat(count[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        each = np.repeat(sums, np.diff(np.append(first, len(key))))
        back = order[each > 0]
        told = answered(block[back], 0, key=key[back], n=each[each > 0])
        told = told.add_column(3, "print", pa.nulls(told.num_rows, pa.binary())).append_column("total", pa.nulls(told.num_rows, pa.binary()))
        return told.append_column("tokens", pa.array([int(sums.sum())] + [0] * (told.num_rows - 1) if told.num_rows else [], pa.int64())).append_column("types", pa.array([int((sums > 0).sum())] + [0] * (told.num_rows - 1) if told.num_rows else [], pa.int64()))

    def ask_segments(table: pa.Table) -> pa.Table:
        found = Segments(Words(table.column("text"), lower=True), anchor)
        return _counted_up(n, table.column("block")[0].as_py(), learned_from(table)[found.of], found.context, found.print, names=("print",))

    def predicted(table: pa.Table) -> pa.Table:
        """To each block that asked about a context of which a segment was learned twice: the most frequent one (of equals, that of the smallest fingerprint)."""
        key, prints, count, block = unpacked(table, "key", U64), unpacked(table, "print", U64), unpacked(table, "c", np.uint32).astype(np.int64), blocks_of(table, "c", 4)
        order, new = _sorted_by(key, prints)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(count[order], first) if len(first) else np.empty(0, np.int64)
        k, p = key[order][first], prints[order][first]
        by, head = _sorted_by(k, -sums)
        best = by[np.flatnonzero(np.diff(k[by], prepend=~k[by[:1]]))]  # as by is stable, the smallest fingerprint
        group = np.cumsum(np.diff(k, prepend=~k[:1]) != 0) - 1
        whole = np.bincount(group, sums).astype(np.int64) if len(k) else sums
        # each block once a context
        o2, new2 = _sorted_by(key, block)
        one = o2[new2]
        at = np.searchsorted(k[best], key[one])
        good = sums[best][at] > 1 if len(one) else np.empty(0, bool)
        one, at = one[good], at[good]
        return answered(block[one], 1, key=key[one], print=p[best][at], n=sums[best][at], total=whole[at])

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        """Documents in the order of their length, so that those that are walked side by side are alike, and some at a time, so that the arrays stay small."""
        level = column(known, "level")
        first, second = (known.filter(pa.array(level == i)) for i in (0, 1))
        words = _table_of(unpacked(first, "key", U64), unpacked(first, "n", np.int64))
        follows = _table_of(unpacked(second, "key", U64), unpacked(second, "print", U64), unpacked(second, "n", np.int64), unpacked(second, "total", np.int64))
        sizes = pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy()
        order = np.argsort(sizes, kind="stable")
        table, ends = table.take(pa.array(order)), np.cumsum(sizes[order])
        out, a = [], 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + GROUP, "right")))
            out.append(score_some(table.slice(a, b - a), words, follows))
            a = b
        return pa.concat_tables(out)

    def score_some(table: pa.Table, known: tuple, follows: tuple) -> pa.Table:
        ids, texts = table.column("doc_id").to_pylist(), [_bytes(x) for x in table.column("text").to_pylist()]
        words = Words(table.column("text"), lower=True)
        key, of = tokens(words)
        (c,) = _looked_up(known, key)
        segments = Segments(words, anchor)
        best, n_best, whole = _looked_up(follows, segments.context)
        asks = np.flatnonzero(n_best > 0)
        came = segments.print[asks] == best[asks]
        share = np.log((n_best[asks] + 0.4) / (whole[asks] - n_best[asks] + 0.4))
        marks = np.zeros(len(words.data) + 1, np.int32)
        np.add.at(marks, segments.start[asks[came]], 1)
        np.add.at(marks, segments.end[asks[came]], -1)
        skip = np.insert(np.cumsum(marks[:-1], dtype=np.int32) > 0, words.ends[1:], False)  # with the end marks, which are never skipped
        spent = mixed_bits(texts, shared.value, skip, (segments.of[asks], came, share))
        n_tokens = np.bincount(of, minlength=len(ids))
        return pa.table({"doc_id": table.column("doc_id"), "held_out": [held_out(d) for d in ids], "n_tokens": n_tokens.astype(np.int64), "n_known": np.bincount(of, c > 0, minlength=len(ids)).astype(np.int64), "logs": np.bincount(of, np.log10(c + 1.0), minlength=len(ids)), "bits": spent, "n_bytes": pa.array([len(x) for x in texts], pa.int64())})

    counts = resolve(per_block(blocks, ask_words, "part int, block int, key binary, c binary"), n, total, f"{ANSWER}, tokens long, types long")
    follows = resolve(per_block(blocks, ask_segments, "part int, block int, key binary, print binary, c binary"), n, predicted, ANSWER)
    names = [x.split()[0] for x in ANSWER.split(", ")]
    scored = per_block_with(blocks, counts.select(names).unionByName(follows), score, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, bits double, n_bytes long")
    totals = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("vocabulary")).withColumn("one", F.lit(1))
    return scored.withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").drop("one")  # totals is one row


def _table_of(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and their values."""
    order = np.argsort(key)
    return key[order], *(v[order] for v in values)


def _looked_up(known: tuple[np.ndarray, ...], key: np.ndarray) -> list[np.ndarray]:
    """The values of each key, 0 for unknown ones."""
    there, *values = known
    if not len(there):
        return [np.zeros(len(key), v.dtype) for v in values]
    at = np.minimum(np.searchsorted(there, key), len(there) - 1)
    good = there[at] == key
    return [np.where(good, v[at], v.dtype.type(0)) for v in values]


def _cuts(texts: list[bytes], most: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes."""
    a, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most or i == len(texts) - 1:
            yield a, i + 1
            a, size = i + 1, 0


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = doc_columns(read(spark, sf_dir, "documents"))
    found = scores(docs, train(docs))
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("vocabulary") + 1.0)
    score = -F.col("bits") * float(np.log10(2))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), score.alias("score"), (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


QUERIES = {"op5_lm_score": op5_lm_score}
SQL: dict[str, str] = {}
