"""Byte-level BPE on sentencepiece: the model file is written directly from a rank vocabulary.

Each byte b of a token becomes the character U+0100 + b, so that a piece is a word of 256 letters; a piece's
score is minus its rank, the normaliser is the identity. sentencepiece then joins the neighbouring pair of highest
score first, which is the rank order of byte-level BPE. Decoding is the inverse mapping of the pieces.

Encoding and decoding go through one worker, which decodes by a table of the pieces' bytes and remembers the ids of pre-tokens up to MEMO_BYTES.

Nulls: a null text is encoded as the empty text. Empty text: no ids, empty bytes. Repeated rows give repeated results, an empty table none. Further
columns are kept; one that is named like a result is replaced by it.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, read, slices

RANKS = "byte_bpe_multi_50k.tiktoken"
FIRST = 0x100
#: Bytes of pre-tokens whose ids a worker remembers, the upkeep of each included.
MEMO_BYTES, UPKEEP = 32 << 20, 150


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def to_piece(token: bytes) -> str:
    return "".join(chr(FIRST + b) for b in token)


def to_bytes(piece: str) -> bytes:
    return bytes(ord(c) - FIRST for c in piece)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model, as protocol-buffer bytes. Piece 0 is the unknown piece, piece 1 + i the i-th rank.

    Fields used: ModelProto.pieces 1 (piece 1, score 2, type 3), trainer_spec 2 (model_type 3: BPE is 2),
    normalizer_spec 3 (name 1, add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5)."""
    out = [_message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out.append(_message(1, _message(1, to_piece(token).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, 1)))
    out.append(_message(2, _number(3, 2)))
    out.append(_message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


class Coder:
    """A worker's encoder and decoder of one model; pieces: the model's pieces by id, as bytes."""

    def __init__(self, proto: bytes, order: np.ndarray, pattern: str, pieces: list[bytes]):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.order = order.astype(np.int32)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.held = 0
        tokens: list[bytes] = [b""] * (int(order.max(initial=-1)) + 1)
        for rank, piece in zip(order.tolist(), pieces, strict=True):
            tokens[rank] = piece
        self.tokens = pa.array(tokens, pa.large_binary())

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; a null one has none."""
        found = [self.find(x) if x else [] for x in texts]
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        new = list(set().union(*found).difference(memo))
        if new:
            for p, ids in zip(new, self.model.encode([to_piece(p.encode()) for p in new], out_type=int, num_threads=1), strict=True):
                memo[p] = self.order[np.asarray(ids, np.int64) - 1].tobytes()
            self.held += sum(map(len, new)) + UPKEEP * len(new)
        get = memo.__getitem__
        coded = [b"".join(map(get, parts)) for parts in found]
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.LargeBinaryArray:
        """The bytes of each list of ids. A null list, like an empty one, has no bytes."""
        ids = pc.fill_null(ids, []) if ids.null_count else ids
        taken = pc.take(self.tokens, ids.flatten())
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(ids), np.int64))))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)[ends] if len(taken) else np.zeros(len(ids) + 1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])


@lru_cache(2)
def _coder(proto: bytes, order: bytes, pattern: str, lengths: bytes, pieces: bytes) -> Coder:
    ends = np.cumsum(np.frombuffer(lengths, np.int32)).tolist()
    return Coder(proto, np.frombuffer(order, np.int32), pattern, [pieces[a:b] for a, b in zip([0, *ends], ends, strict=False)])


class ByteBPE:
    """encode() and decode() of a column by the ranks in a file of the driver; the vocabulary is sent to the workers. round_trip() does both in one pass.

    The vocabulary is of fixed size (about 2 MB as a model), whatever the corpus."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = sorted(read_ranks(path).items(), key=lambda x: x[1])
        order = np.array([r for _, r in ranks], np.int32)
        lengths = np.array([len(t) for t, _ in ranks], np.int32)
        self.shared = spark.sparkContext.broadcast((model_proto(dict(ranks)), order.tobytes(), pattern, lengths.tobytes(), b"".join(t for t, _ in ranks)))

    def _mapped(self, df: DataFrame, source: str, made: dict[str, T.DataType], fn) -> DataFrame:
        """df with further columns; fn: a coder and the source column of a batch -> those columns."""
        shared, base = self.shared, df.select(*[c for c in df.columns if c not in made])
        schema = T.StructType([*base.schema.fields, *(T.StructField(c, t, False) for c, t in made.items())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = _coder(*shared.value)
            for part in slices(batches, source):
                yield pa.RecordBatch.from_arrays([*part.columns, *fn(coder, part.column(source))], names=[*part.schema.names, *made])

        return base.mapInArrow(run, schema)

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """df with the array<int> column `out`: the ids of each match of the pattern, in order."""
        return self._mapped(df, text, {out: T.ArrayType(T.IntegerType(), False)}, lambda coder, x: (coder.encode(x.to_pylist()),))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """df with the binary column `out`: the bytes that the ids stand for."""
        return self._mapped(df, ids, {out: T.BinaryType()}, lambda coder, x: (coder.decode(x).cast(pa.binary()),))

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
        """df with both: the ids of the text, and the bytes that those ids stand for."""

        def both(coder: Coder, x: pa.Array) -> tuple[pa.Array, pa.Array]:
            found = coder.encode(x.to_pylist())
            return found, coder.decode(found).cast(pa.binary())

        return self._mapped(df, text, {ids: T.ArrayType(T.IntegerType(), False), out: T.BinaryType()}, both)


def ids_sha256(ids: str) -> Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    bpe = ByteBPE(spark, path or public_tokenizers.path(RANKS))
    return bpe.round_trip(doc_columns(read(spark, sf_dir, "documents"))).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
