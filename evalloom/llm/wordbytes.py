"""Words of many texts at once, on their UTF-8 bytes: where they lie, and a 64-bit hash of each.

A word is a run of bytes other than the space and U+0009 to U+000D; as UTF-8 has those bytes in no other character, that is the same as a
run of characters. Hashes depend on the word's bytes alone (with `lower`, A-Z count as a-z).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import U64, mix

IS_WORD = bytes(not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words above so many bytes are hashed one by one.
LONG = 512
#: Bytes of text that are looked at together, so that the arrays of single bytes stay small.
STEP = 2 << 20
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_TIMES = U64(0x9E3779B97F4A7C15)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all texts, and the ends of each in them (one more than there are texts; a null is empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return memoryview(b""), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return (memoryview(data)[ends[0] : ends[-1]] if data is not None else memoryview(b"")), ends - ends[0]


class Words:
    """starts, lengths (in data), hashes: of each word; sizes: words of each text; of: each word's text; first: each text's first word."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        self.data, self.ends = text_bytes(texts)
        starts, lengths, hashes, at, n = [], [], [], 0, len(self.ends) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + STEP, "right")) - 1)
            base = int(self.ends[at])
            data = bytes(self.data[base : int(self.ends[to])])
            found = _found(data.translate(LOWER) if lower else data, self.ends[at : to + 1] - base)
            starts.append(found[0] + base)
            lengths.append(found[1])
            hashes.append(found[2])
            at = to
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.lengths = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, U64)
        self.first = np.searchsorted(self.starts, self.ends[:-1]) if n else np.empty(0, np.int64)
        self.sizes = np.diff(np.append(self.first, len(self.starts)))
        self.of = np.repeat(np.arange(n, dtype=np.int32), self.sizes)

    def whole(self, length: int) -> np.ndarray:
        """For each run of `length` words, by its first: whether it lies in one text."""
        n = len(self.of) - length + 1
        return self.of[:n] == self.of[length - 1 :] if n > 0 else np.empty(0, bool)


def _found(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: some texts' bytes; ends: from 0 on, where each begins and the last ends."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = np.frombuffer(data.translate(IS_WORD), bool)
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[:-1]
    begins[edges] = inside[edges]
    stops[:-1] &= ~inside[1:]
    last = ends[1:][ends[1:] > 0] - 1
    stops[last] = inside[last]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    return starts, lengths, hash_ranges(data, starts, lengths)


def hash_ranges(data: bytes | memoryview, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, eight bytes at a time."""
    eight = np.ndarray((len(data) + 1,), "<u8", bytes(data) + bytes(8), strides=(1,))  # the eight bytes from each place on
    h = eight[starts].astype(U64) & _KEEP[np.minimum(lengths, 8)]
    h = mix(h ^ lengths.astype(U64) * _TIMES)
    more, at = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(more):
        x = eight[starts[more] + at].astype(U64) & _KEEP[np.minimum(lengths[more] - at, 8)]
        h[more] = mix(h[more] * _TIMES + x)
        at += 8
        more = more[lengths[more] > at]
    for i in np.flatnonzero(lengths > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h
