"""Chunking of documents (document_id, text) into rows chunk_id, document_id, chunk_index, text, start, end, method.

All are narrow: a document's chunks come from one row and an explode. Ids are document_id || '_chunk_' || index.
Null and empty texts have no chunks.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import sentences, strip

CHUNK = ["chunk_id", "document_id", "chunk_index", "text", "start", "end", "method"]


def _checked(size: int, overlap: int) -> int:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")
    return size - overlap


def _rows(df: DataFrame, pieces: Column, method: str) -> DataFrame:
    """pieces: array of structs text, start, end."""
    found = df.select(F.col("document_id").cast("string").alias("document_id"), F.posexplode(pieces).alias("chunk_index", "p"))
    return found.select(F.concat("document_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", F.col("p.text").alias("text"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.lit(method).alias("method"))


def _piece(text: Column, start: Column, size: int, n: Column) -> Column:
    return F.struct(F.substring(text, start + 1, F.lit(size)).alias("text"), start.alias("start"), F.least(start + size, n).alias("end"))


def chunk_fixed(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of `size` characters, each `size - overlap` after the one before, until one reaches the end."""
    step = _checked(size, overlap)
    text, n = F.col("text"), F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step))
    return _rows(df, F.transform(starts, lambda s: _piece(text, s, size, n)), "fixed_size")


def chunk_fixed_tail(df: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """A window at every step before the end, trimmed; blank ones are dropped and not numbered."""
    step = _checked(size, overlap)
    text, n = F.col("text"), F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    pieces = F.transform(starts, lambda s: _piece(text, s, size, n))
    pieces = F.transform(pieces, lambda p: F.struct(strip(p["text"]).alias("text"), p["start"].alias("start"), p["end"].alias("end")))
    return _rows(df, F.filter(pieces, lambda p: p["text"] != ""), "fixed_tail")


#: The white space that strip() takes off.
SPACE = " \t\n\x0b\f\r"


def pack(parts: Iterable[str], most: int) -> list[str]:
    """Texts joined greedily up to so many characters, trimmed; a longer one stays whole, a blank result is dropped."""
    out, now, size = [], [], 0
    for s in parts:
        if size + len(s) > most:
            out.append("".join(now).strip(SPACE))
            now, size = [], 0
        now.append(s)
        size += len(s)
    out.append("".join(now).strip(SPACE))
    return [x for x in out if x]


def chunk_sentences(df: DataFrame, max_chunk_size: int = 500) -> DataFrame:
    """Sentences packed greedily up to max_chunk_size characters; a longer sentence stays whole. Each step of the packing hangs on the one before,
    so it is a loop over a document's sentences, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def packed(parts: pd.Series) -> pd.Series:
        return parts.map(lambda x: None if x is None else pack(x, max_chunk_size))

    none = F.lit(None).cast("int")
    return _rows(df, F.transform(packed(sentences(F.col("text"))), lambda t: F.struct(t.alias("text"), none.alias("start"), none.alias("end"))), "sentence")


METHODS = {"fixed_size": chunk_fixed, "fixed_tail": chunk_fixed_tail, "sentence": chunk_sentences}


def chunk_corpus(df: DataFrame, method: str = "fixed_size", **params: int) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown chunking method {method}; known: {', '.join(METHODS)}")
    return METHODS[method](df, **params)


def chunk_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of chunks and average, least, greatest and total length; zeros if there are none."""
    n = F.length("text")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.groupBy(*(by or [])).agg(F.count("*").alias("total_chunks"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_length"), zero(F.min(n)).alias("min_length"), zero(F.max(n)).alias("max_length"), zero(F.sum(n)).alias("total_length"))


def chunks_per_doc(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def build_docstore(chunks: DataFrame) -> DataFrame:
    """chunk_id, text, document_id, metadata (start, end and method as strings; nulls left out)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("start", "end", "method")))
    return chunks.select("chunk_id", "text", "document_id", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("metadata"))
