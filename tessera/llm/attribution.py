"""Token counts of the parts of a document, from one encoding of the whole.

A document is encoded once; its tokens then have byte spans, and the parts (fields, sections) have
character spans, which are turned into byte spans. Counting is a join of the two sets of intervals by
binary search. A token that crosses a boundary is allocated by rule:

  first  to the part that holds its first byte (the default)
  last   to the part that holds its last byte
  share  to each part by the share of its bytes there; counts are then fractions

Parts may overlap or leave gaps; a token is counted by every part that it falls to, or by none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _ship, parse
from .common import batch_udf, batches, fresh

RULES = ("first", "last", "share")


@lru_cache(maxsize=2)
def _tokenizer(name: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    with open(SparkFiles.get(name), "rb") as f:
        ranks = parse(f.read())
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for b, i in ranks.items():
        size[i] = len(b)
    return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def line_spans(text: str | None) -> tuple[list[int], list[int]]:
    """Character spans of the lines, each with the line feed that ends it: together the whole text. None for an empty text."""
    if not text:
        return [], []
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return [0, *ends[:-1]], ends


def byte_offsets(data: bytes, chars: np.ndarray) -> np.ndarray:
    """Byte offset of each character offset; offsets beyond the text are at its end."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(data))[np.clip(chars, 0, len(starts))]


def allocate(sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (given by their byte sizes, in order) of each byte span."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    if rule == "share":
        upto = lambda x: np.interp(x, bounds, np.arange(len(bounds)))
        return np.maximum(upto(ends) - upto(starts), 0.0) if len(sizes) else np.zeros(len(starts))
    at = bounds[:-1] if rule == "first" else bounds[1:] - 1
    return np.maximum(np.searchsorted(at, ends) - np.searchsorted(at, starts), 0).astype(np.float64)


def attributed(docs: DataFrame, path: str, pattern: str, text: str = "text", spans: str | None = None, rule: str = "first") -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned): n_tokens, and parts, an array of (start, end, tokens).

    spans names a column array<struct<start, end>> of character offsets (end excluded); without it the
    parts are the text's lines. Null and empty texts have no tokens, and a null span or a null array
    no parts; spans are clipped to the text; texts of any length are encoded at once and whole; ids play
    no part, and rows, repeated or not, are counted each by itself; equal spans get equal counts; an
    empty table gives an empty result; other columns, whatever their names, pass through.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    batches(docs.sparkSession)
    name = _ship(docs.sparkSession, path)

    def run(texts: pa.Array, given: pa.Array | None = None) -> pa.Array:
        enc, size = _tokenizer(name, pattern)
        wanted = given.to_pylist() if given is not None else None
        total, lengths, starts, ends, counts = [], [0], [], [], []
        for i, t in enumerate(texts.to_pylist()):
            t = t or ""
            if wanted is None:
                a, b = line_spans(t)
            else:
                real = [x for x in wanted[i] or () if x and x["start"] is not None and x["end"] is not None]
                a, b = [x["start"] for x in real], [x["end"] for x in real]
            data = t.encode("utf-8", "surrogatepass")
            sizes = size[np.array(enc.encode_ordinary(t), np.int64)]
            first, last = (byte_offsets(data, np.array(x, np.int64)) for x in (a, b))
            total.append(len(sizes))
            lengths.append(lengths[-1] + len(a))
            starts += a
            ends += b
            counts.append(allocate(sizes, first, last, rule))
        part = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.float64())], ["start", "end", "tokens"])
        return pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), part)], ["n_tokens", "parts"])

    out = fresh(docs, "tokens")
    kind = "n_tokens long, parts array<struct<start: long, end: long, tokens: double>>"
    if spans is None:
        return docs.withColumn(out, batch_udf(run, kind, F.col(text).cast("string"))), out
    return docs.withColumn(out, batch_udf(run, kind, F.col(text).cast("string"), F.col(spans))), out


def query(spark, sf_dir: str) -> DataFrame:
    """One row for each line of each document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, name = attributed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = out.select("doc_id", F.col(f"{name}.n_tokens").alias("doc_tokens"), F.posexplode_outer(f"{name}.parts").alias("section", "part"))
    return rows.select("doc_id", "doc_tokens", F.col("section").cast("long").alias("section"), F.col("part.start").alias("start_char"), F.col("part.end").alias("end_char"), F.col("part.tokens").cast("long").alias("n_tokens"))
