"""What several text operators share: reliable cut points, size-checked joins, tokenising."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.names import fresh
from tessera.storage import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "fresh"]

#: Rows up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Share of a table's rows from which a key is joined apart from others.
SHARE = 1 / 2000
#: Characters that separate words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


settle = cut


def small_or_shuffled(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df (already settled), marked for broadcast only if its row count is within the limit."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("merge")


def beside(left: DataFrame, right: DataFrame, key: str, most: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of left (settled) to right, which has one row a key, on a key of which some values may have much of left.

    Where right is known to have `most` rows, and they are within the limit, it is broadcast. Otherwise
    values with a share of SHARE or more of left, at most 1 / SHARE of them, are joined by a broadcast of
    right's rows for them; the others by a shuffle, in which none of them is then large.
    """
    if most is not None and most <= limit:
        return left.join(F.broadcast(right), key)
    n = left.count()
    much = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= max(n * SHARE, 2)).select(key)
    much = settle(much)
    hot = left.join(F.broadcast(much), key, "left_semi").join(F.broadcast(right.join(F.broadcast(much), key, "left_semi")), key)
    return hot.unionByName(left.join(F.broadcast(much), key, "left_anti").join(right, key))


def batches(spark: SparkSession, records: int = 1000, size: int = 4 << 20) -> None:
    """Bound what one Arrow batch of texts holds: lowers two options of the session where they are higher, as a plan reads them when it runs."""
    for name, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", size)):
        option = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(option)).removesuffix("b"))
        if not 0 < now <= most:
            spark.conf.set(option, str(most))


_LIBC = ctypes.CDLL(ctypes.util.find_library("c") or None)


def tidy() -> None:
    """Give freed memory back to the system, as worker processes stay for a while after a task."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidied(f: Callable) -> Callable:
    """f, a generator function over a task's batches, with tidy() at its end."""

    def run(it):
        try:
            yield from f(it)
        finally:
            tidy()

    return run


def tidied_group(f: Callable) -> Callable:
    """f, a function of a group's frame, with tidy() after large groups."""

    def run(pdf):
        n = len(pdf)
        out = f(pdf)
        del pdf
        if n > 64:
            tidy()
        return out

    return run


def batch_udf(f: Callable, kind: str, *columns: Column | str, after: Callable[[], None] | None = None) -> Column:
    """f of Arrow arrays, batch by batch; `after` and tidy() run when a task is done."""

    def end() -> None:
        if after is not None:
            after()
        tidy()

    def one(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for x in it:
                yield f(x)
        finally:
            end()

    def more(it: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        try:
            for xs in it:
                yield f(*xs)
        finally:
            end()

    return F.arrow_udf(one if len(columns) == 1 else more, kind)(*columns)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than SPACES (bytes.split() separates at exactly these)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ascii_lower(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and everything else kept."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hash(h: np.ndarray, k: int, mul: np.uint64 = _MUL) -> np.ndarray:
    """Hash of every run of k values: a polynomial built by doubling, then mixed. Empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, base, width, power, left = None, 0, h, 1, mul, k
    with np.errstate(over="ignore"):
        while left:  # base holds hashes of `width` values, power is mul ** width
            if left & 1:
                piece = base[have : have + n]
                out = piece.copy() if out is None else out * power + piece
                have += width
            left >>= 1
            if left:
                base = base[: len(base) - width] * power + base[width:]
                power, width = power * power, width * 2
        return mix(out)


def flat_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """All words of a batch: code of each word in order, the distinct words, and where each text's words start (one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = _lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    real = lengths > 0
    starts = np.concatenate([[0], np.cumsum(real)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).cast(pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), starts.astype(np.int64)


def _lower(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased in the arrays' own bytes; UTF-8 lead and continuation bytes are never in that range."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data), offset=texts.offset)


def word_hashes(dictionary: list[bytes]) -> np.ndarray:
    """64-bit hash of each distinct word, the same in every process."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary), np.uint64, len(dictionary))
