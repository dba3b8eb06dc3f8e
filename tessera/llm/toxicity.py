"""Toxicity by compression distance: windows of a text are compressed with a zstandard dictionary of
ordinary text and with one of toxic text, and what the second saves is the evidence.

Both dictionaries are trained by zstandard, one on windows of ordinary documents and one, of short
segments, on whole toxic documents. There a document is one sample, so a string counts by the documents
that hold it, and what toxic documents share outweighs what is frequent in all. The toxic dictionary is
followed by the ordinary one, so that common language costs the same with either and only toxic text
makes a difference. How much has to be saved is calibrated on labelled documents that the dictionaries
have not seen, at the rate of toxic documents among all labelled ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, batch_udf, batches, settle

#: Bound of the labelled sample that the model is fitted on: documents of each class (those with the
#: least hashes of their ids) and characters of each.
SAMPLE = {1: 2000, 0: 4000}
SAMPLE_CHARS = 16_384
#: Bytes of a window (it ends with the word that reaches them), of the ordinary and of the toxic dictionary.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 64, 65_536, 2048
#: Of the toxic dictionary's training: bytes of a segment and of the strings counted in it (short, as few words of a toxic text are toxic).
SEGMENT, MATCH = 16, 6
#: Level of compression, and bytes of the shortest match.
LEVEL, SHORTEST = 6, 4


def windows(text: str | None) -> list[bytes]:
    """Consecutive words, lower-cased, at least WINDOW bytes of them (fewer in the last); a longer word is cut at WINDOW bytes. None without words."""
    out, now, size = [], [], 0
    for w in ascii_lower(text).split():
        for i in range(0, len(w), WINDOW):
            piece = w[i : i + WINDOW]
            now.append(piece)
            size += len(piece) + 1
            if size >= WINDOW:
                out.append(b" " + b" ".join(now) + b" ")
                now, size = [], 0
    if now:
        out.append(b" " + b" ".join(now) + b" ")
    return out


def trained(samples: list[bytes], size: int, **how) -> bytes:
    """A zstandard dictionary of at most about `size` bytes; the last samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    """Two raw dictionaries and the weights that turn savings into a probability."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(self, t) for t in texts], float).reshape(-1, len(self.weights) - 1)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[1:]) + self.weights[0], -30, 30)))


@lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=SHORTEST, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)


def features(m: Model, text: str | None) -> list[float]:
    """Of the bytes saved in each window: the most, the mean of the two and of the five highest, the mean; all 0 without windows."""
    ws = windows(text)
    if not ws or not m.toxic:
        return [0.0] * 4
    a, b = _compressor(m.ordinary).compress, _compressor(m.toxic + m.ordinary).compress
    saved = np.sort(np.fromiter((len(a(w)) - len(b(w)) for w in ws), float, len(ws)))[::-1]
    return [saved[0], saved[:2].mean(), saved[:5].mean(), saved.mean()]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Intercept and weights by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w)) * len(x) / 100
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def own_lines(texts: list[str], others: list[str]) -> list[bytes]:
    """Each text's lines that neither others nor an earlier text has, as one sample: so that neither boilerplate nor copies look common."""
    split = lambda t: [b" " + b" ".join(x.split()) + b" " for x in ascii_lower(t).split(b"\n")]
    seen = {x for t in others for x in split(t)}
    out = []
    for t in texts:
        lines = [x for x in split(t) if x not in seen]
        seen.update(lines)
        out.append(b"".join(lines))
    return [x for x in out if x.strip()]


def fit(rows: list[tuple[str, int]], odds: float | None = None) -> Model:
    """A model of (text, toxic) rows: dictionaries from two thirds of them, calibration on the others. odds: toxic to ordinary documents where rows are not in proportion. With one class only, the score is its share everywhere."""
    if len({y for _, y in rows}) < 2:
        share = np.clip(np.mean([y for _, y in rows]) if rows else 0.0, 1e-3, 1 - 1e-3)
        return Model(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0))
    learn, rest = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    whole = own_lines([t for t, y in learn if y], [t for t, y in learn if not y])
    base = trained([w for t, y in learn if not y for w in windows(t)], ORDINARY_BYTES)
    m = Model(base, trained(whole, TOXIC_BYTES, k=SEGMENT, d=MATCH), (0.0,) * 5)
    x, y = np.array([features(m, t) for t, _ in rest], float), np.array([y for _, y in rest], float)
    first, *more = _logistic(x, y)
    if odds and 0 < y.sum() < len(y):
        first += math.log(odds) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(m.ordinary, m.toxic, (first, *more))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[tuple[str, int]], float | None]:
    """The bounded sample of labelled rows, in an order that mixes classes, and the odds of toxic among all labels; conflicting or null labels don't count."""
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2 and y in (0, 1)")
    ones, n = known.agg(F.sum("y"), F.count(F.lit(1))).first()
    few = docs.select(doc_id, F.col(text).cast("string").alias("t")).where(F.char_length("t") <= SAMPLE_CHARS)
    # ids are sampled first and generously, as some have no or too long a text
    picked = settle(reduce(DataFrame.union, [known.where(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(2 * n) for y, n in SAMPLE.items()]).select(doc_id, "y"))
    found = settle(few.join(F.broadcast(picked), doc_id).select("y", "t", F.xxhash64(doc_id).alias("h")))
    got = [found.where(F.col("y") == y).orderBy("h", "t").limit(n).collect() for y, n in SAMPLE.items()]
    rows = [(r.t, int(r.y)) for r in sorted((r for part in got for r in part), key=lambda r: (r.h, r.t))]
    return rows, ones / (n - ones) if ones and n > ones else None


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability, in a new column `name`, that each whole text is toxic, however long it is.

    Null and empty texts get the score of no evidence; rows, repeated or not, are scored by their text
    alone; a table without rows gives none; other columns pass through. A column of that name is an error.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}")
    batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts.to_pylist()), pa.float64())

    return docs.withColumn(name, batch_udf(run, "double", F.col(text).cast("string")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    out = scored(docs, fit(*sample(docs, labels)))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
