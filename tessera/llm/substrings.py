"""Substring deduplication over words by fixed-block anchors.

Reference blocks are the non-overlapping 10-word blocks of every document; every rolling 10-word
window probes them. Any 20-word window holds a whole reference block, so both sides of a repeated
window have a hit inside. Hits are then extended: the 20-word windows around them are compared in
full (by 96 bits of hash), and overlapping repeated windows merge into maximal repeats, of which every
occurrence but the earliest goes.

Both comparisons are exchanges of packed arrays. Documents travel in flushes: a flush sends each part of
the hash range one row with the windows that belong there, and gets back the places that matched. A
window that a flush has several times is sent once, for the first of its places, and the flush keeps
the others, so no part grows with the frequency of a passage. Parts hold about as many windows at any
size of input. What a row holds shrinks when both flushes and parts are many, so FLUSH_BYTES and
PART_CHARS, which bound a task's memory, are worth raising for inputs of several TB.
"""

from __future__ import annotations

import hashlib
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, batches, flat_words, fresh, mix, settle, small_or_shuffled, tidied, tidied_group, window_hash, word_hashes, words

#: Words of a window that may not repeat, and of a block; 2 * BLOCK - 1 <= WINDOW + 1 words.
WINDOW, BLOCK = 20, 10
#: Bytes of text in a flush, and characters of text to each part of the hash range.
FLUSH_BYTES, PART_CHARS = 8_000_000, 12_000_000
_SECOND = np.uint64(0xD6E8FEB86659FD93)
_NOTHING = np.empty(0, np.int64)
_SENT = "chunk long, part long, asks binary, head binary"
_GOT = "chunk long, head binary, place binary"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _places(x: np.ndarray) -> bytes:
    """Ascending uint32 places as gaps."""
    return _pack(np.diff(x, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _places_back(b: bytes) -> np.ndarray:
    raw = _unpack(b, np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.int64) if len(raw) else np.empty(0, np.int64)


def _spans(at: np.ndarray, width: int) -> np.ndarray:
    """(start, end) rows of the union of [i, i + width) for ascending i."""
    if not len(at):
        return np.empty((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > width)
    return np.column_stack([at[np.concatenate([[0], cut + 1])], at[np.append(cut, len(at) - 1)] + width])


def _parts(h: np.ndarray, parts: int):
    """(part, rows) for each part that has windows, rows in their order."""
    part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts < 65536 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "part", "asks", "head"])


def _short(h: np.ndarray) -> np.ndarray:
    """The lower 32 bits: within a part, which is of a fixed size, enough for a filter."""
    return h.astype(np.uint32)


def _numbers(x: np.ndarray) -> bytes:
    """uint32 as byte planes."""
    return _pack(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _numbers_back(b: bytes) -> np.ndarray:
    raw = _unpack(b, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel() if len(raw) else np.empty(0, np.uint32)


def _flushes(it):
    """Batches (id, text, ...) put together: a number, ids, word hashes in a row, starts, k1, k2, and the further columns' values."""
    first, n, some, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def together():
        lengths = [len(x[1]) for x in some]
        at = np.concatenate([[0], np.cumsum(lengths)])
        starts = np.concatenate([*[x[2][:-1] + a for x, a in zip(some, at, strict=False)], at[-1:]])
        return first + n, *[np.concatenate([x[i] for x in some]) for i in (0, 1)], starts, *[np.concatenate([x[i] for x in some]) for i in (3, 4)], [v for x in some for v in x[5]]

    for b in it:
        if b.num_rows:
            h, starts, k1, k2 = _sequences(b.column(1))
            more = b.column(2).to_pylist() if b.num_columns > 2 else []
            some.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), h, starts, k1, k2, more))
            size += b.column(1).nbytes
        if size >= FLUSH_BYTES:
            yield together()
            n, some, size = n + 1, [], 0
    if some:
        yield together()


def _head(ids: np.ndarray, k1: np.ndarray, k2: np.ndarray, starts: np.ndarray, known: np.ndarray, rep: np.ndarray, also: np.ndarray) -> bytes:
    """What a flush keeps: its documents, places known to match, and for places asked for those of equal windows."""
    return pickle.dumps((_pack(np.concatenate([ids.view(np.uint64), k1, k2, starts.astype(np.uint64)])), _places(known.astype(np.uint32)), _numbers(rep), _numbers(also)))


def _sequences(texts: pa.Array):
    """Of a batch: word hashes in a row, where each document's start, and two keys of each document's whole sequence."""
    codes, dictionary, starts = flat_words(texts)
    h = word_hashes(dictionary)[codes]
    turn = np.arange(len(h), dtype=np.uint64) - np.repeat(starts[:-1], np.diff(starts)).astype(np.uint64)
    keyed = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h + turn * m), dtype=np.uint64)]) for m in (np.uint64(0x9E3779B97F4A7C15), _SECOND)]
    return h, starts, *[c[starts[1:]] - c[starts[:-1]] for c in keyed]


def _whole(starts: np.ndarray, k: int) -> np.ndarray:
    """Places in the row where a k-word window lies in one document."""
    n = np.diff(starts)
    first, count = starts[:-1], np.maximum(n - k + 1, 0)
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _probe(parts: int):
    """Every 10-word window, once a flush; those that the flush knows to match, and to be a reference block, are told and not asked."""

    def run(it):
        for chunk, ids, h, starts, k1, k2, _ in _flushes(it):
            n = np.diff(starts)
            at = _whole(np.concatenate([[0], np.cumsum(np.where(n >= WINDOW, n, 0))]), BLOCK)
            real = np.flatnonzero(np.repeat(n >= WINDOW, n))
            at = real[at]  # windows of documents that are long enough
            w = window_hash(h, BLOCK)[at] if len(at) else np.empty(0, np.uint64)
            flag = (at - np.repeat(starts[:-1], n)[at]) % BLOCK == 0
            order = np.argsort(w)
            new = np.ones(len(w), bool)
            new[1:] = w[order][1:] != w[order][:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(w)))
            any_flag = np.bitwise_or.reduceat(flag[order], first) if len(first) else np.empty(0, bool)
            known = np.repeat((count > 1) & any_flag, count)
            later = ~new & ~known
            rep = order[np.repeat(first, count)]
            yield _rows([(chunk, -1 - chunk, None, _head(ids, k1, k2, starts, np.sort(at[order[known]]), at[rep[later]], at[order[later]]))])
            told, some = w[order[first[(count > 1) & any_flag]]], np.sort(order[first[(count == 1) | ~any_flag]])
            asks, tells = dict(_parts(w[some], parts)), dict(_parts(told, parts))
            for p in sorted(asks.keys() | tells.keys()):
                x, t = some[asks.get(p, _NOTHING)], told[tells.get(p, _NOTHING)]
                yield _rows([(chunk, p, pickle.dumps((_short(w[x]).tobytes(), _places(at[x].astype(np.uint32)), np.packbits(flag[x]).tobytes(), _short(t).tobytes())), None)])

    return run


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places whose block hash occurs at least twice in the part, once or more as a reference block. Equal windows of a flush are one."""
    if pdf.part.iloc[0] < 0:
        return pd.DataFrame({"chunk": pdf.chunk, "head": pdf["head"], "place": None})
    got, out = [pickle.loads(a) for a in pdf.asks], []
    code, told = np.frombuffer(b"".join(x[0] for x in got), np.uint32), np.frombuffer(b"".join(x[3] for x in got), np.uint32)
    sizes = np.array([len(x[0]) // 4 for x in got])
    flag = np.concatenate([np.unpackbits(np.frombuffer(x[2], np.uint8), count=n) for x, n in zip(got, sizes, strict=True)]).astype(bool)
    ref = np.sort(np.concatenate([code[flag], told]))
    # a reference block answers others if it occurs twice in all, itself included
    every = np.sort(np.concatenate([code, told]))
    at = np.searchsorted(ref, code)
    hit = (at < len(ref)) & (ref[np.minimum(at, len(ref) - 1)] == code) if len(ref) else np.zeros(len(code), bool)
    some = np.flatnonzero(hit)
    hit[some] = np.searchsorted(every, code[some], "right") - np.searchsorted(every, code[some]) > 1
    for chunk, x, h in zip(pdf.chunk, got, np.split(hit, np.cumsum(sizes)[:-1]), strict=True):
        if h.any():
            out.append((chunk, None, _places(_places_back(x[1])[h].astype(np.uint32))))
    return pd.DataFrame(out, columns=["chunk", "head", "place"])


def _gathered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a flush and all its places: known, answered, and equal to those answered."""
    head, known, rep, also = pickle.loads(pdf["head"].dropna().iloc[0])
    got = np.unique(np.concatenate([np.empty(0, np.int64), *[_places_back(x) for x in pdf["place"].dropna()]]))
    rep, also = _numbers_back(rep).astype(np.int64), _numbers_back(also).astype(np.int64)
    return _unpack(head, np.uint64), np.unique(np.concatenate([_places_back(known), got, also[np.isin(rep, got)]]))


def _by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each document of a flush: its keys, and the spans of block hits in it."""
    head, at = _gathered(pdf)
    n = (len(head) - 1) // 4
    ids, k1, k2, starts = head[:n].view(np.int64), head[n : 2 * n], head[2 * n : 3 * n], head[3 * n :].astype(np.int64)
    bounds = np.searchsorted(at, starts)
    hits = [_spans(at[a:b] - s, 1).astype(np.uint32) for a, b, s in zip(bounds[:-1], bounds[1:], starts[:-1], strict=True)]
    return pd.DataFrame({"doc_id": ids, "k1": k1.view(np.int64), "k2": k2.view(np.int64), "n_words": np.diff(starts), "hits": [x.tobytes() if len(x) else None for x in hits]})


def _extend(parts: int):
    """Windows that hold a hit, once a flush, with the document and the turn that order them. Where a flush has a window again, that is later for sure."""

    def run(it):
        for chunk, ids, h, starts, k1, k2, each in _flushes(it):
            hits = _pick(zip(k1.view(np.int64).tolist(), k2.view(np.int64).tolist(), strict=True), each, "hits")
            want = np.zeros(len(h) + 1, np.int64)
            for spans, s, e in zip(hits, starts[:-1], starts[1:], strict=True):
                for a, z in np.frombuffer(spans or b"", np.uint32).reshape(-1, 2).astype(np.int64):
                    # a window holds the block at i if it starts in [i - (WINDOW - BLOCK), i]
                    want[max(s + a - (WINDOW - BLOCK), s)] += 1
                    want[min(s + z, e)] -= 1
            at = _whole(starts, WINDOW)
            at = at[np.cumsum(want)[at] > 0]
            if len(at):
                w, v = window_hash(h, WINDOW)[at], (window_hash(h, WINDOW, _SECOND)[at] >> np.uint64(32)).astype(np.uint32)
            else:
                w, v = np.empty(0, np.uint64), np.empty(0, np.uint32)
            doc = np.searchsorted(starts, at, "right") - 1
            turn = at - starts[doc]
            order, first = _firsts(w, v, ids[doc], turn)
            mine = order == first
            later = (ids[doc][order] != ids[doc][first]) | (turn[order] != turn[first])
            same = ~mine & ~later  # of repeated ids
            yield _rows([(chunk, -1 - chunk, None, _head(ids, k1, k2, starts, np.sort(at[order[later]]), at[first[same]], at[order[same]]))])
            some = np.sort(order[mine])
            for p, x in _parts(w[some], parts):
                x = some[x]
                docs, code = np.unique(doc[x], return_inverse=True)
                yield _rows([(chunk, p, pickle.dumps((w[x].tobytes(), v[x].tobytes(), _places(at[x].astype(np.uint32)), _numbers(turn[x]), _numbers(code), _pack(ids[docs]))), None)])

    return run


def _firsts(low: np.ndarray, high: np.ndarray, ids: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by window, id and turn, and for each the first row of its window."""
    order = np.lexsort((turns, ids, high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
    return order, order[np.flatnonzero(new)][np.cumsum(new) - 1]


def _first_wins(pdf: pd.DataFrame) -> pd.DataFrame:
    """Places of the windows of a part that also start earlier: in a smaller id, or earlier in the same."""
    if pdf.part.iloc[0] < 0:
        return pd.DataFrame({"chunk": pdf.chunk, "head": pdf["head"], "place": None})
    got, out = [pickle.loads(a) for a in pdf.asks], []
    low, high = np.frombuffer(b"".join(x[0] for x in got), np.uint64), np.frombuffer(b"".join(x[1] for x in got), np.uint32)
    turns = np.concatenate([_numbers_back(x[3]) for x in got]).astype(np.int64)
    ids = np.concatenate([_unpack(x[5], np.int64)[_numbers_back(x[4])] for x in got])
    order, first = _firsts(low, high, ids, turns)
    later = np.zeros(len(order), bool)
    later[order] = (ids[order] != ids[first]) | (turns[order] != turns[first])
    for chunk, x, hit in zip(pdf.chunk, got, np.split(later, np.cumsum([len(x[1]) // 4 for x in got])[:-1]), strict=True):
        if hit.any():
            out.append((chunk, None, _places(_places_back(x[2])[hit].astype(np.uint32))))
    return pd.DataFrame(out, columns=["chunk", "head", "place"])


def _cuts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Each document of a flush that loses words: the spans of its repeated windows, merged."""
    head, at = _gathered(pdf)
    n = (len(head) - 1) // 4
    ids, k1, k2, starts = head[:n].view(np.int64), head[n : 2 * n].view(np.int64), head[2 * n : 3 * n].view(np.int64), head[3 * n :].astype(np.int64)
    bounds = np.searchsorted(at, starts)
    rows = [(ids[i], k1[i], k2[i], _spans(at[a:b] - starts[i], WINDOW).astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    return pd.DataFrame(rows, columns=["doc_id", "k1", "k2", "cuts"])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, cuts): for each id with words to remove, an array of (k1, k2, cuts), the key of the text
    that loses them and its word spans as uint32 pairs."""
    batches(docs.sparkSession)
    docs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, math.ceil(chars / PART_CHARS))
    sent = docs.mapInArrow(tidied(_probe(parts)), _SENT)
    hit = sent.groupBy("part").applyInPandas(tidied_group(_meet), _GOT)
    found = settle(hit.groupBy("chunk").applyInPandas(tidied_group(_by_document), "doc_id long, k1 long, k2 long, n_words long, hits binary").where(F.col("n_words") >= WINDOW))
    # of documents of equal words only those of the smallest id can hold a first occurrence; the others go whole
    key = ["k1", "k2", "n_words"]
    many = settle(found.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    at = found.where("hits is not null").join(small_or_shuffled(many), key, "left")
    whole = at.where(F.col("doc_id") > F.col("first")).select("doc_id", "k1", "k2", _span_of("n_words").alias("cuts"))
    left = at.where(F.col("first").isNull() | (F.col("doc_id") == F.col("first")))
    left = settle(left.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2", "hits")).alias("each")))
    with_text = docs.join(left, "doc_id").select("doc_id", "text", "each")
    parts = max(8, math.ceil(parts / 2))
    sent = with_text.mapInArrow(tidied(_extend(parts)), _SENT)
    cut = sent.groupBy("part").applyInPandas(tidied_group(_first_wins), _GOT).groupBy("chunk").applyInPandas(tidied_group(_cuts), "doc_id long, k1 long, k2 long, cuts binary")
    return cut.union(whole).groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2", "cuts")).alias("cuts"))


def _span_of(n: str):
    """The span (0, n) in the bytes of two little-endian uint32."""
    return batch_udf(lambda x: pa.array([np.array([0, v], np.uint32).tobytes() for v in x.to_pylist()], pa.binary()), "binary", n)


def _keys(texts: pa.Array) -> list[tuple[int, int]]:
    _, _, k1, k2 = _sequences(texts)
    return list(zip(k1.view(np.int64).tolist(), k2.view(np.int64).tolist(), strict=True))


def _pick(keys, each, field: str) -> list[bytes | None]:
    """What belongs to each text among what its id has; ids are rarely shared by different texts."""
    return [next((x[field] for x in xs or () if (x["k1"], x["k2"]) == k), None) for k, xs in zip(keys, each, strict=True)]


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "repeats", with_text: bool = True) -> DataFrame:
    """docs with a new struct column `name`: n_words, n_removed, kept (the words left, joined by a space) and kept_sha256.

    A word goes if a 20-word window of its document covers it whose words also start earlier, in a
    document with a smaller id or before it in the same. Null and empty texts have no words; rows with
    a null id neither lose words nor make others lose any; of rows that repeat an id neither is earlier
    at the same place, so equal rows lose the same words; texts count whole, one longer than a flush
    being a flush; an empty table gives an empty result; other columns pass through. A column of that
    name is an error.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}")
    cut_id, cut_at = fresh(docs, "cut_id"), fresh(docs, "cuts")
    found = settle(repeats(docs, doc_id, text).withColumnsRenamed({"doc_id": cut_id, "cuts": cut_at}))
    out = docs.join(found, docs[doc_id] == found[cut_id], "left")

    def run(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        given = cuts.to_pylist()
        some = [i for i, c in enumerate(given) if c]
        spans: list[bytes | None] = [None] * len(given)
        if some:
            sub = texts.take(pa.array(some))
            for i, s in zip(some, _pick(_keys(sub), [given[i] for i in some], "cuts"), strict=True):
                spans[i] = s
        n, gone, kept, sha = [], [], [], []
        for t, s in zip(texts.to_pylist(), spans, strict=True):
            ws = words(t)
            n.append(len(ws))
            if s:
                keep, at = [], 0
                for a, z in np.frombuffer(s, np.uint32).reshape(-1, 2).tolist():
                    keep += ws[at:a]
                    at = z
                ws = keep + ws[at:]
            line = b" ".join(ws)
            gone.append(n[-1] - len(ws))
            kept.append(line.decode("utf-8", "surrogatepass") if with_text else None)
            sha.append(hashlib.sha256(line).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], ["n_words", "n_removed", "kept", "kept_sha256"])

    kind = "n_words long, n_removed long, kept string, kept_sha256 string"
    return out.withColumn(name, batch_udf(run, kind, F.col(text).cast("string"), F.col(cut_at))).drop(cut_id, cut_at)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs, with_text=False).select("doc_id", *[F.col(f"repeats.{c}").alias(c) for c in ("n_words", "n_removed", "kept_sha256")])
