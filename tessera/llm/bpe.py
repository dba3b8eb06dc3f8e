"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

Leaf i of a piece's tree holds the rank of the pair that starts at byte i, paired with i, so that the
root is the leftmost pair of the lowest rank. A merge changes at most three leaves (the merged pair,
the pair before it, the absorbed position) and repairs their paths to the root. Short pieces are done
many at once, each numpy row a tree; long ones one by one with the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, batches, fresh

#: Pieces remembered, in each of two generations; frequent pieces survive in one or the other.
REMEMBERED = 150_000
#: Texts that are cut into pieces at once.
FEW = 200
#: Bytes up to which pieces are encoded together.
TOGETHER = 64
#: Stands for no pair; times TOGETHER it fits 32 bits.
_NONE = 1 << 24
#: Leaves of the trees that are worked on at once: they stay in the processor's cache.
AT_ONCE = 1 << 16


class Encoder:
    """Encodes pieces by ranks {bytes: id}; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.bytes = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("a rank file needs all 256 single bytes")
        pairs = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.rank = np.array([pairs.get(int(k), 0) for k in self.keys], np.int32)
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of pieces."""
        self.young: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.old: dict[str, tuple[str, tuple[int, ...]]] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(_NONE))

    def _many(self, pieces: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Pieces of 2 to `leaves` bytes, a power of two."""
        n, width = len(pieces), leaves + 1
        size = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte[data]
        live = np.arange(width)[None, :] < size[:, None]
        none = np.int32(_NONE * leaves)
        tree = np.full((n, 2 * leaves), none, np.int32)
        place = np.arange(leaves, dtype=np.int32)
        paired = live[:, 1:]
        tree[:, leaves:] = np.where(paired, self._ranks(token[:, :-1], token[:, 1:]) * np.int32(leaves) + place, none)
        for level in range(leaves.bit_length() - 2, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = tree[:, b : 2 * b].reshape(n, a, 2).min(axis=2)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        flat, tok, nxt, prv, alive = tree.ravel(), token.ravel(), after.ravel(), before.ravel(), live.ravel()
        rows = np.arange(n)
        while True:
            root = flat[rows * (2 * leaves) + 1]
            some = root < none
            rows, root = rows[some], root[some]
            if not len(rows):
                break
            rank, i = root // leaves, root % leaves
            base, end = rows * width, size[rows]
            j = nxt[base + i]
            k, p = nxt[base + j], prv[base + i]
            tok[base + i], nxt[base + i], alive[base + j] = rank, k, False
            has_k, has_p = k < end, p >= 0
            prv[(base + k)[has_k]] = i[has_k]
            top = rows * (2 * leaves)
            flat[top + leaves + np.minimum(j, leaves - 1)] = np.where(j < leaves, none, flat[top + 2 * leaves - 1])
            right = self._ranks(rank, tok[base + np.minimum(k, leaves)])
            flat[top + leaves + i] = np.where(has_k, right * np.int32(leaves) + i, none)
            q = np.maximum(p, 0)
            left = self._ranks(tok[base + q], rank)
            flat[(top + leaves + q)[has_p]] = (left * np.int32(leaves) + q)[has_p]
            spots = [leaves + i, leaves + np.minimum(j, leaves - 1), leaves + np.where(has_p, q, i)]
            for _ in range(leaves.bit_length() - 1):
                spots = [s >> 1 for s in spots]
                for s in spots:
                    at = top + 2 * s
                    flat[top + s] = np.minimum(flat[at], flat[at + 1])
        return [tuple(t[a].tolist()) for t, a in zip(token, live, strict=True)]

    def _long(self, piece: bytes) -> tuple[int, ...]:
        n, none, size = len(piece), 1 << 60, self.size
        leaves = 1 << max(1, (n - 1).bit_length())
        tok = [int(self.byte[b]) for b in piece]

        def at(i: int, j: int) -> int:
            key = tok[i] * size + tok[j]
            k = int(self.keys.searchsorted(key))
            return int(self.rank[k]) * leaves + i if k < len(self.keys) and self.keys[k] == key else none

        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = at(i, i + 1)
        for s in range(leaves - 1, 0, -1):
            tree[s] = min(tree[2 * s], tree[2 * s + 1])

        def put(i: int, value: int) -> None:
            s = leaves + i
            tree[s] = value
            while s > 1:
                s >>= 1
                low = min(tree[2 * s], tree[2 * s + 1])
                if tree[s] == low:
                    break
                tree[s] = low

        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while tree[1] < none:
            rank, i = divmod(tree[1], leaves)
            j = nxt[i]
            k, p = nxt[j], prv[i]
            tok[i], nxt[i], alive[j] = rank, k, False
            put(j, none)
            put(i, at(i, k) if k < n else none)
            if k < n:
                prv[k] = i
            if p >= 0:
                put(p, at(p, i))
        return tuple(t for t, a in zip(tok, alive, strict=True) if a)

    def pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece. A piece that is itself a token is that token."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for at, p in enumerate(pieces):
            if (one := self.ranks.get(p)) is not None:
                out[at] = (one,)
            elif len(p) > TOGETHER:
                out[at] = self._long(p)
            elif p:
                sizes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(at)
        for leaves, ats in sizes.items():
            for i in range(0, len(ats), step := AT_ONCE // leaves):
                part = ats[i : i + step]
                for at, ids in zip(part, self._many([pieces[x] for x in part], leaves), strict=True):
                    out[at] = ids
        return out

    def texts(self, texts: list[str | None], pattern) -> list[tuple[list[int], str]]:
        """Ids of each text, also as decimal numbers joined by commas."""
        cut = [pattern.findall(t) if t else [] for t in texts]
        known: dict[str, tuple[str, tuple[int, ...]]] = {}
        new = []
        young, old = self.young, self.old
        for p in set().union(*cut):
            hit = young.get(p)
            if hit is None and (hit := old.get(p)) is not None:
                young[p] = hit
            if hit is None:
                new.append(p)
            else:
                known[p] = hit
        for p, ids in zip(new, self.pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
            known[p] = hit = ",".join(map(str, ids)), ids
            if len(p) <= TOGETHER:
                young[p] = hit
        if len(young) >= REMEMBERED:
            self.old, self.young = young, {}
        out = []
        for c in cut:
            hits = list(map(known.__getitem__, c))
            out.append((list(chain.from_iterable([h[1] for h in hits])), ",".join([h[0] for h in hits])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def parse(data: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file's content."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    """Of a file shipped to executors; one for each worker process."""
    with open(SparkFiles.get(name), "rb") as f:
        return Encoder(parse(f.read()))


@lru_cache(maxsize=4)
def _pattern(pattern: str):
    return regex.compile(pattern)


def _ship(spark, path: str) -> str:
    """Give every executor the rank file; returns the name under which they find it."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = True) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned): n_tokens, ids, ids_sha256, decoded_sha256.

    path is a tiktoken rank file, pattern splits text into pieces that are encoded separately; text of
    special tokens is ordinary text. Null texts count as empty: no ids, and the digests of nothing.
    Texts of any length are encoded whole; of pairs of equal rank the leftmost merges first; ids play no
    part, and rows, repeated or not, are encoded each by itself; an empty table gives an empty result;
    other columns, whatever their names, pass through.
    """
    batches(docs.sparkSession)
    name = _ship(docs.sparkSession, path)

    def run(texts: pa.Array) -> pa.Array:
        enc, sizes, ids, said, back = _encoder(name), [], [], [], []
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for i in range(0, len(texts), FEW):
            for own, line in enc.texts(texts.slice(i, FEW).to_pylist(), _pattern(pattern)):
                sizes.append(len(own))
                ids.append(np.array(own, np.int32) if with_ids else None)
                said.append(sha(line.encode()))
                back.append(sha(enc.decode(own)))
        columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(said, pa.string()), pa.array(back, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    out = fresh(docs, "bpe")
    kind = "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.withColumn(out, batch_udf(run, kind, F.col(text).cast("string"), after=lambda: _encoder(name).forget())), out


def decoded(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with a new column `text`: the ids' bytes as UTF-8, broken sequences replaced; null for null ids. A column of that name is an error."""
    if text.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"df has a column {text}")
    name = _ship(df.sparkSession, path)

    def run(lists: pa.Array) -> pa.Array:
        enc = _encoder(name)
        return pa.array([None if x is None else enc.decode(x).decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return df.withColumn(text, batch_udf(run, "string", F.col(ids)))


def multi() -> tuple[str, str]:
    """The multilingual rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def digests(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens[, ids], ids_sha256, decoded_sha256)."""
    out, name = encoded(docs.select("doc_id", "text"), *multi(), with_ids=with_ids)
    return out.select("doc_id", *[F.col(f"{name}.{c}").alias(c) for c in ("n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256")])


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
