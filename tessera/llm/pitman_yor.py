"""A hierarchical Pitman-Yor language model, fitted by Gibbs sampling and used for perplexity.

A token's context is the word before it (or the start of its document). Each context is a restaurant,
as many as the corpus has distinct words; all share a parent, the root, whose base is uniform over the
known words with a share for unknown ones. A table of a context's restaurant is a customer of the root.

Documents travel in flushes. A flush counts its distinct pairs (context, word) and sends each part of
the hash range those that belong there, once each however often they occur. A part holds whole
contexts; contexts with a large share of all tokens are spread over the parts by pair, so no part grows
with the frequency of a word. Parts keep seats: the number of tables of each pair, redrawn from its
conditional distribution given all others' (t tables of c customers have weight S(c, t), generalised
Stirling numbers, exact up to 64 customers and by a saddle point beyond). Between rounds parts tell the
owners of words, another hash range, how many tables they have of each word; owners seat the root and
answer with its counts, as they do for contexts that are spread. Discounts follow the numbers of
singletons, concentrations are sampled. In the last round each part averages predictive probabilities
over several samples and answers each flush for each pair; the flush's documents add them up.

Everything travels as packed arrays; what a row holds shrinks when both flushes and parts are many, so
FLUSH_CHARS and PART_CHARS, which bound a task's memory, are worth raising for inputs of several TB.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, flat_words, mix, settle, tidied, tidied_group, word_hashes

#: Bytes of text in a flush, and characters of text to a part.
FLUSH_CHARS, PART_CHARS = 16_000_000, 16_000_000
#: A context is spread if it has this share of a part's tokens; at most 4 / (3 * SPREAD) contexts a part are.
SPREAD = 0.5
#: Sweeps before the second exchange, sweeps after it before samples are taken, and samples.
BURN, AGAIN, SAMPLES = 3, 1, 4
#: Customers up to which table numbers are drawn exactly.
EXACT = 64
#: Parts of a part's pairs that are redrawn at once, the totals following in between.
TURNS = 2
#: log10 probabilities travel as multiples of this, in 16 bits: rounded by 0.03 % of the probability at most.
UNIT = 2.0**-12
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = 56
_END, _START = np.uint64(0x5EED0FE2D00001), np.uint64(0x5EED0FE2D00002)
_ROW = "part long, kind long, a binary, b binary, stats array<double>"
_NAMES = ["part", "kind", "a", "b", "stats"]
_CELLS, _SEATS = -1, -2


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: small numbers and repeated bytes cost little."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if len(raw) else np.empty(0, kind)


def _rising(x: np.ndarray) -> bytes:
    """An ascending array as gaps."""
    return _pack(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def _risen(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _range(key: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Which of n equal ranges of `bits`-bit hashes each is in."""
    return (((key >> np.uint64(bits - 32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch: the hashes of all tokens, each document's words and then its end, and how many each has."""
    codes, dictionary, starts = flat_words(texts, lower=True)
    sizes = np.diff(starts) + 1
    is_word = np.ones(int(sizes.sum()), bool)
    is_word[np.cumsum(sizes) - 1] = False
    token = np.full(len(is_word), _END)
    token[is_word] = (word_hashes(dictionary) >> np.uint64(64 - _BITS))[codes]
    return token, sizes


def _before(token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The context of each token."""
    ctx = np.empty_like(token)
    ctx[1:] = token[:-1]
    ctx[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = _START
    return ctx


def _pairs(ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ctx * _MUL + word)


def _flushes(it):
    """Batches (id, held, text) put together: ids, held, tokens and sizes of about FLUSH_CHARS."""
    some, size = [], 0
    for b in it:
        if b.num_rows:
            some.append((b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(bool), *_tokens(b.column(2))))
            size += b.column(2).nbytes
        if size >= FLUSH_CHARS:
            yield [x for s in some for x in s[0]], *[np.concatenate([s[i] for s in some]) for i in (1, 2, 3)]
            some, size = [], 0
    if some:
        yield [x for s in some for x in s[0]], *[np.concatenate([s[i] for s in some]) for i in (1, 2, 3)]


def _heavy(share: float):
    """(context, n) of each flush for contexts with a quarter of the share; what is left out is under a quarter of it in all. With a null: all tokens."""

    def run(it):
        for _, _, token, sizes in _flushes(it):
            key, n = np.unique(_before(token, sizes), return_counts=True)
            some = n >= share / 4 * len(token)
            yield pa.RecordBatch.from_arrays([pa.array([None, *key[some].astype(np.int64).tolist()], pa.int64()), pa.array([len(token), *n[some].tolist()], pa.int64())], names=["ctx", "n"])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _send(parts: int, spread: np.ndarray):
    """Each flush's pairs, a row for each part that has any, and a row of its own: who its documents are and which pairs they have."""

    def run(it):
        first = TaskContext.get().partitionId() << 32
        for n, (ids, held, token, sizes) in enumerate(_flushes(it)):
            ctx = _before(token, sizes)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pair, at, entry = np.unique(_pairs(ctx, token), return_index=True, return_inverse=True)
            learn = np.bincount(entry, ~held[doc], len(pair)).astype(np.uint32)
            ctx, word = ctx[at], token[at]
            part = _range(np.where(np.isin(ctx, spread), pair, mix(ctx)), parts)
            order = np.lexsort((word, ctx, part))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # each document's pairs in ascending order, as gaps
            own = np.sort((doc << 32) | rank[entry]) & 0xFFFFFFFF
            gaps = np.diff(own, prepend=0)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            gaps[starts] = own[starts]
            chunk = first + n
            yield _rows([(-1 - chunk, chunk, pickle.dumps((ids, held, sizes, len(pair))), _pack(gaps.astype(np.uint32)), None)])
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                some = order[cut[p] : cut[p + 1]]
                keys, runs = np.unique(ctx[some], return_counts=True)
                words, code = np.unique(word[some], return_inverse=True)
                yield _rows([(p, chunk, pickle.dumps((_rising(keys), _pack(runs.astype(np.uint32)), _rising(words), _pack(code.astype(np.uint32)), _pack(learn[some]))), None, None)])

    return run


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's pairs with their customers, and which of them each flush asks for. A flush's own row passes through."""
    if pdf.part.iloc[0] < 0:
        return pdf
    got = [pickle.loads(a) for a in pdf.a]
    ctx = np.concatenate([np.repeat(_risen(x[0]), _unpack(x[1], np.uint32)) for x in got])
    word = np.concatenate([_risen(x[2])[_unpack(x[3], np.uint32)] for x in got])
    learn = np.concatenate([_unpack(x[4], np.uint32) for x in got])
    sizes = [len(_unpack(x[3], np.uint32)) for x in got]
    del got
    _, at, entry = np.unique(_pairs(ctx, word), return_index=True, return_inverse=True)
    customers = np.bincount(entry, learn, len(at)).astype(np.uint32)
    order = np.lexsort((word[at], ctx[at]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    asked = [(c, _pack(np.diff(x, prepend=0).astype(np.uint32))) for c, x in zip(pdf.kind, np.split(rank[entry], np.cumsum(sizes)[:-1]), strict=True)]
    keys, runs = np.unique(ctx[at], return_counts=True)
    words, code = np.unique(word[at][order], return_inverse=True)
    c = customers[order]
    cells = pickle.dumps((_rising(keys), _pack(runs.astype(np.uint32)), _rising(words), _pack(code.astype(np.uint32)), _pack(c)))
    stats = [float((c == 1).sum()), float((c == 2).sum()), float(c.sum()), float((c > 0).sum())]
    return pd.DataFrame([(pdf.part.iloc[0], _CELLS, cells, pickle.dumps(asked), stats)], columns=_NAMES)


@dataclass(frozen=True)
class Shared:
    """What all parts know: numbers of tokens and words, the root's tables and customers, and the parameters."""

    tokens: float
    words: float
    tables: float
    customers: float
    discount: float  # of contexts
    root_discount: float
    theta: float = 1.0  # concentration of contexts
    root_theta: float = 1.0
    unknown: float = 0.5  # the base's share of unknown words


def log_stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t <= n: S(c, t) = S(c-1, t-1) + (c - 1 - d t) S(c-1, t)."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, n + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = np.where(t < c, np.log(np.maximum(c - 1 - d * t, 1e-300)) + s[c - 1, 1 : c + 1], -np.inf)
        s[c, 1 : c + 1] = np.logaddexp(s[c - 1, :c], stay)
    return s


def draw_tables(c: np.ndarray, p: np.ndarray, rest: np.ndarray, theta: float, d: float, rng: np.random.Generator, table: np.ndarray, mass: float = math.inf) -> np.ndarray:
    """Tables t of c customers, given the parent's probability p of the dish and `rest` other tables of the
    restaurant: weight S(c, t) times the product of (theta + d (rest + i)) p_i over i < t. A new table is a
    customer of the parent, whose mass so grows by one: p_i = (mass p + i) / (mass + i). 0 for no customers."""
    t = np.minimum(c, 1).astype(np.int64)
    log_p = np.log(np.maximum(p, 1e-300))
    small = np.flatnonzero((c >= 2) & (c <= EXACT))
    order = small[np.argsort(c[small], kind="stable")]
    for at in np.split(order, np.flatnonzero(np.diff(c[order])) + 1) if len(order) else []:
        n = int(c[at[0]])
        i = np.arange(n)
        step = np.log(theta + d * (rest[at, None] + i)) + (log_p[at, None] if math.isinf(mass) else np.log((mass * np.maximum(p[at, None], 1e-300) + i) / (mass + i)))
        log = np.cumsum(step, axis=1) + table[n, 1 : n + 1]
        upto = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
        t[at] = 1 + (upto < (rng.random(len(at)) * upto[:, -1])[:, None]).sum(axis=1)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        # tables are a Poisson number of Sibuya sizes given their sum; y = 1 - x tilts the mean sum to c
        n, w = c[big].astype(float), np.maximum((theta + d * (rest[big] + 1)) * p[big], 1e-300)
        lo, hi = np.full(len(big), -700.0), np.zeros(len(big))
        for _ in range(60):
            mid = (lo + hi) / 2
            over = np.log(w) + np.log1p(-np.exp(np.minimum(mid, -1e-12))) + (d - 1) * mid > np.log(n)
            lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
        y = np.exp(hi)
        mean = w * (1 - y**d) / d
        var = np.maximum(mean - n / (1 + (1 - d) * (1 - y) / np.maximum(y, 1e-300)), 0.0)
        normal = np.rint(mean + np.sqrt(var) * rng.standard_normal(len(big)))
        t[big] = np.clip(np.where(mean < 30, 1 + rng.poisson(np.minimum(mean, 30)), normal), 1, c[big])
    return t


def digamma(x: np.ndarray) -> np.ndarray:
    x, low = np.asarray(x, float).copy(), 0.0
    for _ in range(6):
        low = low - np.where(x < 6, 1 / x, 0.0)
        x = np.where(x < 6, x + 1, x)
    return low + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def auxiliary(theta: float, d: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """Of restaurants: the sum of log x, x drawn from Beta(theta + 1, customers - 1), and the expected number
    of tables that are due to the concentration. Given these, theta is Gamma(1 + number, 1 - sum)."""
    some = customers > 1
    x = rng.beta(theta + 1, customers[some] - 1) if some.any() else np.ones(1)
    t = tables[tables > 1]
    return float(np.log(np.maximum(x, 1e-300)).sum()), float((theta / d * (digamma(theta / d + t) - digamma(np.array([theta / d + 1])))).sum())


class Seats:
    """The tables of one part's pairs, and what other parts have of the same words and spread contexts."""

    def __init__(self, packed: bytes, part: int, spread: np.ndarray, turn: int = 0):
        keys, runs, words, code, customers = pickle.loads(packed)
        self.ctx_keys, self.word_keys = _risen(keys), _risen(words)
        self.ctx = np.repeat(np.arange(len(self.ctx_keys)), _unpack(runs, np.uint32))
        self.word, self.c = _unpack(code, np.uint32).astype(np.int64), _unpack(customers, np.uint32).astype(np.int64)
        self.t = np.minimum(self.c, 1)
        self.shared_ctx = np.flatnonzero(np.isin(self.ctx_keys, spread))
        self.rng = np.random.Generator(np.random.PCG64([20240611, int(part), turn]))
        self.active = np.flatnonzero(self.c > 1)
        self.other_c0, self.t0, self.count = (np.zeros(len(self.word_keys)) for _ in range(3))
        self.other_t, self.other_c = np.zeros(len(self.ctx_keys)), np.zeros(len(self.ctx_keys))
        self.own_c = np.bincount(self.ctx, self.c, len(self.ctx_keys))
        self.sums()

    def sums(self) -> None:
        self.own_c0 = np.bincount(self.word, self.t, len(self.word_keys))
        self.own_t = np.bincount(self.ctx, self.t, len(self.ctx_keys))

    def _asked(self, owners: int):
        """(owner, rows of word_keys, rows of ctx_keys) that each owner answers for."""
        w = np.searchsorted(_range(self.word_keys, owners, _BITS), np.arange(owners + 1))
        s = np.searchsorted(_range(self.ctx_keys[self.shared_ctx], owners, _BITS), np.arange(owners + 1))
        for q in range(owners):
            if w[q + 1] > w[q] or s[q + 1] > s[q]:
                yield q, slice(w[q], w[q + 1]), self.shared_ctx[s[q] : s[q + 1]]

    def messages(self, owners: int):
        """(owner, keys, tables and customers of each): words, then spread contexts with a bit on top."""
        count = np.bincount(self.word, self.c, len(self.word_keys))
        for q, w, s in self._asked(owners):
            key = np.concatenate([self.word_keys[w], self.ctx_keys[s] | np.uint64(1 << _BITS)])
            yield q, pickle.dumps((_rising(key), _pack(np.concatenate([self.own_c0[w], self.own_t[s]]).astype(np.uint32)), _pack(np.concatenate([count[w], self.own_c[s]]).astype(np.uint32))))

    def answered(self, owners: int, answers: dict[int, bytes], seats: bytes | None = None) -> None:
        """Take the seats that were sent, and all others' from the owners' answers."""
        if seats is not None:
            self.t[self.active] = _unpack(seats, np.uint32)
            self.sums()
        for q, w, s in self._asked(owners):
            total, t0, count = (_unpack(x, np.uint32) for x in pickle.loads(answers[q]))
            n = w.stop - w.start
            self.other_c0[w], self.t0[w], self.count[w] = total[:n] - self.own_c0[w], t0[:n], count[:n]
            self.other_t[s], self.other_c[s] = total[n:] - self.own_t[s], count[n:] - self.own_c[s]
        self.own_before, self.t0_before = self.own_c0.sum(), self.t0.sum()

    def root(self, g: Shared, word: np.ndarray | slice = slice(None), less: np.ndarray | float = 0.0) -> np.ndarray:
        """The root's probability of words, without `less` of their customers. Others' tables stay as they were told."""
        c0 = (self.other_c0 + self.own_c0)[word] - less
        t0 = np.minimum(self.t0, self.other_c0 + self.own_c0)
        tables, customers = g.tables - self.t0_before + t0.sum(), g.customers - self.own_before + self.own_c0.sum()
        base = np.where(self.count[word] > 0, (1 - g.unknown) / max(g.words, 1.0), g.unknown)
        seated = np.maximum(c0 - g.root_discount * np.minimum(t0[word], np.maximum(c0, 0)), 0.0)
        return (seated + (g.root_theta + g.root_discount * tables) * base) / (g.root_theta + customers - less)

    def sweep(self, g: Shared, table: np.ndarray) -> None:
        """Redraw the tables of all pairs that have a choice, given all others."""
        for some in np.array_split(self.rng.permutation(self.active), TURNS):
            t = self.t[some]
            rest = (self.own_t + self.other_t)[self.ctx[some]] - t
            self.t[some] = draw_tables(self.c[some], self.root(g, self.word[some], t), rest, g.theta, g.discount, self.rng, table, g.root_theta + g.customers)
            self.sums()

    def predictive(self, g: Shared) -> np.ndarray:
        """Probability of each pair's word in its context."""
        tables, customers = (self.own_t + self.other_t)[self.ctx], (self.own_c + self.other_c)[self.ctx]
        return (self.c - g.discount * self.t + (g.theta + g.discount * tables) * self.root(g)[self.word]) / (g.theta + customers)

    def stats(self, g: Shared) -> list[float]:
        """Auxiliary sums of the contexts that are whole here, and the share of tokens that they pass to the root, summed."""
        whole = np.ones(len(self.ctx_keys), bool)
        whole[self.shared_ctx] = False
        c, t = self.own_c[whole], self.own_t[whole]
        return [*auxiliary(g.theta, g.discount, c, t, self.rng), float((c * (g.theta + g.discount * t) / (g.theta + c)).sum()), float(c.sum())]


def _first(owners: int, spread: np.ndarray):
    def run(it):
        for b in it:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for q, m in Seats(cells, part, spread).messages(owners):
                    yield _rows([(part, q, m, None, None)])

    return run


def _owner(g: Shared | None):
    """Answers of one owner: tables of all parts, the root's tables (one a word at first), customers. A last row has the sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [pickle.loads(a) for a in pdf.a]
        keys = [_risen(x[0]) for x in got]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([_unpack(x[1], np.uint32) for x in got]), len(every)).astype(np.int64)
        count = np.bincount(at, np.concatenate([_unpack(x[2], np.uint32) for x in got]), len(every)).astype(np.int64)
        word = every < np.uint64(1 << _BITS)
        t0 = np.where(word, np.minimum(total, 1), 0)
        if g is not None:
            rng = np.random.Generator(np.random.PCG64([20240612, int(pdf.kind.iloc[0])]))
            n = total[word]
            p = np.full(len(n), (1 - g.unknown) / max(g.words, 1.0))
            t0[word] = draw_tables(n, p, np.full(len(n), max(g.tables - 1, 0.0)), g.root_theta, g.root_discount, rng, log_stirling(g.root_discount))
        out, upto = [], 0
        for part, k in zip(pdf.part, keys, strict=True):
            x = at[upto : upto + len(k)]
            upto += len(k)
            out.append((part, pdf.kind.iloc[0], pickle.dumps(tuple(_pack(y[x].astype(np.uint32)) for y in (total, t0, count))), None, None))
        c0 = total[word]
        sums = [(count[word] > 0).sum(), (count[word] == 1).sum(), (c0 == 1).sum(), (c0 == 2).sum(), t0.sum(), c0.sum()]
        out.append((None, None, None, None, [float(x) for x in sums]))
        return pd.DataFrame(out, columns=_NAMES).astype({"part": "Int64", "kind": "Int64"})

    return run


def _seated(pdf: pd.DataFrame, owners: int, spread: np.ndarray, turn: int) -> tuple[Seats, pd.DataFrame]:
    """The seats of a part's rows: its pairs, its tables where it has been here before, owners' answers."""
    cells, seats = pdf[pdf.kind == _CELLS], pdf[pdf.kind == _SEATS]
    s = Seats(cells.a.iloc[0], pdf.part.iloc[0], spread, turn)
    s.answered(owners, {int(r.kind): r.a for r in pdf[pdf.kind >= 0].itertuples()}, seats.a.iloc[0] if len(seats) else None)
    return s, cells


def _burn(g: Shared, owners: int, spread: np.ndarray):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, _ = _seated(pdf, owners, spread, 1)
        table = log_stirling(g.discount)
        for _ in range(BURN):
            s.sweep(g, table)
        part = pdf.part.iloc[0]
        out = [(part, _SEATS, _pack(s.t[s.active].astype(np.uint32)), None, s.stats(g))]
        return pd.DataFrame(out + [(part, q, m, None, None) for q, m in s.messages(owners)], columns=_NAMES)

    return run


def _answer(g: Shared, owners: int, spread: np.ndarray):
    """To each flush, for each of its pairs: log10 of the averaged probability, and the word's count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, cells = _seated(pdf, owners, spread, 2)
        part, table, p = pdf.part.iloc[0], log_stirling(g.discount), np.zeros(len(s.c))
        for i in range(AGAIN + SAMPLES):
            s.sweep(g, table)
            if i >= AGAIN:
                p += s.predictive(g)
        log = np.rint(-np.log10(np.clip(p / SAMPLES, 1e-15, 1.0)) / UNIT).astype(np.uint16)
        count, out = s.count[s.word].astype(np.uint32), []
        for chunk, x in pickle.loads(cells.b.iloc[0]):
            at = np.cumsum(_unpack(x, np.uint32), dtype=np.int64)
            out.append((part, chunk, _pack(log[at]), _pack(count[at]), None))
        return pd.DataFrame(out, columns=_NAMES)

    return run


def _by_document(g: Shared):
    """The documents of a flush: sums over their pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, answers = pdf[pdf.part < 0], pdf[pdf.part >= 0].sort_values("part")
        ids, held, sizes, n = pickle.loads(own.a.iloc[0])
        log = np.concatenate([_unpack(a, np.uint16) for a in answers.a]) * -UNIT
        count = np.concatenate([_unpack(b, np.uint32) for b in answers.b]).astype(float)
        assert len(log) == n, "a flush got an answer for each of its pairs"
        gaps = _unpack(own.b.iloc[0], np.uint32).astype(np.int64)
        upto, starts = np.cumsum(gaps), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        entry = upto - np.repeat(upto[starts] - gaps[starts], sizes)
        base = np.log10((count + 0.5) / (g.tokens + 0.5 * (g.words + 1)))
        add = lambda x: np.add.reduceat(x[entry], starts)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": sizes, "n_known": add((count > 0).astype(np.int64)), "base_score": add(base), "score": add(log)})

    return run


def _summed(rows: DataFrame, n: int) -> np.ndarray:
    """Element-wise sums of the arrays in stats; n numbers whatever the input."""
    got = rows.where("stats is not null").select(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return np.array([x or 0.0 for x in got])


def _discount(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def scores(docs: DataFrame, held: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Learns from the rows whose boolean column `held` isn't true (null counts as false). Tokens are the
    words, A-Z lower-cased, and an end; null and empty texts are just an end. base_score is the
    unigram model with 0.5 added to each count, score the log10 probability under this model; unknown
    words are one class in both. Whole texts count, however long: a text longer than a flush is a flush.
    Repeated rows and null ids are learnt and scored like others, in any order of rows; without any
    learning document every word is unknown; an empty table gives an empty result. Words are told apart
    by 56 bits of hash. Other columns are ignored, so none can clash.
    """
    spark = docs.sparkSession
    batches(spark)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(held), F.lit(False)).alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    chars = read.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(8, math.ceil(chars / PART_CHARS))
    owners = max(4, parts // 8)
    share = SPREAD / parts
    heavy = settle(read.mapInArrow(tidied(_heavy(share)), "ctx long, n long").groupBy("ctx").agg(F.sum("n").alias("n")))
    every = heavy.where("ctx is null").agg(F.sum("n")).first()[0] or 0
    # at most 4 / (3 * share) contexts can have as much
    spread = np.sort(np.array([r.ctx for r in heavy.where(F.col("ctx").isNotNull() & (F.col("n") >= 0.75 * share * every)).collect()], np.int64)).astype(np.uint64)
    shards = settle(read.mapInArrow(tidied(_send(parts, spread)), _ROW).groupBy("part").applyInPandas(tidied_group(_shard), _ROW))
    own = shards.where("part >= 0")
    once, twice, tokens, cells = _summed(own, 4)
    first = own.select("part", "a").mapInArrow(tidied(_first(owners, spread)), _ROW)
    down = settle(first.groupBy("kind").applyInPandas(tidied_group(_owner(None)), _ROW))
    known, single, once0, twice0, tables, customers = _summed(down, 6)
    g = Shared(tokens, known, tables, customers, _discount(once, twice), _discount(once0, twice0))
    told = lambda x: x.where("part is not null and kind >= 0")
    burnt = settle(own.select("part", "kind", "a", F.lit(None).cast("binary").alias("b"), "stats").union(told(down)).groupBy("part").applyInPandas(tidied_group(_burn(g, owners, spread)), _ROW))
    log_x, by_theta, passed, seen = _summed(burnt, 4)
    rng = np.random.Generator(np.random.PCG64(20240613))
    log_x0, by_theta0 = auxiliary(g.root_theta, g.root_discount, np.array([g.customers]), np.array([g.tables]), rng)
    g = replace(g, theta=float(rng.gamma(1 + by_theta) / (1 - log_x)), root_theta=float(rng.gamma(1 + by_theta0) / (1 - log_x0)))
    down = settle(told(burnt).groupBy("kind").applyInPandas(tidied_group(_owner(g)), _ROW))
    _, _, once0, twice0, tables, customers = _summed(down, 6)
    # Good and Turing: unknown words have the probability of words seen once; the base gives its share of what comes down to it
    to_base = max(passed, 1e-9) / max(seen, 1e-9) * (g.root_theta + g.root_discount * tables) / (g.root_theta + customers)
    unknown = float(np.clip((single + 1) / (tokens + 2) / max(to_base, 1e-12), 0.01, 0.99))
    g = replace(g, tables=tables, customers=customers, unknown=unknown)
    answers = own.union(burnt.where(F.col("kind") == _SEATS)).union(told(down)).groupBy("part").applyInPandas(tidied_group(_answer(g, owners, spread)), _ROW)
    out = shards.where("part < 0").union(answers).groupBy("kind").applyInPandas(tidied_group(_by_document(g)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs.withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 1), "held")
