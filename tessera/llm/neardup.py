"""Near duplicates by MinHash: universal hash minima, banding, verification of signatures and of whole
sets, and connected components.

Documents with equal shingle sets form a class, a node of the graph; all further work is on classes.
Every bucket's members are compared with its smallest member. Where that leaves the classes that buckets
connect in several components, those outside the largest are compared with all others of it: within the
whole connected set where those outside are few, within each bucket where they are not, in blocks, so no
bucket has a cap. Links are confirmed on full sets. At a similarity of 0.8, 32 bands of 4 miss a pair with a
probability of 5e-8, and the signature filter with 4e-7.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.names import fresh

from .common import batch_udf, batches, beside, flat_words, mix, settle, small_or_shuffled, tidied_group, window_hash, word_hashes
from .components import components

BANDS, ROWS = 32, 4
#: Least share of equal minima for a pair to be verified: 5 standard deviations under 0.8.
LEAST_EQUAL = 0.62
#: Documents that are compared with as many others in one task.
BLOCK = 512
#: Blocks of classes outside a connected set's largest component up to which they are compared within the whole set: each text then travels once a block, otherwise once a bucket.
FEW_BLOCKS = 8
_PERMS = BANDS * ROWS
_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(0, 1 << 63, _PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, _PERMS, dtype=np.uint64)
_SIG = "n_shingles long, sig binary, k1 long, k2 long"


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles (lower-cased A-Z); the whole sequence if shorter; empty without words."""
    codes, dictionary, starts = flat_words(texts, lower=True)
    h = word_hashes(dictionary)[codes]
    w = window_hash(h, k)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        elif b > a:
            out.append(window_hash(h[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(u: np.ndarray) -> bytes:
    """The upper 32 bits of each hash function's minimum over the set."""
    low = np.full(_PERMS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(u), 2048):
        low = np.minimum(low, (_A[:, None] * u[None, i : i + 2048] + _B[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).tobytes()


def _signatures(k: int, text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        n, sig, k1, k2 = [], [], [], []
        for u in shingle_sets(texts, k):
            n.append(len(u))
            sig.append(minima(u) if len(u) else None)
            a, b = _keys(u)
            k1.append(a)
            k2.append(b)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["n_shingles", "sig", "k1", "k2"])

    return batch_udf(run, _SIG, text)


def _sets(k: int, text: Column | str) -> Column:
    """The set and its class's keys."""

    def run(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(texts, k)
        k1, k2 = zip(*map(_keys, sets), strict=True) if sets else ((), ())
        return pa.StructArray.from_arrays([pa.array([u.tobytes() for u in sets], pa.binary()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["set", "k1", "k2"])

    return batch_udf(run, "set binary, k1 long, k2 long", text)


def _keys(u: np.ndarray) -> tuple[int, int]:
    """Two sums that identify a set, beside its size."""
    return int(u.sum(dtype=np.uint64).astype(np.int64)), int(mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))


def _shared(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _similar(percent: int, a: Column | str, b: Column | str) -> Column:
    """Whether two sets' intersection is at least percent % of their union."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            both = _shared(x, y)
            out.append(both * 100 >= ((len(x) + len(y)) // 8 - both) * percent)
        return pa.array(out, pa.bool_())

    return batch_udf(run, "boolean", a, b)


def _equal_share(a: Column | str, b: Column | str) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(a.to_pylist()), np.uint32).reshape(-1, _PERMS)
        y = np.frombuffer(b"".join(b.to_pylist()), np.uint32).reshape(-1, _PERMS)
        return pa.array((x == y).mean(axis=1) if len(x) else [], pa.float64())

    return batch_udf(run, "double", a, b)


def _texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, set) of the classes in nodes (node): read from a document of the class's least id. An id may have several texts; the class's own is told by its keys."""
    want = settle(nodes.distinct().join(classes.select("node", "class_id", "k1", "k2"), "node"))
    ids = settle(want.select(F.col("class_id").alias("doc_id")).distinct())
    texts = docs.join(small_or_shuffled(ids), "doc_id", "left_semi").select("doc_id", _sets(k, "text").alias("s")).select("doc_id", "s.*")
    found = texts.join(want, (texts["doc_id"] == want["class_id"]) & (texts["k1"] == want["k1"]) & (texts["k2"] == want["k2"]))
    return settle(found.select("node", "set").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (u, v) of pairs of nodes whose sets are similar enough: first by signatures and sizes, then by the sets."""
    s = lambda x: classes.select(F.col("node").alias(x), F.col("sig").alias(f"{x}_sig"), F.col("n_shingles").alias(f"{x}_n"))
    # u has one row a bucket; a v, the middle of a star, may have very many
    likely = beside(settle(pairs.join(s("u"), "u")), s("v"), "v").where(F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent)
    likely = settle(likely.where(_equal_share("u_sig", "v_sig") >= LEAST_EQUAL).select("u", "v"))
    sets = _texts_of(likely.select(F.col("u").alias("node")).union(likely.select(F.col("v").alias("node"))), classes, docs, k)
    both = beside(settle(likely.join(sets.toDF("u", "u_set"), "u")), sets.toDF("v", "v_set"), "v")
    return both.where(_similar(percent, "u_set", "v_set")).select("u", "v")


def _linked(percent: int):
    """Links that join components within a pair of blocks. Pairs are tried from the most similar signatures down; of those in one component already, none is; so a task returns fewer links than it has components."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if not len(second):
            second = first
        top: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        x, y = (np.frombuffer(b"".join(s.sig), np.uint32).reshape(-1, _PERMS) for s in (first, second))
        sets = [np.frombuffer(s, np.uint64) for s in second["set"]]
        ids, comps, sizes = second.rep.to_numpy(), second.comp.to_numpy(), np.array([len(s) for s in sets])
        out = []
        for rep, comp, one, sig in zip(first.rep, first.comp, first["set"], x, strict=True):
            one = np.frombuffer(one, np.uint64)
            near = (comps != comp) & (np.minimum(sizes, len(one)) * 100 >= np.maximum(sizes, len(one)) * percent)
            at = np.flatnonzero(near)
            equal = (y[at] == sig).mean(axis=1)
            for j in at[np.argsort(-equal, kind="stable")][: int((equal >= LEAST_EQUAL).sum())]:
                if (c := find(comp)) == (d := find(comps[j])):
                    continue
                where = np.searchsorted(sets[j], one)
                shared = int((sets[j][np.minimum(where, len(sets[j]) - 1)] == one).sum())
                if shared * 100 >= (len(one) + sizes[j] - shared) * percent:
                    top[max(c, d)] = min(c, d)
                    out.append((max(rep, ids[j]), min(rep, ids[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _rest(members: DataFrame, stars: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between the components that the stars' links left.

    members (key, node) are the buckets. Within a group, a connected set of buckets or one bucket, classes of the group's largest component are compared only with those outside it. None
    if nothing is left.
    """
    sets = settle(components(stars).withColumnsRenamed({"component": "grp"}))
    at = settle(sets.join(comps, "node", "left").select("node", "grp", F.coalesce("component", "node").alias("comp")))
    sizes = lambda x: x.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", "comp")).alias("main")).where("n > most and n > 2")
    open_sets = settle(sizes(at))
    if open_sets.isEmpty():
        return None
    left = at.join(small_or_shuffled(open_sets.select("grp", (F.col("n") - F.col("most") <= FEW_BLOCKS * BLOCK).alias("few"))), "grp")
    few = left.where("few").select("node", "grp", "comp")
    # the other classes, once for each of their buckets
    many = settle(left.where("not few").select("node", "comp"))
    each = members.join(small_or_shuffled(many), "node").select("node", F.xxhash64(F.lit(1), "key").alias("grp"), "comp")
    every = settle(few.union(each))
    groups = settle(sizes(every).select("grp", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("nu"), F.ceil(F.col("most") / BLOCK).cast("int").alias("nm")))
    left = settle(every.join(small_or_shuffled(groups), "grp"))
    if left.isEmpty():
        return None
    sets = _texts_of(left.select("node"), classes, docs, k)
    out = F.col("comp") != F.col("main")
    block = F.when(out, F.pmod(F.xxhash64("node"), F.col("nu"))).otherwise(F.col("nu") + F.pmod(F.xxhash64("node"), F.col("nm"))).cast("int")
    others = F.sequence(F.lit(0), F.when(out, F.col("nu") + F.col("nm") - 1).otherwise(F.col("nu") - 1))
    cells = F.transform(others, lambda j: F.struct(F.least(j, block).alias("i"), F.greatest(j, block).alias("j"), F.when(j >= block, 0).otherwise(1).alias("side")))
    dealt = left.select("grp", "node", "comp", F.explode(cells).alias("c")).select("grp", F.col("node").alias("rep"), "comp", "c.*")
    full = dealt.join(sets.join(classes.select("node", "sig"), "node").withColumnRenamed("node", "rep"), "rep")
    return full.groupBy("grp", "i", "j").applyInPandas(tidied_group(_linked(percent)), "u long, v long").distinct()


def _classed(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, k1, k2) of each row, settled; and the classes (k1, k2, n_shingles, class_id, component, component_id).

    class_id is the least id of a class, component_id of a component (null if none has an id), and
    component tells components apart.
    """
    batches(docs.sparkSession)
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = settle(read.select("doc_id", text_key(F.col("text")).alias("text_key"), _signatures(k, F.col("text")).alias("s")).select("doc_id", "text_key", "s.*"))
    real = base.where("n_shingles > 0")
    # of equal sets any signature is the same
    classes = settle(real.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig"), F.min("text_key").alias("text_key")))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    docs = read
    if classes.where("class_id is null").isEmpty():
        docs = read.where("doc_id is not null")
    else:  # classes of rows without an id are found by their text's key
        numbered = F.when(F.col("class_id").isNull(), F.col("text_key.a")).otherwise(F.col("class_id"))
        classes = classes.withColumn("class_at", numbered)
        docs = read.withColumn("doc_id", F.coalesce("doc_id", text_key(F.col("text"))["a"]))
    sigs = classes.select("node", "n_shingles", "sig", "k1", "k2", (F.col("class_at") if "class_at" in classes.columns else F.col("class_id")).alias("class_id"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    bands = sigs.select("node", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")).where("n > 1")
    buckets = settle(buckets.groupBy("n", "center", "sum").agg(F.min("key").alias("key")).select("key", "center"))
    members = settle(bands.join(small_or_shuffled(buckets), "key"))
    stars = settle(members.where("node <> center").select(F.col("node").alias("u"), F.col("center").alias("v")).distinct())
    links = settle(_confirmed(stars, sigs, docs, k, percent))
    comps = settle(components(links))
    rest = _rest(members.select("key", "node"), stars, comps, sigs, docs, k, percent)
    if rest is not None:
        comps = settle(components(links.union(rest)))
    to = settle(classes.select("node", "k1", "k2", "n_shingles", "class_id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node"))
    least = to.groupBy("component").agg(F.min("class_id").alias("component_id"))
    return base.drop("sig"), settle(beside(to, least, "component", to.count()))


def text_key(text: Column) -> Column:
    """128 bits in place of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(11), text).alias("b"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for each row of docs.

    class_id is the smallest id with the same set; component_id the smallest id reachable over links of
    at least percent % Jaccard similarity. Null and empty texts have no shingles and no links; a row
    with a null id links others but is kept and has a null component_id; rows that repeat an id are
    each judged by their own text; of equal rows all share one fate. Texts count whole, however long;
    an empty table gives an empty result; other columns are ignored, so none can clash.
    """
    base, classes = _classed(docs, doc_id, text, k, percent)
    out = _with_class(base, classes)
    free = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    at = lambda c: F.when(free, F.col("doc_id")).otherwise(F.col(c)).alias(c)
    out = out.select("doc_id", "n_shingles", at("class_id"), at("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _with_class(base: DataFrame, classes: DataFrame) -> DataFrame:
    """base with its class's columns; a class of very many copies doesn't meet in one task."""
    key = F.xxhash64("k1", "k2", "n_shingles")
    real = base.where("n_shingles > 0").withColumn("at", key)
    found = classes.withColumn("at", key)
    many = beside(real, found.groupBy("at").agg(F.collect_list(F.struct("k1", "k2", "n_shingles", "class_id", "component", "component_id")).alias("each")), "at")
    one = F.filter("each", lambda x: (x["k1"] == F.col("k1")) & (x["k2"] == F.col("k2")) & (x["n_shingles"] == F.col("n_shingles")))[0]
    many = many.withColumn("one", one).select(*base.columns, *[F.col(f"one.{c}").alias(c) for c in ("class_id", "component", "component_id")])
    return many.unionByName(base.where("n_shingles = 0"), allowMissingColumns=True)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the least id, and of equal ids the one with the least key of its text.

    Rows are told apart by id and text, so null and repeated ids are judged by their text, and of rows
    that agree in both one stays. Rows without words are no duplicates and stay. Whole texts count; an
    empty table gives an empty result; other columns, whatever their names, pass through.
    """
    base, classes = _classed(docs, doc_id, text, k, percent)
    rows = _with_class(base, classes).where("component is not null").groupBy("component", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    rows = settle(rows)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    ranked = settle(beside(rows, best, "component", rows.count()).withColumn("stays", rank == F.col("best")))
    i, t, here = fresh(docs, "gone_id"), fresh(docs, "gone_key"), fresh(docs, "key")
    keyed = docs.withColumn(here, text_key(F.col(text).cast("string")))
    same = lambda d: F.col(doc_id).cast("long").eqNullSafe(d[i]) & (F.col(here) == d[t])
    gone = settle(ranked.where("not stays").select(F.col("doc_id").alias(i), F.col("text_key").alias(t)))
    out = keyed.join(small_or_shuffled(gone), same(gone), "left_anti")
    twice = settle(ranked.where("stays and n > 1").select(F.col("doc_id").alias(i), F.col("text_key").alias(t)))
    if not twice.isEmpty():
        again = small_or_shuffled(twice)
        one = out.join(again, same(twice), "left_semi").dropDuplicates([doc_id, here])
        out = out.join(again, same(twice), "left_anti").unionByName(one)
    return out.select(*[out[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=4).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
