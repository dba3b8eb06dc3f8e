"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

The sketch is a log-bucketed histogram with a relative error of about 1 % (gamma 1.02): a count for
each bucket, merged by adding counts, so it is the same in whatever order tasks finish. A cut-off is
a fence around two of the group's quantiles, as far out as they are apart; groups with too few documents use their language's, then the
whole corpus's sketch, which are sums of the groups' own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, batch_udf, batches, fresh, settle, small_or_shuffled, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition counts.
WINDOW = 5
#: Documents that a group needs for fences of its own.
MIN_GROUP = 200
#: Distances of a metric's two quantiles beyond one of them at which a value is an outlier.
REACH = 3.0
#: Ratio of neighbouring bucket bounds in the sketch, and its resolution at zero.
GAMMA, RESOLUTION = 1.02, 1e-4
#: Adaptive metrics: name, least distance of the quantiles (only so that uniform groups don't reject ties), fences below and above, the two
#: quantiles. Repeated lines are usual in a few documents of any group, so that quartiles would say nothing about them.
METRICS = (("word_length", 0.05, True, True, (0.25, 0.75)), ("symbol_rate", 0.02, False, True, (0.25, 0.75)), ("dup_line_rate", 0.02, False, True, (0.01, 0.99)))

_COUNTS = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")])
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"


def repeated_words(ws: list[bytes], k: int = WINDOW) -> int:
    """Words inside k-word windows that occur at least twice; exact, as windows are numbered and not hashed."""
    n = len(ws) - k + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int64, len(ws))
    if len(seen) == len(ws):
        return 0
    size, code, codes = len(seen), ids[:n].copy(), len(seen)
    for j in range(1, k):
        if codes * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            codes = int(code.max()) + 1
        code = code * size + ids[j : j + n]
        codes *= size
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] > 1)
    if not len(at):
        return 0
    return int(k + np.minimum(np.diff(at), k).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The fields of _DDL for one whole text; all 0 for null and empty texts."""
    if not text:
        return (0,) * 6
    ws = words(text)
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    return (
        len(ws),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        len(lines),
        repeated_words(ws),
    )


def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], fields=list(_COUNTS))


def counts(text: Column) -> Column:
    """Struct of base counts of a text column."""
    return batch_udf(_measured, _DDL, text.cast("string"))


def _rates(m: Column) -> list[Column]:
    n = F.greatest(m["n_words"], F.lit(1)).cast("double")
    return [m["word_chars"] / n, m["n_symbols"] / n, m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)).cast("double")]


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (m["n_repeat_words"] * 100 > m["n_words"] * 20)


def sketch(df: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """(keys, metric, bucket, n): the bucket of each value, counted; the partial counts of tasks add up."""
    cells = F.array(*[F.struct(F.lit(i).alias("metric"), F.ceil(F.log(v + F.lit(RESOLUTION)) / math.log(GAMMA)).cast("int").alias("bucket")) for i, v in enumerate(values)])
    return df.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, "c.metric", "c.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketched: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """(keys, metric, n, q0, q1 ...): the value of the bucket in which each quantile lies. A window holds one sketch, which has a bounded number of buckets."""
    by = Window.partitionBy(*keys, "metric")
    run = sketched.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("total", F.sum("n").over(by))
    value = F.greatest(F.pow(F.lit(GAMMA), F.col("bucket") - 0.5) - F.lit(RESOLUTION), F.lit(0.0))
    return run.groupBy(*keys, "metric").agg(
        F.max("total").alias("n"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p), value)).alias(f"q{i}") for i, p in enumerate(probabilities)]
    )


def thresholds(df: DataFrame, lang: Column, source: Column, m: Column, min_group: int = MIN_GROUP, reach: float = REACH) -> DataFrame:
    """One row for each (lang, source), nulls being groups like others: lo and hi, arrays in the order of METRICS."""
    good = df.select(lang.alias("lang"), source.alias("source"), m.alias("m")).where(~base_failed(F.col("m")))
    cells = settle(sketch(good, ["lang", "source"], _rates(F.col("m"))))
    cells = cells.withColumn("no_lang", F.lit(False)).withColumn("no_source", F.lit(False))
    add = lambda d, keys: d.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by_lang = add(cells, ["lang"])
    q = sorted({p for x in METRICS for p in x[4]})
    own, of_lang, of_all = quantiles(cells, ["lang", "source"], q), quantiles(by_lang, ["lang"], q), quantiles(add(by_lang, []), [], q)
    at = own.alias("a").join(of_lang.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.metric") == F.col("b.metric"))).join(F.broadcast(of_all.alias("c")), F.col("a.metric") == F.col("c.metric"))
    pick = lambda c: F.when(F.col("a.n") >= min_group, F.col(f"a.{c}")).when(F.col("b.n") >= min_group, F.col(f"b.{c}")).otherwise(F.col(f"c.{c}"))
    least = F.array(*[F.lit(x[1]) for x in METRICS])[F.col("a.metric")]
    low, high = (F.array(*[pick(f"q{q.index(x[4][i])}") for x in METRICS])[F.col("a.metric")] for i in (0, 1))
    spread = F.greatest(high - low, least) * reach
    at = at.select("a.lang", "a.source", F.col("a.metric"), (low - spread).alias("lo"), (high + spread).alias("hi"))
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("metric", c))), lambda x: x[c]).alias(c)
    return at.groupBy("lang", "source").agg(order("lo"), order("hi"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP, reach: float = REACH, once: bool = False) -> tuple[DataFrame, str]:
    """docs with a struct column (its name is returned) of base counts, base_failed and kept.

    Fails by rule: fewer than 10 words, or over 20 % of words in repeated 5-word windows. Otherwise a
    document is kept if its mean word length, symbols per word and share of repeated lines are within
    its group's fences, the fences included. Null and empty texts fail; texts of any length are measured
    whole; a null lang or source is a group like any other; ids play no part, and repeated rows are
    counted and judged alike; an empty table gives an empty result. Other columns, whatever their names,
    pass through.
    once: materialise the counts instead of computing them again for the second pass; for narrow docs.
    """
    batches(docs.sparkSession)
    name = fresh(docs, "quality")
    df = docs.withColumn(name, counts(docs[text]))
    df = settle(df.drop(text)) if once else df
    fences = settle(thresholds(df, df[lang], df[source], df[name], min_group, reach))
    l, s, lo, hi = (fresh(df, f"quality_{x}") for x in ("lang", "source", "lo", "hi"))
    fences = small_or_shuffled(fences.toDF(l, s, lo, hi))
    out = df.join(fences, df[lang].eqNullSafe(fences[l]) & df[source].eqNullSafe(fences[s]), "left").drop(l, s)
    m, inside = F.col(name), F.lit(True)
    for i, (v, (_, below, above)) in enumerate(zip(_rates(m), [(x[0], x[2], x[3]) for x in METRICS], strict=True)):
        inside &= F.coalesce(v >= F.col(lo)[i], F.lit(True)) if below else F.lit(True)
        inside &= F.coalesce(v <= F.col(hi)[i], F.lit(True)) if above else F.lit(True)
    return out.withColumn(name, m.withField("base_failed", base_failed(m)).withField("kept", ~base_failed(m) & inside)).drop(lo, hi), name


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The documents that judged() keeps, with the columns they had."""
    out, name = judged(docs, **how)
    return out.where(F.col(name)["kept"]).select(*[out[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out, name = judged(docs, once=True)
    m = F.col(name)
    return out.select("doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
