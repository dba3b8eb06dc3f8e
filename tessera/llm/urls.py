"""URL filtering by explicit rules and, where none fits, by the reputation of the host.

Reputation is empirical Bayes: outcomes of labelled pages are counted for each host, and its rate of
good pages is shrunk through beta-binomial priors, from host to registered domain to suffix to all
pages. How strongly a level's groups hold together is estimated from their spread around their
parents' rates. A host is blocked if the upper bound of its posterior lies below a floor.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_udf, fresh, settle, small_or_shuffled

#: A host is blocked if its rate of good pages is under FLOOR with a probability of at least SURE.
FLOOR, SURE = 0.5, 0.95
#: Suffixes of two labels; all others have one.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn", "co.za")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ://."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls; of equal lengths the first."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, r in sorted(reversed(rules), key=lambda x: len(x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, action = F.when(fits, r).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain; a host of one label, or an address, is both."""
    labels = F.size(F.split(host, r"\."))
    two = F.substring_index(host, ".", -2).isin(*TWO_LABELS)
    suffix = F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(two, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    whole = (labels < 2) | host.rlike(r"^[\d.:\[\]]+$|:.*:")
    return F.when(whole, host).otherwise(suffix), F.when(whole, host).otherwise(domain)


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    log = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f = f * d * c
        if np.all(np.abs(d * c - 1) < 1e-12):
            break
    return np.where(flip, 1 - front * f, front * f)


def _below(floor: float, a: Column | str, b: Column | str) -> Column:
    def run(s: pa.Array, t: pa.Array) -> pa.Array:
        x, y = s.to_numpy(zero_copy_only=False), t.to_numpy(zero_copy_only=False)
        return pa.array(beta_cdf(floor, x, y) if len(x) else [], pa.float64())

    return batch_udf(run, "double", a, b)


def _strength(groups: DataFrame) -> float:
    """Pseudo-counts of the prior that groups (n, k, mean: the parent's rate) share, from their overdispersion by moments."""
    v = F.col("mean") * (1 - F.col("mean"))
    over, of = groups.where("n > 0").agg(F.sum(F.pow(F.col("k") - F.col("n") * F.col("mean"), 2) - F.col("n") * v), F.sum(F.col("n") * (F.col("n") - 1) * v)).first()
    rho = min(0.9, max(0.001, over / of)) if of else 0.1
    return 1 / rho - 1


def _shrunk(groups: DataFrame) -> DataFrame:
    """groups with their rate, shrunk towards mean."""
    s = _strength(groups)
    return groups.withColumn("rate", (F.col("k") + s * F.col("mean")) / (F.col("n") + s))


def reputations(hosts: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(host, a, b, p_below) from hosts (host, n labelled, k good): the posterior Beta(a, b) of each host's rate of good pages, and the probability that it is below the floor. Without any label the rate is 1/2."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = settle(hosts.withColumn("suffix", suffix).withColumn("domain", domain))
    domains = settle(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = settle(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    whole = ((k or 0) + 1) / ((n or 0) + 2)
    suffixes = settle(_shrunk(suffixes.withColumn("mean", F.lit(whole))).select("suffix", F.col("rate").alias("mean")))
    domains = settle(_shrunk(domains.join(small_or_shuffled(suffixes), "suffix")).select("domain", F.col("rate").alias("mean")))
    hosts = hosts.join(small_or_shuffled(domains), "domain")
    s = _strength(hosts)
    a, b = F.col("k") + s * F.col("mean"), F.col("n") - F.col("k") + s * (1 - F.col("mean"))
    return hosts.select("host", a.alias("a"), b.alias("b")).withColumn("p_below", _below(floor, "a", "b"))


def judged(pages: DataFrame, outcomes: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, floor: float = FLOOR, sure: float = SURE) -> tuple[DataFrame, str]:
    """pages with a struct column (its name is returned): host, path, rule, verdict, a, b, p_below.

    outcomes (page_id, good boolean) labels some pages; a page with several is good if all are, and
    those with a null are ignored. Null urls and urls without :// have an empty host, which is a host
    like any other; urls of any length count whole; of rules of equal length that fit the first given
    wins; repeated pages count as often as they occur; null ids are judged but never labelled; other
    columns, whatever their names, pass through; an empty table gives an empty result.
    """
    name = fresh(pages, "url")
    host, path = host_and_path(F.col(url))
    rule, action = rule_of(F.col(f"{name}.host"), F.col(f"{name}.path"), rules)
    df = pages.withColumn(name, F.struct(host.alias("host"), path.alias("path")))
    known = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    labelled = df.select(F.col(page_id).alias("page_id"), F.col(f"{name}.host").alias("host")).join(known, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("good").cast("double").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("k"))
    h, a, b, low = (fresh(df, f"url_{x}") for x in ("host", "a", "b", "below"))
    rep = settle(reputations(hosts, floor)).toDF(h, a, b, low)
    out = df.join(small_or_shuffled(rep), F.col(f"{name}.host") == F.col(h), "left")
    verdict = F.coalesce(action, F.when(F.col(low) >= sure, "block").otherwise("allow"))
    fields = F.col(name)
    for k, v in (("rule", rule), ("verdict", verdict), ("a", F.col(a)), ("b", F.col(b)), ("p_below", F.col(low))):
        fields = fields.withField(k, v)
    return out.withColumn(name, fields).select(*[out[c] for c in pages.columns], name), name


def query(spark, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path; that document's labels are its outcome."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    shown = pages.select("page_id", F.regexp_extract(host_and_path(F.col("url"))[1], r"/(\d{1,18})(\.html)?/?$", 1).alias("doc")).where("doc <> ''").select("page_id", F.col("doc").cast("long").alias("doc_id"))
    outcomes = shown.join(labels, "doc_id").select("page_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    out, name = judged(pages, outcomes)
    return out.select("page_id", *[F.col(f"{name}.{c}").alias(c) for c in ("host", "path", "rule", "verdict", "a", "b", "p_below")])
