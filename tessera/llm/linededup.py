"""Line deduplication by site-relative frequency, in DataFrame operations only.

A line (outer blanks removed) is boilerplate on a host if the share of the host's distinct pages that
contain it exceeds a ratio. Copies of one page count once, so that copying a page doesn't turn its
text into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, settle

#: Share of a host's distinct pages above which a line is boilerplate.
RATIO = 0.025
#: Pages that must contain it, so that small hosts keep their text.
MIN_PAGES = 5
#: Outer characters that don't count.
BLANK = " \t\r\x0b\x0c"


def _key(text: Column) -> Column:
    """128 bits in place of a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _line(x: Column) -> Column:
    return F.trim(x, F.lit(BLANK))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): keys of each host's boilerplate lines; at most the mean lines of a page / ratio of them. Pages and lines are counted by partial sums before they are shuffled."""
    pages = docs.where(docs[text].isNotNull()).select(docs[host].alias("host"), docs[text].cast("string").alias("text"))
    total = pages.select("host", _key(F.col("text")).alias("page")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: _line(x) != "")
    cells = pages.select("host", F.xxhash64("text").alias("page"), F.explode(F.array_distinct(F.transform(lines, lambda x: _key(_line(x))))).alias("line"))
    often = cells.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    hit = often.alias("o").join(total.alias("t"), F.col("o.host").eqNullSafe(F.col("t.host"))).where(F.col("n").cast("double") / F.col("total").cast("double") > F.lit(ratio))
    return hit.groupBy("o.host").agg(F.collect_list("line").alias("lines"))


def without_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, str]:
    """docs with the boilerplate lines of their host removed from text; also a struct column (its name
    is returned) of n_lines and n_removed.

    Blank lines and null texts stay as they are (a null has 0 lines); an empty text is one blank line; a
    text may become empty; texts of any length count whole, each line by 128 bits of hash; a line exactly
    at the ratio stays; a null host is a host; ids play no part, so null and repeated ones don't matter,
    and repeated rows are cleaned alike; an empty table gives an empty result; other columns, whatever
    their names, pass through.
    """
    found = settle(boilerplate(docs, text, host, ratio, min_pages))
    name = fresh(docs, "lines")
    h, b = fresh(docs, "lines_host"), fresh(docs, "lines_drop")
    found = found.toDF(h, b)
    few = (found.agg(F.sum(F.size(b))).first()[0] or 0) <= BROADCAST_ROWS
    out = docs.join(F.broadcast(found) if few else found.hint("merge"), docs[host].eqNullSafe(found[h]), "left").drop(h)
    all_lines = F.split(F.col(text), "\n", -1)
    kept = F.when(F.col(b).isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~F.array_contains(F.col(b), _key(_line(x)))))
    out = out.withColumn(name, F.struct(F.coalesce(F.size(F.when(F.col(text).isNotNull(), all_lines)), F.lit(0)).alias("all"), kept.alias("kept")))
    left = F.col(f"{name}.kept")
    out = out.withColumn(text, F.when(F.col(text).isNotNull(), F.array_join(left, "\n")))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.col(f"{name}.all"))
    return out.withColumn(name, F.struct(n.cast("long").alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(n - F.size(left)).cast("long").alias("n_removed"))).drop(b), name


def clean(docs: DataFrame, **how) -> DataFrame:
    """docs with cleaned texts and the columns they had; a column n_chars follows the text."""
    out, _ = without_boilerplate(docs, **how)
    out = out.select(*[out[c] for c in docs.columns])
    text = how.get("text", "text")
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out, name = without_boilerplate(docs)
    return out.select("doc_id", "source", "text", F.col(f"{name}.n_lines").alias("n_lines"), F.col(f"{name}.n_removed").alias("n_removed"))


#: The cleaned rows of a relation {docs} with doc_id, source, text and others, as CTEs ending in {name}_clean.
_CTES = """
{name}_pages AS (SELECT DISTINCT source, text FROM {docs} WHERE text IS NOT NULL),
{name}_total AS (SELECT source, count(*) AS total FROM {name}_pages GROUP BY source),
{name}_lines AS (SELECT DISTINCT source, text, trim(l, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS l FROM {name}_pages)),
{name}_often AS (SELECT source, line, count(*) AS n FROM {name}_lines WHERE line <> '' GROUP BY source, line),
{name}_drop AS (SELECT o.source, list(line) AS gone FROM {name}_often o JOIN {name}_total t ON o.source IS NOT DISTINCT FROM t.source
  WHERE n >= 5 AND n::DOUBLE / total::DOUBLE > 0.025::DOUBLE GROUP BY o.source),
{name}_clean AS (SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(d.text, chr(10)),
    lambda x: NOT list_contains(coalesce(b.gone, []::VARCHAR[]), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))), chr(10)) END AS text),
  d.text AS old_text, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
  coalesce(len(list_filter(string_split(d.text, chr(10)), lambda x: list_contains(coalesce(b.gone, []::VARCHAR[]), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))))), 0)::BIGINT AS n_removed
  FROM {docs} d LEFT JOIN {name}_drop b ON d.source IS NOT DISTINCT FROM b.source)
"""
SQL = "WITH " + _CTES.format(name="ld", docs="documents") + " SELECT doc_id, source, text, n_lines, n_removed FROM ld_clean"
