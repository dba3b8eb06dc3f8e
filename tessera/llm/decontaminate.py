"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a window of tokens of which a mask reads some and ignores the others, so that it still
matches where words were substituted. Every window of every document and of every benchmark item is
hashed under each mask; equal hashes are hits, and a hit counts if enough tokens of a wider window
around it agree along the same alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle, small_or_shuffled

#: Masks: 1 reads a token, 0 ignores it. All have the same span.
MASKS = ("110110101011", "111001011011", "101110010111")
#: Tokens before and after the seed that verification reads too, and the share of tokens that must agree.
PAD, AGREE = 2, 0.8
#: Seeds of the benchmark up to which they are broadcast, with up to 16 tokens' hashes each: 40 MB at most.
INDEX_ROWS = 200_000
#: Distinct keys of seeds up to which they are broadcast, as 64-bit numbers, so that only windows that hit are shuffled: 64 MB at most.
KEY_ROWS = 2_000_000
#: What separates tokens, in lower-cased text.
BETWEEN = r"[^\p{L}\p{N}]+"

_SPAN = len(MASKS[0])
_READ = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]


def token_hashes(text: Column) -> Column:
    """Hashes of the tokens (runs of letters and digits, lower-cased) of a text; empty for null."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN, -1), "")
    return F.transform(tokens, lambda x: F.xxhash64(x))


def seeds(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pos and key for every window and mask of df's array column h; short arrays have none.

    A key is the tokens' hashes shifted by their rank in the mask and joined by exclusive or: a few
    machine instructions, as every window of every document needs it.
    """
    last = F.size("h") - _SPAN
    each = df.withColumn("pos", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    keys = []
    for i, read in enumerate(_READ):
        key = F.lit(i).cast("long")
        for n, j in enumerate(read):
            key = key.bitwiseXOR(F.shiftleft(F.get("h", F.col("pos") + j), 3 * n + i))
        keys.append(key)
    return each.select(*keep, "pos", F.explode(F.array(*keys)).alias("key"))


def _around(h: Column, at: Column, before: Column) -> Column:
    """The tokens from `before` ahead of at to PAD after the seed; shorter where the text ends."""
    return F.slice(h, at - before + 1, before + _SPAN + PAD)


def overlaps(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = INDEX_ROWS, keys: int = KEY_ROWS) -> DataFrame:
    """(doc_id, item_id, n_hits, most_equal): the pairs that overlap, with their verified hits.

    A hit is verified if, over the item's tokens from PAD before the seed to PAD after it (as far as
    the item goes), at least 80 % equal the document's at the same offset; tokens beyond either end of
    the document don't. Null and empty texts, and items or documents under 12 tokens, overlap with
    nothing; rows with a null id are not reported; repeated rows add their hits; texts count whole; an
    exact share of 80 % is enough; empty tables give an empty result; other columns are ignored. A large
    benchmark's seeds are joined by a shuffle, of the windows whose keys it has if their number allows
    a broadcast, and the hits verified afterwards.
    """
    items = bench.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("h"))
    index = seeds(items, ["item_id", "h"])
    before = F.least(F.col("pos"), F.lit(PAD))
    index = settle(index.select("item_id", "key", before.alias("before"), _around(F.col("h"), F.col("pos"), before).alias("item")))
    rows = index.count()
    read = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), token_hashes(F.col(text)).alias("h"))
    if rows <= limit:
        hits = seeds(read, ["doc_id", "h"]).join(F.broadcast(index), "key")
    else:
        read = read.withColumn("same_text", F.xxhash64("h"))
        windows = seeds(read, ["doc_id", "same_text"])
        known = settle(index.select("key").distinct())
        if known.count() <= keys:
            windows = windows.join(F.broadcast(known), "key", "left_semi")
        found = windows.join(small_or_shuffled(index, rows, limit), "key")
        hits = found.join(read.dropDuplicates(["doc_id", "same_text"]), ["doc_id", "same_text"])
    # the tokens around a hit become a row of their own, so that it doesn't take its whole document along
    lead = F.greatest(F.col("before") - F.col("pos"), F.lit(0))
    here = F.slice("h", F.greatest(F.col("pos") - F.col("before"), F.lit(0)) + 1, F.size("item") - lead)
    hits = hits.select("doc_id", "item_id", "item", lead.alias("lead"), F.explode(F.array(here)).alias("here"))
    at = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("lead")), F.col("here"))
    same = F.size(F.filter(F.zip_with(at, F.col("item"), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    hits = hits.select("doc_id", "item_id", same.alias("same"), F.size("item").alias("of"))
    return hits.where(F.col("same") >= F.ceil(F.col("of") * AGREE)).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"), F.max("same").cast("long").alias("most_equal"))


def without_overlaps(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that overlap with an item.

    Each row is judged by its whole text (64 bits of hash stand for it), whether or not its id is null or
    repeated; null and empty texts and those of under 12 tokens stay; equal rows go or stay together; an
    empty table gives an empty result; other columns, whatever their names, pass through.
    """
    key, name = F.xxhash64(F.col(text).cast("string")), fresh(docs, "gone")
    found = overlaps(docs.where(F.col(text).isNotNull()).select(key.alias("doc_id"), F.col(text).alias("text")), bench, "doc_id", "text")
    gone = settle(found.select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small_or_shuffled(gone), key == gone[name], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    tokens = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    read = " UNION ALL ".join(
        f"SELECT id, pos, h, {m} AS m, concat_ws(' ', {', '.join(f'h[pos + {j + 1}]' for j in r)}) AS key FROM {{}}_at" for m, r in enumerate(_READ)
    )
    side = lambda name, table, key: (
        f"{name} AS (SELECT {key} AS id, {tokens} AS h FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL), "
        f"{name}_at AS (SELECT id, h, unnest(range(len(h) - {_SPAN - 1})) AS pos FROM {name} WHERE len(h) >= {_SPAN}), {name}_seed AS ({read.format(*[name] * len(MASKS))})"
    )
    return f"""WITH {side("d", "documents", "doc_id")}, {side("b", "benchmark", "item_id")},
hits AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS shift, greatest(b.pos - {PAD}, 0) AS lo, least(b.pos + {_SPAN + PAD}, len(b.h)) AS hi, d.h AS dh, b.h AS bh
  FROM d_seed d JOIN b_seed b ON d.m = b.m AND d.key = b.key),
counted AS (SELECT doc_id, item_id, hi - lo AS n, len(list_filter(range(lo, hi), lambda q: q + shift >= 0 AND q + shift < len(dh) AND dh[q + shift + 1] = bh[q + 1])) AS same FROM hits)
SELECT doc_id, item_id, count(*) AS n_hits, max(same)::BIGINT AS most_equal FROM counted WHERE same >= ceil(n * {AGREE}::DOUBLE) GROUP BY doc_id, item_id"""


SQL = _sql()
