import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import attribution, bpe, common, components, decontaminate, linededup, neardup, pitman_yor, quality, substrings

from .data import SCHEMA, rows, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def duck(docs, sql, **more):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    for k, v in more.items():
        con.register(k, v)
    return sorted(map(tuple, con.sql(sql).fetchall()), key=repr)


# words and hashes


def test_flat_words_split_like_the_pattern():
    import pyarrow as pa

    texts = ["a B\x1cc\xa0d  e", None, "", "\x0b\x0c", "Ünï x"]
    codes, dictionary, starts = common.flat_words(pa.array(texts))
    got = [[dictionary[c].decode() for c in codes[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


def test_window_hash_is_a_function_of_its_window():
    h = np.array([3, 1, 4, 1, 5, 3, 1, 4, 9, 2, 6], np.uint64)
    for k in range(1, 12):
        w = common.window_hash(h, k)
        groups = collections.defaultdict(set)
        for i, x in enumerate(w):
            groups[tuple(h[i : i + k])].add(int(x))
        assert len(w) == len(h) - k + 1 and all(len(v) == 1 for v in groups.values()) and len({*map(int, w)}) == len(groups)


# quality rules


def brute_counts(text):
    ws = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(ws) - 4):
        at[tuple(ws[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [None, "", "a b c d e a b c d e", "a " * 30, "x\nx\n\nx \n y#%|", "p q r s t u p q r s t v p q r s t", "é <b>& " * 9])
def test_quality_counts(text):
    m = quality.measure(text)
    assert (m[0], m[1], m[2], m[3], m[5]) == brute_counts(text)


def test_quality_rejects_outliers_only(spark):
    good = [(i, f"plain words number {i} and some more of them here to read in full", "en", "a", 1, *["x"] * 4) for i in range(300)]
    junk = [(900 + i, " ".join(f"w{j}###$$$" for j in range(12)), "en", "a", 1, *["x"] * 4) for i in range(5)]
    df = spark.createDataFrame(good + junk, SCHEMA)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300))


def test_quality_fences_follow_the_spread_of_the_group(spark):
    """The same odd documents are outliers in a narrow group and usual in a wide one; a few repeated lines are not an outlier where some have them."""
    rest = ["x"] * 4
    words = lambda i, size, n=0: " ".join(("abcdefghijklmnop" * 2)[(i + 3 * j) % 16 :][:size] + " #" * (j < n) for j in range(20))
    odd = [(1000 + i, words(i, 7), 20) for i in range(3)] + [(1100 + i, words(i, 5, 8), 20) for i in range(3)]
    narrow = [(i, words(i, 5), "en", "narrow", 1, *rest) for i in range(400)]
    wide = [(i + 5000, words(i, 4 + i % 4, i % 12), "en", "wide", 1, *rest) for i in range(400)]
    lines = [(3000 + i, f"{words(i, 5)}\n" + "\n".join(f"{x * 5} lines" for x in "abcdefgh") + "\naaaaa lines", "en", "narrow", 1, *rest) for i in range(12)]
    df = spark.createDataFrame(narrow + wide + lines + [(i + b, t, "en", s, 1, *rest) for s, b in (("narrow", 0), ("wide", 5000)) for i, t, _ in odd], SCHEMA)
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {r[0] for r in narrow + wide + lines} | {5000 + i for i, _, _ in odd}


def test_quality_edge_cases(docs, empty):
    out, name = quality.judged(docs)
    got = {r.doc_id: r[name] for r in out.collect()}
    for r in docs.collect():
        assert tuple(got[r.doc_id][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(r.text)
    assert not got[1000].kept and not got[1001].kept and got[1002].base_failed
    assert out.count() == docs.count() and quality.keep_good(empty).count() == 0


def test_quality_verdict_equals_brute_force(spark):
    """Fences from exact quantiles of each group, its language or all; documents that the sketch's 1 % puts beside a fence may fall on either side."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    for reach, least in ((quality.REACH, 30), (1.0, quality.MIN_GROUP)):
        out, name = quality.judged(docs, min_group=least, reach=reach)
        given = [(r.doc_id, r.lang, r.source, brute_counts(r.text), r[name].kept, len([x for x in (r.text or "").split("\n") if WORD.search(x)])) for r in out.collect()]

        def rates(m, lines):
            n = max(m[0], 1)
            return m[1] / n, m[2] / n, m[3] / max(lines, 1)

        good = [(lang, src, rates(m, ln)) for _, lang, src, m, _, ln in given if m[0] >= 10 and 100 * m[4] <= 20 * m[0]]
        groups = collections.defaultdict(list)
        for lang, src, r in good:
            for key in ((lang, src), (lang,), ()):
                groups[key].append(r)

        def fence(lang, src, i):
            key = next(k for k in ((lang, src), (lang,), ()) if len(groups[k]) >= least or k == ())
            x = sorted(r[i] for r in groups[key])
            low, high = (x[max(math.ceil(len(x) * p) - 1, 0)] for p in quality.METRICS[i][4])
            d = max(high - low, quality.METRICS[i][1]) * reach
            return low - d if quality.METRICS[i][2] else -math.inf, high + d if quality.METRICS[i][3] else math.inf

        sure = rejected = 0
        for _, lang, src, m, kept, ln in given:
            if m[0] < 10 or 100 * m[4] > 20 * m[0]:
                assert not kept
                continue
            r = rates(m, ln)
            bounds = [fence(lang, src, i) for i in range(3)]
            slack = [0.0101 * max(abs(lo) if lo > -math.inf else 0, abs(hi), 0.01) * (1 + 2 * reach) for lo, hi in bounds]
            if all(min(abs(v - lo), abs(v - hi)) > e for v, (lo, hi), e in zip(r, bounds, slack)):
                sure += 1
                assert kept == all(lo <= v <= hi for v, (lo, hi) in zip(r, bounds)), (r, bounds)
            rejected += not kept
        assert sure > 0.5 * len(good) and rejected > 0


# line deduplication


def test_line_dedup_matches_sql(docs, empty):
    out, name = linededup.without_boilerplate(docs)
    got = sorted([(r.doc_id, r.source, r.text, r[name].n_lines, r[name].n_removed) for r in out.collect()], key=repr)
    want = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in x) for x in duck(docs, linededup.SQL)]
    assert got == sorted([(None if a is None else int(a), *x) for a, *x in want], key=repr)
    assert sum(x[4] for x in got) > 0
    assert linededup.clean(docs).columns == docs.columns and linededup.clean(empty).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    same = [(i, "alpha beta\ngamma delta", "en", "s", 1, *["x"] * 4) for i in range(50)]
    other = [(100 + i, f"line {i}\nmenu", "en", "s", 1, *["x"] * 4) for i in range(50)]
    got = {r.doc_id: r.text for r in linededup.clean(spark.createDataFrame(same + other, SCHEMA)).collect()}
    assert got[0] == "alpha beta\ngamma delta" and got[100] == "line 0"


# near duplicates


def jaccard_components(given, k, percent):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {i: shingles(t) for i, t in given if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k,percent", [(4, 80), (5, 80)])
def test_near_duplicates_match_all_pairs(docs, k, percent):
    want = jaccard_components([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = [r for r in neardup.near_duplicates(docs, k=k, percent=percent).collect()]
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert sum(not v[2] for v in want.values()) > 10


def test_chain_of_copies_whose_first_is_no_center(spark):
    """Each copy differs from the base only; copies differ from each other too much; the base has the greatest id."""
    base = [f"b{i}" for i in range(300)]
    given = []
    for i in range(40):
        w = list(base)
        for j in range(5):
            w[(7 * i + 60 * j) % 300] = f"c{i}_{j}"
        given.append((i, " ".join(w)))
    given.append((500, " ".join(base)))
    want = jaccard_components(given, 5, 80)
    got = neardup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_an_id_with_two_texts_links_both(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    given = [(1, " ".join(a)), (5, " ".join(b)), (5, " ".join([*a[:-1], "tail"])), (9, " ".join([*b[:-1], "end"])), (None, " ".join([*a[1:], "x"]))]
    got = neardup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False)]


def test_one_of_each_judges_rows_by_their_text(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    given = [(None, a), (None, a), (7, b), (7, b), (7, a), (8, b + " end"), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in given], "doc_id long, text string, component string, node string")
    got = sorted((tuple(r)[:2] for r in neardup.one_of_each(df).collect()), key=repr)
    assert got == sorted([(7, a), (7, b), (None, None), (None, None), (3, "")], key=repr)
    only = spark.createDataFrame([(None, a), (None, a + " z"), (None, b)], "doc_id long, text string")
    assert neardup.one_of_each(only).count() == 2


@pytest.mark.parametrize("block,limit", [(neardup.BLOCK, common.BROADCAST_ROWS), (4, 0)])
def test_classes_that_buckets_connect_but_no_link_does(spark, monkeypatch, block, limit):
    """Variants of one text that are similar in a chain or too little, in sets larger and smaller than a block."""
    import random

    rng, given = random.Random(8), []
    for g in range(3):
        base = [f"g{g}_{i}" for i in range(160)]
        for i in range(24):
            w = list(base)
            for j in rng.sample(range(160), rng.choice([1, 3, 5, 8])):
                w[j] = f"z{rng.randrange(10**6)}"
            given.append((rng.randrange(1000), " ".join(w)))
    given = list({i: (i, t) for i, t in given}.values())
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FEW_BLOCKS", 8 * (limit > 0))
    monkeypatch.setattr(components, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(common.beside, "__defaults__", (None, limit))
    monkeypatch.setattr(common.small_or_shuffled, "__defaults__", (None, limit))
    got = neardup.near_duplicates(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == jaccard_components(given, 5, 80)


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0 and neardup.one_of_each(empty).columns == empty.columns


def test_components_of_a_long_path(spark, monkeypatch):
    path = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200), (None, 5)]
    for limit in (components.BROADCAST_ROWS, 0):
        monkeypatch.setattr(components, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(common.beside, "__defaults__", (None, limit))
        got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
        assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


# decontamination


@pytest.fixture(scope="module")
def bench(spark, docs):
    by = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, " ".join(by[4].split()[:30]).upper()), (2, by[1]), (2, by[1]), (3, None), (4, ""), (5, "too short"), (None, by[5]), (6, "un related words that occur in no document at all here or there ever")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit,keys", [(decontaminate.INDEX_ROWS, 0), (0, decontaminate.KEY_ROWS), (0, 0)])
def test_decontamination_matches_sql(docs, bench, limit, keys):
    got = sorted((r.doc_id, r.item_id, r.n_hits, r.most_equal) for r in decontaminate.overlaps(docs, bench, limit=limit, keys=keys).collect())
    b = bench.toPandas().astype({"item_id": "Int64"})
    d = docs.toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", d)
    con.register("benchmark", b)
    assert got == sorted(con.sql(decontaminate.SQL).fetchall()) and len(got) > 3


def test_decontamination_tolerates_substitutions(spark):
    item = [f"t{i}" for i in range(40)]
    near = list(item)
    for i in range(3, 40, 9):
        near[i] = "changed"
    far = [w if i % 2 else "changed" for i, w in enumerate(item)]
    given = [(1, "before " + " ".join(near) + " after", *[None] * 7), (2, " ".join(far), *[None] * 7), (3, " ".join(item[10:24]), *[None] * 7)]
    got = decontaminate.without_overlaps(spark.createDataFrame(given, SCHEMA), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [2]


def test_decontamination_of_nothing(docs, empty, bench):
    assert decontaminate.overlaps(empty, bench).count() == 0
    assert decontaminate.without_overlaps(docs, bench.where("item_id = 99")).count() == docs.count()


# byte pairs


@pytest.fixture(scope="module")
def ranks():
    path, pattern = bpe.multi()
    with open(path, "rb") as f:
        return bpe.parse(f.read()), pattern


def test_encoding_equals_the_library(docs, ranks):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=ranks[0], special_tokens={})
    out, name = bpe.encoded(docs, *bpe.multi())
    assert out.columns == [*docs.columns, name]
    for r in out.collect():
        ids = lib.encode_ordinary(r.text or "")
        assert list(r[name].ids) == ids and r[name].n_tokens == len(ids)
        assert r[name].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r[name].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decoded(out.select(F.col("text").alias("was"), F.col(f"{name}.ids").alias("ids")), bpe.multi()[0])
    assert all((r.was or "") == r.text for r in back.collect())


@pytest.mark.parametrize("piece", [b"", b"a", b"aa", b"aaaa", b"abababab" * 30, bytes(range(256)), b"  \n\n   ", "日本語テキスト".encode() * 12, b"x" * 64, b"x" * 65, b"the" * 21])
def test_pieces_equal_naive_merging(ranks, piece):
    table = ranks[0]
    parts = [bytes([c]) for c in piece]
    if piece in table:
        parts = [piece]
    while True:
        best = min(((table.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    enc = bpe.Encoder(table)
    assert enc.pieces([piece, b"other words", piece])[2] == tuple(table[p] for p in parts)
    assert enc.pieces([b"zz", piece])[1] == tuple(table[p] for p in parts)
    if len(piece) > 1 and piece not in table:
        assert enc._long(piece) == tuple(table[p] for p in parts)


# token attribution


def test_attribution_rules(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as f:
        lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse(f.read()), special_tokens={})
    text = "Héllo wörld 日本, tokenization\n\n  of things"
    spans = [(0, 3), (3, 9), (2, 30), (12, 13), (50, 60), (5, 5)]
    data = text.encode()
    ends = np.cumsum([len(lib.decode_single_token_bytes(i)) for i in lib.encode_ordinary(text)])
    starts = np.concatenate([[0], ends[:-1]])
    df = spark.createDataFrame([(text, spans), (None, spans), ("", None)], "text string, at array<struct<start: long, end: long>>")
    for rule in attribution.RULES:
        out, name = attribution.attributed(df, path, pattern, spans="at", rule=rule)
        got = out.collect()
        for part, (a, b) in zip(got[0][name].parts, spans):
            lo, hi = len(text[:a].encode()), len(text[:b].encode())
            if rule == "first":
                want = sum(lo <= s < hi for s in starts)
            elif rule == "last":
                want = sum(lo <= e - 1 < hi for e in ends)
            else:
                want = sum(max(0, min(e, hi) - max(s, lo)) / (e - s) for s, e in zip(starts, ends))
            assert part.tokens == pytest.approx(want), (rule, a, b)
        assert got[0][name].n_tokens == len(ends) and got[1][name].n_tokens == 0 and list(got[2][name].parts) == []
    assert len(data) > len(text)


def test_lines_add_up(docs):
    import public_tokenizers

    out, name = attribution.attributed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in out.collect():
        assert sum(p.tokens for p in r[name].parts) == r[name].n_tokens
        assert "".join((r.text or "")[p.start : p.end] for p in r[name].parts) == (r.text or "")


# repeated passages


def brute_repeats(given, size=20):
    texts = [(i, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for i, t in given]
    first = {}
    for i, w in texts:
        if i is not None:
            for p in range(len(w) - size + 1):
                key = tuple(w[p : p + size])
                first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, w in texts:
        gone = set()
        if i is not None:
            for p in range(len(w) - size + 1):
                if first[tuple(w[p : p + size])] < (i, p):
                    gone.update(range(p, p + size))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_match_brute_force(docs, empty):
    want = brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted([(r.doc_id, *[r.repeats[c] for c in ("n_words", "n_removed", "kept_sha256")]) for r in substrings.deduplicated(docs).collect()], key=repr)
    assert got == want and sum(x[2] for x in want) > 1000
    assert substrings.deduplicated(empty).count() == 0


@pytest.mark.parametrize("seed,limit", [(3, "10MB"), (4, "-1")])
def test_substrings_of_repetitive_texts(spark, monkeypatch, seed, limit):
    import random

    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") for _ in range(60)]
    given = []
    for i in range(150):
        k = rng.randrange(4)
        a = rng.randrange(30)
        w = [[rng.choice("abc") for _ in range(rng.randrange(60))], [rng.choice("xyz") for _ in range(rng.randrange(15))] + base[a : a + rng.randrange(10, 40)], base * rng.randrange(1, 4), ["q"] * rng.randrange(70)][k]
        given.append((rng.randrange(120), " ".join(w)))
    want = brute_repeats(given)
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    monkeypatch.setattr(substrings, "PART_CHARS", 1500)
    got = sorted([(r.doc_id, *[r.repeats[c] for c in ("n_words", "n_removed", "kept_sha256")]) for r in substrings.deduplicated(df).collect()], key=repr)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want


def test_substrings_keep_clashing_columns(spark):
    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, same, 5), (2, same, 6), (2, same, 7), (None, same, 8)], "doc_id long, text string, __cuts int")
    got = sorted((r.doc_id or 0, r["__cuts"], r.n.n_removed) for r in substrings.deduplicated(df, name="n").collect())
    assert got == [(0, 8, 0), (1, 5, 0), (2, 6, 40), (2, 7, 40)]
    with pytest.raises(ValueError):
        substrings.deduplicated(df, name="TEXT")


# language model


def test_pitman_yor_base_and_gain(docs, empty):
    df = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter()
    given = [(r.doc_id, r.text) for r in docs.collect()]
    for i, t in given:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted([(i, held(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, t in given], key=repr)
    out = pitman_yor.scores(df, "held").collect()
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out], key=repr) == want
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out)
    assert all(r.score < 0 for r in out)
    assert pitman_yor.scores(empty.withColumn("held", F.lit(False)), "held").count() == 0
    unseen = pitman_yor.scores(docs.withColumn("held", F.lit(True)), "held").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in unseen)


def test_pitman_yor_parts_flushes_and_spread_contexts(spark, docs, monkeypatch):
    """Cut into many parts and flushes, with a context in a third of all pairs, counts stay exact and scores close."""
    hot = spark.createDataFrame([(5000 + i, " ".join(f"the w{(i * 7 + j) % 300}" for j in range(60))) for i in range(60)], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(hot).withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    few = sorted(map(tuple, pitman_yor.scores(df, "held").collect()), key=repr)
    monkeypatch.setattr(pitman_yor, "PART_CHARS", 5000)
    many = sorted(map(tuple, pitman_yor.scores(df.repartition(7), "held").collect()), key=repr)
    assert [x[:5] for x in few] == [x[:5] for x in many] and [x[5] for x in few] == pytest.approx([x[5] for x in many])
    assert sum(x[6] for x in many) == pytest.approx(sum(x[6] for x in few), rel=0.02)


def test_pitman_yor_beats_a_bigram_of_fixed_discount(spark):
    """On held-out documents, over the same outcomes, with the discount that suits the bigram best."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    learn, test = ([re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode().lower()) + [None] for r in docs.where(F.col("held") == h).collect()] for h in (False, True))
    one, two, ctx, follow = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for t in learn:
        one.update(t)
        two.update(pairs := list(zip([b"<s>", *t], t)))
        ctx.update(a for a, _ in pairs)
    follow.update(a for a, _ in two)
    n, single = sum(one.values()), sum(x == 1 for x in one.values())
    best = math.inf
    for d in (0.5, 0.6, 0.7, 0.8, 0.9):
        log = 0.0
        for t in test:
            for a, b in zip([b"<s>", *t], t):
                back = one[b] / n * (1 - single / n) if one[b] else single / n
                p = (max(two[a, b] - d, 0) + d * follow[a] * back) / ctx[a] if ctx[a] else back
                log += math.log10(p)
        best = min(best, 10 ** (-log / sum(map(len, test))))
    out = pitman_yor.scores(docs, "held").where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert 10 ** (-out[0] / out[1]) < best


def test_table_draws_follow_their_law():
    d, p, theta, rest, c, n = 0.6, 0.3, 1.4, 3, 7, 40_000
    s = pitman_yor.log_stirling(d)
    weight = np.exp(np.cumsum(np.log(theta + d * (rest + np.arange(c))) + math.log(p)) + s[c, 1 : c + 1])
    weight /= weight.sum()
    rng = np.random.Generator(np.random.PCG64(1))
    t = pitman_yor.draw_tables(np.full(n, c), np.full(n, p), np.full(n, rest), theta, d, rng, s)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - weight).max() < 0.01
    assert (pitman_yor.draw_tables(np.array([0, 1]), np.array([p, p]), np.array([0, 0]), theta, d, rng, s) == [0, 1]).all()


def test_saddle_point_is_close_to_the_exact_law():
    d, c, theta = 0.7, 400, 1.0
    s = pitman_yor.log_stirling(d, c)
    rng = np.random.Generator(np.random.PCG64(2))
    for a in (0.5, 20.0, 300.0):
        rest = 100_000  # so many other tables that each new one has nearly the same weight
        p = a / (theta + d * (rest + 1))
        log = np.cumsum(np.log(theta + d * (rest + np.arange(c))) + math.log(p)) + s[c, 1:]
        weight = np.exp(log - log.max())
        mean = (weight * np.arange(1, c + 1)).sum() / weight.sum()
        t = pitman_yor.draw_tables(np.full(4000, c), np.full(4000, p), np.full(4000, rest), theta, d, rng, pitman_yor.log_stirling(d))
        assert t.mean() == pytest.approx(mean, rel=0.08), a


def test_digamma():
    x = np.array([0.2, 1.0, 3.7, 50.0])
    want = [(math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5 for v in x]
    assert pitman_yor.digamma(x) == pytest.approx(want, abs=1e-6)


def seats_of(pairs):
    """One part that holds (context, word, customers), contexts and words being small numbers."""
    import pickle

    pairs = sorted(pairs)
    ctx, word, c = (np.array(x, np.uint64) for x in zip(*pairs))
    keys, runs = np.unique(ctx, return_counts=True)
    words, code = np.unique(word, return_inverse=True)
    packed = (pitman_yor._rising(keys), pitman_yor._pack(runs.astype(np.uint32)), pitman_yor._rising(words), pitman_yor._pack(code.astype(np.uint32)), pitman_yor._pack(c.astype(np.uint32)))
    return pitman_yor.Seats(pickle.dumps(packed), 0, np.empty(0, np.uint64)), ctx.astype(int), word.astype(int)


def exchange(s, g):
    """The owners' part of a round."""
    from dataclasses import replace

    asked = pd.DataFrame([(0, q, m, None, None) for q, m in s.messages(4)], columns=pitman_yor._NAMES)
    down = pd.concat([pitman_yor._owner(g)(x) for _, x in asked.groupby("kind")])
    sums = np.sum([x for x in down.stats if x is not None], axis=0)
    s.answered(4, {int(r.kind): r.a for r in down[down.part.notna()].itertuples()})
    return replace(g, words=sums[0], tables=sums[4], customers=sums[5]) if g else sums


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    s, ctx, _ = seats_of([(u, w, int(rng.integers(1, 90))) for u in (1, 2, 7) for w in range(30)] + [(u, 99, 0) for u in (1, 2, 7)])
    sums = exchange(s, None)
    g = pitman_yor.Shared(float(s.c.sum()), sums[0], sums[4], sums[5], 0.6, 0.4, 1.3, 0.8, 0.3)
    for _ in range(3):
        s.sweep(g, pitman_yor.log_stirling(g.discount))
        p = s.predictive(g)
        for k in (1, 2, 7):
            assert p[ctx == k].sum() == pytest.approx(1.0)


def test_sampler_agrees_with_customer_by_customer_seating():
    """A plain Chinese-restaurant sampler that moves single customers at both levels, with the same parameters."""
    import random

    pairs = [(1, 1, 6), (1, 2, 2), (2, 1, 3), (2, 3, 9), (3, 2, 4), (3, 3, 1), (4, 1, 2)]
    d, theta, d0, theta0, words = 0.6, 1.2, 0.4, 0.9, 3
    s, ctx, word = seats_of(pairs)
    sums = exchange(s, None)
    g = pitman_yor.Shared(27.0, sums[0], sums[4], sums[5], d, d0, theta, theta0, 0.0)
    mine = np.zeros(len(s.c))
    for i in range(3000):
        s.sweep(g, pitman_yor.log_stirling(d))
        g = exchange(s, g)
        if i >= 200:
            mine += s.predictive(g)
    mine /= 2800
    rng = random.Random(4)
    low = collections.defaultdict(list)  # (context, word): sizes of tables
    top = collections.defaultdict(list)  # word: sizes of the root's tables

    def root(w):
        c, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (sum(top[w]) - d0 * len(top[w]) + (theta0 + d0 * t) / words) / (theta0 + c)

    def seat(tables, new, disc):
        x = rng.random() * (sum(tables) - disc * len(tables) + new)
        for i, n in enumerate(tables):
            x -= n - disc
            if x < 0:
                tables[i] += 1
                return False
        tables.append(1)
        return True

    def add(u, w):
        t = sum(len(v) for (a, _), v in low.items() if a == u)
        if seat(low[u, w], (theta + d * t) * root(w), d):
            seat(top[w], (theta0 + d0 * sum(map(len, top.values()))) / words, d0)

    def leave(tables):
        x = rng.random() * sum(tables)
        for i, n in enumerate(tables):
            x -= n
            if x < 0:
                tables[i] -= 1
                if not tables[i]:
                    del tables[i]
                    return True
                return False

    def remove(u, w):
        if leave(low[u, w]):
            leave(top[w])

    customers = [(u, w) for u, w, n in pairs for _ in range(n)]
    for x in customers:
        add(*x)
    want = np.zeros(len(s.c))
    for i in range(3000):
        for x in customers:
            remove(*x)
            add(*x)
        if i >= 200:
            for j, (u, w) in enumerate(zip(ctx, word)):
                t = sum(len(v) for (a, _), v in low.items() if a == u)
                n = sum(sum(v) for (a, _), v in low.items() if a == u)
                want[j] += (sum(low[u, w]) - d * len(low[u, w]) + (theta + d * t) * root(w)) / (theta + n)
    # all pairs of a turn are redrawn at once, which such a small corpus feels a little
    assert mine == pytest.approx(want / 2800, abs=0.025)


def test_columns_of_any_name_pass_through(spark, docs):
    import public_tokenizers

    names = ["__lines", "__lines_host", "__lines_drop", "__quality", "__quality_lo", "__bpe", "__tokens", "__gone", "__key"]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    path = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    none = spark.createDataFrame([], "item_id long, text string")
    for out in (linededup.clean(df), quality.keep_good(df), neardup.one_of_each(df), decontaminate.without_overlaps(df, none)):
        assert out.columns == df.columns and all(r[n] == i for r in out.select(*names).limit(5).collect() for i, n in enumerate(names))
    for out, name in (linededup.without_boilerplate(df), quality.judged(df), bpe.encoded(df, *path), attribution.attributed(df, *path)):
        assert out.columns == [*df.columns, name] and out.count() == df.count()


def test_one_very_long_text(spark):
    """A text of over a million words, beside a short one that repeats a passage of it."""
    words = [f"w{i * 7919 % 50021}" for i in range(1_100_000)]
    df = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, "a b " + " ".join(words[500_000:500_040]), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.repeats for r in substrings.deduplicated(df, with_text=False).collect()}
    assert got[2].n_removed == 40 and got[1].n_words == len(words)
    assert {r.doc_id for r in neardup.one_of_each(df).collect()} == {1, 2}
    scored = {r.doc_id: r for r in pitman_yor.scores(df.withColumn("held", F.lit(False)), "held").collect()}
    assert scored[1].n_tokens == len(words) + 1 and scored[2].n_known == 43
    item = spark.createDataFrame([(9, " ".join(words[900_000:900_030]))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.overlaps(df, item).collect()] == [1]
    assert linededup.clean(df).where("doc_id = 1").first().n_chars == len(" ".join(words))


@pytest.mark.parametrize("name", ["op6_token_counts", "op8_toxicity", "op9_byte_bpe", "op3_quality_rules", "op1_url_filter"])
def test_queries_of_empty_tables(spark, tmp_path, name):
    from tessera.llm import registry

    for t, kind in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_rows_are_what_the_fixture_says():
    assert len(rows()) == 130 and pd.Series([r[0] for r in rows()]).isna().sum() == 2
