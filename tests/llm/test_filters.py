import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity, urls

# url rules and reputation


def test_host_path_and_rules(spark):
    cases = [
        (1, "http://A.Example.NET/en/x?q=1", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://b.example.net/de/", "b.example.net", "/de/", "net/", "block"),
        (3, "x://y.example.com/de/1#t", "y.example.com", "/de/1", "example.com/de/", "block"),
        (4, "http://z.org/fr/?a://b/c", "z.org", "/fr/", "org/fr/", "allow"),
        (5, "http://net/", "net", "/", "net/", "block"),
        (6, "http://example.net", "example.net", "", None, "allow"),
        (7, "no scheme", "", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "http://planet/x", "planet", "/x", None, "allow"),
        (10, "://?x", "", "", None, "allow"),
        (None, "ftp://h.net/a", "h.net", "/a", "net/", "block"),
    ]
    df = spark.createDataFrame([(c[0], c[1], "clash") for c in cases], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, good boolean")
    out, name = urls.judged(df, none)
    got = sorted(((r.page_id, r.url, r[name].host, r[name].path, r[name].rule, r[name].verdict) for r in out.collect()), key=repr)
    assert got == sorted(cases, key=repr) and out.columns == ["page_id", "url", "host", name]
    assert urls.judged(df.limit(0), none)[0].count() == 0


def test_bad_hosts_are_blocked_and_unknown_ones_are_not(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 3}.test/{i}") for i in range(240)] + [(900, "http://new.site1.test/")]
    outcomes = [(i, not i % 2) for i in range(240)] + [(3, None), (None, True)]
    out, name = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good boolean"))
    got = {r.page_id: r[name] for r in out.collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(240)) and got[900].verdict == "allow"
    assert 0.3 < got[900].a / (got[900].a + got[900].b) < 0.7


def test_posterior_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    hosts = [(f"h{i}.d{i % 7}.{'abc'[i % 3]}", float(n := rng.integers(0, 30)), float(rng.binomial(n, [0.9, 0.4, 0.6][i % 3]))) for i in range(60)]
    got = {r.host: (r.a, r.b) for r in urls.reputations(spark.createDataFrame(hosts, "host string, n double, k double")).collect()}

    def strength(groups):
        over = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in groups if n)
        of = sum(n * (n - 1) * m * (1 - m) for n, k, m in groups if n)
        return 1 / min(0.9, max(0.001, over / of)) - 1

    def level(groups, key, mean):
        sums = {}
        for name, n, k in groups:
            a = sums.setdefault(key(name), [0, 0, mean(name)])
            a[0] += n
            a[1] += k
        s = strength(sums.values())
        return {g: (k + s * m) / (n + s) for g, (n, k, m) in sums.items()}

    whole = (sum(h[2] for h in hosts) + 1) / (sum(h[1] for h in hosts) + 2)
    suffix = level(hosts, lambda h: h.split(".")[2], lambda h: whole)
    domain = level(hosts, lambda h: h.split(".", 1)[1], lambda h: suffix[h.split(".")[2]])
    s = strength([(n, k, domain[h.split(".", 1)[1]]) for h, n, k in hosts])
    for h, n, k in hosts:
        m = domain[h.split(".", 1)[1]]
        assert got[h] == pytest.approx((k + s * m, n - k + s * (1 - m)))


def test_beta_cdf_by_integration():
    x = np.linspace(0, 0.37, 200_001)
    for a, b in ((1, 1), (2.5, 7), (40, 60), (300, 200), (0.9, 3)):
        y = np.linspace(1e-9, 1 - 1e-9, 2_000_001)
        density = y ** (a - 1) * (1 - y) ** (b - 1)
        want = np.trapezoid(density[y <= 0.37], y[y <= 0.37]) / np.trapezoid(density, y)
        assert urls.beta_cdf(0.37, [a], [b])[0] == pytest.approx(want, abs=2e-4)
    assert len(x)


# toxicity


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"{a}{b}{c}" for a in "bdfglm" for b in ("an", "er", "ol") for c in ("ten", "sha", "rio", "kum")])
    bad = ["vilescum", "worthless", "idiotic"]
    out = []
    for i in range(n):
        w = list(rng.choice(vocabulary, rng.integers(20, 200)))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w[rng.integers(len(w))] = bad[rng.integers(3)]
        out.append((" ".join(w), toxic))
    return out


def test_toxic_texts_are_told_apart():
    m = toxicity.fit(corpus(600, 1))
    held = corpus(200, 2)
    p = m.score([t for t, _ in held])
    y = np.array([y for _, y in held])
    assert ((p >= 0.5) == y).mean() > 0.97 and (p >= 0).all() and (p <= 1).all()
    assert m.score([None, "", " \n", "x" * 50_000]).max() < 0.5


def test_both_dictionaries_are_trained():
    m = toxicity.fit(corpus(600, 1))
    assert [d[:4] for d in (m.ordinary, m.toxic)] == [b"\x37\xa4\x30\xec"] * 2
    assert len(m.toxic) <= toxicity.TOXIC_BYTES


def test_boilerplate_and_copies_are_no_evidence():
    """A line in toxic and ordinary documents, and many copies of one toxic document, don't make a text toxic."""
    line = "all rights reserved by the makers of this page and its owners"
    rows = [(f"{line}\n{t}" if i % 2 else t, y) for i, (t, y) in enumerate(corpus(600, 1))]
    copied = next(t for t, y in rows if y)
    m = toxicity.fit(rows + [(copied, 1)] * 60)
    held = corpus(200, 2)
    assert m.score([f"{line}\n{t}" for t, y in held if not y]).max() < 0.5
    assert (m.score([t for t, y in held if y]) >= 0.5).mean() > 0.95
    assert toxicity.own_lines(["a\nb", "b\nc", "a"], ["c"]) == [b" a  b "]


def test_columns_pass_and_names_may_not_clash(spark):
    m = toxicity.fit(corpus(100, 1))
    df = spark.createDataFrame([(None, "vilescum " * 40_000, 1), (None, None, 2)], "doc_id long, text string, windows int")
    got = toxicity.scored(df, m, name="p").collect()
    assert [r.windows for r in got] == [1, 2] and got[0].p > got[1].p
    with pytest.raises(ValueError):
        toxicity.scored(df, m, name="Text")


def test_held_out_accuracy_on_labels(spark):
    """Some labels are wrong, so neither is near 1; both are far over the share of toxic documents."""
    out = toxicity.query(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("toxic is not null").select("toxic", "predicted").collect()
    caught = [r.predicted for r in out if r.toxic]
    assert np.mean(caught) > 0.4 and np.mean([r.toxic for r in out if r.predicted]) > 0.75


def test_one_class_and_no_labels():
    assert toxicity.fit([("a b", 0)] * 5).score(["c"])[0] < 0.01 and toxicity.fit([("a b", 1)] * 5).score([None])[0] > 0.99
    assert toxicity.fit([]).score(["x"])[0] < 0.01


def test_windows_hold_every_word():
    text = "Aa bb " * 100 + "z" * 300 + " end"
    ws = toxicity.windows(text)
    assert b"".join(b"".join(w.split()) for w in ws) == b"".join(text.lower().encode().split())
    assert toxicity.windows(None) == toxicity.windows(" \t") == []


def test_labels_are_read_from_learning_rows_only(spark, tmp_path):
    rows = corpus(300, 3)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(rows)] + [(5000, None, None, None, None), (None, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)] + [(7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    first = {r.doc_id: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert len(first) == 302 and first[5000].predicted == 0 and first[None].held_out is False
    con = duckdb.connect()
    held = [i for i in range(300) if first[i].held_out]
    flipped = spark.read.parquet(str(tmp_path / "labels.parquet")).withColumn("toxic", F.when(F.col("doc_id").isin(held), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped.write.parquet(str(tmp_path / "b" / "labels.parquet"))
    spark.read.parquet(str(tmp_path / "documents.parquet")).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    again = {r.doc_id: r for r in toxicity.query(spark, str(tmp_path / "b")).collect()}
    assert all(first[i].score == again[i].score for i in first)
    assert np.mean([first[i].predicted == rows[i][1] for i in held]) > 0.9
    con.close()
