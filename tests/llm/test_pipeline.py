"""The pipeline against a brute-force version of each stage, each on that stage's own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, linededup, quality, registry

from .data import SCHEMA, rows
from .test_text_operators import duck, jaccard_components


def test_every_stage(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None], SCHEMA).select(*columns)
    bench = spark.createDataFrame([(1, [r for r in rows() if r[0] == 4][0][1])], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "encoding"]
    at, seen = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        before, after = at.collect(), out.collect()
        ids = sorted(r.doc_id for r in after)
        if name != "encoding":
            assert out.columns == columns
        if name == "quality rules":
            judged, field = quality.judged(at)
            assert ids == sorted(r.doc_id for r in judged.collect() if r[field].kept) and 1000 not in ids and len(ids) > 50
        elif name == "line dedup":
            want = {int(r[0]): r[2] for r in duck(at, linededup.SQL)}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        elif name == "near dedup":
            want = jaccard_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert ids == sorted(r.doc_id for r in before if want[r.doc_id][2]) and len(ids) < len(before)
        elif name == "decontamination":
            hit = {r[0] for r in duck(at, decontaminate.SQL, benchmark=bench.toPandas())}
            assert ids == sorted(r.doc_id for r in before if r.doc_id not in hit) and hit
        else:
            text = {r.doc_id: r.text for r in before}
            back = bpe.decoded(out.select("doc_id", "ids"), bpe.multi()[0]).collect()
            assert {r.doc_id: r.text for r in back} == text
        seen.append(len(after))
        at = out
    assert spark.read.parquet(str(tmp_path / "4")).count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    assert seen == sorted(seen, reverse=True)


def test_decontamination_judges_each_row_by_its_text(spark):
    item, clean = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    given = [(None, item), (None, clean), (1, item), (1, clean), (2, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = [(r.doc_id, r.text) for r in decontaminate.without_overlaps(docs, bench).collect()]
    assert sorted(got, key=repr) == sorted([(None, clean), (1, clean), (2, None)], key=repr)


def test_registered_queries():
    assert {n.split("_")[0] for n in registry.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
