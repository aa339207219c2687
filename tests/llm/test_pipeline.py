"""The pipeline against each stage's own brute force, and on awkward tables."""

import shutil

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import decontaminate, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns and docs.count() - kept.count() <= 2
    single = corpus_pipeline.drop_near_duplicates(spark, kept, SF)
    rows = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in kept.select("doc_id", "text").collect())
    fp = np.array([f for _, f in rows], np.uint64)
    root = np.arange(len(rows))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    while True:
        new = np.where(near, root[None, :], len(rows)).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert sorted(r.doc_id for r in single.collect()) == [rows[i][0] for i in range(len(rows)) if root[i] == i]
    clean = corpus_pipeline.drop_contaminated(spark, single, SF)

    def bad(t):
        d = decontaminate.tokens(t)
        return any(decontaminate.agreement(d, b, s) for b in bench for s in {i - j for i, x in enumerate(d) for j in np.flatnonzero(b == x)})

    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not bad(r.text))
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert corpus_pipeline.write_tokens(spark, mixed, SF).count() == mixed.count()


def test_awkward_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, _language int"
    rows = [(1, "ein text " * 9, "de", "a", None, "x", 1), (1, "ein text " * 9, "de", "a", None, "x", 1), (None, None, None, None, None, None, None), (3, "", "de", None, None, None, None), (4, "other words here now", "en", "b", 5, "y", 2)]
    shutil.copy(f"{SF}/benchmark.parquet", tmp_path / "benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
        assert (docs.where("doc_id = 1").count() > 0) == bool(table)
        ids = sorted(r.doc_id for r in corpus_pipeline.write_tokens(spark, docs, str(tmp_path)).collect())
        assert ids == sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids


def test_run_leaves_no_tables_of_earlier_stages(spark):
    import os

    from tracewright.llm.common import shared_root

    folder = f"{shared_root(spark).removeprefix('file://')}/{spark.sparkContext.applicationId}"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, SF)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left == {"token", "tokens"} and rows.count() > 0


def test_registered(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5


def test_sql(spark):
    from compare import duck, rows

    con = duck(SF)
    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(con.execute(sql).fetchdf()), name
