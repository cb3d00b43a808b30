"""The operators' queries against their DuckDB oracles, and the pipeline's stages, on the smallest tables."""

import os

import duckdb
import pytest

from pagetrail.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
    key = got.columns[0]
    import pandas as pd

    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True)[sorted(got)], want.sort_values(key).reset_index(drop=True)[sorted(want)], check_dtype=False)


@here
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == names
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= 200
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_removed int, removed_words long, rid long"
    texts = [f"the quick brown fox number {i} jumps over the lazy dog near the river bank while it rains" for i in range(12)] + [f"der schnelle braune fuchs nummer {i} springt über den faulen hund am fluss bei regen und wind" for i in range(12)] + [None, "", "123 456"]
    docs = spark.createDataFrame([(i, t, "en" if i < 12 else "de", "s", 1, 7.0 + i, "kept", 3, 4, 5) for i, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert (r.score, r.lang_pred, r.n_removed, r.removed_words, r.rid) == (7.0 + r.doc_id, "kept", 3, 4, 5), name
    assert {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SF).collect()} <= set(range(24))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
