"""The registered queries at sf0.001: DuckDB SQL where there is any, and the pipeline's stages."""
import duckdb
import pytest

import corpus_pipeline
from creditlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, name):
    run, sql = QUERIES[name]
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(sql)
    got = run(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda row: tuple(str(round(v, 4) if isinstance(v, float) else v) for v in row)
    assert sorted(map(plain, got.select(*want.columns).collect())) == sorted(map(plain, want.fetchall()))


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns and 0 < out.count() <= before
        docs, before = out, out.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
