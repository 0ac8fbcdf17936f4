import glob
import os

import duckdb
import pandas as pd
import pytest

from tests.llm.helpers import documents, written
from tidemark.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), c.execute(SQL[name]).df()
    # a column of integers with nulls is one of floats on one side and of nullable integers on the other
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    key = lambda df: sorted((tuple("" if pd.isna(v) else str(whole(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)))
    assert key(got) == key(want)


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "exact_dedup", "ngram_join", "packing"]
    out = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    packed = out.select("doc_id").distinct().count()
    assert 100 < packed < docs.count()
    assert out.filter("length > 1024").count() == 0


def test_stages_stand_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    docs = written(spark, documents(spark), f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, written(spark, rows, f"{tmp_path}/{k}-{rows.count()}"), str(tmp_path))
            assert out.count() <= max(1, rows.count() * 20)
            if k < 4:
                assert out.columns == docs.columns
