"""The pipeline stage by stage against the operators' own outputs."""

import pytest
from pyspark.sql import functions as F
from test_text_operators import labelled_docs

import corpus_pipeline
from natal.llm import packing, quality, simhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, labels = labelled_docs(spark)
    path = tmp_path_factory.mktemp("tables")
    d.select(*COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def test_stages(spark, tables):
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    toxic, good, single, pack = (f for _, f in corpus_pipeline.STAGES)
    names = docs.columns

    rejected = {r.doc_id for r in toxicity.score_documents(docs, labels).filter("predicted = 1").collect()}
    kept = toxic(spark, docs, tables)
    assert kept.columns == names and rejected
    assert ids(kept) == ids(docs.filter(~docs.doc_id.isin(*[i for i in rejected if i is not None]) | docs.doc_id.isNull()))

    rejected = {r.doc_id for r in quality.score_documents(kept, labels).filter("predicted = 0").collect()}
    better = good(spark, kept, tables)
    assert better.columns == names and rejected
    assert {i[1] for i in ids(better) if not i[0]}.isdisjoint(rejected)

    one = single(spark, better, tables)
    assert one.columns == names
    groups = simhash.near_duplicates(better)
    assert one.count() == groups.select("component_id").distinct().count()
    assert {i[1] for i in ids(one) if not i[0]} == {r[0] for r in groups.select("component_id").distinct().collect() if r[0] is not None}

    assert pack(spark, one, tables).agg({"length": "sum"}).first()[0] == packing.pieces(one).agg({"length": "sum"}).first()[0]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 0
    assert out.columns[:2] == ["doc_id", "piece"]


def test_clashing_columns_and_repeated_rows_pass(spark, tables, tmp_path):
    d, labels = labelled_docs(spark)
    d = d.withColumns({"fold": F.lit("f"), "n": F.lit("n"), "key": F.lit(1), "component": F.lit(None).cast("int"), "size": F.lit("s")})
    d.union(d).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.simpleString() == d.schema.simpleString()
    docs = docs.cache()
    assert docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty()
    assert docs.count() > 0 and docs.filter("fold <> 'f' or n <> 'n' or key <> 1 or component is not null or size <> 's'").isEmpty()


def test_stages_without_labels(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic, good = (f for _, f in corpus_pipeline.STAGES[:2])
    assert toxic(spark, docs, str(tmp_path)).count() == docs.count()
    assert good(spark, docs, str(tmp_path)).isEmpty()


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
