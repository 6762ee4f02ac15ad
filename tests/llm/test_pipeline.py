"""The corpus pipeline stage by stage, and its edges."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_edges import ROWS  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    # further columns whose names the stages use inside
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name in ("__row", "__text", "__id", "__found", "__counts", "h", "copies", "size", "block", "again"):
        df = df.withColumn(name, F.lit(name))
    return df


def test_stages_keep_columns_and_survive_edges(spark, docs):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, and no rows at all."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        rows = out.count()
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
        assert rows == {"quality_rules": 5, "ngram_join": 8, "pii_surrogates": len(ROWS)}.get(name, rows) and rows > 0
        assert stage(spark, docs.limit(0), D).count() == 0, name


def test_run_equals_its_stages(spark):
    """Each stage works on all that the one before kept, and its decisions take effect."""
    from tideline.llm import mixing, ngram_join, pii, quality_rules

    final = corpus_pipeline.run(spark, D).toPandas()
    docs = spark.read.parquet(f"{D}/documents.parquet")
    judged = quality_rules.judge(docs).where("kept").select("doc_id")
    good = docs.join(judged, "doc_id", "left_semi")
    lead = ngram_join.components(good).where("doc_id = component_id").select("doc_id")
    alone = good.join(lead, "doc_id", "left_semi")
    clean = pii.surrogates(alone, "no secret").join(alone.select("doc_id", "source"), "doc_id")
    wanted = mixing.taken_words(clean).where("copies > 0").toPandas()
    assert 0 < len(wanted) < docs.count()
    pieces = final[final.start == 0].groupby("doc_id").size()
    assert dict(pieces) == dict(zip(wanted.doc_id, wanted.copies))
    placed = final.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all() and (placed.offset + placed.length <= 1024).all()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "pii_surrogates", "mixing", "best_fit_packing"]
