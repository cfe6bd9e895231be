import re

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
KEPT = re.compile(r"AKIA[0-9A-Z]{16}|[\w.]+@[\w.]+\.com")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "s", 0), (None, "A row without an id but with enough words to stay in the corpus for good.", "en", "s", 5)], docs.schema)
    now, seen = docs.union(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF).cache()
        seen[name] = now.collect()
        if name != "best_fit_packing":
            assert now.columns == docs.columns
            assert {r.doc_id for r in seen[name]} <= {r.doc_id for r in before.collect()}
            assert all(r.n_chars == len(r.text) for r in seen[name] if r.doc_id is not None)
    assert 10_001 not in {r.doc_id for r in seen["quality_rules"]}
    texts = [r.text for r in seen["simhash_near_dedup"]]
    assert len(texts) == len(set(texts))
    old = {m for r in seen["simhash_near_dedup"] for m in KEPT.findall(r.text)}
    assert old and not old & {m for r in seen["pii_surrogates"] for m in KEPT.findall(r.text)}
    assert {r.doc_id for r in seen["best_fit_packing"]} == {r.doc_id for r in seen["pii_surrogates"]}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("column", ["doc_id", "text", "lang", "source", "n_chars"])
def test_nulls_in_a_column(spark, column):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    now = docs.withColumn(column, F.lit(None).cast(docs.schema[column].dataType))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    now.collect()


def test_near_duplicates_with_shared_ids(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long), (1, long), (1, "quite another text of its own that is like no other here"), (2, long + " more"), (3, "a third text with nothing in common with the ones before it"), (None, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert kept == [(False, 1, rows[2][1]), (False, 1, long), (False, 3, rows[4][1]), (True, 0, long)]
