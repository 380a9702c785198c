"""The pipeline's stages on small tables, and the queries against their SQL."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import agree
from quarrylight.llm import lm_scoring, queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    agree(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


@needs_data
def test_lm_scoring_counts_trigrams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    trigrams = lm_scoring.lm_scores(docs, order=3)
    assert sorted(map(repr, queries.QUERIES["op6_lm_scoring"](spark, SF).collect())) == sorted(map(repr, trigrams.collect()))


@pytest.fixture
def tables(spark, tmp_path):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) + "." for i in range(40)]
    near = [good[0].replace("w0x7 ", "changed "), good[1] + " more"]
    junk = [" ".join(f"j{i}j{j}###" for j in range(40)) for i in range(12)]
    short = ["too short", "", None]
    texts = good + near + [good[2]] + junk + short
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 43), 0) for i in range(len(texts)) if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), texts


def test_stages(spark, tables):
    sf_dir, texts = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs.write.mode("overwrite").parquet(f"{sf_dir}/stage{len(ids)}")
        docs = spark.read.parquet(f"{sf_dir}/stage{len(ids)}")
        ids.append(sorted(r.doc_id for r in docs.collect()))
    classified, ruled, deduped, mixed = ids
    assert set(range(40)) <= set(classified) and texts.index("") not in classified
    assert set(range(40)) <= set(ruled) and not set(ruled) & set(range(43, len(texts)))
    assert deduped == list(range(40))  # 40 and 41 are near copies of 0 and 1, 42 a copy of 2
    assert mixed == deduped
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == set(mixed)
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    assert all(whole[r.doc_id] == r.doc_tokens for r in pieces)


def test_rows_without_ids_are_judged_by_themselves(spark, tables):
    """The same rows with null ids: junk goes, one row of each group stays."""
    sf_dir, texts = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in (corpus_pipeline.rules, corpus_pipeline.dedupe):
        wanted = Counter(r.text for r in stage(spark, docs, sf_dir).collect())
        got = Counter(r.text for r in stage(spark, docs.withColumn("doc_id", F.lit(None).cast("long")), sf_dir).collect())
        if stage is corpus_pipeline.rules:
            assert got == wanted
        else:  # which of a group stays is up to the keys
            assert sum(got.values()) == sum(wanted.values()) and len([t for t in got if t in texts[2:40]]) == 38


def test_run_equals_its_stages(spark, tables):
    sf_dir, _ = tables
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == set(range(40))


def test_stages_on_nothing(spark, tables, tmp_path):
    sf_dir, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_take_nulls_everywhere(spark, tables):
    sf_dir, texts = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.union(spark.createDataFrame([(None, texts[3], None, None, None), (None, None, None, None, None)], docs.schema)).union(docs.filter("doc_id = 5"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sf_dir)
        alone = stage in (corpus_pipeline.dedupe, corpus_pipeline.mix)
        assert odd.filter("doc_id = 5").count() == (1 if alone else 2)  # rows are judged one by one; of copies one stays
        assert odd.filter("doc_id is null").count() == (0 if alone else 1)
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).count() > 0
