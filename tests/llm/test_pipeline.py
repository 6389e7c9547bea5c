"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_partenum import brute
from tidemark.llm import queries, quality_rules

SMALL = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = corpus_pipeline.staging.table(spark, SMALL, "documents")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.staging.stage(stage(spark, docs, SMALL))
        seen.append(name)
        if name != "packing":
            assert docs.columns == names
        if name == "quality_rules":
            kept = {r["doc_id"] for r in quality_rules.score(before).where("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        if name == "near_copies":
            _, component = brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == set(component.values())
        if name == "surrogates":
            assert docs.count() == before.count()
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()}
    assert seen == ["language_id", "quality_rules", "near_copies", "surrogates", "packing"]


def test_odd_documents_pass_all_stages(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", odd["score"].alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staging.stage(stage(spark, docs, SMALL))
    assert docs.count() > 0
    docs = odd.where("false").selectExpr("doc_id", "text", "lang", "source", "score AS n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staging.stage(stage(spark, docs, SMALL))
    assert docs.count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    """12 MB of texts in one task: no stage may hold them as one batch."""
    setting = corpus_pipeline.staging.BATCH_SETTING
    before = spark.conf.get(setting, None)
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat(concat('w', id, ' '), 800) AS text", "'en' AS lang", "'a' AS source").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "surrogates":  # without Python
                continue
            spark.conf.unset(setting)
            stage(spark, docs.limit(0), SMALL)
            found = docs.mapInArrow(sizes, "n bigint, bytes bigint").collect()
            assert sum(r["n"] for r in found) == 3000
            assert max(r["bytes"] for r in found) < 3 << 20, name
        spark.conf.set(setting, "1m")
        corpus_pipeline.staging.small_batches(spark)
        assert spark.conf.get(setting) == "1m"
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = queries.QUERIES[name](spark, SMALL)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in rows.collect()))) == sorted(map(str, want.fetchall()))


def test_ten_operators_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names
