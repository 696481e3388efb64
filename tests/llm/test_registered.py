"""Registered queries: oracles, native plans, the pipeline."""

import os

import harness
import pytest

from netvigil.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    got = harness.spark_side(QUERIES[name](spark, SF_DIR))
    want = harness.duck_side(harness.connect(SF_DIR), ORACLES[name])
    assert got == want


@pytest.mark.parametrize("number", range(1, 14))
def test_one_query_per_operator(number):
    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1


@pytest.mark.parametrize("name", ["op6_chat", "op9_outliers", "op12_linededup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept, columns = {r["doc_id"] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
        left = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(left) == len(set(left)) and set(left) <= kept
        assert name == "pii" or len(left) < len(kept) or name == "decontamination"
        kept = set(left)
    out = pipeline.run(spark, SF_DIR)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == kept


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, and no rows at all, pass every stage."""
    import corpus_pipeline as pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = spark.read.parquet(f"{SF_DIR}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "mail a@b.org", "en", "s", 12), (2, "", "en", "s", 0),
                                 (2, "", "en", "s", 0), (3, "word " * 500, "en", None, 2500)], schema)
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in pipeline.STAGES:
            docs = pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.count() <= rows.count()


def test_filters_tell_rows_apart(spark, tmp_path):
    """A clean row stays beside a toxic or contaminated one of its id; a bad one goes without an id too."""
    import corpus_pipeline as pipeline

    item = "seven copper kettles hang above the narrow stove while nobody counts the evening trains " * 3
    bad = "you worthless scum and idiot clown " * 4
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"{bad} {i}" if i < 30 else f"the river is calm today and boats {i} go by", "en", "s", 1) for i in range(60)]
    rows += [(100, "the river is calm", "en", "s", 1), (100, bad, "en", "s", 1), (None, bad + " x", "en", "s", 1), (None, "boats go by", "en", "s", 1),
             (200, item, "en", "s", 1), (200, "a calm day", "en", "s", 1), (None, "note: " + item, "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, int(i < 30), 1) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(pipeline.STAGES)
    left = {(r["doc_id"], r["text"]) for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()}
    assert (100, "the river is calm") in left and (None, "boats go by") in left and not any("scum" in t for _, t in left)
    left = {(r["doc_id"], r["text"]) for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert (200, "a calm day") in left and len(left) == len(rows) - 2 and not any("kettles" in t for _, t in left)
