import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from specflow.llm import queries, simhash
from specflow.session import table

SF = "/root/testdata/sf0.001"


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"
    ]
    assert queries.SQL.keys() <= __spark_entry__.oracle_sql().keys()


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((docs, after))
        docs = after
    return out


def test_stages_return_documents(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    clean = [d["doc_id"] for d in before.collect() if labels.get(d["doc_id"]) == 0]
    toxic = [d["doc_id"] for d in before.collect() if labels.get(d["doc_id"]) == 1]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    assert sum(d in kept for d in toxic) <= 0.2 * len(toxic)


def test_shared_lines_go(stages):
    before, after = stages[1]
    assert after.count() == before.count()
    lines = after.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    key = F.lower(F.trim("line"))
    often = lines.groupBy(key.alias("key")).agg(F.count_distinct("doc_id").alias("n")).filter("key <> '' AND n >= 10")
    assert often.count() == 0
    assert after.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = stages[2]
    groups = simhash.near_duplicates(before).select("component_id").distinct().count()
    assert after.count() == groups < before.count()
    again = simhash.near_duplicates(after).select("component_id").distinct().count()
    assert again == after.count()


def test_no_benchmark_passage_is_left(spark, stages):
    before, after = stages[3]
    found = queries.decontaminate.contamination(before, table(spark, SF, "benchmark"))
    bad = found.filter(queries.decontaminate.is_contaminated()).count()
    assert 0 < bad == before.count() - after.count()


def test_every_id_is_packed_once(stages):
    before, after = stages[4]
    per_doc = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("all"))
    assert per_doc.count() == before.count()
    assert per_doc.filter("n <> all").count() == 0


def test_stages_bear_odd_rows(documents):
    spark = documents.sparkSession
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() > 0


def test_run_applies_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    want = stages[-1][1]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.count() == want.count()
    assert got.select(names).exceptAll(want.select(names)).count() == 0


def test_empty_tables(spark, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
