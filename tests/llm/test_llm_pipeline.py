import duckdb
import pytest
from tests.conftest import SF_CHECK, SF_SMALL

import corpus_pipeline as C
from softlab.llm.queries import REGISTRY
from softlab.llm import substring


def test_every_operator_and_stage_is_registered():
    import __spark_entry__ as E
    names = set(E.queries())
    assert "pipeline" in names and len(C.STAGES) == 5
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1


def test_chat_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_CHECK}/conversations.parquet'")
    q = REGISTRY["op1_chat_format"]
    got = sorted(tuple(r) for r in q.fn(spark, SF_CHECK).collect())
    assert got == sorted(con.sql(q.sql).fetchall()) and got[0][0] == -7


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.shared_table(stage(spark, out[-1], SF_CHECK), "stage"))
    return out


def test_stages_work_on_what_the_one_before_kept(spark, stages):
    docs, good, single, cut, clean, ids = stages
    for x in (good, single, cut, clean):
        assert x.columns == docs.columns and x.schema == docs.schema
    sizes = [x.count() for x in stages]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] == sizes[5] > 0
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    kept = labels.join(good, "doc_id", "left_semi")
    assert kept.filter("quality = 1 and toxic = 0").count() >= 0.98 * labels.filter("quality = 1 and toxic = 0").count()
    assert kept.filter("quality = 0 or toxic = 1").count() <= 0.1 * labels.filter("quality = 0 or toxic = 1").count()
    assert substring.repeats(cut, n=C.PASSAGE_WORDS).agg({"n_removed": "sum"}).first()[0] <= 0.001 * 400_000
    assert single.join(cut, ["doc_id", "text"], "left_semi").count() > 0.7 * sizes[2]     # others are as they were


def test_run_equals_its_stages(spark, stages):
    got = {r["doc_id"]: r["ids"] for r in C.run(spark, SF_CHECK).collect()}
    assert got == {r["doc_id"]: r["ids"] for r in stages[-1].collect()}


def test_small_tables_and_null_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id here", None, None, None), (10**6, None, None, None, None), (3, "again", "en", "s", 5)],
                                docs.schema)
    for rows in (docs.limit(0), docs.unionByName(odd)):
        for _, stage in C.STAGES:
            rows = C.shared_table(stage(spark, rows, SF_SMALL), "stage")
        rows.count()


def test_decisions_belong_to_rows(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    good = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    bad = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(1)
    from pyspark.sql import functions as F
    for same in (None, 10**7):
        both = good.unionByName(bad).withColumn("doc_id", F.lit(same).cast(docs.schema["doc_id"].dataType))
        kept = C.quality_stage(spark, docs.unionByName(both), SF_CHECK)
        back = kept.filter(F.col("doc_id").eqNullSafe(F.lit(same))).select("text").collect()
        assert back == good.select("text").collect()
    words = [" ".join(f"{x}{i * 7919 % 997}" for i in range(80)) for x in "pqr"]
    rows = [(5, words[0]), (5, words[1]), (5, words[1]), (6, words[1] + " end"), (None, words[2]), (None, words[2]), (7, words[2])]
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = sorted(((r["doc_id"], r["text"]) for r in C.near_dedup_stage(spark, made, SF_CHECK).collect()), key=str)
    assert got == sorted([(5, words[0]), (5, words[1]), (7, words[2]), (None, words[2]), (None, words[2])], key=str)
