"""Postings kept per tenant: rebuilding one leaves the others as they are."""

from pyspark.sql import functions as F
from weftline.operators import fulltext
from weftline.operators.indexing import index_state
from weftline.plans import skew
from weftline.sources.versions import VersionStore

OLD = [("a", 1, "red fox"), ("a", 2, "red"), ("b/c", 3, "red fox"), (None, 4, "red"), ("d", 5, None)]
NEW = [("a", 1, "blue"), ("b/c", 3, "blue")]
SCHEMA = "tenant string, doc_id bigint, text string"


def held(store):
    found = fulltext.published_postings(store)
    assert found.columns == ["tenant", "term", "doc_id", "tf", "df"]
    return sorted(tuple(r) for r in found.collect())


def paths(store):
    return {r["name"]: r["path"] for r in store._ledger().orderBy("seq").collect()}


def test_one_tenant(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    assert fulltext.published_postings(store) is None
    fulltext.rebuild_postings(store, spark.createDataFrame(OLD, SCHEMA))
    others = [("b/c", "fox", 3, 1, 1), ("b/c", "red", 3, 1, 1)]
    assert held(store) == [("a", "fox", 1, 1, 1), ("a", "red", 1, 1, 2), ("a", "red", 2, 1, 2), *others]
    before = paths(store)
    fulltext.rebuild_postings(store, spark.createDataFrame(NEW, SCHEMA), "a")
    assert held(store) == [("a", "blue", 1, 1, 1), *others]
    after = paths(store)
    assert sum(before[name] != after[name] for name in before) == 1


def test_tenant_without_documents_goes(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    fulltext.rebuild_postings(store, spark.createDataFrame(OLD, SCHEMA))
    none = spark.createDataFrame([], SCHEMA)
    fulltext.rebuild_postings(store, none, "a")
    assert {row[0] for row in held(store)} == {"b/c"}
    fulltext.rebuild_postings(store, none)
    assert fulltext.published_postings(store) is None


def test_state_keeps_nulls_and_columns_apart(spark):
    rows = [(1, None, "en"), (2, "en", None), (3, "en", ""), (4, "a\nb", "c"), (5, "a", "b\nc"), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    hashes = [r["content_hash"] for r in index_state(docs).collect()]
    assert None not in hashes and len(set(hashes)) == len(rows)


def test_term_join_asks_for_no_hash_build(spark):
    facts = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    per_key = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for hot_rows in (3, 1000):
        joined = skew.join_per_key(facts, per_key, ["k"], "n", F.col("id"), hot_rows, max_broadcast=1)
        assert "shuffle_hash" not in joined._jdf.queryExecution().logical().toString()
        assert joined.count() == 100
