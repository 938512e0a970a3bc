import re

import pytest
from conftest import rows, same_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import cells, fulltext, ranking, search
from weftline.sources.tables import load_table
from weftline.sources.versions import VersionStore
from weftline.sources.workspace import fresh_path, stage


def new_store(spark):
    return VersionStore(spark, fresh_path(spark, "store"))


# --- cells -----------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark, tiny):
    return stage(load_table(spark, tiny, "embeddings"), "vectors")


@pytest.fixture(scope="module")
def held(spark, vectors):
    store = new_store(spark)
    cells.publish_kmeans_cells(store, vectors)
    return store


def as_queries(vectors):
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding")


def test_every_vector_is_in_one_cell(held, vectors):
    stored = held.current(cells.CELLS)
    same_rows(stored.select("vec_id", "embedding"), vectors.select("vec_id", "embedding"))
    assert stored.select("cell").distinct().count() <= cells.cells_for(vectors.count()) == 22


def test_only_probed_cells_are_scanned(held, vectors):
    few = as_queries(vectors.where("vec_id < 2"))
    probed = cells.probed_cells(held, few, 2)
    assert 1 <= len(probed) <= 4
    found = cells.search_cells(held, few, 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(cell.*?)\]", plan)
    assert filters and all(f"IN ({','.join(map(str, probed))})" in f for f in filters)
    reached = held.current(cells.CELLS).where(F.col("cell").isin(probed))
    inside = rows(reached.select("vec_id"))
    assert {(r["vec_id"],) for r in found.collect()} <= set(inside)


def test_all_cells_probed_is_exact(held, vectors):
    asked = as_queries(vectors)
    n = cells.cells_for(vectors.count())
    exact = search.cosine_topk(asked, vectors.select("vec_id", "embedding"), 5, exclude_self=True)
    same_rows(cells.search_cells(held, asked, 5, n, exclude_self=True), exact)


def test_recall_grows_with_the_probes(held, vectors):
    asked = as_queries(vectors)
    exact = stage(search.cosine_topk(asked, vectors.select("vec_id", "embedding"), 5), "exact")
    found = [cells.recall(cells.search_cells(held, asked, 5, n), exact, 5) for n in (1, 4, 22)]
    assert found[0] < found[1] < found[2] == 1.0


def test_number_of_cells():
    assert [cells.cells_for(n) for n in (0, 1, 400, 10**12)] == [1, 1, 20, cells.MAX_CELLS]


# --- postings in blocks ----------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark, tiny):
    return stage(load_table(spark, tiny, "documents").select("doc_id", "text"), "docs")


@pytest.mark.parametrize("range_documents", [1, 16, 10_000])
def test_ranking_equals_the_scan_of_all_documents(spark, tiny, docs, range_documents):
    store = new_store(spark)
    ranking.publish_postings(store, docs, range_documents)
    asked = load_table(spark, tiny, "benchmark")
    index = stage(fulltext.document_terms(docs), "terms")
    exact = fulltext.fulltext_topk(asked, index, 5).select("item_id", "doc_id", "score", "rank")
    same_rows(ranking.ranked_search(store, asked, 5), exact)


def test_blocks_hold_all_postings_and_their_bounds(spark, docs):
    store = new_store(spark)
    ranking.publish_postings(store, docs, 16)
    blocks = store.current(ranking.BLOCKS)
    assert blocks.where("most <> array_max(weights) OR n <> size(doc_ids)").isEmpty()
    index = stage(fulltext.document_terms(docs), "terms")
    assert blocks.agg(F.sum("n")).first()[0] == index.agg(F.sum(F.size("terms"))).first()[0]
    expected = fulltext.document_frequencies(index).select("term", "df")
    same_rows(store.current(ranking.TERMS).select("term", F.col("df")), expected)
    ranges = blocks.select(F.explode("doc_ids").alias("doc_id"), "range").distinct()
    assert ranges.count() == ranges.select("doc_id").distinct().count()


def test_ranges_are_skipped(spark, tiny, docs):
    """Queries cut from documents: few ranges hold their rare terms."""
    store = new_store(spark)
    ranking.publish_postings(store, docs, 8)
    asked = docs.where("length(text) > 300").select(F.col("doc_id").alias("item_id"), F.substring("text", 100, 120).alias("text"))
    terms = stage(ranking.query_terms(store, asked), "asked")
    highest = Window.partitionBy("item_id").orderBy(F.desc("bound"), "range")
    bounds = stage(ranking.range_bounds(store, terms).withColumn("place", F.row_number().over(highest)), "bounds")
    first = stage(ranking._best(ranking._scores(store, terms, bounds.where(F.col("place") <= ranking.FIRST_RANGES)), 1), "first")
    rest = bounds.where(F.col("place") > ranking.FIRST_RANGES).count()
    scored = ranking.ranges_to_score(bounds, first, 1).count()
    assert scored < 0.5 * rest


def test_queries_without_known_terms(spark, docs):
    store = new_store(spark)
    ranking.publish_postings(store, docs)
    asked = spark.createDataFrame([(1, "zzzzqqq"), (2, ""), (3, None)], "item_id bigint, text string")
    assert ranking.ranked_search(store, asked).isEmpty()
    empty = new_store(spark)
    ranking.publish_postings(empty, docs.limit(0))
    assert ranking.ranked_search(empty, docs.limit(3).withColumnRenamed("doc_id", "item_id")).isEmpty()


def test_postings_are_not_shuffled(spark, docs, monkeypatch):
    """Counted terms go to their range once, a row for each document, and are not stored."""
    plans, staged = {}, {}
    write, kept = VersionStore.write, ranking.stage

    def planned(store, df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(store, df, name, *rest)

    def noted(df, name):
        staged[name] = df.columns
        return kept(df, name)

    monkeypatch.setattr(VersionStore, "write", planned)
    monkeypatch.setattr(ranking, "stage", noted)
    ranking.publish_postings(new_store(spark), docs, 16)
    assert plans[ranking.BLOCKS].count("Exchange hashpartitioning") == 1 and "Generate" not in plans[ranking.BLOCKS]
    assert not any("terms" in columns for columns in staged.values())


def test_a_range_gives_at_most_k_rows_a_query(spark, tiny, docs):
    store = new_store(spark)
    ranking.publish_postings(store, docs, 64)
    asked = stage(ranking.query_terms(store, load_table(spark, tiny, "benchmark")), "asked")
    bounds = stage(ranking.range_bounds(store, asked), "bounds")
    every = stage(ranking._scores(store, asked, bounds), "every")
    best = stage(ranking._scored(store, asked, bounds, 2), "best")
    assert best.count() <= 2 * bounds.count() < every.count()
    same_rows(ranking._best(best, 2), ranking._best(every, 2))
    bar = ranking._best(every, 2).where("rank = 2").select("item_id", F.col("score").alias("bar"))
    above = stage(ranking._scored(store, asked, bounds.join(bar, "item_id"), 2), "above")
    assert above.join(bar, "item_id").where("score < bar").isEmpty()
    same_rows(ranking._best(above, 2), ranking._best(every, 2))


def test_rows_of_one_id_count_together(spark):
    """Whatever their lengths and so their ranges; also rows without an id."""
    words = ["ant", "bee", "cat", "dog", "elk", "fox", "gnu", "hen"]
    texts = [(i, " ".join(words[(i * n) % 8] for n in range(1 + i % 13))) for i in range(60)]
    texts += [(3, "ant " * 40 + "bee"), (3, "bee"), (7, "cat dog " * 30), (None, "ant"), (None, "bee cat " * 20), (61, None)]
    docs = stage(spark.createDataFrame(texts, "doc_id bigint, text string"), "docs")
    asked = spark.createDataFrame([(1, "ant bee"), (2, "cat"), (3, "hen gnu cat")], "item_id bigint, text string")
    found = []
    for range_documents in (2, 10_000):
        store = new_store(spark)
        ranking.publish_postings(store, docs, range_documents)
        found.append(stage(ranking.ranked_search(store, asked, 6), "found"))
    same_rows(*found)
    assert found[0].select("item_id", "doc_id").distinct().count() == found[0].count() == 18
