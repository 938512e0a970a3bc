"""Ranked search (BM25) from published postings, in blocks with upper bounds.

Documents are dealt to ranges of about ``RANGE_DOCUMENTS``. The postings of a term in
a range are one block: ids, weights and the largest weight. A weight is the part of a
score that term and document alone decide, so a score is the sum of idf times weight
over the query's terms, and idf times the largest weights bounds every score in a
range. A search reads the bounds first, scores the ranges of highest bound, and then
only those ranges whose bound reaches the k-th score found. What it skips cannot be
in the answer.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import blocks
from weftline.functions import text as tx
from weftline.operators.fulltext import K1, B, document_terms
from weftline.plans.sizing import broadcast_if_small
from weftline.sources.versions import VersionStore
from weftline.sources.workspace import stage

RANGE_DOCUMENTS = 256
FIRST_RANGES = 4
MAX_TRAVELLING_QUERIES = 10_000
BLOCKS, TERMS, CORPUS = "term-blocks", "terms", "corpus"
ROUNDING = 1e-5  # scores are rounded to 6 decimals


def publish_postings(store: VersionStore, documents: DataFrame, range_documents: int = RANGE_DOCUMENTS) -> None:
    """Count the terms of ``documents`` (doc_id, text) and publish blocks, document
    frequencies and corpus size in one step. Documents of like length lie in one
    range, so that the bounds of a range are near its weights.

    Lengths are counted first and stored; the counted terms of a document are shuffled
    once, to its range, where its postings become blocks. Postings are never rows."""
    lengths = stage(documents.select("doc_id", F.size(tx.tokens(F.col("text"))).alias("doc_len")), "lengths")
    n_documents, n_tokens, longest = lengths.agg(F.count(F.lit(1)), F.sum("doc_len"), F.max("doc_len")).first()
    average = (n_tokens or 0) / max(n_documents, 1)
    edges = _length_edges(lengths, math.ceil(n_documents / range_documents))
    n_slots = stage(_slots(lengths, edges, range_documents), "slots")
    index = _placed(document_terms(documents), edges, n_slots)
    several = stage(_in_several_ranges(_placed(lengths, edges, n_slots)), "several")
    if not several.isEmpty():
        marked = broadcast_if_small(several.select(F.col("doc_id").alias("other"), F.lit(True).alias("several")))
        apart = F.when(F.col("several"), -1 - F.col("range")).otherwise(F.col("range"))
        index = index.join(marked, F.col("doc_id").eqNullSafe(F.col("other")), "left").withColumn("range", apart)
    one_text = F.array_join("terms", " ").alias("terms")  # letters and digits only; half as many bytes as an array
    held = index.where(F.size("terms") > 0).select("range", "doc_id", "doc_len", one_text, "tfs")
    schema = blocks.block_schema(documents.schema["doc_id"].dataType.simpleString())
    written = store.write(held.groupBy("range").applyInArrow(blocks.blocks_of_range(average, K1, B), schema), BLOCKS)
    terms = store.read(written).groupBy("term").agg(F.sum("n").alias("df"))
    corpus = store.spark.createDataFrame([(n_documents, longest or 0)], "n_documents bigint, longest int")
    store.publish({BLOCKS: written, TERMS: store.write(terms, TERMS), CORPUS: store.write(corpus, CORPUS)})


def _placed(index: DataFrame, edges: list[float], n_slots: DataFrame) -> DataFrame:
    """``index`` (doc_id, doc_len, ...) with the range of each document."""
    placed = index.withColumn("band", _band(edges)).join(F.broadcast(n_slots), "band")
    slot = F.pmod(F.xxhash64("doc_id"), F.col("slots"))
    return placed.withColumn("range", (F.col("first") + slot).cast("int")).drop("band", "slots", "first")


def _in_several_ranges(placed: DataFrame) -> DataFrame:
    """The ids whose rows lie in more than one range. Their rows go to ranges of their
    own, below zero, which are always scored: no bound of a range holds for their sums."""
    return placed.groupBy("doc_id").agg(F.min("range").alias("lo"), F.max("range").alias("hi")).where("lo <> hi").select("doc_id")


def _length_edges(index: DataFrame, n_ranges: int) -> list[float]:
    """Lengths that cut the documents into bands, at most 64."""
    shares = [i / min(n_ranges, 64) for i in range(1, min(n_ranges, 64))]
    return sorted(set(index.approxQuantile("doc_len", shares, 0.001))) if shares else []


def _band(edges: list[float]):
    """The band of a document: how many edges lie below its length."""
    return F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda n, e: n + (F.col("doc_len") > e).cast("int")) if edges else F.lit(0)


def _slots(index: DataFrame, edges: list[float], range_documents: int) -> DataFrame:
    """band, slots (ranges of the band) and first (its first range); at most 64 rows."""
    counts = index.groupBy(_band(edges).alias("band")).agg(F.ceil(F.count(F.lit(1)) / range_documents).alias("slots"))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def query_terms(store: VersionStore, queries: DataFrame) -> DataFrame:
    """item_id, term, idf of the terms of each query text that the corpus holds."""
    n_documents = store.current(CORPUS).first()["n_documents"]
    asked = queries.select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"))
    df = F.col("df")
    idf = F.log(1 + (F.lit(n_documents) - df + 0.5) / (df + 0.5))
    return asked.join(store.current(TERMS), "term").select("item_id", "term", idf.alias("idf"))


def range_bounds(store: VersionStore, asked: DataFrame) -> DataFrame:
    """item_id, range, bound: no document of the range scores more. Of the blocks only
    term, range and largest weight are read."""
    most = store.current(BLOCKS).where("range >= 0").select("term", "range", "most")
    asked = broadcast_if_small(asked)
    return most.join(asked, "term").groupBy("item_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))


def _scored(store: VersionStore, asked: DataFrame, ranges: DataFrame, k: int | None) -> DataFrame:
    """item_id, doc_id, score of the documents in the given ranges (item_id, range and,
    if known, bar) of each query. Blocks of asked terms in these ranges go to their range
    once, whatever the number of queries."""
    each = asked.groupBy("item_id").agg(F.collect_list(F.struct("term", "idf")).alias("w"))
    each = each.select("item_id", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"))
    bar = F.col("bar") if "bar" in ranges.columns else F.lit(None).cast("double").alias("bar")
    wanted = ranges.select("item_id", "range", bar).join(broadcast_if_small(each, MAX_TRAVELLING_QUERIES), "item_id")
    held = store.current(BLOCKS).select("term", "range", "doc_ids", "weights")
    for part in (asked.select("term"), ranges.select("range")):
        held = held.join(broadcast_if_small(part.distinct()), part.columns, "left_semi")
    kinds = (wanted.schema["item_id"].dataType, held.schema["doc_ids"].dataType.elementType)
    schema = blocks.score_schema(*(kind.simpleString() for kind in kinds))
    return held.groupBy("range").cogroup(wanted.groupBy("range")).applyInArrow(blocks.scores_of_range(k), schema)


def _scores(store: VersionStore, asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """item_id, doc_id, score of all documents in the given ranges of each query."""
    parts = _scored(store, asked, ranges, None)
    return parts.groupBy("item_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranges_to_score(bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The ranges not scored yet whose bound reaches the k-th score of ``first``."""
    bar = first.where(F.col("rank") == k).select("item_id", F.col("score").alias("bar"))
    rest = bounds.where(F.col("place") > FIRST_RANGES).join(bar, "item_id", "left")
    return rest.where(F.col("bar").isNull() | (F.col("bound") + ROUNDING >= F.col("bar")))


def ranked_search(store: VersionStore, queries: DataFrame, k: int = 10) -> DataFrame:
    """Best k documents of each query (item_id, text): item_id, doc_id, score, rank."""
    asked = stage(query_terms(store, queries), "asked")
    highest = Window.partitionBy("item_id").orderBy(F.desc("bound"), "range")
    bounds = stage(range_bounds(store, asked).withColumn("place", F.row_number().over(highest)), "bounds")
    first = _scored(store, asked, bounds.where(F.col("place") <= FIRST_RANGES), k)
    apart = store.current(BLOCKS).where("range < 0").select("range").distinct()
    if not apart.isEmpty():
        everywhere = apart.crossJoin(asked.select("item_id").distinct())
        first = first.unionByName(_scores(store, asked, everywhere))
    first = stage(_best(first, k), "first")
    rest = _scored(store, asked, ranges_to_score(bounds, first, k), k)
    return _best(first.drop("rank").unionByName(rest), k)
