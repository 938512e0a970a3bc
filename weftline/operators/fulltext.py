"""Full-text postings and ranked search (BM25, Robertson and Zaragoza 2009)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.functions import topk
from weftline.functions.terms import count_terms
from weftline.operators import search
from weftline.plans import skew
from weftline.plans.sizing import BROADCAST_ROWS, broadcast_if_small
from weftline.sources.versions import Version, VersionStore
from weftline.sources.workspace import stage

K1 = 1.2
B = 0.75

SLICE_DOCUMENTS = 20_000

POSTINGS = "postings/"


def document_terms(documents: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """One row per document: scope columns, doc_id, doc_len, terms, tfs.

    A document is one row, so its terms are counted in the task that reads it;
    nothing is shuffled. Store it: it is the index, and the postings are its
    exploded form.
    """
    kept = [*(scope or []), "doc_id"]
    tokenised = documents.select(*kept, tx.tokens(F.col("text")).alias("tokens"))
    measured = tokenised.select(*kept, F.size("tokens").alias("doc_len"), "tokens")
    schema = T.StructType(
        [
            *measured.schema.fields[:-1],
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("tfs", T.ArrayType(T.IntegerType())),
        ]
    )
    return measured.mapInArrow(count_terms, schema)


def document_frequencies(index: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """scope columns, term, df."""
    kept = scope or []
    terms = index.select(*kept, F.explode("terms").alias("term"))
    return terms.groupBy(*kept, "term").agg(F.count(F.lit(1)).alias("df"))


def fulltext_postings(
    index: DataFrame,
    frequencies: DataFrame,
    scope: list[str] | None = None,
    hot_rows: int = skew.HOT_ROWS,
    max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """scope columns, term, doc_id, tf, df. ``frequencies`` is used more than
    once: pass a stored table. A term of very many documents is salted by
    document."""
    on = [*(scope or []), "term"]
    postings = index.select(
        *(scope or []), "doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("posting")
    ).select(
        *(scope or []),
        F.col("posting.terms").alias("term"),
        "doc_id",
        F.col("posting.tfs").alias("tf"),
    )
    return skew.join_per_key(
        postings, frequencies, on, "df", F.col("doc_id"), hot_rows, max_broadcast
    ).select(*on, "doc_id", "tf", "df")


def rebuild_postings(store: VersionStore, documents: DataFrame, tenant: str | None = None) -> None:
    """Rebuild and publish the postings of one tenant or, without one, of all.

    Each tenant is a part of its own in ``store``. A rebuild of one tenant reads its
    documents, writes its part and leaves the other parts as they are. A tenant
    without postings has no part. ``documents`` has tenant, doc_id and text; rows
    without a tenant are left out.
    """
    held = documents.where(F.col("tenant").isNotNull() if tenant is None else F.col("tenant") == tenant)
    index = stage(document_terms(held, ["tenant"]), "terms")
    frequencies = stage(document_frequencies(index, ["tenant"]), "frequencies")
    part = F.md5("tenant").alias("part")  # a safe folder name for any tenant
    postings = fulltext_postings(index, frequencies, ["tenant"])
    written = store.write(postings.select("*", part), "postings", partition_by="part")
    found = [row["part"] for row in frequencies.select(part).distinct().collect()]  # one per tenant
    new = {POSTINGS + p: Version(f"{written.path}/part={p}", postings.schema) for p in found}
    rebuilt = [n for n in store.names() if n.startswith(POSTINGS)]
    if tenant is not None:
        rebuilt = [n for n in rebuilt if n == POSTINGS + hashlib.md5(tenant.encode()).hexdigest()]
    store.publish(new, withdraw=[n for n in rebuilt if n not in new])


def published_postings(store: VersionStore) -> DataFrame | None:
    """tenant, term, doc_id, tf, df of every tenant; None before the first rebuild."""
    return store.parts(POSTINGS)


def fulltext_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    max_travelling: int = search.MAX_TRAVELLING_ROWS,
) -> DataFrame:
    """Best k documents of each query text: item_id, doc_id, score, rank.

    ``index`` is the stored ``document_terms``. A task scores whole documents, so
    the pairs of a frequent term with all its documents are never rows; only
    document counts of query terms and k rows per query and task are shuffled.
    """
    asked_terms = queries.select(
        F.col("item_id").alias("query_id"),
        F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("term"),
    )
    wanted = broadcast_if_small(asked_terms.select("term").distinct())
    held_terms = index.select(F.explode("terms").alias("term"))
    frequencies = held_terms.join(wanted, "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df")
    )
    n_documents, n_tokens = index.agg(F.count(F.lit(1)), F.sum("doc_len")).first()
    average_length = (n_tokens or 0) / max(n_documents, 1)
    df = F.col("df")
    idf = F.log(1 + (F.lit(n_documents) - df + 0.5) / (df + 0.5))
    weighted = (
        asked_terms.join(frequencies, "term")
        .groupBy("query_id")
        .agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("parts"))
        .select("query_id", F.col("parts.term").alias("terms"), F.col("parts.idf").alias("weights"))
    )

    def score(best: topk.TopK, asked: pa.Table, held: pa.Table) -> None:
        topk.bm25_block(best, asked, held, ["doc_id"], average_length, K1, B)

    held = index.select("doc_id", "doc_len", "terms", "tfs")
    best = search.best_matches(
        weighted, held, ["doc_id"], k, score, "score", max_travelling, SLICE_DOCUMENTS
    )
    found = search.ranked(best.where(F.col("score").isNotNull()), "doc_id", k, "score")
    return found.withColumnRenamed("query_id", "item_id")
