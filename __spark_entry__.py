"""Wires query names to the jobs. See README.md for what each one does."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_queries  # noqa: E402
from weftline.functions.hashing import table_hash  # noqa: E402
from weftline.functions.text import lines  # noqa: E402
from weftline.operators import (  # noqa: E402
    billing,
    bucketed,
    cells,
    charges,
    chunking,
    embedding,
    fulltext,
    health,
    indexing,
    locations,
    ranking,
    search,
    sections,
    tenancy,
)
from weftline.operators.sections import MARKERS, SHORT_LINES  # noqa: E402
from weftline.plans.sizing import spread_small_input  # noqa: E402
from weftline.sources.snapshots import damaged_parts, snapshot_export, snapshot_import_clean  # noqa: E402
from weftline.sources.tables import load_table, schema_of  # noqa: E402
from weftline.sources.versions import VersionStore  # noqa: E402
from weftline.sources.workspace import fresh_path, stage  # noqa: E402
from weftline.streaming import indexes as index_stream  # noqa: E402
from weftline.streaming import locations as location_stream  # noqa: E402

try:
    import corpus_pipeline
    from weftline.llm import queries as llm
except ImportError as missing:
    if (missing.name or "").split(".")[0] not in ("corpus_pipeline", "weftline"):
        raise
    llm = None

K = 10
NPROBE = 4
KMEANS_CELLS = 16
CELL_PROBES = 2
DIM = 64

TENANT = "AMERICA"
TEXT_TENANT = "src3"
ENABLED = ("AMERICA", "ASIA", "EUROPE")
RUN_DATE = "1998-11-01"
DAILY_RUN_DATE = "1998-10-04"
AS_OF = "1998-01-15"
LATE_BEFORE = "2024-01-15"
LEDGER_SINCE = "1998-10-01"
LEDGER_RUNS = [
    (billing.DAY, "1998-10-02"),
    (billing.DAY, "1998-10-03"),
    (billing.MONTH, "1998-11-01"),
    (billing.MONTH, "1998-11-01"),
    (billing.MONTH, "1998-12-01"),
]

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Query:
    return lambda spark, sf_dir: load_table(spark, sf_dir, name)


embeddings, benchmark = _table("embeddings"), _table("benchmark")
orders, customer, events = _table("orders"), _table("customer"), _table("events")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small_input(load_table(spark, sf_dir, "documents"), "doc_id")


def on_documents(job: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(documents(spark, sf_dir))


# --- marked text -----------------------------------------------------------
# The documents in the marker grammar: short lines are headers, long ones entries,
# and a document opens in the last section of the documents before it.


def _marked_line(line: Column, at: Column) -> Column:
    number, length = (at + 1).cast("string"), F.length(line).cast("string")
    entry = F.concat(F.lit("line-"), number, F.lit(": "), length, F.lit(" ##@ "), line)
    header = F.concat(F.lit("##@--  "), line)
    return F.when(line == "", line).when(F.length(line) <= sections.SHORT_LINE, header).otherwise(entry)


def marked(job: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.array_join(F.transform(lines(F.col("text")), _marked_line), "\n")
        return job(documents(spark, sf_dir).withColumn("text", text), MARKERS, carry_across_docs=True)

    return run


# --- vectors ---------------------------------------------------------------


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.semantic_search(benchmark(spark, sf_dir), documents(spark, sf_dir), K)


def _as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "embedding")


def cosine_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir).select("vec_id", "embedding")
    return search.cosine_topk(_as_queries(vectors), vectors, K, exclude_self=True)


def ivf_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return search.ivf_cells(vectors, search.label_centroids(vectors, DIM))


def _ivf(vectors: DataFrame, centroids: DataFrame, n_probe: int = NPROBE) -> DataFrame:
    vectors = vectors.select("vec_id", "embedding")
    celled = stage(search.ivf_index(vectors, centroids), "celled")
    return search.cosine_topk_ivf(
        _as_queries(vectors), celled, centroids, K, n_probe, exclude_self=True
    )


def cosine_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return _ivf(vectors, search.label_centroids(vectors, DIM))


def ivf_cells_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embeddings(spark, sf_dir)
    return search.ivf_cells(vectors, search.kmeans_centroids(vectors, cells=KMEANS_CELLS))


def cosine_topk_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned cells, all of them probed: the answer is the exact one."""
    vectors = embeddings(spark, sf_dir)
    return _ivf(vectors, search.kmeans_centroids(vectors, cells=KMEANS_CELLS), KMEANS_CELLS)


def cosine_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centres of the most and the least frequent label, searched in the two cells
    nearest to each of an index stored by cell."""
    vectors, store = embeddings(spark, sf_dir), _store(spark)
    centroids = stage(search.label_centroids(vectors, DIM), "centroids")
    cells.publish_cells(store, vectors, centroids)
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.agg(
        F.min_by("label", F.struct(-F.col("n"), "label")).alias("most"), F.min_by("label", F.struct("n", "label")).alias("least")
    )
    chosen = ends.select(F.explode(F.array_distinct(F.array("most", "least"))).alias("cell"))
    asked = centroids.join(chosen, "cell").select(F.col("cell").alias("query_id"), "embedding")
    return cells.search_cells(store, stage(asked, "asked"), K, CELL_PROBES)


# --- index upkeep ----------------------------------------------------------
# The corpus before: every document not in Spanish, as it is. The corpus now: no
# document labelled toxic, and a note at the end of those of low quality. So
# Spanish documents are inserts, noted ones updates, toxic ones deletes.

NOTE = "\nReviewed: low quality."


def old_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(F.col("lang") != "es")


def new_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load_table(spark, sf_dir, "labels")
    toxic = labels.where(F.col("toxic") == 1).select("doc_id")
    low = labels.where(F.col("quality") == 0).select("doc_id", "quality")
    noted = F.when(F.col("quality").isNotNull(), F.concat("text", F.lit(NOTE)))
    return (
        documents(spark, sf_dir)
        .join(toxic, "doc_id", "left_anti")
        .join(low, "doc_id", "left")
        .withColumn("text", F.coalesce(noted, "text"))
        .drop("quality")
    )


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.index_diff(
        indexing.index_state(old_corpus(spark, sf_dir)),
        indexing.index_state(new_corpus(spark, sf_dir)),
    )


def index_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old_index = stage(indexing.full_rebuild(old_corpus(spark, sf_dir)), "old-index")
    diff = stage(index_diff(spark, sf_dir), "diff")
    return indexing.index_apply(old_index, diff, new_corpus(spark, sf_dir))


def _store(spark: SparkSession) -> VersionStore:
    return VersionStore(spark, fresh_path(spark, "store"))


def semantic_search_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search the vectors of an index that held an older corpus and was updated."""
    store = _store(spark)
    for corpus in (old_corpus(spark, sf_dir), documents(spark, sf_dir)):
        index_stream.update_indexes(store, corpus, complete=True)
    return search.search_chunks(benchmark(spark, sf_dir), store.current(index_stream.VECTORS), K)


def _rebuilt(spark: SparkSession, sf_dir: str, corpus: DataFrame) -> VersionStore:
    """A store that held the older corpus, all its tables rebuilt from ``corpus``."""
    store = _store(spark)
    index_stream.update_indexes(store, old_corpus(spark, sf_dir), complete=True)
    index_stream.rebuild_indexes(store, corpus)
    return store


def full_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir, new_corpus(spark, sf_dir)).current(index_stream.CHUNKS)


def full_rebuild_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir, documents(spark, sf_dir)).current(index_stream.POINTS)


def dual_target_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    index_stream.update_indexes(store, documents(spark, sf_dir), complete=True)
    reports = [
        store.current(table)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_docs"))
        .select(F.lit(table).alias("target"), "rows", "distinct_docs")
        for table, key in (("chunks", "doc_id"), ("points", "point_id"))
    ]
    return reports[0].unionByName(reports[1])


def index_apply_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    # A pattern, since a stream takes a plain path for a folder only: the table may be one file.
    arriving = spark.readStream.schema(schema_of("documents")).parquet(f"{sf_dir}/{{documents.parquet}}")
    index_stream.start_index_updates(arriving, store, fresh_path(spark, "offsets")).awaitTermination()
    return store.current("chunks")


# An index in buckets: the older corpus first, then an update to the corpus of now.


def _updated(spark: SparkSession, sf_dir: str) -> bucketed.BucketedIndex:
    index = bucketed.BucketedIndex(_store(spark))
    index.update(old_corpus(spark, sf_dir), complete=True)
    index.update(new_corpus(spark, sf_dir), complete=True)
    return index


def bucket_table(name: str) -> Query:
    return lambda spark, sf_dir: _updated(spark, sf_dir).table(name)


def bucket_chunk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).chunk_health()


def bucket_point_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).point_health()


def bucket_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which buckets an update writes that takes the toxic documents out: bucket,
    n_chunks it holds now, rewritten."""
    index = bucketed.BucketedIndex(_store(spark))
    index.update(documents(spark, sf_dir), complete=True)
    toxic = load_table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    kept = documents(spark, sf_dir).join(toxic, "doc_id", "left_anti")
    touched = index.update(kept, complete=True)
    bucket = bucketed.bucket_of(F.col("doc_id"), index.n_buckets).alias("bucket")
    held = index.table(bucketed.CHUNKS).groupBy(bucket).agg(F.count(F.lit(1)).alias("n_chunks"))
    return held.withColumn("rewritten", F.col("bucket").isin(touched))


def bucket_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points after two partial batches: the older corpus, then documents labelled of
    low quality, noted, with the deletion of toxic ones."""
    index = bucketed.BucketedIndex(_store(spark))
    labels = load_table(spark, sf_dir, "labels")
    low = labels.where(F.col("quality") == 0).select("doc_id")
    index.update(old_corpus(spark, sf_dir), complete=False)
    arriving = new_corpus(spark, sf_dir).join(low, "doc_id", "left_semi")
    index.update(arriving, complete=False, deleted=labels.where(F.col("toxic") == 1).select("doc_id"))
    return index.table(bucketed.STATE).groupBy(bucketed.bucket_of(F.col("doc_id"), 8).alias("part")).agg(
        F.count(F.lit(1)).alias("n_documents"), F.min("content_hash").alias("least_hash")
    )


# --- full text -------------------------------------------------------------


def fulltext_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = documents(spark, sf_dir).withColumnRenamed("source", "tenant")
    index = stage(fulltext.document_terms(tenants, ["tenant"]), "terms")
    frequencies = stage(fulltext.document_frequencies(index, ["tenant"]), "frequencies")
    return fulltext.fulltext_postings(index, frequencies, ["tenant"])


def fulltext_rebuild_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of all tenants of the older corpus, one tenant rebuilt from all documents."""
    store = _store(spark)
    for corpus, tenant in ((old_corpus, None), (documents, TEXT_TENANT)):
        held = corpus(spark, sf_dir).withColumnRenamed("source", "tenant")
        fulltext.rebuild_postings(store, held, tenant)
    return fulltext.published_postings(store)


def fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stage(fulltext.document_terms(documents(spark, sf_dir)), "terms")
    return fulltext.fulltext_topk(benchmark(spark, sf_dir), index, K)


def fulltext_topk_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking from published postings, scoring the ranges that can matter."""
    store = _store(spark)
    ranking.publish_postings(store, documents(spark, sf_dir))
    return ranking.ranked_search(store, benchmark(spark, sf_dir), K)


# --- accounts --------------------------------------------------------------


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (load_table(spark, sf_dir, t) for t in ("nation", "region"))
    return tenancy.tenant_accounts(customer(spark, sf_dir), nation, region)


def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    enabled = spark.createDataFrame([(t,) for t in ENABLED], "tenant string")
    return tenancy.tenant_scope(accounts(spark, sf_dir), enabled)


def _run(spark: SparkSession, sf_dir: str, period: str, date: str, tenant: str | None) -> DataFrame:
    """A run after an earlier one that stopped: accounts of the BUILDING segment
    are billed already."""
    segment = customer(spark, sf_dir).where(F.col("c_mktsegment") == "BUILDING")
    everyone = accounts(spark, sf_dir)
    earlier = everyone.join(segment, everyone["account"] == segment["c_custkey"], "left_semi")
    charges = orders(spark, sf_dir)
    existing = billing.billing_run(charges, earlier, date, tenant, period=period)
    return billing.billing_run(charges, everyone, date, tenant, existing, period).drop("tenant", "period_end")


def billing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, billing.MONTH, RUN_DATE, TENANT)


def billing_run_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, billing.DAY, DAILY_RUN_DATE, None)


def _runs(spark: SparkSession, sf_dir: str, runs: list[tuple[str, str]]) -> DataFrame:
    """Runs (period, date) one after the other, each over the invoices of those before."""
    charges, everyone = orders(spark, sf_dir), accounts(spark, sf_dir)
    invoices = None
    for period, date in runs:
        new = billing.billing_run(charges, everyone, date, existing=invoices, period=period)
        new = stage(new, "invoices")
        invoices = new if invoices is None else invoices.unionByName(new)
    return invoices.select("account", "period_start", "period_end", "n_charges", "amount")


def billing_days_then_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = [(billing.DAY, f"1998-10-{day:02}") for day in (2, 3, 5)]
    return _runs(spark, sf_dir, [*days, (billing.MONTH, RUN_DATE)])


def billing_month_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir, [(billing.MONTH, "1998-03-31"), (billing.MONTH, "1998-04-30")])


def billing_late_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of a ledger by charge. Urgent charges arrive before the third run,
    those of high priority before the last; the fourth repeats the third."""
    ledger, everyone = charges.ChargeLedger(_store(spark), LEDGER_SINCE), accounts(spark, sf_dir)
    priority = F.col("o_orderpriority")
    arrived = orders(spark, sf_dir)
    late = [("1-URGENT", "2-HIGH")] * 2 + [("2-HIGH",)] * 2 + [()]
    for (period, date), missing in zip(LEDGER_RUNS, late, strict=True):
        held = arrived.where(~priority.isin(*missing)) if missing else arrived
        ledger.bill(held, everyone, date, period=period)
    columns = ("account", "period_start", "period_end", "run", "n_charges", "amount", "n_arrears", "arrears")
    return ledger.invoices().select(*columns)


def _paid(spark: SparkSession, sf_dir: str, issued_by: str | None = None) -> DataFrame:
    return billing.autopay_run(
        billing.all_invoices(orders(spark, sf_dir), issued_by=issued_by),
        billing.funds(customer(spark, sf_dir)),
    )


PAID_COLUMNS = ("account", "period_start", "amount", "applied", "balance", "status")


def autopay_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paid(spark, sf_dir).select(*PAID_COLUMNS)


def autopay_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    purses = billing.funds(customer(spark, sf_dir))
    charges, everyone = orders(spark, sf_dir), accounts(spark, sf_dir)
    return billing.autopay_tenant(charges, everyone, purses, TENANT, AS_OF).select(*PAID_COLUMNS)


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("c_mktsegment") == "HOUSEHOLD", billing.COMPLIANT).when(
        F.col("c_mktsegment") == "MACHINERY", billing.DELINQUENT
    )
    return (
        customer(spark, sf_dir)
        .select(F.col("c_custkey").alias("account"), mark.alias("mark"))
        .where(F.col("mark").isNotNull())
    )


def invoice_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    issued = billing.all_invoices(orders(spark, sf_dir), issued_by=AS_OF)
    marked = billing.invoice_mark(issued, _marks(spark, sf_dir), AS_OF)
    return marked.select("account", "period_start", "due_date", "due_date_marked")


def invoice_delinquency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.invoice_delinquency(_paid(spark, sf_dir, AS_OF), AS_OF)


def delinquency_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = billing.invoice_mark(_paid(spark, sf_dir, AS_OF), _marks(spark, sf_dir), AS_OF)
    balances = stage(balances, "balances")
    return billing.delinquency_transitions(
        billing.invoice_delinquency(balances, AS_OF),
        billing.invoice_delinquency(balances, AS_OF, due="due_date_marked"),
    )


# --- snapshots -------------------------------------------------------------

SNAPSHOT_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "benchmark", "labels", "pages", "conversations",
)


def _contents(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and portable hash of each table, which SQL can compute as well."""
    found = None
    for name, held in sorted(tables.items()):
        row = held.agg(F.count(F.lit(1)).alias("rows"), table_hash(held.schema).alias("content_hash"))
        row = row.select(F.lit(name).alias("table"), "rows", "content_hash")
        found = row if found is None else found.unionByName(row)
    return found


def export_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of the snapshot hold."""
    path = fresh_path(spark, "snapshot")
    snapshot_export(spark, {t: load_table(spark, sf_dir, t) for t in SNAPSHOT_TABLES}, path)
    return _contents({t: spark.read.schema(schema_of(t)).parquet(f"{path}/{t}") for t in SNAPSHOT_TABLES})


def import_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and hash of every table of a store after the import. Before it, the store
    held another version of one table and a table that the snapshot lacks."""
    path, store = fresh_path(spark, "snapshot"), _store(spark)
    store.replace("region", load_table(spark, sf_dir, "nation"))
    store.replace("stale", load_table(spark, sf_dir, "region"))
    snapshot_export(spark, {t: load_table(spark, sf_dir, t) for t in SNAPSHOT_TABLES}, path)
    snapshot_import_clean(spark, path, {t: schema_of(t) for t in SNAPSHOT_TABLES}, store)
    return _contents({name: store.current(name) for name in store.names()})


def damaged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items and German texts are written into a finished snapshot a second time."""
    path, tables = fresh_path(spark, "snapshot"), ("documents", "lineitem", "orders")
    snapshot_export(spark, {t: load_table(spark, sf_dir, t) for t in tables}, path)
    load_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").write.mode("append").parquet(f"{path}/lineitem")
    load_table(spark, sf_dir, "documents").where("lang = 'de'").write.mode("append").parquet(f"{path}/documents")
    damaged = damaged_parts(spark, path, {t: schema_of(t) for t in tables})
    return damaged.groupBy("table", "problem").agg(F.sum("rows_listed").alias("rows_listed"), F.sum("rows_found").alias("rows_found"))


def import_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, store = fresh_path(spark, "snapshot"), _store(spark)
    snapshot_export(spark, {"documents": load_table(spark, sf_dir, "documents")}, path)
    snapshot_import_clean(spark, path, {"documents": schema_of("documents")}, store)
    return store.current("documents")


# --- locations -------------------------------------------------------------


def location_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log holds three kinds of event; the batch brings every event."""
    path = fresh_path(spark, "locations")
    batch = events(spark, sf_dir)
    held = batch.where(F.col("event_type").isin("signup", "view", "error"))
    locations.write_log(locations.with_day(held), path)
    return locations.location_append(spark, path, batch)


def location_append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals: the later half of the time first, then every event, so that the
    second brings both late events and repeats."""
    inbox, path, offsets = (fresh_path(spark, name) for name in ("inbox", "locations", "offsets"))
    batch = events(spark, sf_dir)
    late = F.col("ts") < F.lit(LATE_BEFORE).cast("timestamp_ntz")
    for arrivals in (batch.where(~late), batch):
        arrivals.write.mode("append").parquet(inbox)
        arriving = spark.readStream.schema(schema_of("events")).parquet(inbox)
        location_stream.start_location_log(arriving, path, offsets).awaitTermination()
    return spark.read.schema(schema_of("events")).parquet(path).select(batch.columns)


def location_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locations.location_latest(events(spark, sf_dir))


# --- contract --------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    return semantic_search(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        "section_catalog": on_documents(lambda d: sections.section_catalog(d, SHORT_LINES)),
        "section_summary": on_documents(lambda d: sections.section_summary(d, SHORT_LINES)),
        "empty_sections": on_documents(lambda d: sections.empty_sections(d, SHORT_LINES)),
        "marked_catalog": marked(sections.section_catalog),
        "marked_summary": marked(sections.section_summary),
        "marked_empty_sections": marked(sections.empty_sections),
        "chunk_documents": on_documents(chunking.chunk_documents),
        "hashed_embedding": on_documents(embedding.hashed_embedding),
        "semantic_search": semantic_search,
        "semantic_search_published": semantic_search_published,
        "cosine_topk_exact": cosine_topk_exact,
        "ivf_cells": ivf_cells,
        "cosine_topk_ivf": cosine_topk_ivf,
        "ivf_cells_kmeans": ivf_cells_kmeans,
        "cosine_topk_kmeans": cosine_topk_kmeans,
        "cosine_topk_cells": cosine_topk_cells,
        "index_diff": index_diff,
        "index_apply": index_apply,
        "index_apply_stream": index_apply_stream,
        "full_rebuild": full_rebuild,
        "point_index": on_documents(indexing.point_index),
        "point_vectors": on_documents(indexing.point_vectors),
        "full_rebuild_points": full_rebuild_points,
        "dual_target_index": dual_target_index,
        "chunk_index_health": on_documents(
            lambda d: health.chunk_index_health(chunking.chunk_documents(d))
        ),
        "vector_index_health": on_documents(
            lambda d: health.vector_index_health(indexing.point_index(d))
        ),
        "bucket_chunks": bucket_table(bucketed.CHUNKS),
        "bucket_points": bucket_table(bucketed.POINTS),
        "bucket_point_vectors": bucket_table(bucketed.POINT_VECTORS),
        "bucket_chunk_health": bucket_chunk_health,
        "bucket_point_health": bucket_point_health,
        "bucket_rewrites": bucket_rewrites,
        "bucket_arrivals": bucket_arrivals,
        "fulltext_postings": fulltext_postings,
        "fulltext_topk": fulltext_topk,
        "fulltext_topk_published": fulltext_topk_published,
        "fulltext_rebuild_tenant": fulltext_rebuild_tenant,
        "tenant_scope": tenant_scope,
        "billing_run": billing_run,
        "billing_run_daily": billing_run_daily,
        "billing_days_then_month": billing_days_then_month,
        "billing_month_ends": billing_month_ends,
        "billing_late_charges": billing_late_charges,
        "autopay_run": autopay_run,
        "autopay_tenant": autopay_tenant,
        "invoice_mark": invoice_mark,
        "invoice_delinquency": invoice_delinquency,
        "delinquency_transitions": delinquency_transitions,
        "snapshot_export": export_all,
        "snapshot_import_clean": import_documents,
        "snapshot_import_all": import_all,
        "snapshot_damaged": damaged_rows,
        "location_append": location_append,
        "location_append_stream": location_append_stream,
        "location_latest": location_latest,
        **(llm.queries() | {"pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if llm and corpus_pipeline.ORACLE_SQL else {}
    return oracle_queries.oracle_sql() | pipeline | (llm.oracle_sql() if llm else {})
