import __spark_entry__ as entry
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows, same_rows
from pyspark.sql import functions as F

from weftline.functions.digests import MEASURES, table_digest
from weftline.functions.hashing import table_hash
from weftline.operators import chunking, fulltext, health, indexing, search
from weftline.plans import ordering, sizing, skew
from weftline.sources import snapshots, workspace
from weftline.sources.tables import load_table, schema_of
from weftline.sources.versions import VersionStore
from weftline.sources.workspace import fresh_path, stage
from weftline.streaming import indexes


@pytest.fixture(scope="module")
def corpora(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    old = docs.where(F.col("lang") != "es")
    new = docs.where(F.col("source") != "src3").withColumn(
        "text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" fin."))).otherwise(F.col("text"))
    )
    return stage(old, "old"), stage(new, "new")


def diff_of(old, new):
    return indexing.index_diff(indexing.index_state(old), indexing.index_state(new))


def test_diff_classes(corpora):
    old, new = corpora
    got = {r.doc_id: r.change for r in diff_of(old, new).collect()}
    before = {r.doc_id: r.text for r in old.collect()}
    after = {r.doc_id: r.text for r in new.collect()}
    for doc_id in before.keys() | after.keys():
        if doc_id not in before:
            expected = "insert"
        elif doc_id not in after:
            expected = "delete"
        else:
            expected = "unchanged" if before[doc_id] == after[doc_id] else "update"
        assert got.pop(doc_id) == expected
    assert not got


@pytest.mark.parametrize("bound", [100_000, 3])
def test_incremental_equals_rebuild(corpora, monkeypatch, bound):
    old, new = corpora
    monkeypatch.setattr(
        indexing, "broadcast_if_small", lambda df: sizing.broadcast_if_small(df, bound)
    )
    diff = stage(diff_of(old, new), "diff")
    same_rows(indexing.index_apply(indexing.full_rebuild(old), diff, new), indexing.full_rebuild(new))


def test_a_changed_layer_is_a_change(spark):
    schema = "doc_id bigint, lang string, text string"
    old = spark.createDataFrame([(1, "en", "same")], schema)
    new = spark.createDataFrame([(1, "fr", "same")], schema)
    assert rows(diff_of(old, new)) == [(1, "update")]


def test_store_updates_and_resets(spark, corpora):
    old, new = corpora
    store = VersionStore(spark, fresh_path(spark, "store"))
    assert store.current("chunks") is None and store.drop("chunks") is False
    indexes.update_indexes(store, old, complete=True)
    first = store.current("chunks")
    indexes.update_indexes(store, new, complete=True)
    same_rows(store.current("chunks"), indexing.full_rebuild(new))
    same_rows(store.current("points"), indexing.point_index(new))
    same_rows(store.current("vectors"), search.chunk_vectors(indexing.full_rebuild(new)))
    same_rows(store.current("state"), indexing.index_state(new))
    same_rows(first, indexing.full_rebuild(old))  # a reader keeps its version
    assert store.drop("vectors") is True
    indexes.update_indexes(store, old.limit(5), complete=False)
    same_rows(store.current("vectors"), search.chunk_vectors(store.current("chunks")))
    assert store.drop("points") is True and store.current("points") is None
    same_rows(store.replace("points", indexing.point_index(new)), indexing.point_index(new))


@pytest.mark.parametrize("name, corpus", [("full_rebuild", entry.new_corpus), ("full_rebuild_points", entry.documents)])
def test_rebuild_leaves_no_table_of_the_old_corpus(spark, tiny, monkeypatch, name, corpus):
    store = VersionStore(spark, fresh_path(spark, "store"))
    indexes.update_indexes(store, entry.old_corpus(spark, tiny), complete=True)
    monkeypatch.setattr(entry, "_store", lambda spark: store)
    entry.queries()[name](spark, tiny)
    docs = corpus(spark, tiny)
    same_rows(store.current("chunks"), indexing.full_rebuild(docs))
    same_rows(store.current("vectors"), search.chunk_vectors(indexing.full_rebuild(docs)))
    same_rows(store.current("state"), indexing.index_state(docs))
    same_rows(store.current("points"), indexing.point_index(docs))


def test_failed_build_leaves_the_published_version(spark, corpora):
    old, _ = corpora
    store = VersionStore(spark, fresh_path(spark, "store"))
    store.replace("points", indexing.point_index(old))
    broken = indexing.point_index(old).withColumn("summary", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        store.replace("points", broken)
    same_rows(store.current("points"), indexing.point_index(old))


def test_stream_of_documents_equals_batch(spark, corpora):
    old, new = corpora
    folder, store = fresh_path(spark, "arriving"), VersionStore(spark, fresh_path(spark, "store"))
    checkpoint = fresh_path(spark, "offsets")
    for corpus in (old, new):
        corpus.coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(schema_of("documents")).parquet(folder)
        indexes.start_index_updates(arriving, store, checkpoint).awaitTermination()
    # New documents replace old ones; a stream deletes nothing.
    merged = new.unionByName(old.join(new, "doc_id", "left_anti"))
    same_rows(store.current("chunks"), indexing.full_rebuild(merged))
    same_rows(store.current("state"), indexing.index_state(merged))
    same_rows(store.current("vectors"), search.chunk_vectors(indexing.full_rebuild(merged)))
    same_rows(store.current("points"), indexing.point_index(merged))


@pytest.mark.parametrize("parts", [1, 3])
def test_registered_stream_reads_a_table_of_one_file_or_of_many(spark, corpora, tmp_path, parts):
    held = corpora[0].select(schema_of("documents").names).toPandas()
    table = tmp_path / "documents.parquet"
    if parts > 1:
        table.mkdir()
    for i in range(parts):
        found = pa.Table.from_pandas(held[i::parts], preserve_index=False)
        pq.write_table(found, table / f"part-{i}.parquet" if parts > 1 else table)
    (tmp_path / "documents.parquet.old").write_text("another table")
    same_rows(entry.index_apply_stream(spark, str(tmp_path)), indexing.full_rebuild(corpora[0]))


def test_health(spark):
    chunks = spark.createDataFrame(
        [("a", "x"), ("a", None), ("b", None)], "layer string, symbol string"
    )
    assert rows(health.chunk_index_health(chunks)) == [("a", 2, 0.666667, 0.5), ("b", 1, 0.333333, 0.0)]
    points = chunks.withColumnRenamed("symbol", "summary")
    assert [r[3] for r in rows(health.vector_index_health(points))] == [0.5, 0.0]


# --- full text -------------------------------------------------------------


def test_salted_postings_equal_plain(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    index = stage(fulltext.document_terms(docs, ["source"]), "terms")
    frequencies = stage(fulltext.document_frequencies(index, ["source"]), "df")
    plain = fulltext.fulltext_postings(index, frequencies, ["source"])
    shuffled = fulltext.fulltext_postings(index, frequencies, ["source"], max_broadcast=5)
    salted = fulltext.fulltext_postings(index, frequencies, ["source"], hot_rows=3, max_broadcast=5)
    same_rows(plain, shuffled)
    same_rows(plain, salted)
    assert plain.count() == index.agg(F.sum(F.size("terms"))).first()[0]


def test_document_terms_do_not_shuffle_and_keep_empty_documents(spark):
    docs = spark.createDataFrame([(1, "b a B"), (2, "?"), (3, "")], "doc_id bigint, text string")
    index = fulltext.document_terms(docs)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.doc_len, dict(zip(r.terms, r.tfs))) for r in index.collect()}
    assert got == {1: (3, {"a": 1, "b": 2}), 2: (0, {}), 3: (0, {})}


def test_hot_key_is_spread(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") < 1000, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), "id"
    )
    per_key = facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = skew.join_per_key(facts, per_key, ["key"], "n", F.col("id"), hot_rows=100, max_broadcast=5)
    assert got.count() == 3000
    assert rows(got.groupBy("n").count()) == [(1, 2000), (1000, 1000)]


@pytest.mark.parametrize("max_travelling", [1000, 2])
def test_bm25_against_brute_force(spark, tiny, max_travelling, monkeypatch):
    import math
    import re

    monkeypatch.setattr(fulltext, "SLICE_DOCUMENTS", 30)
    monkeypatch.setattr(fulltext.search, "SLICE_QUERIES", 7)
    docs = load_table(spark, tiny, "documents").select("doc_id", "text")
    asked = load_table(spark, tiny, "benchmark")

    def tokens(text):
        return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]

    held = {r.doc_id: tokens(r.text) for r in docs.collect()}
    average = sum(map(len, held.values())) / len(held)
    df = {}
    for terms in held.values():
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    expected = []
    for r in asked.collect():
        scored = []
        for doc_id, terms in held.items():
            score = 0.0
            for t in set(tokens(r.text)) & set(terms):
                tf = terms.count(t)
                idf = math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5))
                score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / average))
            if score:
                scored.append((-round(score, 6), doc_id))
        scored.sort()
        expected += [(r.item_id, d, -s, i + 1) for i, (s, d) in enumerate(scored[:5])]
    index = stage(fulltext.document_terms(docs), "terms")
    got = fulltext.fulltext_topk(asked, index, 5, max_travelling)
    assert rows(got.select("item_id", "doc_id", "score", "rank"), "item_id", "rank") == sorted(
        expected, key=lambda r: (r[0], r[3])
    )


# --- snapshots -------------------------------------------------------------


def test_snapshot_round_trip(spark, tiny):
    path, store = fresh_path(spark, "snapshot"), VersionStore(spark, fresh_path(spark, "store"))
    tables = {t: load_table(spark, tiny, t) for t in ("events", "customer", "embeddings", "documents")}
    tables["empty"] = tables["events"].where("false")
    manifest = {r["table"]: tuple(r[k] for k in MEASURES) for r in snapshots.snapshot_export(spark, tables, path).collect()}
    assert set(manifest) == set(tables) and manifest["empty"] == (0, 0, 0, 0)
    schemas = {t: df.schema for t, df in tables.items()}
    assert snapshots.damaged_parts(spark, path, schemas).isEmpty()
    snapshots.snapshot_import_clean(spark, path, schemas, store)
    for name, df in tables.items():
        same_rows(store.current(name), df)
        assert tuple(df.agg(*table_digest(df.schema)).first()) == manifest[name]


def test_import_names_the_damaged_part(spark, tiny, tmp_path):
    path, store = fresh_path(spark, "snapshot"), VersionStore(spark, fresh_path(spark, "store"))
    customer = load_table(spark, tiny, "customer").repartition(3)
    schemas = {"customer": schema_of("customer")}
    snapshots.snapshot_export(spark, {"customer": customer}, path)
    names = sorted(r.part for r in snapshots.read_parts(spark, path).collect())
    assert len(names) == 3
    local = path.removeprefix("file:")
    held = pq.read_table(f"{local}/customer/{names[1]}")
    at = held.column_names.index("c_acctbal")
    nudged = pa.array([held.column(at)[0].as_py() + 1e-7, *held.column(at)[1:].to_pylist()], pa.float64())
    pq.write_table(held.set_column(at, held.schema.field(at), nudged), tmp_path / "changed.parquet")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.Path(f"{path}/customer/{names[1]}")
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray((tmp_path / "changed.parquet").read_bytes()))
    out.close()
    spark.createDataFrame([("customer", "lost.parquet", 2, 1, 1, 1)], snapshots.PARTS_SCHEMA).write.mode("append").parquet(
        f"{path}/{snapshots.PARTS}"
    )
    customer.limit(2).coalesce(1).write.mode("append").parquet(f"{path}/customer")
    found = snapshots.damaged_parts(spark, path, schemas).collect()
    assert sorted((r.problem, r.rows_listed, r.rows_found) for r in found) == [
        ("changed", held.num_rows, held.num_rows),
        ("missing", 2, 0),
        ("unlisted", 0, 2),
    ]
    assert [r.part for r in found if r.problem == "changed"] == [names[1]]
    with pytest.raises(snapshots.SnapshotError, match=names[1]):
        snapshots.snapshot_import_clean(spark, path, schemas, store)
    assert store.names() == []


def test_bad_snapshot_publishes_nothing(spark, tiny):
    root = fresh_path(spark, "bad")
    events, customer = load_table(spark, tiny, "events"), load_table(spark, tiny, "customer")
    snapshots.snapshot_export(spark, {"customer": customer, "events": events}, root)
    store = VersionStore(spark, fresh_path(spark, "store"))
    store.replace("customer", customer)
    events.limit(3).write.mode("append").parquet(f"{root}/events")
    schemas = {t: schema_of(t) for t in ("customer", "events")}
    with pytest.raises(snapshots.SnapshotError):
        snapshots.snapshot_import_clean(spark, root, schemas, store)
    assert store.current("events") is None
    same_rows(store.current("customer"), customer)
    with pytest.raises(snapshots.SnapshotError):
        snapshots.snapshot_import_clean(spark, root, {"orders": schema_of("orders")}, store)
    with pytest.raises(Exception):
        snapshots.read_manifest(spark, fresh_path(spark, "nowhere")).collect()


def test_clean_import_withdraws_and_takes_every_table(spark, tiny):
    path, store = fresh_path(spark, "snapshot"), VersionStore(spark, fresh_path(spark, "store"))
    tables = {t: load_table(spark, tiny, t) for t in ("customer", "region")}
    snapshots.snapshot_export(spark, tables, path)
    store.replace("nation", load_table(spark, tiny, "nation"))
    with pytest.raises(snapshots.SnapshotError):
        snapshots.snapshot_import_clean(spark, path, {"customer": schema_of("customer")}, store)
    assert store.names() == ["nation"]
    snapshots.snapshot_import_clean(spark, path, {t: schema_of(t) for t in tables}, store)
    assert store.names() == ["customer", "region"]


def test_newest_version_of_a_batch_wins(spark):
    batch = spark.createDataFrame([(1, "old", 1), (1, "new", 3), (1, "mid", 2), (2, "x", None)], "doc_id bigint, text string, v int")
    assert sorted(map(tuple, indexes.newest(batch, "v").collect())) == [(1, "new"), (2, "x")]


def test_hash_ignores_order_but_not_content(spark):
    schema = "a bigint, b double, c string, d array<float>"
    one = [(1, 0.1, "x", [1.0, 2.5]), (2, None, None, None), (2, None, None, None)]
    hash_of = lambda data: spark.createDataFrame(data, schema).agg(table_hash(df.schema)).first()[0]
    df = spark.createDataFrame(one, schema)
    assert hash_of(one) == hash_of(one[::-1])
    assert hash_of(one) != hash_of(one[:2])
    assert hash_of(one) != hash_of([(1, 0.1, "x", [2.5, 1.0]), *one[1:]])
    assert hash_of([]) == "0"


def test_digest_is_exact(spark):
    def digest(value: str, kind: str) -> tuple:
        df = spark.sql(f"SELECT CAST({value} AS {kind}) AS `a.b`, 1 AS n")
        return tuple(df.agg(*table_digest(df.schema)).first())

    different = {
        "double": ["0", "1e-7", "-0.0D", "double('NaN')", "double('Infinity')", "null", "0.1D + 0.2D", "0.3D"],
        "float": ["0", "-0.0F", "float('NaN')", "null"],
        "string": ["''", "null", "'a'", "' a'"],
        "array<double>": ["array()", "null", "array(null)", "array(null, 1)", "array(1, null)", "array(1)", "array(0, -0.0D)", "array(0, 0)"],
        "array<array<string>>": ["array(array('a'), array('b'))", "array(array('a', 'b'))", "array(array('a', 'b'), array())", "array(null)"],
        "struct<x:int,y:array<int>>": ["null", "struct(null, null)", "struct(1, null)", "struct(null, array(1))", "struct(1, array())"],
        "map<string,int>": ["null", "map()", "map('a', 1)", "map('a', null)", "map('b', 1)", "map('a', 1, 'b', 2)", "map('a', 2, 'b', 1)"],
        "decimal(38,18)": ["0", "0.000000000000000001", "null"],
        "binary": ["X''", "X'00'", "null"],
        "boolean": ["true", "false", "null"],
        "timestamp_ntz": ["timestamp_ntz'2024-01-01 00:00:00'", "timestamp_ntz'2024-01-01 00:00:00.000001'", "null"],
    }
    for kind, values in different.items():
        assert len({digest(v, kind) for v in values}) == len(values), kind
    assert digest("map('a', 1, 'b', 2)", "map<string,int>") == digest("map('b', 2, 'a', 1)", "map<string,int>")


# --- plan helpers ----------------------------------------------------------


def test_number_rows_and_carry_over_buckets(spark):
    data = [(i * 7 % 101, "hot" if i % 3 else f"g{i % 5}", "h" + str(i) if i % 13 == 0 else None) for i in range(101)]
    df = spark.createDataFrame(data, "id bigint, grp string, head string")
    edges = ordering.order_edges(df, "id", 9)
    assert len(edges) > 5 and ordering.order_edges(df, "id", 1000) == []
    numbered = {r.id: r.pos for r in ordering.number_rows(df, "grp", ["id"], edges, "pos").collect()}
    carried = {r.id: r.got for r in ordering.carry_forward(df, "id", F.col("head"), edges, "got").collect()}
    seen, last = {}, None
    for id_, grp, head in sorted(data):
        seen[grp] = seen.get(grp, 0) + 1
        assert numbered[id_] == seen[grp] and carried[id_] == last
        last = head or last


def test_size_checks(spark):
    df = spark.range(10)
    assert sizing.fits(df, 10) and not sizing.fits(df, 9)
    assert sizing.fetch_bounded(df, 9) is None and sizing.fetch_bounded(df, 10).num_rows == 10
    assert "broadcast" in sizing.broadcast_if_small(df, 10)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in sizing.broadcast_if_small(df, 9)._jdf.queryExecution().analyzed().toString().lower()
    assert sizing.spread_small_input(spark.range(0, 9, 1, 1), "id").rdd.getNumPartitions() == 8
    assert sizing.spread_small_input(spark.range(0, 9, 1, 9), "id").rdd.getNumPartitions() == 9


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    named = spark.conf.get(workspace.CHECKPOINT_DIR, None)
    assert named is None or workspace.shared_folder(spark) == named.rstrip("/")
    monkeypatch.setattr(workspace, "CHECKPOINT_DIR", "spark.weftline.no.such.setting")
    own = workspace.shared_folder(spark)
    assert own != named and workspace.shared_folder(spark) == own


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default):
            return {"spark.master": "yarn"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        workspace.shared_folder(Session())
