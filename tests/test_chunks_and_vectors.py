import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows, same_rows

from weftline.functions import terms, topk
from weftline.operators import chunking, embedding, search, sections
from weftline.sources.tables import load_table

LETTERS = "abcdé \n𝄞"


def expected_chunks(text, is_header, size=1000, step=800):
    out, offset, headers = [], 0, []
    for line in text.split("\n"):
        if is_header(line):
            headers.append((offset, line))
        offset += len(line) + 1
    for start in range(0, max(len(text) - (size - step) - 1, 0) + 1, step):
        symbol = [h for at, h in headers if at <= start]
        out.append((start, symbol[-1] if symbol else None, text[start : start + size]))
    return out


def odd_texts():
    rng = random.Random(11)
    texts = ["", "x", "\n", "a" * 200, "a" * 201, "a" * 800, "a" * 1000, "a" * 1001, "a" * 5000]
    texts += ["h\n" + "b" * 797 + "\nhead\n" + "c" * 900, "q" * 799 + "\n" + "r" * 40 + "\n" + "s" * 900]
    texts += ["t" * 780 + "\n" + "u" * 40 + "\n" + "v" * 2000 + "\nend\n", "￿" * 30 + "\n" + "w" * 3000]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 30)):
            parts.append("".join(rng.choices(LETTERS, k=rng.choice([3, 20, 39, 40, 41, 42, 300, 900]))))
        texts.append("\n".join(parts))
    return texts


def test_chunks_against_brute_force(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(
        [(i, t, "xx") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string"
    )
    got = {}
    for r in chunking.chunk_documents(docs).collect():
        assert r.chunk_id == hashlib.sha256(f"{r.doc_id}:{r.start}".encode()).hexdigest()
        assert r.layer == "xx" and r.start == 800 * r.chunk_no
        got.setdefault(r.doc_id, []).append((r.start, r.symbol, r.text))
    for i, text in enumerate(texts):
        expected = expected_chunks(text, lambda line: len(line) <= sections.SHORT_LINE)
        found = sorted(got[i])
        assert [(a, c) for a, _, c in found] == [(a, c) for a, _, c in expected], i
        if "￿" not in text:
            assert [b for _, b, _ in found] == [b for _, b, _ in expected], i


def test_chunk_symbols_with_markers(spark):
    text = "##@-- One\nalpha: ##@ x\n" + "y" * 900 + "\n##@-- " + "long title " * 90 + "\nz: ##@ " + "w" * 900
    docs = spark.createDataFrame([(1, text, "xx")], "doc_id bigint, text string, lang string")
    got = [r.symbol for r in chunking.chunk_documents(docs, sections.MARKERS).orderBy("start").collect()]
    expected = expected_chunks(text, lambda line: line.startswith("##@--"))
    assert got == [re.sub(r"^##@--\s*", "", s) for _, s, _ in expected]


def test_chunk_bounds_are_checked(spark, tiny):
    with pytest.raises(ValueError):
        chunking.chunk_documents(load_table(spark, tiny, "documents"), size=1000, step=400)


def test_chunking_does_not_shuffle(spark, tiny):
    plan = embedding.embed(chunking.chunk_documents(load_table(spark, tiny, "documents")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def expected_vector(text):
    counts = [0.0] * 64
    for token in re.split(r"[^\w]+|_", text.lower()):
        if token:
            counts[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 64] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [c / norm if norm else 0.0 for c in counts]


def test_embedding_against_brute_force(spark, tiny):
    docs = load_table(spark, tiny, "documents").select("doc_id", "text")
    for r in embedding.embed(docs.join(docs.withColumnRenamed("text", "raw"), "doc_id")).collect():
        assert np.allclose(r.embedding, expected_vector(r.raw), atol=1e-12)


def test_text_without_tokens_has_a_zero_vector_and_no_sparse_rows(spark):
    docs = spark.createDataFrame([(1, "?! --"), (2, "")], "doc_id bigint, text string")
    assert all(set(r.embedding) == {0.0} for r in embedding.embed(docs).collect())
    assert embedding.hashed_embedding(docs).count() == 0


# --- top-k -----------------------------------------------------------------


def test_memory_of_counting_does_not_follow_the_batch():
    lists = [[f"t{(i * j) % 97}" for j in range(400)] for i in range(500)] + [None, [], ["a"] * 300]
    schema = pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.string()))])

    def peak(times, job):
        held = pa.RecordBatch.from_pydict({"id": list(range(len(lists) * times)), "tokens": lists * times}, schema)
        tracemalloc.start()
        found = [r.num_rows for r in job(iter([held]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(found) == held.num_rows
        return most

    for job in (terms.count_terms, terms.hashed_vectors(64, "embedding")):
        assert peak(10, job) < 2 * peak(2, job)


def test_slices_of_a_batch_count_the_same(monkeypatch):
    lists = [["a", "b", "a"], None, [], ["c"] * 7, ["a", "c"], ["d"], ["b", "b"]]
    held = pa.RecordBatch.from_pydict({"id": list(range(7)), "tokens": pa.array(lists, pa.list_(pa.string()))})
    jobs = (terms.count_terms, terms.hashed_vectors(4, "embedding"))
    whole = [pa.Table.from_batches(job(iter([held]))).to_pylist() for job in jobs]
    for most in (1, 2, 3, 5):
        cut = list(terms.slices(iter([held]), most))
        assert len(cut) > 1 and pa.Table.from_batches(cut).to_pylist() == held.to_pylist()
        with monkeypatch.context() as patch:
            patch.setattr(terms, "slices", lambda batches, cut=cut: iter(cut))
            found = [pa.Table.from_batches(job(iter([held]))).to_pylist() for job in jobs]
        for a, b in zip(whole[0], found[0], strict=True):
            assert dict(zip(a["terms"], a["tfs"])) == dict(zip(b["terms"], b["tfs"]))
        assert whole[1] == found[1]


def brute(queries, vectors, k, exclude_self=False):
    out = []
    for qid, q in queries:
        scored = []
        for vid, v in vectors:
            if exclude_self and vid == qid:
                continue
            d = math.sqrt(np.dot(q, q) * np.dot(v, v))
            sim = round(float(np.dot(q, v)) / d, 6) if d else None
            scored.append((sim is None, -(sim or 0), vid, sim))
        scored.sort(key=lambda s: s[:3])
        out += [(qid, vid, sim, i + 1) for i, (_, _, vid, sim) in enumerate(scored[:k])]
    return sorted(out)


def test_kernel_keeps_ties_and_missing_scores_in_order():
    best = topk.TopK(3)
    nan = float("nan")
    best.add(0, np.array([[0.5, 0.5, nan, 0.5], [nan, nan, nan, 0.1]]), pa.table({"id": ["d", "b", "a", "c"]}))
    best.add(0, np.array([[0.5, 0.7], [nan, nan]]), pa.table({"id": ["aa", "e"]}))
    got = best.table(pa.array([10, 20]), "q", "s").to_pylist()
    assert [(r["q"], r["id"], r["s"]) for r in got] == [
        (10, "e", 0.7),
        (10, "aa", 0.5),
        (10, "b", 0.5),
        (20, "c", 0.1),
        (20, "a", None),
        (20, "aa", None),
    ]


def kernel_cases():
    rng = np.random.default_rng(5)
    spread, copies = rng.normal(size=(9000, 8)), rng.normal(size=(40, 8))[rng.integers(0, 40, 9000)]
    odd = spread.copy()
    odd[::3], odd[5], odd[6], odd[7] = 0, np.nan, 1e-200, odd[7] * 1e40
    alike = spread[:1] + 1e-7 * spread
    mostly_zero = np.vstack([spread[:3], np.zeros((20, 8))])
    return {"spread": spread, "copies": copies, "odd": odd, "alike": alike, "mostly_zero": mostly_zero}


@pytest.mark.parametrize("case", kernel_cases())
def test_kernel_scores_few_pairs_and_finds_the_same(case, monkeypatch):
    vectors, k = kernel_cases()[case], 5
    asked, ids = vectors[:300], np.random.default_rng(6).permutation(len(vectors))
    expected = []
    for i, scores in enumerate(topk.cosine(asked, vectors)):
        order = np.lexsort((ids, -np.where(np.isnan(scores), -np.inf, scores)))[:k]
        expected += [(i, ids[j], None if np.isnan(scores[j]) else scores[j]) for j in order]
    scored = []
    monkeypatch.setattr(topk, "cosine", lambda q, v, whole=topk.cosine: scored.append(len(q) * len(v)) or whole(q, v))
    best = topk.TopK(k)
    topk.cosine_block(best, asked, vectors, pa.table({"id": ids}))
    found = best.table(pa.array(range(len(asked))), "query_id", "sim")
    assert [tuple(r.values()) for r in found.to_pylist()] == expected
    if case == "spread":
        assert sum(scored) == 0  # before: every pair in double precision


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    grid = rng.integers(-2, 3, size=(120, 4)).astype(float)  # many ties, some zero vectors
    data = [(i, [float(x) for x in v]) for i, v in enumerate(grid)]
    return data, spark.createDataFrame(data, "vec_id bigint, embedding array<float>").repartition(5)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("max_travelling", [1000, 5])
def test_both_exact_plans_match_brute_force(points, monkeypatch, exclude_self, max_travelling):
    monkeypatch.setattr(search, "SLICE_CANDIDATES", 17)
    monkeypatch.setattr(search, "SLICE_QUERIES", 13)
    data, df = points
    queries = df.withColumnRenamed("vec_id", "query_id")
    got = search.cosine_topk(queries, df, 7, exclude_self, max_travelling)
    assert rows(got.select("query_id", "vec_id", "sim", "rank"), "query_id", "vec_id") == sorted(
        brute(data, data, 7, exclude_self), key=lambda r: (r[0], r[1])
    )


def test_all_cells_probed_equals_exact(spark, small, monkeypatch):
    monkeypatch.setattr(search, "SLICE_CANDIDATES", 40)
    vectors = load_table(spark, small, "embeddings")
    centroids = search.label_centroids(vectors, 64)
    plain = vectors.select("vec_id", "embedding")
    celled = search.ivf_index(plain, centroids).cache()
    queries = plain.withColumnRenamed("vec_id", "query_id")
    exact = search.cosine_topk(queries, plain, 10, exclude_self=True)
    same_rows(exact, search.cosine_topk_ivf(queries, celled, centroids, 10, 10, exclude_self=True))


def test_recall_grows_with_probes(spark, small):
    vectors = load_table(spark, small, "embeddings")
    plain = vectors.select("vec_id", "embedding").cache()
    centroids = search.kmeans_centroids(vectors, cells=12)
    celled = search.ivf_index(plain, centroids).cache()
    assert celled.count() == plain.count()
    queries = plain.withColumnRenamed("vec_id", "query_id")
    exact = search.cosine_topk(queries, plain, 10).select("query_id", "vec_id").cache()
    found = []
    for nprobe in (1, 6, 12):
        got = search.cosine_topk_ivf(queries, celled, centroids, 10, nprobe)
        found.append(got.join(exact, ["query_id", "vec_id"]).count() / exact.count())
    assert found[0] < found[1] < found[2] == 1.0


def test_many_centroids_take_the_sliced_plan(spark, small):
    vectors = load_table(spark, small, "embeddings")
    centroids = search.label_centroids(vectors, 64)
    few = search.nearest_cells(vectors, centroids, 3)
    many = search.nearest_cells(vectors, centroids, 3, max_travelling=2)
    assert few.count() == 3 * vectors.count()
    same_rows(few, many)


def test_semantic_search_matches_brute_force(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    asked = load_table(spark, tiny, "benchmark")
    chunks = [(r.chunk_id, np.array(expected_vector(r.text))) for r in chunking.chunk_documents(docs).collect()]
    queries = [(r.item_id, np.array(expected_vector(r.text))) for r in asked.collect()]
    got = rows(
        search.semantic_search(asked, docs, 5).select("item_id", "chunk_id", "sim", "rank"), "item_id", "rank"
    )
    assert got == sorted(brute(queries, chunks, 5), key=lambda r: (r[0], r[3]))
