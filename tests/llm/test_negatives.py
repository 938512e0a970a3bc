import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import check, duck
from weftline.llm import negatives, queries
from weftline.sources.workspace import stage

SCHEMA = "vec_id bigint, label int, embedding array<float>, score int, key string"
ANCHORS = "vec_id % 5 = 0"


def brute(rows, n_positives, n_negatives, low, high):
    """Every anchor against every row, in whole numbers."""
    held = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        held[vec_id] = min(held.get(vec_id, (label, vector, whole)), (label, vector, whole))
    out = []
    for a, (label, _, v) in held.items():
        if a % 5:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, m) for b, (m, _, w) in held.items() if b != a)
        for p, positive, _ in [s for s in scores if s[2] == label][:n_positives]:
            fit = [s for s in scores if s[2] != label and -low * p <= -100 * s[0] <= -high * p][:n_negatives]
            out += [(a, positive, rank, b, -p, -s) for rank, (s, b, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(df, F.expr(ANCHORS), **options).collect())


def clustered(n, seed=3):
    """Clusters, copies, ties and a vector that a third of the rows share."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, 8))
    out = []
    for i in range(n):
        v = centres[i % 6] + draw.normal(size=8) * 0.2 if i % 3 else centres[0]
        out.append((i, int(draw.integers(0, 4)), [float(np.float32(x)) for x in v], 1, "x"))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rows = clustered(400)
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize(("leaf_rows", "low", "high"), [(8, 30, 90), (10_000, 0, 100)])
def test_equals_brute_force(vectors, leaf_rows, low, high):
    rows, df = vectors
    found = mined(df, n_positives=4, n_negatives=3, low=low, high=high, leaf_rows=leaf_rows)
    assert found and found == brute([r[:3] for r in rows], 4, 3, low, high)


def test_small_slices(vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(negatives, "SLICE_ROWS", 37)
    monkeypatch.setattr(negatives, "SLICE_QUERIES", 5)
    assert mined(df, n_positives=2, n_negatives=4) == brute([r[:3] for r in rows], 2, 4, 30, 90)


def test_every_row_is_indexed_and_ranges_hold(spark, vectors):
    whole = stage(negatives.whole_vectors(vectors[1]), "whole")
    index = negatives.build_index(whole, leaf_rows=16, sample_rows=60)
    tree = index.tree.value
    placed = index.rows.toArrow()
    assert placed.num_rows == 400 and len(tree.points) > 1
    lifted = tree.lifted(negatives._matrix(placed.column("vector")))
    lo = [a.copy() for a in tree.lo]
    hi = [a.copy() for a in tree.hi]
    leaves = negatives._descend(tree, lifted, lo, hi)
    assert (leaves == placed.column("leaf").to_numpy()).all()
    assert all((a == b).all() for a, b in zip([*lo, *hi], [*tree.lo, *tree.hi], strict=True))


def test_siblings_are_left_out(spark):
    """Two far clusters: a narrow annulus around one never reaches the other's leaves."""
    draw = np.random.default_rng(5)
    sample = np.vstack([draw.integers(0, 9, (200, 8)) + 900, draw.integers(0, 9, (200, 8)) - 900]).astype(np.int64)
    radius2 = float((sample * sample).sum(1).max())
    tree = negatives.grow_tree(sample, 400, radius2, leaf_rows=20)
    leaves = negatives._descend(tree, tree.lifted(sample), tree.lo, tree.hi)
    anchor = sample[:1]
    near = int((anchor @ sample[:200].T).min())
    owner, inner, outer = negatives._radii(tree, anchor, [[near]], [[negatives.MOST]])
    _, reached, _ = negatives.reached_leaves(tree, negatives._anchored(anchor), owner, inner, outer)
    assert set(leaves[:200]) <= set(reached.tolist())
    assert not set(leaves[200:]) & set(reached.tolist())


def test_routes_of_vectors_without_clusters_are_bounded():
    """Every window reaches every leaf: the pairs are not held at once, and a query is a
    row for a shard, not for a leaf."""
    draw = np.random.default_rng(8)
    sample = draw.integers(-99, 99, (3000, 24)).astype(np.int64)
    tree = negatives.grow_tree(sample, 3000, float((sample * sample).sum(1).max()), leaf_rows=8)
    leaves = negatives._descend(tree, tree.lifted(sample), tree.lo, tree.hi)
    shards = negatives.shards_of(np.bincount(leaves, minlength=tree.leaves), 1000)
    n = 1500
    windows = {"keys": [0, 1, 2, 3, 4], "lows": [negatives.LEAST] * 5, "highs": [negatives.MOST] * 5}
    columns = {name: pa.array([each] * n, pa.list_(pa.int64())) for name, each in windows.items()}
    vectors = pa.array([v.astype("<i4").tobytes() for v in sample[:n]])
    batch = pa.record_batch({"anchor_id": pa.array(range(n)), "label": pa.array([1] * n), "vector": vectors, **columns})
    held, cut = SimpleNamespace(value=tree), SimpleNamespace(value=shards)
    rows = met = 0
    tracemalloc.start()
    for chosen in negatives._choose_first(held)(iter([batch])):
        for rest in negatives._route_rest(held, cut)(iter([chosen])):
            rows, met = rows + rest.num_rows, met + len(rest.column("leaves").flatten())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert met == n * (tree.leaves - negatives.FIRST_LEAVES) and rows <= n * (shards.max() + 1)
    assert n * 5 * tree.leaves > 5 * negatives.ROUTED_AT_ONCE and peak < 150e6


def test_leaves_form_shards():
    assert negatives.shards_of(np.array([3, 3, 0, 5, 9, 1]), 6).tolist() == [0, 0, 0, 1, 2, 3]


@pytest.mark.parametrize("low", [0.1, 0.9])
def test_best_of_windows(low):
    """Few and many candidates of overlapping windows."""
    draw = np.random.default_rng(2)
    scores, fits = draw.integers(0, 50, (7, 200)), draw.random((7, 200)) < low
    edges = [[(0, 49), (40, 45), (48, 3)], [], [(49, 49)], [(47, 49), (0, 1)], [], [(30, 40)], [(0, 20), (10, 30)]]
    keys, lows, highs = ([list(range(len(w))) for w in edges], *([[pair[n] for pair in w] for w in edges] for n in (0, 1)))
    found = sorted(
        tuple(int(x) for x in row)
        for part in negatives._best_of_windows(scores, fits, keys, lows, highs, 4)
        for row in zip(*part, strict=True)
    )
    expected = []
    for q, windows in enumerate(edges):
        for key, (least, most) in enumerate(windows):
            inside = [(-scores[q, c], c) for c in range(200) if fits[q, c] and least <= scores[q, c] <= most]
            expected += [(q, key, int(c), int(-s)) for s, c in sorted(inside)[:4]]
    assert found == sorted(expected)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.0]), (5, 1, [0.5, 0.5]), (10, 2, [0.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.1]),
        (3, 2, [0.9, 0.1]), (3, 2, [0.9, 0.1]), (4, None, [1.0, 1.0]), (6, 2, None), (7, 2, [nan, 0.0]),
        (8, 2, [inf, 0.0]), (9, 2, [None, 0.0]), (None, 2, [1.0, 0.0]), (11, 2, [-1.0, -1.0]), (15, 3, [0.3, 0.3]),
        (12, 2, [0.5]), (13, 1, []), (14, 2, [0.25, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 0, None) for r in rows], SCHEMA)
    filled = [(i, m, v if v is None else [*v, *[0.0] * (2 - len(v))]) for i, m, v in rows]
    assert mined(df) == brute(filled, 5, 10, 30, 90)


def test_huge_components_are_cut(spark):
    rows = [(0, 1, [1e30, 0.0]), (1, 1, [1e30, 1.0]), (2, 2, [1e29, 1.0]), (3, 2, [1.0, 1.0])]
    found = mined(spark.createDataFrame([(*r, 0, None) for r in rows], SCHEMA), low=0, high=100)
    bound = negatives.component_bound(2)
    assert [r[3] for r in found] == [2, 3] and found[0][4] == bound * bound


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_twin(spark, tiny):
    difference, n, *_ = check(spark, duck(tiny), tiny, queries.op11_hard_negatives, queries.NEGATIVES_SQL)
    assert difference is None and n > 0
