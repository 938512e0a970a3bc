"""Hard negatives by a multiway hyperplane tree of the GNAT kind (Brin 1995).

Vectors of whole numbers are lifted onto a sphere by one more coordinate, so an inner
product with an anchor is a distance and a window of scores an annulus around the
anchor.

* Tree: every inner node has up to ``ARITY`` split points; a vector goes to the
  nearest. Split points are taken from a sample (the ``SAMPLE_ROWS`` rows of least
  hash), every vector is sent down the tree. Each split point stores the range of its
  distances to the vectors below each of its siblings, taken over all vectors.
* Search: a sibling is left out when for some split point the range, by the triangle
  inequality, does not meet the annulus. Leaves are compared exactly. A search goes
  twice: some leaves near the annulus give a bound for the k-th score, then the
  narrowed annulus chooses among all others.

Neighbouring leaves form shards of bounded size, and an anchor goes once to a shard,
with the leaves of it that it reaches. A shard and its visitors meet in groups of
bounded size: visitors, and the rows of a leaf too large for a shard, are cut into
slices by the hash of their ids, so a hot leaf is many groups. No pair leaves a group
unless it is among the k best there. Routes are found for so many anchors at a time
that a window and a leaf of it fit ``ROUTED_AT_ONCE`` times: where vectors have no
clusters, almost every window reaches almost every leaf.

Defined results: rows without an id, a label, a vector or with a component that is
null or not finite take no part. Of the rows of one id the least by (label, vector)
counts. Shorter vectors are filled up with zeros. Components beyond the bound that
keeps 100 times a score within 64 bits are cut to it. Equal scores rank by id. Other
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.workspace import stage

ARITY = 16
SAMPLE_ROWS = 16_384
LEAF_ROWS = 512
SLICE_ROWS = 20_000
SLICE_QUERIES = 4_000
FIRST_LEAVES = 3
SCORED_AT_ONCE = 2_000_000
ROUTED_AT_ONCE = 1_000_000
ROUTED_TOGETHER = 256  # queries of a task
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
LEAST, MOST = -(1 << 62), 1 << 62  # an open window

INDEX = "vec_id bigint, label bigint, vector binary, leaf int, node int, i int, j int, lo double, hi double"


# --- vectors ---------------------------------------------------------------


def component_bound(width: int) -> int:
    return min((1 << 31) - 1, math.isqrt(((1 << 63) - 1) // (100 * max(width, 1))))


def _whole(width: int):
    """Components to whole numbers, as bytes, with the squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = component_bound(width)
        for batch in batches:
            lists = batch.column(2)
            row = pc.list_parent_indices(lists).to_numpy()
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            whole = np.zeros((batch.num_rows, width), np.int64)
            whole[row, place] = np.clip(np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)), -bound, bound)
            out = [one.tobytes() for one in whole.astype("<i4")]
            squares = np.einsum("ij,ij->i", whole, whole)
            arrays = [batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(squares, pa.int64())]
            yield pa.record_batch(arrays, ["vec_id", "label", "vector", "square"])

    return run


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector, square`` of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    held = held.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(sound)
    one = held.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    width = held.agg(F.max(F.size("embedding"))).first()[0] or 0
    return one.mapInArrow(_whole(width), "vec_id bigint, label bigint, vector binary, square bigint")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """int64, one row per vector."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<i4").reshape(len(column), -1).astype(np.int64)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where none can pass 2**53."""
    longest = left.shape[1] * int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0))
    if longest < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


# --- tree ------------------------------------------------------------------


@dataclass
class Tree:
    """Inner nodes with their split points on the sphere of squared radius ``radius2``.

    ``children[n][j]``: a leaf number, or -1 - m for the inner node m. Without inner
    nodes there is one leaf, 0. ``lo``, ``hi``: for split point i and child j of a node
    the range of distances.
    """

    radius2: float
    points: list[np.ndarray]
    children: list[np.ndarray]
    leaves: int
    lo: list[np.ndarray]
    hi: list[np.ndarray]

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        held = vectors.astype(np.float64)
        rest = self.radius2 - np.einsum("ij,ij->i", held, held)
        return np.hstack([held, np.sqrt(np.maximum(rest, 0.0))[:, None]])

    @property
    def slack(self) -> float:
        """More than the rounding of any distance."""
        return 1e-6 * math.sqrt(self.radius2) + 1e-9


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", left, left)[:, None] + np.einsum("ij,ij->i", right, right) - 2 * left @ right.T
    return np.sqrt(np.maximum(square, 0.0))


def _split_points(held: np.ndarray, arity: int, slack: float) -> np.ndarray:
    """Points far from each other: each the farthest from those before it."""
    chosen = [int(np.argmax(_distances(held, held.mean(0)[None])[:, 0]))]
    near = _distances(held, held[chosen])[:, 0]
    while len(chosen) < arity and near.max() > slack:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(held, held[chosen[-1:]])[:, 0])
    return held[chosen]


def grow_tree(sample: np.ndarray, n_rows: int, radius2: float, leaf_rows: int = LEAF_ROWS, arity: int = ARITY) -> Tree:
    """The tree over a sample of ``n_rows`` vectors, so deep that a leaf is expected
    to hold at most ``leaf_rows`` of them. Ranges are empty until ``with_ranges``."""
    tree = Tree(radius2, [], [], 0, [], [])
    share = n_rows / max(len(sample), 1)

    def grow(held: np.ndarray) -> int:
        points = _split_points(held, arity, tree.slack) if len(held) * share > leaf_rows else held[:0]
        if len(points) < 2:
            tree.leaves += 1
            return tree.leaves - 1
        node = len(tree.points)
        nearest = _distances(held, points).argmin(1)
        tree.points.append(points)
        tree.children.append(np.zeros(len(points), np.int64))
        for j in range(len(points)):
            tree.children[node][j] = grow(held[nearest == j])
        return -1 - node

    if len(sample):
        grow(tree.lifted(sample))
    tree.leaves = max(tree.leaves, 1)
    for points in tree.points:
        tree.lo.append(np.full((len(points), len(points)), np.inf))
        tree.hi.append(np.full((len(points), len(points)), -np.inf))
    return tree


def _descend(tree: Tree, lifted: np.ndarray, lo: list[np.ndarray], hi: list[np.ndarray]) -> np.ndarray:
    """The leaf of each vector; widens the ranges on its way."""
    leaf = np.zeros(len(lifted), np.int32)
    waiting = [(0, np.arange(len(lifted)))] if tree.points else []
    while waiting:
        node, rows = waiting.pop()
        apart = _distances(lifted[rows], tree.points[node])
        nearest = apart.argmin(1)
        for j, child in enumerate(tree.children[node]):
            own = nearest == j
            if not own.any():
                continue
            lo[node][:, j] = np.minimum(lo[node][:, j], apart[own].min(0))
            hi[node][:, j] = np.maximum(hi[node][:, j], apart[own].max(0))
            if child >= 0:
                leaf[rows[own]] = child
            else:
                waiting.append((int(-1 - child), rows[own]))
    return leaf


def _place(tree: Broadcast):
    """Every vector with its leaf; at the end of a task the ranges it has seen."""
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in INDEX.split(", ")]

    def batch_of(columns: dict[str, object], rows: int) -> pa.RecordBatch:
        arrays = [columns.get(name, pa.nulls(rows, kind)) for name, kind in zip(names, kinds, strict=True)]
        return pa.record_batch([pa.array(a, k) if isinstance(a, np.ndarray) else a for a, k in zip(arrays, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tree.value
        lo, hi = [a.copy() for a in held.lo], [a.copy() for a in held.hi]
        for batch in batches:
            if batch.num_rows:
                leaf = _descend(held, held.lifted(_matrix(batch.column(2))), lo, hi)
                columns = dict(zip(names, batch.columns[:3], strict=False)) | {"leaf": leaf}
                yield batch_of(columns, batch.num_rows)
        for node, (low, high) in enumerate(zip(lo, hi, strict=True)):
            i, j = np.nonzero(np.isfinite(low))
            ranges = {"node": np.full(len(i), node), "i": i, "j": j, "lo": low[i, j], "hi": high[i, j]}
            yield batch_of(ranges, len(i))

    return run


def _with_ranges(tree: Tree, ranges: DataFrame) -> Tree:
    """The tree with the ranges over all tasks: at most nodes * ARITY**2 rows."""
    found = ranges.groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    node, i, j, lo, hi = (found.column(c).to_numpy() for c in ("node", "i", "j", "lo", "hi"))
    for n in range(len(tree.points)):
        own = node == n
        tree.lo[n][i[own], j[own]] = lo[own]
        tree.hi[n][i[own], j[own]] = hi[own]
    return tree


@dataclass
class Index:
    """The stored vectors by leaf (vec_id, label, vector, leaf, shard), the tree, the
    shard of each leaf (also as a table), the rows of each shard and its labels."""

    rows: DataFrame
    tree: Broadcast
    shards: Broadcast
    places: DataFrame
    sizes: DataFrame
    labels: DataFrame


def shards_of(leaf_rows: np.ndarray, most: int) -> np.ndarray:
    """The shard of each leaf: neighbours together as long as they hold ``most`` rows."""
    out, shard, held = np.zeros(len(leaf_rows), np.int32), 0, 0
    for leaf, rows in enumerate(leaf_rows.tolist()):
        if held and held + rows > most:
            shard, held = shard + 1, 0
        out[leaf], held = shard, held + rows
    return out


def _with_shard(leaves: DataFrame, places: DataFrame) -> DataFrame:
    own = places.select(F.col("leaf").alias("leaf"), F.col("shard").alias("shard"))  # columns of its own in each join
    return leaves.join(F.broadcast(own), "leaf")


def build_index(vectors: DataFrame, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Index every row of ``whole_vectors`` (a stored table)."""
    spark = vectors.sparkSession
    n_rows, radius2 = vectors.agg(F.count(F.lit(1)), F.max("square")).first()
    sample = vectors.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    held = _matrix(sample.column("vector")) if sample.num_rows else np.zeros((0, 0), np.int64)
    tree = grow_tree(held, n_rows, float(radius2 or 0), leaf_rows)
    placed = stage(vectors.mapInArrow(_place(spark.sparkContext.broadcast(tree)), INDEX), "tree")
    tree = _with_ranges(tree, placed.where("node IS NOT NULL"))
    rows = placed.where("leaf IS NOT NULL").select("vec_id", "label", "vector", "leaf")
    sizes = stage(rows.groupBy("leaf", "label").agg(F.count(F.lit(1)).alias("n")), "leaves")
    counted = sizes.groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()  # leaves come from the sample
    leaf_sizes = np.zeros(tree.leaves, np.int64)
    leaf_sizes[counted.column("leaf").to_numpy()] = counted.column("n").to_numpy()
    shards = shards_of(leaf_sizes, SLICE_ROWS)
    places = spark.createDataFrame(pa.table({"leaf": np.arange(tree.leaves, dtype=np.int32), "shard": shards}))
    rows, sizes = (_with_shard(df, places) for df in (rows, sizes))
    return Index(
        rows,
        spark.sparkContext.broadcast(tree),
        spark.sparkContext.broadcast(shards),
        places,
        sizes.groupBy("shard").agg(F.sum("n").alias("n")),
        sizes.select("shard", "label").distinct(),
    )


# --- search ----------------------------------------------------------------
# A query: anchor_id, label, vector and its windows as three arrays of one length:
# keys (what the window is for), lows, highs (bounds of the score).

QUERY = "anchor_id bigint, label bigint, vector binary, keys array<bigint>, lows array<bigint>, highs array<bigint>, first array<int>"
ROUTE = f"{QUERY}, shard int, leaves array<int>"
FOUND = "anchor_id bigint, key bigint, vec_id bigint, score bigint"


def _radii(tree: Tree, vectors: np.ndarray, lows: list, highs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The annuli of all windows: of which query, inner and outer radius."""
    owner = np.repeat(np.arange(len(lows)), [len(w) for w in lows])
    square = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))[owner] + tree.radius2
    low, high = (np.array([x for w in side for x in w], np.float64) for side in (lows, highs))
    inner = np.sqrt(np.maximum(square - 2 * high, 0.0))
    outer = np.where(low > high, -np.inf, np.sqrt(np.maximum(square - 2 * low, 0.0)))
    return owner, np.where(high >= MOST, 0.0, inner), np.where(low <= LEAST, np.inf, outer)


def _anchored(vectors: np.ndarray) -> np.ndarray:
    return np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))])


def reached_leaves(tree: Tree, anchors: np.ndarray, owner: np.ndarray, inner: np.ndarray, outer: np.ndarray):
    """Of each window the leaves that its annulus may meet: (window, leaf, distance of
    the leaf's split point to the inner radius), as arrays."""
    if not tree.points:
        n = len(owner)
        return np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    slack = tree.slack
    windows, leaves, gaps = [], [], []
    waiting = [(0, np.flatnonzero(outer >= 0))]
    while waiting:
        node, rows = waiting.pop()
        if not len(rows):
            continue
        asked, at = np.unique(owner[rows], return_inverse=True)
        apart = _distances(anchors[asked], tree.points[node])
        lo, hi = tree.lo[node], tree.hi[node]
        nearest = np.maximum(lo - apart[:, :, None], apart[:, :, None] - hi).max(1)
        farthest = (apart[:, :, None] + hi).min(1)
        own = (nearest[at] <= outer[rows, None] + slack) & (farthest[at] >= inner[rows, None] - slack)
        for j, child in enumerate(tree.children[node]):
            met = np.flatnonzero(own[:, j])
            if child >= 0:
                windows.append(rows[met])
                leaves.append(np.full(len(met), child))
                gaps.append(np.abs(apart[at[met], j] - inner[rows[met]]))
            else:
                waiting.append((int(-1 - child), rows[met]))
    if not windows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(windows), np.concatenate(leaves), np.concatenate(gaps)


def _routed(tree: Tree, batch: pa.RecordBatch):
    """The queries of ``batch`` in parts, each with (query, leaf, gap) of its windows. A
    part has so few that its windows and all leaves make at most ``ROUTED_AT_ONCE`` pairs."""
    windows = pc.list_value_length(batch.column("lows")).to_numpy()
    most = max(1, ROUTED_AT_ONCE // (tree.leaves * max(1, int(windows.max(initial=0)))))
    for start in range(0, batch.num_rows, most):
        part = batch.slice(start, most)
        vectors = _matrix(part.column("vector"))
        owner, inner, outer = _radii(tree, vectors, part.column("lows").to_pylist(), part.column("highs").to_pylist())
        window, leaf, gap = reached_leaves(tree, _anchored(vectors), owner, inner, outer)
        yield part, owner[window], leaf, gap


def _choose_first(tree: Broadcast):
    """Of each query the leaves of least gap, ties to the lower leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, query, leaf, gap in _routed(tree.value, batch):
                near = np.full((part.num_rows, tree.value.leaves), np.inf)
                np.minimum.at(near, (query, leaf), gap)
                every, chosen = np.arange(part.num_rows), np.full((part.num_rows, FIRST_LEAVES), -1, np.int32)
                for n in range(FIRST_LEAVES):
                    least = near.argmin(1)
                    found = np.isfinite(near[every, least])
                    chosen[found, n] = least[found]
                    near[every, least] = np.inf
                yield part.append_column("first", pa.array([c[c >= 0].tolist() for c in chosen], pa.list_(pa.int32())))

    return run


def _route_rest(tree: Broadcast, shards: Broadcast):
    """A row for each query and shard: the leaves there that are not among its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, query, leaf, _ in _routed(tree.value, batch):
                reached = np.zeros((part.num_rows, tree.value.leaves), bool)
                reached[query, leaf] = True
                first = part.column("first")
                reached[pc.list_parent_indices(first).to_numpy(), first.flatten().to_numpy()] = False
                query, leaf = np.nonzero(reached)
                shard = shards.value[leaf]
                starts = np.flatnonzero(np.diff(query, prepend=-1) | np.diff(shard, prepend=-1))
                ends = np.append(starts[1:], len(leaf))
                for at in range(0, len(starts), 10_000):
                    a, b = starts[at : at + 10_000], ends[at : at + 10_000]
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(a, b[-1]) - a[0], pa.int32()), pa.array(leaf[a[0] : b[-1]], pa.int32())
                    )
                    rows = part.take(pa.array(query[a])).append_column("shard", pa.array(shard[a], pa.int32()))
                    yield rows.append_column("leaves", lists)

    return run


def best_in_window(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row, ties to the lower column."""
    held = np.where(allowed, scores, LEAST)
    n = held.shape[1]
    if n > k:
        bar = np.partition(held, n - k, axis=1)[:, n - k]
        allowed = allowed & (held >= bar[:, None])
    row, at = np.nonzero(allowed)
    order = np.lexsort((at, -held[row, at], row))
    row, at = row[order], at[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[best], at[best]


def _best_of_windows(scores: np.ndarray, fits: np.ndarray, keys: list, lows: list, highs: list, k: int):
    """(query, key, column, score) of the k best fitting columns in each window of each
    row of ``scores``; ties to the lower column."""
    owner = np.repeat(np.arange(len(keys)), [len(w) for w in keys])
    key, low, high = (np.array([x for w in side for x in w], np.int64) for side in (keys, lows, highs))
    lowest, highest = np.full(len(keys), MOST), np.full(len(keys), LEAST)
    np.minimum.at(lowest, owner, low)
    np.maximum.at(highest, owner, high)
    inside = fits & (scores >= lowest[:, None]) & (scores <= highest[:, None])
    if np.count_nonzero(inside) > inside.size // 8:
        step = max(1, SCORED_AT_ONCE // scores.shape[1])
        for at in range(0, len(owner), step):
            rows = owner[at : at + step]
            held = inside[rows] & (scores[rows] >= low[at : at + step, None]) & (scores[rows] <= high[at : at + step, None])
            row, column = best_in_window(scores[rows], held, k)
            yield rows[row], key[at + row], column, scores[rows[row], column]
        return
    row, column = np.nonzero(inside)
    score = scores[row, column]
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    for n in range(int(nth.max(initial=-1)) + 1):
        window = np.full(len(keys), -1)
        window[owner[nth == n]] = np.flatnonzero(nth == n)
        own = window[row]
        at = np.flatnonzero((own >= 0) & (score >= low[own]) & (score <= high[own]))
        at = at[np.arange(len(at)) - np.searchsorted(row[at], row[at], side="left") < k]
        yield row[at], key[own[at]], column[at], score[at]


def _visits(asked: pa.Table, leaves: np.ndarray) -> np.ndarray:
    """Which of the sorted ``leaves`` each row of ``asked`` has come to."""
    lists = asked.column("leaves").combine_chunks()
    row, leaf = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(leaves, leaf), len(leaves) - 1)
    here = leaves[at] == leaf
    out = np.zeros((asked.num_rows, len(leaves)), bool)
    out[row[here], at[here]] = True
    return out


def _search_group(k: int, same: bool):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if held.num_rows and asked.num_rows:
            held = held.sort_by("vec_id")
            ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
            leaves, leaf = np.unique(held.column("leaf").to_numpy(), return_inverse=True)
            vectors = _matrix(held.column("vector"))
            asked = asked.take(pc.sort_indices(pc.list_element(asked.column("leaves").combine_chunks(), 0)))
            own = asked.column("label").to_numpy()
            everyone = [(np.arange(len(own)), np.arange(len(ids)))]
            meet = ((np.flatnonzero(own == m), np.flatnonzero(labels == m)) for m in np.intersect1d(own, labels)) if same else everyone
            for queries, rows in meet:
                step = max(1, SCORED_AT_ONCE // len(rows))
                for start in range(0, len(queries), step):
                    part = asked.take(pa.array(queries[start : start + step]))
                    comes = _visits(part, leaves)
                    at = rows[comes.any(0)[leaf[rows]]]
                    if not len(at):
                        continue
                    anchors = part.column("anchor_id").to_numpy()
                    scores = _products(_matrix(part.column("vector")), vectors[at])
                    fits = comes[:, leaf[at]] & (ids[at] != anchors[:, None])
                    if not same:
                        fits &= labels[at] != part.column("label").to_numpy()[:, None]
                    windows = [part.column(c).to_pylist() for c in ("keys", "lows", "highs")]
                    for row, key, column, score in _best_of_windows(scores, fits, *windows, k):
                        out.append((anchors[row], key, ids[at[column]], score))
        columns = [np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in range(4)]
        return pa.table(dict(zip(["anchor_id", "key", "vec_id", "score"], columns, strict=True)))

    return run


def _best_in_leaves(index: Index, routes: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best per window and group among the leaves it is sent to. ``routes`` has
    the shard and, in it, ``leaves``."""
    if same:
        routes = routes.join(index.labels, ["shard", "label"], "left_semi")
    slices = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    asked = routes.groupBy("shard").agg(F.count(F.lit(1)).alias("asked"))
    shapes = index.sizes.join(asked, "shard").select(
        "shard", slices("n", SLICE_ROWS).alias("rows"), slices("asked", SLICE_QUERIES).alias("visits")
    )
    shapes = F.broadcast(shapes)  # at most a row per leaf, and leaves come from the sample
    slot = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.rows.join(shapes, "shard").withColumn("row_slice", slot("vec_id", "rows")).withColumn("visit_slice", every("visits"))
    come = routes.join(shapes, "shard").withColumn("visit_slice", slot("anchor_id", "visits")).withColumn("row_slice", every("rows"))
    group = ["shard", "row_slice", "visit_slice"]
    held = held.select(*group, "vec_id", "label", "vector", "leaf")
    come = come.select(*group, "anchor_id", "label", "vector", "keys", "lows", "highs", "leaves")
    return held.groupBy(*group).cogroup(come.groupBy(*group)).applyInArrow(_search_group(k, same), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_windows(index: Index, anchors: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor_id, key, vec_id, score, rank``: of each window the k best of other ids
    with the anchor's label (``same``) or another one. ``anchors`` holds vec_id, label
    and vector, ``windows`` anchor_id, key, low and high; both stored tables."""

    def packed(held: DataFrame) -> DataFrame:
        each = held.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("key", "low", "high"))).alias("w"))
        arrays = [F.col(f"w.{c}").alias(f"{c}s") for c in ("key", "low", "high")]
        own = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "vector")
        return own.join(each.select("anchor_id", *arrays), "anchor_id")

    # Few and small rows that are much work: Spark would put them into one task.
    spread = lambda held: held.repartition(math.ceil(anchors.count() / ROUTED_TOGETHER) or 1, "anchor_id")
    queries = stage(spread(packed(windows)).mapInArrow(_choose_first(index.tree), QUERY), "queries")
    routes = _with_shard(queries.select("*", F.explode("first").alias("leaf")), index.places)
    first = stage(_best_in_leaves(index, routes.withColumn("leaves", F.array("leaf")), k, same), "found")
    bound = _ranked(first, k).where(F.col("rank") == k).select("anchor_id", "key", F.col("score").alias("bound"))
    narrowed = windows.join(bound, ["anchor_id", "key"], "left").withColumn("low", F.greatest("low", "bound"))
    queries = spread(packed(narrowed).join(queries.select("anchor_id", "first"), "anchor_id"))
    routes = stage(queries.mapInArrow(_route_rest(index.tree, index.shards), ROUTE), "routes")
    return _ranked(first.unionByName(_best_in_leaves(index, routes, k, same)), k)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has vec_id, label and embedding; ``anchors`` is a condition on vec_id.
    A negative's score lies between ``low`` and ``high`` percent of the positive's.
    """
    index = build_index(stage(whole_vectors(vectors), "whole"), leaf_rows)
    chosen = stage(index.rows.where(anchors).select("vec_id", "label", "vector"), "anchors")
    bounds = {"low": LEAST, "high": MOST}
    every = chosen.select(
        F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("key"), *[F.lit(v).cast("bigint").alias(c) for c, v in bounds.items()]
    )
    positives = stage(search_windows(index, chosen, every, n_positives, same=True), "positives")
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    floor = lambda percent: F.expr(f"({percent} * positive_score - pmod({percent} * positive_score, 100)) div 100")
    windows = positives.select("anchor_id", F.col("positive_id").alias("key"), (-floor(-low)).alias("low"), floor(high).alias("high"))
    windows = windows.where("low <= high")
    found = search_windows(index, chosen, windows, n_negatives, same=False)
    found = found.select(
        "anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return found.join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
