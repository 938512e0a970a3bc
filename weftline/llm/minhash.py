"""Near-duplicate groups by a signature-coordinate inverted join.

Documents with equal shingle sets form a class; one row stands for it. A class is
posted under each (coordinate, value) pair of its MinHash signature. Two sets of
the wanted similarity agree in at least ``m`` of the coordinates (but for one pair
in a million), so:

* prefix: with the postings of every row in one order, rare ones first, such rows
  share one of their first ``K - m + 1``. Postings that nobody shares fill the
  prefix of an ordinary document, which then meets no list at all;
* skip: in a list, a row whose group is the other's already is passed over, and
  so is one whose size or sketch rules the similarity out;
* count: what is left counts its collisions over all coordinates and is kept from
  ``m`` on;
* every kept pair is confirmed on the full shingle sets.

Lists are merged without emitting their pairs. First each list's members meet one
of them (its hub), twice with other hubs, and confirmed links join groups. Then
lists that still hold several groups are compared in blocks of bounded size inside
the tasks, and only pairs of different groups that pass all tests leave them. The
sketch test is exact: bits that differ between two sets' bitmaps are at least that
many elements apart.

Groups are connected components, by label and pointer steps over written tables.

Defined results: words are runs of other than ASCII white space, A-Z in lower
case. Fewer words than a shingle make one shingle of them all. Null, empty and
blank texts have no shingle and are alone. Rows of one doc_id are one document;
a row without a doc_id is alone and kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.memos import remembered
from weftline.plans.sizing import broadcast_if_small
from weftline.sources.workspace import stage

SHINGLE = 5
COORDINATES = 64
PERCENT = 85
MISSED = 1e-6
SKETCH_BITS = 4096
BLOCK = 512
MEMO = 300_000
AT_ONCE = 2048
BROADCAST_IDS = 1_000_000  # 8 MB of ids
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(12).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(percent: int, n: int = COORDINATES, missed: float = MISSED) -> int:
    """The largest m that a pair at the similarity falls below with at most ``missed``."""
    p, below, m = percent / 100, 0.0, 0
    while m < n:
        below += math.comb(n, m) * p**m * (1 - p) ** (n - m)
        if below > missed:
            break
        m += 1
    return max(1, m)


# --- sets ------------------------------------------------------------------


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    words = (text or b"").lower().split()  # bytes: ASCII white space and A-Z only
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    known = remembered(_WordHashes, _WordHashes)
    codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    mixed = codes[:n] * _PLACES[0]
    for i in range(1, SHINGLE):
        mixed += codes[i : n + i] * _PLACES[i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[at : at + AT_ONCE, None] * _FACTORS).min(0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def sketch(found: np.ndarray) -> bytes:
    bits = np.zeros(SKETCH_BITS, bool)
    bits[(found % np.uint64(SKETCH_BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, classes, signatures = [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            sizes.append(len(found))
            some = len(found) > 0
            classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if some else None)
            signatures.append(signature(found).tobytes() if some else None)
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())]
        yield pa.record_batch(arrays, ["doc_id", "n_shingles", "class", "signature"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py()) for text in batch.column(1)]
        arrays = [
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([signature(s).tobytes() for s in sets], pa.binary()),
            pa.array([sketch(s) for s in sets], pa.binary()),
            pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
        ]
        yield pa.record_batch(arrays, ["rep", "n", "signature", "sketch", "shingles"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
        tokens = (values.astype(np.int64) + coordinate).ravel()
        reps = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), COORDINATES)
        yield pa.record_batch([pa.array(tokens), pa.array(reps)], ["token", "rep"])


def prefix_lists(reps: DataFrame, matches: int) -> DataFrame:
    """``token, rep``: the prefix of each row, without lists of one member."""
    postings = reps.select("rep", "signature").mapInArrow(_postings, "token bigint, rep bigint")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    row = Window.partitionBy("rep")
    ranked = (
        postings.join(shared, "token")
        .withColumn("place", F.row_number().over(row.orderBy("df", "token")))
        .withColumn("n", F.count(F.lit(1)).over(row))
    )
    # unshared postings come first, so this many shared ones are left in the prefix
    prefix = stage(ranked.where(F.col("place") <= F.col("n") - matches + 1).select("token", "rep"), "prefix")
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return prefix.join(lists, "token").select("token", "rep", "n")


# --- pairs -----------------------------------------------------------------


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), "<u8") for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b")
    possible = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return joined.where(possible).select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a bigint, b bigint")


def _similar_in_blocks(percent: int, matches: int):
    """Compare the two blocks of each group (token, i, j) of rows in that order."""

    def compare(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = lambda name: group.column(name).to_numpy()
        wide = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind).reshape(group.num_rows, -1)
        block, comp, n, rep = (column(c) for c in ("block", "comp", "n", "rep"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        values, bits = wide("signature", "<u4"), wide("sketch", "<u8")
        rows, others = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = []
        for x in rows:
            at = others[(comp[others] != comp[x]) & (rep[others] > rep[x] if i == j else rep[others] != rep[x])]
            at = at[100 * np.minimum(n[at], n[x]) >= percent * np.maximum(n[at], n[x])]
            at = at[(values[at] == values[x]).sum(1) >= matches]
            apart = np.bitwise_count(bits[at] ^ bits[x]).sum(1, dtype=np.int64)
            at = at[(100 + percent) * apart <= (100 - percent) * (n[at] + n[x])]
            if len(at):
                found.append(np.stack([np.minimum(rep[at], rep[x]), np.maximum(rep[at], rep[x])], 1))
        both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return both[:, 0], both[:, 1]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups; a group is at most two blocks long."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.stack([held.column(c).to_numpy() for c in ("token", "i", "j")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for start, end in zip(np.r_[0, cuts[:-1]], cuts, strict=False):
                yield held.slice(start, end - start)
            held = held.slice(cuts[-1]).combine_chunks() if len(cuts) else held
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights, n = [], [], 0
        for group in groups(batches):
            a, b = compare(group)
            lefts.append(a)
            rights.append(b)
            n += len(a)
            if n > 10_000:
                yield pa.record_batch([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], ["a", "b"])
                lefts, rights, n = [], [], 0
        if lefts:
            yield pa.record_batch([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], ["a", "b"])

    return run


def block_pairs(lists: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs of different groups that share a list and pass all tests but the last."""
    labelled = _with_group(lists, groups)
    open_ = labelled.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_ = open_.where("low <> high").select("token")
    n_blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = (
        labelled.join(open_, "token", "left_semi")
        .withColumn("blocks", n_blocks)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp")
    )
    held = sets.select("rep", "n", "signature", "sketch")
    grouped = rows.join(held, "rep").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = grouped.mapInArrow(_similar_in_blocks(percent, matches), "a bigint, b bigint")
    return found.distinct()


def _with_group(lists: DataFrame, groups: DataFrame) -> DataFrame:
    labels = groups.select(F.col("node").alias("rep"), F.col("comp").alias("found"))
    return lists.join(labels, "rep", "left").withColumn("comp", F.coalesce("found", "rep")).drop("found")


def hub_pairs(lists: DataFrame, groups: DataFrame, hub) -> DataFrame:
    """Each member of a list with the list's hub, unless they are of one group."""
    labelled = _with_group(lists, groups)
    hubs = labelled.groupBy("token").agg(hub("rep").alias("hub"), F.expr(f"{hub.__name__}_by(comp, rep)").alias("hub_comp"))
    met = labelled.join(hubs, "token").where("comp <> hub_comp")
    return met.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node, comp``: the smallest node that can be reached, for each node with a link.

    A step takes the least label of the neighbours, then the label of that label,
    so paths shorten by half; each step is a written table.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node"))
        near = near.agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        moved = stepped.join(jump, "near", "left").select("node", F.col("comp").alias("was"), F.least("near", "far").alias("comp"))
        moved = stage(moved, "labels")
        labels = moved.select("node", "comp")
        if moved.where("comp <> was").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    matches = match_threshold(percent)
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    schema = "doc_id bigint, n_shingles bigint, class binary, signature binary"
    found = stage(texts.mapInArrow(_summaries, schema), "signatures")
    named = found.where("doc_id IS NOT NULL AND class IS NOT NULL")
    reps = named.groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    reps = stage(reps, "classes")
    # rows of one doc_id are one document: its classes are linked by their common row
    own = named.groupBy("doc_id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    own = named.join(own, "doc_id", "left_semi").join(reps.select("class", "rep"), "class")
    own = own.select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).where("a <> b").distinct()

    lists = stage(prefix_lists(reps, matches), "lists")
    members = broadcast_if_small(lists.select(F.col("rep").alias("doc_id")).distinct(), BROADCAST_IDS)
    schema = "rep bigint, n bigint, signature binary, sketch binary, shingles binary"
    sets = stage(texts.join(members, "doc_id", "left_semi").mapInArrow(_full_sets, schema), "sets")
    links = stage(own, "links")
    groups = connected(links)
    for hub in (F.min, F.max):
        pairs = stage(hub_pairs(lists, groups, hub), "pairs")
        links = stage(links.unionByName(confirm_pairs(pairs, sets, percent)), "links")
        groups = connected(links)
    pairs = stage(block_pairs(lists, groups, sets, percent, matches), "pairs")
    links = links.unionByName(confirm_pairs(pairs, sets, percent))
    groups = connected(links)

    named = reps.select("class", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("class", F.coalesce("comp", "rep").alias("comp"))
    alone = F.col("doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", alone))
    return (
        found.select("doc_id", "n_shingles", "class")
        .join(named, "class", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
