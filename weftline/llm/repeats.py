"""Repeated strings of 400 bytes, found by merging the Burrows-Wheeler transforms of shards.

The transforms are of parses, not of bytes (prefix-free parsing, Boucher et al. 2019):

* Parse: every 400-byte string holds its least 64-byte string by hash, the leftmost of
  equal ones, at a place that its bytes alone decide. These places are the samples of
  a text, about one in 169 bytes; a phrase reaches from one sample to the end of the
  next. A sample whose 64 bytes occur nowhere else lies in no repeated string and is
  dropped, so texts fall into runs of phrases.
* Shard transforms: a shard is the runs of some documents, dealt by hash, a bounded
  number of phrases. It sorts its own suffixes once and keeps, in that order, the step
  from each suffix to the one before it.
* Merge: suffixes of all shards that share h phrases are a block of the merged order:
  one interval in each shard. The interleave is refined step by step (Holt and McMillan
  2014): from an interval, h steps back through each shard's transform reach the
  suffixes one block earlier, which splits them by the block they are in; only names
  and sizes of intervals travel between shards, and a block of one suffix is not
  refined further. Suffixes are never sorted again. h doubles up to ``MAX_PHRASES``.
* Common prefixes and repeated intervals: a suffix in a block of h phrases has these
  phrases in common with another one; all 400-byte strings inside are repeated.
* Edges: what is left are strings that begin before the first shared sample or end
  behind the last. Around each sample they are judged by exact bytes in blocks of
  256, 64, 16, 4 and 1 start places: a block whose whole stretch is equal to another's
  is repeated, one whose core (the bytes that all its strings share) is unlike all
  others is not, the rest is divided. Equal stretches go on as one row.

Bytes are compared by 128-bit digests.

Defined results: texts are UTF-8, a null text is empty. Texts shorter than 400 bytes
lose nothing. Every row is a text of its own, whatever its id. Columns other than id
and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.workspace import fresh_path, stage

LENGTH = 400
TRIGGER = 64
MAX_PHRASES = 8
SHARD_PHRASES = 400_000
PIECE = 1 << 20

_POSITION = np.uint64((1 << 31) - 1)
_BASE = 0x9E3779B97F4A7C15 | 3  # odd; 3 modulo 8 keeps short strings of a pattern apart
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTES = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Sizes:
    """Length of the strings, length of a trigger, start places of the largest block."""

    length: int = LENGTH
    trigger: int = TRIGGER

    @property
    def places(self) -> int:
        """Triggers in one string."""
        return self.length - self.trigger + 1

    @property
    def root(self) -> int:
        size = 1
        while size * 4 <= self.places:
            size *= 4
        return size


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


# --- parse -----------------------------------------------------------------


class _Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    held: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.held[0]) < n:
            bases = (_BASE, pow(_BASE, -1, 1 << 64))
            cls.held = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in bases)
        return cls.held


def _trigger_hashes(data: np.ndarray, trigger: int) -> np.ndarray:
    """The hash of the ``trigger`` bytes at each place."""
    power, inverse = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * inverse[: len(data)], out=sums[1:])
    n = len(data) - trigger + 1
    found = (sums[trigger:] - sums[:n]) * power[:n]
    found ^= found >> np.uint64(32)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return found


def _least_places(hashes: np.ndarray, places: int) -> np.ndarray:
    """For each start the place of the least hash among the next ``places``."""
    least = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= places:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(hashes) - places + 1
    rest = places - width
    return (np.minimum(least[:n], least[rest : rest + n]) & _POSITION).astype(np.int64)


def _samples_of(joined: np.ndarray, bounds: list[tuple[int, int]], sizes: Sizes):
    """For each text of a buffer: places, first and last start, hashes of the samples."""
    chosen = np.zeros(len(joined) - sizes.length + 1, np.int64)
    hashes = np.zeros(len(joined) - sizes.trigger + 1, np.uint64)
    for start in range(0, len(chosen), PIECE):
        piece = joined[start : start + PIECE + sizes.length - 1]
        own = _trigger_hashes(piece, sizes.trigger)
        hashes[start : start + len(own)] = own
        chosen[start : start + PIECE] = _least_places(own, sizes.places) + start
    for start, end in bounds:
        mine = chosen[start : end - sizes.length + 1]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        last = np.r_[first[1:] - 1, len(mine) - 1]
        yield mine[first] - start, first, last, hashes[mine[first]]


def _buffers(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[tuple[int, bytes]]]:
    """Keys and texts of at least ``least`` bytes, some PIECE bytes at once."""
    held, n = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_py()
            if len(data) >= least:
                held.append((key, data))
                n += len(data)
                if n >= PIECE:
                    yield held
                    held, n = [], 0
    if held:
        yield held


SAMPLES = "key bigint, k int, place int, first int, last int, hash bigint, phrase binary"


def _parse(sizes: Sizes):
    names = [c.split()[0] for c in SAMPLES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _buffers(batches, sizes.length):
            ends = np.cumsum([len(data) for _, data in held])
            bounds = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
            joined = np.frombuffer(b"".join(data for _, data in held), np.uint8)
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            phrases: list[bytes | None] = []
            for (key, data), (places, first, last, hashes) in zip(held, _samples_of(joined, bounds, sizes), strict=True):
                n = len(places)
                parts = (np.full(n, key), np.arange(n, dtype=np.int32), places, first, last, hashes.view(np.int64))
                for column, part in zip(columns, parts, strict=True):
                    column.append(part)
                at = places.tolist()
                phrases += [_digest(data[a : b + sizes.trigger]) for a, b in zip(at[:-1], at[1:], strict=True)]
                phrases.append(None)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(np.concatenate(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.record_batch([*arrays, pa.array(phrases, pa.binary())], names)

    return run


# --- shard transforms ------------------------------------------------------
# A shard's state, in the order of its sorted suffixes: step (the suffix before, -1 at
# the front of a run), leap (h steps), block (of h phrases, -1: of one suffix only),
# depth (phrases known to be shared), and where each suffix begins.

SHARD = "shard int, block int, name binary, n bigint, state binary"
_FIELDS = ("step", "leap", "block", "depth", "key", "k")


def _packed(state: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({f: state[f] for f in _FIELDS})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return {f: table.column(f).to_numpy() for f in _FIELDS}


def suffix_order(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The order of the suffixes of runs of ``codes`` (0: end of a run), by doubling.
    ``following[i]`` is the next suffix of the run, or -1."""
    rank, ahead = codes.astype(np.int64), following.copy()
    while (ahead >= 0).any():
        second = np.where(ahead >= 0, rank[ahead] + 1, 0)
        _, refined = np.unique(rank * (len(rank) + 2) + second, return_inverse=True)
        if refined.max() == rank.max() and (refined == rank).all():
            break
        rank = refined
        ahead = np.where(ahead >= 0, ahead[ahead], -1)
    return np.argsort(rank, kind="stable")


def _block_rows(shard: int, blocks: np.ndarray, names: list[bytes], state: dict[str, np.ndarray]) -> pa.Table:
    """A row per interval with its name and size, then the state."""
    sizes = np.bincount(blocks[blocks >= 0], minlength=len(names))
    n = len(names) + 1
    return pa.table(
        {
            "shard": pa.array([shard] * n, pa.int32()),
            "block": pa.array([*range(len(names)), None], pa.int32()),
            "name": pa.array([*names, None], pa.binary()),
            "n": pa.array([*sizes.tolist(), None], pa.int64()),
            "state": pa.array([None] * len(names) + [_packed(state)], pa.binary()),
        }
    )


def _transform(table: pa.Table) -> pa.Table:
    """Sort the suffixes of a shard and give its blocks of one phrase."""
    shard = table.column("shard")[0].as_py()
    table = table.sort_by([("key", "ascending"), ("k", "ascending")])
    key, k = table.column("key").to_numpy(), table.column("k").to_numpy()
    next_to = np.zeros(len(k), bool)
    next_to[:-1] = (key[1:] == key[:-1]) & (k[1:] == k[:-1] + 1)
    phrases = table.column("phrase").combine_chunks().dictionary_encode()
    codes = np.zeros(len(k), np.int64)
    codes[next_to] = phrases.indices.to_numpy(zero_copy_only=False)[next_to].astype(np.int64) + 1
    following = np.where(next_to, np.arange(len(k)) + 1, -1)
    order = suffix_order(codes, following)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.full(len(order), -1)
    before[following[next_to]] = np.flatnonzero(next_to)
    before = before[order]
    step = np.where(before >= 0, place[before], -1).astype(np.int32)
    found, blocks = np.unique(codes[order], return_inverse=True)
    spelled = phrases.dictionary.to_pylist()
    names = [spelled[c - 1] for c in found.tolist() if c]
    blocks = (blocks - (len(found) - len(names))).astype(np.int32)
    state = {
        "step": step, "leap": step, "block": blocks, "depth": np.zeros(len(order), np.int8), "key": key[order], "k": k[order],
    }
    return _block_rows(shard, blocks, names, state)


def _refine(phrases: int, last: bool):
    """Keep the blocks of ``phrases`` phrases that are repeated anywhere; then step
    back that many phrases from each and split by the block reached."""

    def run(held: pa.Table, kept: pa.Table) -> pa.Table:
        shard = held.column("shard")[0].as_py()
        state = _unpacked(held.column("state")[0].as_py())
        alive, names = {}, []
        for block, name in zip(kept.column("block").to_pylist(), kept.column("name").to_pylist(), strict=True):
            alive[block] = len(names)
            names.append(name)
        old = state["block"]
        renumbered = np.full(int(old.max(initial=-1)) + 2, -1, np.int32)
        renumbered[list(alive)] = list(alive.values())
        block = renumbered[old]  # -1 reaches the last entry, which stays -1
        state["depth"] = np.where(block >= 0, phrases, state["depth"]).astype(np.int8)
        leap = state["leap"]
        at = np.flatnonzero((block >= 0) & (leap >= 0))
        at = at[block[leap[at]] >= 0]
        if last or not len(at):
            state["block"] = np.full(len(old), -1, np.int32)
            return _block_rows(shard, state["block"], [], state)
        earlier = leap[at]
        pairs, split = np.unique(block[earlier].astype(np.int64) * len(names) + block[at], return_inverse=True)
        joined = [_digest(names[a] + names[b]) for a, b in zip(*(x.tolist() for x in divmod(pairs, len(names))), strict=True)]
        state["block"] = np.full(len(old), -1, np.int32)
        state["block"][earlier] = split
        state["leap"] = np.where(leap >= 0, leap[leap], -1).astype(np.int32)
        return _block_rows(shard, state["block"], joined, state)

    def guarded(held: pa.Table, kept: pa.Table) -> pa.Table:
        return run(held, kept) if held.num_rows else _block_rows(0, np.zeros(0, np.int32), [], _EMPTY).slice(1)

    return guarded


_EMPTY = {f: np.zeros(0, np.int64) for f in _FIELDS}


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            state = _unpacked(data.as_py())
            arrays = [pa.array(state["key"]), pa.array(state["k"]), pa.array(state["depth"].astype(np.int32))]
            yield pa.record_batch(arrays, ["key", "k", "depth"])


def shared_phrases(samples: DataFrame, n_samples: int, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """``key, k, depth``: of each sample how many phrases from it on (0, 1, 2, 4, ...)
    are known to occur elsewhere."""
    n_shards = n_samples // shard_phrases + 1
    dealt = samples.select(F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int").alias("shard"), "key", "k", "phrase")
    table = stage(dealt.groupBy("shard").applyInArrow(_transform, SHARD), "shards")
    phrases = 1
    while phrases <= MAX_PHRASES:
        blocks, states = table.where("state IS NULL"), table.where("state IS NOT NULL")
        repeated = blocks.groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
        kept = blocks.join(repeated, "name", "left_semi")
        kept = kept.select(*[F.col(c).alias(c) for c in ("shard", "block", "name")])  # both sides are one table
        refined = states.select("shard", "state").groupBy("shard").cogroup(kept.groupBy("shard"))
        table = stage(refined.applyInArrow(_refine(phrases, phrases == MAX_PHRASES), SHARD), "shards")
        phrases *= 2
    return table.where("state IS NOT NULL").select("state").mapInArrow(_depths, "key bigint, k int, depth int")


# --- edges -----------------------------------------------------------------
# A start place is named by its distance to its sample. A block is a range of
# distances [low, low + size); a row covers [near, far] of it, those of its own.


def _ranges(places: list[int], ks: list[int], depths: list[int], sizes: Sizes) -> list[tuple[int, int]]:
    """First and last start of the strings inside shared phrases, joined."""
    out: list[tuple[int, int]] = []
    at = {k: p for k, p in zip(ks, places, strict=True)}
    for k, p, d in zip(ks, places, depths, strict=True):
        last = at[k + d] + sizes.trigger - sizes.length if d else -1
        if last >= p:
            if out and p <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(out[-1][1], last))
            else:
                out.append((p, last))
    return out


EDGES = "key bigint, place int, low int, near int, far int, open boolean, whole binary, core binary, start int, end int"


def _stretches(sizes: Sizes):
    """Ranges that are decided (start, end) and a row per sample and block."""
    names = [c.split()[0] for c in EDGES.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, samples in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "samples")), strict=True):
                ks, places, firsts, lasts, depths = ([s[f] for s in samples] for f in ("k", "place", "first", "last", "depth"))
                sure = _ranges(places, ks, depths, sizes)
                rows += [(key, None, None, None, None, None, None, None, a, b) for a, b in sure]
                n = 0
                for p, first, last in zip(places, firsts, lasts, strict=True):
                    while n < len(sure) and sure[n][1] < first:
                        n += 1
                    for low in range((p - last) // sizes.root * sizes.root, p - first + 1, sizes.root):
                        near, far = max(low, p - last), min(low + sizes.root - 1, p - first)
                        decided = n < len(sure) and sure[n][0] <= p - far and p - near <= sure[n][1]
                        whole = text[p - far : p - near + sizes.length]
                        core = text[p - low : p - low - sizes.root + 1 + sizes.length]
                        head = b"%d %d %d " % (low, near, far)
                        rows.append((key, p, low, near, far, not decided, _digest(head + whole), _digest(b"%d " % low + core), None, None))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def _cut_out(sizes: Sizes):
    """The bytes of the rows that go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("key", "place", "low", "near", "far", "open", "stretch")}
            for key, text, rows in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "rows")), strict=True):
                for row in rows:
                    out["key"].append(key)
                    for c in ("place", "low", "near", "far", "open"):
                        out[c].append(row[c])
                    out["stretch"].append(text[row["place"] - row["far"] : row["place"] - row["near"] + sizes.length])
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.bool_(), pa.binary()]
            yield pa.record_batch([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _with_texts(texts: DataFrame, per_document: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with a list per document. Texts lie in buckets of the key and are not
    moved; the lists of a bucket are hashed, as long as the bucket's own documents."""
    return texts.join(per_document.hint("shuffle_hash"), "key", how)


def _bucketed(texts: DataFrame) -> DataFrame:
    """Store the texts in buckets of their key, as many as a shuffle has partitions."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "texts")
    name = f"texts_{path.rpartition('-')[2]}"
    dealt = texts.repartition(n, "key").write.bucketBy(n, "key")
    dealt.format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)


def _decided(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Ranges of starts of the open rows whose stretch occurs more than once."""
    more = classes.where("n > 1").select("whole")
    found = rows.where("open").join(more, "whole", "left_semi")
    return found.select("key", (F.col("place") - F.col("far")).alias("start"), (F.col("place") - F.col("near")).alias("end"))


def _undecided(classes: DataFrame) -> DataFrame:
    """One row per different stretch, where an open one shares its core with others."""
    cores = classes.groupBy("core").agg(F.count(F.lit(1)).alias("stretches"), F.bool_or("open").alias("any_open"))
    return classes.join(cores.where("stretches > 1 AND any_open").select("core"), "core", "left_semi")


def _divided(rows: DataFrame, size: int, length: int) -> DataFrame:
    """The parts of size ``size`` of each row, with digests of stretch and core."""
    low = F.explode(F.expr(f"sequence(low, low + {3 * size}, {size})"))
    parts = rows.withColumnRenamed("near", "near_").withColumnRenamed("far", "far_")
    parts = parts.select("key", "place", "open", "stretch", "near_", "far_", low.alias("low"))
    parts = parts.withColumn("near", F.greatest("near_", "low")).withColumn("far", F.least("far_", F.col("low") + (size - 1)))
    parts = parts.where("near <= far")
    stretch = F.substring("stretch", F.col("far_") - F.col("far") + 1, F.col("far") - F.col("near") + length)
    parts = parts.withColumn("stretch", stretch).drop("near_", "far_")
    core = F.substring("stretch", F.col("far") - F.col("low") + 1, F.lit(length - size + 1))
    named = lambda data, *marks: F.unhex(F.md5(F.concat(*[F.concat_ws(" ", *marks).cast("binary"), data])))
    return parts.withColumns({"whole": named(F.col("stretch"), "low", "near", "far"), "core": named(core, "low")})


def _judge_edges(texts: DataFrame, edges: DataFrame, sizes: Sizes) -> list[DataFrame]:
    """Tables of decided ranges (key, start, end)."""
    kept = ["key", "place", "low", "near", "far"]
    rows = edges.where("start IS NULL")
    first = [F.min_by(F.struct(*kept), F.struct("key", "place")).alias("row")]
    open_ = (F.bool_or("open") & (F.count(F.lit(1)) == 1)).alias("open")
    classes = stage(rows.groupBy("whole", "core").agg(F.count(F.lit(1)).alias("n"), open_, *first), "classes")
    found = [_decided(rows, classes)]
    going = _undecided(classes).select("row.*", "open")
    listed = going.groupBy("key").agg(F.collect_list(F.struct("place", "low", "near", "far", "open")).alias("rows"))
    schema = "key bigint, place int, low int, near int, far int, open boolean, stretch binary"
    rows = _with_texts(texts, listed).mapInArrow(_cut_out(sizes), schema)
    size = sizes.root
    while size > 1:
        size //= 4
        rows = stage(_divided(rows, size, sizes.length), "parts")
        first = F.min(F.struct("key", "place")).alias("row")
        classes = rows.groupBy("whole", "core").agg(F.count(F.lit(1)).alias("n"), open_, first)
        classes = stage(classes, "classes")  # without the bytes: they are written once, in the parts
        found.append(_decided(rows, classes))
        going = _undecided(classes).select("whole", "row.*", "open")
        rows = rows.drop("open").join(going, ["whole", "key", "place"])
    return found


# --- result ----------------------------------------------------------------


def joined_ranges(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The bytes of all strings that begin in the given ranges, as disjoint runs."""
    runs: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], last + length))
        else:
            runs.append((first, last + length))
    return runs


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def _removed(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                runs = joined_ranges([(s["start"], s["end"]) for s in starts or []], length)
                kept, at = [], 0
                for start, end in runs:
                    kept.append(text[at:start])
                    at = end
                data = b"".join([*kept, text[at:]])
                digest = hashlib.sha256(data).hexdigest()
                out.append((doc_id, len(text), len(text) - len(data), len(runs), digest, data if with_text else None))
            names = [c.split()[0] for c in RESULT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return run


def remove_repeats(
    docs: DataFrame,
    sizes: Sizes = Sizes(),
    id_column: str = "doc_id",
    text_column: str = "text",
    with_text: bool = False,
    shard_phrases: int = SHARD_PHRASES,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, ``kept``, the
    remaining bytes of each text without those of strings that also start elsewhere."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"))
    texts = _bucketed(texts.withColumn("key", F.monotonically_increasing_id()))
    samples = stage(texts.select("key", "text").mapInArrow(_parse(sizes), SAMPLES), "samples")
    again = samples.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    samples = stage(samples.join(again, "hash", "left_semi").drop("hash"), "repeated")
    depths = shared_phrases(samples, samples.count(), shard_phrases)
    known = samples.drop("phrase").join(depths, ["key", "k"])
    each = F.sort_array(F.collect_list(F.struct("k", "place", "first", "last", "depth")))
    listed = known.groupBy("key").agg(each.alias("samples"))
    edges = _with_texts(texts, listed).select("key", "text", "samples")
    edges = stage(edges.mapInArrow(_stretches(sizes), EDGES), "edges")
    found = edges.where("start IS NOT NULL").select("key", "start", "end")
    for more in _judge_edges(texts.select("key", "text"), edges, sizes):
        found = found.unionByName(more)
    starts = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("starts"))
    judged = _with_texts(texts, starts, "left")
    result = judged.select("doc_id", "text", "starts").mapInArrow(_removed(sizes.length, with_text), RESULT)
    return result if with_text else result.drop("kept")
