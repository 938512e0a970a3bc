"""Reversible incremental line dedup: sharded cuckoo filters over exact reference tables.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case, hashed to 128 bits. Three tables make the state, all split into
shards by the hash:

* ``refs``: which document holds which key, exactly;
* ``counts``: documents per key and the largest document id holding it;
* ``filters``: per shard a cuckoo filter of the keys that are frequent now.

Documents are inserted by adding references and deleted by removing them. Only
the keys concerned are counted again, and a key that crosses the threshold enters
or leaves its shard's filter, so any insertion can be undone. To clean documents
their keys meet the filter of their shard first; only what it lets through is
looked up in the exact table, so a false positive never drops a line.

Heavy shards are cut into groups of bounded size, counting is combined before it
is shuffled, and texts are moved once, to meet the list of their dropped keys.

Defined results: a null or empty text is one empty line; rows of one doc_id are one
document; rows without a doc_id are not counted and stay as they are. A document
whose lines all go keeps an empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.workspace import stage

MIN_LENGTH = 40
MIN_DOCS = 5
N_SHARDS = 64
GROUP_ROWS = 200_000
SLOTS = 4
MAX_KICKS = 500
LOAD = 0.5
KEY_BYTES = 16


def line_key(line: bytes, min_length: int = MIN_LENGTH) -> bytes | None:
    """The hashed key of a line, or None when it is shorter than ``min_length``."""
    key = line.strip().lower()  # bytes: ASCII white space and A-Z only
    if len(key) < min_length or (len(key) < 4 * min_length and len(key.decode("utf-8", "replace")) < min_length):
        return None
    return hashlib.blake2b(key, digest_size=KEY_BYTES).digest()


# --- cuckoo filter ---------------------------------------------------------


class CuckooFilter:
    """A set of hashed keys with deletion: 16-bit fingerprints in buckets of four."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = len(table) - 1

    @staticmethod
    def sized_for(n_keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * LOAD)))))
        return CuckooFilter(np.zeros((buckets, SLOTS), "<u2"))

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        return CuckooFilter(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets of keys, an array of KEY_BYTES each."""
        halves = keys.view("<u8").reshape(-1, 2)
        prints = (halves[:, 1] % np.uint64(65535)).astype(np.int64) + 1
        first = ((halves[:, 1] >> np.uint64(32)) & np.uint64(self.mask)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, fingerprint):
        return bucket ^ ((fingerprint * 0x5BD1E995) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        found = (self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])
        return found.any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False when the filter is too full; its content is then undefined."""
        rng = np.random.default_rng(0)
        for fingerprint, *places in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in places:
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = fingerprint
                    break
            else:
                bucket = places[0]
                for _ in range(MAX_KICKS):
                    slot = int(rng.integers(SLOTS))
                    fingerprint, self.table[bucket, slot] = int(self.table[bucket, slot]), fingerprint
                    bucket = self._other(bucket, fingerprint)
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = fingerprint
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Remove keys that were inserted."""
        for fingerprint, *places in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in places:
                held = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def _key_array(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8)


def _built(keys) -> bytes:
    n = len(keys)
    while True:
        made = CuckooFilter.sized_for(n)
        if made.insert(_key_array(keys)):
            return made.to_bytes()
        n *= 2


# --- tables ----------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """``refs`` (shard, key, doc_id), ``counts`` (shard, key, n_docs, last_doc) and
    ``filters`` (shard, bits), each a written table. Methods give a new index and
    leave this one as it is."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    min_docs: int
    min_length: int
    n_shards: int

    def insert(self, docs: DataFrame) -> LineIndex:
        """With more documents; references that are there already count once."""
        new = line_refs(docs, self.min_length, self.n_shards).join(self.refs, ["key", "doc_id"], "left_anti")
        new = stage(new.select(self.refs.columns), "line-refs")
        refs = stage(self.refs.unionByName(new), "line-refs")
        return self._recounted(refs, new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of ``doc_ids`` (column doc_id)."""
        gone = doc_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
        removed = stage(self.refs.join(gone, "doc_id", "left_semi").select(self.refs.columns), "line-refs")
        refs = stage(self.refs.join(gone, "doc_id", "left_anti").select(self.refs.columns), "line-refs")
        return self._recounted(refs, removed)

    def _recounted(self, refs: DataFrame, changed: DataFrame) -> LineIndex:
        touched = stage(changed.select("shard", "key").distinct(), "line-keys")
        again = count_refs(refs.join(touched.select("key"), "key", "left_semi"))
        counts = stage(self.counts.join(touched.select("key"), "key", "left_anti").unionByName(again).select(self.counts.columns), "line-counts")
        was, now = (
            c.where(F.col("n_docs") >= self.min_docs).select("key", F.lit(True).alias(name))
            for c, name in ((self.counts, "was"), (counts, "now"))
        )
        crossed = (
            touched.join(was, "key", "left")
            .join(now, "key", "left")
            .select("shard", "key", F.col("now").isNotNull().alias("enters"))
            .where(F.col("enters") != F.col("was").isNotNull())
        )
        updated = self.filters.groupBy("shard").cogroup(crossed.groupBy("shard"))
        updated = stage(updated.applyInPandas(_update_filter, "shard int, bits binary"), "line-filters")
        full = updated.where(F.col("bits").isNull()).select("shard")
        frequent = counts.where(F.col("n_docs") >= self.min_docs)
        remade = build_filters(frequent.join(F.broadcast(full), "shard", "left_semi"))
        filters = stage(updated.where(F.col("bits").isNotNull()).unionByName(remade), "line-filters")
        return replace(self, refs=refs, counts=counts, filters=filters)

    def repeated_lines(self, refs: DataFrame) -> DataFrame:
        """``doc_id, key`` of references to frequent keys that a larger document holds."""
        n_refs = refs.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        cuts = n_refs.select("shard", F.ceil(F.col("n") / F.lit(GROUP_ROWS)).cast("int").alias("cuts"))
        cuts = stage(cuts, "line-cuts")  # one row per shard
        asked = refs.join(F.broadcast(cuts), "shard").select(
            "shard", F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int").alias("cut"), "key", "doc_id"
        )
        held = self.filters.join(F.broadcast(cuts), "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "bits"
        )
        passed = (
            asked.groupBy("shard", "cut")
            .cogroup(held.groupBy("shard", "cut"))
            .applyInArrow(_let_through, "key binary, doc_id bigint")
        )
        exact = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "last_doc")
        return passed.join(exact, "key").where(F.col("doc_id") < F.col("last_doc")).select("doc_id", "key")

    def clean(self, docs: DataFrame, refs: DataFrame | None = None, name: str = "kept") -> DataFrame:
        """``docs`` and a column ``name``: struct(text, n_lines, n_dropped). A column of
        that name gives way to it; all others stay, whatever they are called.

        ``refs`` are the documents' own references, when they are at hand.
        """
        refs = line_refs(docs, self.min_length, self.n_shards) if refs is None else refs
        keys, owner, rewritten = (_free_name(docs, n) for n in ("dropped__", "dropped_id__", "rewritten__"))
        dropped = self.repeated_lines(refs).groupBy("doc_id").agg(F.collect_list("key").alias(keys))
        dropped = dropped.withColumnRenamed("doc_id", owner)
        joined = docs.join(dropped, docs["doc_id"] == dropped[owner], "left").drop(owner)
        return _rewritten(joined, self.min_length, name, keys, rewritten).drop(keys)


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {column.lower() for column in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _pairs(batches: Iterator[pa.RecordBatch], min_length: int, n_shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = {line_key(line, min_length) for line in text.as_py().split(b"\n")}
            found.discard(None)
            keys += found
            ids += [doc_id] * len(found)
        shards = _key_array(keys).reshape(-1, KEY_BYTES)[:, 0].astype(np.int32) % n_shards
        yield pa.record_batch(
            [pa.array(shards, pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())],
            ["shard", "key", "doc_id"],
        )


def line_refs(docs: DataFrame, min_length: int = MIN_LENGTH, n_shards: int = N_SHARDS) -> DataFrame:
    """``shard, key, doc_id``: the distinct keys of each document."""
    held = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("binary")
    )
    found = held.mapInArrow(lambda b: _pairs(b, min_length, n_shards), "shard int, key binary, doc_id bigint")
    return found.distinct()


def count_refs(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def build_filters(keys: DataFrame) -> DataFrame:
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": frame["shard"].iloc[:1].astype("int32"), "bits": [_built(list(frame["key"]))]})

    return keys.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, bits binary")


def _update_filter(held: pd.DataFrame, crossed: pd.DataFrame) -> pd.DataFrame:
    """The filter of one shard after its crossings; null bits when it must be remade."""
    shard = held["shard"].iloc[0] if len(held) else crossed["shard"].iloc[0]
    enters = crossed["enters"].to_numpy(bool)
    keys = crossed["key"].to_numpy(object)
    if len(held):
        table = CuckooFilter.from_bytes(held["bits"].iloc[0])
        table.delete(_key_array(keys[~enters]))
        fits = table.insert(_key_array(keys[enters]))
        bits = table.to_bytes() if fits else None
    else:
        bits = _built(list(keys[enters]))
    return pd.DataFrame({"shard": pd.Series([shard], dtype="int32"), "bits": [bits]})


def _let_through(asked: pa.Table, held: pa.Table) -> pa.Table:
    asked = asked.select(["key", "doc_id"])
    if not asked.num_rows or not held.num_rows:
        return asked.slice(0, 0)
    keys = _key_array(asked.column("key").to_pylist())
    found = CuckooFilter.from_bytes(held.column("bits")[0].as_py()).contains(keys)
    return asked.filter(pa.array(found))


def _rewritten(docs: DataFrame, min_length: int, name: str, dropped: str, rewritten: str) -> DataFrame:
    """Drop the lines of the keys in the column ``dropped``; a null list drops nothing.
    ``rewritten`` is a free name."""

    @F.pandas_udf("text string, n_dropped bigint")
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            kept, counts = [None] * len(texts), [0] * len(texts)
            for i, (text, keys) in enumerate(zip(texts, lists, strict=True)):
                if text is None:
                    continue
                gone = {bytes(k) for k in keys}
                lines = text.encode().split(b"\n")
                stay = [line for line in lines if line_key(line, min_length) not in gone]
                kept[i], counts[i] = b"\n".join(stay).decode(), len(lines) - len(stay)
            yield pd.DataFrame({"text": kept, "n_dropped": counts})

    text = F.coalesce("text", F.lit(""))
    some = F.col(dropped).isNotNull()
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    no_keys = F.array().cast("array<binary>")
    return (
        docs.withColumn(rewritten, rewrite(F.when(some, text), F.coalesce(dropped, no_keys)))
        .withColumn(
            name,
            F.struct(
                F.when(some, F.col(f"{rewritten}.text")).otherwise(text).alias("text"),
                n_lines.cast("bigint").alias("n_lines"),
                F.col(f"{rewritten}.n_dropped").alias("n_dropped"),
            ),
        )
        .drop(rewritten)
    )


def build_index(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, n_shards: int = N_SHARDS
) -> LineIndex:
    refs = stage(line_refs(docs, min_length, n_shards), "line-refs")
    counts = stage(count_refs(refs), "line-counts")
    filters = stage(build_filters(counts.where(F.col("n_docs") >= min_docs)), "line-filters")
    return LineIndex(refs, counts, filters, min_docs, min_length, n_shards)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, name: str = "kept") -> DataFrame:
    """``docs`` and a column ``name`` struct(text, n_lines, n_dropped): the text without
    lines that a larger document of the same corpus holds."""
    index = build_index(docs, min_docs, min_length)
    return index.clean(docs, index.refs, name)
