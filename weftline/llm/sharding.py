"""Sharding by a histogram sort: shards of near equal bytes, equal texts together.

Documents are sorted by (hash of the text, doc_id). The splitters between shards
are found on a narrow table of keys and sizes: each round divides every interval
that still holds a splitter into up to ``2 ** PROBE_BITS`` parts, counts the
exact bytes of each part across all partitions, and keeps the part in which the
target falls, until the bytes below a boundary meet the tolerance. What reaches
the driver is bounded by shards times parts. A group of equal texts is cut only
where a boundary falls inside it; then the doc_id decides, so a group may hold
any share of the rows.

After that the documents are exchanged once, by pieces of a shard. A piece is a
range of the sort key, cut further by the hash of the doc_id when one text makes
it heavy. Slots are numbered per piece and continued over the pieces of a shard.

Defined results: a null text has no bytes and hashes like any other value; a null
doc_id sorts first; rows equal in both text and doc_id stay in one shard; with
fewer rows than shards some shards are empty; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.workspace import stage

PROBE_BITS = 10
KEY_BITS = 64
TOLERANCE = 0.0005  # of the mean shard, in bytes
ROW_OVERHEAD = 8
PIECES_PER_PARTITION = 8
HOT_PIECE = 4  # times the mean rows of a piece
MAX_LONG = (1 << 63) - 1
MIN_LONG = -(1 << 63)


@dataclass(frozen=True)
class Boundary:
    """The first key of a shard: rows from (hash, id) on belong to it or later ones."""

    hash: int
    id: int

    def reached(self, hash_: Column, id_: Column) -> Column:
        if self.hash > MAX_LONG:
            return F.lit(False)
        return (hash_ > self.hash) | ((hash_ == self.hash) & (id_ >= self.id))


@dataclass
class _Search:
    """One boundary and the interval it is sought in: ``below`` bytes lie under it,
    its keys share ``prefix``; ``hash`` is set once only ids are left to divide."""

    target: float
    below: int = 0
    prefix: int | None = None
    hash: int | None = None
    found: Boundary | None = None

    def edge(self, prefix: int, shift: int) -> Boundary:
        value = prefix << shift
        if self.hash is None:
            return Boundary(value, MIN_LONG)
        return Boundary(self.hash, value) if value <= MAX_LONG else Boundary(self.hash + 1, MIN_LONG)

    def narrow(self, parts: list[tuple[int, int, int]], shift: int, allowed: float, last: bool) -> None:
        """Settle at an edge of ``parts`` (prefix, bytes, rows), or go into one of them."""
        below = self.below
        for prefix, size, n_rows in parts:
            under, over = self.target - below, below + size - self.target
            if over >= 0:
                if min(under, over) <= allowed or n_rows == 1 or last:
                    self.found = self.edge(prefix if under <= over else prefix + 1, shift)
                else:
                    self.below, self.prefix = below, prefix
                return
            below += size
        self.found = Boundary(MAX_LONG + 1, MIN_LONG)


def find_boundaries(keys: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[Boundary]:
    """Boundaries between ``n_shards`` shards of ``keys`` (key_hash, key_id, size)."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / n_shards
    searches = [_Search(total * i / n_shards) for i in range(1, n_shards)]
    shifts = [*range(KEY_BITS - PROBE_BITS, 0, -PROBE_BITS), 0]
    for by_id in (False, True):
        digits = F.col("key_id") if by_id else F.col("key_hash")
        previous = None
        for shift in shifts:
            open_ = [s for s in searches if s.found is None]
            if not open_:
                break
            wanted = F.lit(False)
            for hash_, prefix in {(s.hash, s.prefix) for s in open_}:
                inside = F.lit(True)
                if by_id:
                    inside = inside & (F.col("key_hash") == hash_)
                if prefix is not None:
                    inside = inside & (F.shiftright(digits, previous) == prefix)
                wanted = wanted | inside
            group = F.col("key_hash") if by_id else F.lit(None).cast("bigint")
            counted = (
                keys.where(wanted)
                .groupBy(group.alias("hash"), F.shiftright(digits, shift).alias("part"))
                .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
            )
            parts = defaultdict(list)
            for row in counted.collect():  # at most shards x 2 ** PROBE_BITS rows
                above = None if previous is None else row["part"] >> (previous - shift)
                parts[row["hash"], above].append((row["part"], row["size"], row["n_rows"]))
            last = by_id and shift == 0
            for s in open_:
                s.narrow(sorted(parts[s.hash, s.prefix]), shift, allowed, last)
            previous = shift
        for s in searches:  # one hash value is left: divide its ids
            if not by_id and s.found is None:
                s.hash, s.prefix = s.prefix, None
    return [s.found for s in searches]


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    tolerance: float = TOLERANCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, text, size, shard, slot`` of every document. Slots are gapless."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint") + ROW_OVERHEAD
    keyed = docs.select(
        F.col(id_column),
        F.col(text_column),
        F.xxhash64(text_column).alias("key_hash"),
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(MIN_LONG)).alias("key_id"),
        size.alias("size"),
    )
    keys = stage(keyed.select("key_hash", "key_id", "size"), "shard-keys")
    hash_, id_ = F.col("key_hash"), F.col("key_id")
    shard = F.lit(0)
    for boundary in find_boundaries(keys, n_shards, tolerance):
        shard = shard + boundary.reached(hash_, id_).cast("int")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece_bits = max(1, math.ceil(math.log2(partitions * PIECES_PER_PARTITION)))
    piece = F.shiftright(hash_, KEY_BITS - piece_bits)

    def in_pieces(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", shard).withColumn("piece", piece)

    # heavy pieces are few: there are at most 1 / HOT_PIECE as many as pieces
    limit = max(1, HOT_PIECE * keys.count() >> piece_bits)
    heavy = (
        in_pieces(keys)
        .groupBy("shard", "piece")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select("shard", "piece", F.ceil(F.col("n") / F.lit(limit)).alias("cuts"))
    )
    heavy = stage(heavy, "shard-heavy")

    def in_cuts(df: DataFrame) -> DataFrame:
        cut = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("key_id"), F.col("cuts")))
        return in_pieces(df).join(F.broadcast(heavy), ["shard", "piece"], "left").withColumn("cut", cut.cast("int")).drop("cuts")

    place = ["shard", "piece", "cut"]
    counts = in_cuts(keys).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("piece", "cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*place, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    offsets = stage(offsets, "shard-offsets")

    number = F.row_number().over(Window.partitionBy(*place).orderBy("key_hash", "key_id"))
    numbered = in_cuts(keyed).withColumn("number", number)
    return numbered.join(offsets, place).select(
        id_column,
        text_column,
        "size",
        "shard",
        (F.col("offset") + F.col("number") - 1).alias("slot"),
    )
