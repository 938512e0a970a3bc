"""Phrase collocations by SON partitioning (Savasere, Omiecinski and Navathe 1995).

The documents are dealt to ``SHARDS`` shards of about one size, whole partitions each.
A phrase with ``min_count`` occurrences in the corpus has its share of them,
``min_count / SHARDS``, in at least one shard. So

* mine: each shard finds all its phrases that reach this lowered support. A shard is
  as many tasks as it has partitions: a task counts the phrases of a block of words,
  the counts of a shard are added up by hash;
* unite: the locally frequent phrases whose shards together can reach ``min_count`` are
  the candidates. Their hashes set bits of maps of fixed size, two bits each. Phrases on
  the bits of others only mean that more is counted;
* count: where a candidate is locally frequent, its count in the shard stands since
  mining. Every other shard, where it has fewer occurrences than the lowered support,
  counts it now, and one task spells it. So a candidate has at most ``min_count`` rows
  and those of its speller, however many tasks there are.

While mining, phrases are told apart by 96 bits of two hashes. Both passes must see the
same rows in the same partitions: the counts of the second have to complete those of the
first to the sums of all shards. If they do not, the texts are written once and counted
from there.

Single words come first and are all counted. Then two rounds follow: pairs of words
that are frequent themselves, then phrases of three words and more whose pairs are
frequent in the whole corpus.

Scores are native: a phrase is cut in two, ``l`` and ``r`` count its parts, the score
is floor(1000 * a * n / (l * r)) in decimals of 38 digits, the lowest cut counts.

Defined results: A-Z in lower case; pieces end at ``.,;:!?`` and at line ends; words
are runs of other than space and tab. A null text is empty, a null language ``und``.
Repeated rows and rows without an id count like all others. Only text and language
are read, whatever the other columns are named. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.workspace import stage

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
PERCENT = 100  # of a phrase's occurrences, inside a longer one, that make it redundant
UNKNOWN = "und"
BLOCK_BYTES = 24_000_000  # of text a task holds at once
BATCH_ROWS = 1 << 16  # a task hands over at once
SHARDS = 8  # 62 at most are made
MAP_BITS = 1 << 25  # 4 MB

_BREAK = b"."
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_SPACED = bytes.maketrans(_PIECE_ENDS + b"\t", _BREAK * len(_PIECE_ENDS) + b" ")
_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]

COUNTS = "lang string, words int, phrase binary, hash bigint, n bigint"
MINED = "part int, hash bigint, check int, n bigint"
COUNTED = f"{COUNTS}, part int, check int"


def prepared(text: bytes | None) -> bytes:
    """Lower case, words set apart by spaces, a break after each piece."""
    return (text or b"").lower().translate(_SPACED).replace(_BREAK, b" . ")


def coded_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of prepared texts as codes, 0 for a break, and the word of each code."""
    joined = b" . ".join([b"", *texts, b""])
    offsets = pa.py_buffer(np.array([0, len(joined)], np.int64))
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, offsets, pa.py_buffer(joined)])
    words = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
    spelled = words.dictionary.cast(pa.large_binary()).to_pylist()
    order = np.arange(1, len(spelled) + 1)
    order[spelled.index(_BREAK)] = 0
    empty = spelled.index(b"") if b"" in spelled else -1
    numbers = words.indices.to_numpy()
    return order[numbers[numbers != empty]], [_BREAK, *spelled]


def _mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    found = (left ^ (left >> np.uint64(29))) * _ODD[0] + right * _ODD[1]
    found ^= found >> np.uint64(32)
    return found * _ODD[2]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Blocks of documents, by language, cut when they pass BLOCK_BYTES: language,
    codes and words."""
    held: dict[str, list[bytes]] = {}
    n = 0

    def coded():
        for lang in list(held):
            yield lang, *coded_words(held.pop(lang))
            pa.default_memory_pool().release_unused()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = prepared(text.as_py())
            held.setdefault(lang, []).append(data)
            n += len(data)
            if n >= BLOCK_BYTES:
                yield from coded()
                held, n = {}, 0
    yield from coded()


@dataclass
class _Level:
    """The kept phrases of one length in a block: at each position the number of the
    phrase that begins there (0: none kept; not filled for the longest), and of each
    phrase its two hashes, its count and how it is made: a phrase one word shorter and a
    word."""

    at: np.ndarray | None
    hashes: np.ndarray
    checks: np.ndarray
    counts: np.ndarray
    shorter: _Level | None
    head: np.ndarray
    tail: np.ndarray

    def spelled(self, words: list[bytes]) -> list[bytes]:
        tails = [words[c] for c in self.tail.tolist()]
        if self.shorter is None:
            return tails
        heads = self.shorter.spelled(words)
        return [heads[p] + b" " + w for p, w in zip(self.head.tolist(), tails, strict=True)]


def _numbered(numbers: np.ndarray, places: np.ndarray, size: int, keep: np.ndarray) -> np.ndarray:
    renumbered = np.zeros(len(keep), np.int64)
    renumbered[keep] = np.arange(1, int(keep.sum()) + 1)
    at = np.zeros(size, np.int64)
    at[places] = renumbered[numbers]
    return at


def _words_of(lang: str, codes: np.ndarray, words: list[bytes], allowed: np.ndarray | None):
    """Single words, and the two hashes of each code. The language is part of them."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    checks = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    counts = np.bincount(codes, minlength=len(words))
    counts[0] = 0
    keep = (counts > 0) if allowed is None else (counts > 0) & _in_map(allowed, hashes)
    found = np.flatnonzero(keep)
    at = _numbered(codes, np.arange(len(codes)), len(codes), keep)
    return _Level(at, hashes[found], checks[found], counts[found], None, found, found), hashes, checks


def _longer(level: _Level, codes: np.ndarray, hashes: np.ndarray, checks: np.ndarray, words: int, rule, last: bool) -> _Level:
    """Phrases one word longer whose two parts are both kept, as far as ``rule``
    (hashes, counts -> bool) keeps them."""
    starts = np.flatnonzero((level.at[:-1] > 0) & (level.at[1:] > 0)) if len(codes) > 1 else np.zeros(0, np.int64)
    n_codes = len(hashes)
    made = level.at[starts] * n_codes + codes[starts + words - 1]
    if last:
        found, counts = np.unique(made, return_counts=True)
    else:
        found, numbers, counts = np.unique(made, return_inverse=True, return_counts=True)
    head, tail = found // n_codes - 1, found % n_codes
    mixed = _mix(level.hashes[head], hashes[tail])
    keep = rule(mixed, counts)
    at = None if last else _numbered(numbers, starts, len(codes), keep)
    checked = _mix(level.checks[head[keep]], checks[tail[keep]])
    return _Level(at, mixed[keep], checked, counts[keep], level, head[keep], tail[keep])


def _in_map(bits: np.ndarray, hashes: np.ndarray, salt: int = 0) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for probe in (hashes, hashes >> np.uint64(32)):
        slot = (probe ^ np.uint64(salt)) & np.uint64(len(bits) * 64 - 1)
        found &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return found


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _short(checks: np.ndarray) -> pa.Array:
    return pa.array((checks >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _only(level: _Level, chosen: np.ndarray, counts: np.ndarray) -> _Level:
    return _Level(
        None, level.hashes[chosen], level.checks[chosen], counts[chosen], level.shorter, level.head[chosen], level.tail[chosen]
    )


def _rows(lang: str, words: list[bytes], length: int, level: _Level) -> pa.RecordBatch:
    n = len(level.counts)
    arrays = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, length, np.int32)), pa.array(level.spelled(words), pa.binary())]
    return pa.record_batch([*arrays, _signed(level.hashes), pa.array(level.counts)], ["lang", "words", "phrase", "hash", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, codes, words in _blocks(batches):
        yield _rows(lang, words, 1, _words_of(lang, codes, words, None)[0])


def _levels(lang, codes, words, words_map, pairs_map, lengths, rule):
    """(length, level) of the wanted lengths; ``pairs_map`` None: pairs follow the
    rule, else they are those in the map."""
    level, hashes, checks = _words_of(lang, codes, words, words_map)
    for length in range(2, max(lengths) + 1):
        own = rule if pairs_map is None or length > 2 else lambda h, _: _in_map(pairs_map, h)
        level = _longer(level, codes, hashes, checks, length, own, length == max(lengths))
        if not len(level.counts):
            return
        if length in lengths:
            yield length, level


def _mine(words_map: Broadcast, pairs_map: Broadcast | None, lengths: range):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pairs_map.value if pairs_map else None
        part = TaskContext.get().partitionId()
        rule = lambda hashes, _: np.ones(len(hashes), bool)
        for lang, codes, words in _blocks(batches):
            for _, level in _levels(lang, codes, words, words_map.value, pairs, lengths, rule):
                number = pa.array(np.full(len(level.counts), part, np.int32))
                arrays = [number, _signed(level.hashes), _short(level.checks), pa.array(level.counts)]
                mined = pa.record_batch(arrays, ["part", "hash", "check", "n"])
                yield from (mined.slice(at, BATCH_ROWS) for at in range(0, mined.num_rows, BATCH_ROWS))

    return run


def _count(shards: int, found: Broadcast, wanted: Broadcast, words_map: Broadcast, pairs_map: Broadcast | None, lengths: range):
    """Counts of the candidates that the shard has not counted yet, and a row with count
    0 of those that this task is to spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pairs_map.value if pairs_map else None
        part = TaskContext.get().partitionId()
        rule = lambda hashes, _: _in_map(found.value, hashes)
        for lang, codes, words in _blocks(batches):
            for length, level in _levels(lang, codes, words, words_map.value, pairs, lengths, rule):
                open_ = _in_map(wanted.value, level.hashes, part % shards)
                spelled = _in_map(wanted.value, level.hashes, shards + part)
                chosen = _only(level, open_ | spelled, np.where(open_, level.counts, 0))
                rows = _rows(lang, words, length, chosen)
                number = pa.array(np.full(len(chosen.counts), part, np.int32))
                yield pa.record_batch([*rows.columns, number, _short(chosen.checks)], [*rows.schema.names, "part", "check"])

    return run


# --- Spark -----------------------------------------------------------------


def hash_map(hashes: DataFrame, bits: int, salt: str = "0") -> Broadcast:
    """Two bits per hash, moved by the salt, in a map of fixed size, put together where
    the hashes are."""
    probes = F.expr(f"explode(array(hash ^ ({salt}), shiftrightunsigned(hash, 32) ^ ({salt})))")
    slots = hashes.select(probes.alias("probe")).select(F.col("probe").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    word = F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(word.alias("word")).toArrow()
    held = np.zeros(bits // 64, np.uint64)
    held[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(held)


def candidates(local: DataFrame, min_count: int, shards: int) -> DataFrame:
    """``hash, check, held, known, total, speller`` of phrases that are frequent in a
    shard and can be in the corpus: the shards where they are, as bits, their count
    there, that of all shards, and a partition that has the phrase."""
    support = -(-min_count // shards)
    shard = F.expr(f"pmod(part, {shards})").alias("shard")
    by_shard = local.repartition("hash").groupBy(shard, "hash", "check").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    frequent = F.col("n") >= support
    held = F.bit_or(F.when(frequent, F.expr("shiftleft(1L, shard)")).otherwise(F.lit(0))).alias("held")
    known = F.sum(F.when(frequent, F.col("n")).otherwise(F.lit(0))).alias("known")
    united = by_shard.groupBy("hash", "check").agg(held, known, F.sum("n").alias("total"), F.min("part").alias("speller"))
    return united.where((F.col("held") != 0) & (F.col("total") >= min_count))


def completed(counted: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """``lang, words, phrase, hash, n, total``: the counts from mining and those of the
    shards that were open."""
    each = counted.groupBy("lang", "words", "phrase", "hash", "check", F.expr(f"pmod(part, {shards})").alias("shard"))
    each = each.agg(F.sum("n").alias("n")).join(found, ["hash", "check"])
    is_open = F.expr("shiftright(held, shard) & 1") == 0
    n = F.sum(F.when(is_open, F.col("n")).otherwise(F.lit(0))) + F.first("known")
    return each.groupBy("lang", "words", "phrase", "hash", "check").agg(n.alias("n"), F.first("total").alias("total")).drop("check")


def _round(texts: DataFrame, words_map: Broadcast, pairs_map: Broadcast | None, lengths: range, min_count: int, shards: int, bits: int):
    """``lang, words, phrase, hash, n`` of the frequent phrases of some lengths, and
    whether both passes saw the same partitions."""
    local = texts.mapInArrow(_mine(words_map, pairs_map, lengths), MINED)
    found = stage(candidates(local, min_count, shards), "candidates")
    bits_found = hash_map(found, bits)
    is_open = f"filter(sequence(0, {shards - 1}), s -> (shiftright(held, s) & 1) = 0)"
    wanted = found.select("hash", F.expr(f"explode(concat({is_open}, array(speller + {shards})))").alias("place"))
    count = _count(shards, bits_found, hash_map(wanted, bits, "place"), words_map, pairs_map, lengths)
    exact = stage(completed(texts.mapInArrow(count, COUNTED), found, shards), f"phrases-{max(lengths)}")
    whole = exact.where("n = total").count()
    return exact.drop("total"), whole == exact.count() == found.count()


def frequent_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    shards: int = SHARDS,
    map_bits: int = MAP_BITS,
) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` (words of each language) and ``lang, words, phrase, n`` of all
    phrases of 1 to ``max_words`` words with at least ``min_count`` occurrences.
    ``docs`` has lang (not null) and text; it is read five times."""
    shards = min(shards, 62)
    texts = docs.select("lang", F.col("text").cast("binary").alias("text"))
    words = stage(texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "words", "phrase", "hash").agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= min_count)
    words_map, pairs_map = hash_map(frequent, map_bits), None
    for lengths in (range(2, 3), range(3, max_words + 1)):
        if not len(lengths) or max(lengths) > max_words:
            continue
        exact, agreed = _round(texts, words_map, pairs_map, lengths, min_count, shards, map_bits)
        if not agreed:  # partitions that are not the same twice
            texts = stage(texts, "texts")
            exact, agreed = _round(texts, words_map, pairs_map, lengths, min_count, shards, map_bits)
        if not agreed:
            raise RuntimeError("the two passes over the texts do not agree")
        frequent = frequent.unionByName(exact)
        pairs_map = hash_map(exact, map_bits)
    spelled = F.col("phrase").cast("string")
    return totals, frequent.select("lang", "words", spelled.alias("phrase"), "n")


def _part(first: Column | int, size: Column | int) -> Column:
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, first, size), " ")


def score_phrases(totals: DataFrame, frequent: DataFrame) -> DataFrame:
    """``lang, words, phrase, a, l, r, n, score`` of the phrases of two words and more:
    the lowest cut, the first of equal ones."""
    longer = frequent.where("words > 1").withColumnRenamed("n", "a")
    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("*", _part(F.lit(1), F.col("cut")).alias("head"), _part(F.col("cut") + 1, F.col("words")).alias("tail"))
    counts = frequent.select("lang", "phrase", "n")
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    wide = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.join(totals, "lang").withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"))
    cuts = cuts.withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "words", "a", "l", "r", "n")).alias("best"))
    return lowest.select("lang", "phrase", "best.*").drop("cut")


def without_parts(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Drop phrases of which some longer phrase holds at least ``percent`` of the
    occurrences; it need not be kept itself."""
    longer = scored.where("words > 2").select("lang", "words", "phrase", F.col("a").alias("a_longer"))
    sizes = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    parts = sizes.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    parts = parts.select("lang", _part(F.col("first"), F.col("size")).alias("phrase"), "a_longer")
    most = parts.groupBy("lang", "phrase").agg(F.max("a_longer").alias("most"))
    covered = F.coalesce(F.col("most") * 100 >= F.col("a") * percent, F.lit(False))
    return scored.join(most, ["lang", "phrase"], "left").where(~covered).drop("most")


def mine_phrases(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    percent: int = PERCENT,
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each
    language by score, then count, then phrase."""
    texts = docs.select(F.coalesce(F.col(lang_column), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).alias("text"))
    totals, frequent = frequent_phrases(texts, min_count, max_words)
    kept = without_parts(stage(score_phrases(totals, frequent), "scored"), percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
