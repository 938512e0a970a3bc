"""Benchmark decontamination: shared n-grams as seeds, then Smith-Waterman alignment.

One scan finds the places where a document shares a word n-gram with any test
item. A bitmap of fixed size says which n-grams those may be, so what travels to
the tasks does not grow with the benchmark; the few false hits drop out in the
exact join that follows. Hits close to each other make a passage.

Seeds are rare n-grams. How many passages hold an n-gram decides: an item is cut
into stretches so short that any part of it that is a leak holds a whole one, and of
each stretch the ``SEEDS`` rarest n-grams that occur at all are its seeds, whatever
their count; those that share a word with a rarer seed come after all others. So an
excerpt that leaked into very many documents still has seeds, and an edited word
breaks only one of the separate seeds of a stretch, while the frequent n-grams of an
item bring no candidates; they only show where a candidate is to be aligned. A
passage and an item that share a seed are a candidate. Copies edited so much that no
seed of them is left are lost; the tests measure that.

A candidate goes on when enough words of the item stand close together in the
passage; this count is never less than the score, so no leak is lost by it. What is
left is aligned by words (Smith-Waterman: match 1, mismatch and gap -1), which scores
copies with replaced, missing or added words. It is a leak from ``MIN_SHARE`` of the
item on, or from ``MIN_SCORE`` on for long items.

Defined results: words are the letters and digits of the pieces between white
space, in lower case. Null and empty texts have none. Items of fewer words than a
seed are not searched. Rows of one doc_id are one document, and items of one
item_id are each aligned. Other columns are not read. Of n-grams equally rare the
one of the smaller hash is the seed. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.memos import remembered
from weftline.plans.sizing import broadcast_if_small
from weftline.sources.workspace import stage

GRAM = 3
BITMAP_BITS = 26
MARGIN = 64
MIN_SHARE = 0.5
MIN_SCORE = 30
SEEDS = 3
MEMO = 300_000
BROADCAST_IDS = 1_000_000  # 8 MB of ids
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- words -----------------------------------------------------------------


class _WordHashes(dict):
    """Hashes of tokens; 0 for a token without a letter or digit."""

    def __missing__(self, token: bytes) -> int:
        word = "".join(filter(str.isalnum, token.decode("utf-8", "replace").lower()))
        if len(self) >= MEMO:
            self.clear()
        self[token] = value = (xxhash.xxh64_intdigest(word.encode()) or 1) if word else 0
        return value


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """One hash per token, 0 where it holds no word."""
    known = remembered(_WordHashes, _WordHashes)
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def words_of(text: bytes | None) -> np.ndarray:
    found = word_hashes(tokens_of(text))
    return found[found != 0]


def grams_of(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - GRAM + 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(GRAM):
        mixed += words[i : n + i] * _PLACES[i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def _bit(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


# --- alignment -------------------------------------------------------------


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and the ends of both sides (exclusive)."""
    at = np.arange(len(passage))
    row = np.zeros(len(passage) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        started = np.maximum(row[:-1] + np.where(passage == word, 1, -1), row[1:] - 1)
        np.maximum(started, 0, out=started)
        row[1:] = np.maximum.accumulate(started + at) - at  # gaps in the item cost 1 each
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def align_span(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Score and the aligned span of the passage."""
    score, item_end, end = align(item, passage)
    if not score:
        return 0, 0, 0
    _, _, length = align(item[:item_end][::-1], passage[:end][::-1])
    return score, end - length, end


# --- the job ---------------------------------------------------------------


def stretch_length(n_words: int, min_share: float, min_score: int) -> int:
    """Places of n-grams in a stretch: a leak has at least this many words of the item
    less the edited ones, and twice the places of a stretch less one."""
    least = min(min_score, math.ceil(min_share * n_words))
    return max(1, (least - GRAM + 2) // 2)


def stretches(n_places: int, length: int) -> np.ndarray:
    """The stretch of each place: as few of even size as have at most ``length`` places."""
    n = -(-n_places // length)
    return np.arange(n_places) * n // max(1, n_places)


def _item_grams(items: DataFrame, min_share: float, min_score: int) -> DataFrame:
    """``gram, item, stretch, place`` of every item."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column(1)]
            found = [grams_of(w) for w in words]
            lengths = [stretch_length(len(w), min_share, min_score) for w in words]
            places = [stretches(len(g), n) for g, n in zip(found, lengths, strict=True)]
            keys = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(g) for g in found])
            values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            numbers = np.concatenate([*places, np.zeros(0, np.int64)])
            at = np.concatenate([*map(np.arange, map(len, found)), np.zeros(0, np.int64)])
            yield pa.record_batch([pa.array(c) for c in (values, keys, numbers, at)], ["gram", "item", "stretch", "place"])

    held = items.select("item", F.col("text").cast("binary").alias("text"))
    return held.mapInArrow(grams, "gram bigint, item bigint, stretch bigint, place bigint")


def _bitmap(grams: DataFrame) -> np.ndarray:
    """The fixed-size bitmap of all item n-grams, as packed bits; built in words of 64
    bits, so at most 2 ** (BITMAP_BITS - 6) rows are fetched."""
    bit = F.shiftrightunsigned("gram", 64 - BITMAP_BITS)
    marked = grams.withColumn("bit", bit).selectExpr(
        "shiftright(bit, 6) AS word", "shiftleft(1L, CAST(bit & 63 AS int)) AS mark"
    )
    at = marked.groupBy("word").agg(F.bit_or("mark").alias("marks")).toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 6), "<i8")
    words[at.column("word").to_numpy()] = at.column("marks").to_numpy()
    return words.view(np.uint8)


def rare_seeds(grams: DataFrame, hits: DataFrame, seeds: int) -> DataFrame:
    """``gram, item``: of each stretch the ``seeds`` n-grams in the fewest passages, of
    those that are in any; first such as share no word, then the next rarest. A
    stretch has at most MIN_SCORE / 2 n-grams."""
    counts = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("passages"))
    by_rarity = F.sort_array(F.collect_list(F.struct("passages", "gram", "place"))).alias("found")
    ranked = grams.join(counts, "gram").groupBy("item", "stretch").agg(by_rarity)
    apart = F.aggregate(
        "found",
        F.filter("found", lambda x: F.lit(False)),
        lambda kept, x: F.when(
            (F.size(kept) < seeds) & ~F.exists(kept, lambda y: F.abs(y["place"] - x["place"]) < GRAM),
            F.concat(kept, F.array(x)),
        ).otherwise(kept),
    )
    chosen = ranked.withColumn("apart", apart).withColumn("rest", F.array_except("found", "apart"))
    taken = F.slice(F.concat("apart", "rest"), 1, seeds)
    return chosen.select("item", F.explode(taken).alias("seed")).select("seed.gram", "item").distinct()


def find_passages(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """``doc_id, first_word, text, hits``: passages that may share n-grams with items.

    ``hits`` are the different n-grams that may be shared."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = tokens_of(text.as_py())
                codes = word_hashes(tokens)
                places = np.flatnonzero(codes)
                grams = grams_of(codes[places])
                at = _bit(grams)
                hits = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if not len(hits):
                    continue
                for group in np.split(hits, np.flatnonzero(np.diff(hits) > 2 * MARGIN) + 1):
                    first, end = max(0, group[0] - MARGIN), min(len(places), group[-1] + GRAM + MARGIN)
                    start, stop = places[first], places[end - 1] + 1
                    rows.append((doc_id, int(start), b" ".join(tokens[start:stop]).decode(), np.unique(grams[group]).view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.record_batch(arrays, ["doc_id", "first_word", "text", "hits"])

    schema = "doc_id bigint, first_word bigint, text string, hits array<bigint>"
    return docs.mapInArrow(scan, schema)


def most_words(item: np.ndarray, passage: np.ndarray) -> int:
    """No local alignment scores more: the most words of the item within any stretch
    of the passage as long as an alignment of positive score can be."""
    counts = np.concatenate([[0], np.cumsum(np.isin(passage, item))])
    width = min(2 * len(item), len(passage))
    return min(len(item), int((counts[width:] - counts[: len(counts) - width]).max()))


def _aligned(pairs: DataFrame, min_share: float, min_score: int) -> DataFrame:
    """The leaks among (passage, item): each pair aligned around all n-grams it shares,
    rare or not, stretches far apart each alone."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, first_word, text, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = word_hashes(text.encode().split())
                at = np.flatnonzero(codes)
                words, wanted = codes[at], words_of(item.encode())
                shared, reach = np.flatnonzero(np.isin(grams_of(words), grams_of(wanted))), len(wanted) + MARGIN
                best = (0, 0, 0)
                for group in np.split(shared, np.flatnonzero(np.diff(shared) > 2 * reach) + 1):
                    low, high = max(0, group[0] - reach), group[-1] + reach
                    most = most_words(wanted, words[low:high])
                    if most <= best[0] or (most < min_score and most / len(wanted) < min_share):
                        continue
                    score, start, end = align_span(wanted, words[low:high])
                    if score > best[0]:
                        best = (score, int(at[low + start]), int(at[low + end - 1]) + 1)
                score, start, end = best
                if score >= min_score or score / len(wanted) >= min_share:
                    rows.append((doc_id, item_id, score, score / len(wanted), first_word + start, end - start))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "item_id", "score", "share", "first_word", "n_words"]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    schema = "doc_id bigint, item_id bigint, score bigint, share double, first_word bigint, n_words bigint"
    return pairs.mapInArrow(aligned, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_share: float = MIN_SHARE,
    min_score: int = MIN_SCORE,
    seeds: int = SEEDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, item_id, score, share, first_word, n_words`` of every leak, the best
    alignment of each document and item; places count pieces between white space."""
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("binary").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    items = stage(items.withColumn("item", F.monotonically_increasing_id()), "items")
    grams = stage(_item_grams(items, min_share, min_score), "item-grams")
    passages = find_passages(texts, _bitmap(grams)).withColumn("passage", F.monotonically_increasing_id())
    passages = stage(passages, "passages")
    hits = passages.select("passage", F.explode("hits").alias("gram"))

    rare = stage(rare_seeds(grams, hits, seeds), "seeds")
    candidates = hits.join(broadcast_if_small(rare), "gram").select("passage", "item").distinct()
    pairs = (
        candidates.join(passages.drop("hits"), "passage")
        .join(items.withColumnRenamed("text", "item_text"), "item")
        .select("doc_id", "first_word", "text", "item_id", "item_text")
    )
    aligned = _aligned(pairs, min_share, min_score)
    best = F.max(F.struct("score", "share", (-F.col("first_word")).alias("first_word"), "n_words")).alias("best")
    return aligned.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id",
        "item_id",
        "best.score",
        "best.share",
        (-F.col("best.first_word")).alias("first_word"),
        "best.n_words",
    )


def without_leaks(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold a leak. A document without a doc_id
    cannot be named by a leak and stays."""
    leaked = find_leaks(docs, items, **settings).select("doc_id").distinct()
    leaked = broadcast_if_small(stage(leaked, "leaked"), BROADCAST_IDS)
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)
