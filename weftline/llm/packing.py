"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are cut into pieces of at most ``capacity`` tokens. A round matches
pieces with the gaps of open sequences:

* pieces are ranked once within their length, gaps in each round within their
  size, by a distributed sort over hashed order buckets;
* a sweep from the longest length down gives each length its successors, the
  smallest gaps that hold it. It works on the numbers per length and per gap size,
  two tables of at most ``capacity`` rows whatever the corpus;
* rank resolves conflicts: a gap takes one piece per round, the pieces of a
  length take the gaps of a size in the order of their ranks, and those beyond
  the last gap go to the next size or wait for the next round;
* gaps are updated and the next round begins. When no gap holds any piece, as many
  sequences are opened as the rest needs at least.

Every round writes its matches to the shared folder, which also cuts the lineage.

Defined results: a null text is empty and its document is the end token alone;
repeated rows are packed each; an empty table gives no sequence. Only the id and
the text are read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm.memos import remembered
from weftline.sources.workspace import stage

CAPACITY = 2048
END_TOKEN = 0
MEMO = 400_000
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe
CHARS_AT_ONCE = 4_000_000


# --- tokens ----------------------------------------------------------------


def _byte_symbols() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others in
    their order for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_SYMBOLS = _byte_symbols()


def _plain_letters(word: str) -> bool:
    """Whether normalising ``word`` is lower-casing it letter by letter, and leaves
    letters: not for decomposed forms, the sigma and letters that become marks."""
    return word.isalpha() and word.lower().isalpha() and "Σ" not in word and is_normalized("NFC", word)


class WordIds(dict):
    """Token ids of words as little-endian 32-bit numbers, remembered per word.

    The tokenizer drops white space and no token, normalisation or special string
    crosses it, so a text's ids are those of its words in order. Cuts are made at
    the blank and the line feed only. A word of letters with ``TAIL`` characters
    after it is its letters and its tail, two pre-tokens; letters are
    lower-cased, spelt as byte symbols and given to the merge model directly.

    Two generations of at most MEMO words are held: a full one becomes the old
    one, from which words in use move on to the next.
    """

    def __init__(self, tokenizer: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.merge = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}

    def texts(self, texts: list[str]) -> list[bytes]:
        known = self.__getitem__
        return [b"".join(map(known, t.replace("\n", " ").split(" "))) for t in texts]

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._encode(word)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def _encode(self, word: str) -> bytes:
        base = word.rstrip(TAIL)
        if not (base.isascii() and base.isalpha() or _plain_letters(base)):
            return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(base) < len(word):
            return self[base] + self[word[len(base) :]]
        lower = base.lower()
        if lower != base:
            return self[lower]
        if not base.isascii():
            base = base.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return self._packed([t.id for t in self.merge(base)])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def _word_ids(tokenizer: str) -> WordIds:
    return remembered((WordIds, hash(tokenizer)), lambda: WordIds(tokenizer))


def _groups(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of about CHARS_AT_ONCE characters."""
    start = n = 0
    for i, text in enumerate(texts):
        if n and n + len(text) > CHARS_AT_ONCE:
            yield ids[start:i], texts[start:i]
            start, n = i, 0
        n += len(text)
    if start < len(texts):
        yield ids[start:], texts[start:]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on demand, ``ids``."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text("utf-8"))
    end = np.array([END_TOKEN], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer.value)
        for batch in batches:
            for doc_ids, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in zip(doc_ids, words.texts(texts), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        held = ids[at : at + width]
                        rows.append((doc_id, piece, at // 4, len(held) // 4, zlib.crc32(held), held))
                columns = list(zip(*rows, strict=True))
                arrays = [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in columns[2:5]),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(h, "<u4").astype("i4") for h in columns[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    schema += ", ids array<int>" if keep_ids else ""
    held = docs.select(F.col(id_column).cast("bigint"), F.coalesce(text_column, F.lit("")))
    return held.mapInArrow(cut, schema)


# --- packing ---------------------------------------------------------------


def _ranked(df: DataFrame, size: str, key: str) -> DataFrame:
    """``df`` with a gapless ``rank`` from 0 within each ``size``, numbered per order
    bucket so that a size held by most rows is still many tasks."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    earlier = Window.partitionBy(size).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(size, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(size, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    number = F.row_number().over(Window.partitionBy(size, "bucket").orderBy(key))
    return (
        df.withColumn("rank", number)
        .join(offsets, [size, "bucket"])
        .withColumn("rank", F.col("rank") + F.col("before") - 1)
        .drop("bucket", "before")
    )


def _sweep(pieces: np.ndarray, used: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Match numbers per size; gives (length, first rank, last rank, gap, first gap rank).

    ``pieces`` and ``used`` (the ranks taken so far) are brought up to date; a gap
    is matched at most once.
    """
    free = np.flatnonzero(gaps).tolist()
    taken = np.zeros_like(gaps)
    matches = []
    for length in np.flatnonzero(pieces)[::-1].tolist():
        at = bisect_left(free, length)
        while pieces[length] and at < len(free):
            gap = free[at]
            n = int(min(pieces[length], gaps[gap] - taken[gap]))
            matches.append((length, int(used[length]), int(used[length]) + n - 1, gap, int(taken[gap])))
            pieces[length] -= n
            used[length] += n
            taken[gap] += n
            if taken[gap] == gaps[gap]:
                free.pop(at)
    return matches


def _match_table(matches: list[tuple[int, int, int, int, int]]) -> pa.Table:
    """The matches as Arrow columns: Spark takes them without a Python worker, which a
    list of rows needs on the executors beside those of the operators."""
    kinds = {"length": pa.int64(), "first": pa.int64(), "last": pa.int64(), "gap": pa.int32(), "gap_first": pa.int64()}
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*matches, strict=True), kinds.values(), strict=True)], list(kinds))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``key, sequence_id, offset`` of every row of ``pieces`` (key, length); keys are
    distinct and lengths go from 1 to ``capacity``."""
    spark = pieces.sparkSession
    items = stage(_ranked(pieces.select("key", "length"), "length", "key"), "pack-pieces")
    left, used = (np.zeros(capacity + 1, np.int64) for _ in range(2))
    for row in items.groupBy("length").count().collect():  # at most `capacity` rows
        left[row["length"]] = row["count"]
    sizes = np.arange(capacity + 1)
    gaps = np.zeros(capacity + 1, np.int64)
    open_ = None
    opened = 0
    rounds: list[DataFrame] = []
    while left.any():
        shortest = int(np.flatnonzero(left)[0])
        gaps[:shortest] = 0
        fresh = 0
        if not gaps[int(shortest) :].any():
            fresh = int(max(left[capacity // 2 + 1 :].sum(), -(-int((left * sizes).sum()) // capacity)))
            gaps[capacity] = fresh
            ranked = spark.range(opened, opened + fresh).select(
                F.col("id").alias("sequence_id"), F.lit(capacity).alias("gap"), (F.col("id") - opened).alias("rank")
            )
            opened += fresh
        else:
            ranked = _ranked(open_.where(F.col("gap") >= shortest), "gap", "sequence_id")
        matches = _sweep(left, used, gaps)
        plan = spark.createDataFrame(_match_table(matches))  # at most two rows per size
        chosen = (
            items.join(F.broadcast(plan), "length")
            .where(F.col("rank").between(F.col("first"), F.col("last")))
            .select("key", "length", "gap", (F.col("rank") - F.col("first") + F.col("gap_first")).alias("rank"))
        )
        matched = stage(ranked.join(chosen, ["gap", "rank"], "left").drop("rank"), "pack-round")
        rounds.append(
            matched.where("key IS NOT NULL").select("key", "sequence_id", (F.lit(capacity) - F.col("gap")).alias("offset"))
        )
        open_ = matched.select(
            "sequence_id", (F.col("gap") - F.coalesce("length", F.lit(0))).cast("int").alias("gap")
        ).where("gap > 0")
        after = gaps.copy()
        for length, first, last, gap, _ in matches:
            after[gap] -= last - first + 1
            after[gap - length] += last - first + 1
        gaps = after
        gaps[0] = 0
    if not rounds:
        return spark.createDataFrame([], "key bigint, sequence_id bigint, offset bigint")
    placed = rounds[0]
    for more in rounds[1:]:
        placed = placed.unionByName(more)
    return placed.select("key", "sequence_id", F.col("offset").cast("bigint").alias("offset"))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    cut = token_pieces(docs, tokenizer_path, capacity, False, id_column, text_column)
    pieces = stage(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces, capacity)
    return pieces.join(placed, "key").drop("key")


def fill_sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids, doc_starts``: the packed token sequences themselves.

    ``placed`` is the result of ``pack_documents`` for these documents, whose doc_ids
    must be distinct. A group holds one sequence, at most ``capacity`` tokens.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, keep_ids=True).select("doc_id", "piece", "ids")
    held = placed.join(pieces, ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (
        held.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("doc_starts"))
    )
