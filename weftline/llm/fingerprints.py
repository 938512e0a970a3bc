"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Each paragraph (a line of the text) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors modulo powers of two:

* four lanes modulo 2**64 from a 256-bit hash of the paragraph: equal multisets of
  paragraphs give equal sums whatever their order;
* ``LANES`` lanes modulo 2**32 that count the paragraph's word pairs with random
  signs: the difference of two sums shows how many pairs the documents do not share.
  A text of less than 2 GB has at most 2**30 pairs, so no count wraps.

Because it is a sum, paragraphs can be inserted and deleted without the rest of
the document: ``plus`` and ``minus``. The edited texts below are done that way.

The successor of a document is found by one range exchange on (doc_id, hash of
the text); each task walks its sorted rows and keeps only the previous one. The
two rows at the edges of each task are joined in a second, small step.

Defined results: a null text is empty; an empty text is one empty paragraph; a
null doc_id comes first; documents of equal doc_id follow the hash of their text;
a single document is its own successor. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.workspace import stage

LANES = 128
EXACT = 4
MEMO = 300_000
END = "\n"  # closes a paragraph; no word holds it


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode())
        return value


_hashes = _WordHashes()


class Vector:
    """A fingerprint as numbers; sums and differences are modular."""

    __slots__ = ("exact", "lanes")

    def __init__(self, exact: np.ndarray, lanes: np.ndarray) -> None:
        self.exact, self.lanes = exact, lanes

    def plus(self, other: Vector) -> Vector:
        return Vector(self.exact + other.exact, self.lanes + other.lanes)

    def minus(self, other: Vector) -> Vector:
        return Vector(self.exact - other.exact, self.lanes - other.lanes)

    def to_bytes(self) -> bytes:
        return self.exact.astype("<u8").tobytes() + self.lanes.astype("<u4").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Vector:
        return Vector(np.frombuffer(data, "<u8", EXACT), np.frombuffer(data, "<u4", LANES, 8 * EXACT))

    def likeness(self, other: Vector) -> float:
        """1 for equal fingerprints; else the share of word pairs in common, estimated."""
        if np.array_equal(self.exact, other.exact) and np.array_equal(self.lanes, other.lanes):
            return 1.0
        a, b = (v.lanes.view(np.int32).astype(np.float64) for v in (self, other))
        apart = (self.lanes - other.lanes).view(np.int32).astype(np.float64)
        both = a @ a + b @ b
        return float(np.clip(1 - (apart @ apart) / both, 0.0, 1.0)) if both else 0.0


def of_paragraphs(paragraphs: list[str]) -> Vector:
    """The sum of the vectors of some paragraphs."""
    digests = b"".join(hashlib.blake2b(p.encode(), digest_size=8 * EXACT).digest() for p in paragraphs)
    exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    words: list[str] = []
    for paragraph in paragraphs:
        words += paragraph.split()
        words.append(END)
    codes = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    mixed = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    slots = (mixed >> np.uint64(40))[codes[:-1] != np.uint64(_hashes[END])]
    counts = np.bincount((slots % np.uint64(2 * LANES)).astype(np.int64), minlength=2 * LANES)
    return Vector(exact, (counts[:LANES] - counts[LANES:]).astype(np.int32).view(np.uint32))


def of_text(text: str) -> Vector:
    return of_paragraphs(text.split("\n"))


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the start of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def edited_vector(vector: Vector, text: str, edited: str) -> Vector:
    """The edited text's fingerprint: paragraphs of the old end out, of the new end in."""
    kept = len(text) - len(text) // 4
    cut = text.rfind("\n", 0, kept) + 1
    return vector.minus(of_text(text[cut:])).plus(of_text(edited[cut:]))


DONE, FIRST, OPEN = "done", "first", "open"
SCHEMA = (
    "part int, kind string, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double, text string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
RESULT = COLUMNS[2:-1]


def _finished(part: int, doc_id, text: str, vector: Vector, following: str, next_vector: Vector) -> tuple:
    edited = edit(text, following)
    changed = edited_vector(vector, text, edited)
    digest = hashlib.sha256(edited.encode()).hexdigest()
    return (
        part, DONE, doc_id, len(text), digest, vector.to_bytes(), changed.to_bytes(),
        vector.likeness(changed), vector.likeness(next_vector), None,
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    return frame.astype({"doc_id": "Int64", "n_chars": "Int64"})


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Finish every row whose successor is in the same task; hand on both edges."""
    part = TaskContext.get().partitionId()
    held = None

    def edge(kind: str, doc_id, text: str) -> tuple:
        return (part, kind, doc_id, len(text), None, None, None, None, None, text)

    for batch in batches:
        rows = []
        ids = batch["doc_id"].astype("Int64")
        for doc_id, text in zip(ids, batch["text"], strict=True):
            vector = of_text(text)
            if held is None:
                rows.append(edge(FIRST, doc_id, text))
            else:
                rows.append(_finished(part, *held, text, vector))
            held = (doc_id, text, vector)
        yield _frame(rows)
    if held is not None:
        yield _frame([edge(OPEN, *held[:2])])


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [
            _finished(part, doc_id, text, of_text(text), following, of_text(following))
            for part, doc_id, text, following in zip(
                batch["part"], batch["doc_id"].astype("Int64"), batch["text"], batch["following"], strict=True
            )
        ]
        yield _frame(rows)


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of each document and of its text edited with its successor's start."""
    text = F.coalesce(text_column, F.lit(""))
    sorted_ = (
        docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    walked = stage(sorted_.mapInPandas(_walk, SCHEMA), "fingerprints")

    # One row per task: which non-empty task follows (after the last comes the first).
    firsts = walked.where(F.col("kind") == FIRST)
    tasks = firsts.select("part")
    follows = tasks.select(
        "part",
        F.coalesce(
            F.lead("part").over(Window.orderBy("part")),
            F.min("part").over(Window.partitionBy()),
        ).alias("next_part"),
    )
    heads = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    edges = walked.where(F.col("kind") == OPEN).join(follows, "part").join(heads, "next_part")
    closed = edges.select("part", "doc_id", "text", "following").mapInPandas(_close, SCHEMA)
    finished = walked.where(F.col("kind") == DONE).unionByName(closed)
    as_text = {c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")}
    return finished.select(RESULT).withColumns(as_text)
