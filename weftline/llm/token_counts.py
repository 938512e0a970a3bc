"""Token counts of whole texts with a whole-token shortcut (sentencepiece BPE).

Proved once per model, from its vocabulary alone:

* no piece holds the space symbol after another character, so no merge crosses
  the place before a run of spaces: a text is the sum of its pre-tokens, each a
  run of spaces with the word after it;
* which vocabulary strings encode alone as one token. Such words count as one
  without merging.

Only the other pre-tokens are merged, each distinct one about once per Python
worker. Rows stay where they are: there is no shuffle, and memory is bounded by
the batch and ``MEMO`` remembered words.

Defined results: null and empty texts have no bytes and no tokens. Special
strings inside a text are ordinary text, as the library's default has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MEMO = 300_000


class TokenCounter:
    """Counts tokens as the model does; the vocabulary is checked when it is made."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        if any(SPACE in piece.lstrip(SPACE) for piece in pieces):
            raise ValueError("a piece crosses a space: texts cannot be cut at spaces")
        if self.processor.encode("a b") != self.processor.encode(f"a{SPACE}b"):
            raise ValueError("the model treats a written space symbol unlike a space")
        words = [p[1:] for p in pieces if p.startswith(SPACE) and not p[1:].startswith(SPACE) and p[1:]]
        self.whole = {
            word: 1
            for word, ids in zip(words, self.processor.encode(words, num_threads=1), strict=True)
            if len(ids) == 1
        }
        self.words = _Words(self)

    def merge(self, word: str) -> int:
        """Tokens of a word after one space, by merging."""
        return len(self.processor.encode(word))

    def spaces(self, n: int) -> int:
        """Tokens of ``n`` spaces with nothing after them."""
        return len(self.processor.encode("a" + " " * n)) - 1

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            return sum(map(self.words.__getitem__, words))
        total = run = 0
        for word in words:
            run += 1
            if word:
                total += self.words[word] if run == 1 else self.merge(" " * (run - 1) + word)
                run = 0
        return total + (self.spaces(run) if run else 0)


class _Words(dict):
    """Counts of words: the whole tokens, and up to MEMO merged ones."""

    def __init__(self, counter: TokenCounter) -> None:
        super().__init__(counter.whole)
        self.counter = counter
        self.limit = len(counter.whole) + MEMO

    def __missing__(self, word: str) -> int:
        n = self.counter.merge(word)
        if len(self) >= self.limit:
            self.clear()
            self.update(self.counter.whole)
        self[word] = n
        return n


_counters: dict[int, TokenCounter] = {}


def counter_of(model: bytes) -> TokenCounter:
    """The counter of a model; one per Python worker, kept between tasks."""
    key = hash(model)
    if key not in _counters:
        _counters[key] = TokenCounter(model)
    return _counters[key]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    The model file is read by the driver and sent along; its size is that of a
    vocabulary and does not depend on the data.
    """
    model = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(model.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = F.coalesce(text_column, F.lit(""))
    counted = docs.select(
        id_column,
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        tokens(text).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
