"""What Python workers remember."""

import gc

import public_tokenizers
from pyspark import SparkContext
from pyspark.sql import functions as F

from weftline.llm import decontamination, language, minhash, packing
from weftline.llm.queries import WORD_TOKENIZER

MEMORIES = (language.Labeller, minhash._WordHashes, decontamination._WordHashes, packing.WordIds)
WORDS = [f"word{i}" for i in range(3000)]


class Shared:
    id = "model"
    value = language.fit([("en", i, f"some words {i} of english") for i in range(9)] + [("de", 1, "ein paar worte")])


def test_a_worker_remembers_the_words_of_one_operator():
    """As in the pipeline, whose stages follow each other in the same workers."""
    text = " ".join(WORDS)
    tokenizer = open(public_tokenizers.path(WORD_TOKENIZER), encoding="utf-8").read()
    for step in (
        lambda: language._labeller(Shared).label([WORDS]),
        lambda: minhash.shingles(text.encode()),
        lambda: decontamination.words_of(text.encode()),
        lambda: packing._word_ids(tokenizer).texts([text]),
        lambda: language._labeller(Shared).label([WORDS]),
    ):
        step()
        assert sum(type(x) in MEMORIES and len(x) >= len(WORDS) for x in gc.get_objects()) == 1


def test_an_operator_keeps_its_words_between_batches():
    minhash.shingles(" ".join(WORDS).encode())
    before = minhash.remembered(minhash._WordHashes, dict)
    minhash.shingles(b"a text of some other words")
    assert minhash.remembered(minhash._WordHashes, dict) is before and len(before) > len(WORDS)


def test_rounds_of_packing_start_no_python_worker(spark, monkeypatch):
    """Spark reads a list of rows in Python workers of their own, Arrow columns in none."""

    def refused(*args, **options):
        raise AssertionError("a list of rows goes to Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    pieces = spark.range(60).select(F.col("id").alias("key"), (F.col("id") % 7 + 1).alias("length"))
    placed = pieces.join(packing.pack(pieces, 8), "key").groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in placed) <= 8 and sum(r["n"] for r in placed) == sum(i % 7 + 1 for i in range(60))
