"""The corpus pipeline: five stages over documents, each written and read again.

1. language ID: documents without a letter go, and those whose words are made of
   other letter groups than the labelled rows (a language the model never saw, noise);
   texts of several known languages stay; all stay without labelled rows to learn from;
2. line dedup: lines repeated in later documents go, documents stay;
3. near-dedup: one document of each group of near copies stays;
4. decontamination: documents that hold a test item go;
5. packing: what is left is packed into token sequences.

All stages but the last return the columns of documents. A document that loses
lines has its length counted again. Stages take documents with nulls in any
column, repeated rows, further columns, or no rows at all. A row without a doc_id
is a document of its own and judged like any other: stages that go by the id give
it a key above all ids, so it follows the documents that have one.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontamination, language, lines, minhash, packing
from weftline.llm.queries import WORD_TOKENIZER, language_model
from weftline.sources.tables import load_table
from weftline.sources.workspace import stage

MIN_FAMILIARITY = 0.9  # of a text's words, as a part of that of a labelled document's
NEAR_PERCENT = 80
HIGH_ID = 1 << 62  # row numbers of Spark stay below
NO_ID = "no_id__"


def _free_keys(docs: DataFrame, unnamed: DataFrame) -> DataFrame:
    """``unnamed`` with a stored ``doc_id`` that no row of ``docs`` has. Above all ids;
    where those reach up to the largest numbers, hashes tried until they are free."""
    number = F.monotonically_increasing_id()
    top = docs.agg(F.max("doc_id")).first()[0]
    if top is None or top < HIGH_ID:
        return stage(unnamed.withColumn("doc_id", number + F.lit(max(top or 0, 0) + 1)), "keys")
    numbered = stage(unnamed.withColumn("number__", number), "numbers")
    taken, salt = docs.select("doc_id"), 0
    while True:
        keyed = numbered.withColumn("doc_id", F.xxhash64("number__", F.lit(salt))).drop("number__")
        twice = keyed.groupBy("doc_id").count().where("count > 1")
        if twice.isEmpty() and keyed.join(taken, "doc_id", "left_semi").isEmpty():
            return keyed
        salt += 1


def by_key(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage over rows that all have a doc_id; null ids are null again after it."""

    @functools.wraps(step)
    def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        unnamed = docs.where("doc_id IS NULL")
        if unnamed.isEmpty():
            return step(spark, docs, sf_dir)
        named = docs.where("doc_id IS NOT NULL").withColumn(NO_ID, F.lit(False))
        keyed = _free_keys(docs, unnamed).withColumn(NO_ID, F.lit(True))
        after = step(spark, named.unionByName(keyed), sf_dir)
        return after.withColumn("doc_id", F.when(~F.col(NO_ID), F.col("doc_id"))).select(docs.columns)

    return judged


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_model(docs)
    if model is None:
        return docs
    found = language.with_language(docs, model, "found__", evidence=True)
    known = (F.col("found__.lang") != language.UNKNOWN) & (F.col("found__.familiarity") >= MIN_FAMILIARITY)
    return found.where(known).select(docs.columns)


@by_key
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(docs, name="kept__")
    changed = F.col("kept__.n_dropped") > 0
    cleaned = cleaned.withColumn("text", F.when(changed, F.col("kept__.text")).otherwise(F.col("text")))
    n_chars = F.when(changed, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(docs.columns)


@by_key
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group stays; of repeated rows, one."""
    groups = minhash.near_duplicates(docs, percent=NEAR_PERCENT)
    gone = stage(groups.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated = stage(repeated, "repeated")
    once = left.join(repeated, "doc_id", "left_anti").select(docs.columns)
    first = left.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return once.unionByName(first)


@by_key
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, load_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(WORD_TOKENIZER))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None  # SQL cannot express the learned model, MinHash or the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
