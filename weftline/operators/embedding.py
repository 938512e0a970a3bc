"""Hashed embeddings of texts, dense for storage and search, sparse for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text as tx
from weftline.functions.terms import hashed_vectors

BUCKETS = 64


def embed(texts: DataFrame, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``embedding``, an L2-normalised array<double>.

    The buckets of a text are counted where its row is: the vector of a chunk is
    as large as its text, so a group-by would shuffle the corpus once more.
    """
    kept = [c for c in texts.columns if c != text]
    tokenised = texts.select(*kept, tx.tokens(F.col(text)).alias("tokens"))
    vector = T.StructField("embedding", T.ArrayType(T.DoubleType()))
    schema = T.StructType([*tokenised.schema.fields[:-1], vector])
    return tokenised.mapInArrow(hashed_vectors(buckets, "embedding"), schema)


def hashed_embedding(
    documents: DataFrame, key: str = "doc_id", buckets: int = BUCKETS
) -> DataFrame:
    """Sparse rows: key, bucket, weight (6 decimals, zeros left out)."""
    return (
        embed(documents.select(key, "text"), buckets)
        .select(key, F.posexplode("embedding").alias("bucket", "weight"))
        .where(F.col("weight") > 0)
        .withColumn("weight", F.round("weight", 6))
    )
