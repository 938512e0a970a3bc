"""Overlapping chunks of documents, each with the header in force at its start.

All of it is done inside the row. The text is cut once into blocks of ``step``
characters; a chunk is a block plus the first characters of the next one. Chunk
starts are marked in a copy of the text which is then cut into sections, so that
each section tells how many chunks start in it. Both passes are linear in the
length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.sections import (
    SHORT_LINES,
    Grammar,
    header_pieces,
    opens_with_header,
)

CHUNK_CHARS = 1000
CHUNK_STEP = 800

# Noncharacters of Unicode: never part of a text meant for interchange.
_START = "\uffff"
_STAND_IN = "\ufffe"


def _symbols(blocks: Column, grammar: Grammar) -> Column:
    """One header (or null) per block: the last one at or before its start."""
    clean = F.transform(blocks, lambda b: F.replace(b, F.lit(_START), F.lit(_STAND_IN)))
    marked = F.concat(F.lit(_START), F.array_join(clean, _START))
    # A start inside a line moves to the front of the line: the header in force
    # stays the same, and no header line is left with a mark inside.
    marked = F.regexp_replace(marked, rf"(?dm)^([^\n{_START}]*){_START}", rf"{_START}$1")
    label = f"{_START}?"

    def per_piece(piece: Column) -> Column:
        starts = F.length(piece) - F.length(F.replace(piece, F.lit(_START), F.lit("")))
        first_line = F.replace(F.substring_index(piece, "\n", 1), F.lit(_START), F.lit(""))
        headed = opens_with_header(piece, grammar, label)
        return F.array_repeat(F.when(headed, grammar.title(first_line)), starts)

    return F.flatten(F.transform(header_pieces(marked, grammar, label), per_piece))


def chunk_documents(
    documents: DataFrame,
    grammar: Grammar = SHORT_LINES,
    layer: str = "lang",
    size: int = CHUNK_CHARS,
    step: int = CHUNK_STEP,
) -> DataFrame:
    """chunk_id, doc_id, chunk_no, start, layer, symbol, text.

    A chunk starts every ``step`` characters as long as the text has something
    the chunk before does not hold; an empty text is one empty chunk.
    """
    overlap = size - step
    if not 0 <= overlap <= step:
        raise ValueError("need step <= size <= 2 * step")
    block = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    # A last block no longer than the overlap is already in the chunk before it.
    repeated = (F.size("blocks") > 1) & (F.length(F.element_at("blocks", -1)) <= overlap)
    n_chunks = F.size("blocks") - F.when(repeated, 1).otherwise(0)
    return (
        documents.where("text IS NOT NULL")
        .select(
            "doc_id",
            F.col(layer).alias("layer"),
            F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(block).alias("blocks"),
        )
        .select(
            "doc_id",
            "layer",
            F.posexplode_outer(
                F.slice(
                    F.arrays_zip(
                        F.col("blocks").alias("block"),
                        F.slice("blocks", 2, F.size("blocks")).alias("following"),
                        _symbols(F.col("blocks"), grammar).alias("symbol"),
                    ),
                    1,
                    n_chunks,
                )
            ).alias("chunk_no", "chunk"),
        )
        .select(
            F.sha2(F.concat_ws(":", "doc_id", F.col("chunk_no") * step), 256).alias("chunk_id"),
            "doc_id",
            "chunk_no",
            (F.col("chunk_no") * step).alias("start"),
            "layer",
            F.col("chunk.symbol").alias("symbol"),
            F.concat(
                "chunk.block", F.substring(F.coalesce("chunk.following", F.lit("")), 1, overlap)
            ).alias("text"),
        )
    )
