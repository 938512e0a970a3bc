"""Text expressions. All of them stay inside the row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"
SUMMARY_PATTERN = r"^([^.\n]{1,60}\.)"


def lines(text: Column) -> Column:
    """Lines of a text; one final newline ends the last line, it opens none."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, in order."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SEPARATOR, -1), "")


def summary(text: Column) -> Column:
    """First sentence when it ends within 61 characters, else null."""
    return F.nullif(F.regexp_extract(text, SUMMARY_PATTERN, 1), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
