"""Exact digest of rows: no value is rounded or spelled out, a null is not an empty value.

``table_digest`` adds up a 64-bit hash of every row in three pieces, so it does not
depend on the order of the rows or on how they are partitioned, digests of parts add
up to that of the table, and no sum overflows below two trillion rows.
Hashes are Spark's own, which know every type but maps; maps, nested nulls and the
sign of zero are told apart here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECES = {"low": (0, 22), "mid": (22, 21), "high": (43, 21)}  # of the hash: first bit, bits
MEASURES = ("rows", *PIECES)


def exact_parts(value: Column, kind: T.DataType) -> list[Column]:
    """Columns that are equal, nulls included, just where ``value`` is. All NaN are one value."""
    null = value.isNull()
    if isinstance(kind, T.StructType):
        fields = (exact_parts(value.getField(f.name), f.dataType) for f in kind.fields)
        return [null, *(part for parts in fields for part in parts)]
    if isinstance(kind, T.ArrayType):
        return [null, F.size(value), F.transform(value, lambda x: F.struct(*exact_parts(x, kind.elementType)))]
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda e: F.xxhash64(*exact_parts(e["key"], kind.keyType), *exact_parts(e["value"], kind.valueType)),
        )
        return [null, F.size(value), F.array_sort(entries)]
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # the hash takes both zeros for one
        return [null, value, (value == 0) & (value.cast("string") == "-0.0")]
    return [null, value]


def row_digest(schema: T.StructType) -> Column:
    parts = (exact_parts(F.col(_quoted(f.name)), f.dataType) for f in schema.fields)
    return F.xxhash64(F.lit(len(schema.fields)), *(part for some in parts for part in some))


def table_digest(schema: T.StructType) -> list[Column]:
    """Aggregates named as ``MEASURES``; zeros for no rows."""
    row = row_digest(schema)

    def piece(name: str) -> Column:
        first, bits = PIECES[name]
        part = F.shiftrightunsigned(row, first).bitwiseAND(F.lit((1 << bits) - 1))
        return F.coalesce(F.sum(part), F.lit(0)).alias(name)

    return [F.count(F.lit(1)).alias("rows"), *map(piece, PIECES)]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
