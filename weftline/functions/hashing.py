"""Order-free content hash of a table that any SQL engine can compute as well. It spells
floats with six places; ``functions/digests.py`` is exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\x00"
FIELD_MARK = "\x1f"


def canonical(name: str, kind: T.DataType) -> Column:
    """A value as text that any SQL engine can spell the same way."""
    value = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = value.cast("decimal(28,6)").cast("string")
    elif isinstance(kind, T.ArrayType):
        text = F.array_join(
            F.transform(value, lambda x: x.cast("double").cast("decimal(28,6)").cast("string")), ","
        )
    elif isinstance(kind, T.TimestampNTZType):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(NULL_MARK))


def table_hash(schema: T.StructType) -> Column:
    """Aggregate: the sum of the first 60 bits of the md5 of every row. Independent of
    row order and of how the rows are partitioned. Two sums of 30 bits are added at the
    end, so no row is turned into a wide decimal."""
    row = F.md5(F.concat_ws(FIELD_MARK, *[canonical(f.name, f.dataType) for f in schema.fields]))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    high, low = F.sum(F.shiftright(number, 30)), F.sum(number.bitwiseAND(F.lit((1 << 30) - 1)))
    wide = (high.cast("decimal(20,0)") * F.lit(1 << 30) + low).cast("decimal(38,0)")
    return F.coalesce(wide.cast("string"), F.lit("0"))
