"""Chat formatting with typed content parts.

A message is an array of parts: ``struct<kind, text, ref, units>``. A visitor
renders each part by its kind: text is escaped, anything else becomes an ordered
placeholder such as ``<image:0>`` and an attachment record with its reference and
its expanded token count (units times the cost of the kind).

Template, one per turn::

    <turn ROLE>BODY</turn>\\n

``<`` opens every control string and never occurs in escaped text: ``\\`` becomes
``\\b`` and ``<`` becomes ``\\l`` (in names also ``>`` becomes ``\\g``). Plain
replacement undoes this in the reverse order, so any text survives, whatever
control strings it holds.

The work is one shuffle by conversation; offsets are running sums over its parts.

Defined results: null text is empty, a null role is the empty name, a null kind
is text, a message without parts has an empty body. Rows are ordered by turn
(nulls first), then role, then the parts themselves, so repeated turns have a fixed order.
A null conversation id is a conversation of its own. Only the named columns are
read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,units:double>"
COSTS = {"image": 576.0, "audio": 25.0, "document": 800.0}  # per tile, second, page
TEXT_BYTES_PER_TOKEN = 4
OPEN, NAMED, CLOSE = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_name(name: Column) -> Column:
    return F.replace(escape(name), F.lit(">"), F.lit("\\g"))


def unescape_name(name: Column) -> Column:
    return unescape(F.replace(name, F.lit("\\g"), F.lit(">")))


def text_part(text: Column) -> Column:
    """The parts of a message that is one text."""
    empty = F.lit(None).cast("string")
    return F.array(
        F.struct(
            F.lit("text").alias("kind"),
            text.alias("text"),
            empty.alias("ref"),
            F.lit(None).cast("double").alias("units"),
        ).cast(PART)
    )


def _cost(kind: Column, costs: dict[str, float]) -> Column:
    cost = F.lit(1.0)
    for name, value in costs.items():
        cost = F.when(kind == name, F.lit(value)).otherwise(cost)
    return cost


def format_chat(
    messages: DataFrame,
    loss_role: str = "assistant",
    costs: dict[str, float] | None = None,
) -> DataFrame:
    """One row per conversation of ``messages`` (conv_id, turn, role, parts).

    ``formatted``; ``n_turns``; ``loss_spans`` with code point and byte offsets of
    each text part of the trained role; ``attachments`` in order of appearance;
    ``expanded_tokens``, the attachments' tokens and an estimate for the text.
    """
    costs = COSTS if costs is None else costs
    conversation = Window.partitionBy("conv_id")
    no_parts = F.coalesce(F.size("parts"), F.lit(0)) < 1
    rows = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(f"array<{PART}>")
    ).withColumn("parts", F.when(no_parts, text_part(F.lit(""))).otherwise(F.col("parts")))
    order = [F.col("turn").asc_nulls_first(), "role", "parts"]
    rows = rows.withColumn("turn_no", F.row_number().over(conversation.orderBy(*order)) - 1)
    last = F.size("parts") - 1
    parts = rows.select("conv_id", "turn_no", "role", last.alias("last"), F.posexplode("parts").alias("part_no", "part"))

    kind = F.coalesce("part.kind", F.lit("text"))
    is_text = kind == "text"
    held = parts.select(
        "conv_id",
        "turn_no",
        "part_no",
        "role",
        "last",
        kind.alias("kind"),
        is_text.alias("is_text"),
        F.col("part.ref").alias("ref"),
        F.when(~is_text, F.ceil(F.coalesce("part.units", F.lit(1.0)) * _cost(kind, costs)))
        .otherwise(F.ceil(F.octet_length(F.coalesce("part.text", F.lit(""))) / TEXT_BYTES_PER_TOKEN))
        .cast("bigint")
        .alias("tokens"),
        F.when(is_text, escape(F.coalesce("part.text", F.lit(""))))
        .otherwise(F.concat(F.lit("<"), escape_name(kind), F.lit(":"), F.col("part_no").cast("string"), F.lit(">")))
        .alias("body"),
    )
    first = F.col("part_no") == 0
    pieces = held.withColumn(
        "head",
        F.when(first, F.concat(F.lit(OPEN), escape_name(F.col("role")), F.lit(NAMED))).otherwise(F.lit("")),
    ).withColumn(
        "piece",
        F.concat("head", "body", F.when(F.col("part_no") == F.col("last"), F.lit(CLOSE)).otherwise(F.lit(""))),
    )
    before = conversation.orderBy("turn_no", "part_no").rowsBetween(Window.unboundedPreceding, -1)

    def start(measure) -> Column:
        so_far = F.coalesce(F.sum(measure("piece").cast("bigint")).over(before), F.lit(0))
        return so_far + measure("head")

    placed = pieces.withColumn("start", start(F.char_length)).withColumn("start_byte", start(F.octet_length))
    at = [F.col("turn_no"), F.col("part_no")]
    span = F.struct(
        *at,
        "start",
        F.char_length("body").cast("bigint").alias("length"),
        "start_byte",
        F.octet_length("body").cast("bigint").alias("n_bytes"),
    )
    attachment = F.struct(*at, "kind", "ref", "start", "tokens")
    trained = F.col("is_text") & (F.col("role") == loss_role)
    return (
        placed.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct(*at, "piece"))).alias("pieces"),
            (F.max("turn_no") + 1).cast("bigint").alias("n_turns"),
            F.sort_array(F.collect_list(F.when(trained, span))).alias("loss_spans"),
            F.sort_array(F.collect_list(F.when(~F.col("is_text"), attachment))).alias("attachments"),
            F.sum("tokens").alias("expanded_tokens"),
        )
        .select(
            "conv_id",
            F.array_join(F.col("pieces.piece"), "").alias("formatted"),
            "n_turns",
            "loss_spans",
            "attachments",
            "expanded_tokens",
        )
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation. Text
    parts are unescaped; placeholders stay as they stand in the body."""
    turns = F.split(formatted, CLOSE, -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(t: Column) -> Column:
        name_end = F.locate(NAMED, t)
        role = F.substring(t, len(OPEN) + 1, name_end - len(OPEN) - 1)
        body = F.substring(t, name_end + 1, F.length(t))
        return F.struct(unescape_name(role).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Bytes are cut, so each span costs
    its own length only."""
    raw = formatted.cast("binary")

    def cut(span: Column) -> Column:
        held = F.substring(raw, span["start_byte"].cast("int") + 1, span["n_bytes"].cast("int"))
        return unescape(held.cast("string"))

    return F.array_join(F.transform(spans, cut), "")
