"""Catalogue of sectioned text: headers open a section, entries belong to one.

A document is one row, so the current header is found inside the row: every line
gets its number as a prefix, the numbered text is cut in front of each header
line, and each cut piece is one section. That needs no shuffle and no window
over lines, whatever the length of the document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.plans import ordering
from weftline.sources.workspace import stage

# The marker grammar and the name of the opening section.
DEFAULT_SECTION = "General"
HEADER_PATTERN = r"##@--"
HEADER_STRIP_PATTERN = r"^##@--\s*"
ENTRY_PATTERN = r"(?s)^[a-zA-Z0-9_.-]+:.*##@"
ENTRY_SPLIT_PATTERN = r"(?s)^([^:]*):.*##@(.*)$"

SHORT_LINE = 40


@dataclass(frozen=True)
class Grammar:
    """What makes a header and an entry. Patterns are Java regexps.

    ``header`` is tried at the start of a line and must not run past its end;
    ``title`` cleans a header line; ``entry`` selects among the other lines;
    ``name`` and ``help`` read an entry line.
    """

    header: str
    title_strip: str | None
    entry: str | None
    split: str

    def title(self, line: Column) -> Column:
        return F.regexp_replace(line, self.title_strip, "") if self.title_strip else line

    def is_entry(self, line: Column) -> Column:
        return line.rlike(self.entry) if self.entry else F.lit(True)

    def name(self, line: Column) -> Column:
        return F.regexp_extract(line, self.split, 1)

    def help(self, line: Column) -> Column:
        return F.regexp_extract(line, self.split, 2)


# Marked headers and entries; the entry splits at its first colon and last marker.
MARKERS = Grammar(
    header=HEADER_PATTERN,
    title_strip=HEADER_STRIP_PATTERN,
    entry=ENTRY_PATTERN,
    split=ENTRY_SPLIT_PATTERN,
)

# Plain prose: a short line is a header, every other line an entry.
SHORT_LINES = Grammar(
    header=rf"[^\n]{{0,{SHORT_LINE}}}(?:\n|\z)",
    title_strip=None,
    entry=None,
    split=r"(?s)^([^ ]*) ?(.*)$",
)


def header_pieces(text: Column, grammar: Grammar, label: str = "") -> Column:
    """``text`` cut in front of each header line. ``label`` is a pattern for
    what stands before each line's own text."""
    return F.split(text, rf"(?dm)^(?={label}{grammar.header})", -1)


def opens_with_header(piece: Column, grammar: Grammar, label: str = "") -> Column:
    return piece.rlike(rf"\A{label}{grammar.header}")


def _numbered(text: Column) -> Column:
    return F.array_join(
        F.transform(
            tx.lines(text), lambda line, i: F.concat((i + 1).cast("string"), F.lit("\t"), line)
        ),
        "\n",
    )


def _unlabelled(line: Column) -> Column:
    return F.substring(line, F.instr(line, "\t") + 1, F.length(line))


LINE_LABEL = r"\d+\t"


def section_lines(
    documents: DataFrame, grammar: Grammar, carry_across_docs: bool = False
) -> DataFrame:
    """Header and entry lines: doc_id, line_no, section, is_header, line.

    With ``carry_across_docs`` a document opens in the last section of the
    documents before it (by doc_id), else in ``General``.
    """
    opening = F.lit(DEFAULT_SECTION)
    source = documents.select("doc_id", "text")
    if carry_across_docs:
        source = source.join(_opening_sections(source, grammar), "doc_id")
        opening = F.coalesce("opening", F.lit(DEFAULT_SECTION))
    first_line = F.substring_index("piece", "\n", 1)
    headed = opens_with_header(F.col("piece"), grammar, LINE_LABEL)
    pieces = source.where("text IS NOT NULL").select(
        "doc_id",
        opening.alias("opening"),
        F.explode_outer(header_pieces(_numbered(F.col("text")), grammar, LINE_LABEL)).alias("piece"),
    ).select(
        "doc_id",
        F.when(headed, grammar.title(_unlabelled(first_line)))
        .otherwise(F.col("opening"))
        .alias("section"),
        headed.alias("headed"),
        F.array_remove(F.split("piece", "\n", -1), "").alias("labelled"),
    )
    return (
        pieces.select("doc_id", "section", "headed", F.posexplode_outer("labelled").alias("at", "labelled"))
        .select(
            "doc_id",
            F.substring_index("labelled", "\t", 1).cast("int").alias("line_no"),
            "section",
            (F.col("headed") & (F.col("at") == 0)).alias("is_header"),
            _unlabelled(F.col("labelled")).alias("line"),
        )
        .where(F.col("is_header") | grammar.is_entry(F.col("line")))
    )


def _opening_sections(documents: DataFrame, grammar: Grammar) -> DataFrame:
    piece = F.element_at(header_pieces(F.col("text"), grammar), -1)
    last_header = F.when(
        opens_with_header(piece, grammar), grammar.title(F.substring_index(piece, "\n", 1))
    )
    edges = ordering.order_edges(documents, "doc_id")
    return ordering.carry_forward(
        documents.select("doc_id", last_header.alias("last_header")),
        "doc_id",
        F.col("last_header"),
        edges,
        "opening",
    ).select("doc_id", "opening")


def section_catalog(
    documents: DataFrame,
    grammar: Grammar = MARKERS,
    carry_across_docs: bool = False,
    rows_per_bucket: int = ordering.ROWS_PER_BUCKET,
) -> DataFrame:
    """Every entry with its section and its position in that section over all
    documents: doc_id, line_no, section, entry_pos, name, help."""
    entries = (
        section_lines(documents, grammar, carry_across_docs)
        .where(~F.col("is_header"))
        .select(
            "doc_id",
            "line_no",
            "section",
            grammar.name(F.col("line")).alias("name"),
            grammar.help(F.col("line")).alias("help"),
        )
    )
    edges = ordering.order_edges(documents, "doc_id", rows_per_bucket)
    return ordering.number_rows(
        entries, "section", ["doc_id", "line_no"], edges, "entry_pos"
    ).select("doc_id", "line_no", "section", "entry_pos", "name", "help")


def _per_section(
    documents: DataFrame, grammar: Grammar, carry_across_docs: bool
) -> DataFrame:
    """One row per section: place of its first header or entry, entry count and
    longest entry name. Partial aggregation absorbs a hot section."""
    is_entry = ~F.col("is_header")
    return (
        section_lines(documents, grammar, carry_across_docs)
        .groupBy("section")
        .agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"),
            F.count_if(is_entry).alias("n_entries"),
            F.max(F.when(is_entry, F.length(grammar.name(F.col("line"))))).alias("longest"),
        )
    )


def section_summary(
    documents: DataFrame, grammar: Grammar = MARKERS, carry_across_docs: bool = False
) -> DataFrame:
    """Sections that have entries: section, first_doc, first_line, n_entries,
    max_name_len. Sort by (first_doc, first_line) for the listing order.
    ``max_name_len`` is the longest name of all sections."""
    # Stored, so that the text is read once for the rows and for the width.
    sections = stage(_per_section(documents, grammar, carry_across_docs), "sections")
    longest = sections.agg(F.max("longest")).scalar()
    return sections.where(F.col("n_entries") > 0).select(
        "section",
        F.col("first.doc_id").alias("first_doc"),
        F.col("first.line_no").alias("first_line"),
        "n_entries",
        longest.alias("max_name_len"),
    )


def empty_sections(
    documents: DataFrame, grammar: Grammar = MARKERS, carry_across_docs: bool = False
) -> DataFrame:
    """Sections that have a header but no entry."""
    return (
        _per_section(documents, grammar, carry_across_docs)
        .where(F.col("n_entries") == 0)
        .select("section")
    )
