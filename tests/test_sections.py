import pytest
from conftest import rows, same_rows
from pyspark.sql import functions as F

from weftline.operators import sections
from weftline.sources.tables import load_table
from weftline.sources.text_files import read_text_documents

FIRST = "\n".join(
    [
        "alpha: ##@ before any header",
        "##@-- First",
        "beta: gamma ##@ one",
        "##@-- Empty",
        "##@-- Third",
        "##@-- Second",
        "#skipped: ##@ comment",
        "delta.x-y: ##@ two ##@ three",
        "no marker here",
        "##@-- Third",
        "eta: ##@ late entry",
        "##@--   First",
        "beta: ##@ again",
    ]
)
SECOND = "omega: ##@ next document"


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(1, FIRST), (2, SECOND)], "doc_id bigint, text string")


def test_entries_and_positions(golden):
    got = rows(sections.section_catalog(golden), "doc_id", "line_no")
    assert got == [
        (1, 1, "General", 1, "alpha", " before any header"),
        (1, 3, "First", 1, "beta", " one"),
        (1, 8, "Second", 1, "delta.x-y", " three"),
        (1, 11, "Third", 1, "eta", " late entry"),
        (1, 13, "First", 2, "beta", " again"),
        (2, 1, "General", 2, "omega", " next document"),
    ]


def test_summary_keeps_first_seen_order_and_global_width(golden):
    got = rows(sections.section_summary(golden), "first_doc", "first_line")
    assert [(r[0], r[3]) for r in got] == [
        ("General", 2),
        ("First", 2),
        ("Third", 1),
        ("Second", 1),
    ]
    assert {r[4] for r in got} == {9}


def test_empty_section_is_only_in_its_own_report(golden):
    assert rows(sections.empty_sections(golden)) == [("Empty",)]


def test_carry_across_documents(golden):
    got = rows(sections.section_catalog(golden, carry_across_docs=True), "doc_id", "line_no")
    assert got[-1] == (2, 1, "First", 3, "omega", " next document")
    kept = rows(sections.section_summary(golden, carry_across_docs=True), "first_doc", "first_line")
    assert [(r[0], r[3]) for r in kept] == [
        ("General", 1),
        ("First", 3),
        ("Third", 1),
        ("Second", 1),
    ]


def test_greedy_split_and_kept_blanks(spark):
    docs = spark.createDataFrame(
        [(1, "a: b ##@ c ##@ d\nb: pre req ##@ tail \n.PHONY: a b\n%:\n\t@:\nc:##@\n")],
        "doc_id bigint, text string",
    )
    got = rows(sections.section_catalog(docs), "line_no")
    assert [(r[4], r[5]) for r in got] == [("a", " d"), ("b", " tail "), ("c", "")]


def test_header_lines_with_odd_bytes(spark):
    text = "##@--\tTabbed\r\nx: ##@ y\r\n##@--Bare\nz: ##@  w\n##@--\nq: ##@ unnamed"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = rows(sections.section_catalog(docs), "line_no")
    assert [(r[2], r[4], r[5]) for r in got] == [
        ("Tabbed\r", "x", " y\r"),
        ("Bare", "z", "  w"),
        ("", "q", " unnamed"),
    ]


def test_bucketed_numbering_equals_plain(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    plain = sections.section_catalog(docs, sections.SHORT_LINES)
    cut = sections.section_catalog(docs, sections.SHORT_LINES, rows_per_bucket=17)
    same_rows(plain, cut)


def test_bucketed_carry_equals_plain(spark, tiny, monkeypatch):
    docs = load_table(spark, tiny, "documents")
    plain = sections.section_catalog(docs, sections.SHORT_LINES, carry_across_docs=True).cache()
    plain.count()
    real = sections.ordering.order_edges
    monkeypatch.setattr(sections.ordering, "order_edges", lambda df, c, n=0: real(df, c, 17))
    same_rows(plain, sections.section_catalog(docs, sections.SHORT_LINES, carry_across_docs=True))


def test_brute_force_on_prose(spark, tiny):
    docs = load_table(spark, tiny, "documents").select("doc_id", "text").orderBy("doc_id")
    expected, count = [], {}
    for doc_id, text in docs.collect():
        section = "General"
        for number, line in enumerate(text.split("\n"), 1):
            if len(line) <= sections.SHORT_LINE:
                section = line
                continue
            count[section] = count.get(section, 0) + 1
            name, _, rest = line.partition(" ")
            expected.append((doc_id, number, section, count[section], name, rest))
    got = rows(sections.section_catalog(docs, sections.SHORT_LINES), "doc_id", "line_no")
    assert got == expected


def test_files_are_read_in_the_given_order(spark, tmp_path):
    late, early = tmp_path / "a.txt", tmp_path / "b.txt"
    late.write_text(SECOND)
    early.write_text(FIRST + "\n")
    docs = read_text_documents(spark, [str(early), str(late)])
    got = rows(sections.section_catalog(docs, carry_across_docs=True), "doc_id", "line_no")
    assert got[-1][:3] == (1, 1, "First") and len(got) == 6
    with pytest.raises(ValueError):
        read_text_documents(spark, [])
    with pytest.raises(ValueError, match="not a file"):
        read_text_documents(spark, [str(early), str(tmp_path)])


def test_a_list_of_files_is_one_scan(spark, tmp_path):
    paths = []
    for i in range(60):
        path = tmp_path / f"part {i % 7}%20é+{i}.txt"
        path.write_text(f"Head {i}\nentry-{i} some long help text for the entry number {i} that is no header\n")
        paths.append(str(path))
    paths = [*paths[::-1], paths[3]]
    docs = read_text_documents(spark, paths)
    assert docs._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    got = rows(docs.select("doc_id", "text"), "doc_id")
    assert [n for n, _ in got] == list(range(61))
    assert [t.split("\n")[0] for _, t in got] == [f"Head {i}" for i in (*range(59, -1, -1), 3)]


def test_catalogue_needs_one_shuffle(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    plan = sections.section_catalog(docs, sections.SHORT_LINES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    lines = sections.section_lines(docs, sections.SHORT_LINES)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
