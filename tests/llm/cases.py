"""Odd rows that every operator must take."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, rank bigint"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
LINE = "a shared line of more than forty characters, in many documents"
TEXTS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "12345 !!! \u2028 --"),
    (5, LONG),
    (6, LONG),
    (7, f"one\n{LINE}\ntwo"),
    (8, f"{LINE.upper()}  \n\n{LINE}"),
    (9, f"\t{LINE}\r\nend"),
    (10, f"{LINE}"),
    (11, f"x\n{LINE}\nx\ny"),
    (11, f"x\n{LINE}\nx\ny"),
    (12, "d\u00e9j\u00e0 vu \U0001f600 \u4e2d\u6587 <|endoftext|> it's \u2581x a  b"),
    (None, f"no id\n{LINE}"),
    (None, None),
    (13, "same"),
    (14, "same"),
]


def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeats, clashing names."""
    rows = [
        (i, text, None if n % 3 == 0 else ("en", "fr")[n % 2], None if n % 4 == 0 else "src0", None, -1, None)
        for n, (i, text) in enumerate(TEXTS)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
