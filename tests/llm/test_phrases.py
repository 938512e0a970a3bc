import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cases import no_documents, odd_documents
from compare import check, duck
from weftline.llm import phrases, queries


def brute(rows, min_count, max_words, top, percent):
    """Every phrase of every piece counted in one dictionary."""
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {p: n for p, n in counts.items() if n >= min_count}
    out = []
    for lang in totals:
        mine = {p: n for (own, p), n in found.items() if own == lang}
        scored = []
        for p, a in mine.items():
            if len(p) < 2:
                continue
            inside = any(
                100 * n >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, n in mine.items()
                if len(q) > len(p)
            )
            if inside:
                continue
            cuts = [(1000 * a * totals[lang] // (mine[p[:c]] * mine[p[c:]]), c) for c in range(1, len(p))]
            score, cut = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), mine[p[:cut]], mine[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.mine_phrases(df, **options).collect())


@pytest.fixture(scope="module")
def corpus(spark):
    vocabulary = ["the", "of", "Cat", "café", "x\x01y", "中文", "don't"]
    rows = []
    for i in range(120):
        words = [vocabulary[(i * 7 + j * j * (i % 5 + 1)) % len(vocabulary)] for j in range(i % 23)]
        rows.append((i, (" ", "\t", "  ", ", ")[i % 4].join(words) + ".\r\nThe CAT of the cat", ("en", "fr", None)[i % 3]))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)


@pytest.mark.parametrize(("min_count", "max_words"), [(1, 5), (3, 5), (9, 2)])
def test_equals_brute_force(corpus, min_count, max_words):
    rows = [(r["lang"], r["text"]) for r in corpus.collect()]
    options = {"min_count": min_count, "max_words": max_words, "top": 40, "percent": 100}
    found = mined(corpus, **options)
    assert found and found == brute(rows, **options)


def test_part_of_a_longer_phrase_by_share(corpus):
    rows = [(r["lang"], r["text"]) for r in corpus.collect()]
    options = {"min_count": 3, "max_words": 4, "top": 1000, "percent": 60}
    assert mined(corpus, **options) == brute(rows, **options)


@pytest.mark.parametrize("shards", [1, 2, 50])
def test_shards_change_nothing(corpus, shards):
    texts = corpus.selectExpr("coalesce(lang, 'und') AS lang", "text")
    found = [
        sorted(tuple(r) for r in phrases.frequent_phrases(texts.repartition(n), 7, 5, s)[1].collect())
        for n, s in ((1, 8), (9, shards))
    ]
    assert found[0] == found[1]


def test_a_full_map_changes_nothing(corpus):
    texts = corpus.selectExpr("coalesce(lang, 'und') AS lang", "text")
    wide, narrow = (
        sorted(tuple(r) for r in phrases.frequent_phrases(texts, 3, 5, map_bits=bits)[1].collect()) for bits in (1 << 26, 64)
    )
    assert wide == narrow


def test_rows_of_the_count_do_not_grow_with_the_tasks(spark, monkeypatch):
    """A phrase that is frequent in every shard is spelled once and not counted by every task."""
    made, plain = [], spark.createDataFrame([("en", "a b c. d e")] * 320, "lang string, text string").repartition(40)
    kind = type(plain)
    recorded = kind.mapInArrow

    def mapped(self, *args, **options):
        out = recorded(self, *args, **options)
        made.append(out)
        return out

    monkeypatch.setattr(kind, "mapInArrow", mapped)
    found = {(r["phrase"], r["n"]) for r in phrases.frequent_phrases(plain, 16)[1].where("words > 1").collect()}
    assert found == {("a b", 320), ("b c", 320), ("a b c", 320), ("d e", 320)}
    counts = [df for df in made if "phrase" in df.columns]
    assert sum(df.where("words > 1").count() for df in counts) == len(found)


def test_partitions_that_change_between_passes(spark, corpus):
    place = F.udf(lambda: os.urandom(1)[0], "int").asNondeterministic()
    moving = corpus.withColumn("place", place()).repartition(7, "place").drop("place")
    rows = [(r["lang"], r["text"]) for r in corpus.collect()]
    options = {"min_count": 5, "max_words": 4, "top": 500, "percent": 100}
    assert mined(moving, **options) == brute(rows, **options)


def test_products_beyond_64_bits(spark):
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n bigint")
    rows = [("en", 1, "a", 10**13), ("en", 1, "b", 3 * 10**13), ("en", 2, "a b", 7 * 10**12)]
    frequent = spark.createDataFrame(rows, "lang string, words int, phrase string, n bigint")
    (found,) = phrases.score_phrases(totals, frequent).collect()
    assert found["score"] == 1000 * 7 * 10**12 * 10**15 // (3 * 10**26)


def test_odd_rows(spark):
    odd = odd_documents(spark)
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    options = {"min_count": 2, "max_words": 5, "top": 300, "percent": 100}
    assert mined(odd, **options) == brute(rows, **options)


def test_no_rows(spark):
    assert mined(no_documents(spark)) == []


def test_twin(spark, tiny):
    difference, n, *_ = check(spark, duck(tiny), tiny, queries.op13_phrases, queries.PHRASES_SQL)
    assert difference is None and n > 0
