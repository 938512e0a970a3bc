"""Leaks against alignment of every document with every item."""

import random

import numpy as np
import pytest
from cases import no_documents, odd_documents, texts_of

from weftline.llm import decontamination as d
from weftline.sources.tables import load_table


def brute(rows, items):
    """(doc_id, item_id) -> score, by aligning all that share an n-gram, common or rare."""
    out = {}
    for i, text in rows:
        words = d.words_of((text or "").encode())
        for item_id, item in items:
            wanted = d.words_of((item or "").encode())
            if not np.isin(d.grams_of(words), d.grams_of(wanted)).any():
                continue
            score = d.align(wanted, words)[0]
            if score >= d.MIN_SHARE * len(wanted) or score >= d.MIN_SCORE:
                out[i, item_id] = max(score, out.get((i, item_id), 0))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): r["score"] for r in df.collect()}


def test_leaks_equal_all_alignments(spark, tiny):
    docs, items = (load_table(spark, tiny, t) for t in ("documents", "benchmark"))
    expected = brute(texts_of(docs), [tuple(r) for r in items.collect()])
    assert found(d.find_leaks(docs, items)) == expected and expected


def textbook(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, passage = rng.integers(1, 4, rng.integers(1, 9)), rng.integers(1, 4, rng.integers(1, 15))
        score, start, end = d.align_span(item, passage)
        assert score == textbook(item, passage)
        assert textbook(item, passage[start:end]) == score


def edited_copies(seed, rate):
    """300 documents, 200 of them with a copy of an item of which ``rate`` of the words
    are replaced, missing or preceded by another word; and the 20 items."""
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(16, 56)))) for i in range(20)]
    rows = []
    for n in range(300):
        around = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 300))]
        words = items[n % 20][1].split()
        if n < 200:
            for _ in range(max(1, int(len(words) * rate))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["Added,", words[at]], ["other!"]])
            around[10:10] = words
        rows.append((n, " ".join(around)))
    return rows, items


@pytest.fixture(scope="module")
def edited():
    return edited_copies(4, 1 / 8)


def test_edited_copies_are_found_and_clean_texts_are_not(spark, edited):
    rows, items = edited
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = found(d.find_leaks(docs, bench))
    assert got == brute(rows, items)
    assert {i for i, _ in got} == set(range(200))


@pytest.mark.parametrize(("rate", "least"), [(0.05, 1.0), (0.2, 0.98), (0.3, 0.95)])
def test_recall_of_rare_seeds(spark, rate, least):
    rows, items = edited_copies(5, rate)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, expected = found(d.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"))), brute(rows, items)
    assert len(expected) > 150 and set(got) <= set(expected)
    assert len(got) >= least * len(expected)
    assert all(score <= expected[pair] for pair, score in got.items())


def test_seeds_are_the_rarest_of_every_stretch(spark):
    rows = [(g, 1, g // 6, g) for g in range(18)] + [(3, 2, 0, 0)]
    grams = spark.createDataFrame(rows, "gram bigint, item bigint, stretch bigint, place bigint")
    times = {0: 9, 1: 4, 2: 4, 3: 1, 4: 7, 5: 3, 6: 400, 7: 500, 8: 600}  # the others are in no passage
    hits = spark.createDataFrame([(n, g) for g, times_ in times.items() for n in range(times_)], "passage bigint, gram bigint")
    seeds = sorted((r["item"], r["gram"]) for r in d.rare_seeds(grams, hits, 3).collect())
    # 3, then 0 for it shares no word with 3, then the rarest of the rest; 6 to 8 though frequent
    assert seeds == [(1, 0), (1, 3), (1, 5), (1, 6), (1, 7), (1, 8), (2, 3)]


def test_frequent_grams_alone_bring_no_candidate(spark, monkeypatch):
    rng = random.Random(9)
    items = [(n, " ".join(f"own{n}x{i} its{n}x{i} a{n}x{i} b{n}x{i} of the many" for i in range(8))) for n in range(5)]
    between = lambda: " ".join(f"word{rng.randrange(99)}" for _ in range(6))
    rows = [(n, " ".join(f"of the many {between()}" for _ in range(10))) for n in range(200)]
    rows += [(1000 + n, f"before it {text} and after") for n, text in items]
    pairs = []
    whole = d._aligned
    monkeypatch.setattr(d, "_aligned", lambda df, *rest: pairs.append(df.count()) or whole(df, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = found(d.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == brute(rows, items) == {(1000 + n, n): 56 for n in range(5)}
    assert pairs == [5]


def test_every_leak_holds_a_whole_stretch():
    for n_words in range(d.GRAM, 200):
        least = min(d.MIN_SCORE, -(-n_words // 2))
        length = d.stretch_length(n_words, 0.5, d.MIN_SCORE)
        stretches = d.stretches(n_words - d.GRAM + 1, length)
        sizes = np.bincount(stretches)
        assert 2 * sizes.min() >= min(length, len(stretches)) and sizes.max() <= length <= d.MIN_SCORE // 2
        width = max(least, d.GRAM) - d.GRAM + 1
        for start in range(len(stretches) - width + 1):
            inside = np.bincount(stretches[start : start + width], minlength=len(sizes))
            assert (inside == sizes).any()


def test_bitmap_marks_the_grams(spark):
    grams = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500)
    bits = d._bitmap(spark.createDataFrame([(int(g),) for g in grams] * 2, "gram bigint"))
    at = d._bit(grams.view(np.uint64))
    assert (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all()
    assert np.unpackbits(bits).sum() == len(set(at.tolist()))


def test_spans_hold_the_leak(spark, edited):
    rows, items = edited
    texts = dict(rows)
    docs = spark.createDataFrame(rows[:40], "doc_id bigint, text string")
    for r in d.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect():
        span = " ".join(texts[r["doc_id"]].split()[r["first_word"] : r["first_word"] + r["n_words"]])
        assert d.align(d.words_of(dict(items)[r["item_id"]].encode()), d.words_of(span.encode()))[0] == r["score"]


def test_a_frequent_excerpt_of_a_long_item_is_found_everywhere(spark):
    rng = random.Random(8)
    item = [f"item{i}" for i in range(100)]
    rows = []
    for n in range(1000):
        text = [f"word{rng.randrange(400)}" for _ in range(20)]
        if n < 63:
            excerpt = item[:45] if n >= 3 else list(item)
            for at in range(n % 6):  # a word replaced in every stretch of MIN_SCORE / 2
                excerpt[5 + 8 * at] = "other"
            text[10:10] = excerpt
        rows.append((n, " ".join(text)))
    items = [(1, " ".join(item))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = found(d.find_leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == brute(rows, items) and {i for i, _ in got} == set(range(63))


def test_the_count_of_words_is_never_less_than_the_score():
    rng = np.random.default_rng(3)
    for _ in range(300):
        item, passage = rng.integers(1, 6, rng.integers(1, 12)), rng.integers(1, 9, rng.integers(1, 60))
        assert d.most_words(item, passage) >= d.align(item, passage)[0]


def test_leaks_of_odd_rows(spark):
    odd = odd_documents(spark)
    items = [(1, None), (None, "a b c d"), (2, ""), (3, "two words"), (4, "a shared line of more than forty characters in many documents")]
    items += [(5, "Été a b"), (4, "word1 word2 word3 word4 word5 word6"), (6, "12345 !!! no")]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, doc_id int")
    got = found(d.find_leaks(odd, bench))
    assert got == brute(texts_of(odd), [i for i in items if i[0] is not None])
    left = d.without_leaks(odd, bench)
    assert left.columns == odd.columns
    leaked = {i for i, _ in got}
    assert sorted(texts_of(left), key=repr) == sorted((r for r in texts_of(odd) if r[0] is None or r[0] not in leaked), key=repr)
    assert d.find_leaks(no_documents(spark), bench).count() == 0
    assert d.find_leaks(odd, bench.limit(0)).count() == 0
