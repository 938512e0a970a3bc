import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cases import no_documents, odd_documents
from weftline.llm import queries, repeats
from weftline.llm.repeats import Sizes

SMALL = Sizes(length=20, trigger=4)


def brute(texts, length):
    """Every string of every text, counted."""
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(d[i : i + length] for _, d in data for i in range(len(d) - length + 1))
    out = []
    for doc_id, d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(d, gone[1:-1], strict=True) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, sizes, **options):
    found = repeats.remove_repeats(df, sizes, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def corpus(seed):
    """Copies, copies with an edit, shared passages of all lengths about the limit, runs
    of one letter, texts of one short period."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (4, 5, 6, 7, 12, 40)]
    texts = [prose(draw.randint(0, 60)) for _ in range(40)]
    for _ in range(40):
        base = draw.choice(texts)
        at = draw.randint(0, len(base))
        texts.append(base[:at] + draw.choice(["", "X", prose(3)]) + base[at + draw.randint(0, 2) :])
    for _ in range(60):
        texts.append(prose(draw.randint(0, 8)) + draw.choice(shared) + prose(draw.randint(0, 8)))
    texts += ["a" * n for n in (19, 20, 21, 100)] + ["ab" * 30 + prose(9), "x" + "ab" * 12, "abc" * 25]
    return list(enumerate(texts))


def table(spark, texts):
    return spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)


@pytest.mark.parametrize(("seed", "shard_phrases"), [(1, 1_000_000), (2, 60)])
def test_equals_brute_force(spark, seed, shard_phrases):
    texts = corpus(seed)
    found = removed(table(spark, texts), SMALL, shard_phrases=shard_phrases)
    expected = brute(texts, SMALL.length)
    assert found == expected
    assert 0 < sum(r[2] for r in expected) < sum(r[1] for r in expected)


def test_long_strings_on_documents(spark, tiny):
    docs = queries.documents(spark, tiny)
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 400)
    found = sorted((tuple(r) for r in queries.op12_repeated_strings(spark, tiny).collect()), key=repr)
    assert found == expected and any(r[2] for r in found)


def test_odd_rows(spark):
    odd = odd_documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert removed(odd, Sizes()) == brute(texts, 400)
    assert removed(odd, SMALL) == brute(texts, 20)


def test_kept_bytes(spark):
    texts = [(1, "-" * 5 + "q" * 3 + "0123456789abcdefghijklm"), (2, "z0123456789abcdefghijklm!")]
    kept = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(table(spark, texts), SMALL, with_text=True).collect()}
    assert kept == {1: b"-----qqq", 2: b"z!"}


def test_no_rows(spark):
    assert removed(no_documents(spark), Sizes()) == []


def test_shard_order_is_that_of_its_suffixes():
    draw = np.random.default_rng(4)
    runs = [draw.integers(1, 4, draw.integers(0, 9)).tolist() + [0] for _ in range(30)]
    codes = np.array([c for run in runs for c in run], np.int64)
    following = np.where(codes > 0, np.arange(len(codes)) + 1, -1)
    suffixes = [run[i:] for run in runs for i in range(len(run))]
    order = repeats.suffix_order(codes, following)
    assert [suffixes[i] for i in order] == sorted(suffixes)


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_samples_depend_on_the_string_alone(piece, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", piece)
    draw = np.random.default_rng(6)
    data = draw.integers(0, 3, 700).astype(np.uint8)
    copy = np.r_[draw.integers(0, 3, 41).astype(np.uint8), data[100:600]]
    (places, first, last, _), = repeats._samples_of(data, [(0, len(data))], SMALL)
    (other, first_, last_, _), = repeats._samples_of(copy, [(0, len(copy))], SMALL)
    at = {i: p for p, a, b in zip(places, first, last, strict=True) for i in range(a, b + 1)}
    at_ = {i: p for p, a, b in zip(other, first_, last_, strict=True) for i in range(a, b + 1)}
    assert sorted(at) == list(range(len(data) - SMALL.length + 1))
    for i in range(100, 580):
        assert i <= at[i] <= i + SMALL.places - 1
        assert at[i] - 100 == at_[i - 100 + 41] - 41
