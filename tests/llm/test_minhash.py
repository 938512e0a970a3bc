"""Near-duplicate groups against all pairs of full sets."""

import random
import re
from collections import defaultdict

import pytest
from cases import no_documents, odd_documents, texts_of

from weftline.llm import minhash
from weftline.sources.tables import load_table


def brute(rows, percent=85):
    sets, inverted = [], defaultdict(set)
    for n, (_, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
        sets.append(found)
        for s in found:
            inverted[s].add(n)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for n, (i, _) in enumerate(rows):
        parent[find(n)] = find(first.setdefault(i, n)) if i is not None else find(n)
    for x, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for y in inverted[g]:
                if y < x:
                    shared[y] += 1
        for y, both in shared.items():
            if None not in (rows[x][0], rows[y][0]) and 100 * both >= percent * (len(s) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    out = [(i, len(sets[n]), least.get(find(n)) if i is not None else None) for n, (i, _) in enumerate(rows)]
    return sorted(((*r, r[0] is None or r[0] == r[2]) for r in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_groups_equal_all_pairs(spark, small):
    docs = load_table(spark, small, "documents")
    assert found(minhash.near_duplicates(docs)) == brute(texts_of(docs))


def test_groups_of_odd_rows(spark):
    odd = odd_documents(spark)
    assert found(minhash.near_duplicates(odd)) == brute(texts_of(odd))
    assert minhash.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(base[:140] + [f"end{i}"] * 3)) for i in range(30)]
    rows += [(5, " ".join(base)), (6, " ".join(base).upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(minhash.near_duplicates(docs)) == brute(rows)
    assert found(minhash.near_duplicates(docs, percent=95)) == brute(rows, 95)


def test_long_chains_are_one_group(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(500, 400)], "a bigint, b bigint"))
    got = {r["node"]: r["comp"] for r in minhash.connected(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


def test_threshold():
    assert minhash.match_threshold(85) == 40 or 38 <= minhash.match_threshold(85) <= 42
    assert minhash.match_threshold(80) < minhash.match_threshold(85)
