"""The registered queries over a whole small table, against plain Python or DuckDB."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from compare import check, duck
from conftest import rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import lines, queries
from weftline.sources.tables import load_table


@pytest.fixture(scope="module")
def texts(spark, tiny):
    found = load_table(spark, tiny, "documents").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in found}


@pytest.mark.parametrize("size", ["tiny", "small"])
def test_groups_equal_sql(spark, request, size):
    sf_dir = request.getfixturevalue(size)
    difference, n, *_ = check(spark, duck(sf_dir), sf_dir, queries.op9_minhash_groups, queries.GROUPS_SQL)
    assert difference is None and n > 0


def test_pieces_hold_the_ids_of_the_library(spark, tiny, texts):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path(queries.WORD_TOKENIZER)))
    pieces, places = defaultdict(dict), defaultdict(list)
    for r in queries.op5_best_fit_packing(spark, tiny).collect():
        pieces[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        cuts = [ids[at : at + 2048] for at in range(0, len(ids), 2048)]
        found = [pieces[doc_id][i] for i in range(len(pieces[doc_id]))]
        assert [(r.start, r.length) for r in found] == [(2048 * i, len(c)) for i, c in enumerate(cuts)]
        assert [r.ids_crc32 for r in found] == [zlib.crc32(struct.pack(f"<{len(c)}I", *c)) for c in cuts]
    for held in places.values():
        held.sort()
        assert [at for at, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))]
        assert sum(n for _, n in held) <= 2048


def test_shards_keep_their_law(spark, tiny, texts):
    found = queries.op6_histogram_shards(spark, tiny).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    sizes, slots, n_texts = Counter(), defaultdict(list), Counter()
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) <= set(range(24)) and sum(sizes.values()) == sum(r["size"] for r in found)
    assert max(sizes.values()) <= sum(sizes.values()) / 24 + max(r["size"] for r in found)
    assert all(sorted(held) == list(range(len(held))) for held in slots.values())


def test_tokens_are_those_of_the_library(spark, tiny, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path(queries.PIECE_TOKENIZER)))
    expected = []
    for doc_id, text in sorted(texts.items()):
        n = len(model.encode(text))
        expected.append((doc_id, len(text.encode()), n, n > 4096))
    got = queries.op7_token_counts(spark, tiny).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows(got, "doc_id") == expected


def test_edited_texts_and_equal_fingerprints(spark, tiny, texts):
    ids = sorted(texts)
    following = dict(zip(ids, [*ids[1:], ids[0]], strict=True))
    by_text = defaultdict(set)
    for r in queries.op10_fingerprints(spark, tiny).collect():
        text, other = texts[r.doc_id], texts[following[r.doc_id]]
        n = len(text) // 4
        edited = text[: len(text) - n] + other[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[text].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len(set.union(*by_text.values())) == len(by_text)


def test_lines_beside_columns_of_the_same_names(spark):
    line = "a line of more than forty characters that many documents hold"
    docs = spark.range(1, 8).selectExpr("id AS doc_id", f"'{line}' AS text", "1 AS dropped__", "2 AS Rewritten__", "3 AS dropped_id__")
    found = lines.dedup_lines(docs, name="found")
    assert found.columns == [*docs.columns, "found"]
    got = rows(found.select("doc_id", "dropped__", "Rewritten__", "dropped_id__", F.col("found.n_dropped")), "doc_id")
    assert got == [(i, 1, 2, 3, int(i < 7)) for i in range(1, 8)]
