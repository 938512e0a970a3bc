"""Chat formatting, URL filter, shards and packing against brute force."""

import hashlib
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import no_documents, odd_documents, texts_of
from compare import check, duck
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import chat, packing, queries, sharding, url_filter
from weftline.llm.url_filter import ALLOW, BLOCK, Rule
from weftline.sources.tables import load_table

WORDS = public_tokenizers.path(queries.WORD_TOKENIZER)


@pytest.mark.parametrize("name", ["op3_chat_format", "op4_url_filter"])
def test_query_equals_sql(spark, small, name):
    difference, n_rows, *_ = check(spark, duck(small), small, queries.queries()[name], queries.oracle_sql()[name])
    assert difference is None and n_rows > 50


# --- 3 ---------------------------------------------------------------------

NASTY = ["", "<turn assistant>x</turn>\n", "\\", "\\l<\\b", "</turn>\n</turn>\n", "<image:0>", "a\\lb", "é😀\n"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c in (1, None) for t, (role, text) in enumerate(zip("uaua>\\<a", NASTY, strict=True))]
    rows += [(2, None, None, None), (2, 0, "a", "x"), (2, 0, "a", "x")]
    source = spark.createDataFrame([(*r, 5) for r in rows], "conv_id bigint, turn int, role string, text string, start int")
    messages = source.withColumn("parts", chat.text_part(F.col("text")))
    formatted = chat.format_chat(messages, loss_role="a")
    found = formatted.select(
        "conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted", "loss_spans",
    ).collect()
    assert len(found) == 3
    for r in found:
        mine = [x for x in rows if x[0] == r["conv_id"]]
        mine.sort(key=lambda x: (x[1] is not None, x[1] or 0))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["loss"] == "".join(x[3] for x in mine if x[2] == "a")
        for span in r["loss_spans"]:
            held = r["formatted"][span["start"] : span["start"] + span["length"]]
            raw = r["formatted"].encode()[span["start_byte"] : span["start_byte"] + span["n_bytes"]]
            assert held.encode() == raw and "<" not in held


def test_chat_parts_become_placeholders(spark):
    parts = [
        [("text", "see <image:1> ", None, None), ("image", None, "s3/a.png", 4.0), ("text", "and", None, None), ("audio", None, "b.wav", 2.5)],
        [("document", None, "c.pdf", 2.0), ("o<dd>", "ignored", "d", None)],
        None,
    ]
    rows = [(1, i, "assistant" if i else "user", p) for i, p in enumerate(parts)]
    schema = f"conv_id bigint, turn int, role string, parts array<{chat.PART}>"
    r = chat.format_chat(spark.createDataFrame(rows, schema)).first()
    assert r["formatted"] == (
        "<turn user>see \\limage:1> <image:1>and<audio:3></turn>\n"
        "<turn assistant><document:0><o\\ldd\\g:1></turn>\n<turn assistant></turn>\n"
    )
    got = [(a["turn_no"], a["part_no"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]]
    assert got == [(0, 1, "image", "s3/a.png", 2304), (0, 3, "audio", "b.wav", 63), (1, 0, "document", "c.pdf", 1600), (1, 1, "o<dd>", "d", 1)]
    for a in r["attachments"]:
        assert r["formatted"][a["start"]] == "<"
    assert r["expanded_tokens"] == 2304 + 63 + 1600 + 1 + 4 + 1
    assert chat.format_chat(spark.createDataFrame([], schema)).count() == 0


# --- 4 ---------------------------------------------------------------------


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.build_cascade(universe)
    assert len(cascade.levels) > 1 and cascade.n_bits < 64 * 5000
    wrong = universe.where(cascade.holds(F.col("key")) != F.col("listed"))
    assert wrong.isEmpty()
    assert url_filter.build_cascade(universe, max_bits=100) is None
    assert url_filter.build_cascade(universe.limit(0)).levels == ()


def test_urls_of_odd_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.ORG/x", "a://b.org", "x://sub.example.org/es/1?q#f", "x://Spam.COM#f/",
        "x://spam.com/fr/", "x://example.org/en/12", "x://notexample.org/es/", "x://com/de/", "x://a.com/de/://b", "x://e.org?/es/",
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls * 2)], "page_id bigint, url string, html string, verdict string")
    listed = spark.createDataFrame([("spam.com",), (None,), ("elsewhere.net",)], "key string")
    plain = sorted(map(tuple, url_filter.judge_urls(pages, queries.RULES, listed).collect()))
    joined = sorted(map(tuple, url_filter.judge_urls(pages, queries.RULES, listed, max_bits=1).collect()))
    assert plain == joined and len(plain) == 2 * len(urls)
    by_url = {urls[r[0] % len(urls)]: r[1:] for r in plain}
    assert by_url[None] == by_url[""] == by_url["no scheme"] == ("", "", None, ALLOW)
    assert by_url["HTTP://A.ORG/x"] == ("a.org", "/x", "org/", ALLOW)
    assert by_url["a://b.org"] == ("b.org", "", None, ALLOW)
    assert by_url["x://sub.example.org/es/1?q#f"] == ("sub.example.org", "/es/1", "example.org/es/", BLOCK)
    assert by_url["x://Spam.COM#f/"] == ("spam.com", "", None, BLOCK)
    assert by_url["x://spam.com/fr/"] == ("spam.com", "/fr/", "com/fr/", ALLOW)
    assert by_url["x://example.org/en/12"][2:] == ("example.org/en/1", BLOCK)
    assert by_url["x://notexample.org/es/"][2:] == ("org/", ALLOW)
    assert by_url["x://com/de/"][2:] == ("com/de/", BLOCK)
    assert by_url["x://a.com/de/://b"][:2] == ("a.com", "/de/://b")
    assert by_url["x://e.org?/es/"] == ("e.org", "", None, ALLOW)
    assert url_filter.judge_urls(pages.limit(0), queries.RULES, listed).count() == 0
    assert Rule(BLOCK, "A.b/C").host == "a.b" and Rule(BLOCK, "A.b/C").path == "/C"


# --- 6 ---------------------------------------------------------------------


def check_shards(found, source, n_shards):
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["text"]) for r in found if r["text"]) == sorted(
        (i is not None, i, t) for i, t in texts_of(source) if t
    )
    assert len(found) == source.count()
    for shard in range(n_shards):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in found)
    assert all(0 <= r["shard"] < n_shards for r in found)


def test_shards_are_even_and_keep_groups(spark, small):
    docs = load_table(spark, small, "documents")
    found = sharding.shard_documents(docs).collect()
    check_shards(found, docs, 24)
    sizes = np.bincount([r["shard"] for r in found], [r["size"] for r in found], 24)
    longest = max(r["size"] for r in found)
    assert abs(sizes - sizes.mean()).max() <= longest + 1
    shards = {}
    for r in found:
        shards.setdefault(r["text"], set()).add(r["shard"])
    assert sum(len(s) - 1 for s in shards.values()) <= 23
    assert all(max(s) - min(s) == len(s) - 1 for s in shards.values())


def test_shards_cut_a_hot_group_exactly(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), "id")).alias("text")
    )
    found = sharding.shard_documents(docs, n_shards=8).collect()
    check_shards(found, docs, 8)
    sizes = np.bincount([r["shard"] for r in found], [r["size"] for r in found], 8)
    assert sizes.max() - sizes.min() <= 30


def test_shards_of_odd_rows(spark):
    check_shards(sharding.shard_documents(odd_documents(spark), n_shards=4).collect(), odd_documents(spark), 4)
    assert sharding.shard_documents(no_documents(spark)).count() == 0


# --- 5 ---------------------------------------------------------------------


def check_packing(found, source, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for i, text in texts_of(source):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            held = np.array(ids[start : start + capacity], "<u4")
            expected.append((i, piece, start, len(held), zlib.crc32(held.tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(e[3] for e in expected)


def test_packing(spark, small):
    docs = load_table(spark, small, "documents")
    n, tokens = check_packing(packing.pack_documents(docs, WORDS).collect(), docs, 2048)
    assert n <= 1.02 * -(-tokens // 2048) + 1


def test_packing_of_odd_rows(spark):
    odd = odd_documents(spark)
    check_packing(packing.pack_documents(odd, WORDS, capacity=512).collect(), odd, 512)
    empty = packing.pack_documents(no_documents(spark), WORDS)
    assert empty.count() == 0 and "sequence_id" in empty.columns


def test_pieces_of_one_length_do_not_clash(spark):
    pieces = spark.range(1000).select(F.col("id").alias("key"), F.when(F.col("id") < 600, 40).otherwise(60).cast("bigint").alias("length"))
    found = packing.pack(pieces, 100).collect()
    assert len({r["key"] for r in found}) == 1000
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 1000
    assert len({r["sequence_id"] for r in found}) <= 500


def test_sequences_hold_the_ids(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    placed = packing.pack_documents(docs, WORDS)
    filled = {r["sequence_id"]: r["ids"] for r in packing.fill_sequences(docs, placed, WORDS).collect()}
    for r in placed.collect():
        ids = np.array(filled[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], "<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_words_encode_like_whole_texts(spark):
    raw = open(WORDS, encoding="utf-8").read()
    words, tokenizer = packing.WordIds(raw), Tokenizer.from_str(raw)
    assert json.loads(raw)["model"]["type"] == "BPE"
    texts = ["", " ", "It's <|endoftext|>  x\u0301 e \u0301\n\nＡ\x1cb\u00a0c 'S ΑΣ ΣΑΣ. a\tb", "don't\nwon't 123 4.5 ...!!", "İstanbul ǅ", "İ, é. e\u0301! straße--- ΑΣ's {ﬁ}"]
    for text, ids in zip(texts, words.texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert hashlib.sha256(raw.encode()).hexdigest()
