"""Languages, token counts, fingerprints and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import LINE, no_documents, odd_documents, texts_of
from compare import check, duck

from weftline.llm import fingerprints, language, lines, queries, token_counts
from weftline.sources.tables import load_table

MODEL = public_tokenizers.path(queries.PIECE_TOKENIZER)


@pytest.fixture(scope="module")
def docs(spark, small):
    return load_table(spark, small, "documents")


# --- 2 ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(docs):
    return queries.language_model(docs)


def test_language_of_held_out_documents(spark, small, docs):
    found = queries.op2_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == docs.count()
    held = found[found["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([1, 3, 0, 5])
    scores, moves = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    found = language.chain_marginals(scores, lengths, moves)
    at = 0
    for n in lengths:
        expected = np.zeros((n, 2))
        for path in np.ndindex(*[2] * n) if n else []:
            # a uniform state before the first word leads into it
            weight = np.exp(moves[:, path[0]]).sum() * np.exp(sum(scores[at + t, s] for t, s in enumerate(path)))
            weight *= np.exp(sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, s in enumerate(path):
                expected[t, s] += weight
        if n:
            assert np.allclose(found[at : at + n], expected / expected.sum(1, keepdims=True))
        at += n


def test_blocks_do_not_change_the_chain(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.array([100, 7, 64, 33])
    scores, moves = rng.normal(size=(lengths.sum(), 3)) * 3, rng.normal(size=(3, 3))
    found = language.chain_marginals(scores, lengths, moves)
    monkeypatch.setattr(language, "BLOCK", 5)
    assert np.allclose(found, language.chain_marginals(scores, lengths, moves))


def test_features_of_words_beside_each_other():
    words = ["", "a", "été", "under", "an" * 40, "under", "wörter" * 9]
    known = {"under": (0, 2)}
    beside = [[] for _ in words]
    for features, owner in language.feature_blocks(words, known):
        for f, i in zip(features.tolist(), owner.tolist(), strict=True):
            beside[i].append(f)
    for word, found in zip(words, beside, strict=True):
        alone = [f for features, _ in language.feature_blocks([word], known) for f in features.tolist()]
        assert found == alone
        n = len(word)
        assert len(found) == bool(n) + 2 * min(4, n) + max(0, n - 1) + max(0, n - 2) + len(known.get(word, ()))
    assert beside[3] == beside[5] and len(set(beside[4])) < len(beside[4])


def test_long_texts_are_cut_into_blocks(monkeypatch, model):
    words = ["these", "der", "les", "palabra", "the" * 500, ""]
    whole = model.word_scores(words, model.known())
    monkeypatch.setattr(language, "POINTS_AT_ONCE", 7)
    cut = model.word_scores(words, model.known())
    assert all(np.allclose(a, b) for a, b in zip(whole, cut, strict=True))


def test_code_switched_words_are_labelled(spark, docs, model):
    by_lang = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.where("n_chars > 600").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, f"{by_lang['en']} {by_lang['de']} {by_lang['es']}"), (2, None)], "doc_id bigint, text string")
    spans = language.language_spans(mixed, model).orderBy("first_word").toPandas()
    labels = np.repeat(spans["lang"].to_numpy(), spans["n_words"].to_numpy())
    assert len(labels) == 120
    assert (labels == np.repeat(["en", "de", "es"], 40)).mean() > 0.9


def test_languages_of_odd_rows(spark, model):
    found = language.identify_languages(odd_documents(spark), model).toPandas()
    assert len(found) == len(texts_of(odd_documents(spark)))
    none = found[found["doc_id"].isin([1, 2, 3, 4])]
    assert (none["lang_pred"] == "und").all() and (none["score"] == 0).all()
    assert language.train(no_documents(spark)) is None
    untrained = language.identify_languages(odd_documents(spark), None).toPandas()
    assert (untrained["lang_pred"] == "und").all()
    assert language.identify_languages(no_documents(spark), model).count() == 0


# --- 7 ---------------------------------------------------------------------


def test_token_counts_equal_the_library(docs):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    expected = {i: (len(t.encode()), len(processor.encode(t))) for i, t in texts_of(docs)}
    found = token_counts.count_tokens(docs, MODEL).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in found} == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in found)


def test_token_counts_of_strange_texts(spark):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = token_counts.TokenCounter(open(MODEL, "rb").read())
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "▁", "the", "é", "中", "<s>", "</s>", "<0x0A>", ".", "\u00a0", "😀", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert counter.count(text) == len(processor.encode(text)), repr(text)
    expected = sorted(len(processor.encode(t or "")) for _, t in texts_of(odd_documents(spark)))
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(odd_documents(spark), MODEL).collect()) == expected
    assert token_counts.count_tokens(no_documents(spark), MODEL).count() == 0


# --- 8 ---------------------------------------------------------------------


def brute_lines(rows):
    space = " \t\n\r\x0b\x0c"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(space))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        stay = [x for x in all_ if i is None or not (len(h := holders.get(key(x), set())) >= 5 and i < max(h))]
        out.append((i, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def cleaned(df):
    found = df.select("doc_id", "kept.n_lines", "kept.n_dropped", "kept.text").collect()
    return sorted((tuple(r) for r in found), key=repr)


def test_lines_equal_sql(spark, small):
    difference, n_rows, *_ = check(spark, duck(small), small, queries.op8_line_dedup, queries.LINES_SQL)
    assert difference is None and n_rows == 1000


def test_lines_of_odd_rows(spark):
    odd = odd_documents(spark)
    found = lines.dedup_lines(odd)
    assert cleaned(found) == brute_lines(texts_of(odd))
    assert set(odd.columns) < set(found.columns)
    assert lines.dedup_lines(no_documents(spark)).count() == 0


def test_lines_are_incremental_and_reversible(spark):
    odd = odd_documents(spark).where("doc_id IS NOT NULL")
    more = spark.createDataFrame([(20, f"{LINE}\nnew"), (21, LINE)], "doc_id bigint, text string")
    index = lines.build_index(odd)
    grown = index.insert(more)
    together = odd.select("doc_id", "text").unionByName(more)
    assert cleaned(grown.clean(together)) == brute_lines(texts_of(together))
    back = grown.delete(more.select("doc_id"))
    assert cleaned(back.clean(odd)) == cleaned(index.clean(odd))
    state = lambda x: sorted(map(tuple, x.counts.collect()), key=repr)
    assert state(back) == state(index)
    few = index.delete(spark.createDataFrame([(7,), (8,)], "doc_id bigint"))
    rest = odd.where("doc_id NOT IN (7, 8)")
    assert cleaned(few.clean(rest)) == brute_lines(texts_of(rest))
    bits = few.filters.collect()
    keys = [lines.line_key(LINE.encode())]
    assert not any(lines.CuckooFilter.from_bytes(r["bits"]).contains(lines._key_array(keys))[0] for r in bits)


def test_cuckoo_filter():
    keys = [hashlib.blake2b(bytes([i % 256, i // 256]), digest_size=16).digest() for i in range(5000)]
    held = lines.CuckooFilter.from_bytes(lines._built(keys[:3000]))
    assert held.contains(lines._key_array(keys[:3000])).all()
    assert held.contains(lines._key_array(keys[3000:])).mean() < 0.01
    held.delete(lines._key_array(keys[:1500]))
    assert held.contains(lines._key_array(keys[1500:3000])).all()
    assert held.contains(lines._key_array(keys[:1500])).mean() < 0.01
    assert not lines.CuckooFilter.sized_for(10).insert(lines._key_array(keys))


# --- 10 --------------------------------------------------------------------


def test_fingerprints_against_brute_force(spark, docs):
    for source in (docs, odd_documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        rows = sorted((i, t or "") for i, t in texts_of(source))
        found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(source).collect()}
        assert len(found) == len(rows)
        for (i, text), (following_id, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            r, n = found[i], len(text) // 4
            edited = text[: len(text) - n] + following[:n]
            assert r["n_chars"] == len(text)
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = (fingerprints.of_text(t) for t in (text, edited, following))
            assert r["near_edited"] == pytest.approx(a.likeness(b)) and r["near_next"] == pytest.approx(a.likeness(c))
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
            assert (found[following_id]["fingerprint"] == r["fingerprint"]) == (text == following)


def test_fingerprints_tell_edits_from_strangers(docs):
    found = fingerprints.fingerprint_documents(docs.where("n_chars > 400")).toPandas()
    assert found["near_edited"].median() > 0.6 and found["near_next"].median() < 0.3


def test_fingerprints_ignore_order_and_take_updates():
    a, b, c = "first line here", "second line", "third one\ttoo"
    whole = fingerprints.of_text(f"{a}\n{b}\n{c}")
    assert whole.to_bytes() == fingerprints.of_text(f"{c}\n{a}\n{b}").to_bytes()
    assert whole.minus(fingerprints.of_paragraphs([b])).to_bytes() == fingerprints.of_text(f"{a}\n{c}").to_bytes()
    assert whole.to_bytes() != fingerprints.of_text(f"{a}\n{b}\n{b}\n{c}").to_bytes()
    assert fingerprints.Vector.from_bytes(whole.to_bytes()).likeness(whole) == 1.0


@pytest.mark.parametrize("n", [30_000, 40_000, 66_000, 131_000])
def test_likeness_of_long_repetitive_texts(n):
    text = " ".join(["again"] * n)
    edited = fingerprints.edit(text, " ".join(["other"] * n))
    whole, changed = fingerprints.of_text(text), fingerprints.of_text(edited)
    held = fingerprints.Vector.from_bytes(changed.to_bytes())
    # equal pairs fill one lane with n - 1, and n / 4 of them are replaced by as many of another
    kept, new = 3 * n // 4, n // 4
    assert whole.likeness(held) == pytest.approx(1 - 2 * new**2 / (n**2 + kept**2 + new**2), abs=1e-3)
    assert fingerprints.edited_vector(whole, text, edited).to_bytes() == changed.to_bytes()


def test_fingerprints_of_odd_rows(spark):
    found = fingerprints.fingerprint_documents(odd_documents(spark))
    assert found.count() == len(texts_of(odd_documents(spark)))
    assert fingerprints.fingerprint_documents(no_documents(spark)).count() == 0
