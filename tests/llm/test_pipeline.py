"""The pipeline's stages against brute force over what the stage before kept."""

import corpus_pipeline
import pytest
from cases import no_documents, odd_documents, texts_of
from pyspark.sql import functions as F
from test_decontamination import brute as brute_leaks
from test_minhash import brute as brute_groups
from test_native_operators import check_packing
from test_text_operators import brute_lines

from weftline.llm import language
from weftline.llm.queries import language_model
from weftline.sources.tables import load_table, schema_of
from weftline.sources.workspace import stage


def ids(df):
    return sorted(i for i, _ in texts_of(df))


def test_stages_against_brute_force(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    kept = {}
    for name, step in steps.items():
        before = docs
        docs = stage(step(spark, docs, tiny), "stage")
        kept[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.schema == schema_of("documents")

    before, after = kept["language ID"]
    letters = [i for i, t in texts_of(before) if any(map(str.isalpha, t or ""))]
    assert ids(after) == sorted(letters)
    before, after = kept["line dedup"]
    assert sorted(texts_of(after)) == sorted((i, t) for i, _, _, t in brute_lines(texts_of(before)))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
    before, after = kept["MinHash near-dedup"]
    expected = [i for i, _, c, _ in brute_groups(texts_of(before), corpus_pipeline.NEAR_PERCENT) if i == c]
    assert ids(after) == sorted(expected) and len(expected) < before.count()
    before, after = kept["benchmark decontamination"]
    items = [tuple(r) for r in load_table(spark, tiny, "benchmark").collect()]
    leaked = {i for i, _ in brute_leaks(texts_of(before), items)}
    assert leaked and ids(after) == sorted(set(ids(before)) - leaked)
    before, after = kept["best-fit packing"]
    check_packing(after.collect(), before, 2048)


def test_texts_of_several_languages_stay(spark, tiny):
    docs = load_table(spark, tiny, "documents")
    by_lang = {r["lang"]: r["text"].split() for r in docs.where("n_chars > 400").collect()}
    assert len(by_lang) >= 3
    mixed = " ".join(w for _, words in sorted(by_lang.items()) for w in words[:40])
    own = docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("bigint"), "text": F.lit(mixed), "lang": F.lit(None).cast("string")})
    found = language.with_language(own, language_model(docs), "found").select("found.score").first()[0]
    assert found < 0.5
    assert -1 in ids(corpus_pipeline.language_stage(spark, docs.unionByName(own), tiny))


FOREIGN = [
    "съешь же ещё этих мягких французских булок да выпей чаю " * 5,
    "我们 的 朋友 今天 去 北京 " * 5,
    "ang lahat ng tao ay isinilang na malaya at pantay pantay sa karangalan at mga karapatan sila ay pinagkalooban ng katwiran",
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän",
    "xkq zzvt plomf grut wex hgfd qwrt vbnm " * 5,
]


@pytest.mark.parametrize("langs", [("de", "en", "es", "fr"), ("en",)])
def test_texts_of_unknown_languages_go(spark, small, langs):
    docs = load_table(spark, small, "documents").where(F.col("lang").isin(*langs))
    texts = [(-i, text) for i, text in enumerate(FOREIGN, 1)] + [(-10, "Keniloworthy"), (-11, "12 + 30"), (-12, None)]
    own = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "CAST(NULL AS string) lang", "'s' source", "CAST(1 AS bigint) n_chars"
    )
    kept = ids(corpus_pipeline.language_stage(spark, docs.unionByName(own, allowMissingColumns=True), small))
    letters = [i for i, t in texts_of(docs) if any(map(str.isalpha, t or ""))]
    assert kept == sorted([*letters, -10])  # a name alone is no evidence


def test_documents_pass_when_no_language_can_be_learned(spark, tiny):
    docs = load_table(spark, tiny, "documents").withColumn("lang", F.lit(None).cast("string"))
    assert ids(corpus_pipeline.language_stage(spark, docs, tiny)) == ids(docs)


@pytest.mark.parametrize("top", [7, 2**63 - 1])
def test_rows_without_an_id_are_judged(spark, tiny, top):
    item = load_table(spark, tiny, "benchmark").where("text IS NOT NULL").orderBy("item_id").first()["text"]
    words = " ".join(f"word{i}" for i in range(60))
    line = "a line of more than forty characters in five documents"
    texts = [(top, f"named {words}"), (None, f"named {words}"), (None, words[::-1]), (None, words[::-1]), (None, f"x {item}")]
    texts += [(None, f"{line}\n{n} alone") for n in range(5)]
    docs = stage(spark.createDataFrame([(*t, "en", "s", 0) for t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint"), "rows")
    cleaned = texts_of(corpus_pipeline.line_stage(spark, docs, tiny))
    assert sum(line in t for _, t in cleaned) == 1 and len(cleaned) == len(texts)
    assert sum(i is None for i, _ in cleaned) == len(texts) - 1
    once = [t for _, t in texts_of(corpus_pipeline.near_duplicate_stage(spark, docs, tiny))]
    assert once.count(f"named {words}") == once.count(words[::-1]) == 1
    left = texts_of(corpus_pipeline.decontamination_stage(spark, docs, tiny))
    assert sorted(left, key=repr) == sorted((t for t in texts if item not in t[1]), key=repr)


def test_run_gives_the_packed_pieces(spark, tiny):
    found = corpus_pipeline.run(spark, tiny)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 50


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_take_odd_rows(spark, tiny, make):
    docs = make(spark)
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, tiny), "stage")
        if name != "best-fit packing":
            assert after.columns == docs.columns
            assert after.count() <= docs.count()
            docs = after
    assert after.count() >= (make is odd_documents)
