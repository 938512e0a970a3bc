"""The registered queries of these operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import (
    chat, decontamination, fingerprints, language, lines, minhash, negatives, packing, phrases, repeats, sharding, token_counts,
    url_filter,
)
from weftline.llm.url_filter import ALLOW, BLOCK, Rule
from weftline.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]

HELD_OUT_FOLDS = 5
RULES = [
    Rule(ALLOW, "org/"),
    Rule(BLOCK, "example.org/es/"),
    Rule(BLOCK, "example.org/en/1"),
    Rule(ALLOW, "com/fr/"),
    Rule(BLOCK, "com/de/"),
]
BLOCKED_TERMS = ("ads", "adult", "bets", "casino", "pills", "spam")
BLOCKED_HOST = rf"(^|[.-])({'|'.join(BLOCKED_TERMS)})([.-]|$)"
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


# --- 1 decontamination -----------------------------------------------------


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir), load_table(spark, sf_dir, "benchmark"))


# --- 2 language ------------------------------------------------------------


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_FOLDS == 0


def language_model(docs: DataFrame) -> language.Model | None:
    """Learned from the documents that are not held out."""
    return language.train(docs.where(~held_out()))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify_languages(docs, language_model(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words")


# --- 3 chat ----------------------------------------------------------------

EXTRA_CONVERSATION = -7
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = load_table(spark, sf_dir, "conversations")
    turn = F.col("id")
    extra = spark.range(2).select(
        F.lit(EXTRA_CONVERSATION).cast("bigint").alias("conv_id"),
        turn.alias("turn"),
        F.when(turn == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    messages = held.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    formatted = chat.format_chat(messages)
    read = formatted.select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        "expanded_tokens",
    )
    lines_ = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines_, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPED = r"replace(replace({0}, '\', '\b'), '<', '\l')"
CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_CONVERSATION}, 0, 'user', '{EXTRA_TEXT}'
  UNION ALL SELECT {EXTRA_CONVERSATION}, 1, 'assistant', '{EXTRA_TEXT}'
)
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn >') + length('</turn>' || chr(10)) + length(replace({_ESCAPED.format("role")}, '>', '\g'))
      + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


# --- 4 URLs ----------------------------------------------------------------


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed hosts are those of the corpus with a blocked term as a part of their name."""
    pages = load_table(spark, sf_dir, "pages")
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("key"))
    listed = hosts.where(F.col("key").rlike(BLOCKED_HOST)).distinct()
    return url_filter.judge_urls(pages, RULES, listed)


def _rule_sql() -> str:
    cases = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    blocked = ", ".join(f"'{r.text}'" for r in RULES if r.verdict == BLOCK)
    return f"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
{cases}
  END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ({blocked}) THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '{BLOCKED_HOST}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


# --- 5 packing, 6 shards, 7 tokens -----------------------------------------


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(documents(spark, sf_dir), n_shards=24)
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECE_TOKENIZER))


# --- 8 lines, 10 fingerprints ----------------------------------------------


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "kept.n_lines", "kept.n_dropped", F.sha2("kept.text", 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split
), frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, coalesce(k.doc_id < f.last_doc, false) AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op9_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


# Every pair of documents that share a shingle, counted exactly.
GROUPS_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END)) AS s
  FROM worded
), sizes AS (
  SELECT d.doc_id, count(s)::BIGINT AS n FROM documents d LEFT JOIN shingles x ON d.doc_id = x.doc_id GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * k >= 85 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id AS root, doc_id AS node FROM documents
  UNION
  SELECT root, b FROM reach JOIN links ON node = a
)
SELECT doc_id, n AS n_shingles, min(root) AS component_id, min(root) = doc_id AS kept
FROM sizes JOIN reach ON node = doc_id GROUP BY doc_id, n
"""


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


# --- 11 negatives ----------------------------------------------------------


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = load_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


NEGATIVES_SQL = f"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES}
)
SELECT p.anchor_id, positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
QUALIFY rank <= {negatives.NEGATIVES}
"""


# --- 12 repeated strings ---------------------------------------------------


def op12_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


# --- 13 phrases ------------------------------------------------------------


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


PHRASES_SQL = rf"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), cut AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM cut
), totals AS (
  SELECT lang, sum(len(words))::HUGEINT AS n FROM pieces GROUP BY lang
), starts AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
  FROM pieces, (SELECT unnest(range(1, {phrases.MAX_WORDS + 1})) AS k) WHERE len(words) >= k
), frequent AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM starts GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS c FROM frequent WHERE k > 1
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.c, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:c.c], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[c.c + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), covered AS (
  SELECT DISTINCT s.lang, s.phrase FROM frequent s JOIN frequent b
    ON s.lang = b.lang AND s.k > 1 AND b.k > s.k AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
    AND 100 * b.f >= {phrases.PERCENT} * s.f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest ANTI JOIN covered USING (lang, phrase)
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {phrases.TOP}
"""


# --- contract --------------------------------------------------------------


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_language_id": op2_language_id,
        "op3_chat_format": op3_chat_format,
        "op4_url_filter": op4_url_filter,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_histogram_shards": op6_histogram_shards,
        "op7_token_counts": op7_token_counts,
        "op8_line_dedup": op8_line_dedup,
        "op9_minhash_groups": op9_minhash_groups,
        "op10_fingerprints": op10_fingerprints,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_repeated_strings": op12_repeated_strings,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_chat_format": CHAT_SQL,
        "op4_url_filter": _rule_sql(),
        "op8_line_dedup": LINES_SQL,
        "op9_minhash_groups": GROUPS_SQL,
        "op11_hard_negatives": NEGATIVES_SQL,
        "op13_phrases": PHRASES_SQL,
    }
