"""Language identification by a linear-chain conditional random field over words.

Every word of a text is a position of the chain, its state is a language. A word's
features are its prefixes and suffixes, character n-grams and membership in small
per-language lexicons; transitions between languages are learned too. The
forward-backward algorithm gives each word its probability of each language, so
code-switched text is labelled word by word; a document's language is the one with
the largest share of its words.

Training uses a bounded sample of labelled rows: per language at most
``SAMPLE_DOCS`` documents (those of least id hash) and of each a window of
``SAMPLE_CHARS`` characters at a hashed place. Sequences are joined from runs of
different documents, so the transitions see switches. The model's size depends on
the number of languages only. Prediction reads whole texts in one pass without a
shuffle; chains are computed exactly in blocks, many at a time.

A text in a language the model never saw shows in its letter groups: the share of a
word's features that the sample holds, against that of a document of the sample among
the others (``familiarity``), tells it whatever the number of languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so
is everything when there are no labelled rows. Tokens without a letter take part
in the chain but have no vote. Only the id and the text are read in prediction, so
further columns change nothing; a repeated row is labelled each time, an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.memos import remembered

UNKNOWN = "und"
SAMPLE_DOCS = 300
SAMPLE_CHARS = 1200
LEXICON_WORDS = 300
HASH_BITS = 17
SEQUENCE = 40
MEAN_RUN = 15
STEPS = 40
RATE = 0.15
PENALTY = 1e-6
BLOCK = 32
MEMO = 300_000
POINTS_AT_ONCE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
WORDS_AT_ONCE = 200_000
EVIDENCE_WORDS = 5


# --- features --------------------------------------------------------------


def letters(token: str) -> str:
    return (token if token.isalpha() else "".join(filter(str.isalpha, token))).lower()


def _places(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers of 64-bit sums: the upper bits after mixing."""
    return (((hashes ^ (hashes >> np.uint64(29))) * SPREAD) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _grams(points: np.ndarray, first: np.ndarray, n: int, kind: int) -> np.ndarray:
    """Features of ``kind`` of the ``n`` code points from each place of ``first`` on."""
    hashes = np.full(len(first), kind, np.uint64)
    for k in range(n):
        hashes = hashes * MULTIPLIER + points[first + k]
    return _places(hashes)


def feature_blocks(words: list[str], known: dict[str, tuple[int, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of many words as pairs of arrays: feature, index of its word.

    Features are the word (its first 24 letters), prefixes and suffixes of one to
    four letters, all bigrams and trigrams, and the lexicons of ``known`` that hold
    the word. A word without letters has none. The features of a word come in the
    same order whatever words are beside it; an array holds about POINTS_AT_ONCE at most.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    held = [(1 << HASH_BITS) + i for word in words for i in known.get(word, ())]
    holder = [at for at, word in enumerate(words) for _ in known.get(word, ())]
    yield np.array(held, np.int64), np.array(holder, np.int64)
    whole = np.full(len(words), 1, np.uint64)
    for k in range(24):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        whole[longer] = whole[longer] * MULTIPLIER + points[first[longer] + k]
    some = np.flatnonzero(lengths)
    yield _places(whole[some]), some
    for n in range(1, 5):
        some = np.flatnonzero(lengths >= n)
        yield _grams(points, first[some], n, 2), some
        yield _grams(points, first[some] + lengths[some] - n, n, 3), some
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(first + lengths, lengths) - np.arange(len(points))
    for at in range(0, len(points), POINTS_AT_ONCE):
        for n in (2, 3):
            starts = at + np.flatnonzero(room[at : at + POINTS_AT_ONCE] >= n)
            yield _grams(points, starts, n, 4), owner[starts]


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    lexicons: tuple[frozenset[str], ...]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages
    seen: np.ndarray  # per feature, whether the sample holds it
    familiarity: float  # of a word of the sample, to the sample's other documents

    def known(self) -> dict[str, tuple[int, ...]]:
        """Word -> the lexicons that hold it."""
        return lexicon_numbers(self.lexicons)

    def word_scores(self, words: list[str], known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the weights of the features of each word (words x languages), and
        the share of its features that the sample holds."""
        scores = np.zeros((len(words), len(self.languages)))
        held, n = np.zeros(len(words)), np.zeros(len(words))
        for features, owner in feature_blocks(words, known):
            weights = self.weights[features]
            for k in range(scores.shape[1]):
                scores[:, k] += np.bincount(owner, weights[:, k], len(words))
            held += np.bincount(owner, self.seen[features], len(words))
            n += np.bincount(owner, None, len(words))
        return scores, held / np.maximum(n, 1)


def lexicon_numbers(lexicons: tuple[frozenset[str], ...]) -> dict[str, tuple[int, ...]]:
    numbers: dict[str, tuple[int, ...]] = {}
    for i, lexicon in enumerate(lexicons):
        for word in lexicon:
            numbers[word] = (*numbers.get(word, ()), i)
    return numbers


# --- the chain -------------------------------------------------------------


def chain_marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Word marginals of many chains laid end to end.

    Chains are cut into blocks. The product of a block's step matrices carries the
    messages across it, so blocks run side by side and only the short sequence of
    blocks of a chain is walked in order; the result equals one pass per chain.
    """
    n_states = transitions.shape[0]
    step = np.exp(transitions - transitions.max())
    n_blocks = -(-lengths // BLOCK)
    first_block = np.cumsum(n_blocks) - n_blocks
    total = int(n_blocks.sum())
    first_word = np.cumsum(lengths) - lengths
    chain_of_word = np.repeat(np.arange(len(lengths)), lengths)
    offset = np.arange(len(scores)) - first_word[chain_of_word]
    block_of_word = first_block[chain_of_word] + offset // BLOCK
    place = offset % BLOCK
    emit = np.ones((total, BLOCK, n_states))
    emit[block_of_word, place] = np.exp(scores - scores.max(1, keepdims=True))
    real = np.zeros((total, BLOCK), bool)
    real[block_of_word, place] = True

    through = np.broadcast_to(np.eye(n_states), (total, n_states, n_states)).copy()
    for t in range(BLOCK):
        moved = (through @ step) * emit[:, t, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        through = np.where(real[:, t, None, None], moved, through)

    entering = np.full((total, n_states), 1.0 / n_states)
    leaving = np.full((total, n_states), 1.0)
    order = np.argsort(-n_blocks, kind="stable")
    counts = n_blocks[order]
    for k in range(1, int(n_blocks.max(initial=0))):
        at = first_block[order[: np.searchsorted(-counts, -k, side="left")]] + k
        ahead = np.einsum("bi,bij->bj", entering[at - 1], through[at - 1])
        entering[at] = ahead / ahead.sum(1, keepdims=True)
    for k in range(int(n_blocks.max(initial=0)) - 1, 0, -1):
        at = first_block[order[: np.searchsorted(-counts, -k, side="left")]] + k
        back = np.einsum("bij,bj->bi", through[at], leaving[at])
        leaving[at - 1] = back / back.sum(1, keepdims=True)

    forward = np.empty_like(emit)
    message = entering
    for t in range(BLOCK):
        moved = (message @ step) * emit[:, t]
        moved /= moved.sum(1, keepdims=True)
        message = np.where(real[:, t, None], moved, message)
        forward[:, t] = message
    message = leaving
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= message
        moved = (emit[:, t] * message) @ step.T
        moved /= moved.sum(1, keepdims=True)
        message = np.where(real[:, t, None], moved, message)
    found = forward[block_of_word, place]
    return found / found.sum(1, keepdims=True)


# --- training --------------------------------------------------------------


def training_sample(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``lang, snippet``: at most SAMPLE_DOCS rows per language."""
    text = F.col(text_column)
    order = F.xxhash64(F.col(id_column))
    room = F.greatest(F.char_length(text) - SAMPLE_CHARS, F.lit(0)) + 1
    snippet = F.substring(text, (F.pmod(order, room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "snippet"))
    return (
        labelled.where(text.isNotNull() & F.col(lang_column).isNotNull())
        .select(F.col(lang_column).alias("lang"), order.alias("order"), snippet.alias("snippet"))
        .withColumn("rank", rank)
        .where(F.col("rank") <= SAMPLE_DOCS)
        .select("lang", "order", "snippet")
    )


def _sequences(words: list[list[list[int]]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Runs of documents of changing languages, cut into equal sequences."""
    left = [[(lang, doc) for doc in docs] for lang, docs in enumerate(words)]
    runs = []
    for lang, doc in (x for docs in left for x in docs):
        at = 0
        while at < len(doc):
            n = int(rng.geometric(1 / MEAN_RUN))
            runs.append((lang, doc[at : at + n]))
            at += n
    rng.shuffle(runs)
    flat = np.array([w for _, run in runs for w in run], np.int64)
    state = np.array([lang for lang, run in runs for _ in run], np.int64)
    n = max(1, len(flat) // SEQUENCE) * SEQUENCE
    pad = max(0, n - len(flat))  # fewer words than one sequence: repeat them
    flat, state = np.resize(flat, len(flat) + pad)[:n], np.resize(state, len(state) + pad)[:n]
    return flat.reshape(-1, SEQUENCE), state.reshape(-1, SEQUENCE)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def fit(sample: list[tuple[str, int, str]]) -> Model | None:
    """Maximum likelihood by Adam over all sequences; the same sample gives the same model."""
    sample = sorted(row for row in sample if letters(row[2]))
    if not sample:
        return None
    languages = sorted({lang for lang, *_ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    texts: list[list[list[str]]] = [[] for _ in languages]
    for lang, _, snippet in sample:
        texts[number[lang]].append([letters(token) for token in snippet.split()])
    counts = [Counter(w for doc in docs for w in doc if w) for docs in texts]
    lexicons = tuple(
        frozenset(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS]) for c in counts
    )
    vocabulary = {w: i for i, w in enumerate(sorted({w for docs in texts for doc in docs for w in doc}))}
    blocks = list(feature_blocks(list(vocabulary), lexicon_numbers(lexicons)))
    flat, owner = (np.concatenate(arrays) for arrays in zip(*blocks, strict=True))
    order = np.argsort(owner, kind="stable")
    flat, owner = flat[order], owner[order]
    lettered, starts = np.unique(owner, return_index=True)  # all but the word without letters
    by_vocabulary = np.zeros((len(vocabulary), len(languages)))
    words, states = _sequences(
        [[[vocabulary[w] for w in doc] for doc in docs] for docs in texts], np.random.default_rng(0)
    )

    n = len(languages)
    n_features = (1 << HASH_BITS) + n
    n_words = words.size
    weights, transitions = np.zeros((n_features, n)), np.zeros((n, n))
    moments = [np.zeros_like(x) for x in (weights, weights, transitions, transitions)]
    seen_words = np.bincount((words * n + states).ravel(), minlength=len(vocabulary) * n).reshape(-1, n)
    seen_moves = np.bincount((states[:, :-1] * n + states[:, 1:]).ravel(), minlength=n * n).reshape(n, n)
    for step in range(1, STEPS + 1):
        by_vocabulary[lettered] = np.add.reduceat(weights[flat], starts, axis=0)
        emission = by_vocabulary[words]
        alpha, beta = np.empty_like(emission), np.zeros_like(emission)
        alpha[:, 0] = emission[:, 0]
        for t in range(1, SEQUENCE):
            alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + transitions, 1) + emission[:, t]
        for t in range(SEQUENCE - 2, -1, -1):
            beta[:, t] = _log_sum(transitions + (emission[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        norm = _log_sum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - norm[:, None, None])
        moves = np.zeros((n, n))
        for t in range(SEQUENCE - 1):
            pair = alpha[:, t, :, None] + transitions + (emission[:, t + 1] + beta[:, t + 1])[:, None, :]
            moves += np.exp(pair - norm[:, None, None]).sum(0)
        expected = np.stack([np.bincount(words.ravel(), marginal[..., k].ravel(), len(vocabulary)) for k in range(n)], 1)
        by_word = (seen_words - expected) / n_words
        up = np.stack([np.bincount(flat, by_word[owner, k], n_features) for k in range(n)], 1)
        gradients = (up - PENALTY * weights, (seen_moves - moves) / n_words)
        for i, (value, gradient) in enumerate(zip((weights, transitions), gradients, strict=True)):
            mean, square = moments[2 * i], moments[2 * i + 1]
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient**2 - square)
            value += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    seen = np.bincount(flat, minlength=n_features) > 0
    documents = [[vocabulary[w] for w in doc if w] for docs in texts for doc in docs]
    familiarity = _familiarity(documents, flat, np.cumsum(np.bincount(owner, minlength=len(vocabulary))))
    return Model(tuple(languages), lexicons, weights.astype(np.float32), transitions, seen, familiarity)


def _familiarity(documents: list[list[int]], flat: np.ndarray, ends: np.ndarray) -> float:
    """Mean over all words of the share of their features that another document holds.
    The features of word ``w`` of the vocabulary end at place ``ends[w]`` of ``flat``."""

    def features(words: Iterable[int]) -> np.ndarray:
        return np.concatenate([flat[ends[w - 1] if w else 0 : ends[w]] for w in words] or [flat[:0]])

    holders = Counter()
    for words in documents:
        holders.update(np.unique(features(set(words))).tolist())
    shared = np.zeros(flat.max() + 1)
    shared[[f for f, n in holders.items() if n > 1]] = 1
    totals = np.r_[0.0, np.cumsum(shared[flat])]
    by_word = (totals[ends] - totals[np.r_[0, ends[:-1]]]) / np.maximum(np.diff(np.r_[0, ends]), 1)
    return float(by_word[[w for words in documents for w in words]].mean())


def train(labelled: DataFrame, **columns: str) -> Model | None:
    """Fit on the bounded sample; at most SAMPLE_DOCS rows per language are fetched."""
    rows = training_sample(labelled, **columns).collect()
    return fit([(r["lang"], r["order"], r["snippet"]) for r in rows])


# --- prediction ------------------------------------------------------------


class Labels(NamedTuple):
    """Per word its marginals, whether it has letters and the share of its features
    that the sample holds; per text its number of words."""

    marginals: np.ndarray
    votes: np.ndarray
    familiar: np.ndarray
    lengths: np.ndarray


class Labeller(dict):
    """Scores of words: token -> row of ``scores``. New tokens of many texts are
    scored together. Forgets all when it is full."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.known = model.known()
        self.scores = np.zeros((MEMO, len(model.languages)))
        self.votes = np.zeros(MEMO)
        self.familiar = np.zeros(MEMO)

    def learn(self, tokens: list[str]) -> None:
        """Give every token a row; ``tokens`` are at most MEMO."""
        new = set(tokens).difference(self)
        if len(self) + len(new) > MEMO:
            self.clear()
            new = set(tokens)
        fresh = list(new)
        words = [letters(token) for token in fresh]
        rows = slice(len(self), len(self) + len(fresh))
        self.scores[rows], self.familiar[rows] = self.model.word_scores(words, self.known)
        self.votes[rows] = [bool(word) for word in words]
        self.update(zip(fresh, range(rows.start, rows.stop), strict=True))

    def label(self, texts: list[list[str]]) -> Labels:
        lengths = np.array([len(t) for t in texts], np.int64)
        n = int(lengths.sum())
        scores, votes, familiar = np.empty((n, len(self.model.languages))), np.empty(n), np.empty(n)
        tokens = list(chain.from_iterable(texts))
        for at in range(0, n, MEMO // 2):
            some = tokens[at : at + MEMO // 2]
            self.learn(some)
            rows = np.fromiter(map(self.__getitem__, some), np.int64, len(some))
            here = slice(at, at + len(some))
            scores[here], votes[here], familiar[here] = self.scores[rows], self.votes[rows], self.familiar[rows]
        return Labels(chain_marginals(scores, lengths, self.model.transitions), votes, familiar, lengths)

    def in_groups(self, texts: pd.Series) -> Iterator[tuple[list[int], list[list[str]]]]:
        """Texts in groups of about WORDS_AT_ONCE words; a longer text is alone."""
        group, places, n = [], [], 0
        for i, text in enumerate(texts):
            tokens = text.split() if text else []
            if group and n + len(tokens) > WORDS_AT_ONCE:
                yield places, group
                group, places, n = [], [], 0
            group.append(tokens)
            places.append(i)
            n += len(tokens)
        if group:
            yield places, group


def _labeller(shared) -> Labeller:
    """One per model and Python worker, kept between tasks."""
    return remembered((Labeller, shared.id), lambda: Labeller(shared.value))


class _Shared:
    """A broadcast model with a name that outlives pickling."""

    def __init__(self, broadcast, name: str) -> None:
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> Model:
        return self.broadcast.value


def _share(docs: DataFrame, model: Model | None) -> _Shared:
    context = docs.sparkSession.sparkContext
    broadcast = context.broadcast(model)
    name = zlib.crc32(model.weights.tobytes()) if model else 0
    return _Shared(broadcast, f"{context.applicationId}-{name}")


def with_language(
    docs: DataFrame, model: Model | None, name: str = "language", text_column: str = "text", evidence: bool = False
) -> DataFrame:
    """``docs`` and a column ``name``: struct(lang, score, n_words), on demand with
    ``evidence``: ``certainty``, the mean over the words with letters of the largest
    probability of a language, and ``familiarity``, the mean share of their features
    that the training sample holds, as a part of what it is for a document of the
    sample among the others. ``EVIDENCE_WORDS`` expected words are added to that mean,
    so that a name alone does not make a text foreign."""
    shared = _share(docs, model)

    @F.pandas_udf(
        "lang string, score double, n_words bigint"
        + (", certainty double, familiarity double" if evidence else "")
    )
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, shares, n_words = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            sure, familiar = np.zeros(len(texts)), np.zeros(len(texts))
            if shared.value is not None:
                labeller = _labeller(shared)
                names = shared.value.languages
                for places, group in labeller.in_groups(texts):
                    marginals, votes, held, lengths = labeller.label(group)
                    owner = np.repeat(np.arange(len(lengths)), lengths)
                    n = np.bincount(owner, votes, len(lengths))
                    share = np.stack(
                        [np.bincount(owner, votes * marginals[:, k], len(lengths)) for k in range(len(names))], 1
                    )
                    best = share.argmax(1)
                    if evidence:
                        most = np.bincount(owner, votes * marginals.max(1), len(lengths))
                        sure[places] = np.minimum(1.0, most / np.maximum(n, 1))
                        expected = shared.value.familiarity
                        familiar[places] = (
                            (np.bincount(owner, held, len(lengths)) + EVIDENCE_WORDS * expected)
                            / (n + EVIDENCE_WORDS)
                            / expected
                            if expected
                            else 1.0
                        )
                    for i, place in enumerate(places):
                        n_words[place] = lengths[i]
                        if n[i]:
                            langs[place] = names[best[i]]
                            shares[place] = min(1.0, share[i, best[i]] / n[i])
            found = pd.DataFrame({"lang": langs, "score": shares, "n_words": n_words})
            yield found.assign(certainty=sure, familiarity=familiar) if evidence else found

    return docs.withColumn(name, predict(F.col(text_column)))


def identify_languages(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, n_words`` of every document."""
    found = with_language(docs.select(id_column, text_column), model, "found__", text_column)
    return found.select(
        id_column,
        F.col("found__.lang").alias("lang_pred"),
        F.col("found__.score").alias("score"),
        F.col("found__.n_words").alias("n_words"),
    )


def language_spans(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of words of one language: ``doc_id, first_word, n_words, lang, score``.

    Words are the text's pieces between white space. Documents without words have
    no run."""
    shared = _share(docs, model)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = _labeller(shared)
        names = np.array(shared.value.languages, object)
        for batch in batches:
            ids = batch["id"].astype("Int64")
            for places, group in labeller.in_groups(batch["text"]):
                marginals, _, _, lengths = labeller.label(group)
                best = marginals.argmax(1)
                owner = np.repeat(np.arange(len(lengths)), lengths)
                starts = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])][: len(best)])
                sizes = np.diff(np.r_[starts, len(best)])
                first = np.cumsum(lengths) - lengths
                sure = np.add.reduceat(marginals.max(1), starts) / sizes if len(starts) else np.zeros(0)
                yield pd.DataFrame(
                    {
                        id_column: ids.iloc[np.array(places)[owner[starts]]].to_numpy(),
                        "first_word": starts - first[owner[starts]],
                        "n_words": sizes,
                        "lang": names[best[starts]],
                        "score": sure,
                    }
                ).astype({id_column: "Int64"})

    schema = f"`{id_column}` bigint, first_word bigint, n_words bigint, lang string, score double"
    held = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    return held.mapInPandas(spans, schema)
