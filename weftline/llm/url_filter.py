"""URL filters: host and path rules, and an exact list test by a Bloom filter cascade.

A cascade knows the complete universe of keys of a corpus. Level 0 is a Bloom
filter of the listed keys, level 1 one of the unlisted keys that level 0 lets
through, level 2 one of the listed keys that level 1 lets through, and so on
until a level lets nothing wrong through. A key of the universe is decided by the
first level that turns it away, so membership is exact and needs no join: the
levels are constants of the plan.

The filters are bounded by ``max_bits``. A list too long for that is answered by
a join on the key instead, since such filters must not travel with every task.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, fits no rule and is never listed. Repeated pages are judged one by
one. Only the id and the URL of a page are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.workspace import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALLOW, BLOCK = "allow", "block"
BITS_PER_KEY = 10
N_HASHES = 4
MAX_BITS = 1 << 26
MAX_LEVELS = 64


def url_host(url: Column) -> Column:
    at = F.locate("://", url)
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1)
    found = F.translate(host, UPPER, UPPER.lower())
    return F.when(url.isNotNull() & (at > 0), found).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    at = F.locate("://", url)
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNotNull() & (at > 0), path).otherwise(F.lit(""))


# --- rules -----------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, then a path from its first slash on."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        _, slash, rest = self.text.partition("/")
        return slash + rest

    def fits(self, host: Column, path: Column) -> Column:
        at_host = (host == self.host) | host.endswith("." + self.host)
        return at_host & path.startswith(self.path)


def matching_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null. Rules of one
    length: the longer host first, then ``block`` before ``allow``."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != BLOCK))
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(
        *(
            F.when(
                r.fits(host, path),
                F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
            )
            for r in ordered
        ),
        empty,
    )


# --- cascade ---------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    number: int
    n_bits: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        seeds = (F.lit(self.number * N_HASHES + i) for i in range(N_HASHES))
        return [F.pmod(F.xxhash64(seed, key), F.lit(self.n_bits)) for seed in seeds]

    def lets_through(self, key: Column) -> Column:
        # a constant of the plan: the optimiser folds it into one array
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        through = F.lit(True)
        for position in self.positions(key):
            word = F.get(words, F.shiftright(position, 6).cast("int"))
            through = through & (F.bit_get(word, F.pmod(position, F.lit(64)).cast("int")) == 1)
        return through


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            turned_away = F.lit(level.number % 2 == 1)
            answer = F.when(level.lets_through(key), answer).otherwise(turned_away)
        return answer

    @property
    def n_bits(self) -> int:
        return sum(level.n_bits for level in self.levels)


def _level(number: int, keys: DataFrame, n_keys: int) -> Level:
    n_bits = 64 * max(1, math.ceil(n_keys * BITS_PER_KEY / 64))
    empty = Level(number, n_bits, ())
    words = (
        keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("position"))
        .groupBy(F.shiftright("position", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(position, 64) AS int))")).alias("bits"))
    )
    filled = [0] * (n_bits // 64)
    for row in words.collect():  # at most n_bits / 64 rows
        filled[row["word"]] = row["bits"]
    return Level(number, n_bits, tuple(filled))


def build_cascade(universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """Cascade over ``universe`` (distinct ``key``, ``listed``); None when its
    filters would pass ``max_bits``."""
    levels: list[Level] = []
    bits = 0
    while True:
        held = universe.where(F.col("listed") == F.lit(len(levels) % 2 == 0))
        for level in levels:
            held = held.where(level.lets_through(F.col("key")))
        n_keys = held.count()
        if n_keys == 0:
            return Cascade(tuple(levels))
        bits += n_keys * BITS_PER_KEY
        if bits > max_bits:
            return None
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: keys repeat in the universe")
        levels.append(_level(len(levels), held, n_keys))


def key_universe(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Every distinct ``key`` of the corpus with whether it is ``listed``."""
    flags = keys.select("key", F.lit(0).alias("flag")).unionByName(
        listed.select("key", F.lit(1).alias("flag"))
    )
    universe = flags.where("key IS NOT NULL").groupBy("key").agg(F.max("flag").alias("flag"))
    return universe.select("key", (F.col("flag") == 1).alias("listed"))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    listed_hosts: DataFrame,
    max_bits: int = MAX_BITS,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    The longest fitting rule decides; without one the page is blocked when its
    host is in ``listed_hosts`` (column ``key``).
    """
    url = F.col(url_column)
    parsed = pages.select(F.col(id_column), url_host(url).alias("host"), url_path(url).alias("path"))
    hosts = parsed.where("host <> ''").select(F.col("host").alias("key"))
    universe = stage(key_universe(hosts, listed_hosts), "url-keys")
    cascade = build_cascade(universe, max_bits)
    if cascade is not None:
        judged = parsed.withColumn("listed", cascade.holds(F.col("host")) & (F.col("host") != ""))
    else:
        keys = universe.where("listed").select(F.col("key").alias("host"), "listed")
        judged = parsed.join(keys, "host", "left")
    match = matching_rule(rules, F.col("host"), F.col("path"))
    default = F.when(F.coalesce("listed", F.lit(False)), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.withColumn("match", match).select(
        id_column,
        "host",
        "path",
        F.col("match.rule").alias("rule"),
        F.coalesce("match.verdict", default).alias("verdict"),
    )
