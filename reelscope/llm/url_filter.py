"""URL filters by a Bloom filter cascade.

A rule is ``host suffix + path prefix``. Every url has candidate keys: each suffix of its host (cut at
dots) joined with each beginning of its path that is as long as some rule's path. The set of all
candidate keys of the corpus is the key universe. A cascade for one verdict holds Bloom filters in
turn: the first encodes the listed keys, the second those keys of the universe that the first lets
through wrongly, the third those listed keys that the second lets through wrongly, and so on until
nothing is let through wrongly. A key is listed exactly if the first level that rejects it is an
even one (counted from 1), or no level does and their number is odd: for keys of the universe the
answer is exact, and judging urls needs no join.

Only DataFrame functions are used. The bits of a level (a few bits per encoded key and log2 of the
universe's size) are gathered as 64-bit words; ``max_filter_words`` bounds them, because they are
part of every task's expression.

Null urls and urls without ``://`` have empty host and path, fit no rule and get the default verdict.
Repeated urls are judged alike. An empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (key, host part, path part) of a url, as an array of structs."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    starts = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: k <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda k: F.struct(
        F.concat(s, F.substring(path, F.lit(1), k)).alias("key"), s.alias("host"),
        F.substring(path, F.lit(1), k).alias("path")))))
    return F.when(host != "", pairs).otherwise(F.slice(pairs, 1, 0))


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def _passes(key: Column, level: Level) -> Column:
    words = F.array(*[F.lit(w).cast("long") for w in level.words])
    ok = F.lit(True)
    for p in _positions(key, level.bits, level.hashes, level.seed):
        word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
        ok = ok & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return ok


def build_level(keys: DataFrame, count: int, rate: float, seed: int, max_filter_words: int) -> Level:
    """A Bloom filter of the distinct ``key`` rows with false-positive rate about ``rate``."""
    hashes = max(1, min(30, round(-math.log2(rate))))
    bits = max(64, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
    if bits // 64 > max_filter_words:
        raise ValueError(f"a level of {bits // 64} words is beyond max_filter_words={max_filter_words}")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    rows = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("v")).collect()  # at most bits / 64 rows
    words = [0] * (bits // 64)
    for r in rows:
        words[r["w"]] = r["v"]
    return Level(bits, hashes, seed, tuple(words))


def build_cascade(listed: list[str], universe: DataFrame, universe_size: int, seed: int,
                  max_filter_words: int = 1 << 20, most_levels: int = 40) -> list[Level]:
    """Levels that tell the ``listed`` keys from all other keys (column ``key``) of ``universe``."""
    wanted = universe.sparkSession.createDataFrame([(k,) for k in listed], "key string")
    others = universe.where(~F.col("key").isin(listed))
    count, levels = len(listed), []
    rate = min(0.5, max(1e-9, count / (max(universe_size, 1) * math.sqrt(2))))
    while count and len(levels) < most_levels:
        level = build_level(wanted, count, rate, seed * 1000 + len(levels), max_filter_words)
        levels.append(level)
        wrong = stored(others.where(_passes(F.col("key"), level)).select("key").distinct())
        wanted, others, count, rate = wrong, wanted, wrong.count(), 0.5
    if count:
        raise RuntimeError("the cascade did not end")
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(~_passes(key, levels[i]), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
               max_filter_words: int = 1 << 20) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: the longest fitting rule (ties: the longer host,
    then block before allow). Columns of these names in ``pages`` are replaced."""
    host, path = host_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    lengths = sorted({len(r.path) for r in rules})
    if not rules:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    hosts = out.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
    universe = stored(hosts.select(F.explode(keys).alias("k")).select("k.key").distinct())
    size = universe.count()
    found = []
    for n, verdict in enumerate(sorted({r.verdict for r in rules}, key=lambda v: (v != "block", v))):
        own = sorted({r.key for r in rules if r.verdict == verdict})
        levels = build_cascade(own, universe, size, n + 1, max_filter_words)
        found.append((verdict, levels))

    def ranked(verdict: str, levels: list[Level], order: int) -> Column:
        own = F.filter(keys, lambda k: is_listed(k["key"], levels))
        return F.transform(own, lambda k: F.struct(F.length(k["key"]).alias("a"), F.length(k["host"]).alias("b"),
                                                   F.lit(order).alias("c"), k["key"].alias("rule"),
                                                   F.lit(verdict).alias("verdict")))

    fits = F.concat(*[ranked(v, levels, len(found) - n) for n, (v, levels) in enumerate(found)])
    best = F.array_max(fits)
    out = out.withColumn("__best", best)
    return (out.withColumn("rule", F.col("__best.rule"))
            .withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit(default))).drop("__best"))
