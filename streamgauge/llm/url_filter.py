"""URL filters by a cascade of Bloom filters (operator 3). DataFrame operations only.

A list of domains blocks its hosts and all their subdomains. Which of the corpus's hosts it covers is found once, on the
distinct hosts, by a hash join of their suffixes with the list. A cascade then answers exactly, for every key of a known
universe, whether the key is covered. Level 1 holds the covered keys. Level 2 holds the other keys that level 1 lets
through, level 3 the covered keys that level 2 lets through, and so on until a level lets nothing wrong through. A key's
answer is the parity of the first level that misses it. The universe is every distinct host of the corpus, so no page
needs a join.

A filter is an array of 64-bit words, read by tasks as the result of a scalar subquery. Its size follows from the number
of keys and is computed before it is built. Beyond ``most_bytes`` bytes a cascade is split by key hash into shards; each is
asked about its own hosts only, and pages take the answers by a join on the host, which Spark can split where it is hot.

Rules come first: host and path prefixes, longest first; a rule covers its host and all subdomains. Null urls and urls
without ``://`` have an empty host and path, which no rule and no listed key fits: they are allowed. Repeated pages are
judged each; null page ids stay; very long urls are taken whole; an empty table gives no rows. Columns of the input named
host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import math
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, kept


class Level:
    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        self.hashes = max(1, round(-math.log2(rate)))
        self.words = max(1, math.ceil(n * self.hashes * 1.4427 / 64))
        self.seed = seed
        bit = F.explode(F.array(*[self._place(F.col("key"), i) for i in range(self.hashes)]))
        set_ = keys.select(bit.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v"))
        every = keys.sparkSession.range(self.words).withColumnRenamed("id", "w").join(set_, "w", "left")
        self.filter = kept(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")))), lambda x: x["v"]).alias("words")), "cascade-level")

    def _place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.words * 64))

    def holds(self, key: Column) -> Column:
        words = self.filter.scalar()
        bits = []
        for i in range(self.hashes):
            p = self._place(key, i)
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            bits.append(F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return reduce(lambda a, b: a & b, bits)


class Cascade:
    """Exact membership of ``listed`` keys within ``universe``; both have one column, ``key``, of distinct strings."""

    def __init__(self, universe: DataFrame, listed: DataFrame, deep_rate: float = 0.125, most_levels: int = 60):
        inside = kept(universe.join(listed, "key", "left_semi"), "cascade-listed")
        outside = kept(universe.join(listed, "key", "left_anti"), "cascade-others")
        n_in, n_out = inside.count(), outside.count()
        self.levels: list[Level] = []
        holds, wrong, n, rate = inside, outside, n_in, min(0.5, max(1e-6, n_in * math.sqrt(0.5) / max(1, n_out)))
        while n and len(self.levels) < most_levels:
            level = Level(holds, n, rate, len(self.levels) + 1)
            self.levels.append(level)
            through = kept(wrong.where(level.holds(F.col("key"))), "cascade-through")
            holds, wrong, n, rate = through, holds, through.count(), deep_rate
        if n:
            raise RuntimeError("the cascade did not close")

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return answer


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits. A rule is a host, ``/`` and a path prefix."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0])):
        own = text[: text.index("/")]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(text[text.index("/") :])
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def blocked_domains(spark: SparkSession) -> DataFrame:
    """key: the stored list of domains, one a line; lines that begin with ``#`` are comments."""
    lines = (Path(__file__).parent / "blocked_domains.txt").read_text("utf-8").splitlines()
    return spark.createDataFrame([(x.strip(),) for x in lines if x.strip() and x[0] != "#"], "key string").distinct()


def covered(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """key: the hosts of ``hosts`` that a domain of ``listed`` covers, itself or a parent."""
    parts = F.split("key", "\\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = hosts.where("key <> ''").select("key", F.explode(suffixes).alias("_suffix"))
    return each.join(listed.select(F.col("key").alias("_suffix")).where("_suffix is not null").distinct(), "_suffix", "left_semi").select("key").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], url: str = "url", most_bytes: int = 16_000_000) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block). listed: a table with a column ``key`` of domains to block."""
    own = pages.withColumns({"_url_host": host_of(F.col(url)), "_url_path": path_of(F.col(url))})
    own = own.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url]).withColumnsRenamed({"_url_host": "host", "_url_path": "path"})
    universe = kept(own.select(F.col("host").alias("key")).distinct(), "cascade-universe")
    inside = kept(covered(universe, listed), "cascade-covered")
    shards = max(1, math.ceil(inside.count() * 6 / most_bytes))  # under 6 bytes a listed key, all levels together
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = own.withColumns({"rule": rule, "verdict": says})
    if shards == 1:
        return out.withColumn("verdict", F.coalesce("verdict", F.when(Cascade(universe, inside).contains(F.col("host")), "block").otherwise("allow")))
    shard, blocked = F.pmod(F.xxhash64("key", F.lit(0)), F.lit(shards)), None
    for i in range(shards):
        mine = universe.where(shard == i)
        found = kept(mine.where(Cascade(mine, inside.where(shard == i)).contains(F.col("key"))), "cascade-shard")
        blocked = found if blocked is None else blocked.unionByName(found)
    out = out.join(blocked.select(F.col("key").alias("_blocked")), F.col("host") == F.col("_blocked"), "left")
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow"))).drop("_blocked")
