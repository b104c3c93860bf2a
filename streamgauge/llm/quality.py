"""Quality rules as a short-circuit cascade (operator 10). DataFrame operations only.

Each rule is a condition that rejects a text, over counts that it names. On a bounded sample (at most ``sample_rows`` rows,
drawn from all of the table, only to choose an order) the share of texts that a rule rejects and the time that it and its
counts take are measured, and the rules are ordered by rejections per cost. ``passing`` runs them in that order, the base
rules too: once a rule has rejected a text, the text and its words are emptied, so that later counts and rules do no work
for it. ``judged`` must give every count of every text; there one nested CASE evaluates the method's own rules, and a text
that an early rule rejects never pays for the later ones. Verdicts do not depend on the order; only the cost does.

Words are runs without blanks (space, tab, line feed, vertical tab, form feed, carriage return). Null or empty texts have
no words, are below the least number of words and are rejected. Repeated rows are judged each; other columns stay; an
empty table gives no rows; very long texts are counted whole. Working columns begin with ``_q_``. ``judged`` replaces
columns of the input that have the name of one it adds; ``passing`` gives the input's columns back as they were.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, kept, text_of

#: Texts with more repeated windows than this are searched by sorting instead of by a list.
_FEW = 24


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_q_t`` (the text) and ``_q_w`` (its words)."""
    return df.withColumn("_q_t", text).withColumn("_q_w", F.regexp_extract_all("_q_t", F.lit(f"[^{BLANKS}]+"), F.lit(0)))


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("n_words", F.size("_q_w").cast("long"))


def _chars(df: DataFrame) -> DataFrame:
    return df.withColumn("word_chars", F.length(F.array_join("_q_w", "")).cast("long"))


def _symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("n_symbols", F.size(F.regexp_extract_all("_q_t", F.lit("[#*$%&|<>]"), F.lit(0))).cast("long"))


def _lines(df: DataFrame) -> DataFrame:
    df = df.withColumn("_q_l", F.expr(f"filter(split(_q_t, '\\n', -1), x -> x rlike '[^{BLANKS}]')".replace("\\x", "\\\\x")))
    return df.withColumn("n_lines", F.size("_q_l").cast("long")).withColumn("n_dup_lines", (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long")).drop("_q_l")


def _repeats(df: DataFrame) -> DataFrame:
    """Words in 3-word windows that the text holds twice or more.

    A text without repeated windows is told by the size of its distinct windows. Otherwise the sorted hashes give the
    repeated ones, windows that may repeat are sorted by hash and place, and each repeated window adds the words that
    the window before it has not covered.
    """
    none = lambda kind: f"cast(array() as array<{kind}>)"
    df = df.withColumn("_q_h", F.expr(f"if(size(_q_w) > 2, transform(sequence(1, size(_q_w) - 2), i -> xxhash64(_q_w[i - 1], _q_w[i], _q_w[i + 1])), {none('bigint')})"))
    df = df.withColumn("_q_s", F.expr(f"if(size(array_distinct(_q_h)) = size(_q_h), {none('bigint')}, sort_array(_q_h))"))
    df = df.withColumn("_q_d", F.expr(f"if(size(_q_s) = 0, {none('bigint')}, array_distinct(filter(transform(sequence(1, size(_q_s) - 1), i -> if(_q_s[i] = _q_s[i - 1], _q_s[i], null)), x -> x is not null)))"))
    few = "filter(transform(_q_h, (x, i) -> if(array_contains(_q_d, x), i, -1)), i -> i >= 0)"
    df = df.withColumn("_q_z", F.expr(f"if(size(_q_d) > {_FEW}, array_sort(transform(_q_h, (x, i) -> struct(x as x, i as i))), {none('struct<x:bigint,i:int>')})"))
    many = "array_sort(transform(filter(transform(_q_z, (e, k) -> struct(e.i as i, (k > 0 and _q_z[k - 1].x = e.x) or (k < size(_q_z) - 1 and _q_z[k + 1].x = e.x) as r)), e -> e.r), e -> e.i))"
    df = df.withColumn("_q_p", F.expr(f"case when size(_q_d) = 0 then {none('int')} when size(_q_d) <= {_FEW} then {few} else {many} end"))
    return df.withColumn("n_repeat_words", F.expr("cast(if(size(_q_p) = 0, 0, aggregate(sequence(1, size(_q_p)), 0, (s, k) -> s + if(k < size(_q_p), least(3, _q_p[k] - _q_p[k - 1]), 3))) as bigint)")).drop("_q_h", "_q_s", "_q_d", "_q_z", "_q_p")


COUNTS = {"n_words": _words, "word_chars": _chars, "n_symbols": _symbols, "lines": _lines, "n_repeat_words": _repeats}


def counted(docs: DataFrame, text: str = "text", names: tuple[str, ...] = tuple(COUNTS)) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, ``_q_t`` and ``_q_w``; or only some counts."""
    df = with_words(docs, text_of(text))
    for name in names:
        df = COUNTS[name](df)
    return df


@dataclass(frozen=True)
class Rule:
    """A text is rejected where ``rejects`` (SQL over the counts that ``needs`` names and the text ``_q_t``) holds."""

    name: str
    rejects: str
    needs: tuple[str, ...] = ("n_words",)


def base(least_words: int = 50) -> tuple[Rule, ...]:
    """Rejections that every text must escape before the method's own rules are asked."""
    return Rule("few_words", f"n_words < {least_words}"), Rule("repeats", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words"))


RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", ("n_words", "word_chars")),
    Rule("symbols", "5 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("same_lines", "n_lines >= 6 and 2 * n_dup_lines > n_lines", ("lines",)),
    Rule("shouting", "2 * length(regexp_replace(_q_t, '[^A-Z]+', '')) > length(regexp_replace(_q_t, '[^A-Za-z]+', ''))", ()),
    Rule("exclamations", "5 * size(regexp_extract_all(_q_t, '!+', 0)) > n_words"),
    Rule("letterless", "2 * size(regexp_extract_all(_q_t, '\\\\p{L}+', 0)) < n_words"),
)


def _seconds(df: DataFrame, c: Column, times: int = 2) -> tuple[float, int]:
    """The least time of some runs, and how many rows the condition holds for."""
    best = float("inf")
    for _ in range(times):
        began = time.perf_counter()
        n = df.agg(F.count_if(c)).first()[0]
        best = min(best, time.perf_counter() - began)
    return best, n


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 42) -> list[tuple[Rule, float, float]]:
    """The rules with cost (seconds a text, with its counts) and selectivity (share rejected), by rejections per cost, on a sample."""
    rows = docs.select(F.col(text).alias("t"))
    share = min(1.0, 2 * sample_rows / max(1, rows.count()))
    sample = kept(with_words(rows.sample(share, seed).limit(sample_rows), text_of("t")).select("_q_t", "_q_w"), "quality-sample")
    n = max(1, sample.count())
    idle, _ = _seconds(sample, F.lit(False))  # what any job takes
    found = []
    for rule in rules:
        df = sample
        for name in rule.needs:
            df = COUNTS[name](df)
        seconds, hit = _seconds(df, F.expr(rule.rejects))
        found.append((rule, max(seconds - idle, 1e-4) / n, hit / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def rejects(order: list[Rule]) -> Column:
    """One nested CASE: the first rule that rejects ends it."""
    out = F.lit(False)
    for rule in reversed(order):
        out = F.when(F.expr(rule.rejects), True).otherwise(out)
    return out


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, least_words: int = 50) -> DataFrame:
    """``docs`` with the counts, base_failed and kept.

    ``kept`` is tied to a row number, which is never below 0: so no filter over it is pushed below the counts, where it would
    repeat their expressions in each other without end.
    """
    order = [r for r, _, _ in ordered(docs, rules, text, sample_rows)]
    df = counted(docs, text).withColumn("base_failed", rejects(list(base(least_words))))
    return df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~rejects(order)) & (F.monotonically_increasing_id() >= 0)).drop("_q_t", "_q_w", "n_lines")


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, least_words: int = 50) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns. The verdict is tied to a row number as in ``judged``."""
    order = [r for r, _, _ in ordered(docs, (*base(least_words), *rules), text, sample_rows)]
    df = with_words(docs.select(F.struct("*").alias("_q_own"), F.col(text).alias("_q_in")), text_of("_q_in")).drop("_q_in").withColumn("_q_open", F.lit(True))
    done: set[str] = set()
    for i, rule in enumerate(order):
        for name in rule.needs:
            df = df if name in done else COUNTS[name](df)
            done.add(name)
        df = df.withColumn("_q_open", F.when(F.col("_q_open"), ~F.expr(rule.rejects)).otherwise(False))
        if i + 1 < len(order):
            df = df.withColumns({"_q_t": F.when(F.col("_q_open"), F.col("_q_t")).otherwise(""), "_q_w": F.when(F.col("_q_open"), F.col("_q_w")).otherwise(F.array().cast("array<string>"))})
    return df.select("_q_own", (F.col("_q_open") & (F.monotonically_increasing_id() >= 0)).alias("_q_stays")).where("_q_stays").select("_q_own.*")
