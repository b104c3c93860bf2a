"""Personal data by patterns and by bootstrapped context (operator 4). DataFrame operations only.

Base spans (e-mail, IP address, card and phone numbers) come from fixed patterns and checks. They are the seed entities.
Secrets have seeds too (fixed formats of keys), which are no base spans. Candidates are identifiers of a looser shape than
the base patterns take: an address without a dot, a number with a broken check digit, a phone number without its country,
any long word with digits.

Lexical patterns come from what stands around an entity, from narrow to wide: the two words before it; the word before and
the word after; the last three words or marks before it; and its own spelling (digits, letters and marks by class) with the
kind of character on either side. Patterns and instances form a bipartite graph, scored in rounds: a pattern's confidence
is the mean score of its distinct instances that have one, an instance's score that of its best confident pattern. Seeds
score 1, counter-examples (dotted numbers that can't be addresses, long plain numbers, UUIDs) 0, and instances not yet
reached have none. Patterns with at least ``least_seeds`` distinct seeds and confidence ``sure`` are confident; after
``rounds`` rounds, candidates in a confident pattern become spans, but for counter-examples. Base spans always stay.

Positions are code points, ends exclusive; matches are leftmost and do not overlap within a kind. All matching is done
within the row; only contexts of matches are grouped, on pattern and on instance. Nulls are empty texts; repeated rows get
the same spans each, and count once as evidence; very long texts are matched whole (prefix sums of match lengths are taken
in two levels). An empty table gives no rows. Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, kept, text_of

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The base patterns. Possessive loops and look-behinds keep them linear without changing what they match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Candidate shapes, looser than the base patterns.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}|[0-9]++(?:\.[0-9]++){3,5})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_@./-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_@./-])",
}
#: Formats of keys that are seeds (fixed values), and candidates that count against a pattern.
SECRET = "^([0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})$"
COUNTER = {
    "ip": "^[0-9.]+$",  # a candidate of digits and dots only is no base match: a part over 255, or not four parts
    "secret": "^([0-9-]+|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12})$",
}
LOOSE_HINT = {"email": "@|\\(at\\)|\\[at\\]", "ip": "[:.]", "card": "[0-9]{2}", "phone": "[0-9][ .-][0-9]", "secret": "[0-9]"}
_BLOCK = 256
_MATCH = "array<struct<s:bigint,e:bigint,m:string,l:string,r:string>>"


def matches(df: DataFrame, text: str, pattern: str, hint: Column, out: str) -> DataFrame:
    """Adds ``out``: the matches of a pattern, each with start, end, string, and up to 48 characters on either side.

    The text's pieces between matches and the matches have the same order, so places follow from their lengths.
    """
    q = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    none = "cast(array() as array<string>)"
    df = df.withColumn("_m", F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.expr(none)))
    df = df.withColumn("_g", F.expr(f"if(size(_m) > 0, split({text}, '{q(pattern)}', -1), {none})"))
    df = df.withColumn("_n", F.expr("transform(_m, (x, i) -> cast(length(_g[i]) + length(x) as bigint))"))
    df = df.withColumn("_b", F.expr(f"if(size(_n) = 0, cast(array() as array<bigint>), transform(sequence(0, (size(_n) - 1) div {_BLOCK}), b -> aggregate(slice(_n, cast(b * {_BLOCK} + 1 as int), {_BLOCK}), 0L, (s, x) -> s + x)))"))
    ahead = f"aggregate(slice(_b, 1, i div {_BLOCK}), 0L, (s, x) -> s + x) + aggregate(slice(_n, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0L, (s, x) -> s + x)"
    df = df.withColumn("_e", F.expr(f"transform(_m, (x, i) -> {ahead.replace('1, i div', '1, cast(i div').replace(f'div {_BLOCK})', f'div {_BLOCK} as int))', 1).replace(f'(i div {_BLOCK}) * {_BLOCK} + 1', f'cast((i div {_BLOCK}) * {_BLOCK} + 1 as int)')} + _n[i])"))
    df = df.withColumn(out, F.expr(f"transform(_m, (x, i) -> struct(_e[i] - length(x) as s, _e[i] as e, x as m, right(_g[i], 48) as l, left(_g[i + 1], 48) as r))").cast(_MATCH))
    return df.drop("_m", "_g", "_n", "_b", "_e")


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    d = f"cast(substring({digits}, length({digits}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, k) -> s + if(k % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0"


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": "true",
    "ip": f"x.m rlike '^{_PART}(?:\\\\.{_PART}){{3}}$'",
    "card": "length(regexp_replace(x.m, '[^0-9]', '')) between 14 and 19 and " + _luhn("regexp_replace(x.m, '[^0-9]', '')"),
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15",
}


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_email``, ``_ip``, ``_card`` and ``_phone``: the base matches."""
    for kind in KINDS:
        hint = F.contains(text, F.lit(HINT[kind])) if HINT[kind] else F.col(text).rlike("[0-9]")
        df = matches(df, text, BASE[kind], hint, f"_{kind}")
        if VALID[kind] != "true":
            df = df.withColumn(f"_{kind}", F.expr(f"filter(_{kind}, x -> {VALID[kind]})"))
    return df


def _tagged(kind: str, column: str) -> Column:
    k = ALL_KINDS.index(kind)
    return F.expr(f"transform({column}, x -> struct(x.s as s, {k} as k, x.e as e, x.m as m, x.l as l, x.r as r))")


def _last(c: str, n: int) -> str:
    """SQL: the n-th last word of a context, lower-cased, outer punctuation dropped except a closing mark of a cue."""
    return f"lower(coalesce(try_element_at(filter(split({c}, '[{BLANKS}]+'), w -> w <> ''), {n}), ''))".replace("\\x", "\\\\x")


def _side_of(sql: str) -> Column:
    """The kind of a neighbouring character: edge, blank, digit, letter, or the mark itself."""
    x = F.expr(sql)
    return F.when(x == "", "edge").when(x.rlike(f"[{BLANKS}]"), "blank").when(x.rlike("\\p{N}"), "digit").when(x.rlike("\\p{L}"), "letter").otherwise(x)


def occurrences(df: DataFrame) -> DataFrame:
    """A row a match and pattern: text_id, s, k, e, instance, pattern, seed, counter."""
    arrays = F.flatten(F.array(*[F.transform(_tagged(k, f"_{k}"), lambda x: F.struct(x.alias("x"), F.lit(True).alias("base"))) for k in KINDS], *[F.transform(_tagged(k, f"_loose_{k}"), lambda x: F.struct(x.alias("x"), F.lit(False).alias("base"))) for k in ALL_KINDS]))
    one = df.select("text_id", F.explode(arrays).alias("o")).select("text_id", "o.x.s", "o.x.k", "o.x.e", "o.x.m", F.col("o.x.l").alias("l"), F.col("o.x.r").alias("r"), "o.base")
    one = one.withColumn("w1", F.expr(_last("l", -1))).withColumn("w2", F.expr(_last("l", -2))).withColumn("v1", F.expr(_last("r", 1)))
    one = one.withColumn("lc", _side_of("right(l, 1)")).withColumn("rc", _side_of("left(r, 1)"))
    one = one.withColumn("cue", F.slice(F.reverse(F.regexp_extract_all(F.lower("l"), F.lit("[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"), F.lit(0))), 1, 3))
    secret = F.col("k") == ALL_KINDS.index("secret")
    counter = F.lit(False)
    for kind, pattern in COUNTER.items():
        counter = counter | (F.col("k") == ALL_KINDS.index(kind)) & F.col("m").rlike(pattern)
    one = one.withColumn("seed", F.col("base") | secret & F.col("m").rlike(SECRET)).withColumn("counter", ~F.col("base") & counter)
    spelling = F.translate(F.col("m"), "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "9" * 10 + "A" * 26 + "a" * 26)
    pattern = F.array(
        F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat_ws(" ", F.lit("before"), "w2", "w1")),
        F.when((F.col("w1") != "") & (F.col("v1") != ""), F.concat_ws(" ", F.lit("around"), "w1", "v1")),
        F.when(F.size("cue") == 3, F.concat_ws(" ", F.lit("cue"), F.reverse("cue"))),
        F.when(~secret, F.concat_ws(" ", F.lit("spelling"), "lc", spelling, "rc")),
    )
    return one.select("text_id", "s", "k", "e", F.lower("m").alias("instance"), "seed", "counter", F.explode(F.array_compact(pattern)).alias("pattern"))


def scored(found: DataFrame, rounds: int, least_seeds: int, sure: float) -> DataFrame:
    """Patterns that are confident after all rounds: k, pattern, confidence."""
    edges = found.groupBy("k", "pattern", "instance").agg(F.max("seed").alias("seed"), F.max("counter").alias("counter"))
    edges = kept(edges.withColumn("score", F.when(F.col("seed"), 1.0).when(F.col("counter"), 0.0)), "pii-edges")
    score, patterns = edges, None
    for i in range(rounds):
        patterns = score.groupBy("k", "pattern").agg(F.avg("score").alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        patterns = kept(patterns.where((F.col("seeds") >= least_seeds) & (F.col("confidence") >= sure)), "pii-patterns")
        if i + 1 < rounds:
            best = edges.join(patterns.select("k", "pattern", "confidence"), ["k", "pattern"]).groupBy("k", "instance").agg(F.max("confidence").alias("best"))
            score = edges.join(best, ["k", "instance"], "left").withColumn("score", F.coalesce("score", "best"))
    return patterns


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', cast(x.s as string), ':', cast(x.e as string))), ',')"


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, least_seeds: int = 5, sure: float = 0.8) -> DataFrame:
    """A row a document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, listed), n_added, n_spans."""
    base = with_base(docs.select(F.col(key).alias("key"), text_of(text).alias("t")), "t")
    for kind in ALL_KINDS:
        base = matches(base, "t", LOOSE[kind], F.col("t").rlike(LOOSE_HINT[kind]), f"_loose_{kind}")
    all_base = F.flatten(F.array(*[_tagged(k, f"_{k}") for k in KINDS]))
    base = base.withColumn("_base", all_base)
    # a candidate that touches any base span is no candidate; spans are asked in sorted blocks, as a long text can have very many
    slim = "array_sort(transform(_base, b -> struct(b.s as s, b.e as e)))"
    base = base.withColumn("_sorted", F.expr(f"if(size(_base) = 0, cast(array() as array<struct<s:bigint,e:bigint>>), {slim})"))
    block = f"slice(_sorted, cast(i * {_BLOCK} + 1 as int), {_BLOCK})"
    blocks = f"transform(sequence(0, (size(_sorted) - 1) div {_BLOCK}), i -> struct({block}[0].s as lo, array_max(transform({block}, x -> x.e)) as hi, {block} as spans))"
    base = base.withColumn("_blocks", F.expr(f"if(size(_sorted) = 0, cast(array() as array<struct<lo:bigint,hi:bigint,spans:array<struct<s:bigint,e:bigint>>>>), {blocks})"))
    touched = "exists(_blocks, k -> k.lo < c.e and c.s < k.hi and exists(k.spans, b -> b.s < c.e and c.s < b.e))"
    for kind in ALL_KINDS:
        base = base.withColumn(f"_loose_{kind}", F.expr(f"if(size(_loose_{kind}) = 0 or size(_sorted) = 0, _loose_{kind}, filter(_loose_{kind}, c -> not {touched}))"))
    some = reduce(lambda a, b: a | b, [F.size(f"_loose_{k}") > 0 for k in ALL_KINDS]) | (F.size("_base") > 0)
    base = base.withColumn("text_id", F.when(some, F.sha2("t", 256))).drop("t", "_base", "_sorted", "_blocks")
    base = kept(base, "pii-base")
    found = kept(occurrences(base.where("text_id is not null").dropDuplicates(["text_id"])), "pii-occurrences")
    accepted = scored(found, rounds, least_seeds, sure)
    own = found.where(~F.col("counter") & (~F.col("seed") | (F.col("k") >= len(KINDS))))
    added = own.join(accepted.select("k", "pattern"), ["k", "pattern"], "left_semi").select("text_id", "s", "k", "e").distinct()
    added = added.groupBy("text_id").agg(F.collect_list(F.struct("s", "k", "e")).alias("added"))
    out = base.join(kept(added, "pii-added"), "text_id", "left")
    slim = lambda k: F.expr(f"transform(_{k}, x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e))")
    out = out.withColumn("_base", F.array_sort(F.flatten(F.array(*[slim(k) for k in KINDS]))))
    out = out.withColumn("_all", F.expr("if(added is null, _base, array_sort(concat(_base, added)))"))
    n_added = F.coalesce(F.size("added"), F.lit(0)).cast("long")
    n_added = F.greatest(n_added, F.lit(0))
    return out.select(F.col("key").alias(key), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.expr(_listed("_base")), 256).alias("base_sha256"), F.expr(_listed("_all")).alias("spans"), n_added.alias("n_added"), F.size("_all").cast("long").alias("n_spans"))
