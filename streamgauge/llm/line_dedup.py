"""Line dedup by pairwise alignment (operator 1).

Documents that share hashes of line runs are aligned by patience diff, and aligned common blocks are deleted from the later
document (that of the larger key). The runs are the shortest ones with ``least_words`` words, so that two documents with a
common block share one. A run is rare when at most ``rare`` documents hold it: then every later document is paired with
every earlier one of them. Runs in more documents pair each later document with the first holder; where that leaves a
place of the run, further holders follow, at last all of them. So the result is that of aligning all pairs. Documents with the
same lines go but for the first, which alone is a partner of others.

Where a region has no line unique in both documents, its common run with most words is aligned, and so on before and
after it, so that passages which a document repeats are aligned too, each occurrence with one of the other document.

A block is a run of aligned lines without a gap, in both documents. It goes where it holds at least ``least_words``
words. Lines are compared as they are without their outer blanks; lines without a word are no lines: they stay, except
between two deleted lines.

A document all of whose lines are deleted has the text ''. Null texts stay null and take no part; rows with null keys
stay as they are. Of rows that repeat a key with different texts, the one with the least hash has the key's place; the
others are documents that come after all keys, in the order of a hash. Rows that repeat both are one document, and all of
them change. Very long texts are aligned whole. An empty table gives no rows. Other columns stay, whatever their names, but
for one named ``_gone``, which is replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, kept, same_text, ship
from .keybits import KeyBits

#: Odd factor of the hashes of runs (a fixed value). Equal hashes of unequal runs only add a pair to align.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by their first number, whose second numbers rise (patience sorting)."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect.bisect_left(tops, b)
        back[i] = last[k - 1] if k else -1
        tops[k : k + 1] = [b]
        last[k : k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _heaviest(a: list[int], b: list[int], words: list[int]) -> tuple[int, int, int]:
    """Starts and length of the common run with most words, by a suffix automaton of ``a``; equal ones by place in ``b``."""
    go: list[dict[int, int]] = [{}]
    link, size, end, last = [-1], [0], [-1], 0
    for p, x in enumerate(a):
        new = len(go)
        go.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(p)
        v, last = last, new
        while v >= 0 and x not in go[v]:
            go[v][x] = new
            v = link[v]
        if v < 0:
            continue
        q = go[v][x]
        if size[q] != size[v] + 1:
            go.append(dict(go[q]))
            link.append(link[q])
            size.append(size[v] + 1)
            end.append(end[q])
            old, q = q, len(go) - 1
            link[old] = q
            while v >= 0 and go[v].get(x) == old:
                go[v][x] = q
                v = link[v]
        link[new] = q
    total = [0, *accumulate(words)]
    best, found, v, n = 0, (0, 0, 0), 0, 0
    for q, x in enumerate(b):
        while v and x not in go[v]:
            v = link[v]
            n = size[v]
        if x in go[v]:
            v, n = go[v][x], n + 1
            if total[q + 1] - total[q + 1 - n] > best:
                best, found = total[q + 1] - total[q + 1 - n], (end[v] - n + 1, q - n + 1, n)
    return found


def patience(a: list[int], b: list[int], words: list[int] | None = None) -> list[tuple[int, int]]:
    """Aligned equal elements of two sequences: equal ends, then elements unique in both, then what lies between them.

    Where no element is unique in both, the common run with most ``words`` (of the elements of ``b``; one each where not
    given) is aligned, then what lies before and after it.
    """
    words = words or [1] * len(b)
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        seen: dict[int, int] = {}
        for k in range(j, n):
            seen[b[k]] = -1 if b[k] in seen else k
        mine: dict[int, int] = {}
        for k in range(i, m):
            mine[a[k]] = -1 if a[k] in mine else k
        found = _rising([(k, seen[x]) for x, k in mine.items() if k >= 0 and seen.get(x, -1) >= 0])
        if found:
            for (p, q), (r, s) in zip([(i - 1, j - 1), *found], [*found, (m, n)], strict=True):
                todo.append((p + 1, r, q + 1, s))
            out.extend(found)
        elif not mine.keys().isdisjoint(seen):
            p, q, size = _heaviest(a[i:m], b[j:n], words[j:n])
            p, q = p + i, q + j
            out += [(p + k, q + k) for k in range(size)]
            todo += [(i, p, j, q), (p + size, m, q + size, n)]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least_words: int) -> list[int]:
    """Places in ``b`` of the aligned blocks with enough words."""
    gone: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b, words), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= least_words:
                gone += block
            block = []
        block.append(j)
        last = (i, j)
    return gone


def _runs(h: np.ndarray, w: np.ndarray, sizes: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents whose lines lie one after another: document, hash, first and last line of each shortest run.

    For each line these are the shortest run from it on and the shortest run up to it with ``least_words`` words. A block
    with that many words holds, for each of its lines, one of these runs with the line in it.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = (np.cumsum(sizes) - sizes)[doc]
    total = np.concatenate([[0], np.cumsum(w)])
    at = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + least_words) - 1  # last line of the run from each line on
    back = np.searchsorted(total, total[1:] - least_words, "right") - 1  # first line of the run up to each line
    on, up = (ahead < start + sizes[doc]) & (ahead < n), (back >= start)
    runs = np.unique(np.concatenate([np.stack([at, ahead], 1)[on], np.stack([back, at], 1)[up]]), axis=0)
    first, last = runs[:, 0], runs[:, 1]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _FACTOR, np.uint64)]))
    under = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(int(_FACTOR), -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h.astype(np.int64).view(np.uint64) * powers)])
    keys = (sums[last + 1] - sums[first]) * under[first] + (last - first).astype(np.uint64)
    return doc[first], keys.view(np.int64), first - start[first], last - start[first]


def _run_rows(held: DataFrame, least_words: int) -> DataFrame:
    """k, run, i, j: the shortest runs of each document with their first and last places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w = batch.column("h"), batch.column("w")
            sizes = np.diff(h.offsets.to_numpy())
            doc, run, i, j = _runs(h.flatten().to_numpy(), w.flatten().to_numpy().astype(np.int64), sizes, least_words)
            k = batch.column("k").to_numpy()[doc]
            for at in range(0, len(k), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(run[part]), pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32))], names=["k", "run", "i", "j"])

    return held.select("k", "h", "w").mapInArrow(cut, "k long, run long, i int, j int")


def _aligned(pairs: DataFrame, held: DataFrame, least_words: int) -> DataFrame:
    """k, i: places in the later documents of the blocks that the pairs (a, b) share."""
    left = held.select(F.col("k").alias("a"), F.col("h").alias("ha"))
    right = held.select(F.col("k").alias("b"), F.col("h").alias("hb"), "w")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, gone = [], []
            for r in batch.to_pylist():
                if found := common_blocks(r["ha"], r["hb"], r["w"], least_words):
                    keys.append(r["b"])
                    gone.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["k", "gone"])

    found = pairs.join(left, "a").join(right, "b").select("b", "ha", "hb", "w").mapInArrow(align, "k long, gone array<int>")
    return found.select("k", F.explode("gone").alias("i")).distinct()


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 16, least_words: int = 20) -> DataFrame:
    """key, same (hash of the text), gone: the places, among the lines with words, of lines to delete. Only documents with some."""
    ship(docs.sparkSession)
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, f"^[{BLANKS}]+|[{BLANKS}]+$", "")), lambda x: x != "")
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), same_text(text).alias("same"), lines.alias("lines"))
    rows = rows.select("key", "same", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.size(F.split(x, f"[{BLANKS}]+"))).alias("w"))
    held = kept(rows.where("size(h) > 0").where(F.aggregate("w", F.lit(0), lambda s, x: s + x) >= least_words).withColumn("lines", F.xxhash64("h")), "lines")
    odd = kept(held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("first")).where("n > 1").select("key", "first"), "lines-odd")
    if odd.take(1):
        late = F.col("first").isNotNull() & (F.col("same") != F.col("first"))
        k = F.when(late, F.lit(1 << 62) + F.pmod(F.xxhash64("key", "same"), F.lit(1 << 61))).otherwise(F.col("key"))
        held = kept(held.dropDuplicates(["key", "same"]).join(odd, "key", "left").withColumn("k", k).drop("first"), "lines-once")
    else:
        held = held.withColumn("k", F.col("key"))
    # documents with the lines of an earlier one go whole, and the earliest stands for them as a partner; stored, like the
    # counts below, so that the join can split a value that a large share of all rows has
    leaders = kept(held.groupBy("lines").agg(F.min("k").alias("leader")), "lines-leaders")
    ranked = held.join(leaders, "lines")
    copies = ranked.where("k > leader").select("k", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("i"))
    heads = kept(ranked.where("k = leader").select("k", "h", "w"), "lines-heads")
    runs = kept(_run_rows(heads, least_words), "lines-runs")
    each = runs.select("run", "k").distinct()
    counts = kept(each.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).where("n > 1"), "lines-counts")
    shared = kept(each.join(counts, "run"), "lines-shared")
    ordered = shared.where(F.col("n") <= rare).groupBy("run").agg(F.sort_array(F.collect_list("k")).alias("ks"))  # at most ``rare`` keys
    pairs = ordered.select(F.explode(F.expr("flatten(transform(sequence(1, size(ks) - 1), j -> transform(slice(ks, 1, j), a -> struct(a as a, ks[j] as b))))")).alias("p")).select("p.a", "p.b")
    many = shared.where(F.col("n") > rare)
    firsts = many.where("k <> first").select(F.col("first").alias("a"), F.col("k").alias("b"))
    done = kept(pairs.unionByName(firsts).distinct(), "lines-pairs")
    gone = kept(_aligned(done, heads, least_words), "lines-aligned")
    gone = _rest(runs, many, heads, done, gone, least_words)
    gone = gone.unionByName(copies).groupBy("k").agg(F.sort_array(F.collect_set("i")).alias("gone"))
    return gone.join(held.select("k", "key", "same"), "k").select("key", "same", "gone")


def _rest(runs: DataFrame, many: DataFrame, heads: DataFrame, done: DataFrame, gone: DataFrame, least_words: int) -> DataFrame:
    """``gone`` with what further holders of frequent runs give where the first holder left a place of the run.

    Each round asks about four times as many holders (those whose hash ends in enough zeros), the last one all of them. A
    run all of whose places in a document are gone needs no further holder, so the result is that of all pairs.
    """
    places = runs.join(many.where("k <> first").select("run", "k", "n"), ["run", "k"])
    holders = many.select("run", F.col("k").alias("a"), F.expr("bit_count((xxhash64(k) & -xxhash64(k)) - 1)").alias("zeros"))
    left = kept(places.select("run", "k", "n", F.explode(F.sequence("i", "j")).alias("i")), "lines-open") if many.take(1) else None
    step = 0
    while left is not None:
        open_ = kept(left.join(gone, ["k", "i"], "left_anti").select("run", F.col("k").alias("b"), "n").distinct(), "lines-open")
        top = open_.agg(F.max("n")).first()[0]
        if top is None:
            break
        step += 2
        least = F.floor(F.log2("n")).cast("int") - 2 - step
        pairs = open_.join(holders, "run").where((F.col("a") < F.col("b")) & (F.col("zeros") >= least)).select("a", "b").distinct()
        pairs = kept(pairs.join(done, ["a", "b"], "left_anti"), "lines-pairs")
        gone = kept(gone.unionByName(_aligned(pairs, heads, least_words)).distinct(), "lines-aligned")
        done = done.unionByName(pairs)
        if int(top).bit_length() - 3 - step <= 0:
            break
    return gone


def without_common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rare: int = 16, least_words: int = 20, length_column: str | None = "n_chars", least_left: float = 0.0) -> DataFrame:
    """``docs`` with the common blocks cut from the later documents, and ``_gone``: the number of lines cut.

    Documents that lost lines, and of whose words less than the share ``least_left`` is left, go as a whole.

    A bitmap of the keys with lines to cut picks the documents to join; the texts of all others are not shuffled.
    """
    gone = kept(removals(docs, key, text, rare, least_words), "lines-gone")
    own = docs.select(F.struct("*").alias("_own"), F.col(key).cast("long").alias("_key"), same_text(text).alias("_hash"))
    may = KeyBits(gone, "key").column(F.col("_key"))
    found = gone.select(F.col("key").alias("_k"), F.col("same").alias("_same"), F.col("gone").alias("_places"))
    joined = own.where(may).join(found, (F.col("_key") == F.col("_k")) & (F.col("_hash") == F.col("_same")), "left").withColumn("_text", F.col("_own").getField(text))
    wordy = f"x rlike '[^{BLANKS}]'".replace("\\", "\\\\")
    # _at: the line of each place; _off: lines to delete, with blank lines between two neighbouring places
    out = joined.withColumn("_lines", F.when(F.col("_places").isNotNull(), F.split("_text", "\n", -1)))
    out = out.withColumn("_at", F.expr(f"filter(transform(_lines, (x, i) -> if({wordy}, i, -1)), i -> i >= 0)"))
    out = out.withColumn("_off", F.expr("flatten(transform(_places, (p, j) -> if(j + 1 < size(_places) and _places[j + 1] = p + 1, sequence(_at[p], _at[p + 1] - 1), array(_at[p]))))"))
    rest = F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), _off), i -> _lines[i]), '\n')")
    out = out.withColumn("_new", F.when(F.col("_places").isNotNull(), rest).otherwise(F.col("_text")))
    n_gone = F.greatest(F.coalesce(F.size("_places"), F.lit(0)).cast("int"), F.lit(0))
    names = [c for c in docs.columns if c != "_gone"]
    columns = []
    for c in names:
        old = F.col("_own").getField(c)
        if c == text:
            columns.append(F.col("_new").alias(text))
        elif c == length_column:
            columns.append(F.when(F.col("_places").isNotNull(), F.length("_new")).otherwise(old).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(old.alias(c))
    untouched = own.where(~may).select(*[F.col("_own").getField(c).alias(c) for c in names], F.lit(0).alias("_gone"))
    if least_left > 0:
        words = lambda c: F.size(F.regexp_extract_all(c, F.lit(f"[^{BLANKS}]+"), F.lit(0)))
        out = out.where(F.col("_places").isNull() | (words(F.col("_new")) >= least_left * words(F.col("_text"))))
    return out.select(*columns, n_gone.alias("_gone")).unionByName(untouched)
