"""Exact Jaccard self-join of word n-gram sets by set relations (operator 9).

Two documents link when their sets' Jaccard similarity reaches ``num / den``. What is wanted are the classes that links
connect; copies are one set and are never expanded into pairs.

1. One pass over the texts hashes each document's shingles, gives its set a 64-bit node id, a parity bitmap (a quarter
   byte a shingle), and counts in how many sets each shingle is, from sorted and delta-coded blocks of 40-bit hashes.
   Shingles in at least ``heavy`` sets are heavy; the floor is doubled until at most ``most_heavy`` of them are left, so
   that what is broadcast is bounded.
2. A second pass orders each set with its heavy shingles last and puts its first ``n - ceil(t n) + 1`` shingles into an
   index: linked sets share one of them. Order and index are exact whatever the floor is.
3. First, within each index list the set with the fewest light shingles leads, and is compared with the others only.
   Its verified links join most of any group of near copies at once, and its overlaps are answers that others reuse.
4. Then the pairs of a list whose sets are not in one component yet are taken. Lists are sorted by size and position and cut
   into blocks. Two blocks are skipped whole, in one step, where all their sets are in one component, where their sizes
   are too far apart, or where their positions leave too few shingles to share; a block is left for good once sizes have
   drifted apart. Pairs of what is left pass the same tests one by one, some blocks at a time, so that memory is bounded.
5. For a pair with a common leader the leader's answers decide first: with the leader's overlaps known, the pair's overlap
   is at least ``o(l,a) + o(l,b) - n(l)`` and at most ``min(o(l,a) + n(b) - o(l,b), o(l,b) + n(a) - o(l,a))``. Parity
   bitmaps then rule pairs out exactly (each bit that differs is a shingle that differs). What is left is compared
   shingle by shingle.

Empty sets (null or word-less texts) link with nothing. Equal sets, repeated rows and repeated or null keys are fine: a
class takes its least key; a class without any key has null. Very long texts are hashed whole. An empty table gives no rows.
Only the key and the text are read, and ``one_of_each`` keeps all columns, whatever their names. Distinct shingles are told
apart by 64 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, parts, same_text, ship, text_of
from .components import components
from .keybits import KeyBits
from .wordhash import mix, shingle_hashes, word_hashes

_BITS = 40
#: Entries of a block of an index list, and pairs of blocks that are opened at a time.
_BLOCK, _OPENED = 64, 64
_FLUSH = 2_000_000


def _set_of(text: str, size: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    found = np.sort(shingle_hashes(word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)), size))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def _node(shingles: np.ndarray) -> int:
    """64-bit id of a set."""
    with np.errstate(over="ignore"):
        value = mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(value.view(np.int64)[0])


def _parity(shingles: np.ndarray) -> bytes:
    """Bit i: whether an odd number of shingles have i as their last bits. A power of two bits, about two a shingle."""
    bits = 64 << max(0, (2 * len(shingles) - 1).bit_length() - 6)
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _block(values: np.ndarray) -> bytes:
    step = np.diff(values, prepend=np.uint64(0))
    return len(values).to_bytes(4, "little") + (step & np.uint64(0xFFFF)).astype("<u2").tobytes() + zlib.compress((step >> np.uint64(16)).astype("<u4").tobytes(), 1)


def _unblock(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = np.frombuffer(data, "<u2", n, 4).astype(np.uint64)
    return np.cumsum(np.frombuffer(zlib.decompress(data[4 + 2 * n :]), "<u4").astype(np.uint64) << np.uint64(16) | low, dtype=np.uint64)


def _pairs(c: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Node ids and sizes of the pairs, in parts, of rows sorted by list, size and position. Blocks do not span lists."""
    size = len(c["node"])
    if not size:
        return
    n, pos, root = c["n"].astype(np.int64), c["pos"].astype(np.int64), c["root"]
    first = np.flatnonzero(np.concatenate([[True], c["shingle"][1:] != c["shingle"][:-1]]))
    long = np.diff(np.append(first, size))
    several = long > 1
    per = -(-long // _BLOCK)
    of = np.repeat(np.arange(len(first)), per)  # the list of each block
    turn = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    start = first[of] + turn * _BLOCK
    end = np.minimum(start + _BLOCK, (first + long)[of])
    low_root, high_root = np.minimum.reduceat(root, start), np.maximum.reduceat(root, start)
    least, most = n[start], n[end - 1]
    left = np.maximum.reduceat(n - pos, start)  # shingles from the shared one on, at best
    need = lambda a, b: -(-num * (a + b) // (num + den))
    live, k = np.flatnonzero(several[of]), 0
    while len(live):
        live = live[live + k < len(of)]
        other = live + k
        stay = (of[live] == of[other]) & (most[live] * den >= least[other] * num)
        live, other = live[stay], other[stay]
        one = (low_root[live] == high_root[live]) & (low_root[other] == high_root[other]) & (low_root[live] == low_root[other])
        open_ = ~one & (np.minimum(left[live], left[other]) >= need(least[live], least[other]))
        x, y = live[open_], other[open_]
        for at in range(0, len(x), _OPENED):
            p, q = x[at : at + _OPENED], y[at : at + _OPENED]
            i = (start[p][:, None, None] + np.arange(_BLOCK)[None, :, None]) + np.zeros((1, 1, _BLOCK), np.int64)
            j = (start[q][:, None, None] + np.arange(_BLOCK)[None, None, :]) + np.zeros((1, _BLOCK, 1), np.int64)
            good = (i < end[p][:, None, None]) & (j < end[q][:, None, None]) & (i < j)
            i, j = i[good], j[good]
            good = (root[i] != root[j]) & (n[i] * den >= n[j] * num)
            i, j = i[good], j[good]
            good = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need(n[i], n[j])
            i, j = i[good], j[good]
            swap = c["node"][i] > c["node"][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                yield c["node"][i], c["node"][j], c["n"][i], c["n"][j]
        k += 1


class Join:
    def __init__(self, docs: DataFrame, key: str, text: str, size: int, num: int, den: int, heavy: int = 64, most_heavy: int = 4_000_000):
        self.spark: SparkSession = docs.sparkSession
        ship(self.spark)
        self.docs = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"), same_text(text).alias("same"))
        self.size, self.num, self.den, self.heavy, self.most_heavy = size, num, den, heavy, most_heavy
        self.n_parts = max(parts(docs), 1)

    def need(self, a: str, b: str):
        """Least overlap of linked sets of sizes a and b."""
        return F.expr(f"({self.num}L * ({a} + {b}) + {self.num + self.den - 1}L) div {self.num + self.den}L")

    def scan(self) -> DataFrame:
        """Pass 1: a row a document (kind 0: key, node, n, same), a row a new set (kind 1: node, n, sketch), blocks of shingles (kind 2)."""
        size, n_parts = self.size, self.n_parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            waiting: list[np.ndarray] = []
            held = 0

            def flush() -> list[tuple]:
                if not waiting:
                    return []
                values = np.sort(np.concatenate(waiting) >> np.uint64(64 - _BITS))
                borders = np.searchsorted(values, np.array([(i << _BITS) // n_parts for i in range(n_parts + 1)], np.uint64))
                waiting.clear()
                return [(2, None, i, None, _block(values[a:b]), None) for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)) if b > a]

            def out(rows: list[tuple]) -> pa.RecordBatch:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "key", "node", "n", "data", "same"])

            for batch in batches:
                rows = []
                for k, x, same in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("same").to_pylist(), strict=True):
                    shingles = _set_of(x.as_py(), size)
                    node = _node(shingles)
                    rows.append((0, k, node, len(shingles), None, same))
                    if len(shingles) and node not in seen:
                        seen.add(node)
                        rows.append((1, None, node, len(shingles), _parity(shingles), None))
                        waiting.append(shingles)
                        held += len(shingles)
                        if held >= _FLUSH:
                            rows += flush()
                            held = 0
                if rows:
                    yield out(rows)
            if rows := flush():
                yield out(rows)

        return self.docs.mapInArrow(run, "kind int, key long, node long, n long, data binary, same long")

    def heavies(self, scanned: DataFrame) -> np.ndarray:
        """40-bit hashes of heavy shingles, ascending; at most ``most_heavy``."""
        floor = self.heavy

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for bucket, data in zip(batch.column("node").to_pylist(), batch.column("data"), strict=True):
                    of.setdefault(bucket, []).append(_unblock(data.as_py()))
            for bucket in list(of):
                value, n = np.unique(np.concatenate(of.pop(bucket)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value[n >= floor].astype(np.int64)), pa.array(n[n >= floor].astype(np.int64))], names=["h", "c"])

        blocks = scanned.where("kind = 2").select("node", "data")
        found = kept(blocks.repartitionById(self.n_parts, F.col("node").cast("int")).mapInArrow(count, "h long, c long"), "setjoin-heavy")
        sizes = {r.level: r.n for r in found.groupBy(F.floor(F.log2("c")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
        while sum(n for level, n in sizes.items() if 2 ** (level + 1) > floor) > self.most_heavy:
            floor *= 2
        return np.sort(found.where(F.col("c") >= floor).select("h").toArrow()["h"].to_numpy().astype(np.uint64))  # at most 32 MB

    def postings(self, heavies: np.ndarray) -> DataFrame:
        """Pass 2: the index. A row for each shingle in the prefix of a set."""
        size, num, den = self.size, self.num, self.den
        shared = self.spark.sparkContext.broadcast(heavies)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, seen = shared.value, set()
            for batch in batches:
                made = []
                for x in batch.column("text"):
                    shingles = _set_of(x.as_py(), size)
                    n = len(shingles)
                    if not n or (node := _node(shingles)) in seen:
                        continue
                    seen.add(node)
                    short = shingles >> np.uint64(64 - _BITS)
                    is_heavy = top[np.minimum(np.searchsorted(top, short), len(top) - 1)] == short if len(top) else np.zeros(n, bool)
                    order = np.concatenate([shingles[~is_heavy] >> np.uint64(1), shingles[is_heavy] >> np.uint64(1) | np.uint64(1 << 63)])[: n - (num * n + den - 1) // den + 1]
                    made.append((order.view(np.int64), node, n, int(n - is_heavy.sum())))
                if made:
                    long = [len(m[0]) for m in made]
                    spread = lambda i, kind: np.repeat(np.array([m[i] for m in made], kind), long)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([m[0] for m in made])), pa.array(spread(1, np.int64)), pa.array(spread(2, np.int32)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in long])), pa.array(spread(3, np.int32))],
                        names=["shingle", "node", "n", "pos", "light"],
                    )

        return self.docs.select("text").mapInArrow(run, "shingle long, node long, n int, pos int, light int")

    def led(self, postings: DataFrame) -> DataFrame:
        """Index lists of two sets and more (kind 1) and pairs of each list's leader with its other sets (kind 0).

        Rows stream through sorted by list and light shingles, so a list of any length needs one row of memory.
        """
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("shingle", "node", "n", "pos", "light")
            last: dict[str, np.ndarray] | None = None  # the first row of the list that the batch before ended in
            told = False
            for batch in batches:
                if not batch.num_rows:
                    continue
                c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
                before = 0
                if last is not None:
                    c = {k: np.concatenate([last[k], c[k]]) for k in names}
                    before = 1
                size = len(c["node"])
                starts = np.concatenate([[True], c["shingle"][1:] != c["shingle"][:-1]])
                own = np.concatenate([[True], starts[1:] | (c["node"][1:] != c["node"][:-1])])  # a set met by several tasks counts once
                lead = np.maximum.accumulate(np.where(starts, np.arange(size), 0))
                own &= (lead == np.arange(size)) | (c["node"] != c["node"][lead])
                first = np.flatnonzero(starts)
                several = np.add.reduceat(own.astype(np.int64), first) > 1
                several = np.repeat(several, np.diff(np.append(first, size)))
                rest = own & ~starts
                i, j = np.flatnonzero(rest), lead[rest]
                ni, nj = c["n"][i].astype(np.int64), c["n"][j].astype(np.int64)
                low, high = np.minimum(ni, nj), np.maximum(ni, nj)
                need = -(-num * (ni + nj) // (num + den))
                good = (low * den >= high * num) & (1 + np.minimum(ni - c["pos"][i] - 1, nj - c["pos"][j] - 1) >= need)
                i, j = i[good], j[good]
                # the list that goes on: its leader is told once
                keep = own & several
                if before and told:
                    keep[0] = False
                if before and not told and len(first) and keep[0]:
                    told = True
                k = np.flatnonzero(keep)
                a, b = np.minimum(c["node"][i], c["node"][j]), np.maximum(c["node"][i], c["node"][j])
                led_by = c["node"][j]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.zeros(len(i), np.int32), np.ones(len(k), np.int32)])),
                        pa.array(np.concatenate([a, c["shingle"][k]])), pa.array(np.concatenate([b, c["node"][k]])),
                        pa.array(np.concatenate([np.where(a == led_by, c["n"][j], c["n"][i]), c["n"][k]])), pa.array(np.concatenate([np.where(a == led_by, c["n"][i], c["n"][j]), c["pos"][k]])),
                    ],
                    names=["kind", "a", "b", "na", "nb"],
                )
                at = first[-1]
                told = bool(keep[at]) or (at == 0 and before == 1 and told)
                last = {k: v[at : at + 1].copy() for k, v in c.items()}

        return postings.repartition(self.n_parts, "shingle").sortWithinPartitions("shingle", "light", "node").mapInArrow(run, "kind int, a long, b long, na int, nb int")

    def crossed(self, lists: DataFrame) -> DataFrame:
        """Pairs of each list whose sets lie in different components. lists: shingle, node, n, pos, root."""
        num, den, most = self.num, self.den, 400_000
        pairs = lambda c: _pairs(c, num, den)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ("shingle", "node", "n", "pos", "root")
            held: list[dict[str, np.ndarray]] = []
            count, limit = 0, most

            def done(last: bool) -> Iterator[pa.RecordBatch]:
                nonlocal held, count
                if not held:
                    return
                c = {k: np.concatenate([h[k] for h in held]) for k in names}
                end = len(c["node"]) if last else int(np.searchsorted(c["shingle"], c["shingle"][-1]))
                if not end:
                    held = [c]
                    return
                held = [{k: v[end:] for k, v in c.items()}]
                count = len(held[0]["node"])
                for found in pairs({k: v[:end] for k, v in c.items()}):
                    for x in range(0, len(found[0]), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(v[x : x + 100_000]) for v in found], names=["a", "b", "na", "nb"])

            for batch in batches:
                held.append({k: batch.column(k).to_numpy(zero_copy_only=False) for k in names})
                count += batch.num_rows
                if count >= limit:
                    yield from done(False)
                    limit = max(most, 2 * count)  # a list that goes on is joined up only when it has doubled
            yield from done(True)

        return lists.repartition(self.n_parts, "shingle").sortWithinPartitions("shingle", "n", "pos", "node").mapInArrow(run, "a long, b long, na int, nb int")

    def plausible(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs that parity bitmaps do not rule out."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("na", "nb"))
                off = np.array([_differ(x.as_py(), y.as_py()) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)], np.int64)
                good = (na + nb - off) // 2 >= -(-num * (na + nb) // (num + den))
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(good))

        side = lambda x: sketches.select(F.col("node").alias(x), F.col("data").alias(f"s{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na int, nb int")

    def sets_of(self, pairs: DataFrame, scanned: DataFrame) -> DataFrame:
        """The sets of the nodes in some pairs, from their texts again. A bitmap of keys (at most 16 MB) picks the texts."""
        size = self.size
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        keys = kept(scanned.where("kind = 0").select("key", "node").join(nodes, "node").groupBy("node").agg(F.min("key").alias("key")), "setjoin-keys")
        may = KeyBits(keys, "key")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column("key")
                hit = may.holds(key.fill_null(0).to_numpy(zero_copy_only=False)) | key.is_null().to_numpy(zero_copy_only=False)
                rows = []
                for i in np.flatnonzero(hit).tolist():
                    shingles = _set_of(batch.column("text")[i].as_py(), size)
                    if len(shingles):
                        rows.append((_node(shingles), shingles.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "data"])

        return kept(self.docs.select("key", "text").mapInArrow(run, "node long, data binary").join(nodes, "node", "left_semi"), "setjoin-sets")

    def verified(self, pairs: DataFrame, scanned: DataFrame) -> DataFrame:
        """The exact overlap of each pair: a, b, na, nb, o."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                o = []
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                    p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    p, q = (p, q) if len(p) <= len(q) else (q, p)
                    o.append(int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "na", "nb")), pa.array(o, pa.int32())], names=["a", "b", "na", "nb", "o"])

        sets = self.sets_of(pairs, scanned)
        side = lambda x: sets.select(F.col("node").alias(x), F.col("data").alias(f"s{x}"))
        found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, na int, nb int, o int")
        return found.dropDuplicates(["a", "b"])

    def derived(self, pairs: DataFrame, answers: DataFrame) -> DataFrame:
        """Pairs with the bounds that answers of a common leader give: low and high overlap (null without a common leader)."""
        one = answers.select(F.col("a").alias("x"), F.col("b").alias("l"), "o", F.col("nb").alias("nl")).unionByName(answers.select(F.col("b").alias("x"), F.col("a").alias("l"), "o", F.col("na").alias("nl")))
        best = one.groupBy("x").agg(F.max_by(F.struct("l", "o", "nl"), F.struct("o", "l")).alias("r")).select("x", "r.*")
        side = lambda x: best.select(F.col("x").alias(x), F.col("l").alias(f"l{x}"), F.col("o").alias(f"o{x}"), F.col("nl").alias(f"nl{x}"))
        both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        same = F.col("la") == F.col("lb")
        return both.select("a", "b", "na", "nb", F.when(same, F.expr("oa + ob - nla")).alias("low"), F.when(same, F.expr("least(oa + nb - ob, ob + na - oa)")).alias("high"))

    def labels(self) -> DataFrame:
        """A row a document: key, same (hash of its text), n, component, stays (whether it is the first of its class, by key and then text)."""
        scanned = kept(self.scan(), "setjoin-scan")
        led = kept(self.led(self.postings(self.heavies(scanned))), "setjoin-lists")
        sketches = scanned.where("kind = 1").select("node", "data").dropDuplicates(["node"])
        pairs = led.where("kind = 0").select("a", "b", "na", "nb").distinct()
        answers = kept(self.verified(kept(self.plausible(pairs, sketches), "setjoin-led"), scanned), "setjoin-answers")
        links = answers.where(F.col("o") >= self.need("na", "nb")).select("a", "b")
        roots = kept(components(links), "setjoin-roots")
        lists = led.where("kind = 1").select(F.col("a").alias("shingle"), F.col("b").alias("node"), F.col("na").alias("n"), F.col("nb").alias("pos"))
        lists = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        crossed = self.derived(kept(self.crossed(lists).distinct(), "setjoin-crossed"), answers)
        told = kept(crossed, "setjoin-derived")
        need = self.need("na", "nb")
        open_ = told.where(F.col("low").isNull() | (F.col("low") < need) & (F.col("high") >= need)).select("a", "b", "na", "nb")
        exact = self.verified(kept(self.plausible(open_, sketches), "setjoin-open"), scanned).where(F.col("o") >= need).select("a", "b")
        more = kept(exact.unionByName(told.where(F.col("low") >= need).select("a", "b")), "setjoin-more")
        root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        joined = more.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        upper = components(joined).select(F.col("node").alias("root"), F.col("root").alias("top"))
        docs = scanned.where("kind = 0").select("key", "same", "node", "n")
        # by sorting: a set or class that a large share of all rows has can then be split
        own = docs.where("n > 0").join(roots.hint("merge"), "node", "left").select("key", "same", "n", F.coalesce("root", "node").alias("root"))
        own = kept(own.join(upper.hint("merge"), "root", "left").select("key", "same", "n", F.coalesce("top", "root").alias("top")), "setjoin-tops")
        # stored, so that the join can split a class that holds a large share of all rows
        first = F.min(F.struct(F.col("key").isNull().alias("without"), "key", "same"))
        least = kept(own.groupBy("top").agg(F.min("key").alias("component"), first.alias("first")), "setjoin-least")
        stays = (F.col("first.key").eqNullSafe(F.col("key"))) & (F.col("first.same") == F.col("same"))
        alone = docs.where("n = 0").select("key", "same", "n", F.col("key").alias("component"), F.lit(True).alias("stays"))
        return own.join(least.hint("merge"), "top").select("key", "same", "n", "component", stays.alias("stays")).unionByName(alone)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 4, den: int = 5, heavy: int = 64, most_heavy: int = 4_000_000) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach) of each row of ``docs``."""
    found = Join(docs, key, text, size, num, den, heavy, most_heavy).labels()
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, num: int = 4, den: int = 5, heavy: int = 64, most_heavy: int = 4_000_000) -> DataFrame:
    """``docs`` with one document of each class: that of the least key, of equal keys that with the least hash of its text.

    Rows are told apart by key and text, so a key that repeats with unrelated texts loses only those that are copies. Rows
    without a key count after all others; rows that repeat both key and text are one document, of which one row stays.
    Documents without words all stay.
    """
    found = kept(Join(docs, key, text, size, num, den, heavy, most_heavy).labels(), "setjoin-labels")
    gone = found.where("not stays").select(F.col("key").alias("_gone_key"), F.col("same").alias("_gone_same")).distinct()
    own = docs.select(F.struct("*").alias("_own"), F.col(key).cast("long").alias("_key"), same_text(text).alias("_same"))
    left = own.join(gone, F.col("_key").eqNullSafe(F.col("_gone_key")) & (F.col("_same") == F.col("_gone_same")), "left_anti")
    twice = kept(found.where("stays and n > 0").groupBy("key", "same").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("_twice_key"), F.col("same").alias("_twice_same")), "setjoin-twice")
    if twice.take(1):
        again = F.col("_key").eqNullSafe(F.col("_twice_key")) & (F.col("_same") == F.col("_twice_same"))
        left = left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").dropDuplicates(["_key", "_same"]))
    return left.select("_own.*")
