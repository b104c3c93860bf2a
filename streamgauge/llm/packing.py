"""Packing of token ids into sequences by minimum bin slack (operator 6).

A document's ids (its words' ids and an end id) are cut at each full window; what remains is shorter than a window. Only
the number of remainders of each length matters for packing, at most ``window - 1`` numbers whatever the corpus holds.
On them the driver solves one window after another: with the longest remaining length as seed, a subset-sum dynamic
programme over a bitset (one Python integer, bit s set when s ids can be reached, counts split into powers of two) gives
the multiset of lengths that comes closest to the capacity, and is walked back to the counts. The window found is used as
often as the counts allow, so each solve uses up one length and there are at most ``window - 1`` solves.

Lengths whose best window leaves more slack than ``slack`` (0 ids unless told otherwise) are laid end to end and cut at
window borders; the rest of that stream becomes sequences of a power of two ids each, which need no padding.

Documents find their place by arithmetic: a remainder's rank among those of its length, from counts by partition, gives
its window. No row order, no global sort and no list of documents is held anywhere.

Null text is empty: the end id alone. Repeated rows and null keys are packed like others, and so are very long texts, whose
full windows are told by number. An empty table gives no rows. Only the key and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, kept, ship, text_of
from .tokens import encoder, public


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, whose sum is nearest to ``capacity`` from below.

    Longer lengths are taken first; the programme stops when the capacity itself is reached.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            after = reach | (reach << (length * k)) & mask
            if after != reach:
                steps.append((length, k, reach))
                reach = after
            left, k = left - k, k * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] += k
            total -= length * k
    return dict(used)


class Plan:
    """Where the k-th remainder of each length goes."""

    def __init__(self, histogram: dict[int, int], window: int, slack: int = 0):
        self.window = window
        counts = {n: c for n, c in histogram.items() if 0 < n < window and c > 0}
        taken: dict[int, int] = dict.fromkeys(counts, 0)
        self.segments: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}  # first rank, first window, pieces in a window, offset
        self.windows = 0
        for seed in sorted(counts, reverse=True):
            while counts[seed] > 0:
                counts[seed] -= 1
                used = closest(counts, window - seed)
                counts[seed] += 1
                used[seed] = used.get(seed, 0) + 1
                if window - sum(n * m for n, m in used.items()) > slack:
                    break
                times, offset = min(counts[n] // m for n, m in used.items()), 0
                for n, m in sorted(used.items(), reverse=True):
                    self.segments[n].append((taken[n], self.windows, m, offset))
                    counts[n] -= m * times
                    taken[n] += m * times
                    offset += n * m
                self.windows += times
            if counts[seed] > 0:
                # no window of the seed is full enough: its remainders join the stream
                self.segments[seed].append((taken[seed], -1, 0, 0))
                counts[seed], taken[seed] = 0, taken[seed]
        self.exact = taken
        self.stream_at, at = {}, 0
        for n in sorted(self.segments, reverse=True):
            self.stream_at[n] = at
            at += (histogram[n] - taken[n]) * n
        self.full, tail = divmod(at, window)
        self.tails = [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]
        self.borders = np.cumsum([0, *self.tails]).tolist()

    def whole(self, length: int, rank: int) -> tuple[int, int] | None:
        """Window and offset of a remainder that is not cut; None where it lies in the stream."""
        if rank >= self.exact[length]:
            return None
        own = self.segments[length]
        first, base, m, offset = own[bisect.bisect_right(own, rank, key=lambda s: s[0]) - 1]
        turn, place = divmod(rank - first, m)
        return base + turn, offset + place * length

    def cut(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces of a remainder in the stream: start in it, length, window, offset."""
        at = self.stream_at[length] + (rank - self.exact[length]) * length
        out, done = [], 0
        while done < length:
            k, offset = divmod(at + done, self.window)
            if k < self.full:
                room = self.window - offset
            else:
                rest = at + done - self.full * self.window
                j = bisect.bisect_right(self.borders, rest) - 1
                k, offset, room = self.full + j, rest - self.borders[j], self.borders[j + 1] - rest
            n = min(room, length - done)
            out.append((done, n, self.windows + k, offset))
            done += n
        return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 4096, end_id: int = 2, path: str | None = None, slack: int = 0) -> DataFrame:
    """A row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    path = path or public("word_bpe_49k.json")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder("word", path), np.array([end_id], "<u4").tobytes()
        seen, row, full = defaultdict(int), 0, 0
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                out = defaultdict(list)
                for x in texts.slice(at, 1000):
                    data = enc.encode(x.as_py()) + end
                    n = len(data) // 4
                    rest = n % window
                    cut = (n - rest) * 4
                    out["row_no"].append(row)
                    out["n"].append(n)
                    out["full_before"].append(full)
                    out["rest"].append(rest)
                    out["rank"].append(seen[rest])
                    out["crcs"].append([zlib.crc32(data[i : i + window * 4]) for i in range(0, len(data), window * 4)])
                    out["ids"].append(np.frombuffer(data, "<u4", offset=cut).astype("<u2" if end_id < 65536 else "<u4").tobytes())
                    seen[rest] += 1
                    row += 1
                    full += n // window
                k = len(out["n"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), keys.slice(at, 1000), *(pa.array(out[c], t) for c, t in (("row_no", pa.int64()), ("n", pa.int64()), ("full_before", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("crcs", pa.list_(pa.int64())), ("ids", pa.binary())))],
                    names=["part", "key", "row_no", "n", "full_before", "rest", "rank", "crcs", "ids"],
                )

    made = kept(docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).mapInArrow(tokens, "part int, key long, row_no long, n long, full_before long, rest int, rank long, crcs array<long>, ids binary"), "packing-ids")
    counts = kept(made.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / window)).alias("full")), "packing-counts")
    histogram = {r.rest: r.c for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect()}  # at most a row a length
    before, at = {}, 0
    for r in counts.groupBy("part").agg(F.sum("full").alias("full")).orderBy("part").collect():  # a row a partition
        before[r.part], at = at, at + r.full
    plan, whole_windows = Plan(histogram, window, slack), at
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "rest", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("earlier"))
    # by sorting: the table of offsets grows with the number of partitions, so it is not broadcast
    ranked = made.drop("ids").join(offsets.hint("merge"), ["part", "rest"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier")
    shared = spark.sparkContext.broadcast((plan, before))  # bounded: a few entries a length, one a partition
    out_type = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part int, row_no long, rest int, rank long"
    names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "row_no", "rest", "rank"]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = shared.value
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = (r["part"], r["row_no"], r["rest"], r["rank"])
                first = before[r["part"]] + r["full_before"]
                rows += [(r["key"], i * window, window, r["crcs"][i], r["n"], first + i, 0, *own) for i in range(r["n"] // window)]
                if r["rest"]:
                    found = plan.whole(r["rest"], r["rank"])
                    start = r["n"] - r["rest"]
                    rows.append((r["key"], start, r["rest"], r["crcs"][-1], r["n"], whole_windows + found[0] if found else None, found[1] if found else None, *own))
            yield batch_of(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, _ = shared.value
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u2" if end_id < 65536 else "<u4").astype("<u4")
                for at, n, sequence, offset in plan.cut(r["rest"], r["rank"]):
                    rows.append((r["key"], r["start"] + at, n, zlib.crc32(ids[at : at + n].tobytes()), r["doc_tokens"], whole_windows + sequence, offset, r["part"], r["row_no"], r["rest"], r["rank"]))
            yield batch_of(rows)

    placed = ranked.mapInArrow(place, out_type)
    if plan.full or plan.tails:
        placed = kept(placed, "packing-placed")
        loose = kept(placed.where("sequence_id is null"), "packing-loose")
        pieces = loose.join(made.select("part", "row_no", "ids"), ["part", "row_no"]).mapInArrow(cut, out_type)
        placed = placed.where("sequence_id is not null").unionByName(pieces)
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
