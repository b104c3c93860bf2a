"""Token ids as binary shards with a minimal perfect hash index (operator 8).

``write`` encodes whole texts, appends the end id and writes shards in ascending order of the key: a payload of raw
little-endian ids (16 bits where the vocabulary allows, else 32), and an index. The index of a shard maps each distinct key
to a slot by a minimal perfect hash (cascaded bit arrays: a key sits at the first level where no other key meets it); the
slot holds a fingerprint of the key, the place of its first row and the number of its rows.

An index is laid out to be read in place. After its header, a look-up reads a block of bits with their rank for each level
it visits (under two on average), one slot, the start of the rows and one slice of the payload, whatever the shard holds.
``fetch`` finds the shards of a key by bisection and looks it up so; ``read_back`` returns every row through the index, and
reads payloads in runs.

Rows: equal keys lie next to each other, in the order of their texts; repeated rows are stored each. A null key sorts first
and is kept in the shard, outside the hash. A null text is empty and gives the end id alone. Very long texts are encoded
whole, one at a time. An empty table gives no shards and no rows. Only the key and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import fresh, parts, ship, slices, text_of
from .tokens import encoder, public, size_of
from .wordhash import mix

MAGIC = b"SGIDS002"
_GAMMA = 2.0
#: Bits in a block of a level, and its bytes: the rank of its first bit, then the bits.
_BLOCK, _BLOCK_BYTES = 512, 8 + 64
_HEAD = 4096
_SLOT = np.dtype([("print", "<u4"), ("row", "<i8"), ("count", "<i8")])
_RUN = 1 << 24


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: slots 0..n-1, one for each key."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = []
        base = 0
        for bits in levels:
            ones = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(base + ones - 1)
            base += int(ones[-1]) if len(ones) else 0
        self.base = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, most_levels: int = 32) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left) and len(levels) < most_levels:
            size = max(8, int(len(left) * _GAMMA))
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key that was built in; any slot, or -1, for other keys."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                return out
            at = self._place(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.base + at[hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys.astype(np.uint64) ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


def _blocks(bits: np.ndarray, base: int) -> bytes:
    """A level as blocks, each with the number of ones before it in this and all earlier levels."""
    padded = np.zeros(-(-len(bits) // _BLOCK) * _BLOCK, bool)
    padded[: len(bits)] = bits
    rows = padded.reshape(-1, _BLOCK)
    before = base + np.concatenate([[0], np.cumsum(rows.sum(axis=1))])[:-1]
    out = np.zeros((len(rows), _BLOCK_BYTES), np.uint8)
    out[:, :8] = before.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = np.packbits(rows, axis=1, bitorder="little")
    return out.tobytes()


def _index_bytes(keys: np.ndarray, known: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    """Index of one shard. keys, known (not null), lengths: of its rows in their order."""
    first = np.flatnonzero(known & np.concatenate([[True], (keys[1:] != keys[:-1]) | ~known[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(keys))
    distinct = keys[first]
    hashed = PerfectHash.build(distinct)
    slots = np.zeros(len(first), _SLOT)
    at = hashed.slots(distinct)
    slots["print"][at], slots["row"][at], slots["count"][at] = fingerprints(distinct), first, ends - first
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    parts, base = {}, 0
    for i, bits in enumerate(hashed.levels):
        parts[f"level{i}"] = _blocks(bits, base)
        base += int(bits.sum())
    parts |= {"rest": hashed.rest.astype("<u8").tobytes(), "slots": slots.tobytes(), "starts": starts.tobytes(), "keys": keys.astype("<i8").tobytes(), "known": np.packbits(known).tobytes()}
    places, end = {}, _HEAD
    for name, data in parts.items():
        places[name] = (end, len(data))
        end += len(data)
    head = json.dumps({"width": width, "rows": len(keys), "levels": [len(x) for x in hashed.levels], "alone": base, "places": places}).encode()
    if len(head) > _HEAD - 12:
        raise ValueError("the header of an index is too long")
    return (MAGIC + len(head).to_bytes(4, "little") + head).ljust(_HEAD, b"\0") + b"".join(parts.values())


class Shard:
    """An open shard. Only the header of its index is held; everything else is read where it lies."""

    def __init__(self, payload: str, index: str):
        self.index, self.payload = files.open_read(index), files.open_read(payload)
        data = self.index.read(_HEAD)
        if data[:8] != MAGIC:
            raise ValueError(f"{index} is not an index of token shards")
        head = json.loads(data[12 : 12 + int.from_bytes(data[8:12], "little")])
        self.width, self.rows, self.levels, self.alone, self.places = head["width"], head["rows"], head["levels"], head["alone"], head["places"]

    def _read(self, name: str, at: int, size: int) -> bytes:
        self.index.seek(self.places[name][0] + at)
        return self.index.read(size)

    def _all(self, name: str, kind) -> np.ndarray:
        return np.frombuffer(self._read(name, 0, self.places[name][1]), kind)

    def slot(self, key: int) -> int:
        """The slot of a key that was built in; any slot, or -1, for others."""
        own = np.array([key], np.int64).astype(np.uint64)
        for level, size in enumerate(self.levels):
            place = int(PerfectHash._place(own, level, size)[0])
            block = self._read(f"level{level}", place // _BLOCK * _BLOCK_BYTES, _BLOCK_BYTES)
            bits = int.from_bytes(block[8:], "little")
            if bits >> place % _BLOCK & 1:
                return int.from_bytes(block[:8], "little") + (bits & (1 << place % _BLOCK) - 1).bit_count()
        rest = self._all("rest", "<u8")  # keys that met others at every level: hardly ever any
        at = int(np.searchsorted(rest, own[0]))
        return self.alone + at if at < len(rest) and rest[at] == own[0] else -1

    def find(self, key: int) -> tuple[int, int]:
        """First row and number of rows of a key; 0 rows where the stored fingerprint differs."""
        at = self.slot(key)
        if at < 0:
            return 0, 0
        r = np.frombuffer(self._read("slots", at * _SLOT.itemsize, _SLOT.itemsize), _SLOT)[0]
        return (int(r["row"]), int(r["count"])) if r["print"] == fingerprints(np.array([key], np.int64))[0] else (0, 0)

    def ids(self, row: int) -> np.ndarray:
        a, b = np.frombuffer(self._read("starts", row * 8, 16), "<i8").tolist()
        return self._ids(a, b)

    def _ids(self, a: int, b: int) -> np.ndarray:
        self.payload.seek(a * self.width)
        return np.frombuffer(self.payload.read((b - a) * self.width), f"<u{self.width}")

    def whole(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Runs of rows with keys, known, starts, lengths and ids. Raises where the hash does not lead to a key's rows."""
        starts, keys, known = self._all("starts", "<i8"), self._all("keys", "<i8"), np.unpackbits(self._all("known", np.uint8), count=self.rows).astype(bool)
        slots, levels = self._all("slots", _SLOT), []
        for i, size in enumerate(self.levels):
            rows = self._all(f"level{i}", np.uint8).reshape(-1, _BLOCK_BYTES)
            levels.append(np.unpackbits(rows[:, 8:], axis=1, bitorder="little").ravel()[:size].astype(bool))
        hashed = PerfectHash(levels, self._all("rest", "<u8"))
        for x, y in slices(np.diff(starts).tolist(), _RUN):
            own = np.arange(x, y)
            at = hashed.slots(keys[own])
            good = at >= 0
            found = slots[np.where(good, at, 0)] if len(slots) else np.zeros(len(own), _SLOT)
            good &= (found["print"] == fingerprints(keys[own])) & (found["row"] <= own) & (own < found["row"] + found["count"])
            if not (good | ~known[own]).all():
                raise ValueError("the index does not lead to its keys")
            data = self._ids(int(starts[x]), int(starts[y]))
            cuts = starts[x : y + 1] - starts[x]
            yield keys[own], known[own], starts[x:y], np.diff(cuts), [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def write(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0, width: int | None = None) -> list[dict]:
    """Write the shards of ``docs``; return one entry a shard, in key order, with ``base``: the ids of all shards before it.

    ``width``: bytes of an id, 2 or 4; by default what the vocabulary needs. Raises where its ids don't fit.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or public("byte_bpe_50k.json")
    most = max(size_of(path) - 1, end_id)
    width = width or (2 if most < 1 << 16 else 4)
    if width not in (2, 4) or most >= 1 << 8 * width:
        raise ValueError(f"ids up to {most} don't fit in {width} bytes")
    folder = fresh(spark, "ids")
    files.make_folder(folder)
    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    n = max(parts(docs), 1)
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"), "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, out, keys, known, lengths = files.own_name(folder, "shard"), None, [], [], []
        enc, end = encoder("byte", path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or files.open_write(f"{name}.ids")
            column = batch.column("key")
            known.append(np.array(column.is_valid()))
            keys.append(np.array(column.fill_null(0)))
            for x in batch.column("text"):
                data = enc.encode(x.as_py()) + end
                lengths.append(len(data) // 4)
                out.write(data if width == 4 else np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes())
        if out is None:
            return
        out.close()
        keys, known = np.concatenate(keys), np.concatenate(known)
        with files.open_write(f"{name}.idx") as f:
            f.write(_index_bytes(keys, known, np.array(lengths, np.int64), width))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([sum(lengths)], pa.int64()), "least": pa.array(keys[known][:1].tolist() or [None], pa.int64()), "most": pa.array(keys[known][-1:].tolist() or [None], pa.int64())})

    found = rows.mapInArrow(shard, "part int, name string, n_docs long, n_ids long, least long, most long").collect()  # a row a shard
    manifest, base = [], 0
    for r in sorted(found, key=lambda r: r.part):
        manifest.append(r.asDict() | {"base": base})
        base += r.n_ids
    return manifest


def fetch(manifest: list[dict], keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the rows of some keys: a shard by bisection, a slot by the hash, a slice of the payload."""
    shards = [m for m in manifest if m["least"] is not None]
    least, out, opened = [m["least"] for m in shards], {}, {}
    for k in sorted(set(keys)):
        i, own = bisect.bisect_right(least, k) - 1, []
        while i >= 0 and shards[i]["most"] >= k:  # a repeated key can lie in several shards
            own.append(i)
            i -= 1
        for i in reversed(own):
            if i not in opened:
                opened = {i: Shard(f"{shards[i]['name']}.ids", f"{shards[i]['name']}.idx")}  # keys ascend: one is open at a time
            first, n = opened[i].find(k)
            if n:
                out.setdefault(k, []).extend(opened[i].ids(first + j) for j in range(n))
    return out


def read_back(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Every row of the shards: key, start (ids before it in all shards), n_tokens, ids_crc32 of its 32-bit ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                for keys, known, starts, lengths, ids in Shard(f"{m['name']}.ids", f"{m['name']}.idx").whole():
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array(keys, pa.int64(), mask=~known),
                            "start": pa.array(m["base"] + starts, pa.int64()),
                            "n_tokens": pa.array(lengths, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        }
                    )

    return files.each_file(spark, [(m["name"], m["base"]) for m in manifest], "name string, base long", rows, "key long, start long, n_tokens long, ids_crc32 long")
