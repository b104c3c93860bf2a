"""Online history: keyed state that turns each event into the features it had before it, then records it.

Events of an entity are taken in the order (t, id) within a batch. An event older than the entity's last one, or with its
last id again, gets a status and leaves the state alone. Buffered events older than the longest window are dropped by event
time; totals, the last event and the entity itself never expire. All accepted events of a batch are worked out together,
from prefix sums over the buffer and them, so the cost of an event does not grow with the buffer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import EARTH_KM, HistorySpec, day_angle, feature_names, half_width_table, haversine_km
from ..sources.scratch import kept

FORMAT = "history-state-2"
OLD_FORMATS = ("history-state-1",)
#: What is known of an event: t, amount, time of day on a circle, distance from home, place.
VALUES = ("t", "amount", "angle", "home_km", "lat", "lon")
TOTALS = ("n", "amount", "amount2", "home_km", "cos", "sin")


def prepared(df: DataFrame, s: HistorySpec, home: tuple[str, str], place: tuple[str, str], ts: str) -> DataFrame:
    """The columns that state is made of: entity, event_id, ``VALUES``, contexts (array, ``<NA>`` for nulls), state (null)."""
    contexts = [F.coalesce(F.col(c).cast("string"), F.lit("<NA>")) for c in s.contexts]
    return df.select(
        F.col(s.entity).cast("string").alias("entity"), F.col(s.seq).cast("long").alias("event_id"), F.col(s.t).cast("long").alias("t"), F.col(s.amount).cast("double").alias("amount"),
        day_angle(F.col(ts)).alias("angle"), haversine_km(*[F.col(c) for c in (*home, *place)]).alias("home_km"), F.col(place[0]).alias("lat"), F.col(place[1]).alias("lon"),
        (F.array(*contexts) if contexts else F.array().cast("array<string>")).alias("contexts"), F.lit(None).cast("string").alias("state"),
    )


INPUT = "entity string, event_id long, t long, amount double, angle double, home_km double, lat double, lon double, contexts array<string>, state string"


def longest(s: HistorySpec, days: tuple[int, ...]) -> int:
    return max([*s.windows_h, s.deviation_h, *[24 * d for d in days]]) * s.unit


class Entity:
    """State of one entity: buffered events, totals of all time (also by context value), count, last event and its id."""

    def __init__(self, s: HistorySpec, days: tuple[int, ...] = (7, 30)):
        self.s, self.days, self.names = s, days, feature_names(s, days)
        self.buffer = np.zeros((0, len(VALUES)))
        self.contexts: list[list[str]] = []
        self.totals = dict.fromkeys(TOTALS, 0.0)
        self.by_context: list[dict[str, float]] = [{} for _ in s.contexts]
        self.last: list[float] | None = None
        self.last_id: int | None = None

    def process(self, values: np.ndarray, ids: np.ndarray, contexts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """Statuses and features (a row an event, NaN for none) of events sorted by (t, id); accepted ones are recorded."""
        late = values[:, 0] < (self.last[0] if self.last is not None else -np.inf)
        status = np.where(late, "out_of_order", "ok").astype(object)
        good = np.flatnonzero(~late)
        before = np.concatenate([[-1 if self.last_id is None else self.last_id], ids[good][:-1]]) if len(good) else np.zeros(0)
        again = (ids[good] == before) & ((np.arange(len(good)) > 0) | (self.last_id is not None))
        status[good[again]] = "duplicate"
        good = good[~again]
        out = np.full((len(values), len(self.names)), np.nan)
        if len(good):
            out[good] = self._features(values[good], [contexts[i] for i in good])
            self._record(values[good], ids[good], [contexts[i] for i in good])
        return status.tolist(), out

    def _features(self, new: np.ndarray, contexts: list[list[str]]) -> np.ndarray:
        s, k = self.s, len(self.buffer)
        all_ = np.concatenate([self.buffer, new])
        t, amount, angle, home = all_[:, 0], all_[:, 1], all_[:, 2], all_[:, 3]
        own = np.arange(k, len(all_))
        sums = {n: np.concatenate([[0.0], np.cumsum(x)]) for n, x in (("a", amount), ("q", amount * amount), ("h", home), ("c", np.cos(angle)), ("s", np.sin(angle)))}
        low = {w: np.searchsorted(t, t[own] - w * s.unit, "right") for w in {*s.windows_h, s.deviation_h, *[24 * d for d in self.days]}}
        within = lambda n, w: sums[n][own] - sums[n][low[w]]
        f: dict[str, np.ndarray] = {"h_n_prior": self.totals["n"] + np.arange(len(new))}
        for w in s.windows_h:
            f[f"h_cnt_{w}h"], f[f"h_amt_{w}h"] = (own - low[w]).astype(float), within("a", w)
        x = amount[own]
        for i, c in enumerate(s.contexts):
            value = np.array([*(r[i] for r in self.contexts), *(r[i] for r in contexts)], object)
            count, total = ({w: np.zeros(len(new)) for w in {*s.windows_h, s.deviation_h}} for _ in range(2))
            for v in dict.fromkeys(r[i] for r in contexts):
                at = np.flatnonzero(value == v)
                tv, sv = t[at], np.concatenate([[0.0], np.cumsum(amount[at])])
                mine = np.flatnonzero(at >= k)
                rows = at[mine] - k
                for w in count:
                    lo = np.searchsorted(tv, tv[mine] - w * s.unit, "right")
                    count[w][rows], total[w][rows] = mine - lo, sv[mine] - sv[lo]
            for w in s.windows_h:
                f[f"h_{c}_cnt_{w}h"], f[f"h_{c}_amt_{w}h"] = count[w], total[w]
            f[f"h_amt_to_{c}_mean"] = _over(x, _mean(total[s.deviation_h], count[s.deviation_h]))
        last = np.concatenate([[self.last if self.last is not None else [np.nan] * len(VALUES)], new[:-1]])
        gap = new[:, 0] - last[:, 0]
        f["h_hours_since_last"], f["h_prev_amt"] = gap / s.unit, last[:, 1]
        f["h_amt_to_prev"] = _over(x, last[:, 1])
        f["h_km_to_prev"] = _km(last[:, 4], last[:, 5], new[:, 4], new[:, 5])
        gap_s = gap * 3600 / s.unit
        with np.errstate(divide="ignore", invalid="ignore"):
            f["h_speed_kmh"] = np.where(gap_s >= s.min_gap_s, f["h_km_to_prev"] / (gap_s / 3600), np.nan)
        w = s.deviation_h
        n = (own - low[w]).astype(float)
        mean = _mean(within("a", w), n)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(np.maximum((within("q", w) - n * mean * mean) / (n - 1), 0))
            f["h_amt_z"] = np.where((n > 1) & (spread > 0), (x - mean) / spread, np.nan)
        f["h_amt_mean"], f["h_amt_to_mean"] = mean, _over(x, mean)
        f["h_home_km_mean"] = _mean(within("h", w), n)
        f["h_home_km_ratio"] = _over(home[own], f["h_home_km_mean"])
        for d in self.days:
            w = 24 * d
            n, c, z = (own - low[w]).astype(float), within("c", w), within("s", w)
            enough = n >= s.min_prior
            r = np.where(enough, np.sqrt(c * c + z * z) / np.maximum(n, 1), np.nan)
            away = np.abs(np.mod(angle[own] - np.arctan2(z, c) + math.pi, 2 * math.pi) - math.pi)
            f[f"h_vm{d}_n"], f[f"h_vm{d}_r"] = n, r
            f[f"h_vm{d}_hours"] = np.where(enough, away * 12 / math.pi, np.nan)
            f[f"h_vm{d}_inside"] = np.where(enough, (away <= _half_width(_kappa(r))).astype(float), np.nan)
        return np.stack([f[n] for n in self.names], 1)

    def _record(self, new: np.ndarray, ids: np.ndarray, contexts: list[list[str]]) -> None:
        keep = np.concatenate([self.buffer, new])
        first = int(np.searchsorted(keep[:, 0], keep[-1, 0] - longest(self.s, self.days), "right"))
        self.buffer, self.contexts = keep[first:], [*self.contexts, *contexts][first:]
        a, angle = new[:, 1], new[:, 2]
        for name, x in zip(TOTALS, (np.ones(len(new)), a, a * a, new[:, 3], np.cos(angle), np.sin(angle)), strict=True):
            self.totals[name] += float(x.sum())
        for row, x in zip(contexts, a.tolist(), strict=True):
            for held, v in zip(self.by_context, row, strict=True):
                held[v] = held.get(v, 0.0) + x
        self.last, self.last_id = new[-1].tolist(), int(ids[-1])

    def snapshot(self) -> str:
        return json.dumps({"format": FORMAT, "buffer": self.buffer.tolist(), "contexts": self.contexts, "totals": self.totals, "by_context": self.by_context, "last": self.last, "last_id": self.last_id})

    @classmethod
    def restore(cls, s: HistorySpec, days: tuple[int, ...], text: str) -> Entity:
        d = json.loads(text)
        if d.get("format") != FORMAT:
            raise ValueError(f"state of format {d.get('format')}, not {FORMAT}")
        out = cls(s, days)
        out.buffer = np.array(d["buffer"], float).reshape(-1, len(VALUES))
        out.contexts, out.totals, out.by_context, out.last, out.last_id = d["contexts"], d["totals"], d["by_context"], d["last"], d["last_id"]
        return out


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, total / n, np.nan)


def _over(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(by > 0, x / by, np.nan)


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    a = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(a))


def _kappa(r: np.ndarray) -> np.ndarray:
    r = np.minimum(r, 0.9999)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.where(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6, np.where(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r), 1 / (r**3 - 4 * r * r + 3 * r)))
    return np.clip(k, 0, 1000)


def _half_width(k: np.ndarray) -> np.ndarray:
    return np.where(k <= 1e-6, math.pi, np.interp(k, *half_width_table()))


def online_history(events: DataFrame, s: HistorySpec, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """events (streaming): the columns of ``INPUT``. A row an event: entity, event_id, t, status and all features.

    Rows with ``state`` are snapshots: they set the entity's state, ahead of the events of their batch, and give no row.
    """
    names = feature_names(s, days)
    out = "entity string, event_id long, t long, status string, " + ", ".join(f"`{n}` double" for n in names)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Entity.restore(s, days, state.get[0]) if state.exists else Entity(s, days)
        rows = pd.concat(list(frames), ignore_index=True)
        for text in rows.loc[rows["state"].notna(), "state"]:
            own = Entity.restore(s, days, text)
        rows = rows[rows["state"].isna()].sort_values(["t", "event_id"], kind="stable")
        status, found = own.process(rows[list(VALUES)].to_numpy(float), rows["event_id"].to_numpy(np.int64), [list(x) for x in rows["contexts"]])
        state.update((own.snapshot(),))
        if len(rows):
            yield pd.concat([pd.DataFrame({"entity": key[0], "event_id": rows["event_id"].to_numpy(), "t": rows["t"].to_numpy(), "status": status}), pd.DataFrame(found, columns=names)], axis=1)

    return events.groupBy("entity").applyInPandasWithState(step, out, "state string", "append", GroupStateTimeout.NoTimeout)


def replay(events: DataFrame, s: HistorySpec, folder: str, name: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Run a batch of events (and snapshots) through the stream once, and return what it wrote. events: the columns of ``INPUT``."""
    spark = events.sparkSession
    events.write.parquet(f"{folder}/{name}-in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/{name}-in")
    query = online_history(stream, s, days).writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/{name}-out")


def bulk_state(events: DataFrame, s: HistorySpec, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, state: the snapshots that a replay of ``events`` (the columns of ``INPUT``) leaves, in one aggregation.

    Buffers are cut against the largest t of all rows. What is gathered of an entity is its events of the longest window.
    """
    most = events.agg(F.max("t")).scalar()
    row = F.struct("t", "event_id", *VALUES[1:], "contexts")
    recent = F.sort_array(F.collect_list(F.when(F.col("t") > most - longest(s, days), row)))
    a, z = F.col("amount"), F.col("angle")
    by = events.groupBy("entity").agg(
        recent.alias("recent"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("amount"), F.sum(a * a).alias("amount2"), F.sum("home_km").alias("home_km"),
        F.sum(F.cos(z)).alias("cos"), F.sum(F.sin(z)).alias("sin"), F.max(row).alias("last"),
    )
    values = lambda x: F.array(*[x[c].cast("double") for c in VALUES])
    totals = None
    for i in range(len(s.contexts)):
        one = events.groupBy("entity", F.col("contexts")[i].alias("v")).agg(F.sum("amount").alias("x")).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("v", "x"))).alias(f"m{i}"))
        totals = one if totals is None else totals.join(one, "entity")
    joined = by.join(totals, "entity") if totals is not None else by
    maps = [F.col(f"m{i}") for i in range(len(s.contexts))]
    state = F.to_json(F.struct(
        F.lit(FORMAT).alias("format"), F.transform("recent", values).alias("buffer"), F.transform("recent", lambda x: x["contexts"]).alias("contexts"), F.struct(*TOTALS).alias("totals"),
        (F.array(*maps) if maps else F.array().cast("array<map<string,double>>")).alias("by_context"), values(F.col("last")).alias("last"), F.col("last.event_id").alias("last_id"),
    ))
    return joined.select("entity", state.alias("state"))


def as_input(states: DataFrame) -> DataFrame:
    """Snapshots as rows of ``INPUT``, to feed to a stream ahead of events."""
    empty = {c.split(" ")[0]: c.split(" ")[1] for c in INPUT.split(", ")}
    return states.select(*[F.col(n) if n in ("entity", "state") else F.lit(None).cast(k).alias(n) for n, k in empty.items()])


def save_states(states: DataFrame, path: str) -> None:
    """Snapshots as a table with their format."""
    states.withColumn("format", F.lit(FORMAT)).write.parquet(path)


def load_states(spark, path: str) -> DataFrame:
    """Snapshots of a stored table; other formats are refused."""
    stored = spark.read.parquet(path)
    if other := [r[0] for r in stored.select("format").distinct().collect() if r[0] != FORMAT]:
        raise ValueError(f"states of format {other}, not {FORMAT}")
    return stored.drop("format")


def upgraded(old: DataFrame, events: DataFrame, s: HistorySpec, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """States of this format from a stored table of any known one: older ones lack what the features need and are built from the events again."""
    found = {r[0] for r in old.select("format").distinct().collect()}
    if found <= {FORMAT}:
        return old.drop("format")
    if unknown := found - {FORMAT, *OLD_FORMATS}:
        raise ValueError(f"states of format {sorted(unknown)}")
    return bulk_state(events, s, days)


def parity(online: DataFrame, batch: DataFrame, key: str, names: list[str], within: float = 1e-6) -> DataFrame:
    """feature, n, n_differ: events whose online and batch values are more than ``within`` (or that share of them) apart, or null on one side only."""
    o = online.select(F.col(key).alias("_k"), *[F.nanvl(F.col(n).cast("double"), F.lit(None)).alias(f"o_{n}") for n in names])
    both = batch.join(o, batch[key] == F.col("_k"))

    def off(n: str) -> Column:
        a, b = F.col(n).cast("double"), F.col(f"o_{n}")
        return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > within * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))

    wide = both.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(off(n)).alias(n) for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col("_n").alias("n"), F.col(n).alias("n_differ")) for n in names]))
    return wide.select(rows.alias("x")).select("x.*")


def shadowed(slow: DataFrame, fast: DataFrame, key: str, names: list[str], first: int = 50, within: float = 1e-6) -> tuple[DataFrame, bool]:
    """``fast``, if it agrees with ``slow`` on the ``first`` events by key, else ``slow``; and whether it did."""
    asked = kept(slow.orderBy(key).limit(first), "shadow")
    bad = parity(fast, asked, key, names, within).where(f"n_differ > 0 or n < {asked.count()}").count()
    return (slow, False) if bad else (fast, True)


class SingleWriter:
    """A lock file that one writer at a time can hold: made only where there is none, on any file system of Spark's."""

    def __init__(self, spark, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __enter__(self) -> SingleWriter:
        if not self.system.createNewFile(self.path):
            raise RuntimeError(f"{self.path.toString()}: another writer is at work")
        return self

    def __exit__(self, *_) -> None:
        self.system.delete(self.path, False)
