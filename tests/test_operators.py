import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamgauge.functions import requests, scalars
from streamgauge.functions.steps import Pipeline, step
from streamgauge.functions.views import ModelView
from streamgauge.operators import audit, history, metrics, models, neighbours, ranking, relational, splits
from streamgauge.plans import bundle, runs
from streamgauge.sources import readers
from streamgauge.sources.contracts import EVENTS, Declared, column, missing_fields
from streamgauge.streaming import stateful
from streamgauge.streaming.stateful import Entity


def brute(rows, width):
    """rows: (entity, t, seq, amount). Prior count and sum of each."""
    out = {}
    for e, t, s, _ in rows:
        own = [a for f, u, r, a in rows if f == e and (u, r) < (t, s) and u > t - width]
        out[s] = (len(own), sum(own))
    return out


def test_windows_with_ties_and_borders(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), rng.randint(0, 40), i, float(rng.randint(1, 9))) for i in range(300)] + [(9, 0, 1000, 1.0), (9, 10, 1001, 2.0), (9, 10, 1002, 3.0)]
    df = spark.createDataFrame(rows, "e int, t long, s int, a double")
    spec = history.HistorySpec("e", "t", "s", "a", (), (1, 10), unit=1)
    got = {r.s: r for r in history.entity_history(df, spec).collect()}
    for w in (1, 10):
        for s, (n, total) in brute(rows, w).items():
            assert (got[s][f"h_cnt_{w}h"], got[s][f"h_amt_{w}h"]) == (n, total)
    assert got[1001]["h_cnt_10h"] == 0 and got[1002]["h_cnt_10h"] == 1


@pytest.mark.parametrize("block", [3, 1000])
def test_windows_split_by_time(spark, block):
    rng = random.Random(4)
    rows = [(rng.choice([0, 1, None]), rng.randint(-20, 40), i, float(rng.randint(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "e int, t long, s int, a double")
    got = {r.s: r for r in history.split_windows(df, ["e"], "t", "s", {"one": 1, "ten": 10}, {"a": F.col("a")}, block).collect()}
    for name, w in (("one", 1), ("ten", 10)):
        for s, (n, total) in brute(rows, w).items():
            assert (got[s][f"{name}_n"], got[s][f"{name}_a"]) == (n, total)


def test_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 9))])) for _ in range(200)] + [("c", None)]
    got = {r.g: list(r)[1:] for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.0, 0.25, 0.5, 0.9, 1.0], ("g",)).collect()}
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], [0.0, 0.25, 0.5, 0.9, 1.0]) for g in ("a", "b", None)}
    assert set(got) == set(want) and all(np.allclose(got[g], want[g]) for g in want)
    assert ranking.medians(spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double"), ["x", "y"]) == {"x": 1.5, "y": None}


def test_future_never_changes_the_past(spark):
    rows = [(1, t, t, float(t)) for t in range(50)]
    spec = history.HistorySpec("e", "t", "s", "a", (), (5,), unit=1)
    df = spark.createDataFrame(rows, "e int, t long, s int, a double")
    whole = {r.s: r.h_amt_5h for r in history.entity_history(df, spec).collect()}
    part = {r.s: r.h_amt_5h for r in history.entity_history(df.where("t < 30"), spec).collect()}
    assert all(whole[s] == v for s, v in part.items())


def test_state_machine_equals_windows():
    rng = random.Random(2)
    s = history.HistorySpec("e", "t", "s", "a", ("c",), (5, 20), deviation_h=20, unit=1)
    own, seen, names = Entity(s, (1,)), [], history.feature_names(s, (1,))
    rows = sorted((t, i) for i, t in enumerate(rng.choices(range(60), k=80)))
    at = 0
    while at < len(rows):  # batches of any size give what one by one would
        part = rows[at : at + rng.randint(1, 9)]
        values = [[t, float(i), 1.0, 2.0, 3.0, 4.0] for t, i in part]
        status, out = own.process(np.array(values), np.array([i for _, i in part]), [["xy"[i % 2]] for _, i in part])
        for (t, i), st, f in zip(part, status, out):
            f = dict(zip(names, f))
            assert st == "ok" and f["h_n_prior"] == len(seen)
            for w in (5, 20):
                past = [(a, c) for u, a, c in seen if u > t - w]
                assert (f[f"h_cnt_{w}h"], f[f"h_amt_{w}h"]) == (len(past), sum(a for a, _ in past))
                mine = [a for a, c in past if c == "xy"[i % 2]]
                assert (f[f"h_c_cnt_{w}h"], f[f"h_c_amt_{w}h"]) == (len(mine), sum(mine))
            seen.append((t, float(i), "xy"[i % 2]))
        at += len(part)
        own = Entity.restore(s, (1,), own.snapshot())
    one = lambda t, i: own.process(np.array([[t, 1.0, 1.0, 2.0, 3.0, 4.0]]), np.array([i]), [["x"]])[0]
    assert one(*rows[-1]) == ["duplicate"] and one(-1, 999) == ["out_of_order"] and one(100, 1000) == ["ok"]
    assert own.totals["n"] == 81 and len(own.buffer) == 1
    with pytest.raises(ValueError):
        Entity.restore(s, (1,), json.dumps({"format": "old"}))


def test_states_are_refused_and_upgraded(spark, tmp_path):
    s = history.HistorySpec("e", "t", "s", "a", (), (5,), unit=1)
    rows = spark.createDataFrame([("a", i, i, 1.0, 0.0, 0.0, 0.0, 0.0, [], None) for i in range(3)], stateful.INPUT)
    states = stateful.bulk_state(rows, s)
    stateful.save_states(states, str(tmp_path / "new"))
    assert stateful.load_states(spark, str(tmp_path / "new")).collect() == states.collect()
    old = states.withColumn("format", F.lit("history-state-1"))
    old.write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        stateful.load_states(spark, str(tmp_path / "old"))
    assert stateful.upgraded(old, rows, s).collect() == states.collect()
    with pytest.raises(ValueError):
        stateful.upgraded(states.withColumn("format", F.lit("?")), rows, s)
    with stateful.SingleWriter(spark, str(tmp_path / "lock")):
        with pytest.raises(RuntimeError), stateful.SingleWriter(spark, str(tmp_path / "lock")):
            pass
    with stateful.SingleWriter(spark, str(tmp_path / "lock")):
        pass


def test_running_sums_and_ranks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(0, 9), float(rng.randint(0, 5))) for i in range(500)]
    df = spark.createDataFrame(rows, "s int, c string, t int, x double").repartition(7)
    total, seen = 0.0, {}
    for i, c, t, x in sorted(rows, key=lambda r: (r[2], -r[0])):
        total += x
        seen[i] = total
    out = ranking.running(df, ["t", F.desc("s")], {"up": F.col("x"), "before": F.col("x")}, exclusive=("before",))
    assert {r.s: r.up for r in out.collect()} == seen and all(r.up - r.before == r.x for r in out.collect())
    want = {r[0]: n for c in "ab" for n, r in enumerate(sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0])), 1)}
    assert {r.s: r.rank for r in ranking.ranked(df, ["t", "s"], within=("c",)).collect()} == want
    by = sorted(rows)
    assert ranking.steps(df, ["s"], "t", [F.count_if(F.col("t") < F.col("_previous")).alias("n")]).first().n == sum(a[2] > b[2] for a, b in zip(by, by[1:]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert ranking.running(df.limit(0), ["s"], {"n": F.lit(1)}).count() == 0


def test_half_width_table():
    grid, width = history.half_width_table()
    assert abs(width[0] - 0.9 * 3.14159265) < 1e-2 and abs(width[-1] - 0.0520) < 1e-3
    assert all(a >= b for a, b in zip(width, width[1:]))


def test_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(ValueError):
        relational.left_join_one_to_one(a, b, ["k"])
    assert {(r.k, r.f) for r in relational.flag_existing(a, b, ["k"], "f").collect()} == {(1, 1), (2, 0)}
    assert relational.keep_first(a.withColumn("s", F.monotonically_increasing_id()), ["k"], "s").count() == 2


def test_splits(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(200)], "seq int, t int")
    out = splits.temporal_split(df, "t")
    assert splits.check_parts(out, "seq") == {"rows": 200, "distinct": 200, "none": 0}
    assert out.groupBy("t").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    gap = splits.temporal_split(df, "t", gap=3)
    assert splits.check_parts(gap, "seq")["none"] > 0
    for wrong in [dict(df=df.where("t = 0")), dict(df=df, fractions=(0.5, 0.1, 0.1)), dict(df=df.withColumn("t", F.when(F.col("t") > 5, F.col("t"))))]:
        with pytest.raises(ValueError):
            splits.temporal_split(t="t", **wrong)
    assert splits.violations(out, "seq", "t", ("train", "validation", "holdout")) == [] and splits.violations(gap, "seq", "t", ("train", "validation", "holdout"), gap=3) == []
    assert "gap violated between train and validation" in splits.violations(out, "seq", "t", ("train", "validation", "holdout"), gap=9)
    assert "part other empty" in splits.violations(out, "seq", "t", ("train", "other"))
    assert len(splits.violations(df.withColumn("part", F.when(F.col("t") < 50, "a").otherwise("b")).withColumn("y", (F.col("t") < 50).cast("int")), "seq", None, ("a", "b"), y="y")) == 2
    with pytest.raises(RuntimeError):
        splits.check_natural(df.limit(3).withColumn("y", F.lit(1)), df.withColumn("y", F.lit(1)), "x", "y")
    with pytest.raises(ValueError):
        splits.under_sample(df, "t", "seq", role="validation")
    sealed = splits.SealedHoldout(df)
    with pytest.raises(PermissionError):
        sealed.open()
    sealed.lock()
    assert sealed.open().count() == 200
    with pytest.raises(PermissionError):
        sealed.open()


def test_pipeline_round_trip(spark):
    df = spark.createDataFrame([("gmail.com", 1.0, None), ("gmail.com", None, 2.0), ("yahoo.co.uk", 3.0, 4.0), (None, 5.0, None)], "e string, v1 double, v2 double")
    p = Pipeline([
        step("TokenSplit", column="e", output="tok", index=-1), step("FrequencyEncoder", columns=["e"]), step("CategoricalEncoder", columns=["e"]), step("RowMissingCount", pattern=r"v\d", output="n"),
        step("MissingIndicator", columns=["v1", "v2"]), step("MedianImputer", columns=["v1", "v2"]), step("Standardize", columns=["v1"]), step("CategoricalTyper", columns=["e"]),
        step("LogAmount", column="v2", output="l"), step("AmountDecimals", column="v2", output="d"), step("FinalizeFeatures"),
    ]).fit(df)
    rows = p.transform(df).collect()
    assert [round(r.e_freq, 4) for r in rows] == [0.6667, 0.6667, 0.3333, 0.0] and [r.tok for r in rows] == ["com", "com", "uk", None]
    assert [r.n for r in rows] == [1, 1, 0, 1] and [r.e for r in rows] == ["gmail.com", "gmail.com", "yahoo.co.uk", "<NA>"]
    again = Pipeline.from_json(p.to_json())
    assert again.transform(df).collect() == rows and json.loads(again.to_json()) == json.loads(p.to_json())
    with pytest.raises(RuntimeError):
        step("LogAmount", column="v2", output="l").transform(df)
    with pytest.raises(KeyError):
        step("Nothing")


def test_views(spark):
    df = spark.createDataFrame([("a", 1.0)] * 6 + [("b", None)] * 2 + [(None, 3.0)], "c string, x double")
    linear = ModelView("linear", 5).fit(df).transform(df).collect()
    assert sum(r["c=a"] for r in linear) == 6 and sum(r["c=<RARE>"] for r in linear) == 3 and all(r.x is not None for r in linear)
    tree = ModelView("tree").fit(df)
    assert {r.c for r in tree.transform(df).collect()} == {0, 2, 3}
    assert tree.transform(spark.createDataFrame([("new", 0.0)], df.schema)).first().c == 1


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 1), (0.2, 0)], "p double, y int").withColumn("s", F.monotonically_increasing_id())
    assert abs(metrics.average_precision(df, "y", "p").first()[0] - 0.805556) < 1e-6
    assert abs(metrics.roc_auc(df, "y", "p").first()[0] - 4.5 / 6) < 1e-9
    cost = spark.createDataFrame([(1, 1, 100.0), (1, 0, 5.0), (0, 1, 50.0), (0, 0, 7.0), (1, 0, 20.0)], "y int, q int, a double")
    r = metrics.cost(cost, "y", F.col("q") == 1, "a", 2.0).first()
    assert (r.cost, r.base) == (29.0, 125.0) and abs(r.savings - 96 / 125) < 1e-12
    assert metrics.champion([{"name": "dummy", "pr_auc": 1, "brier": 0}, {"name": "a", "pr_auc": 0.5, "brier": 0.2}, {"name": "b", "pr_auc": 0.5, "brier": 0.1}])["name"] == "b"
    slope, _ = metrics.platt(spark.createDataFrame([(i / 100, int(i % 10 < i / 10)) for i in range(1, 100)], "p double, y int"), "y", "p")
    assert slope > 0


def test_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0], int(i < 5)) for i in range(20)], "k long, v array<double>, y int")
    near = {(r.q, r.n) for r in neighbours.nearest(df, df.where("k = 3"), "k", "v", 2).collect()}
    assert near == {(3, 2), (3, 4)}
    made = neighbours.smote(df, "k", "v", "y", 12, k=2).collect()
    assert len(made) == 12 and all(0 <= r.v[0] <= 4 for r in made)
    assert neighbours.edited(df, "k", "v", "y").count() < 20


def test_neighbours_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i * i % 17), float(i % 5)]) for i in range(25)], "k long, v array<double>")
    vectors = {r.k: r.v for r in df.collect()}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(vectors[a], vectors[b])) ** 0.5
    want = {(a, n) for a in vectors for n in sorted((b for b in vectors if b != a), key=lambda b: (far(a, b), b))[:3]}
    for most in (4, 24, 25):
        assert {(r.q, r.n) for r in neighbours.nearest(df, df, "k", "v", 3, most_queries=most).collect()} == want


def test_contracts():
    c = Declared("x", [column("id", "int", "row_id"), column("y", "int", "target")], [column(r"v\d+", "float", "input")], {"row_id": "id", "target": "y"})
    found = c.of(["id", "v1", "odd"])
    assert found["v1"].dataType.simpleString() == "double" and found["odd"].metadata == {"role": "undeclared"} and c.faults() == []
    assert c.names(["id", "v1", "v2", "y"], "input") == ["v1", "v2"] and c.features(["id", "y", "v1", "odd"]) == ["v1", "odd"] and c.required(["id", "y", "v1"]) == ["id", "v1"]
    assert len(Declared("z", [column("y", "int", "input"), column("y", "int", "input")], keys={"target": "y", "entity": "gone"}, dedup=("gone",)).faults()) == 4
    with pytest.raises(ValueError):
        column("a", "int", "nothing")
    with pytest.raises(ValueError):
        c.forbid_answers(["v1", "y"])
    with pytest.raises(KeyError):
        missing_fields(["a"], ["b"])
    assert Declared.from_json(c.to_json()).to_json() == c.to_json() and c.differs(EVENTS.to_json()) == ["fields", "keys", "name", "numbered"]


def test_targets_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "a")], "s int, y int, k string")
    assert [r.y for r in runs.binary_target(df, "y").orderBy("s").collect()] == [0, 1]
    for bad in (df.withColumn("y", F.lit(None).cast("int")), df.withColumn("y", F.lit(2))):
        with pytest.raises(ValueError):
            runs.binary_target(bad, "y")
    with pytest.raises(KeyError):
        runs.binary_target(df, "z")
    with pytest.raises(ValueError):
        runs.matured(df, "s", 5, 1)
    assert df.select(runs.matured(df, "s", 2, 1, simulated=True).alias("m")).collect() == [(True,), (False,)] and df.where(runs.matured(df, "s", 0)).count() == 2
    assert runs.prepare(df, "benchmark", ["k"], "s")[1] == 0 and runs.prepare(df, "temporal", ["k"], "s")[1] == 1
    assert "More than 1 rows." in runs.report("x", {"d": df}, 1)
    split = splits.temporal_split(spark.createDataFrame([(i, i, i % 2) for i in range(40)], "s int, t int, y int"), "t")
    assert json.loads(runs.split_json(splits.summary(split, "t", "y"), ("train", "validation", "holdout"), [27, 33]))["summary"][0]["n"] == 28
    assert json.loads(runs.manifest_json(["v1", "z"], {"v": r"v\d"}))["families"] == {"v": 1, "other": 1}


def test_event_checks(spark):
    fields = [requests.Field("id", "int"), requests.Field("at", "datetime"), requests.Field("unix", "int"), requests.Field("born", "datetime", nullable=True), requests.Field("x", "float", least=-1, most=1)]
    cross = {"clock": scalars.time_of_day_differs(F.col("unix"), F.col("at")), "born": F.col("born") >= F.col("at")}
    good = {"id": 1, "at": "2020-01-02 00:00:10", "unix": 86410, "x": 0.5}
    rows = [(good, []), ({**good, "unix": 86500}, ["clock"]), ({**good, "born": "2021-01-01 00:00:00"}, ["born"]), ({**good, "born": None}, []), ({**good, "x": 2}, ["x:range"]), ({**good, "id": 1.5}, ["id:type"]), ({**good, "at": "soon"}, ["at:type"]), ({**good, "z": 0}, ["z:unknown"]), ({k: v for k, v in good.items() if k != "id"}, ["id:missing"])]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(rows)] + [(100, "{"), (101, None), (102, "[1]")], "n int, body string")
    out = requests.checked(df, "body", fields, cross)
    got = {r.n: list(r.errors) for r in out.select("n", "errors").collect()}
    assert got == {i: e for i, (_, e) in enumerate(rows)} | {100: ["json"], 101: ["json"], 102: ["json"]}
    sound, aside = requests.routed(out)
    assert sound.count() == 2 and aside.count() == 10


def test_models(spark):
    df = spark.createDataFrame([(i, float(i % 10), i % 3, int(i % 10 > 6)) for i in range(200)], "s int, x double, z int, y int")
    assert abs(models.Model("dummy").fit(df, [], "y").fitted - 0.3) < 1e-9
    m = models.Model("logistic").fit(df.where("s < 100"), ["x", "z"], "y")
    assert metrics.roc_auc(m.score(df.where("s >= 100")), "y", "p").first()[0] == 1.0 and m.importance()[0][0] == "x"
    assert [r.feature for r in models.permutation_importance(df, m.score, ["x", "z"], "y", "s").where("drop > 0.1").collect()] == ["x"]
    with pytest.raises(KeyError):
        models.Model("none").fit(df, ["x"], "y")
    with pytest.raises(RuntimeError):
        models.Model("logistic").score(df)
    assert models.search("trees", 5, 1) == models.search("trees", 5, 1) and models.search("dummy", 5) == [{}]


def test_edited_scopes(spark):
    # 0 and 1 mixed at the border: each rule and scope by hand on a line
    df = spark.createDataFrame([(i, [float(i)], y) for i, y in enumerate([0, 0, 0, 0, 1, 0, 1, 1])], "k long, v array<double>, y int")
    near = {0: (1, 2), 1: (0, 2), 2: (1, 3), 3: (2, 4), 4: (3, 5), 5: (4, 6), 6: (5, 7), 7: (6, 5)}
    y = {r.k: r.y for r in df.collect()}
    agree = {k: [y[n] == y[k] for n in v] for k, v in near.items()}
    run = lambda **o: {r.k for r in neighbours.edited(df, "k", "v", "y", k=2, **o).collect()}
    assert run() == {k for k, a in agree.items() if all(a)} and run(rule="mode") == {k for k, a in agree.items() if 2 * sum(a) > 2}
    assert run(scope="majority") == {k for k, a in agree.items() if all(a) or y[k] == 1}
    both = neighbours.with_synthetic(df, "k", "v", "y", k=2)
    assert both.where("y = 1").count() == 5 and both.where("k < 0").count() == 2 and both.select("k").distinct().count() == 10
    assert neighbours.smote_edited(df, "k", "v", "y", k=2).count() < 10


def test_large_dictionaries_are_joined(spark):
    df = spark.createDataFrame([(str(i // 2),) for i in range(60)] + [(None,)], "c string")
    new = spark.createDataFrame([("0",), ("x",), (None,)], "c string")
    for kind in ("CategoricalTyper", "CategoricalEncoder", "FrequencyEncoder"):
        small, large = (step(kind, columns=["c"], **o).fit(df) for o in ({}, {"most": 2}))
        assert "tables" in large.state and "tables" not in small.state
        for t in (df, new):
            assert sorted(map(str, large.transform(t).collect())) == sorted(map(str, small.transform(t).collect()))
            assert large.transform(t).columns == small.transform(t).columns


def test_readers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.csv", "k,v\n1,a\n2,\n")
    assert sorted((r.k, r.v) for r in readers.read_zip_member(spark, [str(tmp_path / "a.zip")], "m.csv", ["k", "v"]).collect()) == [("1", "a"), ("2", None)]
    out = readers.with_position(spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "t int"), "t").orderBy("seq").collect()
    assert [(r.seq, r.t) for r in out] == [(0, 1), (1, 3), (2, 5), (3, 9)]
    reg = readers.Registry()
    reg.register("gone", lambda s: s.read.parquet(str(tmp_path / "none")))
    assert reg.available(spark)[0][0] == "gone"
    with pytest.raises(KeyError):
        reg.open(spark, "x")
    assert readers.without_nan(spark.createDataFrame([(float("nan"),)], "x double")).first().x is None
    assert readers.canonical_names(spark.createDataFrame([(1, 2)], ["id-01", "b"])).columns == ["id_01", "b"]
    assert readers.synthetic(spark, 10, 1).count() == 10


def test_bundle(tmp_path):
    bundle.save(str(tmp_path), {"a.json": "{}"})
    assert bundle.load(str(tmp_path)) == {"a.json": "{}"}
    (tmp_path / "a.json").write_text("[]")
    with pytest.raises(ValueError):
        bundle.load(str(tmp_path))
    (tmp_path / "a.json").unlink()
    with pytest.raises(FileNotFoundError):
        bundle.load(str(tmp_path))


def test_findings(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a int, b int")
    got = audit.findings(df, ["a", "b"], {"null_b": ("warn", F.col("b").isNull()), "neg": ("error", F.col("a") < 0)}).collect()
    assert [(r.severity, r.code, r.n) for r in got] == [("warn", "null_b", 1)]
