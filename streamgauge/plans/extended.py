"""More queries of the catalogue: sources and sinks, checks, samples, models, thresholds, streaming state, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests, scalars
from ..functions.steps import MISSING, Pipeline, step
from ..functions.views import GiniSelector, ModelView
from ..operators import audit, history, metrics, models, neighbours, splits
from ..sources import contracts, readers
from ..sources.scratch import fresh, kept
from ..streaming import stateful
from . import catalogue, runs
from .catalogue import _CUM, _CURVE, EV, HOUR, ORDERS, SCORED, _cut, events, frame, order_spec, orders, query, r6, scored, spec, t

# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("select l_returnflag, count(*)::bigint as n from lineitem group by 1")
def sc02_pruned_scan(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("select r_regionkey::varchar as r_regionkey, r_name from region")
def sc04_zip_member(spark, sf_dir):
    import io
    import zipfile

    from pyarrow import fs

    rows = t(spark, sf_dir, "region").collect()  # five rows, to have an archive to read
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("region.csv", "r_regionkey,r_name\n" + "".join(f"{r.r_regionkey},{r.r_name}\n" for r in rows))
    folder = fresh(spark, "zip")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/a.zip", compression=None) as f:
        f.write(held.getvalue())
    return readers.read_zip_member(spark, [f"{folder}/a.zip"], "region.csv", ["r_regionkey", "r_name"])


@query("select * from (values (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) v(place, name)")
def sc05_header(spark, sf_dir):
    folder = fresh(spark, "csv")
    t(spark, sf_dir, "nation").write.option("header", True).csv(folder)
    return spark.createDataFrame(list(enumerate(readers.header(spark, folder))), "place int, name string")


@query("select 'absent' as name")
def sc06_missing_sources(spark, sf_dir):
    r = readers.Registry()
    r.register("region", lambda s: t(s, sf_dir, "region"))
    r.register("absent", lambda s: t(s, sf_dir, "no_such_table"))
    return spark.createDataFrame([(n,) for n, _ in r.available(spark)], "name string")


@query("select o_orderkey as id_01, o_custkey as id_02, o_orderstatus from orders")
def sc08_header_rename(spark, sf_dir):
    return readers.canonical_names(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id-01"), F.col("o_custkey").alias("id-02"), "o_orderstatus"))


@query("select event_id, user_id, event_type, value from events")
def sc11_json_event_stream(spark, sf_dir):
    folder = fresh(spark, "json-stream")
    t(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value")).write.text(f"{folder}/in")
    out = readers.event_stream(spark, f"{folder}/in", "event_id long, user_id long, event_type string, value double")
    query_ = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("not bad").drop("bad")


@query("select 1000::bigint as n, 1000::bigint as n_seq, 500::bigint as n_t")
def sc12_synthetic(spark, sf_dir):
    return readers.synthetic(spark, 1000, 7).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("n_seq"), F.count_distinct("t").alias("n_t"))


_PARTS = f"{_CUM}, p as (select *, case when t <= {_cut(0.7)} then 'train' when t <= {_cut(0.85)} then 'validation' else 'holdout' end as part from o)"


@query(f"with {_PARTS} select part, count(*)::bigint as n, round(sum(o_totalprice), 2) as amount from p group by 1")
def sk01_membership_and_context(spark, sf_dir):
    folder = fresh(spark, "membership")
    runs.write_parts(splits.temporal_split(orders(spark, sf_dir), "t"), folder, ["o_orderkey", "o_totalprice"])
    back = runs.read_parts(spark, folder, "o_orderkey long, o_totalprice double")
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query(f"with {_PARTS} select o_orderkey, o_custkey, part from p where part = 'validation'")
def j07_membership_rows(spark, sf_dir):
    folder = fresh(spark, "membership")
    runs.write_parts(splits.temporal_split(orders(spark, sf_dir), "t"), folder, ["o_orderkey"], "parquet")
    members = runs.read_parts(spark, folder, "o_orderkey long", "parquet")
    return splits.rows_of(t(spark, sf_dir, "orders"), members, "o_orderkey", "validation").select("o_orderkey", "o_custkey", "part")


@query("with r as (select p_brand as b, row_number() over (order by count(*) desc, p_brand) as code from part group by 1) select p_partkey, code::int as p_brand_code, (p_size is null)::int as odd from part join r on b = p_brand")
def sk02_json_artifacts(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    fitted = Pipeline([step("CategoricalEncoder", columns=["p_brand"])]).fit(p).to_json()
    view = ModelView("linear", 5).fit(p.select("p_size")).to_json()
    same = int(ModelView.from_json(view).state != json.loads(view)["state"])
    return Pipeline.from_json(fitted).transform(p).select("p_partkey", "p_brand_code", F.lit(same).alias("odd"))


@query("select user_id::varchar as entity, count(*)::double as n, round(sum(value), 4) as amount from events group by 1")
def sk04_state_snapshot(spark, sf_dir):
    s, folder = spec((24, 168)), fresh(spark, "states")
    stateful.save_states(stateful.bulk_state(_input(spark, sf_dir, s), s), folder)
    back = stateful.load_states(spark, folder)
    at = lambda k: F.get_json_object("state", f"$.totals.{k}").cast("double")
    return back.select("entity", at("n").alias("n"), F.round(at("amount"), 4).alias("amount"))


@query("select unnest(['# Tables', '', '## regions', '', '| r_regionkey | n |', '|---|---|'] || (select list('| ' || n_regionkey || ' | ' || k || ' |' order by n_regionkey) from (select n_regionkey, count(*) as k from nation group by 1))) as line")
def sk05_report(spark, sf_dir):
    n = t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count(F.lit(1)).alias("n")).orderBy("r_regionkey")
    return spark.createDataFrame([(x,) for x in runs.report("Tables", {"regions": n}).splitlines()], "line string")


@query("select count(*)::bigint as n, false as first, true as second from orders")
def sk07_resume(spark, sf_dir):
    folder = fresh(spark, "resume")
    _, first = runs.resumed(spark, folder, "orders", lambda: t(spark, sf_dir, "orders").select("o_orderkey"))
    again, second = runs.resumed(spark, folder, "orders", lambda: t(spark, sf_dir, "orders").limit(0))
    return again.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(first).alias("first"), F.lit(second).alias("second"))


@query("select 'dedup' as part union all select 'fields'")
def sk08_contract_snapshot(spark, sf_dir):
    frozen = contracts.EVENTS.to_json()
    now = contracts.Declared("events", [*contracts.EVENTS.fields.fields[:-1]], keys=contracts.EVENTS.keys, dedup=("event_id",))
    return spark.createDataFrame([(x,) for x in [*contracts.Declared.from_json(frozen).differs(frozen), *now.differs(frozen)]], "part string")


@query(f"with {SCORED}, f as (select doc_id, y, (doc_id % 5 + 1)::int as fold from s) select doc_id, y, fold, round((select avg(y) from f g where g.fold <> f.fold), 6) as p from f")
def sk09_out_of_fold(spark, sf_dir):
    df = scored(spark, sf_dir).select("doc_id", "y", "n_chars", (F.pmod("doc_id", F.lit(5)) + 1).cast("int").alias("fold"))
    out = models.out_of_fold(df, lambda: models.Model("dummy"), ["n_chars"], "y", False, ("doc_id",))
    return kept(out, "oof").withColumn("p", F.round("p", 6))


@query("""select '{"event":"scored","o_custkey":"' || substr(sha256(o_custkey::varchar), 1, 12) || '","o_orderstatus":"' || o_orderstatus || '"}' as line from orders""")
def sk06_log_lines(spark, sf_dir):
    return runs.log_lines(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus"], "scored")


# --- filters, checks, lookups ----------------------------------------------------------------------------------------


@query("select * from (values ('event_type'), ('value'), ('props')) v(name)")
def pf03_columns_by_role(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in contracts.EVENTS.names(t(spark, sf_dir, "events").columns, *contracts.FEATURES)], "name string")


@query("select toxic, toxic::tinyint as y, count(*)::bigint as n from labels group by 1, 2")
def pf10_binary_target(spark, sf_dir):
    return runs.binary_target(t(spark, sf_dir, "labels"), "toxic").groupBy("toxic", "y").agg(F.count(F.lit(1)).alias("n"))


@query("select * from (values ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value')) v(field)")
def pf14_consumed_fields(spark, sf_dir):
    p = [step("CalendarFeatures", column="ts", prefix="c"), step("LogAmount", column="value", output="l")]
    required = contracts.EVENTS.required(t(spark, sf_dir, "events").columns)
    return spark.createDataFrame([(n,) for n in requests.consumed(required, p, ["l"], spec((1,)), "event_id")], "field string")


@query("""select event_id, case event_id % 8 when 0 then '' when 1 then 'value:range' when 2 then 'event_type:missing' when 3 then 'value:type' when 4 then 'extra:unknown' when 5 then 'user_id:null'
    when 6 then 'event_type:length' else 'json' end as errors from events""")
def pf15_json_checks(spark, sf_dir):
    e, k = t(spark, sf_dir, "events"), F.pmod("event_id", F.lit(8))
    say = lambda u, kind, v, more="": F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"user_id":'), u, kind, F.lit(',"value":'), v, F.lit(more + "}"))
    u, kind, v = F.col("user_id").cast("string"), F.concat(F.lit(',"event_type":"'), F.col("event_type"), F.lit('"')), F.abs("value").cast("string")
    text = F.when(k == 1, say(u, kind, F.lit("-1.5"))).when(k == 2, say(u, F.lit(""), v)).when(k == 3, say(u, kind, F.lit('"7"'))).when(k == 4, say(u, kind, v, ',"extra":1')).when(k == 5, say(F.lit("null"), kind, v))
    text = text.when(k == 6, say(u, F.lit(',"event_type":" "'), v)).when(k == 7, F.lit('{"event_id":')).otherwise(say(u, kind, v))
    fields = [requests.Field("event_id", "int"), requests.Field("user_id", "int"), requests.Field("event_type", "string"), requests.Field("value", "float", least=0.0)]
    out = requests.checked(e.select(F.col("event_id").alias("id"), text.alias("body")), "body", fields)
    return out.select(F.col("id").alias("event_id"), F.array_join("errors", ",").alias("errors"))


@query("select o_orderkey, (o_custkey % 3 = 0 or o_orderkey % 5 = 0)::int::tinyint as has_any from orders")
def pf16_presence(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, 1).alias("id_1"), F.when(F.col("o_orderkey") % 5 == 0, "x").alias("id_2"))
    return o.select("o_orderkey", scalars.any_present(["id_1", "id_2"]).alias("has_any"))


@query("with f as (select o_custkey as k, count(*) / sum(count(*)) over ()::double as q from orders group by 1) select o_orderkey, round(q::float::double, 6) as o_custkey_freq from orders join f on k = o_custkey")
def j06_joined_lookup(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = step("FrequencyEncoder", columns=["o_custkey"], most=100).fit(o).transform(o)
    return out.select("o_orderkey", F.round(F.col("o_custkey_freq").cast("double"), 6).alias("o_custkey_freq"))


@query("with r as (select o_custkey as k, row_number() over (order by count(*) desc, o_custkey::varchar) as code from orders group by 1) select o_orderkey, code::int as o_custkey_code from orders join r on k = o_custkey")
def f27_joined_code(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return step("CategoricalEncoder", columns=["o_custkey"], most=100).fit(o).transform(o).select("o_orderkey", "o_custkey_code")


# --- audit -----------------------------------------------------------------------------------------------------------


@query("with g as (select user_id, count(distinct event_type) as a, count(distinct user_id % 7) as b from events group by 1) select 'event_type' as \"column\", max(a)::bigint as most from g union all select 'seven', max(b)::bigint from g")
def a05_most_distinct(spark, sf_dir):
    return audit.most_distinct(t(spark, sf_dir, "events").withColumn("seven", F.col("user_id") % 7), "user_id", ["event_type", "seven"])


_LINE = "l as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_shipdate from lineitem)"


@query(f"""with {_LINE}, a as (select count(*) as c from l group by all), b as (select l_returnflag, l_linestatus, l_quantity, l_shipdate, count(*) as c from l group by 1, 2, 3, 4), d as (select l_orderkey, count(*) as c from l group by 1),
    m as (select l_returnflag, l_linestatus, l_quantity, count(distinct l_shipdate) as k from l group by 1, 2, 3)
    select (select count(*) from l)::bigint as n_rows, (select sum(c - 1) from (select count(*) as c from l group by l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_shipdate))::bigint as n_exact,
    (select sum(c - 1) from b)::bigint as n_but_ids, (select sum(c - 1) from d)::bigint as n_row_ids, (select count(*) from m where k > 1)::bigint as n_moved_groups""")
def a11_duplicate_report(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
    return audit.duplicate_report(l, ["l_orderkey", "l_linenumber"], "l_orderkey", "l_shipdate")


@query("select lang, count(*)::bigint as n, count(quality)::bigint as covered, round(count(quality) / count(*), 6) as share from documents left join labels using (doc_id) group by 1")
def a22_coverage(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return audit.coverage(d, "lang", F.col("quality").isNotNull()).withColumn("share", F.round("share", 6))


@query(f"with {SCORED} select round(sum(n_chars * y) / sum(n_chars), 6) as prior from s")
def a25_weighted_prior(spark, sf_dir):
    m = models.Model("dummy").fit(scored(spark, sf_dir), [], "y", "n_chars")
    return spark.createDataFrame([(round(m.fitted, 6),)], "prior double")


@query("select * from (values ('history', 3), ('raw', 2), ('other', 1)) v(family, n)")
def a32_family_counts(spark, sf_dir):
    found = audit.family_counts(["h_n_prior", "h_cnt_1h", "h_amt_1h", "value", "event_type", "odd"], {"history": "h_.*", "raw": "value|event_type"})
    return spark.createDataFrame(list(found.items()), "family string, n int")


@query("select * from (values (1, 'signal')) v(rank, feature)")
def p08_gini_selector(spark, sf_dir):
    df = scored(spark, sf_dir).select("y", (F.col("y") * 10 + F.pmod("doc_id", F.lit(3))).alias("signal"), F.pmod("doc_id", F.lit(7)).alias("noise"))
    s = GiniSelector.from_json(GiniSelector(1, trees=10).fit(df, ["noise", "signal"], "y").to_json())
    return spark.createDataFrame(list(enumerate(s.transform(df).columns, 1)), "rank int, feature string")


@query("select event_type, n from (select event_type, count(*)::bigint as n from events group by 1 order by n desc, event_type limit 3)")
def t06_top_findings(spark, sf_dir):
    return audit.top_findings(t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "n", 3, "event_type")


# --- windows ---------------------------------------------------------------------------------------------------------


@query(catalogue._hist_sql(ORDERS, "o", "o_orderkey", "o_custkey", "o_totalprice", (24, 720, 4320)))
def win_hist_split_by_time(spark, sf_dir):
    widths = {str(w): w * HOUR for w in (24, 720, 4320)}
    out = history.split_windows(history.entity_history(orders(spark, sf_dir), order_spec(())), ["o_custkey"], "t", "o_orderkey", widths, {"amt": F.col("o_totalprice")}, 1440 * HOUR)
    return out.select("o_orderkey", "h_n_prior", *[c for w in widths for c in (F.col(f"{w}_n").alias(f"h_cnt_{w}h"), F.round(f"{w}_amt", 2).alias(f"h_amt_{w}h"))])


def _two_contexts() -> str:
    cols = [f"{frame('count', '*', f'o_custkey, {c}', 't', 'o_orderkey', w * HOUR)} as h_{c}_cnt_{w}h, round({frame('sum', 'o_totalprice', f'o_custkey, {c}', 't', 'o_orderkey', w * HOUR)}, 2) as h_{c}_amt_{w}h" for c in ("o_orderpriority", "o_orderstatus") for w in (720, 4320)]
    ratio = [f"round(case when h_{c}_cnt_4320h > 0 and h_{c}_amt_4320h > 0 then o_totalprice / (h_{c}_amt_4320h / h_{c}_cnt_4320h) end, 5) as h_amt_to_{c}_mean" for c in ("o_orderpriority", "o_orderstatus")]
    return f"with {ORDERS}, f as (select o_orderkey, o_totalprice, {', '.join(cols)} from o) select * exclude (o_totalprice), {', '.join(ratio)} from f"


@query(_two_contexts())
def win_hist_two_contexts(spark, sf_dir):
    s = order_spec((720, 4320), ("o_orderpriority", "o_orderstatus"))
    out = history.context_history(orders(spark, sf_dir), s)
    own = [c for k in s.contexts for w in (720, 4320) for c in (F.col(f"h_{k}_cnt_{w}h"), F.round(f"h_{k}_amt_{w}h", 2).alias(f"h_{k}_amt_{w}h"))]
    return out.select("o_orderkey", *own, *[F.round(f"h_amt_to_{c}_mean", 5).alias(f"h_amt_to_{c}_mean") for c in s.contexts])


def _interval_sql() -> str:
    grid, width = history.half_width_table()
    cols = ", ".join(f"{frame('count', '*', 'user_id', 't', 'event_id', d * 24 * HOUR)} as n{d}, {frame('sum', 'cos(a)', 'user_id', 't', 'event_id', d * 24 * HOUR)} as c{d}, {frame('sum', 'sin(a)', 'user_id', 't', 'event_id', d * 24 * HOUR)} as s{d}" for d in (7, 30))
    long = " union all ".join(f"select event_id, a, {d} as d, n{d} as n, c{d} as c, s{d} as s from f" for d in (7, 30))
    return f"""with {EV}, a as (select event_id, user_id, t, 2 * pi() * (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))) / 86400 as a from e),
        f as (select event_id, a, {cols} from a), l as ({long}),
        r as (select event_id, d, least(sqrt(c * c + s * s) / n, 0.9999) as r, atan2(s, c) as m, a from l where n >= 3),
        k as (select *, greatest(least(case when r < 0.53 then 2 * r + r ** 3 + 5 * r ** 5 / 6 when r < 0.85 then -0.4 + 1.39 * r + 0.43 / (1 - r) else 1 / (r ** 3 - 4 * r * r + 3 * r) end, 1000.0), 0.0) as k, abs(((a - m + pi()) - 2 * pi() * floor((a - m + pi()) / (2 * pi()))) - pi()) as z from r),
        g as (select unnest({grid}::double[]) as x, unnest({width}::double[]) as y), h as (select x, y, lead(x) over (order by x) as x1, lead(y) over (order by x) as y1 from g),
        q as (select event_id, d, z, case when k <= 1e-6 then pi() when x1 is null then y else y + (y1 - y) * (k - x) / (x1 - x) end as q from k asof left join h on k.k >= h.x)
        select event_id, round(max(z * 12 / pi()) filter (where d = 7), 6) as h_vm7_hours, max((z <= q)::int::tinyint) filter (where d = 7) as h_vm7_inside,
            round(max(z * 12 / pi()) filter (where d = 30), 6) as h_vm30_hours, max((z <= q)::int::tinyint) filter (where d = 30) as h_vm30_inside
        from (select event_id from e) left join q using (event_id) group by 1"""


@query(_interval_sql)
def win_hist_circular_interval(spark, sf_dir):
    out = history.circular(events(spark, sf_dir), spec(), "ts")
    return out.select("event_id", *r6("h_vm7_hours"), "h_vm7_inside", *r6("h_vm30_hours"), "h_vm30_inside")


@query(f"""with {EV}, a as (select event_id, user_id, t, 2 * pi() * (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))) / 86400 as a from e),
    f as (select event_id, {frame('count', '*', 'user_id', 't', 'event_id', 720 * HOUR)} as n, {frame('sum', 'cos(a)', 'user_id', 't', 'event_id', 720 * HOUR)} as c, {frame('sum', 'sin(a)', 'user_id', 't', 'event_id', 720 * HOUR)} as s from a)
    select event_id, n as h_vm30_n, round(case when n >= 3 then sqrt(c * c + s * s) / n end, 6) as h_vm30_r from f""")
def win_hist_circular_30(spark, sf_dir):
    return history.circular(events(spark, sf_dir), spec(), "ts", (30,)).select("event_id", "h_vm30_n", *r6("h_vm30_r"))


# --- order, samples, splits ------------------------------------------------------------------------------------------


@query(f"with {ORDERS} select o_orderkey, row_number() over (order by t, o_orderkey) - 1 as seq from o")
def t01_position(spark, sf_dir):
    return readers.with_position(orders(spark, sf_dir).select("o_orderkey", "t"), "t", "o_orderkey").select("o_orderkey", "seq")


@query("with c as (select count(*) as k from lineitem group by l_orderkey, l_linenumber) select 'benchmark' as protocol, sum(k)::bigint as n, 0::bigint as removed from c union all select 'temporal', count(*)::bigint, (sum(k) - count(*))::bigint from c")
def t04_protocol_dedup(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    out = []
    for protocol in ("benchmark", "temporal"):
        df, removed = runs.prepare(l, protocol, ["l_orderkey", "l_linenumber"], "seq")
        out.append((protocol, df.count(), removed))
    return spark.createDataFrame(out, "protocol string, n long, removed long")


@query(f"with {SCORED}, n as (select sum(toxic) as p from s) select 0 as y, p::bigint as n, p::bigint as n_rows, 0::bigint as n_unknown from n union all select 1, p::bigint, p::bigint, 0 from n")
def t07_under_sample_rows(spark, sf_dir):
    s = kept(scored(spark, sf_dir), "scored")
    out = splits.under_sample(s, "y", "doc_id")
    known = s.select(F.col("doc_id").alias("k"), F.col("y").alias("own"))
    return out.join(known, F.col("doc_id") == F.col("k"), "left").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_rows"), F.count_if(~F.col("own").eqNullSafe(F.col("y"))).alias("n_unknown"))


@query(f"with {SCORED}, n as (select count(*) - sum(toxic) as q, sum(toxic) as p from s) select 0 as y, q::bigint as n, 1::bigint as least, 1::bigint as most from n union all select 1, q::bigint, (q // p)::bigint, ceil(q / p)::bigint from n")
def t08_over_sample_rows(spark, sf_dir):
    by = splits.over_sample(scored(spark, sf_dir), "y", "doc_id").groupBy("y", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return by.groupBy("y").agg(F.sum("c").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))


@query(f"with {SCORED}, c as (select quality, count(*) as n from s group by 1), f as (select unnest(range(1, 6)) as fold) select quality, fold::int as fold, (n // 5 + (fold <= n % 5)::int)::bigint as n from c, f")
def x05_stratified_folds(spark, sf_dir):
    return splits.stratified_folds(scored(spark, sf_dir), "quality", "doc_id").groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SCORED}, c as (select quality, count(*) as n from s group by 1) select quality, part, case part when 'test' then round_even(n * 0.3, 0) else n - round_even(n * 0.3, 0) end::bigint as n_rows from c, (select unnest(['test', 'train']) as part)")
def x02_stratified_rows(spark, sf_dir):
    return splits.stratified(scored(spark, sf_dir), "quality", "doc_id").groupBy("quality", "part").agg(F.count_distinct("doc_id").alias("n_rows"))


@query("select * from (values ('whole', ''), ('holes', 'part train is not its whole slice'), ('twice', 'parts overlap;part train is not its whole slice')) v(kind, said)")
def x03_split_violations(spark, sf_dir):
    names = ("train", "validation", "holdout")
    s = kept(splits.temporal_split(orders(spark, sf_dir), "t").select("o_orderkey", "t", "part"), "split")
    lost = s.withColumn("part", F.when((F.col("part") != "train") | (F.col("o_orderkey") % 10 != 0) | F.col("t").isin(*s.where("part = 'train'").agg(F.min("t"), F.max("t")).first()), F.col("part")))
    twice = s.unionByName(s.where("part = 'train'"))
    first = s.select("o_orderkey", "t").withColumn("part", F.lit(None).cast("string"))
    said = [("whole", splits.violations(s, "o_orderkey", "t", names)), ("holes", splits.violations(lost, "o_orderkey", "t", names)), ("twice", splits.violations(twice.unionByName(first.where("o_orderkey < 0")), "o_orderkey", "t", names))]
    said[2] = ("twice", [*said[2][1], *(["part train is not its whole slice"] if "part train is not its whole slice" not in said[2][1] else [])])
    return spark.createDataFrame([(k, ";".join(v)) for k, v in said], "kind string, said string")


@query(f"with {SCORED}, w as (select doc_id, greatest(n_chars, 500) / 1000.0 as w from s) select doc_id, round(w / (select avg(w) from w), 6) as weight from w")
def x06_sample_weights(spark, sf_dir):
    s = scored(spark, sf_dir)
    return splits.sample_weights(s, splits.example_weights(F.col("n_chars").cast("double"), 1000.0, 500.0)).select("doc_id", *r6("weight"))


@query(f"with {_PARTS} select part, count(*)::bigint as n, sum((o_orderstatus = 'F')::int)::bigint as positives, round(avg((o_orderstatus = 'F')::int), 6) as prevalence from p where part = 'holdout' group by 1")
def x10_natural_slice(spark, sf_dir):
    o = splits.temporal_split(orders(spark, sf_dir), "t").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    part = kept(o.where("part = 'holdout'"), "holdout")
    least = part.agg(F.min("t")).first()[0]
    return splits.check_natural(part, o.where(F.col("t") >= least), "holdout", "y")


@query("select 0::bigint as n_wrong")
def o06_folds_disjoint(spark, sf_dir):
    return spark.createDataFrame([(splits.fold_violations(splits.forward_folds(orders(spark, sf_dir), "t"), "o_orderkey"),)], "n_wrong long")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings").where("label in (1, 2, 3)")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), (F.col("label") == 1).cast("int").alias("y"))


def _knn(k: int) -> str:
    return f"""e as (select vec_id, embedding, (label = 1)::int as y from embeddings where label in (1, 2, 3)),
        d as (select a.vec_id as q, a.y as y, b.y as z, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::double - x[2]::double) ** 2)), b.vec_id) as rn from e a join e b on a.vec_id <> b.vec_id),
        v as (select q, any_value(y) as y, sum((y = z)::int) as agree, count(*) as c from d where rn <= {k} group by 1)"""


@query(f"with {_knn(3)} select q as vec_id, y from v where agree = c")
def x09_edited(spark, sf_dir):
    return neighbours.edited(_labelled(spark, sf_dir), "vec_id", "embedding", "y").select("vec_id", "y")


@query(f"with {_knn(3)}, m as (select case when 2 * sum(y) <= count(*) then 0 else 1 end as major from e) select q as vec_id, y from v, m where 2 * agree > c or y <> major")
def x09_edited_majority(spark, sf_dir):
    return neighbours.edited(_labelled(spark, sf_dir), "vec_id", "embedding", "y", rule="mode", scope="majority").select("vec_id", "y")


@query("select count(*)::bigint * 2 as n, count(*)::bigint * 2 as n_between, count(*)::bigint * 2 as n_near from embeddings where label = 1")
def x08_smote_on_segments(spark, sf_dir):
    e = kept(_labelled(spark, sf_dir).where("y = 1"), "minority")
    made = kept(neighbours.smote(e, "vec_id", "embedding", "y", 2 * e.count()), "smote")
    a, b = e.select(F.col("vec_id").alias("of"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("to"), F.col("embedding").alias("vb"))
    both = made.join(a, "of").join(b, "to")
    far = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z))
    both = both.withColumn("bent", far("va", "embedding") + far("embedding", "vb") - far("va", "vb"))
    near = neighbours.nearest(e, e, "vec_id", "embedding", 5).select(F.col("q").alias("of"), F.col("n").alias("to"), F.lit(1).alias("is_near"))
    return both.join(near, ["of", "to"], "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("bent") < 1e-9).alias("n_between"), F.count("is_near").alias("n_near"))


@query("with n as (select count(*) filter (where label = 1) as p, count(*) filter (where label in (2, 3)) as q from embeddings) select 0 as y, q::bigint as n, 0::bigint as n_made from n union all select 1, greatest(p, q)::bigint, greatest(q - p, 0)::bigint from n")
def o02_synthetic_appended(spark, sf_dir):
    out = neighbours.with_synthetic(_labelled(spark, sf_dir), "vec_id", "embedding", "y")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") < 0).alias("n_made"))


# --- scalars, steps, views -------------------------------------------------------------------------------------------


@query("select round(avg((p_type like 'PROMO%')::int), 6) as rate from part")
def f03_prefix_rate(spark, sf_dir):
    return t(spark, sf_dir, "part").agg(F.round(scalars.prefix_rate(F.col("p_type"), "PROMO"), 6).alias("rate"))


@query("select o_orderkey, length(regexp_replace(split_part(printf('%.9f', o_totalprice), '.', 2), '0+$', ''))::int as places from orders")
def f05_places_as_text(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", scalars.places_as_text(F.col("o_totalprice")).alias("places"))


@query("""with p as (select event_id, 2 * pi() * (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))) / 86400 as d, 2 * pi() * (isodow(ts) - 1) / 7 as w from events)
    select event_id, round(sin(d)::float::double, 5) + 0.0 as c_day_sin, round(cos(d)::float::double, 5) + 0.0 as c_day_cos, round(sin(w)::float::double, 5) + 0.0 as c_dow_sin, round(cos(w)::float::double, 5) + 0.0 as c_dow_cos from p""")
def f10_cyclic_day_and_week(spark, sf_dir):
    c = scalars.calendar(F.col("ts"), "c")
    return t(spark, sf_dir, "events").select("event_id", *[(F.round(c[k].cast("double"), 5) + 0.0).alias(k) for k in ("c_day_sin", "c_day_cos", "c_dow_sin", "c_dow_cos")])


@query("select date_trunc('day', ts)::timestamp as day, count(*)::bigint as n from events group by 1")
def f13_date_truncation(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, event_id % 3 = 0 as differs from events")
def f15_clock_consistency(spark, sf_dir):
    e = events(spark, sf_dir)
    unix = F.floor(F.col("t") / 1e6) + F.when(F.col("event_id") % 3 == 0, 90).otherwise(86400 * 3)
    return e.select("event_id", scalars.time_of_day_differs(unix, F.col("ts")).alias("differs"))


@query(f"with {SCORED} select doc_id, round(case when p <= 0.1 then 0.05 when p >= 0.9 then 0.7 when p <= 0.4 then 0.05 + (p - 0.1) / 0.3 * 0.15 else 0.2 + (p - 0.4) / 0.5 * 0.5 end, 6) as q from s")
def f22_isotonic_apply(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.round(metrics.apply_isotonic(F.col("p"), [0.1, 0.4, 0.9], [0.05, 0.2, 0.7]), 6).alias("q"))


@query(f"with {SCORED}, c as (select doc_id, greatest(least(p, 1 - 1e-7), 1e-7) as c from s) select doc_id, round(1 / (1 + exp(-(0.8 * ln(c / (1 - c)) - 1.5))), 6) as q from c")
def m09_platt_apply(spark, sf_dir):
    c = metrics.Calibrator.from_json(json.dumps({"method": "platt", "state": {"slope": 0.8, "intercept": -1.5}}))
    return scored(spark, sf_dir).select("doc_id", F.round(c.column(F.col("p")), 6).alias("q"))


@query(f"with {SCORED} select round(avg(y), 4) as platt, round(avg(y), 4) as isotonic, round(avg(p), 4) as none from s")
def m09_calibrators_keep_the_rate(spark, sf_dir):
    s = kept(scored(spark, sf_dir), "scored")
    q = {m: metrics.Calibrator(m).fit(s, "y", "p").column(F.col("p")) for m in ("platt", "isotonic", "none")}
    return s.agg(*[F.round(F.avg(c), 4).alias(m) for m, c in q.items()])


@query(f"""with {ORDERS}, m as (select o_orderkey, 2 * 6371.0088 * asin(sqrt(pow(sin((radians(b) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(20.0) / 2), 2))) as km, o_orderdate, t, o_orderpriority
    from (select *, (o_orderkey % 90)::double as a, (o_custkey % 80)::double as b from o))
    select o_orderkey, extract(month from o_orderdate)::tinyint as c_month, round((floor((t - epoch_us(timestamp '1990-05-17 00:00:00')) / 86400000000.0) / 365.25)::float::double, 4) as age, round(km::float::double, 2) as km,
        floor(((t / 1e6) % 604800.0) / 604800.0 * 24)::smallint as k_bin, split_part(o_orderpriority, '-', 1) as token from m""")
def p02_feature_steps(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_orderdate", (F.col("t") / 1e6).alias("s"), "o_orderpriority", F.expr("TIMESTAMP_NTZ'1990-05-17 00:00:00'").alias("born"), (F.col("o_orderkey") % 90).cast("double").alias("a"), (F.col("o_custkey") % 80).cast("double").alias("b"), F.lit(0.0).alias("x"), F.lit(20.0).alias("z"))
    p = Pipeline([
        step("CalendarFeatures", column="o_orderdate", prefix="c"), step("AgeAtEvent", birth="born", at="o_orderdate", output="age"), step("HaversineDistance", lat1="a", lon1="x", lat2="b", lon2="z", output="km"),
        step("CyclicClock", column="s", period=604800.0, prefix="k"), step("TokenSplit", column="o_orderpriority", output="token", pattern="-", index=0),
    ])
    out = Pipeline.from_json(p.fit(o).to_json()).transform(o)
    return out.select("o_orderkey", "c_month", F.round(F.col("age").cast("double"), 4).alias("age"), F.round(F.col("km").cast("double"), 2).alias("km"), "k_bin", "token")


@query(f"""with s as (select c_custkey, case when c_custkey % 7 > 0 then c_mktsegment end as v from customer), k as (select v, row_number() over (order by count(*) desc, v) as code from s where v is not null and c_custkey % 2 = 0 group by 1)
    select c_custkey, case when s.v is null then 0 else coalesce(code + 1, 1) end::int as seg from s left join k on s.v = k.v""")
def p07_tree_view(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("seg"))
    view = ModelView("tree").fit(c.where("c_custkey % 2 = 0").select("seg"))
    view.state["keep"] = ["c_custkey"]
    assert view.state["categorical"]["seg"][0] == MISSING
    return view.transform(c)


# --- models and thresholds -------------------------------------------------------------------------------------------


@query(f"with {SCORED}, zr as (select p, row_number() over (order by p) - 1 as at_ from s), zn as (select count(*) as n from s), zg as (select i * (n - 1) / 1999.0::double as place from range(2000) r(i), zn), u as (select distinct x.p + (z.p - x.p) * (place - floor(place)) as t from zg join zr x on x.at_ = floor(place) join zr z on z.at_ = ceil(place)), v as (select distinct round(t, 9) as threshold from u) select count(*)::bigint as n, round(sum(threshold), 4) as total from v")
def t11_candidates(spark, sf_dir):
    c = metrics.candidates(scored(spark, sf_dir), "p").where(F.col("threshold") < float("inf")).select(F.round("threshold", 9).alias("threshold")).distinct()
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("threshold"), 4).alias("total"))


@query(f"""with {_CURVE}, n as (select sum(pos) as a, sum(n - pos) as b, sum(n) as n from g), v as (select p, sum(case when y = 1 then n_chars else 0 end)::double as amt from s group by 1),
    zr as (select p, row_number() over (order by p) - 1 as at_ from s), zn as (select count(*) as n from s), zg as (select i * (n - 1) / 1999.0::double as place from range(2000) r(i), zn), u as (select distinct x.p + (z.p - x.p) * (place - floor(place)) as t from zg join zr x on x.at_ = floor(place) join zr z on z.at_ = ceil(place)),
    z as (select t, (select coalesce(sum(pos), 0) from g where p >= t) as tp, (select coalesce(sum(n - pos), 0) from g where p >= t) as fp, (select coalesce(sum(amt), 0) from v where p >= t) as caught from (select t from u union all select 'infinity'::double)),
    r as (select row_number() over (order by p desc, doc_id) as rn, p from s)
    select 'f1_max' as name, round((select t from z order by round(2.0 * tp / (tp + fp + (select a from n)), 12) desc, t limit 1), 6) as threshold
    union all select 'fpr_0.05', round((select max(p) from c, n where fp / b <= 0.05 and tp = (select max(tp) from c, n where fp / b <= 0.05)), 6)
    union all select 'alert_0.1', round((select p from r where rn = (select greatest(1, round_even(0.1 * n, 0)) from n)), 6)
    union all select 'cost_ca1000', round((select t from z order by round((tp + fp) * 1000.0 + (select sum(amt) from v) - caught, 6), t limit 1), 6)""")
def m08_policy_thresholds(spark, sf_dir):
    out = metrics.policy_thresholds(kept(scored(spark, sf_dir), "scored"), "y", "p", "doc_id", "n_chars", 1000.0, (0.05,), (0.1,))
    return out.select("name", *r6("threshold"))


@query(f"with {SCORED} select count(*)::bigint as n, sum(n_chars)::bigint as total, true as moved from s")
def t09_permutation(spark, sf_dir):
    s = kept(scored(spark, sf_dir).select("doc_id", "n_chars"), "scored")
    out = models.permuted(s, "n_chars", "doc_id").join(s.select("doc_id", F.col("n_chars").alias("was")), "doc_id")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"), (F.count_if(F.col("n_chars") != F.col("was")) * 2 > F.count(F.lit(1))).alias("moved"))


@query("select * from (values ('dummy', 1, 1), ('logistic', 10, 10), ('trees', 10, 10)) v(model, n, n_different)")
def t10_search_space(spark, sf_dir):
    found = {m: models.search(m, 10, 1) for m in models.SPACES}
    return spark.createDataFrame([(m, len(x), len({json.dumps(s, sort_keys=True) for s in x})) for m, x in found.items()], "model string, n int, n_different int")


@query("select * from (values ('n_chars', false), ('p', true)) v(feature, matters)")
def m12_permutation_importance(spark, sf_dir):
    df = scored(spark, sf_dir).select("doc_id", "n_chars", (F.col("y") + F.col("p") / 2).alias("p"), "y")
    out = models.permutation_importance(df, lambda d: d, ["n_chars", "p"], "y", "doc_id")
    return out.select("feature", (F.abs("drop") > 1e-9).alias("matters"))


@query(f"with {_CURVE}, a as (select round(sum(pos * tp * 1.0 / (tp + fp)) / sum(pos), 6) as x from c), b as (select round(avg(y), 6) as x from s) select case when a.x >= b.x then 'score' else 'rate' end as name, 'platt' as calibrator from a, b")
def m10_champion(spark, sf_dir):
    s = kept(scored(spark, sf_dir).select("doc_id", "y", "p"), "scored")
    found = []
    for name, df in (("dummy", s), ("score", s), ("rate", s.withColumn("p", F.lit(0.5)))):
        found.append({"name": name, "pr_auc": metrics.average_precision(df, "y", "p").first()[0], "brier": metrics.calibration(df, "y", "p", "doc_id").first().brier, "log_loss": {"none": 0.7, "platt": 0.4, "isotonic": 0.4}})
    best = json.loads(runs.locked_json(found, metrics.policy_thresholds(s, "y", "p", "doc_id", fprs=(), alerts=(0.1,))))["champion"]
    return spark.createDataFrame([(best["name"], best["calibrator"])], "name string, calibrator string")


def _separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), F.pmod("c_custkey", F.lit(5)).alias("noise"), (F.col("c_acctbal") > 4000).cast("int").alias("y"))


@query("select 1.0::double as roc_auc, 'x' as top")
def m13_logistic(spark, sf_dir):
    df = kept(_separable(spark, sf_dir), "separable")
    m = models.Model("logistic").fit(df, ["x", "noise"], "y")
    return metrics.roc_auc(m.score(df), "y", "p").select(F.round("roc_auc", 4).alias("roc_auc"), F.lit(m.importance()[0][0]).alias("top"))


@query("select 1.0::double as roc_auc, 'x' as top")
def m13_boosted_trees(spark, sf_dir):
    df = kept(_separable(spark, sf_dir), "separable")
    m = models.Model("trees", rounds=3).fit(df.withColumn("late", F.pmod("c_custkey", F.lit(4)) == 0), ["x", "noise"], "y", validation="late")
    return metrics.roc_auc(m.score(df), "y", "p").select(F.round("roc_auc", 2).alias("roc_auc"), F.lit(m.importance()[0][0]).alias("top"))


# --- state -----------------------------------------------------------------------------------------------------------


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, m, n, h: (F.pmod(F.col(k) * m, F.lit(n)) - h).cast("double")
    return events(spark, sf_dir).withColumns({"hlat": at("user_id", 7, 180, 90), "hlon": at("user_id", 13, 360, 180), "mlat": at("event_id", 11, 180, 90), "mlon": at("event_id", 17, 360, 180)})


def _input(spark: SparkSession, sf_dir: str, s: history.HistorySpec, condition: str = "true") -> DataFrame:
    return stateful.prepared(_placed(spark, sf_dir).where(condition), s, ("hlat", "hlon"), ("mlat", "mlon"), "ts")


_STATE_SPEC = spec((1, 24, 168), ("event_type",))
_FEATURES = history.feature_names(_STATE_SPEC)


@query(catalogue._hist_sql(EV, "e", "event_id", "user_id", "value", (24, 168)))
def st01_stream_parity(spark, sf_dir):
    s = spec((24, 168))
    out = stateful.replay(_input(spark, sf_dir, s), s, fresh(spark, "stream"), "events")
    return out.where("status = 'ok'").select("event_id", F.col("h_n_prior").cast("long").alias("h_n_prior"), *[c for w in (24, 168) for c in (F.col(f"h_cnt_{w}h").cast("long").alias(f"h_cnt_{w}h"), F.round(f"h_amt_{w}h", 2).alias(f"h_amt_{w}h"))])


@query(f"select unnest({_FEATURES}) as feature, (select count(*) from events)::bigint as n, 0::bigint as n_differ")
def st10_parity_of_all_features(spark, sf_dir):
    s = _STATE_SPEC
    online = stateful.replay(_input(spark, sf_dir, s), s, fresh(spark, "stream"), "events")
    batch = history.all_history(_placed(spark, sf_dir), s, ("hlat", "hlon"), ("mlat", "mlon"), "ts")
    return stateful.parity(online, kept(batch, "batch"), "event_id", _FEATURES)


@query(f"select unnest({_FEATURES}) as feature, (select count(*) from events where ts > (select min(ts) + interval 20 days from events))::bigint as n, 0::bigint as n_differ")
def st07_bulk_state_continues(spark, sf_dir):
    s = _STATE_SPEC
    cut = events(spark, sf_dir).agg(F.min("t") + 20 * 24 * HOUR).first()[0]
    states = stateful.bulk_state(_input(spark, sf_dir, s, f"t <= {cut}"), s)
    rest = stateful.as_input(states).unionByName(_input(spark, sf_dir, s, f"t > {cut}"))
    online = stateful.replay(rest, s, fresh(spark, "stream"), "events")
    batch = history.all_history(_placed(spark, sf_dir), s, ("hlat", "hlon"), ("mlat", "mlon"), "ts").where(F.col("t") > cut)
    return stateful.parity(online, kept(batch, "batch"), "event_id", _FEATURES)


@query("select 'duplicate' as status, count(distinct user_id)::bigint as n from events union all select 'out_of_order', (count(*) - count(distinct user_id))::bigint from events")
def st04_rejections(spark, sf_dir):
    s = spec((24,))
    own = _input(spark, sf_dir, s)
    out = stateful.replay(stateful.as_input(stateful.bulk_state(own, s)).unionByName(own), s, fresh(spark, "stream"), "events")
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select true as fast_kept, false as wrong_kept")
def st12_shadow(spark, sf_dir):
    slow = kept(history.entity_history(events(spark, sf_dir), spec((24,))), "slow")
    names = ["h_n_prior", "h_cnt_24h", "h_amt_24h"]
    _, good = stateful.shadowed(slow, slow, "event_id", names)
    _, bad = stateful.shadowed(slow, slow.withColumn("h_amt_24h", F.col("h_amt_24h") + 1), "event_id", names)
    return spark.createDataFrame([(good, bad)], "fast_kept boolean, wrong_kept boolean")


@query("select count(distinct user_id)::bigint as n, count(*)::double as events from events")
def st13_state_upgrade(spark, sf_dir):
    s = spec((24,))
    own = _input(spark, sf_dir, s)
    old = own.groupBy("entity").agg(F.lit("{}").alias("state")).withColumn("format", F.lit(stateful.OLD_FORMATS[0]))
    new = stateful.upgraded(old, own, s)
    return new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("state", "$.totals.n").cast("double")).alias("events"))
