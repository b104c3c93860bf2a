"""The registry of queries over the driver's tables, and their SQL. A key begins with the operators that it shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.steps import Pipeline, step
from ..functions.views import ModelView
from ..operators import audit, history, metrics, neighbours, ranking, relational, splits
from ..sources import readers
from ..sources.contracts import EVENTS
from ..sources.scratch import fresh

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}
HOUR = history.MICROS_PER_HOUR


def query(sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import extended  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import extended  # noqa: F401

    return {k: v if isinstance(v, str) else v() for k, v in _SQL.items()}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> Column:
    """Microseconds of a naive timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("t", micros("ts"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that is a function of the id."""
    d = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return d.withColumn("p", F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / 1000.0).withColumn("y", F.col("toxic"))


SCORED = "s as (select doc_id, n_chars, lang, quality, toxic, toxic as y, ((doc_id * 7919) % 1000) / 1000.0::double as p from labels join documents using (doc_id))"
ORDERS = "o as (select *, epoch_us(o_orderdate) as t from orders)"
EV = "e as (select *, epoch_us(ts) as t from events)"


def spec(windows=(1, 24, 168), contexts=("event_type",)) -> history.HistorySpec:
    return history.HistorySpec("user_id", "t", "event_id", "value", contexts, windows)


def order_spec(windows=(24, 720, 4320), contexts=("o_orderpriority",)) -> history.HistorySpec:
    return history.HistorySpec("o_custkey", "t", "o_orderkey", "o_totalprice", contexts, windows, deviation_h=4320)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").withColumn("t", micros("o_orderdate"))


def frame(kind: str, x: str, keys: str, time: str, seq: str, w: int) -> str:
    z = "0" if kind == "count" else "0.0"
    return f"coalesce({kind}({x}) over (partition by {keys} order by {time} range between {w - 1} preceding and 1 preceding), {z}) + coalesce({kind}({x}) over (partition by {keys}, {time} order by {seq} rows between unbounded preceding and 1 preceding), {z})"


def _hist_sql(source: str, name: str, seq: str, entity: str, amount: str, windows: tuple[int, ...]) -> str:
    cols = [f"{frame('count', '*', entity, 't', seq, w * HOUR)} as h_cnt_{w}h, round({frame('sum', amount, entity, 't', seq, w * HOUR)}, 2) as h_amt_{w}h" for w in windows]
    return f"with {source} select {seq}, row_number() over (partition by {entity} order by t, {seq}) - 1 as h_n_prior, {', '.join(cols)} from {name}"


def _hist(df: DataFrame, s: history.HistorySpec) -> DataFrame:
    out = history.entity_history(df, s)
    return out.select(s.seq, "h_n_prior", *[c for w in s.windows_h for c in (F.col(f"h_cnt_{w}h"), F.round(f"h_amt_{w}h", 2).alias(f"h_amt_{w}h"))])


# --- windows ---------------------------------------------------------------------------------------------------------


@query(_hist_sql(EV, "e", "event_id", "user_id", "value", (1, 24, 168)))
def win_hist_entity(spark, sf_dir):
    return _hist(events(spark, sf_dir), spec())


@query(_hist_sql(ORDERS, "o", "o_orderkey", "o_custkey", "o_totalprice", (24, 720, 4320)))
def win_hist_entity_ties(spark, sf_dir):
    return _hist(orders(spark, sf_dir), order_spec())


@query(_hist_sql(EV, "e", "event_id", "user_id", "value", (1, 3, 6, 12, 18, 24, 72, 168)))
def win_hist_all_widths(spark, sf_dir):
    return _hist(events(spark, sf_dir), spec((1, 3, 6, 12, 18, 24, 72, 168)))


@query(f"with {EV} select event_id, " + ", ".join(f"{frame('count', '*', 'user_id, event_type', 't', 'event_id', w * HOUR)} as h_event_type_cnt_{w}h, round({frame('sum', 'value', 'user_id, event_type', 't', 'event_id', w * HOUR)}, 2) as h_event_type_amt_{w}h" for w in (1, 24, 168)) + " from e")
def win_hist_context(spark, sf_dir):
    out = history.context_history(events(spark, sf_dir), spec())
    return out.select("event_id", *[c for w in (1, 24, 168) for c in (F.col(f"h_event_type_cnt_{w}h"), F.round(f"h_event_type_amt_{w}h", 2).alias(f"h_event_type_amt_{w}h"))])


@query(f"""with {EV}, l as (select event_id, value, (t - lag(t) over w) / {HOUR}.0 as g, lag(value) over w as p from e window w as (partition by user_id order by t, event_id))
    select event_id, round(g, 6) as h_hours_since_last, p as h_prev_amt, round(case when p > 0 then value / p end, 6) as h_amt_to_prev from l""")
def win_hist_last(spark, sf_dir):
    out = history.entity_history(events(spark, sf_dir), spec(()))
    return out.select("event_id", *r6("h_hours_since_last"), "h_prev_amt", *r6("h_amt_to_prev"))


@query(f"""with {ORDERS}, f as (select o_orderkey, o_totalprice as x, {frame('count', '*', 'o_custkey', 't', 'o_orderkey', 4320 * HOUR)} as n, {frame('sum', 'o_totalprice', 'o_custkey', 't', 'o_orderkey', 4320 * HOUR)} as s,
    {frame('sum', 'o_totalprice * o_totalprice', 'o_custkey', 't', 'o_orderkey', 4320 * HOUR)} as q from o), g as (select *, case when n > 0 then s / n end as m from f), h as (select *, case when n > 1 then sqrt(greatest((q - n * m * m) / (n - 1), 0.0)) end as d from g)
    select o_orderkey, round(m, 5) as h_amt_mean, round(case when m > 0 then x / m end, 6) as h_amt_to_mean, round(case when d > 0 then (x - m) / d end, 3) as h_amt_z from h""")
def win_hist_deviation(spark, sf_dir):
    out = history.deviation(orders(spark, sf_dir), order_spec())
    return out.select("o_orderkey", F.round("h_amt_mean", 5).alias("h_amt_mean"), *r6("h_amt_to_mean"), F.round("h_amt_z", 3).alias("h_amt_z"))


_HAV = "2 * 6371.0088 * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))"


@query(f"""with {EV}, g as (select event_id, user_id, t, ((user_id * 7) % 180 - 90)::double as hlat, ((user_id * 13) % 360 - 180)::double as hlon, ((event_id * 11) % 180 - 90)::double as mlat, ((event_id * 17) % 360 - 180)::double as mlon from e),
    k as (select *, {_HAV.format(a="hlat", b="hlon", c="mlat", d="mlon")} as dist, lag(mlat) over w as plat, lag(mlon) over w as plon, (t - lag(t) over w) / 1e6 as gap from g window w as (partition by user_id order by t, event_id)),
    f as (select *, {_HAV.format(a="plat", b="plon", c="mlat", d="mlon")} as km, {frame('count', '*', 'user_id', 't', 'event_id', 168 * HOUR)} as n, {frame('sum', 'dist', 'user_id', 't', 'event_id', 168 * HOUR)} as s from k)
    select event_id, round(km, 3) as h_km_to_prev, round(case when gap >= 60 then km / (gap / 3600) end, 2) as h_speed_kmh, round(case when n > 0 then s / n end, 3) as h_home_km_mean, round(case when n > 0 and s / n > 0 then dist / (s / n) end, 6) as h_home_km_ratio from f""")
def win_hist_geo(spark, sf_dir):
    e = events(spark, sf_dir)
    at = lambda k, m, n, h: (F.pmod(F.col(k) * m, F.lit(n)) - h).cast("double")
    e = e.withColumns({"hlat": at("user_id", 7, 180, 90), "hlon": at("user_id", 13, 360, 180), "mlat": at("event_id", 11, 180, 90), "mlon": at("event_id", 17, 360, 180)})
    out = history.geo(e, spec(), ("hlat", "hlon"), ("mlat", "mlon"))
    return out.select("event_id", F.round("h_km_to_prev", 3).alias("h_km_to_prev"), F.round("h_speed_kmh", 2).alias("h_speed_kmh"), F.round("h_home_km_mean", 3).alias("h_home_km_mean"), *r6("h_home_km_ratio"))


@query(f"""with {EV}, a as (select event_id, user_id, t, 2 * pi() * (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))) / 86400 as a from e),
    f as (select event_id, {frame('count', '*', 'user_id', 't', 'event_id', 168 * HOUR)} as n, {frame('sum', 'cos(a)', 'user_id', 't', 'event_id', 168 * HOUR)} as c, {frame('sum', 'sin(a)', 'user_id', 't', 'event_id', 168 * HOUR)} as s from a)
    select event_id, n as h_vm7_n, round(case when n >= 3 then sqrt(c * c + s * s) / n end, 6) as h_vm7_r from f""")
def win_hist_circular(spark, sf_dir):
    out = history.circular(events(spark, sf_dir), spec(), "ts", (7,))
    return out.select("event_id", "h_vm7_n", *r6("h_vm7_r"))


@query(f"with {EV} select event_id, coalesce(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by t, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as prior_positives from e")
def win_prior_positives(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("y", (F.col("event_type") == "error").cast("long"))
    return e.select("event_id", history.exclusive_sum("y", ["user_id"], "t", "event_id").alias("prior_positives"))


@query(f"with {ORDERS}, g as (select o_custkey, t - lag(t) over (partition by o_custkey order by t, o_orderkey) as gap from o) select o_custkey, count(*)::bigint as n, min(gap)::bigint as least, max(gap)::bigint as most from g where gap > 0 group by 1")
def win_gap_stats(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("t", "o_orderkey")
    g = orders(spark, sf_dir).select("o_custkey", (F.col("t") - F.lag("t").over(w)).alias("gap")).where("gap > 0")
    return g.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))


@query(f"with {ORDERS}, g as (select count(*) over (partition by o_custkey, t) as k from o) select count(*)::bigint as n, count(*) filter (where k > 1)::bigint as n_shared from g")
def win_shared_instant(spark, sf_dir):
    g = orders(spark, sf_dir).select(F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "t")).alias("k"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") > 1).alias("n_shared"))


@query(f"with {EV}, f as (select t, t < lag(t) over (order by event_id) as fell from e) select min(t) as t_min, max(t) as t_max, count(distinct t)::bigint as n_distinct, count(*) filter (where fell)::bigint as n_falls from f")
def a08_order_profile(spark, sf_dir):
    return audit.order_profile(events(spark, sf_dir), "t", "event_id")


# --- joins, dedup, sets ----------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def j02_left_join(spark, sf_dir):
    return t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def j01_left_join_one_to_one(spark, sf_dir):
    return relational.left_join_one_to_one(t(spark, sf_dir, "documents").select("doc_id", "lang"), t(spark, sf_dir, "labels"), ["doc_id"])


@query("select c_custkey, (c_custkey in (select o_custkey from orders))::int::tinyint as has_orders from customer")
def j03_existence_flag(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.flag_existing(t(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"], "has_orders")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F')")
def j04_anti_join(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.only_left(t(spark, sf_dir, "customer"), o, ["c_custkey"]).select("c_custkey", "c_name")


@query("select lang, count(*)::bigint as n, count(quality)::bigint as n_labelled, round(avg(quality), 6) as rate from documents left join labels using (doc_id) group by 1")
def j05_label_propagation(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("n_labelled"), F.round(F.avg("quality"), 6).alias("rate"))


@query("with f as (select o_orderpriority as k, count(*) * 1.0::double / sum(count(*)) over () as q from orders group by 1) select o_orderkey, round(q, 6) as priority_freq from orders join f on k = o_orderpriority")
def j06_map_lookup(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    s = step("FrequencyEncoder", columns=["o_orderpriority"]).fit(o)
    freq = s.state["freq"]["o_orderpriority"]
    return o.select("o_orderkey", F.round(relational.lookup(F.col("o_orderpriority"), freq, 0.0), 6).alias("priority_freq"))


@query("with k as (select distinct user_id, ts::date as d from events where event_type = 'error') select event_id from events e where event_type <> 'error' and exists (select 1 from k where k.user_id = e.user_id and k.d = e.ts::date)")
def j11_pair_membership(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    bad = e.where("event_type = 'error'").select("user_id", "d").distinct()
    return e.where("event_type <> 'error'").join(bad, ["user_id", "d"], "left_semi").select("event_id")


@query("select event_id, round(case when value <= 0 then 0 when value >= 100 then 3 when value <= 10 then value / 10 else 1 + 2 * (value - 10) / 90 end, 6) as z from events")
def j12_interpolate(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.round(relational.interpolate(F.col("value"), [0, 10, 100], [0, 1, 3]), 6).alias("z"))


@query("with r as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) as rn from lineitem) select l_orderkey, l_linenumber, l_partkey, l_extendedprice from r where rn = 1")
def t03_keep_first(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").withColumn("seq", F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return relational.keep_first(l, ["l_orderkey", "l_linenumber"], "seq").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("with c as (select l_orderkey, l_linenumber, count(*) as k from lineitem group by 1, 2) select sum(k)::bigint as n_rows, count(*)::bigint as n_distinct, sum(k - 1)::bigint as n_redundant from c")
def a11_duplicates(spark, sf_dir):
    return audit.duplicates(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("with c as (select count(*) as size from documents group by text having count(*) > 1) select size::bigint as size, count(*)::bigint as n_groups from c group by 1")
def a12_duplicate_sizes(spark, sf_dir):
    return audit.duplicate_sizes(t(spark, sf_dir, "documents"), ["text"])


@query("select l_orderkey, l_linenumber, count(distinct l_returnflag)::bigint as n_labels, count(*)::bigint as n from lineitem group by 1, 2 having count(distinct l_returnflag) > 1")
def a13_conflicting_labels(spark, sf_dir):
    return audit.conflicts(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'O') select count(*) filter (where a.k is not null and b.k is not null)::bigint as n_both, count(*) filter (where b.k is null)::bigint as n_only_a, count(*) filter (where a.k is null)::bigint as n_only_b from a full join b on a.k = b.k")
def o04_key_overlap(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return relational.overlap(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


@query("select source, k, count(*)::bigint as n from (select 'customer' as source, c_nationkey as k from customer union all select 'supplier', s_nationkey from supplier) group by 1, 2")
def o01_union_all(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("k"))
    b = t(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("k"))
    return a.unionByName(b).groupBy("source", "k").agg(F.count(F.lit(1)).alias("n"))


@query("select * from (select distinct c_nationkey as k from customer intersect select distinct s_nationkey from supplier)")
def o04_intersect(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf_dir, "supplier").select("s_nationkey"))


# --- sources, filters, projections -----------------------------------------------------------------------------------


@query("select event_id, user_id, event_type, value from events")
def sc01_csv_round_trip(spark, sf_dir):
    folder = fresh(spark, "csv")
    t(spark, sf_dir, "events").write.option("header", True).csv(folder)
    return readers.read_csv(spark, folder, EVENTS, ["event_id", "user_id", "event_type", "value"])


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 100")
def sc03_first_rows(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("select event_id, ts, user_id, value from events where ts > timestamp '2024-01-10 00:00:00' order by ts, event_id limit 50")
def sc13_event_sample(spark, sf_dir):
    return t(spark, sf_dir, "events").where("ts > TIMESTAMP_NTZ'2024-01-10 00:00:00'").orderBy("ts", "event_id").limit(50).select("event_id", "ts", "user_id", "value")


@query("select doc_id, substr(sha256(doc_id::varchar), 1, 12) as safe from documents")
def sk06_safe_ids(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", scalars.safe_id(F.col("doc_id")).alias("safe"))


@query("select p_partkey, p_name, p_size from part")
def pf01_drop_columns(spark, sf_dir):
    return step("DropColumns", columns=["p_brand", "p_type", "p_retailprice", "absent"]).fit(t(spark, sf_dir, "part")).transform(t(spark, sf_dir, "part"))


@query("select event_id, event_type, value, props from events")
def pf02_role_projection(spark, sf_dir):
    s = step("FinalizeFeatures", keep=["event_id"])
    s.contract = EVENTS
    e = t(spark, sf_dir, "events")
    return s.fit(e).transform(e)


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_totalprice > 100000")
def pf07_in_list(spark, sf_dir):
    return t(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 100000)).select("o_orderkey")


@query("with n as (select doc_id, case when n_chars < 500 then 'short' end as a, case when n_chars > 5000 then 'long' end as b, case when source in ('src0', 'src1') then 'source' end as c from documents) select doc_id, concat_ws(',', a, b, c) as errors from n where a is not null or b is not null or c is not null")
def pf15_field_checks(spark, sf_dir):
    bad = scalars.errors({"short": F.col("n_chars") < 500, "long": F.col("n_chars") > 5000, "source": F.col("source").isin("src0", "src1")})
    return t(spark, sf_dir, "documents").select("doc_id", bad.alias("e")).where("size(e) > 0").select("doc_id", F.array_join("e", ",").alias("errors"))


@query(f"with {ORDERS}, m as (select max(t) as m from o) select o_orderkey, t + {720 * HOUR} <= m as matured from o, m")
def pf11_maturity_mask(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.select("o_orderkey", (F.col("t") + 720 * HOUR <= o.agg(F.max("t")).scalar()).alias("matured"))


# --- audit aggregations ----------------------------------------------------------------------------------------------


@query("select event_type, count(*)::bigint as n, round(avg(case when value > 50 then 1.0 else 0.0 end), 6) as rate from events group by 1")
def a02_rate_by_category(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"))


_P = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("with o as (select nullif(o_custkey % 7, 0) as o_custkey, o_orderstatus, o_orderpriority from orders) " + " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null)::bigint as n_null, round(count(*) filter (where {c} is null) / count(*), 6) as null_fraction, count(distinct {c})::bigint as n_distinct from o" for c in _P))
def a06_null_profile(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("o_custkey", F.nullif(F.pmod("o_custkey", F.lit(7)), F.lit(0)))
    return audit.profile(o, _P).withColumn("null_fraction", F.round("null_fraction", 6))


@query("with o as (select nullif(o_custkey % 7, 0) as a, nullif(o_custkey % 7, 0) as b, o_orderkey as c from orders), p as (select 'a' as x, count(*) filter (where a is null) as n from o union all select 'b', count(*) filter (where b is null) from o union all select 'c', count(*) filter (where c is null) from o) select n::bigint as n_null, string_agg(x, ',' order by x) as columns from p group by 1")
def a07_null_blocks(spark, sf_dir):
    m = F.nullif(F.pmod("o_custkey", F.lit(7)), F.lit(0))
    return audit.null_blocks(t(spark, sf_dir, "orders").select(m.alias("a"), m.alias("b"), F.col("o_orderkey").alias("c")), ["a", "b", "c"])


@query("select p_brand, count(*)::bigint as n from part group by 1 order by n desc, p_brand limit 5")
def a09_top_values(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@query(f"with {SCORED}, u as (select 'lang' as \"column\", lang as value, toxic from s union all select 'quality', quality::varchar, toxic from s) select \"column\", value, count(*)::bigint as n, round(avg(toxic), 6) as rate from u group by 1, 2")
def a10_value_table(spark, sf_dir):
    return audit.value_table(scored(spark, sf_dir), ["lang", "quality"], "toxic").withColumn("rate", F.round("rate", 6))


@query("with c as (select count(*) as n from events group by user_id) select round(quantile_cont(n, 0.0)::double, 6) as q000, round(quantile_cont(n, 0.1)::double, 6) as q010, round(quantile_cont(n, 0.5)::double, 6) as q050, round(quantile_cont(n, 0.9)::double, 6) as q090, round(quantile_cont(n, 1.0)::double, 6) as q100 from c")
def a14_entity_quantiles(spark, sf_dir):
    return audit.group_size_quantiles(t(spark, sf_dir, "events"), "user_id", [0.0, 0.1, 0.5, 0.9, 1.0]).select(*r6("q000", "q010", "q050", "q090", "q100"))


@query("with c as (select user_id, count(*) filter (where event_type = 'error') as p from events group by 1), r as (select p, row_number() over (order by p desc, user_id) as rn, greatest(floor(count(*) over () / 10), 1) as k from c) select round(sum(case when rn <= k then p else 0 end) / sum(p), 6) as share from r")
def a15_top_decile_share(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return audit.top_decile_share(e, "user_id", "y").select(*r6("share"))


@query("select l_returnflag, count(l_quantity)::bigint as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std, min(l_extendedprice) as least, round(quantile_cont(l_extendedprice, 0.25), 4) as q25, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.75), 4) as q75, max(l_extendedprice) as most from lineitem group by 1")
def a16_describe_by_class(spark, sf_dir):
    d = audit.describe(t(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "least", *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")], "most")


@query("select o_orderpriority, round(median(o_totalprice) filter (where o_orderstatus = 'F'), 4) as \"F\", round(median(o_totalprice) filter (where o_orderstatus = 'O'), 4) as \"O\" from orders group by 1")
def a18_pivot_median(spark, sf_dir):
    return audit.median_table(t(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus", ["F", "O"]).select("o_orderpriority", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"))


@query(f"with {ORDERS} select (t // {30 * 24 * HOUR})::bigint as bucket, count(*)::bigint as n, round(avg(o_totalprice), 4) as mean from o group by 1")
def a19_time_buckets(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(F.expr(f"t div {30 * 24 * HOUR}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("with g as (select user_id, count(distinct ts::date)::bigint as days, datediff('day', min(ts)::date, max(ts)::date) + 1 as span from events where event_type = 'error' group by 1) select count(*)::bigint as n, median(days)::double as days, median(span)::double as span, round(quantile_cont(span, 0.9), 6) as span_p90 from g")
def a20_episode_spans(spark, sf_dir):
    g = t(spark, sf_dir, "events").where("event_type = 'error'").withColumn("d", F.to_date("ts")).groupBy("user_id").agg(F.count_distinct("d").alias("days"), (F.datediff(F.max("d"), F.min("d")) + 1).alias("span"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.median("days").alias("days"), F.median("span").alias("span"), F.round(F.percentile("span", F.lit(0.9)), 6).alias("span_p90"))


@query("select count(distinct struct_pack(a := l_partkey, b := l_suppkey))::bigint as n from lineitem")
def a23_key_pairs(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("n"))


@query(f"with {SCORED}, b as (select n_chars as x, sum(quality) as pos, count(*) - sum(quality) as neg from s group by 1), c as (select pos, neg, coalesce(sum(neg) over (order by x rows between unbounded preceding and 1 preceding), 0) as below from b), d as (select sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) as a from c) select 'n_chars' as \"column\", round(greatest(a, 1 - a), 6) as auc from d")
def a21_leakage_auc(spark, sf_dir):
    return audit.leakage_auc(scored(spark, sf_dir), ["n_chars"], "quality").select("column", *r6("auc"))


@query(f"with {SCORED}, g as (select lang as value, count(*)::bigint as n, avg(quality) as rate from s group by 1 having count(*) >= 20) select 'lang' as \"column\", value, n, round(rate, 6) as rate from g order by round(rate, 9) desc, value desc limit 1")
def a03_leakage_category(spark, sf_dir):
    return audit.leakage_category(scored(spark, sf_dir), ["lang"], "quality", 20).withColumn("rate", F.round("rate", 6))


# --- splits, weights, samples ----------------------------------------------------------------------------------------


def _cut(f: float) -> str:
    return f"(select min(t) from c where cum >= greatest(round_even({f} * (select sum(k) from v), 0)::bigint, 1))"


_CUM = f"{ORDERS}, v as (select t, count(*) as k from o group by 1), c as (select t, sum(k) over (order by t) as cum from v)"


@query(f"with {_CUM} select o_orderkey, case when t <= {_cut(0.7)} then 'train' when t <= {_cut(0.85)} then 'validation' else 'holdout' end as part from o")
def x01_temporal_split(spark, sf_dir):
    return splits.temporal_split(orders(spark, sf_dir), "t").select("o_orderkey", "part")


@query(f"with {_CUM} select o_orderkey, case when t <= {_cut(0.7)} then 'train' when t > {_cut(0.7)} + {720 * HOUR} and t <= {_cut(0.85)} then 'validation' when t > {_cut(0.85)} + {720 * HOUR} then 'holdout' end as part from o")
def x01_split_with_gap(spark, sf_dir):
    return splits.temporal_split(orders(spark, sf_dir), "t", gap=720 * HOUR).select("o_orderkey", "part")


@query(f"with {_CUM}, p as (select t, o_orderstatus, case when t <= {_cut(0.7)} then 'train' when t <= {_cut(0.85)} then 'validation' else 'holdout' end as part from o) select part, count(*)::bigint as n, round(count(*) / sum(count(*)) over (), 4) as fraction, sum((o_orderstatus = 'F')::int)::bigint as positives, round(avg((o_orderstatus = 'F')::int), 6) as prevalence, min(t) as t_min, max(t) as t_max from p group by 1")
def a24_split_summary(spark, sf_dir):
    o = splits.temporal_split(orders(spark, sf_dir), "t").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return splits.summary(o, "t", "y")


@query(f"with {_CUM} select o_orderkey, case when t <= {_cut(0.4)} then 0 when t <= {_cut(0.6)} then 1 when t <= {_cut(0.8)} then 2 when t <= {_cut(1.0)} then 3 end as fold from o")
def x04_forward_folds(spark, sf_dir):
    return splits.forward_folds(orders(spark, sf_dir), "t").select("o_orderkey", "fold")


@query(f"with {SCORED}, c as (select quality, count(*) as n from s group by 1) select quality, n::bigint as n, round_even(n * 0.3, 0)::bigint as n_test from c")
def x02_stratified_counts(spark, sf_dir):
    s = splits.stratified(scored(spark, sf_dir), "quality", "doc_id")
    return s.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("part") == "test").alias("n_test"))


@query(f"with {SCORED}, n as (select count(*) as n from s), c as (select toxic, count(*) as k from s group by 1) select doc_id, round(n / (2.0 * k), 6) as weight from s join c using (toxic), n")
def x06_class_weights(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("doc_id", F.round(relational.lookup(F.col("toxic"), splits.class_weights(s, "toxic"), 0.0), 6).alias("weight"))


@query(f"with {SCORED} select doc_id, round(greatest(n_chars, 500) / 1000.0, 6) as weight from s")
def x06_example_weights(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.round(splits.example_weights(F.col("n_chars").cast("double"), 1000.0, 500.0), 6).alias("weight"))


@query(f"with {SCORED}, n as (select sum(toxic) as p, count(*) - sum(toxic) as q from s) select 0 as y, p::bigint as n from n union all select 1, p::bigint from n")
def t07_under_sample_counts(spark, sf_dir):
    return splits.under_sample(scored(spark, sf_dir), "y", "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {SCORED}, n as (select count(*) - sum(toxic) as q from s) select 0 as y, q::bigint as n from n union all select 1, q::bigint from n")
def t08_over_sample_counts(spark, sf_dir):
    return splits.over_sample(scored(spark, sf_dir), "y", "doc_id").groupBy("y").agg(F.count(F.lit(1)).alias("n"))


# --- steps and views -------------------------------------------------------------------------------------------------


@query("select p_partkey, regexp_replace(p_brand, '^Brand#', '') as p_brand from part")
def f01_strip_prefix(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return step("StripPrefix", column="p_brand", prefix="Brand#").fit(p).transform(p)


@query("select page_id, split_part(url, '/', 3) as host, case when len(string_split(url, '/')) >= 6 then string_split(url, '/')[6] end as sixth from pages")
def f02_token_split(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", scalars.token(F.col("url"), "/", 2).alias("host"), scalars.token(F.col("url"), "/", 5).alias("sixth"))


@query("select o_orderkey, round(ln(1 + greatest(o_totalprice, 0)), 6) as v from orders")
def f16_log_amount(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.round(scalars.log_amount(F.col("o_totalprice")), 6).alias("v"))


_NEAR = "abs(o_totalprice - round_even(o_totalprice, {d})) <= 1e-9 + 1e-5 * abs(round_even(o_totalprice, {d}))"


@query("select o_orderkey, (case " + " ".join(f"when {_NEAR.format(d=d)} then {d}" for d in (0, 1, 2)) + " else 3 end)::tinyint as v from orders")
def f18_amount_decimals(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return step("AmountDecimals", column="o_totalprice", output="v").fit(o).transform(o).drop("o_totalprice")


@query("select event_id, extract(hour from ts)::tinyint as c_hour, (isodow(ts) - 1)::tinyint as c_dow, extract(month from ts)::tinyint as c_month, round(sin(2 * pi() * (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts))) / 86400)::float::double, 5) as c_day_sin from events")
def f09_calendar(spark, sf_dir):
    c = scalars.calendar(F.col("ts"), "c")
    return t(spark, sf_dir, "events").select("event_id", *[c[k].alias(k) for k in ("c_hour", "c_dow", "c_month")], F.round(c["c_day_sin"].cast("double"), 5).alias("c_day_sin"))


@query("select o_orderkey, floor((epoch_us(o_orderdate) - epoch_us(timestamp '1990-05-17 12:00:00')) / 86400000000.0) / 365.25 as age from orders")
def f12_age(spark, sf_dir):
    age = scalars.age_years(F.expr("TIMESTAMP_NTZ'1990-05-17 12:00:00'"), F.col("o_orderdate"))
    return t(spark, sf_dir, "orders").select("o_orderkey", age.alias("age"))


@query(f"with {EV}, b as (select event_id, (t - (select min(t) from e)) / 1e6 as s from e), p as (select event_id, (s % 86400.0) / 86400.0 as p from b) select event_id, floor(p * 24)::smallint as k_bin, round(sin(2 * pi() * p)::float::double, 4) + 0.0 as k_sin from p")
def f11_cyclic_clock(spark, sf_dir):
    e = events(spark, sf_dir)
    c = scalars.clock((F.col("t") - e.agg(F.min("t")).scalar()) / 1e6, 86400.0, "k")
    return e.select("event_id", c["k_bin"].alias("k_bin"), (F.round(c["k_sin"].cast("double"), 4) + 0.0).alias("k_sin"))


@query("select c_custkey, round(1 / (1 + exp(-c_acctbal / 5000)), 6) as p, case when 1 / (1 + exp(-c_acctbal / 5000)) >= 0.6 then 'SUSPECT' else 'APPROVED' end as decision from customer")
def f21_f30_decision(spark, sf_dir):
    p = scalars.sigmoid(F.col("c_acctbal") / 5000)
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(p, 6).alias("p"), scalars.decision(p, 0.6).alias("decision"))


@query("with k as (select distinct o_orderpriority as v from orders where o_custkey % 5 = 0) select o_orderkey, case when o_custkey % 11 = 0 then '<NA>' when o_orderpriority in (select v from k) then o_orderpriority else '<UNK>' end as o_orderpriority from orders")
def f26_typer(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = step("CategoricalTyper", columns=["o_orderpriority"]).fit(o.where("o_custkey % 5 = 0"))
    return s.transform(o.withColumn("o_orderpriority", F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderpriority")))).select("o_orderkey", "o_orderpriority")


@query("with r as (select p_brand as b, row_number() over (order by count(*) desc, p_brand) as code from part group by 1) select p_partkey, code::int as p_brand_code from part join r on b = p_brand")
def f27_category_code(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return step("CategoricalEncoder", columns=["p_brand"]).fit(p).transform(p).select("p_partkey", "p_brand_code")


@query("with n as (select o_orderkey, nullif(o_custkey % 7, 0) as a, nullif(o_orderkey % 5, 0) as b from orders) select o_orderkey, ((a is null)::int + (b is null)::int)::smallint as n_missing, (a is null)::int::tinyint as a__isna, (b is null)::int::tinyint as b__isna from n")
def f23_f24_missing(spark, sf_dir):
    n = t(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.pmod("o_custkey", F.lit(7)), F.lit(0)).alias("a"), F.nullif(F.pmod("o_orderkey", F.lit(5)), F.lit(0)).alias("b"))
    p = Pipeline([step("RowMissingCount", pattern="[ab]", output="n_missing"), step("MissingIndicator", columns=["a", "b"])]).fit(n)
    return p.transform(n).drop("a", "b")


@query("with n as (select o_orderkey, case when o_custkey % 7 <> 0 then o_totalprice end as x from orders), m as (select median(x) as d from n) select o_orderkey, round(coalesce(x, d), 4) as x from n, m")
def f25_median_fill(spark, sf_dir):
    n = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).alias("x"))
    return step("MedianImputer", columns=["x"]).fit(n).transform(n).withColumn("x", F.round("x", 4))


@query("with m as (select avg(l_quantity) as a, stddev_pop(l_quantity) as s from lineitem) select l_returnflag, round(avg((l_quantity - a) / s), 4) as z from lineitem, m group by 1")
def f19_standardize(spark, sf_dir):
    l = t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return step("Standardize", columns=["l_quantity"]).fit(l).transform(l).groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_quantity").cast("double")), 4).alias("z"))


@query("with k as (select c_mktsegment as v from customer group by 1 having count(*) >= 300) select c_mktsegment as seg, count(*)::bigint as n, (c_mktsegment not in (select v from k))::int::tinyint as rare from customer group by 1")
def f29_one_hot_rare(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    v = ModelView("linear", 300).fit(c.select("c_mktsegment", "c_acctbal"))
    v.state["keep"] = ["c_custkey"]
    wide = v.transform(c).join(c.select("c_custkey", F.col("c_mktsegment").alias("seg")), "c_custkey")
    return wide.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.max("c_mktsegment=<RARE>").alias("rare"))


# --- metrics ---------------------------------------------------------------------------------------------------------

_CURVE = f"{SCORED}, g as (select p, sum(y) as pos, count(*) as n from s group by 1), c as (select p, pos, n, sum(pos) over w as tp, sum(n - pos) over w as fp from g window w as (order by p desc))"


@query(f"with {_CURVE} select round(sum(pos * tp * 1.0 / (tp + fp)) / sum(pos), 6) as pr_auc from c")
def m01_pr_auc(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), "y", "p").select(*r6("pr_auc"))


@query(f"with {_CURVE} select round(sum((n - pos) * (tp - pos / 2)) / (sum(pos) * sum(n - pos)), 6) as roc_auc from c")
def m02_roc_auc(spark, sf_dir):
    return metrics.roc_auc(scored(spark, sf_dir), "y", "p").select(*r6("roc_auc"))


@query(f"with {_CURVE}, z as (select sum(pos) as a, sum(n - pos) as b from c), k as (select tp, p from c, z where fp / b <= 0.1) select round(max(tp) / (select a from z), 6) as recall, round((select max(p) from k where tp = (select max(tp) from k)), 6) as threshold from k")
def m03_recall_at_fpr(spark, sf_dir):
    return metrics.recall_at_fpr(scored(spark, sf_dir), "y", "p", 0.1).select(*r6("recall", "threshold"))


@query(f"with {SCORED}, n as (select greatest(1, round_even(0.1 * count(*), 0))::bigint as k, sum(y) as pos from s), r as (select y, row_number() over (order by p desc, doc_id) as rn from s) select k, round(avg(y), 6) as precision, round(sum(y) / max(pos), 6) as recall from r, n where rn <= k group by k")
def m04_precision_at_budget(spark, sf_dir):
    return metrics.precision_at_budget(scored(spark, sf_dir), "y", "p", "doc_id", 0.1).select("k", *r6("precision", "recall"))


@query(f"with {SCORED}, c as (select sum((p >= 0.5 and y = 1)::int)::double as tp, sum((p >= 0.5 and y = 0)::int)::double as fp, sum((p < 0.5 and y = 1)::int)::double as fn, sum((p < 0.5 and y = 0)::int)::double as tn from s) select round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc, round((tp + fp) / (tp + fp + fn + tn), 6) as alert_rate, round(fp / (fp + tn), 6) as fpr from c")
def m05_operating_point(spark, sf_dir):
    return metrics.operating_point(scored(spark, sf_dir), "y", "p", 0.5).select(*r6("precision", "recall", "f1", "mcc", "alert_rate", "fpr"))


@query(f"with {SCORED}, b as (select ntile(10) over (order by p, doc_id) as bin, p, y from s) select bin::int as bin, count(*)::bigint as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from b group by 1")
def m06_calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(scored(spark, sf_dir), "y", "p", "doc_id").select("bin", "n", *r6("mean_p", "rate"))


@query(f"with {SCORED}, q as (select y, p, greatest(least(p, 1 - 1e-7), 1e-7) as c, ntile(10) over (order by p, doc_id) as bin from s), b as (select count(*) as n, abs(avg(p) - avg(y)) as e from q group by bin) select round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) as log_loss, round((select sum(n * e) / sum(n) from b), 6) as ece from q")
def m06_calibration(spark, sf_dir):
    return metrics.calibration(scored(spark, sf_dir), "y", "p", "doc_id").select(*r6("brier", "log_loss", "ece"))


@query(f"with {SCORED} select sum(case when p >= 0.5 and y = 1 then n_chars else 0 end)::double as caught, sum(case when p < 0.5 and y = 1 then n_chars else 0 end)::double as missed, sum(case when p >= 0.5 and y = 0 then n_chars else 0 end)::double as friction, sum((p >= 0.5)::int)::bigint as alerts from s")
def m07_business(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("a", F.col("n_chars").cast("double"))
    return metrics.business(s, "y", "p", 0.5, "a")


@query(f"with {SCORED}, c as (select sum(case when p >= 0.5 then 1000.0 when y = 1 then n_chars else 0 end)::double as cost, sum(case when y = 1 then n_chars else 0 end)::double as base from s) select cost, base, round((base - cost) / base, 6) as savings from c")
def x11_cost_savings(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("a", F.col("n_chars").cast("double"))
    return metrics.cost(s, "y", F.col("p") >= 0.5, "a", 1000.0).withColumn("savings", F.round("savings", 6))


@query(f"with {_CURVE}, f as (select p, round(2.0 * tp / (tp + fp + (select sum(pos) from g)), 12) as f1 from c) select round(f1, 6) as f1, round(p, 6) as threshold from f order by f.f1 desc, p limit 1")
def m08_f1_threshold(spark, sf_dir):
    return metrics.f1_threshold(scored(spark, sf_dir), "y", "p").select(*r6("f1", "threshold"))


@query(f"with {SCORED}, g as (select p, sum(case when y = 1 then n_chars else 0 end)::double as a, count(*) as n from s group by 1), c as (select p, sum(n) over w * 1000.0 + (select sum(a) from g) - sum(a) over w as cost from g window w as (order by p desc)) select round(cost, 4) as cost, round(p, 6) as threshold from c order by c.cost, p limit 1")
def m08_cost_threshold(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("a", F.col("n_chars").cast("double"))
    return metrics.cost_threshold(s, "y", "p", "a", 1000.0).select(F.round("cost", 4).alias("cost"), *r6("threshold"))


@query("select " + ", ".join(f"round(quantile_cont(value, {q}), 6) as q{int(q * 100):02d}" for q in (0.1, 0.5, 0.9)) + " from events")
def t11_quantile_grid(spark, sf_dir):
    q = ranking.quantiles(t(spark, sf_dir, "events"), "value", [0.1, 0.5, 0.9])
    return q.select(*[F.round(f"q{i}", 6).alias(f"q{x}") for i, x in enumerate((10, 50, 90))])


# --- neighbours, streaming -------------------------------------------------------------------------------------------


@query("""with q as (select vec_id as q, embedding as a from embeddings where vec_id % 50 = 0), d as (select q, vec_id as n, round(sqrt(list_sum(list_transform(list_zip(a, embedding), lambda x: (x[1]::double - x[2]::double) ** 2))), 5) as d from q, embeddings where vec_id <> q),
    r as (select q, d, row_number() over (partition by q order by d, n) as rn from d) select q, rn::int as rank, d from r where rn <= 5""")
def j10_nearest(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings")
    near = neighbours.nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    return near.select("q", F.row_number().over(Window.partitionBy("q").orderBy("d", "n")).alias("rank"), F.round("d", 5).alias("d"))
