"""Queries over the published catalogs and the library's analytics, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.evaluation.metrics import by_horizon, forward_returns, rank_ic_series
from barloom.library import analysis as A
from barloom.library.catalogs import alpha101, features158
from barloom.library.sharing import common_subexpressions, evaluate_library
from barloom.library.store import CombinationStore, FactorLibrary
from barloom.plans.compiler import compile_factors, evaluate_long
from barloom.queries.catalog_sql import catalog_sql
from barloom.queries.operators import _w, full
from barloom.queries.operators import rank as sql_rank
from barloom.queries.panels import PANEL_SQL, nation_groups, nation_weeks
from barloom.queries.storage import _BARS, AS_OF, END, ORDER, START
from barloom.runtime import new_path, stage, table
from barloom.sources import store as S

SAMPLES = (2, 3, 6, 9, 12, 33, 38, 41, 42, 54, 101)


def alpha101_samples(spark, d):
    long = evaluate_long(nation_weeks(spark, d), {f"alpha{n:03d}": alpha101()[n] for n in SAMPLES})
    return long.select("factor_id", "symbol", "date", F.round("value", 6).alias("value"))


def _coverage(long):
    finite = F.abs("value") != float("inf")
    return long.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_cells"), F.count(F.when(finite, True)).alias("n_finite"))


def alpha101_coverage(spark, d):
    factors = {f"alpha{n:03d}": e for n, e in alpha101().items()}
    return _coverage(evaluate_library(nation_weeks(spark, d), factors, nation_groups(spark, d)))


def _values(long):
    """By factor and symbol, over the finite values: their number, mean and mean tilted by the day of the year, on a scale of logarithms so that none outweighs the others."""
    v = F.when(F.abs("value") != float("inf"), F.col("value"))
    t = F.signum(v) * F.ln(1 + F.abs(v))
    return long.groupBy("factor_id", "symbol").agg(F.count(v).alias("n_finite"), F.round(F.avg(t), 6).alias("mean_log"), F.round(F.avg(t * F.dayofyear("date") / 366), 6).alias("tilted"))


_VALUES_SQL = """, t as (select factor_id, symbol, date, sign(f) * ln(1 + abs(f)) as t from (select *, case when isfinite(v) then v end as f from v))
select factor_id, symbol, count(t) as n_finite, round(avg(t), 6) + 0.0 as mean_log, round(avg(t * dayofyear(date) / 366), 6) + 0.0 as tilted from t group by all"""


#: Alphas that rank, compare or divide by what is equal but for the last digit: another order of summing gives other values, so SQL cannot check them.
TIED = (13, 15, 45, 66, 68, 76, 79, 85, 94, 97, 98)


def _alphas(tied: bool) -> dict[str, str]:
    return {f"alpha{n:03d}": e for n, e in alpha101().items() if (n in TIED) == tied}


def alpha101_values(spark, d):
    """The alphas that hang on no ties, on every cell, summed up by factor and symbol."""
    return _values(evaluate_library(nation_weeks(spark, d), _alphas(False), nation_groups(spark, d)))


def alpha101_tied_values(spark, d):
    """The other alphas."""
    return _values(evaluate_library(nation_weeks(spark, d), _alphas(True), nation_groups(spark, d)))


def features158_values(spark, d):
    """All 158 features on every cell, summed up by factor and symbol."""
    return _values(evaluate_library(nation_weeks(spark, d), features158()))


def stock_bars(spark, d):
    """(date, symbol, open, high, low, close, volume, vwap): the bars of price_raw as known, those with positive numbers; it grows by symbols."""
    bars = S.prices_as_of(table(spark, d, "price_raw"), START, END, AS_OF, order=ORDER)
    bars = bars.select("date", "symbol", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]).where("open > 0 and high > 0 and low > 0 and close > 0 and volume > 0")
    return bars.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)


STOCK_PANEL_SQL = f"""{_BARS.replace(f" - {S.GAP_DAYS}", "")},
ok as (select date, symbol, open::double as open, high::double as high, low::double as low, close::double as close, volume::double as volume from bars where open > 0 and high > 0 and low > 0 and close > 0 and volume > 0),
p as (select d.date, s.symbol, d.bar_no, o.* exclude (date, symbol), (o.high + o.low + o.close) / 3 as vwap from (select date, row_number() over (order by date) - 1 as bar_no from (select distinct date from ok)) d
  cross join (select distinct symbol from ok) s left join ok o using (date, symbol))"""


def features158_bars(spark, d):
    """All 158 features over the raw daily bars of all symbols, summed up by factor and symbol."""
    return _values(evaluate_library(stock_bars(spark, d), features158()))


def features158_coverage(spark, d):
    return _coverage(evaluate_library(nation_weeks(spark, d), features158()))


FOUR = {"level": "rank(close)", "move": "close / delay(close, 1)", "size": "rank(volume)", "tilt": "vwap - close"}


def _four(spark, d):
    return evaluate_long(nation_weeks(spark, d), FOUR)


def factor_similarity(spark, d):
    return A.pairwise_similarity(_four(spark, d)).select("a", "b", F.round("similarity", 7).alias("similarity"))


def factor_redundancy(spark, d):
    return A.redundancy(A.pairwise_similarity(_four(spark, d))).select("factor_id", F.round("redundancy", 7).alias("redundancy"), "nearest")


def factor_prune(spark, d):
    scores = spark.createDataFrame([("level", 0.3), ("move", 0.2), ("size", None), ("tilt", 0.1)], "factor_id string, score double")
    return A.prune(A.pairwise_similarity(_four(spark, d)), scores, 0.4)


def _heatmap(spark, d, period):
    plan = compile_factors(nation_weeks(spark, d), FOUR, keep=("open",))
    frame = forward_returns(plan.frame, (1,), dense=True, carry=list(FOUR))
    long = by_horizon(frame, (1,), ["symbol", "date", *FOUR]).select("symbol", "date", "fwd", F.explode(F.create_map(*[x for k in FOUR for x in (F.lit(k), F.col(k))])).alias("factor_id", "factor"))
    return A.ic_heatmap(rank_ic_series(long, by=["factor_id"]), period).select("factor_id", "period", F.round("rank_ic", 7).alias("rank_ic"), "n")


def ic_heatmap_month(spark, d):
    return _heatmap(spark, d, "month")


def ic_heatmap_quarter(spark, d):
    return _heatmap(spark, d, "quarter")


def ic_heatmap_week(spark, d):
    return _heatmap(spark, d, "week")


def report_library(spark, d):
    """Reports of the four factors saved, one saved again, one deleted, and what is left with a rank ICIR, best first."""
    path = new_path(spark, "library")
    lib = FactorLibrary(spark, path)
    plan = compile_factors(nation_weeks(spark, d), FOUR, keep=("open",))
    frame = stage(forward_returns(plan.frame, (1,), dense=True, carry=list(FOUR)), "library-frame")
    long = by_horizon(frame, (1,), ["symbol", "date", *FOUR]).select("symbol", "date", "fwd", F.explode(F.create_map(*[x for k in FOUR for x in (F.lit(k), F.col(k))])).alias("factor_id", "factor"))
    head = rank_ic_series(long, by=["factor_id"]).groupBy("factor_id").agg(F.avg("rank_ic").alias("rank_ic"), F.stddev_samp("rank_ic").alias("_s"))
    reports = stage(head.select("factor_id", F.col("factor_id").alias("name"), F.lit("demo").alias("market"), "rank_ic", (F.col("rank_ic") / F.col("_s")).alias("rank_icir")), "reports")
    lib.save(reports)
    lib.save(reports.where("factor_id = 'move'").withColumn("market", F.lit("again")))
    lib.delete("size")
    return lib.list(min_rank_icir=-10.0).select("factor_id", "market", F.round("rank_ic", 6).alias("rank_ic"), F.round("rank_icir", 6).alias("rank_icir"))


def combination_runs(spark, d):
    """Combination runs saved, one of them twice, and one deleted."""
    store = CombinationStore(spark, new_path(spark, "runs"))
    store.save("equal", {"level": 0.5, "move": 0.5}, {"icir": 0.1}, name="two", market="demo")
    store.save("equal", {"move": 0.25, "level": 0.75}, {"icir": 0.2}, name="two again", market="demo")
    store.save("ols", {"level": 1.0}, {"icir": 0.3}, name="one")
    store.delete(store.save("ols", {"tilt": 1.0}, name="gone"))
    return store.list().select("name", "method", F.concat_ws(",", "factor_ids").alias("factors"), F.col("weights")["level"].alias("level"), "icir", F.length("run_id").cast("long").alias("id_length"))


def shared_subexpressions(spark, d):
    return spark.createDataFrame(common_subexpressions(list(alpha101().values())), "hash string, expression string, count long, n_factors long, nodes long, score long")


def factor_map(spark, d):
    return spark.createDataFrame(A.factor_map(A.pairwise_similarity(_four(spark, d))), "factor_id string, x double, y double, cluster int")


def factor_lineage(spark, d):
    return spark.createDataFrame(A.lineage({"a": "rank(delta(close, 1))", "b": "delta(close, 1)", "c": "rank(delta(close, 1)) * rank(volume)", "d": "rank(volume)"}), "part string, whole string")


_L = "lag({x}, {n}) over (partition by symbol order by date)"
_D1 = f"close - {_L.format(x='close', n=1)}"
_ALPHA = {
    2: f"select symbol, date, -1 * ({full(f'covar_samp(x, y) over {_w(6)} / nullif(stddev_samp(x) over {_w(6)} * stddev_samp(y) over {_w(6)}, 0)', 6, 'x', 'y')}) as v from (select *, {sql_rank('a')} as x, {sql_rank('b')} as y from (select *, ln(volume) - {_L.format(x='ln(volume)', n=2)} as a, (close - open) / open as b from p))",
    3: f"select symbol, date, -1 * ({full(f'covar_samp(x, y) over {_w(10)} / nullif(stddev_samp(x) over {_w(10)} * stddev_samp(y) over {_w(10)}, 0)', 10, 'x', 'y')}) as v from (select *, {sql_rank('open')} as x, {sql_rank('volume')} as y from p)",
    6: f"select symbol, date, -1 * ({full(f'covar_samp(open, volume) over {_w(10)} / nullif(stddev_samp(open) over {_w(10)} * stddev_samp(volume) over {_w(10)}, 0)', 10, 'open', 'volume')}) as v from p",
    9: f"select symbol, date, case when lo is null then null when lo > 0 then x when hi < 0 then x else -x end as v from (select *, {full(f'min(x) over {_w(5)}', 5, 'x')} as lo, {full(f'max(x) over {_w(5)}', 5, 'x')} as hi from (select *, {_D1} as x from p))",
    12: f"select symbol, date, sign(volume - {_L.format(x='volume', n=1)}) * -1 * ({_D1}) as v from p",
    33: f"select symbol, date, {sql_rank('x')} as v from (select *, -1 * (1 - open / close) as x from p)",
    38: f"select symbol, date, -1 * ({sql_rank('a')}) * ({sql_rank('b')}) as v from (select *, case when count(close) over {_w(10)} = 10 then (len(list_filter(list(close) over {_w(10)}, lambda z: z <= close)) - 1) / 9.0 end as a, close / open as b from p)",
    41: "select symbol, date, pow(high * low, 0.5) - vwap as v from p",
    42: f"select symbol, date, case when y = 0 then case when x > 0 then 'inf'::double end else x / y end as v from (select symbol, date, {sql_rank('vc')} as x, {sql_rank('vs')} as y from (select *, vwap - close as vc, vwap + close as vs from p))",
    54: "select symbol, date, case when (low - high) * pow(close, 5) = 0 then case when -1 * ((low - close) * pow(open, 5)) > 0 then 'inf'::double when -1 * ((low - close) * pow(open, 5)) < 0 then '-inf'::double end else (-1 * ((low - close) * pow(open, 5))) / nullif((low - high) * pow(close, 5), 0) end as v from p",
    101: "select symbol, date, (close - open) / ((high - low) + .001) as v from p",
}
_ALPHA_SQL = f"with {PANEL_SQL}" + " union all ".join(f"select 'alpha{n:03d}' as factor_id, symbol, date, round(v, 6) + 0.0 as value from ({q})" for n, q in _ALPHA.items())
_FOUR_SQL = f"""with {PANEL_SQL},
w as (select symbol, date, {sql_rank('close')} as level, close / {_L.format(x='close', n=1)} as move, {sql_rank('volume')} as size, vwap - close as tilt,
  lead(open, 2) over (partition by symbol order by date) / lead(open, 1) over (partition by symbol order by date) - 1 as fwd from p),
l as (select symbol, date, fwd, unnest(['level', 'move', 'size', 'tilt']) as f, unnest([level, move, size, tilt]) as x from w),
pr as (select a.f as a, b.f as b, a.date, a.x, b.x as y from l a join l b on a.date = b.date and a.symbol = b.symbol and a.f < b.f where a.x is not null and b.x is not null),
rk as (select a, b, date, rank() over (partition by a, b, date order by x) + (count(*) over (partition by a, b, date, x) - 1) / 2.0 as rx, rank() over (partition by a, b, date order by y) + (count(*) over (partition by a, b, date, y) - 1) / 2.0 as ry from pr),
sim as (select a, b, avg(s) as s from (select a, b, date, case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) end as s from rk group by all) group by all),
two as (select a, b, s from sim union all select b, a, s from sim),
fk as (select f, date, rank() over (partition by f, date order by x) + (count(*) over (partition by f, date, x) - 1) / 2.0 as rx, rank() over (partition by f, date order by fwd) + (count(*) over (partition by f, date, fwd) - 1) / 2.0 as ry from l where x is not null and fwd is not null),
ic as (select f, date, case when stddev_pop(rx) > 0 and stddev_pop(ry) > 0 then covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) end as c from fk group by all)
"""
_HEAT = _FOUR_SQL + "select f as factor_id, {p} as period, round(avg(c), 7) + 0.0 as rank_ic, count(c) as n from ic group by all"
ORACLES = {
    "alpha101_samples": _ALPHA_SQL,
    "alpha101_values": catalog_sql(_alphas(False), _VALUES_SQL),
    "features158_bars": catalog_sql(features158(), _VALUES_SQL, STOCK_PANEL_SQL),
    "features158_values": catalog_sql(features158(), _VALUES_SQL),
    "report_library": _FOUR_SQL + ", rep as (select f as factor_id, avg(c) as m, stddev_samp(c) as s from ic group by f) select factor_id, case factor_id when 'move' then 'again' else 'demo' end as market, round(m, 6) as rank_ic, round(m / s, 6) as rank_icir from rep where factor_id <> 'size'",
    "combination_runs": "select * from (values ('two again', 'equal', 'level,move', 0.75::double, 0.2::double, 16::bigint), ('one', 'ols', 'level', 1.0, 0.3, 16)) t(name, method, factors, level, icir, id_length)",
    "factor_lineage": "select * from (values ('b', 'a'), ('a', 'c'), ('d', 'c')) t(part, whole)",
    "factor_similarity": _FOUR_SQL + "select a, b, round(s, 7) as similarity from sim",
    "factor_redundancy": _FOUR_SQL + "select a as factor_id, round(max(abs(s)), 7) as redundancy, arg_max(b, abs(s)) as nearest from two group by a",
    "factor_prune": _FOUR_SQL + ", sc as (select * from (values ('level', 0.3), ('move', 0.2), ('size', -1e308), ('tilt', 0.1)) t(f, s)) select distinct case when x.s < y.s then sim.a when y.s < x.s then sim.b else greatest(sim.a, sim.b) end as factor_id from sim join sc x on x.f = sim.a join sc y on y.f = sim.b where abs(sim.s) >= 0.4",
    "ic_heatmap_month": _HEAT.format(p="strftime(date, '%Y-%m')"),
    "ic_heatmap_quarter": _HEAT.format(p="year(date) || '-Q' || quarter(date)"),
    "ic_heatmap_week": _HEAT.format(p="strftime(date, '%G-W%V')"),
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "alpha101_coverage", "alpha101_tied_values", "features158_coverage", "shared_subexpressions", "factor_map")}
