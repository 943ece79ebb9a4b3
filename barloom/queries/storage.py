"""Queries of the point-in-time store over price_raw, adj_events and universe_snapshots, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.runtime import table
from barloom.sources import store as S

AS_OF, START, END = "2022-06-30", "2021-05-03", "2022-05-31"
ORDER = ("as_of_date", "row_id")
ALL_DAYS = "1000-01-01", "9999-12-31"


def _bars(spark, d):
    return S.prices_as_of(table(spark, d, "price_raw"), START, END, AS_OF, order=ORDER)


def _r(*cs, n=5):
    return [F.round(c, n).alias(c) for c in cs]


def pit_prices(spark, d):
    return _bars(spark, d).select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in ("open", "close")], "as_of_date")


def pit_panel_split(spark, d):
    p = S.read_panel(table(spark, d, "price_raw"), table(spark, d, "adj_events"), ["open", "close", "volume"], START, END, AS_OF, "split", order=ORDER)
    return p.select("symbol", "date", *_r("open", "close"), F.round(F.log10(F.when(F.col("volume") > 0, F.col("volume"))), 6).alias("log_volume"))


def pit_panel_total(spark, d):
    p = S.read_panel(table(spark, d, "price_raw"), table(spark, d, "adj_events"), ["high", "close"], START, END, AS_OF, "total", order=ORDER)
    return p.select("symbol", "date", *_r("high", "close"))


def universe_asof(spark, d):
    return S.universe(table(spark, d, "universe_snapshots"), "2021-12-31", "2022-01-15")


def _universe_panel(spark, d, membership):
    tables = (table(spark, d, t) for t in ("price_raw", "adj_events", "universe_snapshots"))
    snaps = table(spark, d, "universe_snapshots")
    index = snaps.agg(F.min(F.upper(F.trim("index_id")))).first()[0]
    return S.universe_panel(*tables, index, ["close"], START, END, AS_OF, membership=membership, order=ORDER).select("symbol", "date", *_r("close"))


def universe_panel_end(spark, d):
    return _universe_panel(spark, d, "end")


def universe_panel_daily(spark, d):
    return _universe_panel(spark, d, "daily")


def _universe_panels(spark, d, membership):
    tables = (table(spark, d, t) for t in ("price_raw", "adj_events", "universe_snapshots"))
    return S.universe_panels(*tables, ["close"], START, END, AS_OF, membership=membership, order=ORDER).select("index_id", "symbol", "date", *_r("close"))


def universe_panels_end(spark, d):
    """The panels of all indices; universe_panel_end is that of the first one."""
    return _universe_panels(spark, d, "end")


def universe_panels_daily(spark, d):
    return _universe_panels(spark, d, "daily")


def universe_union(spark, d):
    return S.union_over_range(table(spark, d, "universe_snapshots"), "2021-09-01", "2022-03-31", AS_OF)


def universe_changes(spark, d):
    c = S.membership_changes(table(spark, d, "universe_snapshots"), AS_OF)
    return c.select("index_id", "effective_date", F.size("symbols").alias("n_members"), F.array_join(F.array_sort("joined"), ",").alias("joined"), F.array_join(F.array_sort("left"), ",").alias("gone"))


def resample_weekly(spark, d):
    return S.resample(_bars(spark, d), "1w").select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])


def resample_monthly(spark, d):
    return S.resample(_bars(spark, d), "1mo").select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])


def _resampled_whole(spark, d, frequency):
    bars = S.prices_as_of(table(spark, d, "price_raw"), *ALL_DAYS, AS_OF, order=ORDER)
    return S.resample(bars, frequency).select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])


def resample_weekly_whole(spark, d):
    """All bars known by AS_OF; resample_weekly reads a window of days."""
    return _resampled_whole(spark, d, "1w")


def resample_monthly_whole(spark, d):
    return _resampled_whole(spark, d, "1mo")


def data_calendar(spark, d):
    return S.data_calendar(table(spark, d, "price_raw")).select("date", "n_symbols", *_r("coverage", n=8))


def store_status(spark, d):
    return S.store_status(table(spark, d, "price_raw"))


_BARS = f"""bars as (
  select * exclude (rn) from (
    select upper(trim(symbol)) as symbol, date, open, high, low, close, volume, as_of_date, row_number() over (partition by upper(trim(symbol)), date order by as_of_date desc, row_id desc) as rn
    from price_raw where date between date '{START}' - {S.GAP_DAYS} and date '{END}' and as_of_date <= date '{AS_OF}') where rn = 1)"""
_EVENTS = f"""ev as (
  select * exclude (rn) from (
    select upper(trim(symbol)) as symbol, ex_date, split_ratio, dividend_cash, row_number() over (partition by event_id order by as_of_date desc, ex_date desc, split_ratio desc nulls last, dividend_cash desc nulls last) as rn
    from adj_events where ex_date <= date '{END}' and as_of_date <= date '{AS_OF}') where rn = 1)"""
_ADJ = f"""with {_BARS}, {_EVENTS},
pr as (select e.*, b.date as d, b.close as c from ev e asof left join bars b on b.symbol = e.symbol and b.date < e.ex_date),
fac as (select symbol, ex_date, case when split_ratio > 0 then split_ratio else 1 end as r,
  case when dividend_cash > 0 and c > 0 and ex_date - d <= {S.GAP_DAYS} and 1 - dividend_cash / c > 0 then 1 - dividend_cash / c else 1 end as k from pr),
adj as (select b.symbol, b.date, any_value(b.open::double) as open, any_value(b.high::double) as high, any_value(b.close::double) as close, any_value(b.volume::double) as volume,
  coalesce(product(f.r), 1) as r, coalesce(product(f.k), 1) as k from bars b left join fac f on f.symbol = b.symbol and f.ex_date > b.date group by b.symbol, b.date)
"""
_SNAP = f"""sn as (
  select index_id, effective_date, list_sort(list_distinct(list_filter(list_transform(symbols, lambda s: upper(trim(s))), lambda s: s <> ''))) as symbols from (
    select upper(trim(index_id)) as index_id, effective_date, symbols, row_number() over (partition by upper(trim(index_id)), effective_date order by as_of_date desc, snapshot_id desc) as rn
    from universe_snapshots where symbols is not null and as_of_date <= date '{{as_of}}') where rn = 1)"""
_RESAMPLE = "with " + _BARS.replace(f" - {S.GAP_DAYS}", "") + " select symbol, max(date) as date, arg_min_null(open, date)::double as open, max(high)::double as high, min(low)::double as low, arg_max_null(close, date)::double as close from bars group by symbol, date_trunc('{u}', date)"
_RESAMPLE_WHOLE = _RESAMPLE.replace(f"date between date '{START}' and date '{END}' and ", "")
ORACLES = {
    "pit_prices": "with " + _BARS.replace(f" - {S.GAP_DAYS}", "") + " select symbol, date, open::double as open, close::double as close, as_of_date from bars",
    "pit_panel_split": _ADJ + f"select symbol, date, round(open / r, 5) as open, round(close / r, 5) as close, case when volume > 0 then round(log10(volume * r), 6) end as log_volume from adj where date >= date '{START}'",
    "pit_panel_total": _ADJ + f"select symbol, date, round(high * (k / r), 5) as high, round(close * (k / r), 5) as close from adj where date >= date '{START}'",
    "universe_asof": "with " + _SNAP.format(as_of="2022-01-15") + " select index_id, unnest(arg_max(symbols, effective_date)) as symbol from sn where effective_date <= date '2021-12-31' group by index_id",
    "universe_panel_end": _ADJ + ", " + _SNAP.format(as_of=AS_OF) + f", u as (select unnest(arg_max(symbols, effective_date)) as symbol from sn where index_id = (select min(index_id) from sn) and effective_date <= date '{END}') select symbol, date, round(close / r, 5) as close from adj where date >= date '{START}' and symbol in (select symbol from u)",
    "universe_panel_daily": _ADJ + ", " + _SNAP.format(as_of=AS_OF) + f", u as (select unnest(symbols) as symbol, effective_date as a, lead(effective_date) over (order by effective_date) as b from sn where index_id = (select min(index_id) from sn)) select adj.symbol, date, round(close / r, 5) as close from adj join u on u.symbol = adj.symbol and date >= a and (b is null or date < b) where date >= date '{START}'",
    "universe_panels_end": _ADJ + ", " + _SNAP.format(as_of=AS_OF) + f", u as (select index_id, unnest(arg_max(symbols, effective_date)) as symbol from sn where effective_date <= date '{END}' group by index_id) select index_id, symbol, date, round(close / r, 5) as close from adj join u using (symbol) where date >= date '{START}'",
    "universe_panels_daily": _ADJ + ", " + _SNAP.format(as_of=AS_OF) + f", u as (select index_id, unnest(symbols) as symbol, effective_date as a, lead(effective_date) over (partition by index_id order by effective_date) as b from sn) select index_id, adj.symbol, date, round(close / r, 5) as close from adj join u on u.symbol = adj.symbol and date >= a and (b is null or date < b) where date >= date '{START}'",
    "universe_union": "with " + _SNAP.format(as_of=AS_OF) + ", u as (select *, lead(effective_date) over (partition by index_id order by effective_date) as until from sn) select distinct index_id, unnest(symbols) as symbol from u where effective_date <= date '2022-03-31' and (until is null or until > date '2021-09-01')",
    "universe_changes": "with " + _SNAP.format(as_of=AS_OF) + """, c as (select *, lag(symbols) over (partition by index_id order by effective_date) as b from sn)
select index_id, effective_date, len(symbols)::int as n_members, coalesce(array_to_string(list_sort(list_filter(symbols, lambda s: b is null or not list_contains(b, s))), ','), '') as joined,
  coalesce(array_to_string(list_sort(list_filter(b, lambda s: not list_contains(symbols, s))), ','), '') as gone from c where b is null or b <> symbols""",
    "resample_weekly": _RESAMPLE.format(u="week"),
    "resample_monthly": _RESAMPLE.format(u="month"),
    "resample_weekly_whole": _RESAMPLE_WHOLE.format(u="week"),
    "resample_monthly_whole": _RESAMPLE_WHOLE.format(u="month"),
    "data_calendar": "select date, n as n_symbols, round(n / max(n) over (), 8) as coverage from (select date, count(distinct upper(trim(symbol))) as n from price_raw group by date)",
    "store_status": "select count(*) as n_rows, count(distinct upper(trim(symbol))) as n_symbols, count(distinct date) as n_days, min(date) as first_date, max(date) as last_date, max(as_of_date) as last_known from price_raw",
}
QUERIES = {n: globals()[n] for n in ORACLES}
