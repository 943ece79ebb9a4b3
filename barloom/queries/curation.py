"""Queries of the general curation operators over the driver's tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.curation.asof import asof_attributes
from barloom.curation.compaction import consolidate_day_files
from barloom.curation.regular_grid import regular_grid
from barloom.curation.snapshots import OPEN_END, attribute_history, composition_dates, compositions, snapshot_changes, table_changes, ymd
from barloom.curation.spikes import flag_implausible
from barloom.curation.units import dividend_residuals, dividend_units, vendor_of, volume_units
from barloom.runtime import broadcast_if_small, norm_key, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    prices, events, notes = (table(spark, d, t) for t in ("price_raw", "adj_events", "source_notes"))
    units = volume_units(prices, notes)
    rows = prices.where("volume is not null and date is not null").select("row_id", vendor_of(F.col("source_id")).alias("vendor"), F.col("date").alias("day"))
    volumes = rows.join(broadcast_if_small(units.where("power <> 0")), ["vendor", "day"]).select(F.lit("price_raw").alias("src_table"), F.col("row_id").cast("string").alias("row_key"), "power")
    cash = dividend_units(events, prices, notes).where("power <> 0").select(F.lit("adj_events").alias("src_table"), F.col("event_id").alias("row_key"), "power")
    return volumes.unionByName(cash).select("src_table", "row_key", F.round(F.pow(F.lit(10.0), F.col("power") + 6)).cast("bigint").alias("factor_e6"))


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit of every vendor and date and of every dividend, how far the identity is from it, and whether another unit would fit as well."""
    prices, events, notes = (table(spark, d, t) for t in ("price_raw", "adj_events", "source_notes"))
    volumes = volume_units(prices, notes).select(F.lit("price_raw").alias("src_table"), F.concat_ws(" ", "vendor", F.col("day").cast("string")).alias("unit_key"), "power", F.round("residual", 6).alias("residual"), "unique_fit")
    cash = dividend_units(events, prices, notes).select(F.lit("adj_events").alias("src_table"), F.col("event_id").alias("unit_key"), "power", F.round("residual", 6).alias("residual"), "unique_fit")
    return volumes.unionByName(cash)


def p1_dividend_residuals(spark: SparkSession, d: str) -> DataFrame:
    """What the identity of dividends leaves for the unit to explain, in powers of ten."""
    found = dividend_residuals(table(spark, d, "adj_events"), table(spark, d, "price_raw"))
    return found.where("residual is not null").select("event_id", "vendor", F.round("residual", 6).alias("residual"))


P1_RESIDUALS_SQL = r"""
with words as (
  select *, lower(split_part(trim(source), ':', 1)) as vendor, regexp_replace(lower(dividend_text), '(?:\bper|/|\beach|\bevery|\bholding of)\s*(\d+|ten|hundred|one hundred|thousand)\b([^.]|$)', ' ') as rest
  from adj_events where lower(source) like '%dividend%' and event_id is not null),
amounts as (
  select *, coalesce(case when isnan(dividend_cash) then null else dividend_cash end, try_cast(replace(regexp_extract(rest, '(\d+(?:[.,]\d+)?)', 1), ',', '.') as double)) as amount from words),
one as (
  select event_id, vendor, upper(trim(symbol)) as symbol, ex_date, amount, provider_adj_factor as f
  from (select *, row_number() over (partition by event_id order by coalesce(as_of_date, date '0001-01-01') desc, amount desc) as rn from amounts where amount is not null) where rn = 1),
prev as (
  select o.event_id, median(p.close::double) as close
  from one o join price_raw p on upper(trim(p.symbol)) = o.symbol and p.date between o.ex_date - 10 and o.ex_date - 1
  where p.close > 0 and o.f > 0 and o.f < 1 and o.amount > 0 group by all)
select event_id, vendor, round(log10(amount / ((1 - f) * prev.close)), 6) as residual from one join prev using (event_id)
"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    panel, specs, snaps, events = (table(spark, d, t) for t in ("session_panel", "session_specs", "universe_snapshots", "adj_events"))
    index_of = specs.select("session_id", norm_key(F.col("index_id")).alias("_index")).where("session_id is not null").dropDuplicates(["session_id"])
    keyed = panel.select("panel_id", "date", "session_id", norm_key(F.col("symbol")).alias("_symbol")).join(broadcast_if_small(index_of), "session_id", "left")
    # Both lookups go through one pass: the entity says which it is.
    asks = keyed.select("panel_id", "date", F.explode(F.array(F.concat(F.lit("i"), F.col("_index")), F.concat(F.lit("s"), F.col("_symbol")))).alias("entity"))
    versions = (
        snaps.where("symbols is not null")
        .select(F.concat(F.lit("i"), norm_key(F.col("index_id"))).alias("entity"), F.col("effective_date").alias("valid_from"), F.col("as_of_date").alias("known_from"), F.col("snapshot_id").alias("ref_id"))
        .unionByName(
            events.where("split_ratio is not null and not isnan(split_ratio) and split_ratio <> 1").select(F.concat(F.lit("s"), norm_key(F.col("symbol"))).alias("entity"), F.col("ex_date").alias("valid_from"), F.col("as_of_date").alias("known_from"), F.col("event_id").alias("ref_id"))
        )
    )
    out = asof_attributes(asks, versions, event_id="panel_id")
    return out.select(F.col("event_id").alias("panel_id"), "ref_id", ymd(F.col("known_from")).alias("known_ymd"))


P2_SQL = """
with idx as (
  select p.panel_id, v.snapshot_id as ref_id, v.as_of_date as kf,
         row_number() over (partition by p.panel_id order by v.effective_date desc, v.as_of_date desc, v.snapshot_id) as rn
  from session_panel p join session_specs s using (session_id)
  join universe_snapshots v on upper(trim(v.index_id)) = upper(trim(s.index_id)) and v.effective_date <= p.date and v.as_of_date <= p.date
  where v.symbols is not null),
spl as (
  select p.panel_id, e.event_id as ref_id, e.as_of_date as kf,
         row_number() over (partition by p.panel_id order by e.ex_date desc, e.as_of_date desc, e.event_id) as rn
  from session_panel p join adj_events e on upper(trim(e.symbol)) = upper(trim(p.symbol)) and e.ex_date <= p.date and e.as_of_date <= p.date
  where e.split_ratio is not null and e.split_ratio <> 1)
select panel_id, ref_id, (year(kf) * 10000 + month(kf) * 100 + day(kf))::bigint as known_ymd
from (select * from idx where rn = 1 union all select * from spl where rn = 1)
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    grid = regular_grid(table(spark, d, "session_panel"), table(spark, d, "session_specs"))
    return grid.where("n_obs = 0").select("session_id", "symbol", F.date_format("slot_start", "yyyy-MM-dd HH:mm").alias("slot_start"))


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = regular_grid(table(spark, d, "session_panel"), table(spark, d, "session_specs"))
    return grid.select("session_id", "symbol", "slot", "n_obs", F.round("filled", 6).alias("filled"), "status")


_P3_SQL = """
with spec as (
  select *, ((close_minute - open_minute + step_minutes - 1) // step_minutes)::int as per_day from session_specs),
read as (
  select session_id, upper(trim(symbol)) as symbol, read_at, close, panel_id from session_panel),
series as (select distinct session_id, symbol from read),
days as (select session_id, unnest(generate_series(start_date::timestamp, end_date::timestamp, interval 1 day))::date as d from spec),
grid as (
  select s.session_id, s.symbol, k.k, d.d, p.open_minute + k.k * p.step_minutes as m,
         (date_diff('day', p.start_date, d.d) * p.per_day + k.k)::int as slot
  from series s join spec p using (session_id) join days d using (session_id)
  join (select unnest(range(0, 1440))::int as k) k on k.k < p.per_day where isodow(d.d) <= 5),
obs as (
  select r.session_id, r.symbol, (date_diff('day', p.start_date, r.read_at::date) * p.per_day + (hour(r.read_at) * 60 + minute(r.read_at) - p.open_minute) // p.step_minutes)::int as slot,
         count(*)::bigint as n_obs, arg_max(r.close, row(r.read_at, r.panel_id)) as px
  from read r join spec p using (session_id)
  where r.close is not null and isodow(r.read_at) <= 5 and r.read_at::date between p.start_date and p.end_date
    and hour(r.read_at) * 60 + minute(r.read_at) >= p.open_minute and hour(r.read_at) * 60 + minute(r.read_at) < p.close_minute
  group by all)
"""
P3_SQL = _P3_SQL + "select g.session_id, g.symbol, strftime(g.d::timestamp + to_minutes(g.m), '%Y-%m-%d %H:%M') as slot_start from grid g left join obs o using (session_id, symbol, slot) where o.n_obs is null"
P3_GRID_SQL = (
    _P3_SQL
    + """select session_id, symbol, slot, coalesce(n_obs, 0)::bigint as n_obs, round(filled, 6) as filled,
  case when n_obs is not null then 'observed' when filled is not null then 'filled' else 'missing' end as status
from (select g.session_id, g.symbol, g.slot, o.n_obs, last_value(o.px ignore nulls) over (partition by g.session_id, g.symbol order by g.slot rows between 3 preceding and current row) as filled
  from grid g left join obs o using (session_id, symbol, slot))"""
)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "universe_snapshots")
    changes = snapshot_changes(compositions(snaps), composition_dates(snaps))
    return changes.select("index_id", ymd(F.col("effective_date")).alias("effective_ymd"), "symbol", "change_kind")


_COMP_SQL = """
with ok as (
  select upper(trim(index_id)) as index_id, effective_date, symbols, weights,
         row_number() over (partition by upper(trim(index_id)), effective_date order by as_of_date desc, snapshot_id desc) as rn
  from universe_snapshots where symbols is not null and as_of_date is not null),
comp as (
  select *, row_number() over (partition by index_id order by effective_date) as ord, count(*) over (partition by index_id) as n from ok where rn = 1),
dates as (select index_id, ord, n, year(effective_date) * 10000 + month(effective_date) * 100 + day(effective_date) as ymd from comp),
flat as (select index_id, ord, unnest(symbols) as s, unnest(weights) as w from comp),
mem as (select index_id, ord, upper(trim(s)) as symbol, max(case when isnan(w) then null else w end) as w from flat where trim(s) <> '' group by all)
"""
P4_SQL = (
    _COMP_SQL
    + """select coalesce(a.index_id, b.index_id) as index_id, d.ymd::bigint as effective_ymd, coalesce(a.symbol, b.symbol) as symbol,
  case when b.symbol is null then 'added' when a.symbol is null then 'removed' else 'changed' end as change_kind
from mem a full join (select index_id, ord + 1 as ord, symbol, w from mem) b on a.index_id = b.index_id and a.ord = b.ord and a.symbol = b.symbol
join dates d on d.index_id = coalesce(a.index_id, b.index_id) and d.ord = coalesce(a.ord, b.ord)
where d.ord > 1 and (a.symbol is null or b.symbol is null or (a.w is null) <> (b.w is null) or abs(a.w - b.w) > 0.000001)"""
)


#: Two full states of the bars: as known by these days.
KNOWN = ("2022-01-31", "2022-06-30")


def p4_bar_corrections(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the raw bars, a row per (date, symbol, vendor), between two full states of the table: every column but the keys counts."""
    bars = table(spark, d, "price_raw").select(F.col("date"), norm_key(F.col("symbol")).alias("symbol"), vendor_of(F.col("source_id")).alias("vendor"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], "transactions", "as_of_date")
    old, new = (bars.where(F.col("as_of_date") <= F.lit(k).cast("date")).drop("as_of_date") for k in KNOWN)
    return table_changes(old, new, ["date", "symbol", "vendor"])


P4_CORRECTIONS_SQL = f"""
with bars as (
  select date, upper(trim(symbol)) as symbol, lower(trim(regexp_extract(source_id, '^([^/:]*)', 1))) as vendor,
    concat_ws('|', coalesce(open::text, '-'), coalesce(high::text, '-'), coalesce(low::text, '-'), coalesce(close::text, '-'), coalesce(volume::text, '-'), coalesce(transactions::text, '-')) as r, as_of_date from price_raw),
sides as (
  select date, symbol, vendor, r, 1 as old, 0 as new from bars where as_of_date <= date '{KNOWN[0]}'
  union all select date, symbol, vendor, r, 0, 1 from bars where as_of_date <= date '{KNOWN[1]}'),
rows_ as (select date, symbol, vendor, r, sum(old) as o, sum(new) as n from sides group by all)
select date, symbol, vendor, case when sum(o) = 0 then 'added' when sum(n) = 0 then 'removed' else 'changed' end as change_kind, sum(o)::bigint as n_old, sum(n)::bigint as n_new
from rows_ group by all having max(case when o <> n then 1 else 0 end) = 1
"""


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "universe_snapshots")
    runs = attribute_history(compositions(snaps), composition_dates(snaps))
    return runs.select("index_id", "symbol", ymd(F.col("valid_from")).alias("valid_from_ymd"), F.coalesce(ymd(F.col("valid_to")), F.lit(OPEN_END).cast("bigint")).alias("valid_to_ymd"))


P5_SQL = (
    _COMP_SQL
    + """, steps as (
  select *, case when ord - 1 = lag(ord) over q and ((w is null and lag(w) over q is null) or abs(w - lag(w) over q) <= 0.000001) then 0 else 1 end as fresh
  from mem window q as (partition by index_id, symbol order by ord)),
runs as (select *, sum(fresh) over (partition by index_id, symbol order by ord) as run from steps),
ends as (select index_id, symbol, run, min(ord) as a, max(ord) + 1 as b from runs group by all)
select e.index_id, e.symbol, f.ymd::bigint as valid_from_ymd, coalesce(t.ymd, 99991231)::bigint as valid_to_ymd
from ends e join dates f on f.index_id = e.index_id and f.ord = e.a left join dates t on t.index_id = e.index_id and t.ord = e.b"""
)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate_day_files(table(spark, d, "bar_files")).select("file_id", "line_no")


P6_SQL = r"""
with lines as (
  select file_id, generate_subscripts(l, 1) as line_no, unnest(l) as line, lower(l[1]) as head
  from (select file_id, string_split_regex(payload, '\r\n|\n|\r') as l from bar_files where payload is not null and payload <> '')),
cut as (
  select file_id, line_no, list_transform(string_split_regex(line, '[,;]'), lambda x: trim(x)) as v, list_transform(string_split_regex(head, '[,;]'), lambda x: trim(x)) as h
  from lines where line_no > 1 and trim(line) <> ''),
rec as (
  select file_id, line_no, upper(v[list_position(h, 'ticker')]) as a, try_cast(v[list_position(h, 'window_start')] as decimal(30, 6)) as b,
    try_cast(v[list_position(h, 'open')] as double) as c, try_cast(v[list_position(h, 'high')] as double) as d, try_cast(v[list_position(h, 'low')] as double) as e,
    try_cast(v[list_position(h, 'close')] as double) as f, try_cast(v[list_position(h, 'volume')] as double) as g, try_cast(v[list_position(h, 'transactions')] as double) as i
  from cut where len(v) = 8)
select file_id, line_no::bigint as line_no
from (select *, row_number() over (partition by a, b, c, d, e, f, g, i order by file_id, line_no) as rn from rec
  where a <> '' and b is not null and c is not null and d is not null and e is not null and f is not null and g is not null and i is not null)
where rn = 1
"""


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    prices = table(spark, d, "price_raw")
    return flag_implausible(prices, volume_units(prices, table(spark, d, "source_notes"))).select("row_id", "field_name").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_units, p1_dividend_residuals, p2_found, p3_found, p3_grid, p4_found, p4_bar_corrections, p5_found, p6_found, p7_found)}
ORACLES = {"p1_dividend_residuals": P1_RESIDUALS_SQL, "p4_bar_corrections": P4_CORRECTIONS_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL, "p3_grid": P3_GRID_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
