"""Queries that write delivered files and stores and read them back, over whole tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.curation.units import vendor_of
from barloom.queries.storage import _ADJ, _SNAP, AS_OF, END, ORDER, START
from barloom.runtime import new_path, norm_key, table
from barloom.sources import files as L
from barloom.sources import store as S

#: The first of two deliveries ends here.
FIRST = "2022-01-31"


def _deliveries(spark, d):
    """The bars of price_raw by (date, symbol) as two deliveries knew them."""
    rows = table(spark, d, "price_raw").withColumn("symbol", norm_key(F.col("symbol"))).where("symbol is not null and date is not null")
    parts = (rows.where(F.col("as_of_date") <= F.lit(FIRST).cast("date")), rows.where(F.col("as_of_date") > F.lit(FIRST).cast("date")))
    return [L.latest(p, ["date", "symbol"], ["as_of_date", "row_id"]).drop("row_id") for p in parts]


def ingest_prices_store(spark, d):
    """Both deliveries put into a store one after the other; the later one counts."""
    store = new_path(spark, "prices")
    for rows in _deliveries(spark, d):
        L.ingest_prices(spark, store, rows)
    return spark.read.parquet(store).select("date", "symbol", F.col("close").cast("double").alias("close"), F.col("transactions").cast("double").alias("transactions"), "as_of_date", "market", F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))


def ingest_day_csv(spark, d):
    """The first delivery as compressed CSV day files, a range of which becomes a parquet store and is read as prices."""
    source, out = new_path(spark, "day-csv"), new_path(spark, "day-aggregates")
    first, _ = _deliveries(spark, d)
    start_ns = (F.unix_seconds(F.col("date").cast("timestamp")) + 54_000) * 1_000_000_000
    raw = first.select(F.col("symbol").alias("ticker"), F.col("volume").cast("long").alias("volume"), *[F.col(c).cast("double").alias(c) for c in ("open", "close", "high", "low")], start_ns.alias("window_start"), "transactions", F.col("date").alias("day"))
    raw.repartition("day").write.partitionBy("day").option("header", True).option("compression", "gzip").csv(source)
    L.day_files_to_parquet(spark, source, out, START, END)
    got = L.read_day_aggregates(spark, out)
    return got.select("date", "symbol", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("open", "high", "low", "close", "transactions")], "as_of_date")


def ingest_corporate_actions(spark, d):
    """Corporate actions as JSON lines, some of them broken, read back for a range of days as events."""
    e = table(spark, d, "adj_events").where("event_id is not null and ex_date is not null and symbol is not null")
    e = L.latest(e, ["event_id"], ["as_of_date", "split_ratio", "dividend_cash", "symbol", "ex_date", "source"])
    day = F.col("ex_date").cast("string")
    is_split = F.lower("source").endswith("splits")
    splits = e.where(is_split).select(F.to_json(F.struct(F.col("event_id").alias("id"), day.alias("execution_date"), F.lit(1.0).alias("split_from"), F.col("split_ratio").alias("split_to"), F.col("symbol").alias("ticker"))).alias("value"))
    dividends = e.where(~is_split).select(F.to_json(F.struct(F.col("event_id").alias("id"), day.alias("ex_dividend_date"), F.col("dividend_cash").alias("cash_amount"), F.col("symbol").alias("ticker"), F.col("as_of_date").cast("string").alias("declaration_date"))).alias("value"))
    paths = [new_path(spark, "splits"), new_path(spark, "dividends")]
    broken = spark.createDataFrame([("",), ("{broken",), ("  ",)], "value string")
    for rows, path in zip((splits, dividends), paths):
        rows.unionByName(broken).write.text(path)
    a = L.split_events(L.read_jsonl(spark, paths[0], L.SPLITS, day="execution_date", start=START, end=END))
    b = L.dividend_events(L.read_jsonl(spark, paths[1], L.DIVIDENDS, day="ex_dividend_date", start=START, end=END))
    return a.unionByName(b).select("event_id", "symbol", "ex_date", "as_of_date", "event_type", F.round("split_ratio", 6).alias("split_ratio"), F.round("dividend_cash", 6).alias("dividend_cash"))


def ingest_universe_store(spark, d):
    """The deliveries of compositions in a store; members by index, effective date and day of knowledge."""
    store = new_path(spark, "universe")
    snaps = L.latest(table(spark, d, "universe_snapshots").where("symbols is not null and as_of_date is not null").withColumn("index_id", norm_key(F.col("index_id"))), ["index_id", "effective_date", "as_of_date"], ["snapshot_id"])
    L.ingest_universe(spark, store, snaps)
    return spark.read.parquet(store).select("index_id", "effective_date", "as_of_date", F.explode(S.clean_members(F.col("symbols"))).alias("symbol"))


def universe_from_deltas(spark, d):
    """Compositions rebuilt from what joined and left."""
    c = S.membership_changes(table(spark, d, "universe_snapshots"), AS_OF)
    delta = lambda col, op, seq: c.select("index_id", "effective_date", F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.col(col).alias("symbols"))
    out = S.apply_deltas(delta("left", "difference", 0).unionByName(delta("joined", "union", 1)))
    return out.select("index_id", "effective_date", F.explode("symbols").alias("symbol"))


def universe_changes_around(spark, d):
    return S.changes_around(table(spark, d, "universe_snapshots"), "2021-12-31", AS_OF)


def trade_status_asof(spark, d):
    """Limits around the closes of price_raw, as known in the middle of the corrections."""
    rows = table(spark, d, "price_raw").where("close > 0 and symbol is not null and date is not null and as_of_date is not null")
    bars = rows.groupBy("date", norm_key(F.col("symbol")).alias("symbol"), "as_of_date").agg(F.max(F.col("close").cast("double")).alias("close"))
    status = bars.select("date", "symbol", (F.col("close") * 1.1).alias("up_limit"), (F.col("close") * 0.9).alias("down_limit"), "close", "as_of_date")
    return S.status_as_of(status, START, END, AS_OF).select("date", "symbol", F.round("up_limit", 5).alias("up_limit"), F.round("down_limit", 5).alias("down_limit"), "as_of_date")


def groups_asof(spark, d):
    """Symbols labelled with the vendor that last delivered them."""
    rows = table(spark, d, "price_raw").where("as_of_date is not null").groupBy(norm_key(F.col("symbol")).alias("symbol"), "as_of_date").agg(F.max(vendor_of(F.col("source_id"))).alias("group"))
    return S.groups_as_of(rows, AS_OF)


def adjustment_series(spark, d):
    """Split events from the providers' cumulated factors."""
    f = table(spark, d, "adj_events").select("symbol", F.col("ex_date").alias("date"), F.col("provider_adj_factor").alias("factor"))
    return L.adjustment_events(f).select("symbol", "ex_date", F.round("split_ratio", 6).alias("split_ratio"), "event_id")


def bars_weekly_adjusted(spark, d):
    """Adjusted weekly bars of all members of an index at the end of the period."""
    members = S.universe(table(spark, d, "universe_snapshots"), END, AS_OF).select("symbol").distinct()
    got = S.get_bars(table(spark, d, "price_raw"), table(spark, d, "adj_events"), members, START, END, AS_OF, "1w", order=ORDER)
    return got.select("symbol", "date", *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")])


_ROWS = "select upper(trim(symbol)) as symbol, date, open, high, low, close, volume, transactions, as_of_date, row_id from price_raw where symbol is not null and date is not null"
_MEMBERS = f"with {_SNAP.format(as_of=AS_OF)}, c as (select *, lag(symbols) over (partition by index_id order by effective_date) as b from sn)"
ORACLES = {
    "ingest_prices_store": f"""select date, symbol, close::double as close, transactions::double as transactions, as_of_date, 'US' as market, year(date)::int as year, month(date)::int as month
from (select *, row_number() over (partition by date, symbol order by as_of_date > date '{FIRST}' desc, as_of_date desc, row_id desc) as rn from ({_ROWS} and as_of_date is not null)) where rn = 1""",
    "ingest_day_csv": f"""select date, symbol, round(open::double, 4) as open, round(high::double, 4) as high, round(low::double, 4) as low, round(close::double, 4) as close, transactions::double as transactions, date as as_of_date
from (select *, row_number() over (partition by date, symbol order by as_of_date desc, row_id desc) as rn from ({_ROWS} and as_of_date <= date '{FIRST}')) where rn = 1 and date between date '{START}' and date '{END}'""",
    "ingest_corporate_actions": f"""with e as (select *, lower(source) like '%splits' as s from (select *, row_number() over (partition by event_id order by as_of_date desc nulls last, split_ratio desc nulls last, dividend_cash desc nulls last, symbol desc, ex_date desc, source desc) as rn from adj_events where event_id is not null and ex_date is not null and symbol is not null) where rn = 1)
select event_id, upper(trim(symbol)) as symbol, ex_date, case when s then ex_date else coalesce(as_of_date, ex_date) end as as_of_date, case when s then 'split' else 'dividend' end as event_type, round(case when s then split_ratio else 1 end, 6) as split_ratio, round(case when s then 0 else dividend_cash end, 6) as dividend_cash
from e where ex_date between date '{START}' and date '{END}'""",
    "ingest_universe_store": """with s as (select *, row_number() over (partition by upper(trim(index_id)), effective_date, as_of_date order by snapshot_id desc) as rn from universe_snapshots where symbols is not null and as_of_date is not null)
select distinct upper(trim(index_id)) as index_id, effective_date, as_of_date, symbol from (select index_id, effective_date, as_of_date, upper(trim(unnest(symbols))) as symbol from s where rn = 1) where symbol <> ''""",
    "universe_from_deltas": _MEMBERS + " select index_id, effective_date, unnest(symbols) as symbol from c where b is null or b <> symbols",
    "universe_changes_around": _MEMBERS + """, ch as (select index_id, effective_date, unnest(list_filter(symbols, lambda s: b is null or not list_contains(b, s))) as symbol, 'joined' as change from c where b is null or b <> symbols
  union all select index_id, effective_date, unnest(list_filter(b, lambda s: not list_contains(symbols, s))), 'left' from c where b <> symbols)
select index_id, effective_date, case when effective_date > date '2021-12-31' then 'since' else 'before' end as side, symbol, change from ch""",
    "trade_status_asof": f"""select date, symbol, round(c * 1.1, 5) as up_limit, round(c * 0.9, 5) as down_limit, as_of_date from (
  select date, symbol, as_of_date, max(close::double) as c, row_number() over (partition by date, symbol order by as_of_date desc) as rn from ({_ROWS}) where close > 0 and date between date '{START}' and date '{END}' and as_of_date <= date '{AS_OF}' group by date, symbol, as_of_date) where rn = 1""",
    "groups_asof": f"""select symbol, g as "group" from (select symbol, g, row_number() over (partition by symbol order by as_of_date desc) as rn from (
  select upper(trim(symbol)) as symbol, as_of_date, max(lower(trim(regexp_extract(source_id, '^([^/:]*)', 1)))) as g from price_raw where as_of_date <= date '{AS_OF}' group by all)) where rn = 1""",
    "adjustment_series": """with f as (select upper(trim(symbol)) as symbol, ex_date as date, max(provider_adj_factor) as f from adj_events where provider_adj_factor > 0 and ex_date is not null and symbol is not null group by all),
g as (select *, lag(f) over (partition by symbol order by date) as b from f) select symbol, date as ex_date, round(f / b, 6) as split_ratio, 'factor|' || symbol || '|' || date as event_id from g where abs(f / b - 1) > 1e-9""",
    "bars_weekly_adjusted": _ADJ + ", " + _SNAP.format(as_of=AS_OF) + f""", u as (select distinct unnest(x) as symbol from (select arg_max(symbols, effective_date) as x from sn where effective_date <= date '{END}' group by index_id)),
v as (select b.symbol, b.date, b.open::double / a.r as open, b.high::double / a.r as high, b.low::double / a.r as low, b.close::double / a.r as close from bars b join adj a using (symbol, date) join u using (symbol) where b.date >= date '{START}')
select symbol, max(date) as date, round(arg_min_null(open, date), 4) as open, round(max(high), 4) as high, round(min(low), 4) as low, round(arg_max_null(close, date), 4) as close from v group by symbol, date_trunc('week', date)""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
