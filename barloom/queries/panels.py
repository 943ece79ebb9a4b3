"""The panel that the factor queries run over, and its SQL twin: weeks of shipping by the supplier's nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.runtime import table

FIELDS = ("open", "high", "low", "close", "volume", "vwap", "market_cap")


def nation_weeks(spark: SparkSession, d: str) -> DataFrame:
    """(date, symbol, open, high, low, close, volume, vwap, market_cap) from all line items: unit prices by week and nation."""
    items, suppliers, nations = (table(spark, d, t) for t in ("lineitem", "supplier", "nation"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    by_supplier = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("symbol"))
    rows = items.where("l_quantity > 0 and l_shipdate is not null").join(by_supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), "symbol").agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum("l_quantity").alias("volume"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("vwap"), F.round(F.sum("l_extendedprice"), 2).alias("market_cap")
    )


def nation_groups(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, sector, industry, subindustry): region, and two coarser cuts of the nations' keys."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.concat(F.lit("I"), F.col("n_nationkey") % 4).alias("industry"), F.concat(F.lit("J"), F.col("n_nationkey") % 6).alias("subindustry")
    )


PANEL_SQL = """
raw as (
  select date_trunc('week', l_shipdate)::date as date, n_name as symbol, l_extendedprice / l_quantity as price, l_quantity as q, l_extendedprice as e,
         row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as o
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_quantity > 0 and l_shipdate is not null),
bars as (
  select date, symbol, arg_min(price, o) as open, max(price) as high, min(price) as low, arg_max(price, o) as close, sum(q) as volume, sum(e) / sum(q) as vwap, round(sum(e), 2) as market_cap
  from raw group by all),
grps as (select n_name as symbol, r_name as sector, 'I' || (n_nationkey % 4) as industry, 'J' || (n_nationkey % 6) as subindustry from nation join region on n_regionkey = r_regionkey),
p as (
  select d.date, s.symbol, d.bar_no, b.* exclude (date, symbol), g.sector, g.industry, g.subindustry
  from (select date, row_number() over (order by date) - 1 as bar_no from (select distinct date from bars)) d cross join (select distinct symbol from bars) s
  left join bars b using (date, symbol) join grps g using (symbol))
"""
