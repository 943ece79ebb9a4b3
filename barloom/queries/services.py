"""Queries through the session and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.library.analysis import factor_id
from barloom.queries.panels import nation_groups, nation_weeks
from barloom.queries.portfolios import _NAV
from barloom.runtime import new_path, table
from barloom.sdk import Session
from barloom.sources.files import is_folder
from barloom.streaming.bars import drain_to_store, stream_of, windowed_bars

SPECS = ["rank(ts_mean(close, 5))", "alpha101:101", "features158:ROC5", "alpha101:12", {"name": "neutral", "expr": "indneutralize(close / delay(close, 1), sector)"}]


def session_backtest(spark, d):
    s = Session(nation_weeks(spark, d), nation_groups(spark, d), horizons=(1, 5))
    r = s.backtest(SPECS)
    return r.select("name", *[F.round(c, 6).alias(c) for c in ("ic", "icir", "rank_ic", "rank_icir", "half_life", "long_short", "turnover", "coverage")], "n_dates", F.concat_ws(",", "codes").alias("codes"))


def session_portfolio(spark, d):
    s = Session(nation_weeks(spark, d), horizons=(1,))
    got = s.backtest_portfolio("-1 * (close / delay(close, 1))", method="quintile", price="vwap")
    return got["nav"].select("run_id", "date", F.round("nav", 6).alias("nav"))


def stream_hourly_bars(spark, d):
    """All of the events through a stream into a store of hourly bars."""
    schema = table(spark, d, "events").schema
    store = new_path(spark, "stream-bars")
    # A table may be one file or a folder of them; a stream watches folders.
    whole = is_folder(spark, f"{d}/events.parquet")
    files = stream_of(spark, f"{d}/events.parquet", schema) if whole else stream_of(spark, d, schema, "events.parquet")
    # Files are in no order of time, so a watermark would drop the rows of later micro-batches.
    bars = windowed_bars(files.withColumn("ts", F.col("ts").cast("timestamp")), key="event_type", time="ts", price="value", tiebreak="event_id", late=None)
    drain_to_store(bars, store, ["start", "event_type"])
    out = spark.read.parquet(store)
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", *[F.col(c).alias(c) for c in ("open", "high", "low", "close", "n")])


def batch_hourly_bars(spark, d):
    bars = windowed_bars(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), key="event_type", time="ts", price="value", tiebreak="event_id")
    return bars.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "open", "high", "low", "close", "n")


_SQL = "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, arg_min(value, row(ts, event_id)) as open, max(value) as high, min(value) as low, arg_max(value, row(ts, event_id)) as close, count(*) as n from events where event_type is not null and ts is not null and value is not null group by all"
_PORTFOLIO = _NAV.replace("case when m < 0 then 0.001 else 0 end", "0")


def _run_name():
    return factor_id("-1 * (close / delay(close, 1))")


ORACLES = {"session_portfolio": _PORTFOLIO + f"select '{_run_name()}' as run_id, date, round(nav, 6) as nav from nav", "stream_hourly_bars": _SQL, "batch_hourly_bars": _SQL}
QUERIES = {n: globals()[n] for n in ("stream_hourly_bars", "batch_hourly_bars", "session_backtest", "session_portfolio")}
