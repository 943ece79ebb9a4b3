"""Point-in-time reads: every read says as of when, and nothing that became known later comes back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite
from barloom.runtime import norm_key, staged_small
from barloom.sources.files import latest

MODES = {"none": "none", "split": "split", "total": "total", "forward": "total"}
#: Days between an ex-date and the close it is measured against; also the lead-in that panels read before their start.
GAP_DAYS = 10
PRICE_FIELDS = ("open", "high", "low", "close", "volume", "transactions")


def as_date(x: str | dt.date) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(x)


def months_between(start: dt.date, end: dt.date) -> list[tuple[int, int]]:
    return [(m // 12, m % 12 + 1) for m in range(start.year * 12 + start.month - 1, end.year * 12 + end.month)]


def prices_as_of(prices: DataFrame, start, end, as_of, symbols: DataFrame | Sequence[str] | None = None, order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """The bar of every (symbol, date) as it was known: of several rows the last in ``order``.

    On a store partitioned by year and month both are restricted too, as the optimizer cannot tell them from the date.
    """
    start, end, as_of = map(as_date, (start, end, as_of))
    rows = prices.where(F.col("date").between(start, end) & (F.col("as_of_date") <= as_of))
    if {"year", "month"} <= set(prices.columns):
        rows = rows.where((F.col("year") * 12 + F.col("month") - 1).between(start.year * 12 + start.month - 1, end.year * 12 + end.month - 1) & F.col("year").between(start.year, end.year))
    rows = rows.withColumn("symbol", norm_key(F.col("symbol"))).where("symbol is not null")
    if isinstance(symbols, DataFrame):
        rows = rows.join(symbols.select(norm_key(F.col("symbol")).alias("symbol")).distinct(), "symbol", "left_semi")
    elif symbols is not None:
        rows = rows.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    return latest(rows, ["symbol", "date"], list(order))


def events_as_of(events: DataFrame, end, as_of) -> DataFrame:
    """Events with an ex-date up to ``end`` as they were known: of each event_id the latest row."""
    rows = events.where((F.col("ex_date") <= as_date(end)) & (F.col("as_of_date") <= as_date(as_of)) & F.col("event_id").isNotNull()).withColumn("symbol", norm_key(F.col("symbol")))
    return latest(rows, ["event_id"], ["as_of_date", "ex_date", "split_ratio", "dividend_cash"])


def forward_adjust(prices: DataFrame, events: DataFrame, mode: str = "split", price_columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices as if every later event had already happened.

    A split of ratio r divides the prices of all bars before its ex-date by r and multiplies their volume. A dividend
    (mode 'total') scales the earlier prices by 1 - cash / last raw close before the ex-date; it is skipped if there is no
    such close within ten days, if that is not positive, or if the factor would not be. The bar of the ex-date itself is
    untouched. Bars and events of a symbol are one timeline, walked twice by window functions: no bar meets each of its events.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, not {mode!r}")
    mode = MODES[mode]
    if mode == "none":
        return prices
    bars = prices.select("symbol", "date", F.lit(0).alias("_kind"), F.struct(*prices.columns).alias("_bar"), F.col("close").cast("double").alias("_close"))
    ratio = F.when(finite(F.col("split_ratio")) & (F.col("split_ratio") > 0), F.col("split_ratio"))
    cash = F.when(finite(F.col("dividend_cash")) & (F.col("dividend_cash") > 0), F.col("dividend_cash"))
    acts = events.select("symbol", F.col("ex_date").alias("date"), F.lit(1).alias("_kind"), ratio.alias("_r"), cash.alias("_d")).where("symbol is not null and date is not null")
    line = bars.unionByName(acts, allowMissingColumns=True)
    # Before an event come the bars of earlier days only: on its own day the event sorts first.
    forward = Window.partitionBy("symbol").orderBy("date", F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("_kind") == 0, F.struct(F.col("date").alias("d"), F.col("_close").alias("c"))), ignorenulls=True).over(forward)
    line = line.withColumn("_prior", F.when(F.col("_kind") == 1, prior))
    close = F.when((F.datediff("date", F.col("_prior.d")) <= GAP_DAYS) & finite(F.col("_prior.c")) & (F.col("_prior.c") > 0), F.col("_prior.c"))
    keep = 1 - F.col("_d") / close
    factor = F.coalesce(F.when(keep > 0, keep), F.lit(1.0)) if mode == "total" else F.lit(1.0)
    line = line.withColumns({"_split": F.coalesce("_r", F.lit(1.0)), "_price": factor / F.coalesce("_r", F.lit(1.0))})
    # Walking backwards, a bar comes before the events of its own day.
    backward = Window.partitionBy("symbol").orderBy(F.desc("date"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"_pf": F.product("_price").over(backward), "_vf": F.product("_split").over(backward)}).where("_kind = 0")
    scaled = lambda c: F.col(f"_bar.{c}").cast("double") * F.col("_vf" if c == "volume" else "_pf")
    return line.select(*[scaled(c).alias(c) if c in price_columns or c == "volume" else F.col(f"_bar.{c}").alias(c) for c in prices.columns])


def read_panel(prices: DataFrame, events: DataFrame, fields: Sequence[str], start, end, as_of, adj: str = "split", symbols=None, order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """(date, symbol, *fields): the adjusted panel as it was known; read with a lead-in before ``start`` for dividends."""
    bad = [f for f in fields if f not in PRICE_FIELDS]
    if bad:
        raise ValueError(f"unknown fields {bad}; the store has {PRICE_FIELDS}")
    start = as_date(start)
    needed = ["symbol", "date", *dict.fromkeys([*fields, "close"])]
    bars = prices_as_of(prices, start - dt.timedelta(days=GAP_DAYS), end, as_of, symbols, order).select(*needed)
    out = forward_adjust(bars, events_as_of(events, end, as_of), adj, [c for c in ("open", "high", "low", "close") if c in needed])
    return out.where(F.col("date") >= start).select("date", "symbol", *fields)


def _usable(snapshots: DataFrame, as_of) -> DataFrame:
    rows = snapshots.where((F.col("as_of_date") <= as_date(as_of)) & F.col("symbols").isNotNull())
    return rows.withColumn("index_id", norm_key(F.col("index_id")))


def clean_members(symbols) -> F.Column:
    """Distinct members, trimmed and upper-cased, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(symbols, lambda s: F.upper(F.trim(s))), lambda s: s.isNotNull() & (s != ""))))


def snapshots_as_of(snapshots: DataFrame, as_of) -> DataFrame:
    """(index_id, effective_date, symbols): one delivery per effective date, the last one known."""
    order = [c for c in ("as_of_date", "snapshot_id") if c in snapshots.columns]
    return latest(_usable(snapshots, as_of).where("effective_date is not null"), ["index_id", "effective_date"], order).select("index_id", "effective_date", clean_members(F.col("symbols")).alias("symbols"))


def universe(snapshots: DataFrame, date, as_of) -> DataFrame:
    """(index_id, symbol): members on ``date`` as known; an index without a snapshot by then has none."""
    top = snapshots_as_of(snapshots, as_of).where(F.col("effective_date") <= as_date(date)).groupBy("index_id").agg(F.max_by("symbols", "effective_date").alias("symbols"))
    return top.select("index_id", F.explode("symbols").alias("symbol"))


def membership_intervals(snapshots: DataFrame, as_of) -> DataFrame:
    """(index_id, symbol, valid_from, valid_to): members from each effective date up to (not including) the next one; null if none follows."""
    s = snapshots_as_of(snapshots, as_of).withColumn("valid_to", F.lead("effective_date").over(Window.partitionBy("index_id").orderBy("effective_date")))
    return s.select("index_id", F.explode("symbols").alias("symbol"), F.col("effective_date").alias("valid_from"), "valid_to")


def universe_panel(prices: DataFrame, events: DataFrame, snapshots: DataFrame, index: str, fields: Sequence[str], start, end, as_of, adj: str = "split", membership: str = "end", order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """The adjusted panel of an index. 'end': its members at the end of the period over all of it; 'daily': each bar only while its symbol was a member."""
    if membership not in ("end", "daily"):
        raise ValueError(f"membership must be end or daily, not {membership!r}")
    own = snapshots.where(norm_key(F.col("index_id")) == index.strip().upper())
    if membership == "end":
        return read_panel(prices, events, fields, start, end, as_of, adj, universe(own, end, as_of), order)
    spans = membership_intervals(own, as_of)
    panel = read_panel(prices, events, fields, start, end, as_of, adj, spans.select("symbol").distinct(), order)
    # Intervals of one symbol do not overlap, so a bar meets at most one.
    return panel.join(spans.select("symbol", "valid_from", "valid_to"), "symbol").where((F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to")))).select("date", "symbol", *fields)


def membership_stays(snapshots: DataFrame, as_of) -> DataFrame:
    """(index_id, symbol, valid_from, valid_to): :func:`membership_intervals` with those that follow on one another united."""
    own = Window.partitionBy("index_id", "symbol").orderBy("valid_from")
    s = membership_intervals(snapshots, as_of).withColumn("_new", (~F.lag("valid_to").over(own).eqNullSafe(F.col("valid_from"))).cast("int"))
    s = s.withColumn("_stay", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("index_id", "symbol", "_stay").agg(F.min("valid_from").alias("valid_from"), F.max_by("valid_to", "valid_from").alias("valid_to")).drop("_stay")


def universe_panels(prices: DataFrame, events: DataFrame, snapshots: DataFrame, fields: Sequence[str], start, end, as_of, adj: str = "split", membership: str = "end", order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """(index_id, date, symbol, *fields): the adjusted panels of all indices. 'end': members at the end of the period over all of it; 'daily': each bar only while its symbol was a member.

    Every bar is read and adjusted once, however many indices its symbol is in.
    """
    if membership not in ("end", "daily"):
        raise ValueError(f"membership must be end or daily, not {membership!r}")
    members = staged_small(universe(snapshots, end, as_of) if membership == "end" else membership_stays(snapshots, as_of), "members")
    panel = read_panel(prices, events, fields, start, end, as_of, adj, members.select("symbol"), order).join(members, "symbol")
    if membership == "daily":
        # Stays of one symbol in one index do not overlap, so a bar meets at most one of each index.
        panel = panel.where((F.col("date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("date") < F.col("valid_to"))))
    return panel.select("index_id", "date", "symbol", *fields)


def union_over_range(snapshots: DataFrame, start, end, as_of) -> DataFrame:
    """(index_id, symbol): everyone who was a member at some time of the range, free of survivorship."""
    s = snapshots_as_of(snapshots, as_of).withColumn("_until", F.lead("effective_date").over(Window.partitionBy("index_id").orderBy("effective_date")))
    s = s.where((F.col("effective_date") <= as_date(end)) & (F.col("_until").isNull() | (F.col("_until") > as_date(start))))
    return s.select("index_id", F.explode("symbols").alias("symbol")).distinct()


def membership_changes(snapshots: DataFrame, as_of) -> DataFrame:
    """(index_id, effective_date, symbols, joined, left): snapshots that differ from the one before; the first of each index stays."""
    before = F.lag("symbols").over(Window.partitionBy("index_id").orderBy("effective_date"))
    s = snapshots_as_of(snapshots, as_of).withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col("symbols")))
    none = F.array().cast("array<string>")
    return s.select("index_id", "effective_date", "symbols", F.array_except("symbols", F.coalesce("_before", none)).alias("joined"), F.array_except(F.coalesce("_before", none), "symbols").alias("left"))


def groups_as_of(groups: DataFrame, as_of) -> DataFrame:
    """(symbol, group): the latest label of each symbol."""
    return latest(groups.where(F.col("as_of_date") <= as_date(as_of)), ["symbol"], ["as_of_date"]).select("symbol", "group")


def resample(bars: DataFrame, frequency: str) -> DataFrame:
    """(symbol, date, open, high, low, close, volume) by calendar week ('1w') or month ('1mo'), dated with the last session of the period."""
    unit = {"1w": "week", "1mo": "month"}.get(frequency)
    if unit is None:
        raise ValueError(f"frequency must be 1w or 1mo, not {frequency!r}")
    period = F.date_trunc(unit, F.col("date").cast("timestamp_ntz")).alias("_period")
    return bars.groupBy("symbol", period).agg(F.max("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")).drop("_period")


def data_calendar(prices: DataFrame) -> DataFrame:
    """(date, n_symbols, coverage): symbols with a bar, and their share of the busiest day's."""
    n = prices.groupBy("date").agg(F.countDistinct(norm_key(F.col("symbol"))).alias("n_symbols"))
    busiest = F.max("n_symbols").over(Window.partitionBy(F.lit(0)))  # one row per day: a bounded calendar
    return n.withColumn("coverage", F.col("n_symbols") / busiest)


def store_status(prices: DataFrame) -> DataFrame:
    """One row: rows, symbols, days, first and last date, last knowledge."""
    return prices.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(norm_key(F.col("symbol"))).alias("n_symbols"), F.countDistinct("date").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("as_of_date").alias("last_known"))


def get_bars(prices: DataFrame, events: DataFrame, symbols: DataFrame | Sequence[str], start, end, as_of, frequency: str = "1d", adj: str = "split", order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """(symbol, date, open, high, low, close, volume) of some symbols, adjusted and as known; daily ('1d'), weekly ('1w') or monthly ('1mo').

    Listed symbols reach the scan of prices and events as a filter, a table of them is semi-joined. Symbols without bars give no row.
    """
    if isinstance(symbols, DataFrame):
        wanted, own = symbols, events
    else:
        wanted = sorted({s.strip().upper() for s in symbols})
        own = events.where(norm_key(F.col("symbol")).isin(wanted))
    bars = read_panel(prices, own, ["open", "high", "low", "close", "volume"], start, end, as_of, adj, wanted, order)
    return (bars if frequency == "1d" else resample(bars, frequency)).select("symbol", "date", "open", "high", "low", "close", "volume")


def status_as_of(status: DataFrame, start, end, as_of) -> DataFrame:
    """The price limits and locks of every (date, symbol) of the range as they were known: the latest of several rows."""
    rows = status.where(F.col("date").between(as_date(start), as_date(end)) & (F.col("as_of_date") <= as_date(as_of))).withColumn("symbol", norm_key(F.col("symbol"))).where("symbol is not null")
    return latest(rows, ["symbol", "date"], ["as_of_date"])


def changes_around(snapshots: DataFrame, baseline, as_of) -> DataFrame:
    """(index_id, effective_date, side, symbol, change): who joined or left at each composition after the ``baseline`` date ('since') and up to it ('before')."""
    c = membership_changes(snapshots, as_of)
    rows = c.select("index_id", "effective_date", F.explode(F.concat(F.transform("joined", lambda s: F.struct(s.alias("symbol"), F.lit("joined").alias("change"))), F.transform("left", lambda s: F.struct(s.alias("symbol"), F.lit("left").alias("change"))))).alias("_c"))
    return rows.select("index_id", "effective_date", F.when(F.col("effective_date") > as_date(baseline), "since").otherwise("before").alias("side"), "_c.symbol", "_c.change")


def apply_deltas(deltas: DataFrame) -> DataFrame:
    """(index_id, effective_date, symbols): full compositions from deltas (index_id, effective_date, seq, op, symbols).

    ``op`` 'union' adds and 'difference' removes members. Deltas are applied by effective date and within it by ``seq``, as their source lists
    them: a member removed and then added on one date stays, one added and then removed does not. What a member's last delta says
    holds, so each member is looked at by itself: no composition is rebuilt from its start, and a large index is spread by its members.
    Unknown operations, null dates and members count as nothing. Dates with no effect still give their composition.
    """
    d = deltas.where(F.col("op").isin("union", "difference") & F.col("effective_date").isNotNull()).select(norm_key(F.col("index_id")).alias("index_id"), "effective_date", "seq", (F.col("op") == "union").alias("_in"), "symbols")
    dates = d.select("index_id", "effective_date").distinct()
    each = d.select("index_id", "effective_date", "seq", "_in", F.explode("symbols").alias("symbol")).withColumn("symbol", norm_key(F.col("symbol"))).where("symbol <> ''")
    each = each.groupBy("index_id", "symbol", "effective_date").agg(F.max_by("_in", "seq").alias("_in"))
    own = Window.partitionBy("index_id", "symbol").orderBy("effective_date")
    spans = each.withColumn("_until", F.lead("effective_date").over(own)).where("_in").select("index_id", "symbol", F.col("effective_date").alias("_from"), "_until")
    held = dates.join(spans, "index_id", "left").where("_from is null or (effective_date >= _from and (_until is null or effective_date < _until))")
    found = held.groupBy("index_id", "effective_date").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    return dates.join(found, ["index_id", "effective_date"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
