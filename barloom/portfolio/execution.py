"""What stands between a wanted trade and a done one: suspensions, price limits, volume. Logs of trades and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite
from barloom.portfolio.accounting import books


def rebased_limits(status: DataFrame, bars: DataFrame, price: str = "close") -> DataFrame:
    """(date, symbol, price, up_limit, down_limit): limits quoted on raw prices, in the basis of adjusted ``bars``.

    Each limit is multiplied by adjusted over raw close; without a positive raw close there is no limit. Bars without a status have none.
    """
    s = status.select("date", "symbol", F.col("up_limit").alias("_up"), F.col("down_limit").alias("_down"), F.col("close").cast("double").alias("_raw"))
    j = bars.select("date", "symbol", F.col(price).cast("double").alias("price")).join(s, ["date", "symbol"], "left")
    f = F.when((F.col("_raw") > 0) & finite(F.col("price")), F.col("price") / F.when(F.col("_raw") > 0, F.col("_raw")))
    return j.select("date", "symbol", "price", (F.col("_up") * f).alias("up_limit"), (F.col("_down") * f).alias("down_limit"))


def execute(moves: DataFrame, market: DataFrame, *, run: str = "run_id", max_share: float | None = None, when_blocked: str = "defer", tolerance: float = 1e-9) -> DataFrame:
    """The trade log (run, date, symbol, side, wanted, filled, deferred, reason) of wanted ``moves`` (run, date, symbol, move).

    ``market``: (date, symbol, price, up_limit, down_limit, volume_room), any of them null where unknown. In this order: without a positive price the symbol
    is 'suspended'; a buy at or above the upper limit is blocked as 'limit_up', a sale at or below the lower one as 'limit_down'; a
    move beyond ``max_share`` of ``volume_room`` is filled up to it ('volume'). What was not filled is deferred ('defer'), given up ('cancel') or
    filled all the same ('force'), as ``when_blocked`` says. Moves of 1e-12 or less are none.
    """
    if when_blocked not in ("defer", "cancel", "force"):
        raise ValueError(f"when_blocked must be defer, cancel or force, not {when_blocked!r}")
    m = moves.where(F.abs("move") > 1e-12).join(market, ["date", "symbol"], "left")
    buy, p = F.col("move") > 0, F.col("price")
    room = F.col("volume_room") * max_share if max_share is not None else F.lit(None).cast("double")
    reason = (
        F.when(~finite(p) | p.isNull() | (p <= 0), "suspended").when(buy & (p >= F.col("up_limit") * (1 - tolerance)), "limit_up")
        .when(~buy & (p <= F.col("down_limit") * (1 + tolerance)), "limit_down").when(finite(room) & (F.abs("move") > room), "volume")
    )
    m = m.withColumn("reason", reason)
    part = F.when(F.col("reason").isNull(), F.col("move")).when(F.col("reason") == "volume", F.signum("move") * room).otherwise(F.lit(0.0))
    filled = F.col("move") if when_blocked == "force" else part
    left = F.col("move") - filled if when_blocked == "defer" else F.lit(0.0)
    return m.select(run, "date", "symbol", F.when(buy, "buy").otherwise("sell").alias("side"), F.col("move").alias("wanted"), filled.alias("filled"), left.alias("deferred"), "reason")


def trade_log(returns: DataFrame, targets: DataFrame, market: DataFrame, *, run: str = "run_id", **rules) -> DataFrame:
    """:func:`execute` for the moves from the drifted book to each target of runs whose targets are given in advance."""
    return execute(books(returns, targets, run)["moves"], market, run=run, **rules)


def position_log(returns: DataFrame, targets: DataFrame, *, run: str = "run_id") -> DataFrame:
    """(run, date, symbol, weight): the drifted book at the end of every date, before that date's rebalance; symbols without weight are left out."""
    b = books(returns, targets, run)
    h = b["held"].join(b["value"].select(run, "date", "f"), [run, "date"])
    return h.select(run, "date", "symbol", (F.col("weight") * F.col("g") / F.when(F.col("f") != 0, F.col("f"))).alias("weight"))


def threshold_triggers(book: DataFrame, target: DataFrame, *, rank_shift: float | None = None, drift: float | None = None, run: str = "run_id") -> DataFrame:
    """(run, date, symbol, rank_shift, drift): the symbols whose decile has moved by more than ``rank_shift`` since the book was made or whose weight is off by more than ``drift``.

    ``book`` and ``target``: (run, date, symbol, weight, decile). Missing numbers never trigger; a date without a row needs no rebalance.
    """
    b = book.select(run, "date", "symbol", F.col("weight").alias("_w"), F.col("decile").alias("_d"))
    j = target.select(run, "date", "symbol", "weight", "decile").join(b, [run, "date", "symbol"])
    shift, off = F.abs(F.col("decile") - F.col("_d")), F.abs(F.col("weight") - F.col("_w"))
    hit = lambda x, most: F.coalesce(finite(x) & (x > most), F.lit(False)) if most is not None else F.lit(False)
    return j.where(hit(shift, rank_shift) | hit(off, drift)).select(run, "date", "symbol", shift.alias("rank_shift"), off.alias("drift"))


def deciles(signal: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``signal`` with ``decile`` 0 to 9 by place within the date; symbols without a signal have none."""
    w = Window.partitionBy(*by, "date")
    place = F.row_number().over(w.orderBy(F.col("signal").asc_nulls_last(), "symbol")) - 1
    n = F.count("signal").over(w)
    return signal.withColumn("decile", F.when(F.col("signal").isNotNull(), F.least(F.floor(place * 10 / F.when(n > 0, n)), F.lit(9)).cast("int")))
