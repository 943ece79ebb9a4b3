"""The panel: one row per (symbol, date) of a dense grid, in one shuffle that all symbol windows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import nn

#: A calendar of days is bounded: a thousand years of them.
MAX_DAYS = 366_000


def panel_dates(panel: DataFrame) -> list:
    """The distinct dates of the panel in order; a bounded calendar, read on the driver."""
    days = [r[0] for r in panel.select("date").where("date is not null").distinct().limit(MAX_DAYS + 1).collect()]
    if len(days) > MAX_DAYS:
        raise ValueError("more dates than a calendar has")
    return sorted(days)


def densify(panel: DataFrame, fields: list[str], order: str | None = None) -> DataFrame:
    """(symbol, date, bar_no, *fields): every symbol on every date of the panel; absent cells are null.

    Fields become doubles without NaN. Of repeated (symbol, date) rows the one with the greatest ``order`` counts; without
    ``order`` each field takes its greatest value. Rows with a null symbol or date are left out. The grid is no join: every symbol
    gets the calendar exploded and is united with its bars; both are grouped by (symbol, date), combined
    before the shuffle, so repeated deliveries of a hot symbol do not travel.
    """
    days = panel_dates(panel)
    cells = panel.where("symbol is not null and date is not null").select("symbol", "date", *([F.col(order).alias("_ord")] if order else []), *[nn(F.col(f).cast("double")).alias(f) for f in fields])
    if not days:
        return cells.select("symbol", "date", F.lit(0).alias("bar_no"), *fields)
    calendar = F.posexplode(F.lit(days)).alias("bar_no", "date")
    grid = cells.select("symbol").distinct().select("symbol", calendar)
    cells = cells.withColumn("bar_no", F.lit(None).cast("int"))
    both = grid.unionByName(cells, allowMissingColumns=True)
    if order:
        last = F.max(F.struct("_ord", *fields)).alias("_last")
        return both.groupBy("symbol", "date").agg(F.max("bar_no").alias("bar_no"), last).select("symbol", "date", "bar_no", *[F.col(f"_last.{f}").alias(f) for f in fields])
    return both.groupBy("symbol", "date").agg(F.max("bar_no").alias("bar_no"), *[F.max(f).alias(f) for f in fields])
