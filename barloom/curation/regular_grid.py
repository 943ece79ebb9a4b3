"""Irregular readings onto a regular grid of periods, with gaps filled or marked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.runtime import broadcast_if_small, norm_key


def regular_grid(readings: DataFrame, specs: DataFrame, *, max_gap: int = 3, tiebreak: str = "panel_id") -> DataFrame:
    """One row per period of every (session, symbol): its last reading, the value carried into it, and a mark.

    ``readings``: session_id, symbol, read_at, close, volume and a ``tiebreak`` for equal times.
    ``specs``: session_id, start_date, end_date, step_minutes, open_minute, close_minute.

    Returns session_id, symbol, slot (number of the period), slot_start (timestamp without zone), n_obs (readings with a
    close), close (last one of the period), volume (their sum), filled (close, or the last close of at
    most ``max_gap`` periods before), status: 'observed', 'filled' or 'missing'.

    Periods lie on Mondays to Fridays from start_date to end_date, from open_minute in steps up to before
    close_minute. Readings with a null close, a null time or a time outside every period belong to no period, but
    their symbol still has a series. Sessions without readings have no series; sessions unknown to
    ``specs``, with null bounds, a step below 1 or an end before the start have no periods. Symbols are
    trimmed and upper-cased, null ones are left out. Repeated readings of a period count in n_obs;
    the latest one gives the close, a tie in time goes to the greatest ``tiebreak``.

    The readings are reduced to one row per period before anything is joined (with map-side
    combination, so a hot symbol costs no more than its periods), and grid and readings meet on
    (session, symbol, slot), never on the symbol alone.
    """
    sp = specs.select(
        "session_id",
        F.col("start_date").alias("_start"),
        F.col("end_date").alias("_end"),
        F.col("step_minutes").cast("int").alias("_step"),
        F.col("open_minute").cast("int").alias("_open"),
        F.col("close_minute").cast("int").alias("_close"),
    ).where("session_id is not null and _start is not null and _end >= _start and _step >= 1 and _open >= 0 and _close > _open")
    sp = sp.dropDuplicates(["session_id"]).withColumn("_per_day", F.ceil((F.col("_close") - F.col("_open")) / F.col("_step")).cast("int"))
    spec = broadcast_if_small(sp)
    read = readings.select("session_id", norm_key(F.col("symbol")).alias("symbol"), F.col("read_at").alias("_at"), F.col("close").alias("_px"), F.col("volume").alias("_vol"), F.col(tiebreak).alias("_tie")).where(
        "session_id is not null and symbol is not null"
    )
    at = read.join(spec, "session_id")
    minute = F.hour("_at") * 60 + F.minute("_at")
    day = F.to_date("_at")
    inside = F.col("_px").isNotNull() & ~F.isnan("_px") & day.between(F.col("_start"), F.col("_end")) & (F.weekday("_at") < 5) & (minute >= F.col("_open")) & (minute < F.col("_close"))
    slot = F.datediff(day, F.col("_start")) * F.col("_per_day") + F.floor((minute - F.col("_open")) / F.col("_step")).cast("int")
    # Slot -1 keeps series that have no reading inside a period: one row for each, so the list of series needs no pass of its own.
    buckets = (
        at.select("session_id", "symbol", F.coalesce(F.when(inside, slot), F.lit(-1)).cast("int").alias("slot"), "_at", "_px", "_vol", "_tie")
        .groupBy("session_id", "symbol", "slot")
        .agg(F.count(F.lit(1)).alias("n_obs"), F.max(F.struct("_at", "_tie", "_px")).alias("_last"), F.sum("_vol").alias("volume"))
    )
    # A short list that grows a lot when its periods are generated: spread before, by another key than it is grouped by, else the engine takes the exchange away.
    series = buckets.select("session_id", "symbol").distinct().repartition(int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("session_id", "symbol"))
    days = F.filter(F.sequence("_start", "_end"), lambda d: F.weekday(d) < 5)
    grid = (
        series.join(spec, "session_id")
        .withColumn("_d", F.explode(days))
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_per_day") - 1)))
        .select(
            "session_id",
            "symbol",
            (F.datediff("_d", "_start") * F.col("_per_day") + F.col("_k")).cast("int").alias("slot"),
            (F.col("_d").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_open") + F.col("_k") * F.col("_step"))).alias("slot_start"),
        )
    )
    joined = grid.join(buckets.where("slot >= 0"), ["session_id", "symbol", "slot"], "left")
    order = Window.partitionBy("session_id", "symbol").orderBy("slot")
    recent = order.rowsBetween(-max_gap, 0)
    px = F.col("_last._px")
    return joined.select(
        "session_id",
        "symbol",
        "slot",
        "slot_start",
        F.coalesce("n_obs", F.lit(0)).alias("n_obs"),
        px.alias("close"),
        "volume",
        F.last(px, ignorenulls=True).over(recent).alias("filled"),
        F.when(px.isNotNull(), "observed").when(F.last(px, ignorenulls=True).over(recent).isNotNull(), "filled").otherwise("missing").alias("status"),
    )
