"""Attributes as known at event time: a bi-temporal as-of join by time shards with carry-in.

A version is *visible* from the later of its valid date and its known date. Among the versions
visible at an event's time the one of highest priority wins, and priority (valid date, then known
date) does not depend on the event. The best version is hence a running maximum over versions in the
order in which they become visible, and a maximum can be computed shard by shard:

1. events are cut into shards (entity, time bucket); shards with more than ``target_rows`` events are
   salted further;
2. of each shard only the maximum goes on to the later shards of the entity (the carry-in);
3. each shard merges its own versions, its carry-in and its events in one sorted pass.

No shard needs another one's rows, so a hot entity is spread over as many tasks as it has time
buckets and salts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.runtime import BROADCAST_ROWS, broadcast_if_small


def asof_attributes(
    events: DataFrame,
    versions: DataFrame,
    *,
    event_id: str = "event_id",
    entity: str = "entity",
    event_date: str = "date",
    valid_from: str = "valid_from",
    known_from: str = "known_from",
    ref: str = "ref_id",
    shard_days: int = 64,
    target_rows: int = 1_000_000,
) -> DataFrame:
    """(event_id, entity, ref_id, known_from): for every event the version of its entity in force and known on its date.

    The latest ``valid_from`` wins, then the latest ``known_from``, then the smallest ``ref``. Events
    without a visible version give no row. Events with a null entity or date, and versions with a null
    entity, valid date, known date or ref, never match. Repeated events (same id) each give their row;
    repeated versions count once. Other columns of either table are not looked at, so their names
    cannot clash. Empty tables give an empty result.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    shard = F.floor(F.col("_day") / shard_days).cast("int")
    ev = (
        events.select(F.col(event_id).alias("_id"), F.col(entity).alias("_entity"), day(event_date).alias("_day"))
        .where("_entity is not null and _day is not null")
        .withColumn("_shard", shard)
    )
    ve = (
        versions.select(F.col(entity).alias("_entity"), day(valid_from).alias("_vf"), day(known_from).alias("_kf"), F.col(ref).alias("_ref"))
        .where("_entity is not null and _vf is not null and _kf is not null and _ref is not null")
        .groupBy("_entity", "_vf", "_kf")
        .agg(F.min("_ref").alias("_ref"))
        .select("_entity", F.greatest("_vf", "_kf").alias("_day"), F.struct("_vf", "_kf", "_ref").alias("_best"))
        .withColumn("_shard", shard)
    )
    sizes = ev.groupBy("_entity", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    tops = ve.groupBy("_entity", "_shard").agg(F.max("_best").alias("_top"))
    before = Window.partitionBy("_entity").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        sizes.join(tops, ["_entity", "_shard"], "full")
        .withColumn("_best", F.max("_top").over(before))
        .where("_n is not null and _best is not null")
        .select("_entity", (F.col("_shard") * shard_days).alias("_day"), "_best", "_shard")
    )
    known = ve.select("_entity", "_day", "_best", "_shard").unionByName(carry)
    hot = sizes.where(F.col("_n") > target_rows).select("_entity", "_shard", F.ceil(F.col("_n") / target_rows).cast("int").alias("_salts"))
    if hot.limit(1).count():
        hot = broadcast_if_small(hot, BROADCAST_ROWS)
        ev = ev.join(hot, ["_entity", "_shard"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id", "_day"), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
        known = known.join(hot, ["_entity", "_shard"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    else:
        ev, known = ev.withColumn("_salt", F.lit(0)), known.withColumn("_salt", F.lit(0))
    # A version that becomes visible on the event's own day counts: it sorts before the event.
    rows = known.select("_entity", "_shard", "_salt", "_day", F.lit(0).alias("_kind"), "_best", F.lit(None).cast(ev.schema["_id"].dataType).alias("_id")).unionByName(
        ev.select("_entity", "_shard", "_salt", "_day", F.lit(1).alias("_kind"), F.lit(None).cast(known.schema["_best"].dataType).alias("_best"), "_id")
    )
    upto = Window.partitionBy("_entity", "_shard", "_salt").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_best", F.max("_best").over(upto))
        .where("_kind = 1 and _best is not null")
        .select(F.col("_id").alias("event_id"), F.col("_entity").alias("entity"), F.col("_best._ref").alias("ref_id"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("_best._kf")).alias("known_from"))
    )
