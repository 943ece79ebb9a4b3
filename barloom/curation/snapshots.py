"""Full snapshots of memberships: what changed between them, and the history they tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.runtime import broadcast_if_small, norm_key

OPEN_END = 99991231


def ymd(column) -> F.Column:
    return (F.year(column) * 10000 + F.month(column) * 100 + F.dayofmonth(column)).cast("bigint")


def compositions(snapshots: DataFrame) -> DataFrame:
    """(index_id, effective_date, ord, n_ords, symbol, weight): the members of each effective date.

    Of several deliveries for one effective date the one with the latest as_of_date counts, then the
    greatest snapshot_id. Deliveries with null index, date, ``symbols`` or ``as_of_date`` and null or blank members
    do not count; an empty ``symbols`` array is a composition without members. Repeated
    members count once, with their greatest weight; a NaN or missing weight is null. ``ord`` numbers the
    effective dates of an index from 0, ``n_ords`` is their number.
    """
    snap = snapshots.select(norm_key(F.col("index_id")).alias("index_id"), "effective_date", "as_of_date", "snapshot_id", "symbols", "weights").where(
        "index_id is not null and effective_date is not null and as_of_date is not null and symbols is not null and snapshot_id is not null"
    )
    # The arrays are left out of the choice; only ids are aggregated and ordered.
    chosen = snap.groupBy("index_id", "effective_date").agg(F.max(F.struct("as_of_date", "snapshot_id")).alias("_top"))
    by_index = Window.partitionBy("index_id")
    chosen = chosen.select(
        F.col("index_id").alias("_ix"),
        F.col("effective_date").alias("_eff"),
        F.col("_top.snapshot_id").alias("_sid"),
        F.col("_top.as_of_date").alias("_asof"),
        (F.row_number().over(by_index.orderBy("effective_date")) - 1).alias("ord"),
        F.count(F.lit(1)).over(by_index).cast("int").alias("n_ords"),
    )
    full = snap.join(
        broadcast_if_small(chosen),
        (F.col("index_id") == F.col("_ix")) & (F.col("effective_date") == F.col("_eff")) & (F.col("snapshot_id") == F.col("_sid")) & (F.col("as_of_date") == F.col("_asof")),
    )
    member = F.explode(F.arrays_zip(F.col("symbols").alias("s"), F.coalesce("weights", F.array().cast("array<double>")).alias("w")))
    return full.select("index_id", "effective_date", "ord", "n_ords", member.alias("_m")).select(
        "index_id", "effective_date", "ord", "n_ords", norm_key(F.col("_m.s")).alias("symbol"), F.when(~F.isnan("_m.w"), F.col("_m.w")).alias("weight")
    ).where("symbol is not null and symbol <> ''")


def snapshot_changes(members: DataFrame, dates: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """(index_id, effective_date, symbol, change_kind, old_weight, new_weight) against the preceding effective date.

    ``members`` as from :func:`compositions`; ``dates``: (index_id, ord, effective_date) of every
    composition, also of those without members. Each member stands on two sides: 'new' in its own
    comparison and 'old' in the next one. Rows are hashed before the shuffle and both sides are grouped once by (index, comparison, member),
    so the hottest index is spread by its members. Equal row hashes mean unchanged; only where they differ the weights
    are compared by ``tolerance``. A weight that appears or goes away (null) is a change. Of a member's repeats the greatest weight counts.
    """
    side = members.select("index_id", "symbol", "weight", F.xxhash64("weight").alias("_h"), F.explode(F.array(F.struct(F.col("ord").alias("cmp"), F.lit(True).alias("new")), F.struct((F.col("ord") + 1).alias("cmp"), F.lit(False).alias("new")))).alias("_s"), "n_ords").where(
        F.col("_s.cmp").between(F.lit(1), F.col("n_ords") - 1)
    )
    row = F.struct("weight", "_h")
    both = side.groupBy("index_id", F.col("_s.cmp").alias("ord"), "symbol").agg(F.max(F.when(F.col("_s.new"), row)).alias("_new"), F.max(F.when(~F.col("_s.new"), row)).alias("_old"))
    new_weight, old_weight = F.col("_new.weight"), F.col("_old.weight")
    far = F.when(new_weight.isNull() | old_weight.isNull(), True).otherwise(F.abs(new_weight - old_weight) > tolerance)
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when((F.col("_new._h") != F.col("_old._h")) & far, "changed")
    return (
        both.select("index_id", "ord", "symbol", kind.alias("change_kind"), old_weight.alias("old_weight"), new_weight.alias("new_weight"))
        .where("change_kind is not null")
        .join(broadcast_if_small(dates.select("index_id", "ord", "effective_date")), ["index_id", "ord"])
        .select("index_id", "effective_date", "symbol", "change_kind", "old_weight", "new_weight")
    )


def table_changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys..., change_kind, n_old, n_new): the keys whose rows were added, removed or changed from one full snapshot of a table to the next.

    Only a hash of the compared ``columns`` (all but the keys if not given, in the order of ``new``) leaves a row: both sides are united and grouped once by
    the keys, and the number of rows and the sum of their hashes on each side tell what happened. Several rows of one key are a bag: their
    order does not matter, their number does. Nulls equal each other, in keys as in columns; a key whose rows are the same on both sides gives
    no row. Columns that only one side has must not be compared. Two empty tables give an empty result.
    """
    columns = [c for c in new.columns if c not in keys] if columns is None else columns
    wide = "decimal(38,0)"
    tagged = lambda df, side: df.select(*[F.col(k) for k in keys], F.xxhash64(F.lit(0), *[F.col(c) for c in columns]).cast(wide).alias("_h"), F.lit(side).alias("_new"))
    both = tagged(old, False).unionByName(tagged(new, True)).groupBy(*keys).agg(
        F.count_if(~F.col("_new")).alias("n_old"), F.count_if("_new").alias("n_new"), F.sum(F.when(F.col("_new"), F.col("_h")).otherwise(-F.col("_h"))).alias("_d")
    )
    kind = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").when((F.col("n_old") != F.col("n_new")) | (F.col("_d") != 0), "changed")
    return both.select(*keys, kind.alias("change_kind"), "n_old", "n_new").where("change_kind is not null")


def composition_dates(snapshots: DataFrame) -> DataFrame:
    """(index_id, ord, effective_date) of the effective dates that have a composition."""
    ok = snapshots.where("index_id is not null and effective_date is not null and as_of_date is not null and symbols is not null and snapshot_id is not null")
    dates = ok.select(norm_key(F.col("index_id")).alias("index_id"), "effective_date").distinct()
    return dates.withColumn("ord", F.row_number().over(Window.partitionBy("index_id").orderBy("effective_date")) - 1)


def attribute_history(members: DataFrame, dates: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """(index_id, symbol, weight, valid_from, valid_to): the unbroken periods of each version, from presence bitmaps.

    A version is a member with a weight. Weights of one member that lie within ``tolerance`` of each
    other (chained) are one version, and each version has a bit per composition, 64 to a word, built with
    one ``bit_or`` per (index, member, version, word). Runs of consecutive bits are the periods; gaps
    part them by themselves. Where a chain holds weights further apart than the tolerance, the runs
    are cut where two consecutive weights differ by more, so the result is exact. ``valid_to`` is the
    (exclusive) date at which the version no longer holds, null if it still holds at the last one.
    A null weight is a version of its own.
    """
    one = members.groupBy("index_id", "symbol", "ord").agg(F.max("weight").alias("weight"))
    # Bounded by the number of compositions of an index, whatever the number of members or deliveries.
    by_weight = Window.partitionBy("index_id", "symbol").orderBy(F.col("weight").asc_nulls_first(), "ord")
    by_time = Window.partitionBy("index_id", "symbol").orderBy("ord")
    jump = F.col("weight").isNotNull() & (F.lag("weight").over(by_weight).isNull() | (F.col("weight") - F.lag("weight").over(by_weight) > tolerance))
    step = F.col("weight").isNotNull() & F.lag("weight").over(by_time).isNotNull() & (F.abs(F.col("weight") - F.lag("weight").over(by_time)) > tolerance) & (F.lag("ord").over(by_time) == F.col("ord") - 1)
    versions = (
        one.withColumn("_jump", jump.cast("int"))
        .withColumn("version", F.sum("_jump").over(by_weight.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_step", step)
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("ord", F.lit(64)).cast("int"))
    words = versions.groupBy("index_id", "symbol", "version", F.floor(F.col("ord") / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits"),
        F.bit_or(F.when(F.col("_step"), bit).otherwise(F.lit(0).cast("bigint"))).alias("cuts"),
        F.min("weight").alias("weight"),
    )
    # A bit starts a run if the bit before it is unset or the weight stepped there; it ends one if the next bit does not go on.
    order = Window.partitionBy("index_id", "symbol", "version").orderBy("word")
    adjacent_before = F.when(F.lag("word").over(order) == F.col("word") - 1, F.lag("bits").over(order)).otherwise(F.lit(0).cast("bigint"))
    next_here = F.lead("word").over(order) == F.col("word") + 1
    next_bits = F.when(next_here, F.lead("bits").over(order)).otherwise(F.lit(0).cast("bigint"))
    next_cuts = F.when(next_here, F.lead("cuts").over(order)).otherwise(F.lit(0).cast("bigint"))
    w = words.withColumn("_prev", adjacent_before).withColumn("_next", next_bits.bitwiseAND(F.bitwise_not(next_cuts)))
    before = F.shiftleft("bits", 1).bitwiseOR(F.shiftrightunsigned("_prev", 63))
    starts = F.col("bits").bitwiseAND(F.bitwise_not(before).bitwiseOR(F.col("cuts")))
    goes_on = F.col("bits").bitwiseAND(F.bitwise_not("cuts"))
    after = F.shiftrightunsigned(goes_on, 1).bitwiseOR(F.shiftleft("_next", 63))
    ends = F.col("bits").bitwiseAND(F.bitwise_not(after))
    w = w.withColumn("_starts", starts).withColumn("_ends", ends)
    at = lambda bits: F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(bits, k) == 1), lambda k: k + F.col("word") * 64)
    # Starts and ends alternate in time, so the n-th start of a version belongs to its n-th end.
    marks = w.select("index_id", "symbol", "version", "weight", F.explode(F.concat(F.transform(at(F.col("_starts")), lambda o: F.struct(o.alias("o"), F.lit(0).alias("end"))), F.transform(at(F.col("_ends")), lambda o: F.struct(o.alias("o"), F.lit(1).alias("end"))))).alias("_m"))
    paired = marks.withColumn("_to", F.lead("_m.o").over(Window.partitionBy("index_id", "symbol", "version").orderBy("_m.o", "_m.end"))).where("_m.end = 0")
    d = broadcast_if_small(dates.select(F.col("index_id").alias("_ix"), F.col("ord").alias("_o"), "effective_date"))
    first = d.withColumnRenamed("effective_date", "valid_from")
    until = d.withColumnRenamed("effective_date", "valid_to")
    return (
        paired.select("index_id", "symbol", "weight", F.col("_m.o").alias("_from"), (F.col("_to") + 1).alias("_until"))
        .join(first, (F.col("index_id") == F.col("_ix")) & (F.col("_from") == F.col("_o")))
        .drop("_ix", "_o")
        .join(until, (F.col("index_id") == F.col("_ix")) & (F.col("_until") == F.col("_o")), "left")
        .select("index_id", "symbol", "weight", "valid_from", "valid_to")
    )
