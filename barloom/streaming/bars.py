"""Bars from streams: windowed aggregation under a watermark, and exactly-once upserts into a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.runtime import new_path
from barloom.sources.files import upsert


def stream_of(spark: SparkSession, folder: str, schema, glob: str | None = None, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """Files that arrive in ``folder``; each is read once, in bounded micro-batches."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def windowed_bars(ticks: DataFrame, *, key: str, time: str, price: str, tiebreak: str, width: str = "1 hour", late: str | None = "2 hours", volume: str | None = None) -> DataFrame:
    """(start, key, open, high, low, close, n, volume) of tumbling windows; of a stream, ticks later than ``late`` are left to the batch path.

    With ``late`` None a stream has no watermark: no tick is too late, in whatever order files come, and the state holds every window of the stream.
    Open and close are the first and last tick by (time, tiebreak). Null keys, times or prices do not count.
    """
    t = ticks.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(price).isNotNull())
    if t.isStreaming and late is not None:
        t = t.withWatermark(time, late)
    order = F.struct(time, tiebreak)
    total = F.sum(volume) if volume else F.lit(None).cast("double")
    bars = t.groupBy(F.window(time, width).alias("_w"), key).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("n"), (total if volume else F.max(F.lit(None).cast("double"))).alias("volume")
    )
    return bars.select(F.col("_w.start").alias("start"), key, "open", "high", "low", "close", "n", "volume")


def drain_to_store(bars: DataFrame, store: str, keys: Sequence[str], checkpoint: str | None = None, output_mode: str = "update", time: str = "start") -> None:
    """Run a stream over all that is there, upserting every micro-batch; a batch that is run again after a failure gives the same store.

    The store is partitioned by the day of ``time`` (column ``day``), so a micro-batch rewrites only the days it has bars of.
    """
    spark = bars.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        upsert(spark, store, batch.withColumn("day", F.to_date(time)), [*keys, "day"], ["day"])

    query = bars.writeStream.foreachBatch(put).outputMode(output_mode).option("checkpointLocation", checkpoint or new_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
