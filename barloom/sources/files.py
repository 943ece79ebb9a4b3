"""Reading delivered files and keeping the stores: day aggregates, JSON lines, compressed CSV, upserts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.runtime import broadcast_if_small, delete_path, norm_key

DAY_AGG = "ticker string, volume long, open double, close double, high double, low double, window_start long, transactions long"
SPLITS = "id string, execution_date string, split_from double, split_to double, ticker string, adjustment_type string, historical_adjustment_factor double"
DIVIDENDS = "id string, ticker string, record_date string, pay_date string, ex_dividend_date string, declaration_date string, frequency long, cash_amount double, currency string, distribution_type string"
PRICES = "date date, symbol string, open float, high float, low float, close float, volume float, transactions long, as_of_date date, source_id string"
EVENTS = "symbol string, ex_date date, as_of_date date, event_type string, split_ratio double, dividend_cash double, provider_adj_factor double, event_id string, source string"
SNAPSHOTS = "index_id string, effective_date date, symbols array<string>, as_of_date date"
STATUS = "date date, symbol string, up_limit double, down_limit double, limit_up_locked boolean, limit_down_locked boolean, close double, as_of_date date"
GROUPS = "symbol string, group string, as_of_date date"


def session_date(ns: F.Column, zone: str = "America/New_York") -> F.Column:
    """The trading day of a bar that starts ``ns`` nanoseconds after the epoch."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.floor(ns / 1000)), zone))


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Raw day aggregates with the path of their file in ``_path``."""
    if fmt == "csv":
        # The header names the columns, in any order; types come from the schema.
        raw = spark.read.option("header", True).csv(path)
        return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(DAY_AGG)], F.col("_metadata.file_path").alias("_path"))
    return spark.read.schema(DAY_AGG).format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("_path"))


def read_day_aggregates(spark: SparkSession, path: str, fmt: str = "parquet", symbols: Sequence[str] | None = None) -> DataFrame:
    """Raw day aggregates under ``path`` as price rows; CSV may be compressed. Only the eight known columns are read."""
    raw = read_raw(spark, path, fmt)
    if symbols is not None:
        raw = raw.where(norm_key(F.col("ticker")).isin([s.strip().upper() for s in symbols]))
    return normalize_day_aggregates(raw)


def normalize_day_aggregates(raw: DataFrame) -> DataFrame:
    """Price rows: the day in the market's zone, known on that day, with the file as its source."""
    day = session_date(F.col("window_start"))
    return raw.select(
        day.alias("date"), norm_key(F.col("ticker")).alias("symbol"), *[F.col(c).cast("float").alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("transactions").cast("long").alias("transactions"), day.alias("as_of_date"), F.col("_path").alias("source_id"),
    )


def dated_files(spark: SparkSession, folder: str, start, end) -> list[str]:
    """The files and folders below ``folder`` whose name holds a date (yyyy-mm-dd) of the range, in order of date and name; a bounded listing of days."""
    make, fs = _fs(spark, folder)
    found, todo = [], [folder.rstrip("/")]
    while todo:
        at = todo.pop()
        for x in fs.listStatus(make(at)) if fs.exists(make(at)) else []:
            name = x.getPath().getName()
            if m := re.search(r"\d{4}-\d{2}-\d{2}", name):
                if str(start) <= m[0] <= str(end):
                    found.append((m[0], f"{at}/{name}"))
            elif x.isDirectory():
                todo.append(f"{at}/{name}")
    return [p for _, p in sorted(found)]


def day_files_to_parquet(spark: SparkSession, source: str, out: str, start, end) -> int:
    """Compressed CSV day files of a date range as one parquet store of raw day aggregates, partitioned by day; how many files were read.

    Each file becomes the partition of its day; days outside the range stay as they are, so it can be run day after day.
    """
    paths = dated_files(spark, source, start, end)
    if paths:
        raw = read_raw(spark, paths, "csv")
        write_atomic(raw.withColumn("day", F.regexp_extract("_path", r"(\d{4}-\d{2}-\d{2})", 1)).drop("_path"), out, ["day"])
    return len(paths)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, *, day: str | None = None, start=None, end=None, tickers: Sequence[str] | None = None) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped. ``tickers`` and a range on the text column ``day`` (yyyy-mm-dd) are filtered while reading."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if day is not None and start is not None:
        rows = rows.where(F.col(day) >= str(start))
    if day is not None and end is not None:
        rows = rows.where(F.col(day) <= str(end))
    return rows if tickers is None else rows.where(norm_key(F.col("ticker")).isin([t.strip().upper() for t in tickers]))


def split_events(raw: DataFrame, source: str = "splits") -> DataFrame:
    """Event rows of raw splits: ratio = to / from, known on the day of execution."""
    ex, ratio = F.col("execution_date").try_cast("date"), F.when(F.col("split_from") > 0, F.col("split_to") / F.when(F.col("split_from") > 0, F.col("split_from")))
    key = F.coalesce("id", F.concat_ws("|", F.lit("split"), "ticker", "execution_date", "split_from", "split_to"))
    return raw.select(
        norm_key(F.col("ticker")).alias("symbol"), ex.alias("ex_date"), ex.alias("as_of_date"), F.coalesce("adjustment_type", F.lit("split")).alias("event_type"), ratio.alias("split_ratio"), F.lit(0.0).alias("dividend_cash"),
        F.col("historical_adjustment_factor").alias("provider_adj_factor"), key.alias("event_id"), F.lit(source).alias("source"),
    )


def dividend_events(raw: DataFrame, source: str = "dividends") -> DataFrame:
    """Event rows of raw dividends: known when declared, else on the ex-date."""
    ex = F.col("ex_dividend_date").try_cast("date")
    key = F.coalesce("id", F.concat_ws("|", F.lit("dividend"), "ticker", "ex_dividend_date", "cash_amount"))
    return raw.select(
        norm_key(F.col("ticker")).alias("symbol"), ex.alias("ex_date"), F.coalesce(F.col("declaration_date").try_cast("date"), ex).alias("as_of_date"), F.lit("dividend").alias("event_type"), F.lit(1.0).alias("split_ratio"),
        F.col("cash_amount").alias("dividend_cash"), F.lit(None).cast("double").alias("provider_adj_factor"), key.alias("event_id"), F.lit(source).alias("source"),
    )


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes last in ``order`` (nulls first). Combined before the shuffle, so a key with many rows is no hot group."""
    rest = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return rows.groupBy(*keys).agg(top.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    return jvm.Path, jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _leaves(fs, path, folder: str, depth: int) -> list[str]:
    """The partition folders ``depth`` levels below ``folder``, relative to it."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{x.getPath().getName()}".lstrip("/") for f in found for x in fs.listStatus(path(f"{folder}/{f}" if f else folder)) if x.isDirectory() and "=" in x.getPath().getName()]
    return found


def recover(spark: SparkSession, path: str, depth: int = 0) -> None:
    """Put back what a swap that broke off had moved aside and not replaced; without such a swap nothing happens."""
    path = path.rstrip("/")
    make, fs = _fs(spark, path)
    old = f"{path}.old"
    if not fs.exists(make(old)):
        return
    for leaf in _leaves(fs, make, old, depth):
        place = make(f"{path}/{leaf}".rstrip("/"))
        if not fs.exists(place):
            fs.mkdirs(place.getParent())
            fs.rename(make(f"{old}/{leaf}".rstrip("/")), place)
    fs.delete(make(old), True)


def swap(spark: SparkSession, path: str, staging: str, depth: int = 0) -> None:
    """Replace ``path``, or those of its partition folders ``depth`` levels down that ``staging`` has, by the staged ones.

    Only renames: at every moment each folder is whole, either old or new, and the old one is there (aside) until the new one is in place. If it
    breaks off, :func:`recover` puts back what is missing, and the same upsert done again gives the same store.
    """
    path = path.rstrip("/")
    make, fs = _fs(spark, path)
    old = f"{path}.old"
    for leaf in _leaves(fs, make, staging, depth):
        place, aside = make(f"{path}/{leaf}".rstrip("/")), make(f"{old}/{leaf}".rstrip("/"))
        if fs.exists(place):
            fs.mkdirs(aside.getParent())
            if not fs.rename(place, aside):
                raise OSError(f"{place} could not be moved aside")
        fs.mkdirs(place.getParent())
        if not fs.rename(make(f"{staging}/{leaf}".rstrip("/")), place):
            raise OSError(f"{place} could not be put in place")
    fs.delete(make(old), True)
    fs.delete(make(staging), True)


def write_atomic(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` beside ``path`` and rename it into place once it is whole; partitions that it does not have stay as they are."""
    spark, staging = df.sparkSession, f"{path.rstrip('/')}.staging"
    recover(spark, path, len(partition_by))
    delete_path(spark, staging)
    out = df.repartition(*partition_by) if partition_by else df
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
    swap(spark, path, staging, len(partition_by))


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition_by: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """Put ``new`` into the store at ``path``; a new row replaces an old one of the same key, the last in ``order`` counts among new ones.

    A differing set of columns raises. Partitions that ``new`` does not touch are not read and not written; the others are written beside the
    store and swapped in by renames (:func:`swap`), so a job that dies leaves every partition whole, and running it again completes it.
    """
    recover(spark, path, len(partition_by))
    rows = new.withColumn("_new", F.lit(1))
    if path_exists(spark, path):
        old = spark.read.parquet(path)
        if set(old.columns) != set(new.columns):
            raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
        if partition_by:
            old = old.join(broadcast_if_small(new.select(*partition_by).distinct()), list(partition_by), "left_semi")
        rows = rows.unionByName(old.select(*new.columns).withColumn("_new", F.lit(0)))
    write_atomic(latest(rows, keys, ["_new", *order]).drop("_new"), path, partition_by)


def ingest_prices(spark: SparkSession, store: str, prices: DataFrame, market: str = "US") -> None:
    """Upsert price rows by (date, symbol) into the store's market, year and month."""
    rows = prices.withColumns({"market": F.lit(market), "year": F.year("date"), "month": F.month("date")})
    upsert(spark, store, rows, ["date", "symbol", "market", "year", "month"], ["market", "year", "month"], ["as_of_date"])


def trade_status(bars: DataFrame, limits: DataFrame, tolerance: float = 0.999) -> DataFrame:
    """Price limits with marks for closes locked at them (within ``tolerance``), known on the day itself."""
    j = limits.join(bars.select("date", "symbol", F.col("close").cast("double").alias("close")), ["date", "symbol"], "left")
    up = F.coalesce((F.col("up_limit") > 0) & (F.col("close") >= F.col("up_limit") * tolerance), F.lit(False))
    down = F.coalesce((F.col("down_limit") > 0) & (F.col("close") * tolerance <= F.col("down_limit")), F.lit(False))
    return j.select("date", "symbol", "up_limit", "down_limit", up.alias("limit_up_locked"), down.alias("limit_down_locked"), "close", F.col("date").alias("as_of_date"))


def ingest_universe(spark: SparkSession, store: str, snapshots: DataFrame) -> None:
    """Upsert index compositions by (index_id, effective_date, as_of_date); ids are trimmed and upper-cased, rows without a date or members left out."""
    rows = snapshots.where("index_id is not null and effective_date is not null and symbols is not null").select(norm_key(F.col("index_id")).alias("index_id"), "effective_date", "symbols", F.coalesce("as_of_date", "effective_date").alias("as_of_date"))
    upsert(spark, store, rows, ["index_id", "effective_date", "as_of_date"])


def composition_rows(weights: DataFrame, index: str, as_of: str | None = None) -> DataFrame:
    """Snapshot rows of one index from rows (con_code, trade_date as yyyymmdd text): the members of each date; known on that date unless ``as_of`` says."""
    day = F.to_date(F.try_to_date("trade_date", "yyyyMMdd"))
    rows = weights.where(F.col("con_code").isNotNull()).groupBy(day.alias("effective_date")).agg(F.array_sort(F.collect_set(norm_key(F.col("con_code")))).alias("symbols")).where("effective_date is not null")
    return rows.select(F.lit(index.strip().upper()).alias("index_id"), "effective_date", "symbols", (F.lit(as_of).cast("date") if as_of else F.col("effective_date")).alias("as_of_date"))


def adjustment_events(factors: DataFrame, source: str = "factors") -> DataFrame:
    """Split events from a series of cumulated adjustment factors (symbol, date, factor): one on each date at which the factor changes, with their ratio.

    Null, zero and negative factors are passed over; the first factor of a symbol is no event.
    """
    own = Window.partitionBy("symbol").orderBy("date")
    f = factors.where("factor > 0 and date is not null").select(norm_key(F.col("symbol")).alias("symbol"), "date", "factor").where("symbol is not null")
    f = f.groupBy("symbol", "date").agg(F.max("factor").alias("factor")).withColumn("_before", F.lag("factor").over(own)).where(F.abs(F.col("factor") / F.col("_before") - 1) > 1e-9)
    return f.select("symbol", F.col("date").alias("ex_date"), F.col("date").alias("as_of_date"), F.lit("adjustment").alias("event_type"), (F.col("factor") / F.col("_before")).alias("split_ratio"), F.lit(0.0).alias("dividend_cash"),
                    F.col("factor").alias("provider_adj_factor"), F.concat_ws("|", F.lit("factor"), "symbol", F.col("date").cast("string")).alias("event_id"), F.lit(source).alias("source"))
