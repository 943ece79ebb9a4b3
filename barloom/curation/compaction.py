"""Far too many small files: packed reading, exact consolidation, staged and verified output."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.runtime import broadcast_if_small, conf, delete_path, new_path, stage

FIELDS = ("ticker", "window_start", "open", "high", "low", "close", "volume", "transactions")


def packing(n_files: int, n_bytes: int, target_bytes: int = 128 << 20) -> dict[str, str]:
    """Scan settings that pack small files into splits of about ``target_bytes``.

    The scan adds the open cost to every file before it packs. A cost near the mean file size keeps a
    split of tiny files from holding so many of them that opening dominates, while a split still fills up.
    """
    mean = max(1, n_bytes // max(1, n_files))
    return {"spark__sql__files__maxPartitionBytes": str(target_bytes), "spark__sql__files__openCostInBytes": str(min(4 << 20, max(4 << 10, mean)))}


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _content(spark: SparkSession, *paths: str) -> tuple[int, int]:
    """(files, bytes) under the paths."""
    found = [fs.getContentSummary(p) for p, fs in (_fs(spark, x) for x in paths)]
    return sum(c.getFileCount() for c in found), sum(c.getLength() for c in found)


def _checks(df: DataFrame) -> tuple:
    """Number and sum of hashes of all rows."""
    wide = "decimal(38,0)"
    return F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast(wide)), F.lit(0).cast(wide)).alias("h")


def _publish(df: DataFrame, out: str, n_out: int, fmt: str = "parquet", **options: str) -> int:
    """Write ``df`` as ``n_out`` files without a shuffle, counted and hashed on the way, and rename them to ``out`` if they read back the same."""
    spark, staging, seen = df.sparkSession, f"{out.rstrip('/')}.staging", Observation()
    delete_path(spark, staging)
    df.observe(seen, *_checks(df)).coalesce(n_out).write.format(fmt).options(**options).save(staging)
    again = spark.read.format(fmt).options(**options).schema(df.schema).load(staging)
    back = again.agg(*_checks(again)).first()
    if (back["n"], back["h"]) != (seen.get["n"], seen.get["h"]):
        delete_path(spark, staging)
        raise RuntimeError(f"{seen.get['n']} records read, {back['n']} written")
    path, fs = _fs(spark, staging)
    if not fs.rename(path, _fs(spark, out)[0]):
        raise RuntimeError(f"{staging} could not be renamed to {out}")
    return back["n"]


def consolidate_files(spark: SparkSession, source: str, out: str, fmt: str = "parquet", target_bytes: int = 128 << 20, **options: str) -> dict[str, int]:
    """Rewrite the many small files under ``source`` as few files of about ``target_bytes`` under ``out``.

    Splits are packed by the scan, then merged with ``coalesce`` (no shuffle: neighbouring splits go to one
    writer). The output is written to a staging folder beside ``out``, counted and hashed while it is
    written, read back, and renamed to ``out`` only if both agree; else it is removed and an error
    raised. No record is dropped or merged: repeated rows stay. An empty source gives an empty output.
    """
    n_files, n_bytes = _content(spark, source)
    n_out = max(1, math.ceil(n_bytes / target_bytes))
    with conf(spark, **packing(n_files, n_bytes, target_bytes)):
        records = _publish(spark.read.format(fmt).options(**options).load(source), out, n_out, fmt, **options)
    return {"files_in": n_files, "bytes_in": n_bytes, "files_out": n_out, "records": records}


def parse_day_files(files: DataFrame) -> DataFrame:
    """(file_id, line_no, the eight values): the complete records of the payloads, as values.

    Lines end with LF, CR LF or CR; ``line_no`` counts all of them from 1. The first line that is not blank is the
    header; it names the columns (any order and case) and shows the separator (semicolon, tab, bar, else comma). A record is
    complete if all eight values are there and read as what they are; anything else, such as a
    header alone, a blank or broken-off line, an unknown header or a null payload, gives no row. With a separator
    other than the comma, a comma inside a number is a decimal comma.
    """
    # A one-element explode is a border for the optimizer: what stands before it is computed once, not once per use.
    once = lambda x: F.explode(F.array(x))
    f = files.where("payload is not null and payload <> ''").select("file_id", once(F.split("payload", "\r\n|\n|\r")).alias("_lines"))
    # Mostly the first line is the header: only files that start blank are searched for it.
    header_at = F.when(F.trim(F.get("_lines", F.lit(0))) != "", 1).otherwise(F.array_position(F.transform("_lines", lambda s: F.trim(s) != ""), True).cast("int"))
    f = f.select("file_id", "_lines", header_at.alias("_h")).where("_h > 0 and size(_lines) > _h")
    f = f.select("file_id", "_lines", "_h", once(F.translate(F.lower(F.get("_lines", F.col("_h") - 1)), '"\ufeff', "")).alias("_head"))
    sep = F.when(F.col("_head").contains(";"), ";").when(F.col("_head").contains("\t"), "\t").when(F.col("_head").contains("|"), "|").otherwise(",")
    # A separator that is a constant is split without compiling a pattern for each line.
    cut = lambda text, by: F.when(by == ",", F.split(text, ",")).when(by == ";", F.split(text, ";")).when(by == "\t", F.split(text, "\t")).otherwise(F.split(text, "\\|"))
    f = f.withColumn("_sep", sep).select("file_id", "_lines", "_h", "_sep", once(F.transform(cut(F.col("_head"), F.col("_sep")), lambda s: F.trim(s))).alias("_names"))
    places = F.struct(*[F.array_position("_names", F.lit(n)).cast("int").alias(n) for n in FIELDS])
    f = f.select("file_id", "_lines", "_h", "_sep", F.size("_names").alias("_n"), once(places).alias("_at")).where(" and ".join(f"_at.{n} > 0" for n in FIELDS))
    f = f.select("file_id", "_h", "_sep", "_n", "_at", F.posexplode("_lines").alias("_no", "_line")).where("_no >= _h and trim(_line) <> ''")
    f = f.select("file_id", "_no", "_sep", "_n", "_at", once(cut(F.translate("_line", '"', ""), F.col("_sep"))).alias("_v")).where("size(_v) = _n")
    text = {n: F.trim(F.get("_v", F.col(f"_at.{n}") - 1)) for n in FIELDS}
    number = {n: F.when(F.col("_sep") == ",", s).otherwise(F.translate(s, ",", ".")) for n, s in text.items()}
    # Nanoseconds have 19 digits, more than a double holds.
    start = F.coalesce(number["window_start"].try_cast("bigint").cast("decimal(30,6)"), number["window_start"].try_cast("decimal(30,6)"))
    values = F.struct(F.when(text["ticker"] != "", F.upper(text["ticker"])).alias("ticker"), start.alias("window_start"), *[number[n].try_cast("double").alias(n) for n in FIELDS[2:]])
    f = f.select("file_id", (F.col("_no") + 1).cast("bigint").alias("line_no"), once(values).alias("_r")).where(" and ".join(f"_r.{n} is not null" for n in FIELDS))
    return f.select("file_id", "line_no", *[F.col(f"_r.{n}").alias(n) for n in FIELDS])


def consolidate_day_files(files: DataFrame, out: str | None = None, target_bytes: int = 32 << 20) -> DataFrame:
    """Every record of the tiny day files exactly once, in few well-sized files; returns them as read back.

    1. The scan packs its files into splits as :func:`packing` sets them, and lines become records without a shuffle; they are
       staged with a hash of 128 bits of their eight values.
    2. Repeats are found on hashes and places alone, combined before the shuffle, so a record delivered a million times is sent once
       per task. What comes out are the hashes that occur more than once with their earliest line.
    3. The staged records without the repeats are merged with ``coalesce`` (no shuffle) into files of about
       ``target_bytes``, counted and hashed while written, and published (renamed) only if what is read back agrees and as many rows
       as there are repeats are missing.

    ``out`` None writes into the shared folder. An empty table gives an empty output.
    """
    spark = files.sparkSession
    out = out or new_path(spark, "day-files")
    paths = files.inputFiles()
    n_files, n_bytes = _content(spark, *paths) if len(paths) <= 1_000 else (len(paths), int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    records = parse_day_files(files)
    # Zero has two signs, which are equal as values.
    value = [F.col(n) + F.lit(0.0) if n in FIELDS[2:] else F.col(n) for n in FIELDS]
    records = records.withColumns({"_h": F.xxhash64(*value), "_h2": F.xxhash64(F.lit("second"), *reversed(value))})
    parts = f"{out}.records"
    delete_path(spark, parts)
    with conf(spark, **packing(n_files, n_bytes)):
        records.write.parquet(parts)
    staged = spark.read.schema(records.schema).parquet(parts)
    counted = staged.groupBy("_h", "_h2").agg(F.min(F.struct("file_id", "line_no")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = stage(counted, "repeats")
    n_all, n_repeats = staged.count(), repeated.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n")).first().n
    # Hash, place and count: some 50 bytes a row, so at most 50 MB are broadcast; beyond that the join is shuffled, with skew split by the engine.
    once = staged.join(broadcast_if_small(repeated.select("_h", "_h2", "_first"), 1_000_000), ["_h", "_h2"], "left").where(F.col("_first").isNull() | (F.col("_first") == F.struct("file_id", "line_no")))
    once = once.select("file_id", "line_no", *FIELDS)
    n_out = max(1, math.ceil(_content(spark, parts)[1] / target_bytes))
    written = _publish(once, out, n_out)
    delete_path(spark, parts)
    if written != n_all - n_repeats:
        delete_path(spark, out)
        raise RuntimeError(f"{n_all} records with {n_repeats} repeats, {written} written")
    return spark.read.schema(once.schema).parquet(out)
