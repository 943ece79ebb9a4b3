"""Session-level helpers: the shared folder, staged tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of short rows is broadcast; 200,000 rows of some 60 bytes are about 12 MB.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on one
    machine) a temporary folder is made and remembered in the session's own settings.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    own = spark.conf.get("spark.barloom.sharedDir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.barloom.sharedDir", own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/barloom-{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, and the copy survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; it stops reading soon after the bound. For results that are cheap to compute twice."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the count proves the bound, else ``df`` as it is (a shuffled join)."""
    return F.broadcast(df) if is_small(df, rows) else df


def staged_small(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """:func:`stage`, then a broadcast hint if the count proves the bound: for results too dear to compute for a count and again."""
    return broadcast_if_small(stage(df, label), rows)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; a table read in enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class conf:
    """Set session options for the length of a ``with`` block (actions inside see them)."""

    def __init__(self, spark: SparkSession, **options: str):
        self.spark, self.options = spark, {k.replace("__", "."): v for k, v in options.items()}

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.options}
        for k, v in self.options.items():
            self.spark.conf.set(k, v)
        return self

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def norm_key(column) -> F.Column:
    """Symbols and index ids are equal when they agree after trimming and upper-casing."""
    return F.upper(F.trim(column))
