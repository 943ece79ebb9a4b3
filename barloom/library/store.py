"""A library of factor reports, kept as one parquet table keyed by factor_id."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.files import path_exists, recover, upsert, write_atomic

REPORT = (
    "factor_id string, name string, expression string, market string, universe string, start string, end string, ic double, icir double, rank_ic double, rank_icir double, half_life double, turnover double, long_short double, coverage double, codes array<string>, "
    "ic_by_horizon map<int,double>, saved_at timestamp_ntz"
)
SORTABLE = ("rank_icir", "icir", "rank_ic", "ic", "turnover", "long_short", "coverage", "saved_at")


class FactorLibrary:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        recover(self.spark, self.path)
        if not path_exists(self.spark, f"{self.path}/_SUCCESS"):
            return self.spark.createDataFrame([], REPORT)
        return self.spark.read.schema(REPORT).parquet(self.path)

    def save(self, reports: DataFrame) -> None:
        """Add reports; one with a known factor_id replaces the old one."""
        known = {f.name: f for f in self.spark.createDataFrame([], REPORT).schema}
        rows = reports.select(*[(F.col(n) if n in reports.columns else F.lit(None)).cast(f.dataType).alias(n) for n, f in known.items()])
        upsert(self.spark, self.path, rows.withColumn("saved_at", F.coalesce("saved_at", F.to_timestamp_ntz(F.date_format(F.now(), "yyyy-MM-dd HH:mm:ss")))), ["factor_id"], order=["saved_at"])

    def get(self, factor_id: str) -> dict | None:
        row = self.table().where(F.col("factor_id") == factor_id).first()
        return row.asDict(recursive=True) if row else None

    def list(self, *, market: str | None = None, universe: str | None = None, min_rank_icir: float | None = None, max_turnover: float | None = None, name_contains: str | None = None, sort: str = "rank_icir", limit: int | None = None, offset: int = 0) -> DataFrame:
        """Reports that meet every condition, best first; missing values last, ties by factor_id."""
        if sort not in SORTABLE:
            raise ValueError(f"sort must be one of {SORTABLE}")
        t = self.table()
        for condition in (
            market is not None and F.col("market") == market,
            universe is not None and F.col("universe") == universe,
            min_rank_icir is not None and F.col("rank_icir") >= min_rank_icir,
            max_turnover is not None and F.col("turnover") <= max_turnover,
            name_contains is not None and F.lower("name").contains(name_contains.lower()),
        ):
            if condition is not False:
                t = t.where(condition)
        t = t.orderBy(F.col(sort).desc_nulls_last(), "factor_id")
        t = t.offset(offset) if offset else t
        return t if limit is None else t.limit(limit)

    def delete(self, factor_id: str) -> bool:
        """Whether there was such a report."""
        if self.get(factor_id) is None:
            return False
        write_atomic(self.table().where(F.col("factor_id") != factor_id), self.path)
        return True


RUN = (
    "run_id string, name string, method string, factor_ids array<string>, weights map<string,double>, market string, universe string, start string, end string, ic double, icir double, rank_ic double, rank_icir double, saved_at timestamp_ntz"
)


def run_id(method: str, factor_ids, **settings) -> str:
    """A name for a combination run: the same factors, in any order, by the same method and settings have the same one."""
    text = json.dumps([method, sorted(factor_ids), sorted((k, str(v)) for k, v in settings.items())])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class CombinationStore:
    """Combination runs, kept as one parquet table keyed by run_id. ``lib:<factor_id>`` among the factors of a run names a report of a library."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self) -> DataFrame:
        recover(self.spark, self.path)
        if not path_exists(self.spark, f"{self.path}/_SUCCESS"):
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(self.path)

    def save(self, method: str, weights: dict[str, float], metrics: dict | None = None, *, name: str | None = None, market: str | None = None, universe: str | None = None, start: str | None = None, end: str | None = None) -> str:
        """Add a run, or replace the one of the same id; its id."""
        key = run_id(method, weights, market=market, universe=universe, start=start, end=end)
        m = metrics or {}
        row = (key, name or key, method, sorted(weights), {k: float(v) for k, v in weights.items()}, market, universe, start, end, *[m.get(k) for k in ("ic", "icir", "rank_ic", "rank_icir")], dt.datetime.now())
        upsert(self.spark, self.path, self.spark.createDataFrame([row], RUN), ["run_id"], order=["saved_at"])
        return key

    def get(self, key: str) -> dict | None:
        row = self.table().where(F.col("run_id") == key).first()
        return row.asDict(recursive=True) if row else None

    def list(self, *, market: str | None = None, method: str | None = None, uses: str | None = None, limit: int | None = None) -> DataFrame:
        """Runs that meet every condition, the latest first; ``uses`` names a factor they contain."""
        t = self.table()
        for condition in (market is not None and F.col("market") == market, method is not None and F.col("method") == method, uses is not None and F.array_contains("factor_ids", uses)):
            t = t if condition is False else t.where(condition)
        t = t.orderBy(F.desc("saved_at"), "run_id")
        return t if limit is None else t.limit(limit)

    def delete(self, key: str) -> bool:
        """Whether there was such a run."""
        if self.get(key) is None:
            return False
        write_atomic(self.table().where(F.col("run_id") != key), self.path)
        return True


def resolve(library: FactorLibrary, specs: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """(expressions, dropped): specs ``lib:<factor_id>`` replaced by the report's expression; unknown ones are dropped with the reason."""
    wanted = {k: v[4:].strip() for k, v in specs.items() if v.startswith("lib:")}
    known = {r.factor_id: r.expression for r in library.table().where(F.col("factor_id").isin(list(wanted.values()))).select("factor_id", "expression").collect()} if wanted else {}
    good = {k: known.get(wanted[k]) if k in wanted else v for k, v in specs.items()}
    return {k: v for k, v in good.items() if v}, {k: f"no report {wanted[k]}" for k, v in good.items() if not v}
