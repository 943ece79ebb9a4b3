"""Comparing factors: similarity, redundancy, pruning, heat maps, maps in the plane, lineage."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.evaluation.metrics import rank_ic_series
from barloom.functions.numeric import only_finite
from barloom.plans.expression import Apply, node_hash, parse, walk

#: Factors compared at once; the matrix has a row for each pair of them.
MAX_FACTORS = 2_000


def pairwise_similarity(long: DataFrame, by: str = "factor_id") -> DataFrame:
    """(a, b, similarity), a < b: mean over dates of Spearman over jointly finite cells; 0 where there is no date.

    Values of a cell are gathered to one row (as many as factors) and unfolded to pairs of factors, so cells meet by (date, symbol)
    once and no factor is joined with all others.
    """
    names = sorted(r[0] for r in long.select(by).distinct().limit(MAX_FACTORS + 1).collect())
    if len(names) > MAX_FACTORS:
        raise ValueError(f"more than {MAX_FACTORS} factors")
    cells = long.withColumn("value", only_finite(F.col("value"))).where("value is not null")
    rows = cells.groupBy("date", "symbol").agg(F.array_sort(F.collect_list(F.struct(by, "value"))).alias("v"))
    pairs = rows.select("date", "symbol", F.posexplode("v").alias("i", "x"), "v").select("date", "symbol", "x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("y"))
    pairs = pairs.select(F.col(f"x.{by}").alias("a"), F.col(f"y.{by}").alias("b"), "date", "symbol", F.col("x.value").alias("u"), F.col("y.value").alias("w"))
    means = rank_ic_series(pairs, "u", "w", ["a", "b"]).groupBy("a", "b").agg(F.avg("rank_ic").alias("s"))
    spark = long.sparkSession
    every = spark.createDataFrame([(x, y) for i, x in enumerate(names) for y in names[i + 1 :]], "a string, b string")
    return every.join(means, ["a", "b"], "left").select("a", "b", F.coalesce("s", F.lit(0.0)).alias("similarity"))


def redundancy(pairs: DataFrame) -> DataFrame:
    """(factor_id, redundancy, nearest): the largest absolute similarity of a factor and with whom; the first name wins ties."""
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    top = both.groupBy("a").agg(F.min(F.struct((-F.abs("similarity")).alias("s"), "b")).alias("m"))
    return top.select(F.col("a").alias("factor_id"), (-F.col("m.s")).alias("redundancy"), F.col("m.b").alias("nearest"))


def prune(pairs: DataFrame, scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(factor_id): the factors to drop. Of each pair at or above the threshold the lower score goes, on a tie the larger id."""
    s = scores.select("factor_id", F.coalesce("score", F.lit(float("-inf"))).alias("score"))
    near = pairs.where(F.abs("similarity") >= threshold)
    j = near.join(s.select(F.col("factor_id").alias("a"), F.col("score").alias("sa")), "a").join(s.select(F.col("factor_id").alias("b"), F.col("score").alias("sb")), "b")
    return j.select(F.when(F.col("sa") < F.col("sb"), F.col("a")).when(F.col("sb") < F.col("sa"), F.col("b")).otherwise(F.greatest("a", "b")).alias("factor_id")).distinct()


PERIODS = {"month": lambda d: F.date_format(d, "yyyy-MM"), "quarter": lambda d: F.concat(F.year(d), F.lit("-Q"), F.quarter(d)), "week": lambda d: F.concat(F.extract(F.lit("YEAROFWEEK"), d), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))}


def ic_heatmap(series: DataFrame, period: str = "month", value: str = "rank_ic", by: str = "factor_id") -> DataFrame:
    """(factor_id, period, value, n): mean coefficient by month, quarter or ISO week."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    return series.groupBy(by, PERIODS[period](F.col("date")).alias("period")).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def classical_mds(distance: np.ndarray, dims: int = 2) -> np.ndarray:
    """Points whose distances match ``distance`` best (Torgerson); missing directions are zero."""
    n = len(distance)
    if n == 0:
        return np.zeros((0, dims))
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (np.asarray(distance, float) ** 2) @ centre)
    top = np.argsort(values)[::-1][:dims]
    points = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
    return np.pad(points, ((0, 0), (0, dims - points.shape[1])))


def factor_map(pairs: DataFrame, n_clusters: int = 4, seed: int = 0) -> list[dict]:
    """Factors in the plane by one minus their absolute similarity, with clusters; a table of at most ``MAX_FACTORS`` factors."""
    rows = pairs.collect()
    names = sorted({x for r in rows for x in (r.a, r.b)})
    at = {x: i for i, x in enumerate(names)}
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for r in rows:
        d[at[r.a], at[r.b]] = d[at[r.b], at[r.a]] = 1 - abs(r.similarity)
    points, rng = classical_mds(d), np.random.default_rng(seed)
    k = min(n_clusters, len(names))
    label = np.zeros(len(names), int)
    if k > 1:
        centres = points[rng.choice(len(names), k, replace=False)]
        for _ in range(100):
            label = ((points[:, None] - centres) ** 2).sum(-1).argmin(1)
            fresh = np.array([points[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            if np.allclose(fresh, centres):
                break
            centres = fresh
    return [{"factor_id": x, "x": float(points[i, 0]), "y": float(points[i, 1]), "cluster": int(label[i])} for x, i in at.items()]


def lineage(factors: Mapping[str, str]) -> list[tuple[str, str]]:
    """(part, whole): factors whose whole tree stands inside another's, without edges that follow from others."""
    trees = {k: parse(e) for k, e in factors.items()}
    inside = {k: {node_hash(n) for n in walk(t) if isinstance(n, Apply)} for k, t in trees.items()}
    root = {k: node_hash(t) for k, t in trees.items()}
    contains = {(a, b) for a in trees for b in trees if root[a] != root[b] and root[a] in inside[b]}
    return sorted((a, b) for a, b in contains if not any((a, m) in contains and (m, b) in contains for m in trees))


def factor_id(expression: str) -> str:
    """Sixteen hex digits of the expression's tree: spellings of one tree share them."""
    return hashlib.sha256(str(parse(expression)).encode()).hexdigest()[:16]
