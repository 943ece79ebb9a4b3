"""Subexpressions that factors share, and evaluation of whole libraries in bounded plans."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.compiler import compile_factors, evaluate_long
from barloom.plans.expression import Apply, ExpressionError, Field, node_hash, parse, size, walk
from barloom.plans.panel import densify
from barloom.runtime import new_path, stage
from barloom.sources.files import path_exists, recover, upsert, write_atomic


def common_subexpressions(expressions: Sequence[str], least: int = 2) -> list[dict]:
    """Shared subtrees: how often they stand, in how many factors, how large they are, and what sharing saves (count * (nodes - 1)).

    Best first, ties by size, then hash. Malformed expressions are left out.
    """
    count, where, node_of = Counter(), Counter(), {}
    for e in expressions:
        try:
            tree = parse(e)
        except ExpressionError:
            continue
        own = Counter(node_hash(n) for n in walk(tree) if isinstance(n, Apply))
        node_of.update({node_hash(n): n for n in walk(tree) if isinstance(n, Apply)})
        count.update(own)
        where.update(own.keys())
    found = [{"hash": h, "expression": str(node_of[h]), "count": n, "n_factors": where[h], "nodes": size(node_of[h]), "score": n * (size(node_of[h]) - 1)} for h, n in count.items() if n >= least]
    return sorted(found, key=lambda x: (-x["score"], -x["nodes"], x["hash"]))


def batches(factors: Mapping[str, str], max_nodes: int = 160) -> list[dict[str, str]]:
    """Factors in groups of up to ``max_nodes`` distinct subtrees, so that no plan grows beyond what the optimizer takes well.

    Factors that share most with the group come next, by a greedy choice over hashes.
    """
    trees = {k: {node_hash(n) for n in walk(parse(e)) if isinstance(n, Apply)} for k, e in factors.items()}
    left, out = dict(factors), []
    while left:
        name = next(iter(left))
        group, seen = {name: left.pop(name)}, set(trees[name])
        while left:
            best = min(left, key=lambda k: (len(trees[k] - seen), -len(trees[k] & seen)))
            if len(seen | trees[best]) > max_nodes:
                break
            seen |= trees[best]
            group[best] = left.pop(best)
        out.append(group)
    return out


def evaluate_library(panel: DataFrame, factors: Mapping[str, str], groups: DataFrame | None = None, *, max_nodes: int = 160) -> DataFrame:
    """(factor_id, symbol, date, value) of any number of factors: one plan a batch over a panel that is made dense once."""
    fields = sorted({n.name for e in factors.values() for n in walk(parse(e)) if isinstance(n, Field)})
    dense = stage(densify(panel, fields), "panel")
    parts = [evaluate_long(dense, b, groups, dense=True) for b in batches(factors, max_nodes)]
    return reduce(DataFrame.unionByName, parts)


def panel_fingerprint(panel: DataFrame, fields: Sequence[str], **context: str) -> str:
    """Sixteen hex digits of a panel's content and of the context it was read in (adjustment, as-of, groups): equal keys mean equal results."""
    digest = F.sum(F.xxhash64("symbol", "date", *fields).cast("decimal(38,0)"))
    r = panel.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("a"), F.max("date").alias("b"), F.countDistinct("symbol").alias("s"), digest.alias("h")).first()
    text = "|".join(map(str, [r.n, r.a, r.b, r.s, r.h, *fields, *sorted(context.items())]))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


MANIFEST = "fingerprint string, hash string, expression string, data_latest string, saved_at timestamp_ntz"


class PrecomputeStore:
    """Factor results kept as parquet under (structure hash, panel fingerprint), in a folder that all executors share."""

    def __init__(self, spark, root: str | None = None):
        self.spark, self.root = spark, root or new_path(spark, "precompute")

    def path(self, expression: str, fingerprint: str) -> str:
        return f"{self.root}/{fingerprint}/{node_hash(parse(expression))}"

    def get(self, expression: str, fingerprint: str) -> DataFrame | None:
        path = self.path(expression, fingerprint)
        return self.spark.read.schema("symbol string, date date, value double").parquet(path) if path_exists(self.spark, f"{path}/_SUCCESS") else None

    def put(self, expression: str, fingerprint: str, values: DataFrame, data_latest: str | None = None) -> None:
        """Keep (symbol, date, value) of a factor and name it in the manifest."""
        write_atomic(values.select("symbol", "date", F.col("value").cast("double").alias("value")), self.path(expression, fingerprint))
        self._note([(fingerprint, node_hash(parse(expression)), expression, data_latest)])

    def _note(self, rows: list[tuple]) -> None:
        now = dt.datetime.now()
        upsert(self.spark, f"{self.root}/manifest", self.spark.createDataFrame([(*r, now) for r in rows], MANIFEST), ["fingerprint", "hash"], order=["saved_at"])

    def entries(self, fingerprint: str | None = None) -> DataFrame:
        """(fingerprint, hash, expression, data_latest, saved_at) of what is kept."""
        path = f"{self.root}/manifest"
        recover(self.spark, path)
        t = self.spark.read.schema(MANIFEST).parquet(path) if path_exists(self.spark, f"{path}/_SUCCESS") else self.spark.createDataFrame([], MANIFEST)
        return t if fingerprint is None else t.where(F.col("fingerprint") == fingerprint)

    def stats(self) -> DataFrame:
        """(fingerprint, n_entries, data_latest, saved_at): one row a panel."""
        return self.entries().groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_entries"), F.max("data_latest").alias("data_latest"), F.max("saved_at").alias("saved_at"))

    def fresh(self, fingerprint: str, data_latest: str) -> bool:
        """Whether something is kept for the panel and all of it is from data up to ``data_latest``."""
        r = self.entries(fingerprint).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("data_latest").eqNullSafe(F.lit(data_latest))).alias("old")).first()
        return r.n > 0 and r.old == 0

    def evaluate(self, panel: DataFrame, factors: Mapping[str, str], fingerprint: str, groups: DataFrame | None = None, *, data_latest: str | None = None, max_nodes: int = 160) -> DataFrame:
        """Like :func:`evaluate_library`; what is stored is read, the rest computed in batches of related factors and stored."""
        missing = {k: e for k, e in factors.items() if self.get(e, fingerprint) is None}
        for batch in batches(missing, max_nodes) if missing else []:
            held = stage(compile_factors(panel, batch, groups).frame, "precomputed")
            for k, e in batch.items():
                write_atomic(held.select("symbol", "date", F.col(k).alias("value")), self.path(e, fingerprint))
            self._note([(fingerprint, node_hash(parse(e)), e, data_latest) for e in batch.values()])
        parts = [self.get(e, fingerprint).select(F.lit(k).alias("factor_id"), "symbol", "date", "value") for k, e in factors.items()]
        return reduce(DataFrame.unionByName, parts)


class FactorCache:
    """Results by what was asked: expression, universe, period, adjustment and market, without looking at the panel."""

    def __init__(self, store: PrecomputeStore):
        self.store = store

    @staticmethod
    def key(universe: str, start: str, end: str, adj: str = "split", market: str = "") -> str:
        text = "|".join((universe.strip().upper(), str(start), str(end), adj, market.strip().upper()))
        return hashlib.sha256(text.encode()).hexdigest()[:16]

    def get(self, expression: str, *context: str) -> DataFrame | None:
        return self.store.get(expression, self.key(*context))

    def put(self, expression: str, values: DataFrame, *context: str) -> None:
        self.store.put(expression, self.key(*context), values)
