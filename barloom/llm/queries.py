"""Queries of the operators on texts. None has an SQL twin: they are tested against brute force and held-out grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.leakage import leaked_items
from barloom.llm.packing import pack_texts
from barloom.llm.reading_level import reading_levels
from barloom.runtime import table


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels")).select("doc_id", "band").distinct()


QUERIES = {f.__name__: f for f in (p8_pack, p9_found, p10_found)}
ORACLES: dict[str, str] = {}
