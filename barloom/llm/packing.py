"""Filling containers of fixed capacity with whole texts: minimum bin slack over the lengths.

Texts of equal length are interchangeable, and there are no more lengths than the capacity. So the packing
itself is found on the histogram of lengths, whose size does not depend on the number of texts:

* the longest remaining length opens a container, and a bitset subset-sum over the remaining lengths finds
  the fullest way to complete it;
* that pattern is repeated as often as the counts allow, and removed.

Texts are then numbered within their length (in buckets, so a frequent length is no hot group) and find
their container by looking up the pattern that covers their number.
"""

from __future__ import annotations

import base64
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.runtime import spread, stage

#: Split pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_loaded: dict = {}


def encoder(path: str):
    """The tokenizer in the vocabulary file at ``path``, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """How many of which lengths fill ``room`` best: subset sums as bits of one number, longest lengths first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of containers, count by length) of every pattern; all texts of the histogram are placed."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError("lengths must lie between 1 and the capacity")
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        top = lengths[0]
        counts[top] -= 1
        rest = {length: n for length, n in counts.items() if n > 0}
        use = fullest(capacity - top, [x for x in lengths if x in rest], rest)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(counts[length] // n for length, n in use.items())
        for length, n in use.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
        out.append((times, use))
    return out


def pack_texts(documents: DataFrame, *, capacity: int = 2048, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", items_per_bucket: int = 200_000) -> DataFrame:
    """(doc_id, part, first_token, n_tokens, container_id): the container of every text, or of every part of a longer one.

    A text of up to ``capacity`` tokens is one item; a longer one is cut into parts of ``capacity`` tokens and a rest, and only
    those. Containers are numbered from 0 without gaps. Empty and null texts have no tokens and stand in container 0; null ids are
    kept like any other. Repeated documents are items of their own. Whole texts are tokenized. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "_n": [len(encode(t)) for t in b["_text"]]})

    whole = docs.mapInPandas(count, f"doc_id {kind}, _n long")
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity).cast("int") - 1, F.lit(0))))
    items = whole.select("doc_id", "_n", parts.alias("part")).select(
        "doc_id", "part", (F.col("part") * F.lit(capacity)).cast("long").alias("first_token"), F.least(F.col("_n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("n_tokens")
    )
    items = stage(items, "pack-items")
    # At most capacity + 1 rows.
    histogram = {r.n_tokens: r["count"] for r in items.groupBy("n_tokens").count().collect()}
    n_items = sum(histogram.values())
    histogram.pop(0, None)
    rows, start, first = [], dict.fromkeys(histogram, 0), 0
    for times, use in patterns(histogram, capacity):
        for length, n in use.items():
            rows.append((length, start[length], start[length] + times * n, n, first))
            start[length] += times * n
        first += times
    table = spark.createDataFrame(rows, "n_tokens int, _from long, _to long, _each int, _first long")
    n_buckets = max(1, math.ceil(n_items / items_per_bucket))
    items = items.withColumn("_b", F.pmod(F.xxhash64("doc_id", "part"), F.lit(n_buckets)).cast("int"))
    offsets = items.groupBy("n_tokens", "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_offset", F.coalesce(F.sum("_c").over(Window.partitionBy("n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    if n_buckets == 1:
        offsets = F.broadcast(offsets)  # at most capacity + 1 rows
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy("n_tokens", "_b").orderBy("doc_id", "part")) - 1).join(offsets, ["n_tokens", "_b"]).withColumn("_r", F.col("_r") + F.col("_offset"))
    # The patterns' table is bounded by the number of lengths, not of texts.
    found = ranked.join(F.broadcast(table), (ranked["n_tokens"] == table["n_tokens"]) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")), "left")
    container = F.when(ranked["n_tokens"] == 0, F.lit(0)).otherwise(F.col("_first") + F.floor((F.col("_r") - F.col("_from")) / F.col("_each")))
    return found.select("doc_id", "part", "first_token", ranked["n_tokens"].alias("n_tokens"), container.cast("long").alias("container_id"))
