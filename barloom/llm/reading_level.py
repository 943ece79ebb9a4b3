"""Reading level of each document: harmonic propagation of graded examples over a document-word graph.

Documents and words are the two sides of a weighted graph (weight: root of the word's count). Graded documents
are clamped to their grade. A word's level is the mean of its documents' levels; a document's level the mean
of its words' levels, where a word counts by the inverse of the spread of levels it occurs at. The two
means alternate until the words' levels stand still.

Words are hashed into a fixed number of buckets, so the words' side is a pair of arrays of known size, which every
task holds; the documents' side stays distributed and is read once an iteration. Only sums by bucket are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.language import Language, fit_language, letter_words
from barloom.llm.text import Memo, plain
from barloom.runtime import broadcast_if_small, spread, stage

BUCKETS = 1 << 18
#: Words of documents looked at together.
CHUNK_WORDS = 300_000


class Chunks:
    """What is known of each stretch between blanks, by its number: arrays that grow with the stretches seen."""

    def __init__(self, language: Language, buckets: int):
        self.language, self.buckets = language, buckets
        self.number = Memo(self._add)
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.facts, self.codes = [], []

    def _add(self, chunk: str) -> int:
        ws = letter_words(chunk)
        words = [w.lower() for w in ws]
        scored = [self.language.score(w) for w in words]
        name = bool(ws) and ws[0][0].isupper() and not ws[0][1:].isupper()
        self.facts.append((any(c.isalnum() for c in chunk), sum(s for s, _ in scored), sum(n for _, n in scored), name, len(words)))
        self.codes.extend(zlib.crc32(w.encode()) % self.buckets for w in words)
        return len(self.facts) - 1

    def rows(self, ids: list, parts: list[np.ndarray], min_words: int):
        """(document, words, weights) of the English documents of ``min_words`` stretches or more with a letter or digit."""
        facts = np.array(self.facts, float)
        codes, start = np.array(self.codes, np.int32), np.r_[0, np.cumsum(facts[:, 4]).astype(int)]
        size = np.array([len(x) for x in parts])
        at, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
        total = lambda x: np.bincount(doc, x, len(parts))
        score, letters, own = facts[at, 1], facts[at, 2], 1 - facts[at, 3]
        english = self.language.holds(total(score), total(letters), total(score * own), total(letters * own))
        good = (total(facts[at, 0]) >= min_words) & english
        kept = good[doc]
        at, doc = at[kept], doc[kept]
        n = start[at + 1] - start[at]
        word = codes[np.repeat(start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        pair, count = np.unique(np.repeat(doc, n).astype(np.int64) * self.buckets + word, return_counts=True)
        end = np.searchsorted(pair, (np.arange(len(parts)) + 1) * np.int64(self.buckets))
        words, weights, last = (pair % self.buckets).astype(np.int32), np.sqrt(count).astype(np.float32), 0
        for k, e in enumerate(end):
            if good[k]:
                yield ids[k], words[last:e], weights[last:e]
            last = e


def graph_rows(ids, texts, min_words: int, known: Chunks):
    some, parts, size = [], [], 0
    for doc, text in zip(ids, texts):
        x = np.fromiter(map(known.number.__getitem__, plain(text).split()), np.int32)
        some.append(doc)
        parts.append(x)
        size += len(x)
        if size > CHUNK_WORDS:
            yield from known.rows(some, parts, min_words)
            some, parts, size = [], [], 0
            if len(known.facts) > 300_000:
                known.clear()
    if some:
        yield from known.rows(some, parts, min_words)


def _flat(b: pd.DataFrame):
    """The edges of a batch: document place, word, weight."""
    size = b["words"].map(len).to_numpy()
    if not len(size) or not size.sum():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.repeat(np.arange(len(b)), size), np.concatenate(b["words"].to_numpy()), np.concatenate(b["weights"].to_numpy()).astype(float)


def document_levels(b: pd.DataFrame, level: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """A document's level: the mean level of its words by weight and trust; NaN if no word of it has a level."""
    doc, word, weight = _flat(b)
    w = weight * trust[word]
    top, low = np.bincount(doc, w * level[word], len(b)), np.bincount(doc, w, len(b))
    return np.where(low > 0, top / np.where(low > 0, low, 1), np.nan)


def word_sums(b: pd.DataFrame, score: np.ndarray, sure: np.ndarray, buckets: int) -> np.ndarray:
    doc, word, weight = _flat(b)
    w = weight * sure[doc]
    s = np.nan_to_num(score)[doc]
    return np.vstack([np.bincount(word, w, buckets), np.bincount(word, w * s, buckets), np.bincount(word, w * s * s, buckets)])


def words_from_sums(sums: np.ndarray, mean: float, variance: float, floor: float = 0.05):
    """Level and trust of each word; a word seen little leans to the mean and to the whole variance."""
    n = sums[0] + 1.0
    level = (sums[1] + mean) / n
    var = np.maximum((sums[2] + mean * mean + variance) / n - level * level, 0.0)
    return level, np.where(sums[0] > 0, 1.0 / (var + floor), 0.0)


def weighted_median(x: np.ndarray, weights: np.ndarray) -> float:
    """The median of ``x`` with each value repeated ``weights`` (whole numbers) times; NaN without any."""
    order = np.argsort(x, kind="stable")
    x, upto = x[order], np.cumsum(weights[order])
    n = int(upto[-1]) if len(upto) else 0
    return float((x[np.searchsorted(upto, (n - 1) // 2, "right")] + x[np.searchsorted(upto, n // 2, "right")]) / 2) if n else np.nan


def cut_points(grades: np.ndarray, levels: np.ndarray, density: np.ndarray, edges: np.ndarray, bands: int, counts: np.ndarray | None = None) -> list[float]:
    """Where one band ends and the next begins: the emptiest place between their middles, weighed with the graded documents on the wrong side.

    ``counts``: how many graded documents each of ``grades`` and ``levels`` stands for; one if not given.
    """
    counts = np.ones(len(grades), np.int64) if counts is None else counts
    mids = [weighted_median(levels[grades == b], counts[grades == b]) for b in range(1, bands + 1)]
    known = [b for b in range(bands) if not np.isnan(mids[b])]
    if not known:
        return [b + 0.5 for b in range(1, bands)]
    mids = np.maximum.accumulate(np.interp(np.arange(bands), known, [mids[b] for b in known]))
    centre = (edges[:-1] + edges[1:]) / 2
    smooth = np.convolve(density, np.ones(5) / 5, "same")
    cuts = []
    for b in range(bands - 1):
        inside = np.flatnonzero((centre > mids[b]) & (centre < mids[b + 1]))
        if not len(inside):
            cuts.append(float((mids[b] + mids[b + 1]) / 2))
            continue
        near = (grades == b + 1) | (grades == b + 2)
        wrong = np.array([np.average((levels[near] > c) != (grades[near] > b + 1), weights=counts[near]) if near.any() else 0.0 for c in centre[inside]])
        cost = wrong + 0.5 * smooth[inside] / max(smooth[inside].max(), 1e-9)
        low = inside[cost <= cost.min() + 1e-9]
        cuts.append(float(centre[low].mean()))
    return cuts


def reading_levels(
    documents: DataFrame, grades: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "band", bands: int = 4, min_words: int = 20, iterations: int = 8, tolerance: float = 0.002, buckets: int = BUCKETS, lang: str = "lang"
) -> DataFrame:
    """(doc_id, level, band): the continuous level and the band (1 to ``bands``) of every English text of ``min_words`` words or more.

    ``grades``: any number of ratings per document; null ones and ones outside the bands are ignored, several are averaged. A
    graded document is clamped while levels spread; its own result comes from its words like any other's, as
    single ratings are noisy. Without usable grades the result is empty. Null texts and ids, texts in other
    languages (see :func:`barloom.llm.language.fit_language`; it learns English from every text that column ``lang`` calls English, or
    from all if there are none) and shorter texts give no row; repeated documents a row each. Whole texts are read. A text none of whose
    words occur elsewhere gets the mean level. Extra columns are not looked at.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("_text")).where("doc is not null and _text is not null"))
    id_type = docs.schema["doc"].dataType.simpleString()
    rated = grades.where(F.col(grade).between(1, bands) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc")).agg(F.avg(F.col(grade).cast("double")).alias("grade"))

    english = spark.sparkContext.broadcast(fit_language(documents, doc_id=doc_id, text=text, lang=lang))

    def graph(batches):
        known = Chunks(english.value, buckets)
        for b in batches:
            yield pd.DataFrame(list(graph_rows(b["doc"], b["_text"], min_words, known)), columns=["doc", "words", "weights"])

    edges = docs.mapInPandas(graph, f"doc {id_type}, words array<int>, weights array<float>").join(broadcast_if_small(rated), "doc", "left")
    edges = stage(edges, "reading-graph")
    first = edges.where("grade is not null").agg(F.avg("grade").alias("m"), F.var_pop("grade").alias("v")).first()
    if first.m is None:
        return spark.createDataFrame([], f"doc_id {id_type}, level double, band int")
    mean, variance = float(first.m), max(float(first.v), 0.25)
    level, trust = np.full(buckets, mean), np.zeros(buckets)
    for turn in range(iterations + 1):
        held = spark.sparkContext.broadcast((level, trust))

        def sums(batches, turn=turn, held=held):
            total = np.zeros((3, buckets))
            for b in batches:
                graded = b["grade"].to_numpy(float)
                clamped = ~np.isnan(graded)
                if turn == 0:
                    score, sure = graded, clamped.astype(float)
                else:
                    own = document_levels(b, *held.value)
                    score, sure = np.where(clamped, graded, own), np.where(clamped, 1.0, np.where(np.isnan(own), 0.0, 0.5))
                total += word_sums(b, score, sure, buckets)
            some = np.flatnonzero(total[0])
            yield pd.DataFrame({"word": some.astype(np.int32), "n": total[0][some], "s": total[1][some], "q": total[2][some]})

        source = edges.where("grade is not null") if turn == 0 else edges
        # At most ``buckets`` rows come to the driver, whatever the corpus.
        got = source.mapInPandas(sums, "word int, n double, s double, q double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas()
        total = np.zeros((3, buckets))
        total[:, got["word"].to_numpy()] = got[["n", "s", "q"]].to_numpy().T
        fresh, trust = words_from_sums(total, mean, variance)
        moved = float(np.average(np.abs(fresh - level), weights=total[0])) if total[0].any() else 0.0
        level = fresh
        if turn > 1 and moved < tolerance:
            break
    held = spark.sparkContext.broadcast((level, trust))

    def final(batches):
        for b in batches:
            own = document_levels(b, *held.value)
            yield pd.DataFrame({"doc_id": b["doc"], "grade": b["grade"], "level": np.where(np.isnan(own), mean, own)})

    levels = stage(edges.mapInPandas(final, f"doc_id {id_type}, grade double, level double"), "reading-levels")
    # Cuts: a histogram of fixed size over all documents, and the graded documents reduced to counts by grade and bin.
    low, high, bins = 1.0, float(bands), 240
    place = F.least(F.greatest(F.floor((F.col("level") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    table = levels.groupBy(place.alias("bin"), F.round("grade").cast("int").alias("g")).count().toPandas()
    span = np.linspace(low, high, bins + 1)
    density = np.bincount(table["bin"].to_numpy(int), table["count"].to_numpy(float), bins)
    graded = table[table["g"].notna()]
    middle = (span[:-1] + span[1:]) / 2
    cuts = cut_points(graded["g"].to_numpy(int), middle[graded["bin"].to_numpy(int)], density, span, bands, graded["count"].to_numpy(np.int64))
    band = F.lit(1)
    for c in cuts:
        band = band + (F.col("level") > c).cast("int")
    return levels.select("doc_id", "level", band.alias("band"))
