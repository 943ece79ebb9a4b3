"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment.

1. Items are cut into word trigrams, in blocks of bounded size; every block is broadcast and met by all documents.
   A trigram is a rare seed of its items if few of them hold it. Rarity is judged among the items, never in the corpus, so
   what is found does not depend on how often a passage has leaked. Items of equal words count once.
2. Where a document holds a rare seed of an item and as many of its trigrams as every passage keeps, the stretch around them is
   aligned with the item: first by plain Smith-Waterman scores, which most chance hits fail, then by a
   Smith-Waterman over (words, errors) that finds for every number of errors the most words of a passage. A stretch of
   foreign words between two longer pieces costs nothing. Equal stretches of a batch are aligned once.
3. What shares only common trigrams with an item, the phrases of many items, is aligned too, but must be closer to it.
"""

from __future__ import annotations

import math
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import Memo, chunks, normal, words
from barloom.runtime import spread

GRAM = 3
#: Words of items held in one broadcast block: some 30 bytes each.
BLOCK_WORDS = 2_000_000
#: Words of documents looked at together, pairs aligned side by side, and words of a stretch that are aligned at once: longer ones are cut into overlapping ones.
CHUNK_WORDS, SIDE_BY_SIDE, STRETCH = 400_000, 256, 2_048
#: Foreign words in a row that are told apart: more are never errors of a passage that counts, only an interjection or its end.
FOREIGN = 8
#: Words around the outermost trigrams that a passage may reach to.
MARGIN = 24


class Rule(NamedTuple):
    """When a passage counts: see :func:`leaked_items`."""

    min_words: int = 16
    slack: float = 0.25
    common_slack: float = 0.2
    common_items: int = 3
    min_piece: int = 6


def tolerated(min_words: int, slack: float) -> int:
    """Errors up to which passages need to be looked at: one of twice ``min_words`` or more has a half that counts as well."""
    return math.floor(slack * (2 * min_words - 1))


def kept_grams(min_words: int, slack: float, jumps: int) -> int:
    """The trigrams every passage that counts keeps.

    n words in their order with e errors and so many interjections stand in at most e + jumps + 1 runs, and a run of r words keeps r - 2 trigrams.
    """
    return max(1, min(n - (GRAM - 1) * (math.floor(slack * n) + jumps + 1) for n in range(min_words, 2 * min_words)))


def scores(q: np.ndarray, t: np.ndarray, error: int, jump: int) -> np.ndarray:
    """The Smith-Waterman score of each row of ``q`` (items) with the same row of ``t`` (texts): a matched word counts 1.

    Any number of a text's words may be jumped over for a fixed price. Numbers below 0 match nothing.
    """
    b, m = q.shape
    row, best, far = np.zeros((b, m + 1), np.int16), np.zeros(b, np.int16), np.full((b, m + 1), -9999, np.int16)
    slide = (error * np.arange(m + 1)).astype(np.int16)
    fresh, far_now = np.zeros_like(row), np.empty_like(row)
    for i in range(t.shape[1]):
        hit = q == t[:, i : i + 1]
        np.add(row[:, :-1], np.where(hit, np.int16(1), np.int16(error)), out=fresh[:, 1:])
        np.maximum(fresh[:, 1:], row[:, 1:] + np.int16(error), out=fresh[:, 1:])
        np.add(far, np.int16(jump), out=far_now)
        np.maximum(fresh, far_now, out=fresh)
        np.maximum(fresh, 0, out=fresh)
        fresh -= slide
        np.maximum.accumulate(fresh, axis=1, out=fresh)
        fresh += slide
        np.maximum(far, fresh, out=far)
        row, fresh = fresh, row
        np.maximum(best, row.max(axis=1), out=best)
    return best


def most_words(q: np.ndarray, t: np.ndarray, errors: int, min_piece: int, jumps: bool = True) -> np.ndarray:
    """(pairs, errors + 1): the most words a passage of each pair has with at most so many errors.

    Smith-Waterman with the number of errors as a coordinate instead of a price, for all pairs side by side. A passage is one
    piece, or (with ``jumps``) pieces of at least ``min_piece`` words, parted by any number of the text's words;
    pieces begin with a matched word. Substituted, dropped and inserted words are errors. To know when a piece is long
    enough, the words of the current one are a coordinate too, up to ``min_piece``.
    """
    b, m = q.shape
    planes = min_piece if jumps else 1
    # [words of the piece - 1, errors, pair, place in the item]; below 0: not reached.
    none = np.int16(-999)
    row = np.full((planes, errors + 1, b, m + 1), none, np.int16)
    far = np.full((errors + 1, b, m + 1), none, np.int16)
    best = np.zeros((errors + 1, b), np.int16)
    for i in range(t.shape[1]):
        hit = q == t[:, i : i + 1]
        fresh = np.full_like(row, none)
        if errors:
            np.maximum(row[:, :-1, :, :-1], row[:, :-1, :, 1:], out=fresh[:, 1:, :, 1:])
            fresh[:, 1:, :, 0] = row[:, :-1, :, 0]
        # A matched word: the piece grows by one, the last plane holds all that are long enough.
        grown = np.where(hit, row[-1, :, :, :-1] + np.int16(1), none)
        np.maximum(fresh[-1, :, :, 1:], grown, out=fresh[-1, :, :, 1:])
        if planes > 1:
            np.maximum(fresh[1:, :, :, 1:], np.where(hit, row[:-1, :, :, :-1] + np.int16(1), none), out=fresh[1:, :, :, 1:])
        first = np.where(hit, np.maximum(far[:, :, :-1], 0) + np.int16(1), none) if jumps else np.where(hit, np.int16(1), none)
        np.maximum(fresh[0, :, :, 1:], first, out=fresh[0, :, :, 1:])
        for e in range(1, errors + 1):
            np.maximum(fresh[:, e, :, 1:], fresh[:, e - 1, :, :-1], out=fresh[:, e, :, 1:])
        if jumps:
            np.maximum(far, fresh[-1], out=far)
        np.maximum(best, fresh[-1].max(axis=2), out=best)
        row = fresh
    return np.maximum.accumulate(best, axis=0).T


def passages(items: list[np.ndarray], texts: list[np.ndarray], common: list[bool], rule: Rule) -> list[tuple[int, int] | None]:
    """(matched words, errors) of the longest passage of each pair that counts, of those with few errors; else None.

    ``common`` tells which pairs share no rare seed: theirs is one piece, with ``common_slack``.
    """
    out: list = [None] * len(items)
    errors = tolerated(rule.min_words, rule.slack)
    # A passage that counts loses at most slack words in all and a jump; the price of a word of 1 leaves this score.
    jump = -3
    least = {True: math.ceil(rule.min_words * (1 - rule.common_slack) - 1e-9), False: math.ceil(rule.min_words * (1 - rule.slack) - 1e-9) + jump}
    allowed = {c: np.maximum(rule.min_words, np.ceil(np.arange(errors + 1) / max(x, 1e-6) - 1e-9)) for c, x in ((True, rule.common_slack), (False, rule.slack))}
    left = sorted(range(len(items)), key=lambda k: (len(texts[k]), len(items[k])))
    for step in ("score", "one piece", "pieces"):
        rest = []
        side = SIDE_BY_SIDE if step == "score" else SIDE_BY_SIDE // 4
        for at in range(0, len(left), side):
            part = left[at : at + side]
            q, t = np.full((len(part), max(len(items[k]) for k in part)), -2, np.int32), np.full((len(part), max(len(texts[k]) for k in part)), -1, np.int32)
            for n, k in enumerate(part):
                q[n, : len(items[k])], t[n, : len(texts[k])] = items[k], texts[k]
            if step == "score":
                rest += [k for k, s in zip(part, scores(q, t, -1, jump)) if s >= least[common[k]]]
                continue
            got = most_words(q, t, errors, rule.min_piece, step == "pieces")
            for k, n in zip(part, got):
                ok = np.flatnonzero(n >= allowed[common[k]])
                if len(ok):
                    e = int(ok[np.argmax(n[ok])])
                    out[k] = (int(n[e]), e)
                elif not common[k]:
                    rest.append(k)
        left = rest
    return out


def leaked(item: np.ndarray, text: np.ndarray, rule: Rule, common: bool = False) -> tuple[int, int] | None:
    return passages([item], [text], [common], rule)[0]


def _blocks(items, budget: int):
    """Blocks of (ids, words); items of equal words in a block are one entry."""
    block, size = {}, 0
    for key, w in items:
        if block and size + len(w) > budget:
            yield [(ids, list(x)) for x, ids in block.items()]
            block, size = {}, 0
        block.setdefault(tuple(w), []).append(key)
        size += len(w)
    if block:
        yield [(ids, list(x)) for x, ids in block.items()]


class Index:
    """The trigrams of a block of items: numbers of their words, sorted codes of the trigrams, and the items of each."""

    def __init__(self, block: list[tuple[list, list[str]]], common_items: int):
        self.ids = [ids for ids, _ in block]
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(x, len(self.number)) for x in w], np.int32) for _, w in block]
        # Three numbers make one of 63 bits.
        self.size = np.int64(len(self.number) + 1)
        if self.size > 1 << 21:
            raise ValueError("a block has more than two million different words")
        code = [self.code(x) for x in self.items]
        self.grams, at = np.unique(np.concatenate(code), return_inverse=True)
        owner = np.repeat(np.arange(len(code)), [len(c) for c in code])
        pair = np.unique(at.astype(np.int64) * len(code) + owner)
        gram, self.owner = pair // len(code), (pair % len(code)).astype(np.int32)
        self.start = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        self.seed = np.diff(self.start) < common_items
        # A table of bits by the code's lower part, to pass over most other trigrams.
        self.mask = (1 << max(16, int(np.ceil(np.log2(16 * len(self.grams)))))) - 1
        self.maybe = np.zeros(self.mask + 1, bool)
        self.maybe[self._slot(self.grams)] = True

    def code(self, x: np.ndarray) -> np.ndarray:
        """A number for the three words from each place on; -1 where one of them stands in no item."""
        a, b, c = x[:-2].astype(np.int64), x[1:-1].astype(np.int64), x[2:].astype(np.int64)
        return np.where((a >= 0) & (b >= 0) & (c >= 0), (a * self.size + b) * self.size + c, -1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code ^ (code >> 17) ^ (code >> 31)) & self.mask

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``x`` where a trigram of the items begins, and its number."""
        code = self.code(x)
        at = np.flatnonzero(code >= 0)
        at = at[self.maybe[self._slot(code[at])]]
        found = np.minimum(np.searchsorted(self.grams, code[at]), len(self.grams) - 1)
        same = self.grams[found] == code[at]
        return at[same], found[same]


def _squeezed(x: np.ndarray) -> np.ndarray:
    """``x`` with at most ``FOREIGN`` negative numbers in a row."""
    foreign = x < 0
    if not foreign.any():
        return x
    n = np.arange(len(x))
    since = n - np.maximum.accumulate(np.where(foreign, -1, n))
    return x[since <= FOREIGN]


def leaked_items(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 16, slack: float = 0.25, common_slack: float = 0.2, common_items: int = 3, min_piece: int = 6
) -> DataFrame:
    """(doc_id, item_id, matched, errors): documents that hold a passage of an item, with its words and the wrong ones among them.

    A passage counts with at least ``min_words`` words of the item in their order and at most ``slack`` wrong words
    (changed, dropped, put in) per matched one: a quarter is one word in five of all. Words of the text between two pieces of
    at least ``min_piece`` words each are an interjection and do not count; the pieces' trigrams lie within twice the item's length and 24 words of
    each other (a run of words that no item has counts as at most 8). A stretch all of whose trigrams stand in ``common_items`` or more items of different words
    counts only as one piece with at most ``common_slack`` wrong words per matched one. ``matched`` and ``errors`` tell of the longest such passage
    with few errors (7 as set). Items are a stated query set, read on the driver in blocks of ``BLOCK_WORDS`` words; all documents meet each
    block whole. Rows with a null id or text give nothing, repeated documents and items of one id count as one;
    items shorter than ``min_words`` cannot leak. Whole texts are searched, however long. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    docs = spread(documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_doc is not null and _text is not null and _text <> ''"))
    id_type, item_type = docs.schema["_doc"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    out_schema = f"doc_id {id_type}, item_id {item_type}, matched int, errors int"
    found = None
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").toLocalIterator()
    every = ((r.i, w) for r in rows if len(w := words(r.t)) >= min_words)
    rule = Rule(min_words, slack, common_slack, common_items, min_piece)
    for block in _blocks(every, BLOCK_WORDS):
        part = docs.mapInPandas(_searcher(spark, block, rule), out_schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], out_schema)
    best = F.max(F.struct("matched", (-F.col("errors")).alias("e"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.matched").alias("matched"), (-F.col("b.e")).cast("int").alias("errors"))


def _searcher(spark, block, rule: Rule):
    held = spark.sparkContext.broadcast(Index(block, rule.common_items))

    def search(batches):
        index = held.value
        memo = Memo(lambda c: tuple(index.number.get(w, -1) for w in normal(c)))
        for b in batches:
            ids, parts, size = [], [], 0
            for doc, t in zip(b["_doc"], b["_text"]):
                x = np.fromiter(chain.from_iterable(map(memo.__getitem__, chunks(t))), np.int32)
                ids.append(doc)
                parts.append(x)
                size += len(x)
                if size > CHUNK_WORDS:
                    yield _found(index, ids, parts, rule)
                    ids, parts, size = [], [], 0
            if ids:
                yield _found(index, ids, parts, rule)

    return search


def _found(index: Index, ids: list, parts: list[np.ndarray], rule: Rule) -> pd.DataFrame:
    pairs, queries, stretches, common = [], [], [], []
    same: dict[tuple, int] = {}
    owners: list[list] = []
    for doc, k, x, only_common in _stretches(index, ids, parts, rule):
        key = (k, only_common, x.tobytes())
        if key not in same:
            same[key] = len(queries)
            queries.append(index.items[k])
            stretches.append(x)
            common.append(only_common)
            owners.append([])
        owners[same[key]].append((doc, k))
    for own, got in zip(owners, passages(queries, stretches, common, rule)):
        if got:
            pairs += [(doc, i, *got) for doc, k in own for i in index.ids[k]]
    return pd.DataFrame(pairs, columns=["doc_id", "item_id", "matched", "errors"])


def _stretches(index: Index, ids: list, parts: list[np.ndarray], rule: Rule):
    """(document, item, words, whether only common trigrams are shared) of all stretches that hold as many trigrams of an item as every passage keeps."""
    # Between documents stands a word of no item.
    joined = [np.append(_squeezed(x), np.int32(-1)) for x in parts]
    whole, border = np.concatenate(joined), np.cumsum([len(x) for x in joined])
    at, gram = index.hits(whole)
    if not len(at):
        return
    n = index.start[gram + 1] - index.start[gram]
    row = np.repeat(np.arange(len(at)), n)
    item, seed, place = index.owner[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + index.start[gram][row]], index.seed[gram][row], at[row]
    doc = np.searchsorted(border, place, "right")
    order = np.argsort(doc * np.int64(len(index.items)) + item, kind="stable")
    doc, item, seed, place = doc[order], item[order], seed[order], place[order]
    length = np.array([len(x) for x in index.items])
    same = np.r_[False, (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])]
    first = np.flatnonzero(~(same & (np.diff(place, prepend=0) <= 2 * length[item] + 24)))
    last = np.r_[first[1:], len(place)] - 1
    rare = np.add.reduceat(seed.astype(np.int64), first) > 0
    # Without a rare seed a passage is one piece: its trigrams lie within its own length.
    close = kept_grams(rule.min_words, rule.common_slack, 0)
    within = 2 * rule.min_words + tolerated(rule.min_words, rule.common_slack)
    dense = np.zeros(len(place) + 1, np.int64)
    if len(place) >= close:
        dense[1 : len(place) - close + 2] = place[close - 1 :] - place[: len(place) - close + 1] <= within
    dense = np.cumsum(dense)  # how many places begin a dense run before each one
    good = np.where(rare, last - first + 1 >= kept_grams(rule.min_words, rule.slack, 1), (last - first + 1 >= close) & (dense[np.maximum(first, last - close + 2)] > dense[first]))
    begin = np.r_[0, border[:-1]]
    for a, z, seeded in zip(first[good], last[good], rare[good]):
        d, k = doc[a], item[a]
        lo, hi = max(begin[d], place[a] - MARGIN), min(border[d] - 1, place[z] + GRAM + MARGIN)
        x, m = whole[lo:hi], length[k]
        # No passage with its interjection is longer than the overlap.
        for cut in range(0, max(1, len(x) - 4 * m - 64), STRETCH):
            yield ids[d], k, x[cut : cut + STRETCH + 4 * m + 64], not seeded
