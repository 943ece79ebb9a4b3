"""Whether a text is in the language most of a corpus is labelled with: a letter trigram model, learned from the corpus itself.

Each word is scored by the chance of its letters, each given the two before it. A text's score is the mean over its
letters, and it is in the language if that is not far below the mean of the texts the model was learned from. Letters other than a
to z score low whatever stands before them, so other scripts do as well. Words that begin with a capital, names mostly, are left out
where enough others remain.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import Memo, plain
from barloom.runtime import spread, stage

LETTERS = re.compile(r"[^\W\d_]+")
letter_words = LETTERS.findall
#: a to z, the border of a word, any other letter.
SYMBOLS = 28
#: Bits a letter at most, so that one odd word does not decide; and how far below the mean a text may lie.
FLOOR, MARGIN = -5.0, 0.75
#: Different stretches, and characters of text, after which a task hands its counts over, so that its memory stays small.
STRETCHES, CHARACTERS = 200_000, 1 << 25
#: A word weighs by the square root of its count, taken as if the corpus had so many words if it has more, and by that count itself if it
#: is below one: else slips and rare names, of which a growing corpus has ever new ones, would in the end outweigh the common words.
WORDS = 1 << 20


def symbols(word: str) -> list[int]:
    return [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in word), 0]


class Language:
    """``counts``: trigrams by the flattened counts of their words (see ``WORDS``); ``raw``: by the counts themselves."""

    def __init__(self, counts: np.ndarray, raw: np.ndarray):
        alone = counts.sum((0, 1)) + 1
        pair = counts.sum(0) + 5 * alone / alone.sum()
        given = counts + 3 * (pair / pair.sum(-1, keepdims=True))
        self.bits = np.log2(given / given.sum(-1, keepdims=True))
        self.bits[:, :, -1] = 2 * FLOOR  # however often texts in other scripts bear the label
        self.known = bool(raw.any())
        self.mean = float((raw * self.bits).sum() / raw.sum()) if self.known else 0.0
        self._memo = Memo(self._score)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def __setstate__(self, state):
        self.__dict__ = {**state, "_memo": Memo(self._score)}

    def _score(self, word: str) -> tuple[float, int]:
        x = np.array(symbols(word))
        n = len(x) - 2
        return max(float(self.bits[x[:-2], x[1:-1], x[2:]].sum()), FLOOR * n), n

    def score(self, word: str) -> tuple[float, int]:
        """Bits (not below the floor) and letters, with the border, of a word in lower case."""
        return self._memo[word]

    def holds(self, score, letters, own_score, own_letters):
        """For arrays of sums over whole texts, and over their words without a capital: whether each is in the language."""
        own = own_letters >= 0.3 * letters
        bits, n = np.where(own, own_score, score), np.where(own, own_letters, letters)
        return self.known & (n > 0) & (bits >= (self.mean - MARGIN) * n)


def fit_language(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", prefix: str = "en") -> Language:
    """The model of the language whose label begins with ``prefix``, learned from every text labelled so.

    Some wrong labels in column ``lang`` do no harm; without such a column, or without a word in the texts labelled so, it is
    learned from all texts. Null ids and texts are left out. Words are counted by the executors; what comes to
    the driver are the sums of 28 x 28 x 28 trigrams. An empty table gives a model that no text fits.
    """
    given = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    labelled = given.where(F.lower(F.trim(F.col(lang))).startswith(prefix)) if lang in documents.columns else None

    def frame(stretches):
        words = Counter()
        for stretch, n in stretches.items():
            for w in letter_words(stretch.lower()):
                words[w] += n
        return pd.DataFrame({"w": np.array(list(words), object), "n": np.array(list(words.values()), float)})

    def count(batches):
        # No word crosses a blank, so equal stretches are taken apart once.
        stretches, size = Counter(), 0
        for b in batches:
            for t in b["_t"]:
                stretches.update(plain(t).split())
                size += len(t)
                if len(stretches) > STRETCHES or size > CHARACTERS:
                    yield frame(stretches)
                    stretches, size = Counter(), 0
        yield frame(stretches)

    out = np.zeros((2, SYMBOLS**3))
    for source in (labelled, given):
        if source is None or out[1].any():
            continue
        words = stage(spread(source.select(F.col(text).alias("_t"))).mapInPandas(count, "w string, n double").groupBy("w").agg(F.sum("n").alias("n")), "language-words")
        scale = min(1.0, WORDS / (words.agg(F.sum("n")).first()[0] or 1.0))

        def trigrams(batches, scale=scale):
            sums = np.zeros((2, SYMBOLS**3))
            for b in batches:
                for w, n in zip(b["w"], b["n"]):
                    x = np.array(symbols(w))
                    cell = (x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:]
                    m = n * scale
                    np.add.at(sums[0], cell, min(m, m**0.5))
                    np.add.at(sums[1], cell, n)
            some = np.flatnonzero(sums[1])
            yield pd.DataFrame({"cell": some.astype(np.int32), "soft": sums[0][some], "raw": sums[1][some]})

        got = words.mapInPandas(trigrams, "cell int, soft double, raw double").groupBy("cell").agg(F.sum("soft").alias("soft"), F.sum("raw").alias("raw")).toPandas()
        out[:, got["cell"].to_numpy(int)] = got[["soft", "raw"]].to_numpy().T
    shape = (SYMBOLS,) * 3
    return Language(out[0].reshape(shape), out[1].reshape(shape))
