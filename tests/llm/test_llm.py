"""Operators on texts: brute force on small fixtures, exact round trips, held-out accuracy, edge cases."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import leakage as L
from barloom.llm import packing as P
from barloom.llm import reading_level as R
from barloom.llm.text import plain, words

VOCABULARY = P.TOKENIZER
needs_tokenizer = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer here")

# --- words


def test_writing_does_not_matter():
    want = ["on", "may", "8", "2010", "the", "depositary", "notes", "of", "abc", "rose", "3.6", "to", "1234567.5"]
    for t in (
        "On May 8, 2010 the depositary notes of ABC rose 3.60% to $1,234,567.50.",
        "<p>ON MAY ８， ２０１０ the dep-\nositary  notes of <b>ABC</b> rose 3.6 percent to US$ 1 234 567.5</p>",
        "on may 08 2010 the depositary​ notes of abc rose 3.6 to 1'234'567.50 dollars",
    ):
        assert words(t) == want, t
    assert words("") == [] and words("$ % .,") == [] and words("0.50 000 0") == ["0.5", "0", "0"]
    assert words("cafÃ©") == words("café") and plain("a &amp; b < c") == "a & b < c"


# --- leaks


def fewest_errors(item, text, min_words=16, slack=0.25, min_piece=6, jumps=True):
    """Whether a passage counts, by another dynamic program: the fewest errors for every number of words, a cell at a time."""
    m, top, none = len(item), len(item), 10_000
    old = np.full((m + 1, top + 1, min_piece + 1), none)  # [place in the item, words, words of the piece]
    ended = np.full((m + 1, top + 1), none)
    for w in text:
        new = np.full_like(old, none)
        for j in range(m + 1):
            here = new[j]
            np.minimum(here, old[j] + 1, out=here)  # put in
            if j:
                np.minimum(here, new[j - 1] + 1, out=here)  # dropped
                np.minimum(here, old[j - 1] + 1, out=here)  # changed
                if w == item[j - 1]:
                    here[1:, 1:] = np.minimum(here[1:, 1:], old[j - 1][:-1, :-1])
                    here[1:, -1] = np.minimum(here[1:, -1], old[j - 1][:-1, -1])
                    here[1, 1] = 0
                    if jumps:
                        here[1:, 1] = np.minimum(here[1:, 1], ended[j - 1][:-1])
        if any(new[:, n, -1].min() <= slack * n for n in range(min_words, top + 1)):
            return True
        np.minimum(ended, new[:, :, -1], out=ended)
        old = new
    return False


def brute(docs, items):
    out = set()
    told = [(i, words(q)) for i, q in items if q]
    texts = {tuple(q) for _, q in told}
    holders = Counter(g for q in texts for g in set(zip(q, q[1:], q[2:])))
    for d, t in docs:
        if d is None or not t:
            continue
        w = words(t)
        for i, item in told:
            if i is None or len(item) < 16 or (Counter(w) & Counter(item)).total() < 16:
                continue
            shared = set(zip(w, w[1:], w[2:])) & set(zip(item, item[1:], item[2:]))
            common = all(holders[g] >= 3 for g in shared)
            near = [k for k, x in enumerate(w) if x in item]
            w_near = w[near[0] : near[-1] + 1]
            if fewest_errors(item, w_near, slack=0.2, jumps=False) if common else fewest_errors(item, w_near):
                out.add((d, i))
    return out


def test_alignment_counts():
    a = np.arange(20)
    rule = L.Rule()
    assert L.leaked(a, a, rule) == (20, 0)
    b = a.copy()
    b[[5, 10]] = -1
    assert L.leaked(a, b, rule) == (18, 2)
    assert L.leaked(a, np.r_[a[:10], [-1] * 30, a[10:]], rule) == (20, 0)
    assert L.leaked(a, np.r_[a[:15], [-1] * 30, a[15:]], rule) is None  # five words are no longer piece
    assert L.leaked(a, np.r_[a[:10], [-1] * 30, a[10:]], rule, common=True) is None
    # One word in five: four of twenty changed, dropped or put in.
    c = a.copy()
    c[[3, 7, 11, 15]] = -1
    assert L.leaked(a, c, rule) == (16, 4) and L.leaked(a, np.delete(a, [3, 7, 11, 15]), rule) == (16, 4)
    assert L.leaked(a[:16], np.insert(a[:16], [3, 7, 11, 15], -1), rule) == (16, 4)
    c[17] = -1
    assert L.leaked(a, c, rule) is None and L.leaked(a, np.full(5, -1), rule) is None and L.leaked(a, np.array([], int), rule) is None
    assert L.leaked(a, a[:12], rule) is None
    assert L.passages([a, a[:3], a], [a, a, np.array([], int)], [False] * 3, rule) == [(20, 0), None, None]


def test_alignment_against_fewest_errors():
    rng = np.random.default_rng(8)
    items, texts = [], []
    for _ in range(90):
        item = rng.integers(0, 30, rng.integers(16, 40))
        x = []
        for w in item:
            r = rng.random()
            x += [] if r < 0.07 else [-1] if r < 0.15 else [w, -1] if r < 0.22 else [w]
        if rng.random() < 0.6:
            k = rng.integers(0, len(x) + 1)
            x[k:k] = [-1] * rng.integers(1, 12)
        items.append(item)
        texts.append(np.maximum([*rng.integers(-3, 30, 10), *x, *rng.integers(-3, 30, 10)], -1))
    for common, slack, jumps in ((False, 0.25, True), (True, 0.2, False)):
        got = [x is not None for x in L.passages(items, texts, [common] * len(items), L.Rule())]
        want = [fewest_errors(i, t, slack=slack, jumps=jumps) for i, t in zip(items, texts)]
        assert got == want and 15 < sum(want) < 80


@pytest.fixture(scope="module")
def leak_world():
    rng = random.Random(5)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(18, 60)))) for i in range(15)]
    docs = []
    for d in range(150):
        w = text(rng.randrange(0, 150))
        if d % 3 == 0:
            item = rng.choice(items)[1].split()
            a = rng.randrange(0, max(1, len(item) - 15))
            piece = item[a : a + rng.randrange(10, 60)]
            rate = rng.choice([0, 0, 0.05, 0.1, 0.4])
            piece = [x if rng.random() > rate else rng.choice(["", "changed", x + " put in"]) for x in piece]
            if rng.random() < 0.3:
                k = len(piece) // 2
                piece = [*piece[:k], *text(40), *piece[k:]]
            at = rng.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((d, " ".join(w)))
    # One item stands in a third of all documents.
    docs += [(1000 + k, " ".join(text(20)) + " " + items[0][1] + " tail") for k in range(30)]
    return docs, items


def test_leaks_against_brute_force(spark, leak_world):
    docs, items = leak_world
    extra = [(None, items[1][1]), (2000, None), (2001, ""), (2002, items[2][1]), (2002, items[2][1]), (2003, "x " * 30000 + items[3][1]), (2004, (" ".join(items[4][1].split()[:9]) + " y ") * 40 + items[4][1])]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("_words", F.lit(1))
    i = spark.createDataFrame([*items, (99, "too short"), (None, items[1][1]), (98, None)], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()}
    want = brute(docs + extra, items)
    assert len(want) > 60 and got == want


def test_leaks_in_blocks_and_empty(spark, leak_world, monkeypatch):
    docs, items = leak_world
    d = spark.createDataFrame(docs[:60], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()}
    monkeypatch.setattr(L, "BLOCK_WORDS", 100)
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == whole
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("n_docs", [45, 120, 2_400])
def test_leaks_of_a_passage_that_several_items_share(spark, same, n_docs):
    passage = " ".join(f"p{chr(97 + k)}" for k in range(20))
    ends = ["tail"] * 3 if same else ["red one", "blue two", "green three"]
    items = [(k, f"{passage} {end}") for k, end in enumerate(ends)]
    docs = [(n, f"start {passage} end {n}" if n % 3 == 0 else f"pb pc pd {n} {n}") for n in range(n_docs)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()}
    assert got == {(n, k) for n in range(0, n_docs, 3) for k in range(3)}
    assert n_docs > 200 or got == brute(docs, items)


def test_chunks_do_not_matter(spark, leak_world, monkeypatch):
    docs, items = leak_world
    block = [([i], words(t)) for i, t in items]
    index = L.Index(block, 3)
    parts = [np.array([index.number.get(w, -1) for w in words(t)], np.int32) for _, t in docs]
    whole = L._found(index, [d for d, _ in docs], parts, L.Rule())
    one = [x for (d, _), p in zip(docs, parts) for x in L._found(index, [d], [p], L.Rule()).itertuples(index=False, name=None)]
    assert sorted(one) == sorted(whole.itertuples(index=False, name=None)) and len(one) > 60


# --- containers


def subset_sums(lengths, counts, room):
    reach = {0}
    for x in lengths:
        for _ in range(counts[x]):
            reach |= {s + x for s in reach if s + x <= room}
    return max(reach)


def test_fullest_is_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(1, 12)))
        lengths, room = sorted(counts, reverse=True), rng.randrange(0, 120)
        use = P.fullest(room, lengths, counts)
        total = sum(k * n for k, n in use.items())
        assert total == subset_sums(lengths, counts, room) and all(n <= counts[k] for k, n in use.items())


def test_patterns_place_everything_tightly():
    rng = random.Random(3)
    hist = Counter(min(2048, int(rng.lognormvariate(5.5, 0.8)) + 1) for _ in range(20_000))
    placed, bins = Counter(), 0
    for times, use in P.patterns(hist, 2048):
        assert sum(k * n for k, n in use.items()) <= 2048
        bins += times
        for k, n in use.items():
            placed[k] += times * n
    assert placed == hist and bins <= -(-sum(k * n for k, n in hist.items()) // 2048) + 2
    assert P.patterns({}, 10) == [] and P.patterns({10: 3}, 10) == [(3, {10: 1})]
    with pytest.raises(ValueError):
        P.patterns({11: 1}, 10)


@needs_tokenizer
@pytest.mark.parametrize("bucket", [200_000, 9])
def test_packing(spark, bucket):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["share", "price", "index", "dividend"]) for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    texts += [(1000 + i, "same words here") for i in range(100)]  # a third of one length
    texts += [(5000, "long " * 500), (5001, ""), (5002, None), (None, "no id"), (1, texts[1][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    out = P.pack_texts(df, capacity=64, items_per_bucket=bucket).collect()
    encode = P.encoder(VOCABULARY).encode_ordinary
    want = Counter()
    for i, t in texts:
        n = len(encode(t or ""))
        for k in range(max(1, -(-n // 64))):
            want[(i, k, k * 64, min(64, n - k * 64))] += 1
    assert Counter((r.doc_id, r.part, r.first_token, r.n_tokens) for r in out) == want
    load = Counter()
    for r in out:
        load[r.container_id] += r.n_tokens
    total = sum(load.values())
    assert max(load.values()) <= 64 and sorted(load) == list(range(len(load))) and len(load) <= -(-total // 64) + 1
    assert P.pack_texts(df.limit(0)).count() == 0


# --- reading level


def level_world(n=400, seed=1):
    rng = random.Random(seed)
    own = {b: [f"{'abcd'[b - 1]}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)] for b in (1, 2, 3, 4)}
    common = [f"z{chr(97 + k)}" for k in range(20)]
    docs, truth = [], {}
    for i in range(n):
        b = i % 4 + 1
        near = max(1, min(4, b + rng.choice([-1, 1])))
        w = [rng.choice(common) if rng.random() < 0.3 else rng.choice(own[near if rng.random() < 0.2 else b]) for _ in range(rng.randrange(30, 90))]
        docs.append((i, " ".join(w)))
        truth[i] = b
    grades = [(i, float(truth[i]) if rng.random() > 0.15 else float(max(1, min(4, truth[i] + rng.choice([-1, 1]))))) for i in range(0, n, 7)]
    return docs, truth, grades


def test_levels_on_held_out_documents(spark):
    docs, truth, grades = level_world()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("grade", F.lit("clash")).withColumn("words", F.lit(1))
    g = spark.createDataFrame(grades + [(3, None), (None, 2.0), (4, 9.0), (99999, 1.0), (0, 1.0)], "doc_id long, band double").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r.band for r in R.reading_levels(df, g).collect()}
    held = [i for i in truth if i % 7]
    assert set(got) == set(truth) and np.mean([got[i] == truth[i] for i in held]) > 0.97


def test_levels_edges(spark):
    docs, _, grades = level_world(80)
    german = "Der Kurs fällt nach der Meldung und die Dividende bleibt gleich weil die Nachfrage nicht mehr wächst und der Index an jedem Handelstag steigt"
    chinese = "股价" * 40
    docs = docs + [(500, german), (501, chinese), (502, ""), (503, None), (None, docs[0][1]), (504, "one two three"), (505, "<p>" + docs[1][1] + "</p>"), (0, docs[0][1]), (506, " ".join(w + w for w in docs[1][1].split()))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame(grades, "doc_id long, band double")
    got = Counter(r.doc_id for r in R.reading_levels(df, g).collect())
    assert not {500, 501, 502, 503, 504, None} & set(got) and got[505] == 1 and got[506] == 1 and got[0] == 2
    assert R.reading_levels(df, g.limit(0)).count() == 0 and R.reading_levels(df.limit(0), g).count() == 0


ENGLISH = [
    "The dog ran quickly over the green hill while children sang songs about winter and their grandmother baked fresh bread in the old kitchen near the river",
    "Herr Schmidt of Düsseldorf and Madame Lefèvre from Orléans met Signor Rossi near Kraków to discuss whether Volkswagen and Générale would buy shares in Łódź this year",
]
OTHER = [
    "De koers van het aandeel steeg gisteren omdat de winst van het bedrijf hoger was dan verwacht en de beleggers weer vertrouwen in de markt kregen na een lange periode",
    "Il prezzo delle azioni è salito ieri perché gli utili della società sono stati superiori alle attese e gli investitori hanno ritrovato fiducia nel mercato dopo tempo",
    "Kurs akcji wzrósł wczoraj, ponieważ zysk spółki był wyższy od oczekiwań, a inwestorzy odzyskali zaufanie do rynku po długim okresie niepewności na giełdzie",
    "Цена акций выросла вчера, потому что прибыль компании оказалась выше ожиданий, и инвесторы снова поверили в рынок после долгого периода неопределенности на бирже",
    "ارتفع سعر السهم أمس لأن أرباح الشركة كانت أعلى من المتوقع واستعاد المستثمرون الثقة في السوق بعد فترة طويلة من عدم اليقين في البورصة المحلية",
    "Le cours de l'action a augmenté hier parce que le bénéfice de la société était supérieur aux attentes et que les investisseurs ont repris confiance",
    "股价昨天上涨 因为公司的利润高于预期 " * 12,
]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no corpus here")
def test_language_is_learned_from_the_corpus(spark):
    from barloom.llm.language import fit_language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = R.Chunks(fit_language(docs), 1 << 18)
    rows = lambda texts: [d for d, *_ in R.graph_rows(range(len(texts)), texts, 20, known)]
    assert rows(ENGLISH) == [0, 1] and rows([t.upper() for t in ENGLISH[:1]]) == [0] and rows(OTHER) == []
    # Without labels most texts decide; without texts nothing is known.
    assert abs(fit_language(docs.drop("lang")).mean - known.language.mean) < 0.5
    empty = fit_language(docs.limit(0))
    assert not empty.known and not empty.holds(*map(np.array, ([-1.0], [9.0], [-1.0], [9.0])))[0]


@pytest.mark.parametrize("label, most", [("en-GB", 1 << 20), (None, 2_000)])
def test_language_is_learned_from_every_text(spark, monkeypatch, label, most):
    from barloom.llm import language as G

    monkeypatch.setattr(G, "STRETCHES", 50)
    monkeypatch.setattr(G, "WORDS", most)
    rng = random.Random(4)
    some = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 6))) for _ in range(900)]
    texts = [" ".join(rng.choices(some, k=3)) + rng.choice(["-Aé", ", <b>x</b>", " 7", "\n", " ΑΣ ΑΣ"]) for _ in range(4_500)] + ["Zq-zq zq"]
    docs = [(i, t, label) for i, t in enumerate(texts)] + [(None, "none", label), (9_000, None, label)] + ([(9_001, "fremd", "de")] if label else [])
    got = G.fit_language(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    counts, words_of = np.zeros((2, 28, 28, 28)), Counter(w for t in texts for w in G.letter_words(plain(t).lower()))
    for w, n in words_of.items():
        x, m = G.symbols(w), n * min(1, most / words_of.total())
        for at in zip(x, x[1:], x[2:]):
            counts[(slice(None), *at)] += (min(m, m**0.5), n)
    want = G.Language(*counts)
    assert got.known and np.allclose(got.bits, want.bits) and np.isclose(got.mean, want.mean)
    wordless = [(1, "7 %", "en"), (2, "", "en"), (3, "abc abd", "fr")]
    assert G.fit_language(spark.createDataFrame(wordless, "doc_id long, text string, lang string")).known
    assert not G.fit_language(spark.createDataFrame(wordless[:2], "doc_id long, text string, lang string")).known


def test_language_stays_when_the_corpus_grows(spark, monkeypatch):
    from barloom.llm import language as G

    monkeypatch.setattr(G, "WORDS", 3_000)
    rng = random.Random(5)
    usual = ENGLISH[0].lower().split()
    texts = [" ".join([*rng.choices(usual, k=20), "".join(rng.choices("qxzjvkw", k=8))]) for _ in range(8_000)]
    few, many = (G.fit_language(spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")).mean for n in (200, 8_000))
    assert abs(few - many) < 0.05


def test_graph_counts_words(spark):
    from barloom.llm.language import Language

    everything = Language(np.ones((28, 28, 28)), np.ones((28, 28, 28)))
    everything.mean = -100.0
    known = R.Chunks(everything, 1 << 18)
    texts = ["a-b b, A 12 % x", "", "one two", "b b"]
    got = {d: dict(zip(w.tolist(), (c**2).round().tolist())) for d, w, c in R.graph_rows([7, 8, 9, 7], texts, 2, known)}
    import zlib

    code = lambda w: zlib.crc32(w.encode()) % (1 << 18)
    assert set(got) == {7, 9} and got[9] == {code("one"): 1.0, code("two"): 1.0} and got[7] == {code("b"): 2.0}
    first = next(R.graph_rows([7], texts, 2, known))
    assert dict(zip(first[1].tolist(), (first[2] ** 2).round().tolist())) == {code("a"): 2.0, code("b"): 2.0, code("x"): 1.0}


def test_propagation_equals_dense_means():
    import pandas as pd

    b = pd.DataFrame({"words": [np.array([0, 2]), np.array([1]), np.array([], int)], "weights": [np.array([1.0, 2.0]), np.array([1.0]), np.array([])]})
    level, trust = np.array([1.0, 2.0, 4.0]), np.array([1.0, 0.0, 0.5])
    got = R.document_levels(b, level, trust)
    assert got[0] == pytest.approx((1 * 1 + 2 * 0.5 * 4) / 2) and np.isnan(got[1]) and np.isnan(got[2])
    s = R.word_sums(b, np.array([3.0, 1.0, 0.0]), np.array([1.0, 0.5, 1.0]), 3)
    np.testing.assert_allclose(s, [[1, 0.5, 2], [3, 0.5, 6], [9, 0.5, 18]])


def test_cut_points_with_counts():
    rng = np.random.default_rng(5)
    edges = np.linspace(1, 4, 241)
    middle = (edges[:-1] + edges[1:]) / 2
    grades, bins = np.repeat(np.arange(1, 5), 30), rng.integers(0, 240, 120)
    counts = rng.integers(1, 60, 120)
    density = np.bincount(bins, counts, 240).astype(float)
    rows = R.cut_points(np.repeat(grades, counts), np.repeat(middle[bins], counts), density, edges, 4)
    assert R.cut_points(grades, middle[bins], density, edges, 4, counts) == pytest.approx(rows)
    # The same distribution, many times the size.
    assert R.cut_points(grades, middle[bins], density * 5_000, edges, 4, counts * 5_000) == pytest.approx(rows)


def test_weighted_median():
    for n in (1, 2, 5, 6):
        x, w = np.arange(n)[::-1] * 1.5, np.arange(1, n + 1)
        assert R.weighted_median(x, w) == np.median(np.repeat(x, w))
    assert np.isnan(R.weighted_median(np.zeros(0), np.zeros(0, int)))


def test_every_graded_document_counts(spark, monkeypatch):
    docs, _, grades = level_world(80)
    text = dict(docs)
    hot = [(g[0], text[g[0]]) for g in grades if text[g[0]]][0]
    df = spark.createDataFrame(docs + [hot] * 1_500, "doc_id long, text string")
    g = spark.createDataFrame(grades, "doc_id long, band double")
    seen, real = [], R.cut_points
    monkeypatch.setattr(R, "cut_points", lambda *a: seen.append(a) or real(*a))
    got = R.reading_levels(df, g).count()
    # Each graded row weighs: counts if they are given, else one for each row.
    assert got > 1_500 and (sum(seen[0][5]) if len(seen[0]) > 5 else len(seen[0][0])) > 1_500
