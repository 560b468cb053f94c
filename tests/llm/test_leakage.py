import random

import numpy as np

from heliovox.llm import leakage as K

WORDS = [f"w{i}" for i in range(400)]


def brute(item, doc, edits=K.EDITS):
    """Most words of the item in one stretch, over all pairs of stretches, by plain edit distance."""
    best = 0
    for a in range(len(item)):
        for s in range(len(doc)):
            row = list(range(len(doc) - s + 1))
            for n, w in enumerate(item[a:], 1):
                new = [n]
                for j, v in enumerate(doc[s:], 1):
                    new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (w != v)))
                row = new
                if min(row) <= edits * n + 1e-9:
                    best = max(best, n)
    return best


def altered(words, rng, every):
    out = []
    for k, w in enumerate(words):
        if every and k % every == every - 1:
            kind = rng.choice("xda")
            out += [] if kind == "d" else ["zzz"] if kind == "x" else [w, "zzz"]
        else:
            out.append(w)
    return out


def frames(spark, docs, items):
    documents = spark.createDataFrame([(k, " ".join(d)) for k, d in docs.items()], "doc_id long, text string")
    return documents, spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")


def test_against_brute_force(spark):
    rng = random.Random(11)
    lengths = [1, 2, 3, 4, 6, 9, 12, 20, 24, 28]
    items = {k: rng.sample(WORDS, n) for k, n in enumerate(lengths)}
    docs, expected = {}, set()
    for every in (0, 11, 14):
        for item in items.values():
            for share in (0.25, 0.45, 0.6, 1.0):
                docs[len(docs)] = rng.sample(WORDS, 8) + altered(item[: max(1, int(len(item) * share))], rng, every) + rng.sample(WORDS, 8)
    for d, doc in docs.items():
        expected |= {(d, i) for i, item in items.items() if not set(doc).isdisjoint(item) and brute(item, doc) >= K.least_words(len(item))}
    got = {(r["doc_id"], r["item_id"]) for r in K.leaks(*frames(spark, docs, items)).collect()}
    assert got <= expected
    assert len(got) >= 0.97 * len(expected)


def test_items_of_any_length(spark):
    rng = random.Random(2)
    words = [f"x{i}" for i in range(6000)]
    items = {n: rng.sample(words, n) for n in (3, 8, 30, 150, 700, 2000)}
    docs, expected = {}, set()
    for n, item in items.items():
        for every in (0, 12, 20):
            start = rng.randrange(max(1, n // 2))
            part = item[start : start + int(np.ceil(n * 0.5))]
            docs[len(docs)] = rng.sample(words, 50) + altered(part, rng, every if n > 20 else 0) + rng.sample(words, 50)
            expected.add((len(docs) - 1, n))
        docs[len(docs)] = rng.sample(words, 50) + item[: int(n * 0.3)] + ["zzz"] * (int(n * 0.2) + 2) + item[int(n * 0.7) :] + rng.sample(words, 50)
    got = {(r["doc_id"], r["item_id"]) for r in K.leaks(*frames(spark, docs, items)).collect()}
    assert {(d, i) for d, i in got if i > 20} == {(d, i) for d, i in expected if i > 20}
    assert expected <= got


def test_many_items_are_shuffled(spark, monkeypatch):
    rng = random.Random(7)
    items = {n: rng.sample(WORDS, 30) for n in range(5)}
    docs = {n: rng.sample(WORDS, 10) + items[n][: 10 + 4 * n] for n in items}
    few = sorted(map(tuple, K.leaks(*frames(spark, docs, items)).collect()))
    monkeypatch.setattr(K, "MOST_PREFIXES", 0)
    monkeypatch.setattr(K, "MOST_WORDS", 0)
    assert sorted(map(tuple, K.leaks(*frames(spark, docs, items)).collect())) == few and len(few) >= 4


def test_a_text_that_says_the_same_again_and_again(spark):
    item = ["a", "b", "c", "d"] * 40
    docs = {1: ["a", "b", "c", "d"] * 6000, 2: ["a", "b", "d", "c"] * 6000, 3: ["q"] + item[:64]}
    got = {(r["doc_id"], r["words_held"]) for r in K.leaks(*frames(spark, docs, {1: item})).collect()}
    assert got == {(1, 160), (3, 64)}


def test_filter_lets_its_keys_through(spark):
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 5000)
    made = K.Filter.of(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert made.has(keys).all()
    assert made.has(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.05


def test_banded_alignment_is_the_whole_one_within_its_band():
    rng = random.Random(4)
    for _ in range(40):
        item = np.array([rng.randrange(6) for _ in range(rng.randint(1, 12))])
        doc = np.array([rng.randrange(8) for _ in range(rng.randint(1, 15))])
        assert K.stretch(item, doc) == K.stretch(item, doc, K.EDITS, -len(item), len(doc))
        assert K.stretch(item, item, K.EDITS, -1, 1) == len(item)


def test_stretch_never_exceeds_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))]
        doc = [rng.choice("abcdefghij") for _ in range(rng.randint(1, 16))]
        number = {w: i for i, w in enumerate("abcdefghij")}
        got = K.stretch(np.array([number[w] for w in item]), np.array([number[w] for w in doc]))
        assert got <= brute(item, doc)


def test_normalised_words():
    assert K.words_of("> Thé ＦＯＸ,\n- ran­ off—fast!") == ["the", "fox", "ran", "off", "fast"]
    assert K.words_of(None) == K.words_of("") == K.words_of("... ---") == []


def test_over_tables(spark):
    rng = random.Random(5)
    item = rng.sample(WORDS, 60)
    long = rng.sample(WORDS, 300)
    docs = [(1, " ".join(item)), (2, "> " + ",\n> ".join(item[:30]).upper()), (3, " ".join(item[:15])), (4, None), (5, ""), (6, " ".join(long * 60 + item + long)), (7, "one two")]
    documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id_", "1 as words_held")
    items = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (9, " ".join(item)), (12, "two words")], "item_id long, text string")
    found = K.leaks(documents, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 9), (2, 9), (6, 9), (7, 12)]  # one of two words is half the item
    assert K.leaks(documents.limit(0), items).count() == 0
    assert K.leaks(documents, items.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    item = [f"k{i}" for i in range(20)]
    docs = spark.createDataFrame([(None, " ".join(item)), (None, "other"), (1, "nothing"), (1, " ".join(item[:9])), (2, None)], "doc_id long, text string").selectExpr("*", "'x' as words", "1 as item", "2 as doc")
    items = spark.createDataFrame([(5, " ".join(item)), (None, " ".join(item))], "item_id long, text string")
    assert {tuple(r) for r in K.leaks(docs, items).collect()} == {(None, 5, 20), (1, 5, 9)}
