"""Passages of evaluation items in a corpus, whole or in part, with small alterations.

A document holds an item if a stretch of at least `share` of the item's words stands in it in order, with at most one
word in ten altered, left out or added. Such a stretch must share many three-word shingles with some item-sized window:
of every window's shingles, ordered by rarity in the corpus, the rarest few are a necessary prefix, of which at least
one must occur. Items whose least stretch is shorter than three words have shingles of that length, all of which are
prefix.

1. Documents are read and cut into words once. Shingles that some item has, by a Bloom filter of bounded size, are
   counted by document; those of documents in which they lie dense enough for some item (the length bound) are kept.
2. The prefix shingles of all items are joined with the kept ones: pairs of document and item.
3. Pairs need enough shared shingles near one diagonal (the positional bound); each such band is one window of the item's size.
4. Texts of the documents left, by a second filter of bounded size, are aligned with the items within their bands.

Items and their prefixes are broadcast if they are few, as counted; else they are shuffled as documents are. Nothing that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from heliovox.session import checkpointed, small

WIDTH = 3
SHARE, EDITS = 0.4, 0.1
# Filters have at most so many bits (64 MB); beyond, more passes by it that the joins then turn away.
MOST_BITS = 29
MEMORY = 500_000
# Prefix shingles and words of items up to which they are broadcast, some ten megabytes each.
MOST_PREFIXES, MOST_WORDS = 300_000, 500_000

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[̀-ͯ­​-‏⁠﻿]")


def words_of(text: str | None) -> list[str]:
    """The words of a text, without case, punctuation, accents, width and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


def width_of(least: int) -> int:
    return min(WIDTH, least)


def least_words(n: int, share: float = SHARE) -> int:
    return max(1, int(np.ceil(share * n - 1e-9)))


def least_shared(m: int, edits: float = EDITS) -> int:
    """Of the shingles of a stretch of m words, how many survive its edits, one more than average granted."""
    width = width_of(m)
    return max(1, (m - width + 1) - width * (int(m * edits) + 1))


class Words(dict):
    """Numbers of words, the same in every process, with a memory of those seen."""

    def __missing__(self, word: str) -> int:
        n = xxhash.xxh3_64_intdigest(word) >> 1
        if len(self) < MEMORY:
            self[word] = n
        return n

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A number for each `width` words in succession."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Filter:
    """A Bloom filter with two probes, of bounded size."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """A filter of the distinct numbers in the only column of `keys`. Only its set bits come to the driver, however many keys there are."""
        (column,) = keys.columns
        keys = keys.distinct()
        bits = min(MOST_BITS, max(16, (16 * keys.count()).bit_length()))
        places = F.explode(F.array(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(column, 64 - bits)))
        place = F.col("place")
        each = keys.select(places.alias("place")).groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[each.column("word").to_numpy()] = each.column("bits").to_numpy().view(np.uint64)
        return cls(bits, words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys, out = keys.view(np.uint64), np.uint64(1)
        for place in (keys & np.uint64((1 << self.bits) - 1), keys >> np.uint64(64 - self.bits)):
            out = out & (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)))
        return out.astype(bool)


def prefix(grams: np.ndarray, frequency: np.ndarray, least: int, edits: float) -> np.ndarray:
    """The shingles of one item that are in the necessary prefix of one of its windows."""
    window = max(1, least - width_of(least) + 1)
    take = window - least_shared(least, edits) + 1
    order = np.lexsort((np.arange(len(grams)), grams, frequency))
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))
    if len(grams) <= window:
        return np.unique(grams[order[:take]])
    windows = np.lib.stride_tricks.sliding_window_view(rank, window)
    chosen = np.unique(np.concatenate([np.partition(part, take - 1, axis=1)[:, :take].ravel() for part in np.array_split(windows, -(-windows.size // 4_000_000))]))
    return np.unique(grams[order[chosen]])


def stretch(item: np.ndarray, passage: np.ndarray, edits: float = EDITS, low: int | None = None, high: int | None = None) -> int:
    """Most words of `item` in one stretch that `passage` holds with at most `edits` of them altered.

    Both hold word numbers. A local alignment (match 1, edit -2) is traced back, and the longest part of it
    within the share of edits taken. low, high: only places j of the passage and i of the item with low <= j - i <= high
    may meet, so that memory is the item's length times the band's width.
    """
    n, m = len(item), len(passage)
    if not n or not m:
        return 0
    low, high = max(-n, -n if low is None else low), min(m, m if high is None else high)
    width = high - low + 1
    if width < 1:
        return 0
    # Column k of row i stands for place i + low + k of the passage; beyond its ends nothing matches.
    score = np.zeros((n + 1, width), np.int32)
    padded = np.full(n + width + 1, -2, np.int64)
    first = max(0, low)
    padded[first - low : first - low + max(0, min(m, n + high) - first)] = passage[first : min(m, n + high)]
    cost = 2 * np.arange(width, dtype=np.int32)
    for i in range(1, n + 1):
        equal = padded[i - 1 : i - 1 + width] == item[i - 1]
        row = np.maximum(score[i - 1] + np.where(equal, 1, -2), 0)
        row[:-1] = np.maximum(row[:-1], score[i - 1, 1:] - 2)
        score[i] = np.maximum.accumulate(row + cost) - cost
    i, k = map(int, np.unravel_index(int(score.argmax()), score.shape))
    steps: list[tuple[int, int]] = []  # (words of the item, edits)
    while i and score[i, k] > 0:
        same = padded[i - 1 + k] == item[i - 1]
        if score[i, k] == score[i - 1, k] + (1 if same else -2):
            steps.append((1, int(not same)))
            i -= 1
        elif k + 1 < width and score[i, k] == score[i - 1, k + 1] - 2:
            steps.append((1, 1))
            i, k = i - 1, k + 1
        else:
            steps.append((0, 1))
            k -= 1
    if not steps:
        return 0
    a = np.array(steps)
    at, wrong = np.r_[0, np.cumsum(a[:, 0])], np.r_[0, np.cumsum(a[:, 1])]
    # The longest part [x, y) with wrong[y] - wrong[x] <= edits * (at[y] - at[x]).
    level = wrong - edits * at
    lowest = np.minimum.accumulate(level[::-1])[::-1]
    best = 0
    highest: list[int] = []
    for x in range(len(level)):
        if not highest or level[x] > level[highest[-1]] + 1e-9:
            highest.append(x)
            y = int(np.searchsorted(lowest, level[x] + 1e-9, side="right")) - 1
            if y > x:
                best = max(best, int(at[y] - at[x]))
    return best


def slack(n: int, edits: float = EDITS) -> int:
    """How far the words of a stretch of an item of n words may stray from their diagonal."""
    return int(n * edits) + 1


def bands(places: np.ndarray, found: np.ndarray, grams: np.ndarray, order: np.ndarray, least: int, n: int, edits: float) -> list[tuple[int, int]]:
    """The bands of diagonals in which a document shares enough shingles with an item, as (first, last) step of `slack + 1`.

    places, found: places and numbers of the document's shingles; grams, order: those of the item of n words, in order of their numbers,
    and their places. Place j of the document and i of the item lie in step (j - i) // (slack + 1). A stretch may stray over two steps.
    """
    need, step = least_shared(least, edits), slack(n, edits) + 1
    start = np.searchsorted(grams, found)
    shared = np.flatnonzero(grams[np.minimum(start, len(grams) - 1)] == found)
    if len(shared) < need:
        return []
    start, places = start[shared], places[shared]
    times = np.searchsorted(grams, found[shared], side="right") - start
    counts: dict[int, int] = {}
    # Some places at a time, for texts that say the same again and again.
    cuts = np.searchsorted(np.cumsum(times), np.arange(2_000_000, int(times.sum()), 2_000_000))
    for part in np.split(np.arange(len(places)), cuts):
        k = times[part]
        j = np.repeat(part, k)
        i = order[np.repeat(start[part] - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())] if len(part) else j
        at = (places[j] - i) // step
        # Each place counts once in every pair of steps it may belong to.
        pairs = np.unique(np.r_[(at - 1) * len(places) + j, at * len(places) + j])
        for b, c in zip(*np.unique(pairs // len(places), return_counts=True)):
            counts[int(b)] = counts.get(int(b), 0) + int(c)
    out: list[tuple[int, int]] = []
    for b in sorted(b for b, c in counts.items() if c >= need):
        if out and out[-1] == (b - 1, b):
            out[-1] = (b - 1, b + 1)  # steps b - 1 to b + 1 are aligned at once
        else:
            out.append((b, b + 1))
    return out


def prepared(items: DataFrame, *, item_id: str, text: str, share: float) -> DataFrame:
    """`item, words, least, grams, order` of every item that has words, shingles in order of their numbers with their places; one row per id."""
    rows = items.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("item")).agg(F.max(text).alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = Words()
        for batch in batches:
            words = [words_of(t) for t in batch["text"]]
            least = [least_words(len(w), share) for w in words]
            grams = [shingles(number.ids(w), width_of(m)) for w, m in zip(words, least)]
            order = [np.argsort(g, kind="stable") for g in grams]
            out = pd.DataFrame({"item": batch["item"], "words": words, "least": least, "grams": [g[o] for g, o in zip(grams, order)], "order": order})
            yield out[[bool(w) for w in words]]

    return rows.mapInPandas(cut, f"item {dict(rows.dtypes)['item']}, words array<string>, least int, grams array<bigint>, `order` array<int>")


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = SHARE, edits: float = EDITS) -> DataFrame:
    """`doc_id, item_id, words_held`: every document with every item it holds, once each, and the longest stretch held.

    Null and empty texts hold nothing, and items without words are held by nothing. Items are unique by `item_id`, of
    rows with the same id one is taken; items with a null id are left out. Of rows with the same `doc_id`, null included,
    the document holds what any of them holds. Texts are read whole.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text <> ''")
    kind = dict(docs.dtypes)["doc"]
    wanted = checkpointed(prepared(items, item_id=item_id, text=text, share=share))
    passes = Filter.of(wanted.select(F.explode("grams").alias("k")))
    # How dense shingles must lie: per width and octave of least lengths, so many within so many words.
    octaves: dict[tuple[int, int], int] = {}
    for m in sorted(r["least"] for r in wanted.select("least").distinct().collect()):
        span = 2 ** m.bit_length()
        octaves.setdefault((width_of(m), span + int(span * edits) + 1), least_shared(m, edits))
    shared = spark.sparkContext.broadcast((passes.bits, passes.words, octaves))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (bits, words, octaves), number = shared.value, Words()
        passes = Filter(bits, words)
        widths = sorted({w for w, _ in octaves})
        uses: list[np.ndarray] = []
        held, totals = 0, (np.empty(0, np.int64), np.empty(0, np.int64))

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, which = np.unique(np.concatenate([totals[0], *uses]), return_inverse=True)
            return keys, np.bincount(which, np.concatenate([totals[1], np.ones(len(which) - len(totals[0]))])).astype(np.int64)

        for batch in batches:
            kept = []
            for doc, t in zip(batch["doc"], batch["text"]):
                ids = number.ids(words_of(t))
                place, found, dense = [], [], False
                for w in widths:
                    grams = shingles(ids, w)
                    at = np.flatnonzero(passes.has(grams))
                    place.append(at)
                    found.append(grams[at])
                    for (width, span), need in octaves.items():
                        dense = dense or width == w and len(at) >= need and bool((at[need - 1 :] - at[: len(at) - need + 1] < span).any())
                found = np.concatenate(found) if found else np.empty(0, np.int64)
                if len(found):
                    uses.append(np.unique(found))
                    held += len(uses[-1])
                if dense:
                    kept.append((doc, np.concatenate(place).astype(np.int32), found))
            if held > 2_000_000:
                totals, uses, held = added(), [], 0
            yield pd.DataFrame(kept, columns=["doc", "places", "found"]).assign(n=None)
        keys, n = added() if uses else totals
        for a in range(0, len(keys), 100_000):
            yield pd.DataFrame({"doc": [None], "places": [None], "found": [keys[a : a + 100_000]], "n": [n[a : a + 100_000]]})

    read = checkpointed(docs.mapInPandas(scan, f"doc {kind}, places array<int>, found array<bigint>, n array<bigint>"))
    counts = read.where("n is not null").select(F.explode(F.arrays_zip("found", "n")).alias("x")).groupBy(F.col("x.found").alias("gram")).agg(F.sum("x.n").alias("docs"))
    kept = read.where("n is null").drop("n")

    # Prefixes, by rarity in all documents.
    each = wanted.select("item", "least", F.explode(F.arrays_zip("grams", "order")).alias("g")).select("item", "least", F.col("g.grams").alias("gram"), F.col("g.order").alias("i"))
    ranked = each.join(counts, "gram", "left").select("item", "least", "i", "gram", F.coalesce("docs", F.lit(0)).alias("docs"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        gram = prefix(rows["gram"].to_numpy(), rows["docs"].to_numpy(), int(rows["least"].iloc[0]), edits)
        return pd.DataFrame({"gram": gram, "item": rows["item"].iloc[0]})

    # Few prefixes and items, as counted here, are broadcast, so that documents' shingles stay where they are; of more, both sides are shuffled.
    prefixes = small(checkpointed(ranked.groupBy("item").applyInPandas(choose, f"gram bigint, item {dict(wanted.dtypes)['item']}")), MOST_PREFIXES)
    words = wanted.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    beside = F.broadcast if words <= MOST_WORDS else lambda some: some
    pairs = kept.select("doc", F.explode(F.array_distinct("found")).alias("gram")).join(prefixes, "gram").select("doc", "item").distinct()

    def near_diagonals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (doc, item, first, last)
                for doc, item, places, found, grams, order, least, n in zip(*(batch[c] for c in ("doc", "item", "places", "found", "grams", "order", "least", "n")))
                for first, last in bands(places, found, grams, order, least, n, edits)
            ]
            yield pd.DataFrame(rows, columns=["doc", "item", "first", "last"])

    both = pairs.join(kept.withColumnRenamed("doc", "doc_"), pairs["doc"].eqNullSafe(F.col("doc_"))).drop("doc_")
    both = both.join(beside(wanted.select("item", "least", "grams", "order", F.size("words").alias("n"))), "item")
    near = checkpointed(both.mapInPandas(near_diagonals, f"doc {kind}, item {dict(wanted.dtypes)['item']}, first bigint, last bigint").distinct())

    # The texts of the documents that are left, by a filter of bounded size before anything is moved.
    chosen = Filter.of(near.select(F.xxhash64("doc").alias("k")))
    few = spark.sparkContext.broadcast((chosen.bits, chosen.words))

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filter_ = Filter(*few.value)
        for batch in batches:
            yield batch.loc[filter_.has(batch["k"].to_numpy(np.int64)), ["doc", "text"]]

    texts = docs.withColumn("k", F.xxhash64("doc")).mapInPandas(sift, f"doc {kind}, text string")
    asked = near.withColumnRenamed("doc", "doc_")
    asked = texts.join(asked, texts["doc"].eqNullSafe(F.col("doc_"))).drop("doc_").join(beside(wanted.select("item", "words", "least")), "item")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, said = None, []
        for batch in batches:
            rows = []
            for doc, t, item, words, least, first, last_ in zip(*(batch[c] for c in ("doc", "text", "item", "words", "least", "first", "last"))):
                if t is not last and t != last:
                    last, said = t, words_of(t)
                n = len(words)
                step, stray = slack(n, edits) + 1, slack(n, edits)
                low, high = first * step - stray, (last_ + 1) * step + stray
                start, end = max(0, low), max(0, min(len(said), n + high))
                number = {w: k for k, w in enumerate(dict.fromkeys(words))}
                passage = np.array([number.get(w, -1) for w in said[start:end]], np.int64)
                held = stretch(np.array([number[w] for w in words]), passage, edits, low - start, high - start)
                if held >= least:
                    rows.append((doc, item, held))
            yield pd.DataFrame(rows, columns=["doc", "item", "held"])

    item_kind = dict(wanted.dtypes)["item"]
    found = asked.mapInPandas(align, f"doc {kind}, item {item_kind}, held int")
    return found.groupBy("doc", "item").agg(F.max("held").alias("words_held")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "words_held")
