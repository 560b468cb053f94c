"""Abusive, hateful and sexual language, disguised or not, in English, Italian and German.

Every word runs through one automaton: the Levenshtein automata of all terms intersected with the lexicon's trie. Its free moves
undo disguises (digits and look-alikes for letters, stops within words, drawn-out letters, a star for any letter), its one paid move
is a misspelling: a letter left out, put in, changed, or swapped with its neighbour. It is made deterministic as words come in, so a
word costs one look-up a letter. Ordinary words that lie so near a term are known by a list.

A hit counts by its context, a window of words around it: whom it is aimed at (a person, a group, nobody), what is said of them, and
less where the window quotes, forbids or speaks of oneself. A misspelt term counts as a term does, only a little less.

One pass over the texts, row by row, without a shuffle; the lexicon is fixed.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from heliovox.llm import lexicon as L

THRESHOLD = 1.0
CATEGORIES = ("abusive", "hateful", "sexual")
# How much a hit counts: within one edit of a term, a word whose letters are starred out, aimed at somebody or at nobody, in quotes or under a ban.
NEAR, HIDDEN = 0.85, 0.8
AIMED, LOOSE, DISTANT, SUGGESTED = 1.3, 0.3, 0.3, 0.4
WINDOW = 12
# Terms shorter than this are too near to ordinary words to be misspelt, and than this to have a letter changed for another.
LEAST, LEAST_CHANGED = 5, 7
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_MARKS = re.compile(r"[̀-ͯ]")
_ALIEN = re.compile(r"[Ͱ-֏]")
_SPACED = re.compile(r"(?<![a-z0-9*@$.])(?:[a-z0-9][ _-]){2,}[a-z0-9](?![a-z0-9])")
_TOKEN = re.compile(r"[a-z0-9@$*]+(?:\.[a-z0-9@$*]+)*")
_HIDDEN = re.compile(r"[a-z]\*{3,}[a-z]?$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^a-z\s])|\n+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*[”“]|«[^»]*»|„[^“”]*[“”]|(?<![a-z0-9])['‘‚][^'’]*['’](?![a-z0-9])")
_NAMED = re.compile(r"\b[A-ZÀ-Þ][^\W\d_]+")
_PEOPLES = re.compile(L.PEOPLES)


def plain(text: str) -> str:
    """Lower case Latin letters without accents, look-alikes and invisible characters."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
    text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return text.translate(L.LOOKALIKES) if _ALIEN.search(text) else text


class Automaton:
    """All terms within one edit of a word, by one walk over its letters.

    A state of the walk is a set of (node of the trie, edit so far, letter still owed by a swap); the edit is 0 for none, 2 for a letter changed, and 1 for any
    other. Sets met before are numbered and their moves remembered; beyond `most` sets all are forgotten, so memory is bounded.
    """

    def __init__(self, terms: Iterable[str], misspelt: Iterable[str] = (), most: int = 100_000, least_changed: int = LEAST_CHANGED) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.letter, self.term, self.open = [""], [""], [False]
        for term, near in [*((t, False) for t in terms), *((t, True) for t in misspelt)]:
            node, path = 0, [0]
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.letter.append(c)
                    self.term.append("")
                    self.open.append(False)
                node = self.child[node][c]
                path.append(node)
            self.term[node] = term
            for n in path if near else ():
                self.open[n] = True
        self.near = set(misspelt)
        self.most, self.least_changed = most, least_changed
        self.forget()

    def forget(self) -> None:
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.ends: list[list[tuple[str, int]] | None] = []
        self.start = self.numbered(self.with_skips({(0, 0, "")}))

    def numbered(self, states: frozenset) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.ends.append(None)
        return self.number[states]

    def with_skips(self, states: set) -> frozenset:
        """A letter of the term left out in the word; and no state that another one betters."""
        more = {(n, 1, "") for s, cost, owed in states if not cost and not owed for n in self.child[s].values() if self.open[n]}
        return frozenset(s for s in states | more if not (s[1] and not s[2] and (s[0], 0, "") in states))

    def move(self, states: frozenset, c: str) -> frozenset:
        read = c.translate(L.LEET)
        out = set()
        for node, cost, owed in states:
            if owed:
                if read == owed:
                    out.add((node, cost, ""))
                continue
            if c == ".":
                out.add((node, cost, ""))
                continue
            children = self.child[node]
            if c == "*":
                out.update((n, cost, "") for n in children.values())
                continue
            if read in children:
                out.add((children[read], cost, ""))
            if read == self.letter[node]:
                out.add((node, cost, ""))
            if not cost and self.open[node]:
                out.add((node, 1, ""))
                for first, n in children.items():
                    if self.open[n] and first != read:
                        out.add((n, 2, ""))
                        swapped = self.child[n].get(read)
                        if swapped is not None and self.open[swapped]:
                            out.add((swapped, 1, first))
        return self.with_skips(out)

    def closest(self, word: str) -> list[tuple[str, int]]:
        """The terms nearest to a word, if within one edit, each with its edits."""
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            if to is None:
                states = self.sets[at]
                if len(self.sets) >= self.most:
                    self.forget()
                    at = self.numbered(states)
                to = self.moves[at][c] = self.numbered(self.move(states, c))
            at = to
            if not self.sets[at]:
                return []
        if self.ends[at] is None:
            cost = {}
            for node, edits, owed in self.sets[at]:
                term = self.term[node]
                if term and not owed and (not edits or term in self.near and (edits == 1 or len(term) >= self.least_changed)):
                    cost[term] = min(edits, 1, cost.get(term, 1))
            least = min(cost.values(), default=0)
            self.ends[at] = sorted((t, e) for t, e in cost.items() if e == least)
        return self.ends[at]


class Pattern:
    """A course of words, some of which others may precede."""

    def __init__(self, text: str) -> None:
        self.steps = []
        for part in text.split():
            gap, _, words = part.rpartition(":") if ":" in part else ("0", "", part)
            gap, words = (part[:-1], "") if part.endswith(":") else (gap, words)
            self.steps.append((int(gap), frozenset(w for x in words.split("|") if x for w in (getattr(L, x[1:]) if x.startswith("@") else [x]))))

    def end(self, words: list[frozenset], at: int, step: int = 0) -> int:
        """The place after the pattern that begins at `at`, 0 if none does."""
        if step == len(self.steps):
            return at
        gap, wanted = self.steps[step]
        if not wanted:
            return min(at + gap, len(words))
        for i in range(at, min(at + (gap if step else 0) + 1, len(words))):
            if not wanted.isdisjoint(words[i]):
                found = self.end(words, i + 1, step + 1)
                if found:
                    return found
        return 0


ROLES = {
    "insult": L.INSULTS, "refuse": L.REFUSE, "slur": L.SLURS, "you": L.YOU, "person": L.PERSON, "group": L.GROUPS, "people": L.PEOPLE, "demean": L.DEMEANING, "copula": L.COPULA, "sexual": L.SEXUAL,
    "hint": L.SUGGESTIVE, "asked": L.ASKED, "distance": L.DISTANCE, "reporting": L.REPORTING, "forbidding": L.FORBIDDING,
}
COURSES = {"threat": L.THREATS, "harm": L.HARM, "act": L.ACTS, "self": L.SELF, "oneself": L.ONESELF, "you are": L.YOU_ARE, "technical": L.TECHNICAL}
# Terms that may be misspelt, and words without which nothing scores.
MISSPELT = ("insult", "slur", "group", "demean", "sexual", "hint")


class Scorer:
    """Scores of a text in each category. Holds only the lexicon, its automaton and a memory of words seen."""

    def __init__(self, memory: int = 200_000, misspellings: bool = True) -> None:
        self.role: dict[str, set[str]] = {}
        for role, words in ROLES.items():
            for w in words:
                self.role.setdefault(w, set()).add(role)
        self.courses: dict[str, list[tuple[str, Pattern]]] = {}
        self.whole: list[list[frozenset]] = []  # the steps of patterns that score
        for kind, texts in COURSES.items():
            for pattern in map(Pattern, texts):
                for w in pattern.steps[0][1]:
                    self.courses.setdefault(w, []).append((kind, pattern))
                if kind in ("threat", "harm", "act"):
                    self.whole.append([words for _, words in pattern.steps])
                for _, words in pattern.steps:
                    for w in words:
                        self.role.setdefault(w, set())
        charged = {w for role in MISSPELT for w in ROLES[role]}
        self.first = (charged - set(L.GROUPS)) | set(L.REFUSE)
        self.starred = charged | {w for steps in self.whole for words in steps for w in words if len(w) > 2}
        self.ordinary = set(L.ORDINARY) - set(self.role)
        self.automaton = Automaton(self.role, [w for w in sorted(charged) if len(w) >= LEAST] if misspellings else [])
        self.harmless: set[str] = set()
        self.memory, self.size = {}, memory

    def word(self, token: str) -> tuple[frozenset[str], float]:
        """The lexicon words a token may stand for, with their certainty; none and 0 if it is no such word."""
        found = self.memory.get(token)
        if found is None:
            found = self._word(token)
            if len(self.memory) < self.size:
                self.memory[token] = found
        return found

    def _word(self, token: str) -> tuple[frozenset[str], float]:
        if token in self.role:
            return frozenset([token]), 1.0
        letters = sum(c.isalpha() for c in token)
        if not letters or len(token) > 40 or letters < 2 and len(token) < 3:
            return frozenset(), 0.0
        if "*" in token:
            bare = token.strip("*")
            if "*" not in bare and bare:  # emphasis, or a star for a last letter
                found = self._word(bare)
                if found[1] >= HIDDEN:
                    return found
            shown = sum(c != "*" for c in token)
            hidden = frozenset(t for t, edits in self.automaton.closest(token) if not edits and t in self.starred) if token[0] != "*" and shown > 1 else frozenset()
            # Two words may be starred out as one, with the space between them; what then stands there goes by its context.
            return (hidden, 1.0) if hidden else (frozenset(["*"]), HIDDEN) if _HIDDEN.match(token) and len(token) > 7 else (frozenset(), 0.0)
        near = self.automaton.closest(token)
        if not near:
            return frozenset(), 0.0
        if near[0][1] and (token in self.ordinary or not token.isalpha() or len(token) < LEAST - 1):
            return frozenset(), 0.0
        return frozenset(t for t, _ in near), NEAR if near[0][1] else 1.0

    def joined(self, sentence: str) -> str:
        """Letters that stand apart, put together into the terms they spell."""

        def join(m: re.Match) -> str:
            letters = re.sub("[ _-]", "", m.group(0)).translate(L.LEET)
            found, at = [], 0
            while at < len(letters):
                end = max((e for e in range(at + 3, len(letters) + 1) if letters[at:e] in self.starred), default=0)
                found += [letters[at:end]] if end else []
                at = end or at + 1
            return " ".join(found) if found else m.group(0)

        return _SPACED.sub(join, sentence)

    def tokens(self, sentence: str) -> list[tuple[str, int]]:
        out = []
        for m in _TOKEN.finditer(sentence):
            token = m.group(0)
            if "." in token and not self.word(token)[1]:
                at = m.start()
                for part in token.split("."):
                    out.append((part, at))
                    at += len(part) + 1
            elif sentence[m.end() : m.end() + 1] != "-" or sentence[m.end() + 1 : m.end() + 2] == " " or token not in self.first:
                out.append((token, m.start()))  # the first part of a compound is no hit
        return [(t, at) for t, at in out if t]

    def sentence(self, part: str, names: frozenset[str] = frozenset(), said: bool = False) -> tuple[float, float, float]:
        """Scores of a plain sentence. names: words written with a capital; said: the sentence before announces a quotation."""
        part = self.joined(part)
        tokens = self.tokens(part)
        found = [self.word(t) for t, _ in tokens]
        words = [w for w, _ in found]
        if not self.may_score(frozenset().union(*words)):
            return 0.0, 0.0, 0.0
        quotes = [m.span() for m in _QUOTED.finditer(part)]
        n = len(tokens)
        roles = [set().union(*(self.role.get(w, ()) for w in ws)) if ws else set() for ws in words]
        spans: dict[str, list[tuple[int, int]]] = {}
        for i, ws in enumerate(words):
            for w in ws:
                for kind, pattern in self.courses.get(w, ()):
                    end = pattern.end(words, i)
                    if end:
                        spans.setdefault(kind, []).append((i, end))
        for a, b in spans.get("technical", ()):
            for i in range(a, b):
                roles[i] -= {"insult", "hint", "refuse", "sexual"}

        def near(i: int, role: str, reach: int = WINDOW) -> bool:
            return any(role in r for r in roles[max(0, i - reach) : i + reach + 1])

        def inside(i: int, kind: str) -> bool:
            return any(a <= i < b for a, b in spans.get(kind, ()))

        def held_off(i: int) -> float:
            """What the window leaves of a hit: less if it quotes or forbids."""
            if near(i, "distance"):
                return DISTANT
            if said or near(i, "reporting"):
                quoted = any(a <= tokens[i][1] < b for a, b in quotes)
                banned = any("forbidding" in roles[k] and any("reporting" in r for r in roles[k + 1 : k + 4]) for k in range(max(0, i - WINDOW), i))
                if quoted or banned:
                    return DISTANT
            return 1.0

        # Groups: listed ones, folk of some name, and names of peoples where they are spoken of as such.
        def people(i: int) -> bool:
            word = tokens[i][0]
            # The first word of a sentence has a capital whatever it is.
            named = i > 0 and word in names and word[-1] in "sienr" and word not in L.COMMON
            return not words[i] and word.isalpha() and len(word) > 3 and (named or _PEOPLES.search(word) is not None) and word not in L.CREATURES

        groups = [i for i in range(n) if "group" in roles[i] or ("people" in roles[i] and i and tokens[i][0] != "kind") or ("kind" in words[i] and i and tokens[i - 1][0] in ("their", "your"))]
        unlisted = [i for i in range(n) if people(i)]
        abusive = hateful = sexual = hidden = 0.0
        for i in range(n):
            sure, role = found[i][1], roles[i]
            if "*" in words[i]:
                hidden = max(hidden, sure * held_off(i))
            if "demean" in role or "insult" in role or "slur" in role:
                # Said of a group: they are such, like such; or such ones, right before its name.
                linked = any("copula" in r for r in roles[max(0, i - 4) : i])
                whom = [g for g in groups if g < i <= g + WINDOW] if linked else []
                whom += [g for g in unlisted if g < i <= g + 6] if linked and not words[i].isdisjoint(L.HARSH) else []
                if whom or "slur" in role and i + 1 in groups:
                    hateful = max(hateful, (1.0 if "demean" in role or "slur" in role else AIMED) * max(sure, 1.0 if sure >= NEAR else 0.0) * held_off(i))
            if "insult" in role:
                own = inside(i, "self") and not inside(i, "you are") or any(abs(a - i) <= WINDOW for a, _ in spans.get("oneself", ())) and not inside(i, "you are")
                someone = any(tokens[k][0] in names and tokens[k + 1][0] in L.IS for k in range(max(0, i - 6), i))
                aimed = near(i, "you") or near(i, "person") or someone or i > 0 and "slur" in roles[i - 1]
                abusive = max(abusive, sure * held_off(i) * (LOOSE if own or not aimed else AIMED))
            if "slur" in role or "refuse" in role or "demean" in role:
                said_of = inside(i, "you are")
                abusive = max(abusive, sure * held_off(i) * (AIMED if said_of else 0.5 if near(i, "you") and "slur" in role else LOOSE * ("slur" in role)))
        for a, b in spans.get("threat", ()):
            abusive = max(abusive, held_off(a))
        for a, b in spans.get("harm", ()):
            if any(abs(g - a) <= WINDOW for g in groups) or any(-6 <= g - a <= b - a + 2 for g in unlisted):
                hateful += held_off(a)
        hints: dict[str, float] = {}
        open_ = [i for i in range(n) if "*" in tokens[i][0] and len(words[i]) > 1 and roles[i] & {"insult", "demean", "slur"}]
        for i in range(n):
            if i in open_ and max(abusive, hateful) >= THRESHOLD:
                continue  # a starred word that insults here isn't sexual as well
            if "sexual" in roles[i]:
                sexual = max(sexual, (1.0 if found[i][1] >= NEAR else found[i][1]) * held_off(i))
            if "hint" in roles[i]:
                hints[min(words[i])] = SUGGESTED * found[i][1] * held_off(i)
        sexual += sum(hints.values()) + max((held_off(a) for a, _ in spans.get("act", ())), default=0.0)
        if hidden:
            if any("asked" in r for r in roles) and sexual > 0:
                sexual += hidden
            elif groups and any("copula" in r for r in roles):
                hateful = max(hateful, hidden * AIMED)
            elif any(r & {"you", "person"} for r in roles):
                abusive = max(abusive, hidden * AIMED)
        if hateful >= THRESHOLD:
            abusive = 0.0
        return abusive, hateful, sexual

    def may_score(self, words: frozenset[str] | set[str]) -> bool:
        """A score above 0 takes a charged word, a hidden one or a whole pattern."""
        return not self.first.isdisjoint(words) or "*" in words or any(all(not s.isdisjoint(words) for s in steps) for steps in self.whole)

    def known(self, text: str) -> dict[str, frozenset[str]]:
        """The tokens of a plain text that stand for words of the lexicon, with these."""
        known = {}
        for token in set(_TOKEN.findall(text)) - self.harmless:
            words, _ = self.word(token)
            if not words and "." in token:
                words = frozenset().union(*(self.word(part)[0] for part in token.split(".") if part))
            if words:
                known[token] = words
            elif len(self.harmless) < self.size:
                self.harmless.add(token)
        return known

    def text(self, text: str | None) -> tuple[float, float, float]:
        """The highest score of any sentence in each category, 0 for null and empty texts."""
        best = (0.0, 0.0, 0.0)
        if not text:
            return best
        whole = plain(text)
        known = self.known(whole)
        spaced = _SPACED.search(whole) is not None
        if not spaced and not self.may_score(frozenset().union(*known.values())):
            return best
        opening, before, said = "", frozenset(), False
        for raw in filter(None, _SENTENCE.split(text)):
            part = plain(raw)
            read = known.keys() & set(_TOKEN.findall(part))
            words = frozenset().union(*(known[t] for t in read))
            if spaced and _SPACED.search(part) or self.may_score(words) or opening and self.may_score(words | before):
                names = frozenset(map(plain, _NAMED.findall(f"{opening} {raw}")))
                best = tuple(map(max, best, self.sentence(part, names, said)))
                if opening:
                    best = tuple(map(max, best, self.sentence(plain(f"{opening} {raw}"), names, said)))
            # A stop after two or three words may stand inside a sentence, to part an insult from whom it is aimed at.
            opening, before = (raw, words) if part.count(" ") < 3 else ("", frozenset())
            said = part.rstrip().endswith(":") and any("reporting" in self.role.get(t, ()) for t in read)
        return best


def score(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), misspellings: bool = True) -> DataFrame:
    """`doc_id`, the `keep` columns and a score per category of every document, over its whole text.

    A score of `THRESHOLD` or more marks content of that category. misspellings: let the automaton take its paid move. Null and empty
    texts score 0; repeated rows are scored each; other columns are left out.
    """
    rows = documents.select(doc_id, *keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(misspellings=misspellings)
        for batch in batches:
            found = pd.DataFrame([scorer.text(t) for t in batch.pop("_text")], columns=CATEGORIES, index=batch.index, dtype="float64")
            yield pd.concat([batch, found], axis=1)

    kind = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kind[c]}" for c in (doc_id, *keep)] + [f"{c} double" for c in CATEGORIES])
    return rows.mapInPandas(run, schema)


def found(scores: DataFrame, *, doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, category` of every category that a document reaches, once each."""
    kinds = F.array(*[F.when(F.col(c) >= threshold, c) for c in CATEGORIES])
    return scores.select(doc_id, F.explode(F.array_compact(kinds)).alias("category"))


def rates(scores: DataFrame, *, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, and the share of them in each category. A null source is a source of its own."""
    return scores.groupBy(source).agg(F.count("*").alias("documents"), *[F.avg((F.col(c) >= threshold).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])


def against_reviews(scores: DataFrame, reviews: DataFrame, *, doc_id: str = "doc_id", category: str = "category", threshold: float = THRESHOLD) -> DataFrame:
    """`category, agreed, missed, extra`: how the scores stand to the labels of reviewers, one count per label and per category reached.

    Null labels and labels of documents that aren't there don't count; a document labelled more than once counts as often.
    """
    labels = reviews.where(F.col(category).isNotNull()).select(doc_id, F.col(category).alias("_label"))
    both = labels.join(scores.select(doc_id, *CATEGORIES), doc_id)
    sides = F.array(*[F.struct(F.lit(c).alias("category"), (F.col(c) >= threshold).alias("_found"), (F.col("_label") == c).alias("_is")) for c in CATEGORIES])
    rows = both.select(F.explode(sides).alias("_s")).select("_s.*")
    return rows.groupBy("category").agg(F.count_if(F.col("_found") & F.col("_is")).alias("agreed"), F.count_if(~F.col("_found") & F.col("_is")).alias("missed"), F.count_if(F.col("_found") & ~F.col("_is")).alias("extra"))
