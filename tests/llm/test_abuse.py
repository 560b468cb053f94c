import pytest

from heliovox.llm import abuse

S = abuse.Scorer()


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("You are a worthless idiot and everyone knows it.", "abusive"),
        ("you 1d10t, shut your m0uth", "abusive"),
        ("What a s t u p i d m o r o n you are", "abusive"),
        ("You b*****d, get out", "abusive"),
        ("Du Vоllidiоt!", "abusive"),
        ("Sei un cre.tino", "abusive"),
        ("You are a stupid imbecille", "abusive"),
        ("Women are vermin.", "hateful"),
        ("Ausländer sind A​b​schaum und gehören weggejagt.", "hateful"),
        ("Send me your nuuuudes", "sexual"),
        ("You are a s*******s s h i t h e a d", "abusive"),
        ("Du dreckiger. Versager, komm her.", "abusive"),
    ],
)
def test_found(text, category):
    scores = dict(zip(abuse.CATEGORIES, S.text(text)))
    assert scores[category] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [None, "", "   ", "\n\n", "*** --- ***", "The idiot-proof connector saved us again.", "Stupid mistake on my side.", "With the naked eye the crack cannot be seen.", "Rats chewed the cable; filth and vermin everywhere.", "Foreign workers and immigrants did an excellent job.", "Site rules: calling a colleague an idiot is forbidden, you know.", "I am such an idiot, you were right."],
)
def test_not_found(text):
    assert max(S.text(text)) < abuse.THRESHOLD


def test_group_insult_is_hateful_only():
    a, h, s = S.text("Women are stupid vermin and you are with them.")
    assert h >= 1 and a < 1


def test_automaton_against_brute_force():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    import random

    words = sorted(w for w in S.automaton.near)
    draw = random.Random(7)
    typed = ["moorn", "morron", "idoit", "brick", "cretn", "vermni", "table", "nodes", "parasiets", "savage"]
    for w in draw.sample(words, 60):
        at, letter = draw.randrange(len(w)), draw.choice("abcdefgh")
        typed.append(draw.choice([w[:at] + w[at + 1 :], w[:at] + letter + w[at:], w[:at] + letter + w[at + 1 :], w[:at] + w[at + 1 : at + 2] + w[at : at + 1] + w[at + 2 :]]))
    automaton = abuse.Automaton(words, words, most=50, least_changed=0)  # forgets its sets again and again
    squeeze = lambda x: __import__("re").sub(r"(.)\1+", r"\1", x)
    for word in typed:
        found = dict(automaton.closest(word))
        least = {w: distance(word, w) for w in words if distance(word, w) <= 1}
        # Letters drawn out are free, so a term may be nearer than by edits alone, never farther.
        assert bool(found) >= bool(least)
        for term, edits in found.items():
            assert edits <= least.get(term, 1)
            assert term in least or squeeze(word) != word
        assert {t for t, e in least.items() if e == min(least.values())} <= found.keys() or min(found.values()) < min(least.values())


def test_over_tables(spark):
    rows = spark.createDataFrame([(1, "You idiot", "a"), (2, None, "a"), (3, "", None), (1, "You idiot", "a"), (4, "fine " * 50_000, "b")], "doc_id long, text string, source string").withColumnRenamed("source", "category")
    scores = abuse.score(rows, keep=("category",))
    assert scores.count() == 5
    assert {tuple(r) for r in abuse.found(scores.drop("category")).distinct().collect()} == {(1, "abusive")}
    rates = {r["category"]: r for r in abuse.rates(scores, source="category").collect()}
    assert rates["a"]["documents"] == 3 and rates["a"]["abusive_rate"] == pytest.approx(2 / 3) and rates[None]["abusive_rate"] == 0
    assert abuse.score(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "category"),
    [("You are an idoit", "abusive"), ("Du bist ein Vollidoit.", "abusive"), ("Immigrants are vermni", "hateful"), ("Send me your pornoos", "sexual"), ("You are a stupid moorn", "abusive")],
)
def test_misspelled_beside_whom_it_is_aimed_at(text, category):
    scores = dict(zip(abuse.CATEGORIES, abuse.Scorer().text(text)))
    assert scores[category] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["You need a brick here", "Your logger stops every morning", "Women work in the interior", "Sei molto efficiente", "Fährst du in die Schweiz?", "Your laser is stupid", "Frauen haben die Daten", "What does the animal do to women?"])
def test_ordinary_words_near_a_term(text):
    assert max(abuse.Scorer().text(text)) < abuse.THRESHOLD


def test_misspelt_terms():
    hit, all_ = 0, 0
    for role, frame, category in (("insult", "You are a {} and you know it.", 0), ("demean", "Immigrants are {}.", 1), ("sexual", "Look at this {}", 2)):
        for w in abuse.ROLES[role]:
            for i in range(len(w) if len(w) >= abuse.LEAST else 0):
                for typed in {w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]}:
                    all_ += 1
                    hit += S.text(frame.format(typed))[category] >= abuse.THRESHOLD
    assert hit / all_ > 0.95


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("All Poles are vermin", "hateful"), ("I will kill you tonight", "abusive"), ("You are garbage and nobody likes you", "abusive"), ("Marco is a complete moron.", "abusive"), ("He is an asshole", "abusive"),
        ("Die Serben sind Abschaum.", "hateful"), ("Gli albanesi sono parassiti", "hateful"), ("Women are idiots", "hateful"), ("you filthy immigrants", "hateful"), ("Ti spezzo le gambe", "abusive"),
        ("Ich schlage dir die Zähne ein", "abusive"), ("Those people belong in cages", "hateful"), ("Send me naked photos of you, I am horny", "sexual"),
    ],
)
def test_plain_cases(text, category):
    scores = dict(zip(abuse.CATEGORIES, S.text(text)))
    assert [c for c, s in scores.items() if s >= abuse.THRESHOLD] == [category]


@pytest.mark.parametrize(
    "text",
    [
        "The manual says: do not write 'you idiot'.", "Do not call a colleague an idiot.", '"You are an idiot", he said.', "I am such an idiot, you were right.", "This voltage can kill you.", "The pigeons are vermin.",
        "Our Bulgarians are an asset", "All connectors are garbage, you should replace them.", "Get rid of all cables for good.", "The update fucked everything", "I cani sono animali", "I piani sono inferiori", "You dropped the dead pixel mask",
    ],
)
def test_quoted_forbidden_or_about_things(text):
    assert max(S.text(text)) < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["You pick a module whose name you like.", "Your roles have holes and done turns.", "This should never be removed, see below.", "Warn that these should be removed.", "You walk toward the summer meaning", "Here is a list of modules whose names you named."])
def test_ordinary_text(text):
    assert max(S.text(text)) < abuse.THRESHOLD


def test_a_letter_changed_counts_in_long_terms_only():
    near = abuse.Automaton(["prick", "halfwit"], ["prick", "halfwit"])
    assert near.closest("trick") == [] and near.closest("halfwig") == [("halfwit", 1)] and near.closest("pirck") == [("prick", 1)] and near.closest("prck") == [("prick", 1)]


def test_without_paid_moves_misspelt_terms_are_not_found():
    assert max(abuse.Scorer(misspellings=False).text("You are an idoit.")) == 0


def test_against_reviews(spark):
    scores = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "doc_id long, abusive double, hateful double, sexual double")
    reviews = spark.createDataFrame([(1, "abusive"), (1, "none"), (2, "hateful"), (2, None), (3, "sexual")], "doc_id long, category string")
    rows = {r["category"]: (r["agreed"], r["missed"], r["extra"]) for r in abuse.against_reviews(scores, reviews).collect()}
    assert rows == {"abusive": (1, 0, 1), "hateful": (0, 1, 0), "sexual": (0, 0, 0)}
    assert abuse.against_reviews(scores.limit(0), reviews).count() == 0


def test_misspelled_alone_is_kept_for_review():
    assert 0 < max(S.text("An idoit wrote this.")) < abuse.THRESHOLD
    assert S.text("An idoit wrote this.") == S.text("Nobody. An idoit wrote this. Fine.")


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("You b*tch", "abusive"), ("you are an id*ot", "abusive"), ("you st*pid m*ron", "abusive"), ("Ich will s**pare con te: s*****e", "sexual"), ("Ieri abbiamo s*****o per ore", "sexual"),
        ("Sei uno s*****o", "abusive"), ("Le donne sono s*****e", "hateful"), ("You w***************t, get out", "abusive"), ("You are an *idiot*", "abusive"), ("k*ll y**rself", "abusive"),
    ],
)
def test_starred(text, category):
    scores = dict(zip(abuse.CATEGORIES, abuse.Scorer().text(text)))
    assert [c for c, s in scores.items() if s >= abuse.THRESHOLD] == [category]


@pytest.mark.parametrize("text", ["You see *** here", "your a*b*c and x*y", "You get **bold** text and 3*4*5", "you want *p and p*", "Use your sel*ct * from t"])
def test_stars_that_hide_nothing(text):
    assert max(abuse.Scorer().text(text)) < abuse.THRESHOLD
