import itertools
import random

import numpy as np
import pytest

from graphloom.llm import toxicity as tox

BAD = ["idiot", "moron", "worthless", "stupid", "loser", "pathetic"]


def corpus(n=900, seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4)))
    rows = []
    for i in range(n):
        y = int(r.random() < 0.2)
        words = [word() for _ in range(r.randint(10, 120))]
        for _ in range(r.randint(2, 4) * y):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words).capitalize() + ".", y))
    return rows


@pytest.fixture(scope="module")
def models(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return tox.fit(docs, labels.filter("doc_id % 3 <> 0"))


HIDDEN = [("1d10t", "idiot"), ("m0r0n", "moron"), ("w0rthle55", "worthless"), ("$tupid", "stupid"), ("s t u p i d", "stupid"), ("l.o.s.e.r", "loser"), ("l-0-s-e-r", "loser"), ("stuuuupid", "stupid"), ("loooser", "loser"), ("p@th3tic", "pathetic"), ("you 1d!ot, go", "you idiot, go"), ("mmmoron!!", "moron!!")]


@pytest.mark.parametrize("hidden,plain", HIDDEN)
def test_restores(models, hidden, plain):
    assert tox.Restorer(models[0]).restore(hidden) == plain


@pytest.mark.parametrize("text", ["the hand", "there are 3 in 1990.", "thered, onan. inhere!", "a b", "", "call 555-7620 now", "x " * 3, "### *** $$$"])
def test_leaves_clean_text(models, text):
    assert tox.Restorer(models[0]).restore(text) == text


def plain_viterbi(cost, lattice):
    """Every path through the lattice."""
    best = None
    for path in itertools.product(*lattice, [(" ", 0.0)]):
        text = "".join(s for s, _ in path)
        total = sum(c for _, c in path)
        a = b = tox.SPACE
        for c in text:
            k = tox._code(c)
            total += cost[a][b][k]
            a, b = b, k
        if best is None or (total, text) < best:
            best = (total, text)
    return best[1][:-1]


@pytest.mark.parametrize("stretch", ["1d10t", "l0s3rrr", "$7up1d", "aaab1ccc", "|!1", "p@7h3t1c"])
def test_viterbi_equals_all_paths(models, stretch):
    own = tox.Restorer(models[0])
    assert own.decode(stretch) == plain_viterbi(own.cost, own.lattice(stretch))


def test_counts_cover_all_text(spark):
    texts = ["Ab c", None, "", "éa1"]
    got = tox.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)).reshape((tox.SIZE,) * 3)
    assert got[0, 1, tox.SPACE] == 1 and got[tox.OTHER, 0, tox.SPACE] == 1 and got[tox.SPACE, tox.SPACE, 2] == 0
    assert got[tox.SPACE, tox.SPACE, 0] == 1 and got[tox.SPACE, tox.SPACE, tox.OTHER] == 1


def test_held_out_accuracy_also_when_hidden(spark, models):
    r = random.Random(1)
    leet = str.maketrans("oies", "0135")
    rows = [(i, t, y) for i, t, y in corpus() if i % 3 == 0]
    hide = lambda t: " ".join(w.translate(leet) if w in BAD else w for w in t.split())
    docs = spark.createDataFrame([(i, hide(t) if r.random() < 0.5 else t) for i, t, _ in rows], "doc_id long, text string")
    got = {x.doc_id: x for x in tox.score(docs, models).collect()}
    assert sum(got[i].predicted == y for i, _, y in rows) >= 0.97 * len(rows)
    assert any(x.restored for x in got.values())


ODD = [(None, None), (1, None), (2, ""), (3, "idiot"), (3, "idiot"), (4, "the hand " * 100_000 + "idiot moron"), (5, "a" * 10_000), (6, "1" * 10_000 + "a1" * 5000), (7, "é ß ﬁ 😀")]


@pytest.mark.parametrize("known", [False, True])
def test_odd_rows_and_clashing_columns(spark, models, known):
    docs = spark.createDataFrame([(*x, 5, "z") for x in ODD], "doc_id long, text string, score int, restored string")
    got = tox.score(docs, models if known else (models[0], None)).collect()
    assert len(got) == len(ODD) and all(0 <= x.score <= 1 for x in got)
    assert got[3].score == got[4].score and got[1].score == got[2].score
    if not known:
        assert {(x.score, x.predicted) for x in got} == {(0.5, 0)}


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model, lexicon = tox.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert lexicon is None and np.isfinite(model.cost).all()
    assert tox.score(docs, (model, lexicon)).count() == 0


EDGES = [("idi07", "idiot"), ("1d107", "idiot"), ("a$$", "ass"), ("tra$$", "trass"), ("worthle55", "worthless"), ("(1diot)", "(idiot)"), ('"5cum', '"scum'), ("*5cum*", "*scum*")]


@pytest.mark.parametrize("hidden,plain", EDGES)
def test_restores_symbols_at_the_edges(models, hidden, plain):
    assert tox.Restorer(models[0]).restore(hidden) == plain


LONG = [("stu" + "p" * 60 + "id", "stupid"), ("l" + "0" * 60 + "ser", "loser"), ("the-hand/" * 8 + "m0r0n", "the-hand/" * 8 + "moron")]


@pytest.mark.parametrize("hidden,plain", LONG)
def test_restores_long_stretches(models, hidden, plain):
    assert tox.Restorer(models[0]).restore(hidden).replace("loo", "lo") == plain


def test_spaced_phrases_come_out_as_words(spark):
    plain = "you are so stupid and worthless"
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([plain, "the other day we are so tired", "you and the dog are here", "a stupid idea and a worthless plan", "it is shit that you hit the ship"] * 20)], "doc_id long, text string")
    own = tox.Restorer(tox.LanguageModel(tox.trigram_counts(docs)))
    assert own.restore(" ".join(plain.replace(" ", ""))) == plain
    assert own.restore("y o u  a r e   s t u p i d") == own.restore("y-o-u--a-r-e--s-t-u-p-i-d") == "you are stupid"
    assert own.restore("s t u p i d") == own.restore("s  t  u  p  i  d") == "stupid" and own.restore("sh!+") == "shit"


def test_time_is_linear_in_a_stretch(models):
    import time

    own = tox.Restorer(models[0])
    took = []
    for n in (5_000, 40_000):
        start = time.time()
        own.decode("a1b0" * n)
        took.append(time.time() - start)
    assert took[1] < 20 * took[0]


def plain_lexicon(rows, support=tox.LEAST_SUPPORT):
    """Odds of words and beginnings, counted feature by feature over the rows that are learnt from."""
    learn = [(y, m, w.split()) for i, (y, m, w) in enumerate(rows) if i % 3 != 2]
    every = lambda words: set(words) | {w[:k] + b"-" for w in words for k in (4, 5, 6) if len(w) > k}
    totals = [len({m for y, m, _ in learn if y == k}) for k in (0, 1)]
    odds = {}
    for f in {f for y, _, w in learn if y for f in every(w)}:
        seen = [{m for y, m, w in learn if y == k and f in every(w)} for k in (0, 1)]
        x = np.log((len(seen[1]) + 0.5) / (totals[1] + 1)) - np.log((len(seen[0]) + 0.5) / (totals[0] + 1))
        if len(seen[1]) >= support and x >= tox.LEAST_ODDS:
            odds[f] = x
    return odds


def test_lexicon_and_score_equal_brute_force(spark, models):
    rows = corpus(150)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = tox.sample(docs, labels, models[0], "toxic", 1500)
    own = tox.Restorer(models[0])
    assert sorted(w for _, _, w in found) == sorted(b" ".join(sorted(set(own.restore(t.lower()).encode().translate(tox._LETTERS).split()))) for _, t, _ in rows)
    lexicon = tox.Lexicon(found)
    want = plain_lexicon(found)
    assert want and lexicon.odds.keys() == want.keys()
    assert all(abs(lexicon.odds[f] - x) < 1e-12 for f, x in want.items())
    got = {r.doc_id: r.score for r in tox.score(docs, (models[0], lexicon)).collect()}
    for i, t, _ in rows:
        words = set(own.restore(t.lower()).encode().translate(tox._LETTERS).split())
        best = {w: max([want.get(w, 0)] + [want.get(w[:k] + b"-", 0) for k in (4, 5, 6) if len(w) > k]) for w in words}
        best = sorted((x for x in best.values() if x > 0), reverse=True)
        x = [*(best[:3] + [0, 0, 0])[:3], np.log1p(len(best)), np.log1p(100 * len(best) / (len(words) + 20))]
        z = (np.array(x) - lexicon.curve.mean) / lexicon.curve.spread @ lexicon.curve.weights[:-1] + lexicon.curve.weights[-1]
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_every_word_of_a_labelled_text_counts(spark, models):
    text = " ".join("".join(random.Random(i).choices("abcdefghijklmnop", k=8)) for i in range(6000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (_, _, w), = tox.sample(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), models[0], "toxic", 10)
    assert set(w.split()) == set(tox.Restorer(models[0]).restore(text).encode().split())


@pytest.fixture(scope="module")
def english(spark):
    lines = ["you are so stupid and worthless", "such an ass of a man", "the pass was a mass of grass", "j. r. r. told us to ask", "the idiot lost a class"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines * 20)], "doc_id long, text string")
    return tox.Restorer(tox.LanguageModel(tox.trigram_counts(docs)))


MARKS = [("i/d/i/o/t", "idiot"), ("i,d,i,o,t", "idiot"), ("i    d    i    o    t", "idiot"), ("s\nt\nu\np\ni\nd", "stupid"), ("a s s", "ass"), ("you a-s-s", "you ass"), ("stu\u200bpid", "stupid"), ("st\u00adupid", "stupid")]


@pytest.mark.parametrize("hidden,plain", MARKS)
def test_other_marks_and_short_words(english, hidden, plain):
    assert english.restore(hidden) == plain


@pytest.mark.parametrize("text", ["x q z", "b, c, d", "x x x", "1 2 3", "a - b", "k. v. w. foo"])
def test_short_stretches_that_are_no_words_stay(english, text):
    assert english.restore(text) == text
