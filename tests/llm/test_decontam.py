import hashlib
import random
import re
import time

import pytest

from graphloom.llm import decontam


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, items, window=10):
    wanted = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wanted.setdefault(tuple(w[i : i + k]), set()).add(str(name) if name is not None else "null")
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wanted}:
            for i in range(len(w) - k + 1):
                if names := wanted.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def check(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, False) for i, t in docs], "doc_id long, text string, n_hit int, contaminated boolean")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(d, b, **options).collect()
    for r, (n, hit, found) in zip(got, plain(docs, items), strict=True):
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (n, hit, found, hit > 0)
    return got


@pytest.mark.parametrize("seed,block_bytes", [(1, 1 << 20), (2, 300), (3, 1 << 20)])
def test_equals_brute_force(spark, seed, block_bytes):
    r = random.Random(seed)
    vocabulary = "a b c" if seed == 3 else "alpha beta gamma delta eps zeta eta theta iota kappa"
    text = lambda n: " ".join(r.choice(vocabulary.split()) for _ in range(n))
    items = [(i, text(r.choice([1, 5, 9, 10, 11, 25, 60]) if seed != 3 else 14)) for i in range(25)]
    docs = []
    for i in range(120):
        t = text(r.randint(0, 60))
        if r.random() < 0.5:
            w = r.choice(items)[1].split()
            a = r.randrange(len(w))
            t += " new " + " ".join(w[a : a + r.randint(1, 30)]).upper() + r.choice(["", ", "]) + text(5)
        docs.append((i, t))
    check(spark, docs, items, block_bytes=block_bytes)


ODD = [(None, None), (1, ""), (2, "A-b c"), (3, "one two three four five six seven eight nine ten eleven"), (3, "one two three four five six seven eight nine ten eleven"), (4, "x " * 100_000 + "one two three four five six seven eight nine ten"), (5, "é1 Ü_ü É1")]


def test_odd_rows(spark):
    items = [(None, None), (7, ""), (8, "one two three four five six seven eight nine ten eleven twelve"), (8, "b c"), (None, "é1 Ü"), (9, "..")]
    got = check(spark, ODD, items)
    assert got[3].matches[0].length == 11
    check(spark, ODD, [])
    check(spark, [], items)


def test_matches_are_the_longest_of_their_places(spark):
    """Many items at one place, one item at many offsets, three blocks: one match per place, and all items."""
    line = "a b a b a b a b a b a b a b"
    items = [(i, line) for i in range(40)] + [(77, line + " c d e"), (78, "c d e f g h i j k l m"), (79, "q " * 3)]
    got = check(spark, [(1, line + " c d e f g h i j k l m x"), (2, "q q q q"), (3, None)] * 2, items, block_bytes=400)
    assert len(list(decontam.item_blocks(spark.createDataFrame(items, "item_id long, text string"), 400))) >= 3
    for r in got:
        assert len({m.at for m in r.matches}) == len(r.matches)
    places = {m.at: (m.length, m.item_id) for m in got[0].matches}
    assert places[0] == (17, "77") and places[14] == (11, "78")
    assert places[1] == (16, "77") and places[2][0] == 15


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def every_match(text, items, window=10):
    """place -> (length, first name) over all pairs of a text's words and an item's."""
    w, out = words(text), {}
    for name, t in sorted(items):
        x = words(t)
        k = min(window, len(x))
        for p in range(len(w)):
            for o in range(len(x) - k + 1 if k else 0):
                n = 0
                while p + n < len(w) and o + n < len(x) and w[p + n] == x[o + n]:
                    n += 1
                if n >= k and n > out.get(p, (0, ""))[0]:
                    out[p] = (n, name)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_longest_matches_equal_all_pairs(seed):
    r = random.Random(seed)
    letters = ["a", "ab", "abc", "abcdefgh", "ab", "abcdefghijklmnop"][seed]
    text = lambda n: " ".join(r.choice(letters) for _ in range(n))
    items = [(f"n{i}", text(r.choice((1, 2, 3, 6, 9, 30)))) for i in range(8 if seed else 3)]
    texts = [text(r.randint(0, 50)) + " " + r.choice(items)[1] for _ in range(12)] + [""]
    window = r.choice((3, 4))
    pat = decontam.Patterns([(n, t.encode()) for n, t in items], window)
    own = decontam.Findings(len(texts))
    own.add(decontam.search([t.encode() for t in texts], pat), pat, 0)
    for k, t in enumerate(texts):
        want = every_match(t, items, window)
        assert {m["at"]: (m["length"], m["item_id"]) for m in own.matches(k)} == want


@pytest.mark.parametrize("text", ["a " * 200_000, " ".join(f"w{i}" for i in range(200_000)), "a b " * 50_000 + "c " * 100_000])
def test_repeated_and_copied_text_takes_linear_work(text):
    start = time.time()
    pat = decontam.Patterns([("x", text.encode()), ("y", text[: len(text) // 2].encode())])
    own = decontam.Findings(2)
    own.add(decontam.search([text.encode(), b"new " + text.encode()], pat), pat, 0)
    n = len(text.split())
    assert own.hit(0) == own.hit(1) == n and own.items[0] == {"x", "y"}
    assert own.matches(0)[0] == {"at": 0, "item_id": "x", "length": n}
    assert time.time() - start < 60
