"""Template leaks: verbatim, reworded in case and punctuation, re-parameterised; clean texts stay."""

import random
from itertools import pairwise

import pytest

from vqspark.llm import leaks, queries

DATA = "/root/testdata/sf0.001"
ITEMS = [
    (1, "A train leaves Berlin at 10:30 and travels 120 km to Hamburg at a constant speed of 60 km per hour. When does it arrive in Hamburg?"),
    (2, "Las en, de que cióncies y boasrr ciónrrñco ñci uecorr rr ñraez asrrja la esbo para de ascorr."),
    (3, "too short"),
    (4, "If Alice has 3 apples and Bob has 3 apples, how many apples do Alice and Bob have together before Bob gives 1 apple to Carol?"),
    (6, "Who wrote Hamlet?"),
    (7, "Compute 12 + 15 * 3 - 4 = 5 mod 7 ."),
    (8, "一二三四五六七八"),
]
NOISE = "the of and to in it that was for on with as by at from this had not are but which".split()


def cases():
    rng = random.Random(1)
    fill = lambda n: " ".join(rng.choice(NOISE) for _ in range(n))
    train = "a train leaves Munich at 8:15 and travels 300 km to Vienna at a constant speed of 75 km per hour. When does it arrive in Vienna?"
    return [
        (1, fill(60) + ". " + ITEMS[0][1] + " " + fill(60), {1}),
        (2, ITEMS[1][1].upper().replace(" ", "!! "), {2}),
        (3, fill(9) + " " + train, {1}),
        (4, train.replace("to Vienna", "to Madrid"), set()),  # one value of the item stands for two here
        (5, "If Dora has 7 apples and Emil has 7 apples, how many apples do Dora and Emil have together before Emil gives 2 apple to Finn?", {4}),
        (6, "If Dora has 7 apples and Emil has 8 apples, how many apples do Dora and Emil have together before Emil gives 2 apple to Finn?", set()),
        (7, fill(500), set()),
        (8, " ".join(ITEMS[1][1].split()[:6]) + fill(30), set()),
        (9, "(too short!)", {3}),
        (10, None, set()),
        (11, "", set()),
        (12, fill(40_000) + "\n" + ITEMS[0][1].lower(), {1}),
        (None, ITEMS[1][1], {2}),
        (13, "1 2 3 4 5 6 7 8 km 9 km 10 " * 50, set()),
        (14, ITEMS[0][1] + " " + ITEMS[1][1], {1, 2}),
        (14, ITEMS[0][1] + " " + ITEMS[1][1], {1, 2}),
        (15, ITEMS[1][1].replace("boasrr", "boasrr x"), set()),  # eleven of fifteen windows
        (16, fill(5) + " too short " + fill(5), set()),  # so short an item must be the whole text
        (17, fill(30) + " who wrote hamlet, " + fill(30), {6}),
        (18, fill(7) + " Compute 12+15*3-4=5 mod 7 " + fill(7), {7}),
        (19, "Compute 13 + 16 * 4 - 5 = 6 mod 8.", set()),  # all but the values is too little
        (20, "九一二三四五六七八九", {8}),
        (21, "Mary Ann Smith. If Dora Lee has 7 apples and Emil has 7 apples, how many apples do Dora Lee and Emil have together before Emil gives 2 apple to Finn?", {4}),
    ]


@pytest.mark.parametrize("bound", [leaks.BROADCAST_ROWS, 0])
def test_cases(spark, monkeypatch, bound):
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", bound)
    docs = spark.createDataFrame([(d, t, 1, "s", 2, 3) for d, t, _ in cases()], "doc_id long, text string, item_id int, share string, _leak1 int, _leak int")
    items = spark.createDataFrame([*ITEMS, (5, None), (9, "?!"), (None, "a b c d e f g"), ITEMS[0]], "item_id long, text string")
    found = leaks.find_leaks(docs, items).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted(((d, i) for d, _, x in cases() for i in x), key=str)
    assert {r.doc_id for r in found if not r.verbatim} == {3, 5, 21}
    kept = leaks.decontaminated(docs, items)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _, x in cases() if not x), key=str) and kept.columns == docs.columns


def leaks_of(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r.doc_id: (r.share, r.verbatim) for r in leaks.find_leaks(docs, items).collect()}


def test_templates_that_repeat(spark):
    """Such an item also meets itself some places on; these alignments don't count against the one that covers it."""
    item = "Add 3 cups then add 4 cups then add 5 cups then stop."
    texts = [item, "First " + item.replace("3", "6").replace("4", "7").replace("5", "8"), item.replace("4", "3")]  # the last: one value stands for two
    assert leaks_of(spark, item, texts) == {0: (1.0, True), 1: (1.0, False)}
    once = " ".join(["again and again"] * 40)
    assert leaks_of(spark, once, [once, " ".join([once] * 30), "again and so on " * 30]).keys() == {0, 1}


def test_texts_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, ITEMS[0][1]), (2, ITEMS[1][1]), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEMS[0][1]), (1, ITEMS[1][1])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.share, r.verbatim) for r in leaks.find_leaks(docs, items).collect()) == [(1, 1, 1.0, True), (2, 1, 1.0, True)]


PROBLEMS = [
    "{a} has {x} apples and buys {y} more apples at the market. How many apples does {a} have now?",
    "A train leaves {a} at {x} o'clock and reaches {b} after {y} hours. What was its average speed between {a} and {b} if the distance is {z} km?",
    "In the library, {a} borrowed {x} books and {b} borrowed {y} books. How many books did {a} and {b} borrow in all?",
    "{a} runs {x} km every day. {b} runs {y} km every day. After {z} weeks, how much further than {a} has {b} run?",
    "A recipe for {x} people needs {y} g of flour and {z} ml of milk. How much flour is needed to cook this recipe for twice as many people?",
    "\"{a} and I,\" said {b}, \"have sold {x} tickets for the play, and only {y} tickets are left.\" How many tickets were there in the beginning?",
    "The sum of two numbers is {x} and their difference is {y}. Find the larger of the two numbers and explain every step of the calculation.",
    "- {a}: paints a fence in {x} hours\n- {b}: paints the same fence in {y} hours\nHow many hours do {a} and {b} need when both of them work together?",
]
FIRST = "Alice Bob Carla Dmitri Ewa Farid Greta Hugo Ines Jonas Katya Liam".split()
LAST = "Smith Okoye Tanaka Lopez Novak Berg".split()


def drawn(rng, template, words):
    a, b = rng.sample(FIRST, 2)
    if words == 2:
        a, b = f"{a} {rng.choice(LAST)}", f"{b} {rng.choice(LAST)}"
    x, y, z = rng.sample(range(2, 90), 3)
    return template.format(a=a, b=b, x=x, y=y, z=z)


@pytest.mark.parametrize("words", [1, 2])
def test_questions_with_other_values(spark, words):
    """Numbers and names are changed, names of one word against those of one or two; at least nine of ten are found, and none by another's item."""
    rng = random.Random(words)
    items = [(i, drawn(rng, t, 1)) for i, t in enumerate(PROBLEMS)]
    docs = [(100 * i + n, " ".join(rng.choices(NOISE, k=20)) + ". " + drawn(rng, t, words) + " " + " ".join(rng.choices(NOISE, k=20))) for i, t in enumerate(PROBLEMS) for n in range(50)]
    docs += [(10_000 + n, " ".join(rng.choices(NOISE, k=80))) for n in range(100)]
    found = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id // 100 == r.item_id for r in found)
    each = [len({r.doc_id for r in found if r.item_id == i}) / 50 for i in range(len(items))]
    assert min(each) >= 0.9, each


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert leaks.find_leaks(none, items).count() == 0
    some = spark.createDataFrame([(1, ITEMS[0][1])], "doc_id long, text string")
    assert leaks.find_leaks(some, items.limit(0)).count() == 0
    assert leaks.decontaminated(some, items.limit(0)).count() == 1


# ---------------------------------------------------------------- brute force
def plain_templates(text):
    """``[(words, slots)]`` of both templates, by the definition; words as tuples."""
    words, slots = [], []
    names = []
    for w in leaks.TOKEN.findall(text or ""):
        low = w.lower()
        if w[0].isdigit():
            words.append(("n",)), slots.append(low)
        elif low in leaks.UNITS and words and words[-1] == ("n",):
            words.append(("u",)), slots.append(low)
        else:
            words.append(low), slots.append(None)
        names.append(slots[-1] is None and len(w) > 1 and w[0].isupper())
    named, values = [], []
    for k, (w, s) in enumerate(zip(words, slots)):
        if names[k] and k and names[k - 1]:
            values[-1] += " " + w
        else:
            named.append(("c",) if names[k] else w), values.append(w if names[k] else s)
    return [(words, slots), (named, values)]


def windows(words, slots, n=5):
    return {i: (tuple(words[i : i + n]), slots[i : i + n]) for i in range(len(words) - n + 1) if sum(s is None for s in slots[i : i + n]) >= 2}


def found_by_force(item, text, share=0.8):
    best = None
    for own, other in zip(plain_templates(item), plain_templates(text)):
        mine, theirs = windows(*own), windows(*other)
        literal = sum(s is None for s in own[1])
        if literal < 4 or 2 * len(mine) < max(1, len(own[0]) - 4):
            continue
        on = {}
        for p, (w, _) in mine.items():
            for q, (v, _) in theirs.items():
                if w == v:
                    on.setdefault(q - p, set()).add(p)
        for shift in on:
            covered, taken, pairs = set(), set(), []
            for s in sorted((s for s in on if abs(s - shift) <= 5), key=lambda s: (abs(s - shift), s)):
                fresh = {p + k for p in on[s] - covered for k in range(5)} - taken
                pairs += [(own[1][i], other[1][i + s]) for i in fresh if own[1][i] is not None]
                covered |= on[s]
                taken |= {p + k for p in on[s] for k in range(5)}
                same = all(a == b for a, b in pairs)
                one = len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(set(pairs))
                if len(covered) >= share * len(mine) - 1e-9 and (same or one):
                    best = max(best or (0, False), (round(len(covered) / len(mine), 6), same))
    return best


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    want = [(d.doc_id, i.item_id, *x) for d in docs for i in items if (x := found_by_force(i.text, d.text))]
    found = queries.op2_template_leaks(spark, DATA).collect()
    assert want and sorted((r.doc_id, r.item_id, r.share, r.verbatim) for r in found) == sorted(want)


def test_changed_items_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, drawn(rng, t, 1)) for i, t in enumerate(PROBLEMS)]
    texts = []
    for n in range(240):
        words = drawn(rng, rng.choice(PROBLEMS), rng.choice([1, 2])).split(" ")
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choices([*NOISE, "17", "km", "Zoe"], k=rng.randrange(3))
        texts.append((n, " ".join(words)))
    found = leaks.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(n, i, *x) for n, t in texts for i, q in items if (x := found_by_force(q, t))]
    assert sorted((r.doc_id, r.item_id, round(r.share, 6), r.verbatim) for r in found) == sorted(want)
    assert all(a <= b for a, b in pairwise(sorted(r.share for r in found)))
