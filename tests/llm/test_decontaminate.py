import random

import numpy as np

from tabularium.llm import decontaminate as D

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def distance(a, b):
    """Least edits between a and any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edit(text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i] = rng.choice("abc") if rng.random() < 0.5 else t[i] + "z" if rng.random() < 0.5 else ""
    return "".join(t)


def brute(index, text):
    cleaned = D.clean(text)
    short = {k for k, (_, x) in enumerate(index.items) if x and len(x) < D.LEAST and f" {x} " in f" {cleaned} "}
    return short | {index.windows[w][0] for w in range(len(index.windows)) if len(cleaned) and distance(index.windows[w][2], cleaned) <= index.windows[w][3]}


def test_equals_brute_force():
    items = [(i, D.clean(prose(n))) for i, n in enumerate((8, 20, 40, 2, 1))]
    index = D.Index(items)
    texts = [None, "", "short", prose(100)]
    for i in range(3):
        for n in (0, 1, 3, 5, 8, 12):
            texts.append(f"{prose(20)} {edit(items[i][1], n)} {prose(20)}")
        texts += [f"{prose(3)} {items[3][1]}, {items[4][1].upper()}", items[4][1], items[3][1] + "s", items[3][1][1:]]
    texts += [edit(items[2][1], 4), (items[1][1][:-1] + " ") * 40, "the " * 2000]
    got = D.matches(index, texts)
    for text, hits in zip(texts, got):
        assert {h[0] for h in hits} == brute(index, text)
    assert sum(map(bool, got)) >= 12


def test_grams_tell_apart_and_agree():
    a = D.grams(D.points("abcdefghijklmnopqrst"))
    b = D.grams(D.points("xxabcdefghijklmnopqrst"))
    assert len(a) == 20 - D.Q + 1 and (a == b[2:]).all() and len(np.unique(a)) == len(a)


def test_clean():
    assert D.clean("Ab,c  É–x\n") == "ab c é x" and D.clean(None) == ""


def test_frames(spark):
    item = prose(30)
    docs = spark.createDataFrame([(1, item, "x"), (2, prose(30), "y"), (None, item, "z"), (3, None, "n"), (1, item, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item.upper()), (8, None), (9, "")], "item_id long, text string")
    rows = D.leaks(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["edits"]) for r in rows) == [(0, 7, 0), (1, 7, 0), (1, 7, 0)]
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3]
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.leaks(docs.limit(0), bench).count() == 0
    assert D.keep_clean(docs, bench.limit(0)).count() == 5


def test_repeated_grams_take_bounded_memory(monkeypatch):
    """Stretches and ranges of windows find what one count over the whole document finds."""
    items = [(0, "ab " * 60), (1, "a" * 200), (2, D.clean(prose(40))), (3, "ab " * 30 + "c")]
    index = D.Index(items)
    texts = ["a" * 3000, "ab " * 900, prose(150) + " " + items[2][1] + " " + prose(150), "ab " * 50 + "a" * 200, prose(200)]
    whole = D.matches(index, texts)
    monkeypatch.setattr(D, "STRETCH", 100)
    monkeypatch.setattr(D, "AT_ONCE", 500)
    assert [{(h[0], h[2]) for h in x} for x in D.matches(index, texts)] == [{(h[0], h[2]) for h in x} for x in whole]
    assert [{h[0] for h in x} for x in whole] == [brute(index, t) for t in texts]


def test_several_passes(spark, monkeypatch):
    docs = [(i, prose(30)) for i in range(6)]
    df = spark.createDataFrame([*docs, (9, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(10 + i, t) for i, t in docs[:3]], "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert sorted(tuple(r)[:2] for r in D.leaks(df, bench).collect()) == [(0, 10), (1, 11), (2, 12)]
