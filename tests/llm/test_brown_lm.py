import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import brown_lm as B


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def brute(rows):
    split = [(d, B.words_of(t.encode() if t is not None else None)) for d, t in rows]
    c = Counter()
    for d, words in split:
        if d is not None and not held_out(d):
            c.update([*words, "end"])
    n, v = sum(c.values()), len(c)
    p = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(d, len(w) + 1, sum(c[x] > 0 for x in [*w, "end"]), n, sum(p(x) for x in [*w, "end"])) for d, w in split]


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, word int")
    return B.score_all(df, *B.learn(df)).collect()


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], round(r[4], 6))


@pytest.mark.parametrize("known", [B.KNOWN, 30])
def test_base_equals_brute_force(spark, sf, monkeypatch, known):
    monkeypatch.setattr(B, "KNOWN", known)
    monkeypatch.setattr(B, "MERGED", 20)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows += [(500, None), (501, ""), (None, "the of"), (3, "Twice THE"), (502, "é x " * 3)]
    got, want = run(spark, rows), brute(rows)
    assert len(got) == len(rows)
    for a, b in zip(sorted(got, key=lambda r: key((r["doc_id"], r["n_tokens"], 0, 0, r["base_score"]))), sorted(want, key=key)):
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == b[:4]
        assert a["base_score"] == pytest.approx(b[4], rel=1e-9)
        assert a["score"] <= 0


def test_no_training(spark):
    d = next(i for i in range(100) if held_out(i))
    (r,) = run(spark, [(d, "a b")])
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and r["base_score"] == pytest.approx(0)
    assert run(spark, []) == []


def test_probabilities_sum_to_one(spark):
    rows = [(i, "a b c a b d e f") for i in range(1, 9)] + [(20, "b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m, _ = B.learn(df)
    assert np.allclose((10**m.move).sum(axis=1), 1)
    # within a class its words and one unknown share the mass
    by = Counter()
    for w, i in m.place.items():
        by[m.classes[i]] += 10 ** (m.logs[i] - m.total[m.classes[i]])
    for c, mass in by.items():
        assert mass + 10 ** (math.log10(B.ALPHA) - m.total[c]) == pytest.approx(1)


def test_exchange_finds_alternating_groups():
    # two groups of words that follow each other
    n = np.zeros((12, 12), dtype=np.int64)
    rng = np.random.default_rng(0)
    group = rng.permutation(np.arange(12) % 2)
    for a in range(12):
        for b in range(12):
            if group[a] != group[b]:
                n[a, b] = rng.integers(5, 15)
    of = B.exchange(n, 2)
    assert len({(g, o) for g, o in zip(group.tolist(), of.tolist())}) == 2


def test_beats_the_unigram_on_held_out_text(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = B.score_all(df, *B.learn(df)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_many_words_of_one_count_still_give_classes(spark, monkeypatch):
    """A level of the histogram that doesn't fit is taken in part, in order."""
    monkeypatch.setattr(B, "KNOWN", 500)
    monkeypatch.setattr(B, "MERGED", 50)
    words = [f"w{i:05d}" for i in range(8000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(400)], "doc_id long, text string")
    m, counts = B.learn(df)
    assert [w for w in m.place] == [bytes(r["word"]) for r in counts.orderBy(F.desc("c"), "word").limit(500).collect()]
    assert len(set(m.classes.tolist())) > 1 and (m.classes < B.CLASSES).all()
    assert np.allclose((10**m.move).sum(axis=1), 1)


def test_every_known_word_gets_the_class_of_its_neighbours(spark, monkeypatch):
    """Rare words that stand where the words of one group stand go to that group's classes."""
    monkeypatch.setattr(B, "MERGED", 12)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = [("a" if k % 2 else "b") + str(rng.integers(0, 6) if rng.random() < 0.9 else rng.integers(6, 60)) for k in range(40)]
        rows.append((i, " ".join(words)))
    m, _ = B.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    sides = {}
    for w, i in m.place.items():
        sides.setdefault(m.classes[i], set()).add(w[:1])
    assert len(m.place) > 80 and all(len(x) == 1 for x in sides.values())
