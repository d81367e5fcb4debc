import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import language_id as L, pivot_topk as P, quality as Q
from tabularium.llm.common import fold

SF = "/root/testdata/sf0.01"


# -- language -----------------------------------------------------------------------------------------------------------


def greedy(model, j, codes):
    """Phrases of a text by definition: the longest that occur in the language's sample."""
    n, at = 0, 0
    sample = model[j]
    while at < len(codes):
        k = 1
        while at + k < len(codes) and codes[at : at + k + 1] in sample:
            k += 1
        n += 1
        at += k
    return n


HAN = "".join(chr(0x4E00 + 7 * i) for i in range(400))
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def drawn(rng, letters, n):
    words = ["".join(rng.choice(list(letters), rng.integers(1, 6))) for _ in range(80)]
    return " ".join(words[i] for i in rng.integers(0, 80, n))


@pytest.mark.parametrize("dense", [3, L.DENSE])
@pytest.mark.parametrize("piece", [7, L.PIECE])
def test_parsing_equals_the_longest_matches(monkeypatch, dense, piece):
    monkeypatch.setattr(L, "DENSE", dense)
    monkeypatch.setattr(L, "PIECE", piece)
    rng = np.random.default_rng(4)
    own = {"el": drawn(rng, GREEK, 300), "ru": drawn(rng, CYRILLIC, 300), "zh": drawn(rng, HAN, 300)}
    texts = {"a": "abra cadabra abrakadabra", "b": "lorem ipsum dolor sit amet"} | own
    m = L.Model(texts)
    chars = lambda codes: "".join(chr(0x1000 + c) for c in codes)
    plain = {j: chars(m.code[L.points(texts[lang])]) + "!" for j, lang in enumerate(m.langs)}
    many = ["abracadabra", "dolor abra", "a", "zzz", "ipsumlorem cad", own["ru"], own["zh"][:1100], "x".join(own["el"][i : i + 40] for i in range(0, 900, 30))]
    many += [drawn(rng, GREEK + CYRILLIC + "abx", 250), drawn(rng, HAN + "雪", 300), own["ru"][100:600] + "ф" + own["ru"][3:700]]
    rate, has = m.rates(many)
    assert has.all()
    for text, found in zip(many, rate):
        codes = "".join("?" if c == L.UNKNOWN else chr(0x1000 + c) for c in m.code[L.points(text)])
        for j in plain:
            assert round(found[j] * len(text)) == greedy(plain, j, codes), (text[:40], j)
    assert [m.langs[k] for k in rate.argmin(axis=1)[5:8]] == ["ru", "zh", "el"]
    # a text that is the sample itself is one phrase, however long
    assert round(rate[5][m.langs.index("ru")] * len(own["ru"])) == 1


def test_sample_is_of_whole_texts(spark):
    rows = [(i, "opening " * 400 + "middle " * 400 + "closing " * 400, "en") for i in range(60)]
    got = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]
    assert all(x in got for x in ("opening", "middle", "closing")) and len(got) <= L.SAMPLE_CHARS + 3 * L.SAMPLE_DOCS


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs, L.sample(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(fold() == 0)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_language_edges(spark):
    rows = [(i, "the quick brown fox jumps over it " * 5, "en") for i in range(20)] + [(20 + i, "der schnelle braune fuchs springt " * 5, "de") for i in range(20)]
    rows += [(100, None, None), (101, "", "en"), (102, "12 34 !!", None), (103, "THE FOX", None), (104, "der fuchs " * 5000, None), (None, "the fox", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    texts = L.sample(df)
    got = {r["doc_id"]: r for r in L.identify(df, texts).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "en", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows)
    kept = L.keep_identified(df, texts)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert L.sample(df.limit(0)) == {} and L.identify(df, {}).where("lang_pred != 'und'").count() == 0 and L.keep_identified(df, {}).count() == 0


def test_sample_is_of_the_training_folds(spark):
    rows = [(i, f"{'held' if zlib.crc32(str(i).encode()) % 5 == 0 else 'train'} words", "en") for i in range(200)]
    assert "held" not in L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["en"]


def test_a_worker_keeps_one_model_and_gives_memory_back():
    """Models of earlier samples go, and so does what a task has freed, though something lives above it on the heap."""
    for texts in ({"a": "abra cadabra"}, {"b": "lorem ipsum"}):
        L.Model.of(texts)
    assert [x.langs for x in L._cache.values() if isinstance(x, L.Model)] == [["b"]]
    code = """
import psutil
from tabularium.llm.common import tidy
rss = lambda: psutil.Process().memory_info().rss >> 20
def run(batches):
    held = [bytearray(100_000) for _ in range(2000)]
    kept.append(bytearray(100_000))
    del held
    yield from batches
kept = []
for f in (run, tidy(run)):
    before = rss()
    list(f(iter([])))
    print(rss() - before)
"""
    left = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    as_was, tidied = map(int, left.stdout.split())
    assert tidied < 50 and tidied < max(as_was, 50), left.stdout


# -- quality ------------------------------------------------------------------------------------------------------------


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.score_all(docs, Q.fit(docs, labels)).join(labels, "doc_id").where(fold() == 0).collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(0, 1, (1500, Q.N_FEATURES)), rng.normal(4, 1, (300, Q.N_FEATURES))
    unlabelled = np.concatenate([rng.normal(0, 1, (700, Q.N_FEATURES)), negative])
    assert abs(Q.estimate_prior(positive, unlabelled) - 0.7) < 0.15
    net, _ = Q.learn(positive, unlabelled)
    assert (Q._sigmoid(net.value(negative)) < 0.5).mean() > 0.95 and (Q._sigmoid(net.value(positive)) > 0.5).mean() > 0.95


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 1), (None, "a b", 1), (3, "w " * 50000, 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    assert Q.fit(df, labels) is None
    assert {r["score"] for r in Q.score_all(df, None).collect()} == {0.5}
    model = Q.learn(np.array([Q.features(b"good words here")] * 5), np.array([Q.features(b"x | y | z")] * 5))
    rows = Q.score_all(df, model).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_features_by_definition():
    text = "Good good words. It is, is good\n| x | 42\nGood good words.".encode()
    f = Q.features(text)
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    assert f[0] == pytest.approx(np.log1p(n) / 10) and f[3] == pytest.approx(2 / len(text)) and f[5] == pytest.approx(2 / n)
    assert f[12] == pytest.approx(len(set(words)) / n) and f[14] == pytest.approx(max(words.count(w) for w in words) / n)
    assert f[16] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / n) and f[17] == pytest.approx(len(set(lines)) / len(lines))
    assert len(f) == Q.N_FEATURES and Q.features(None) == Q.features(b"") == [0.0] * Q.N_FEATURES


def test_quality_of_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    model = Q.learn(np.array([Q.features(b"good words here")] * 5), np.array([Q.features(b"x | y | z")] * 5))
    assert Q.score_all(spark.createDataFrame([], schema), model).count() == 0
    rows = Q.score_all(spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "x | y")], schema), model).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 2
    assert Q.fit(spark.createDataFrame([], schema), spark.createDataFrame([], "doc_id long, quality int")) is None


# -- top k --------------------------------------------------------------------------------------------------------------


def brute(rows, queries, k):
    out = set()
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in ok:
        if queries(q):
            found = sorted((-int(a @ b), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, [0.0] * 8), (63, None), (64, []), (65, [float("nan")] * 8), (66, [1.0, None] * 4), (67, [0.5, 0.5]), (70, [2.0, 1.0]), (None, rows[1][1]), (68, [3e6] * 8), (69, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {tuple(r) for r in P.top_k(df, F.col("vec_id") % 5 == 0, 5, block=block).collect()}
    assert got == brute(rows, lambda q: q % 5 == 0, 5)
    assert P.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_pivots_leave_rows_out():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 3, (2000, 4)), rng.normal(40, 1, (300, 4))])
    x = np.floor(x * 16).astype(np.int64)
    p = P.Pivots(x)
    q = x[-1]
    assert (p.bounds(q.astype(float)) >= x @ q).all()
    ids, scores = p.best(q, -1, np.arange(len(x)), 5)
    assert scores.tolist() == sorted((x @ q).tolist(), reverse=True)[:5]
    assert (p.bounds(q.astype(float)) < scores[-1]).sum() > 1500
