import random
import sys

from tabularium.llm import line_dedup as L

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def line(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(text, n):
    t = list(text)
    for _ in range(n):
        t[rng.randrange(len(t))] = "é"
    return "".join(t)


def shingles(x):
    return {x[i : i + L.SHINGLE] for i in range(max(1, len(x) - L.SHINGLE + 1))}


def brute(docs):
    """Component's first place of each line's place, by all pairs of distinct lines."""
    places = {}
    for doc, text in docs:
        for n, x in enumerate((text or "").split("\n")):
            if x.strip(" "):
                places.setdefault(x, []).append((doc, n))
    texts = sorted(places)
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {x: shingles(x) for x in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            c = len(sets[a] & sets[b])
            if c >= L.THRESHOLD * (len(sets[a]) + len(sets[b]) - c):
                root[find(a)] = find(b)
    first = {}
    for x in texts:
        first[find(x)] = min(first.get(find(x), (1 << 62, 0)), *places[x]) if find(x) in first else min(places[x])
    return {p: first[find(x)] for x in texts for p in places[x]}


def documents():
    base = [line(rng.randint(8, 40)) for _ in range(40)]
    docs = []
    for d in range(60):
        rows = []
        for _ in range(rng.randint(0, 6)):
            x = rng.choice(base)
            r = rng.random()
            rows.append(x if r < 0.3 else near(x, rng.randint(1, 3)) if r < 0.7 else line(rng.randint(1, 30)))
        docs.append((d, "\n".join([*rows, "", "  "])))
    hot = line(30)
    docs += [(100 + i, near(hot, 1 + i % 2) + "\nshort") for i in range(40)]
    return docs + [(200, None), (201, ""), (202, "x"), (203, "x\nx"), (204, "long " * 5000)]


def test_equals_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame([(d, t, 1, "e") for d, t in docs], "doc_id long, text string, id int, key string").repartition(3)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in L.classes(df).collect()}
    want = brute(docs)
    assert got.keys() == want.keys()
    wrong = [p for p in want if got[p] != want[p]]
    assert len(wrong) <= 0.01 * len(want), wrong[:5]
    # the pipeline's form: kept lines stay in order, other columns are untouched
    out = {r["doc_id"]: r for r in L.dedup_lines(df).collect()}
    assert len(out) == len(docs)
    for d, t in docs:
        if t is None:
            assert out[d]["text"] is None
            continue
        kept = [x for n, x in enumerate(t.split("\n")) if (d, n) not in got or got[d, n] == (d, n)]
        assert out[d]["text"] == "\n".join(kept) and out[d]["id"] == 1


def test_edges(spark):
    schema = "doc_id long, text string, n_chars long"
    rows = [(1, "same line here\nsame line here", 29), (1, "same line here\nsame line here", 29), (None, "same line here", 14), (None, None, None), (2, "\n\n", 2)]
    df = spark.createDataFrame(rows, schema)
    out = L.dedup_lines(df)
    assert out.schema == df.schema or out.columns == df.columns
    got = sorted(((r["doc_id"] or 0, r["text"] or "", r["n_chars"]) for r in out.collect()), key=str)
    assert got == sorted([(0, "same line here", 14), (0, "", None), (1, "", 0), (1, "", 0), (2, "\n\n", 2)], key=str)
    assert L.classes(df.limit(0)).count() == 0 and L.dedup_lines(df.limit(0)).count() == 0


def answers(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in L.classes(df).collect()}


def test_star_groups(spark):
    """Copies that are like their source and not like each other."""
    docs = []
    for source, (copies, size, edits) in enumerate([(20, 100, 1), (100, 300, 3), (1000, 300, 3)]):
        own = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(size))
        places = [rng.randrange(10_000) for _ in range(copies + 1)]
        docs += [(source * 100_000 + p * 10 + i % 10, own if i == copies // 2 else near(own, edits)) for i, p in enumerate(places)]
    docs = list({d: (d, t) for d, t in docs}.values())
    got, want = answers(spark, docs), brute(docs)
    assert got.keys() == want.keys()
    wrong = [p for p in want if got[p] != want[p]]
    assert len(wrong) <= 0.005 * len(want), (len(wrong), len(want))


def test_recall_at_the_threshold(spark):
    """Pairs of 400 shingles each at a similarity of 0.8 share a band, all but 0.8 % of them."""
    letters, pairs = "abcdefghijklmnopqrst", []
    for _ in range(2000):
        a = "".join(rng.choices(letters, k=407))
        i = rng.randrange(10, 350)
        pairs.append((a, a[:i] + "".join(rng.choices(letters, k=37)) + a[i + 37 :]))
    x, y = shingles(pairs[0][0]), shingles(pairs[0][1])
    assert 0.8 <= len(x & y) / len(x | y) < 0.81
    rows = [(i * 2 + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    got = answers(spark, rows)
    missed = sum(got[i * 2 + 1, 0] != (i * 2, 0) for i in range(len(pairs)))
    assert missed <= 0.008 * len(pairs), missed


def test_long_lines_that_repeat_themselves(spark):
    """Lines of few distinct shingles for their length are like their copies of another length."""
    texts = []
    for words in ["=", "ab cd ", *[line(8) + " " for _ in range(60)]]:
        n = 400 if words == "=" else 8000
        texts += [(words * n)[:n], (words * n)[: n - len(words)] if words != "=" else "=" * 500]
    got = answers(spark, list(enumerate(texts)))
    wrong = [texts[i][:20] for i in range(1, len(texts), 2) if got[i, 0] != (i - 1, 0)]
    assert not wrong, (len(wrong), wrong[:3])


def test_crowded_bands_and_large_tables(spark, monkeypatch):
    """Bands that are dealt anew, blocks, joins without broadcasts and filters give the same classes."""
    monkeypatch.setattr(L, "BLOCK", 8)
    monkeypatch.setattr(L, "BROADCAST", 0)
    monkeypatch.setattr(L, "TABLE_BITS", 3)
    common = line(40)
    docs = [(i, common + " " + line(60) + ("\U0001f600" if i % 2 else "")) for i in range(60)]
    docs += [(100 + i, near(docs[i][1], 2)) for i in range(0, 60, 3)]
    got, want = answers(spark, docs), brute(docs)
    assert got.keys() == want.keys()
    assert sum(got[p] != want[p] for p in want) <= 1


def test_pairs_at_the_threshold_and_repeats(spark):
    """Pairs are compared by distinct shingles, those just at and just below the threshold too."""
    texts = ["".join(chr(0x4E00 + i) for i in range(a, a + 16)) for a in (0, 1, 2)] + ["ab" * 50, "ab" * 9, "\U0001f600" + "".join(chr(0x4E00 + i) for i in range(16)), "x", "x" * 8, "x" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    pairs = [(i, j) for j in range(len(texts)) for i in range(j)]
    got = {(r["a"], r["b"]) for r in L.similar(spark.createDataFrame(pairs, "a long, b long"), df).collect()}
    sets = [shingles(x) for x in texts]
    assert got == {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= L.THRESHOLD * len(sets[i] | sets[j])}
    assert (0, 1) in got and (0, 2) not in got and (3, 4) in got


def test_files_of_done_steps_are_released(spark, monkeypatch):
    """When pairs are compared, nothing holds the bands' tables any more, and Spark has been told to look: their files are most of the disk."""
    release, similar, steps = L.release, L.similar, []

    def released(session):
        steps.append(set(sys._getframe(1).f_locals))
        release(session)

    def compared(pairs, texts):
        steps.append("compared")
        return similar(pairs, texts)

    monkeypatch.setattr(L, "release", released)
    monkeypatch.setattr(L, "similar", compared)
    x = line(20)
    answers(spark, [(i, near(x, 1)) for i in range(4)])
    held = steps[steps.index("compared") - 1]
    assert {"pairs", "texts"} <= held and not {"keyed", "shared"} & held, held


def test_places_at_the_ends_of_long(spark):
    """Ids at the ends of the range keep their place, ids of repeated lines too."""
    low, high = -(1 << 63) + 1, (1 << 63) - 1
    got = answers(spark, [(high, "one line here\nother line there"), (low, "x\none line here"), (0, "other line there\nother line there")])
    assert got == {(high, 0): (low, 1), (high, 1): (0, 0), (low, 0): (low, 0), (low, 1): (low, 1), (0, 0): (0, 0), (0, 1): (0, 0)}
