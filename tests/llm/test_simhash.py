import random
import re

import numpy as np
import xxhash

from tabularium.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "one TWO", "É Ü a b", "a b c", "x y " * 5000, "nbsp joined word here"]
    texts += [" ".join(rng.choice(["alpha", "Beta", "gamma\n", "delta"]) for _ in range(n)) for n in range(1, 60)]
    for t in texts:
        assert S.fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


def planted(n, rng):
    """Random fingerprints with chains of one and two flipped bits."""
    out = [int(x) for x in rng.integers(0, 2**63, n, dtype=np.uint64)]
    for _ in range(n // 2):
        x = out[rng.integers(0, len(out))]
        for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


def brute_components(values, radius=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def test_index_finds_every_link():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 300):
        values = planted(n, rng)
        a, b = S.links_of(np.array(values, dtype=np.uint64))
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for x, y in zip(a.tolist(), b.tolist()):
            assert bin(x ^ y).count("1") <= 2
            p, q = find(x), find(y)
            root[max(p, q)] = min(p, q)
        want = brute_components(values)
        assert {v: find(v) for v in values} == want


def test_gray_rank_orders_gray_codes():
    i = np.arange(1 << 10, dtype=np.uint64)
    assert (S.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


def test_components_over_partitions(spark):
    rng = np.random.default_rng(4)
    values = planted(150, rng)
    rows = [(np.uint64(v).view(np.int64).item(),) for v in values]
    edges = S.link(spark.createDataFrame(rows, "fp long").repartition(5)).collect()
    root = brute_components(values)
    unsigned = lambda x: x & (2**64 - 1)
    found = {}
    for e in edges:
        a, b = unsigned(e["a"]), unsigned(e["b"])
        assert root[a] == root[b]
        found.setdefault(root[a], set()).add((a, b))
    sizes = {}
    for v in values:
        sizes[root[v]] = sizes.get(root[v], 0) + 1
    assert {r for r, n in sizes.items() if n > 1} == set(found)


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (4, "other text entirely here"), (7, None), (8, "  "), (2, ""), (None, base), (11, "x"), (11, "x")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    fps = {i: brute_fingerprint(t) for i, t in rows if i is not None}
    want = brute_components(sorted(set(fps.values())))
    for i, fp in fps.items():
        assert by[i]["fingerprint"] == f"{fp:016x}"
        assert by[i]["component_id"] == min(j for j, g in fps.items() if want[g] == want[fp])
    assert by[None]["component_id"] is None
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted([0, *[i for i, _ in rows if i is not None and by[i]["component_id"] == i]])
    assert S.near_duplicates(df.limit(0)).count() == 0 and S.keep_first(df.limit(0)).count() == 0
