import re

import pytest

from tabularium.llm import license_scan as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "!!!", "MIT License", "the mit-license and the MIT  LICENSE.", "cc by cc by-nc 4.0", "É GNU General\nPublic license x", "submit license mit licensed",
    "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: AND", "mit license " * 5000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_brute_force(text):
    got = L.scan(text.encode() if text is not None else None)
    assert got[:5] == brute(text)
    assert 0 <= got[6] <= 1 and set(filter(None, got[4].split(","))) <= set(got[5].split(","))


def test_precedence():
    p, n = L.parse("mit or gpl-2.0 and apache-2.0 with x trailing words")
    assert p == ["mit", "gpl-2.0", "apache-2.0", "x", ("with",), ("and",), ("or",)] and n == 7
    assert L.evaluate(p)[0] == {"mit", "gpl-2.0", "apache-2.0-with-x"}
    assert L.evaluate(L.parse("(mit or gpl-2.0) and cc-by-nc-4.0")[0])[1] == pytest.approx(0.1)
    for bad in ("", "and", "mit or", "(mit"):
        with pytest.raises(ValueError):
            L.parse(bad)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = L.scan_all(docs.withColumn("labels", docs.text)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == brute(texts[r["doc_id"]])
    assert L.scan_all(docs.limit(0)).count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "under the MIT License"), (1, "Apache License"), (1, "Apache License"), (2, None), (None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["base_labels"]) for r in L.scan_all(df).collect())
    assert got == [(0, 0, ""), (0, 4, "mit"), (1, 2, "apache"), (1, 2, "apache"), (2, 0, "")]
    assert L.scan_all(df.limit(0)).count() == 0
