import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabularium.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "a", "a  b   c ", "a\n b", "x \n\n y", "tab\t tab", "don't we'll", "é à  b", "<|endoftext|> x", "a <|endoftext|>", "a  <|endoftext|><|endoftext|>  b <|endoftex|>", "\0 a b", "word " * 3000, "日本 語", "end  ", " \n", "1 2,3 !?", "a　 b"]


TOKENIZER = Tokenizer.from_file(PATH)


def encode(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers(spark, sf):
    e = packing.Encoder.of(PATH)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for text in texts:
        assert np.frombuffer(e.ids(text or ""), "<u4").tolist() == encode(text), repr(text)


def check(rows, texts, length):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, parts in by_doc.items():
        ids = encode(texts[doc]) + [0]
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_seq)


def test_pack_round_trip(spark):
    texts = dict(enumerate(ODD)) | {100 + i: "some words here " * i for i in range(80)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, length int")
    rows = packing.pack(df, PATH, 64).collect()
    n = check(rows, texts, 64)
    total = sum(r["length"] for r in rows)
    assert n <= 1.1 * total / 64 + 2


def test_pack_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], schema), PATH).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_linear_program_meets_demand():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(1, 200, 5000), return_counts=True)
    columns, used = packing.linear_program(sizes, counts.astype(float), 256)
    assert np.allclose(used @ columns, counts) and (columns @ sizes <= 256).all()
    slots, n = packing.plan(dict(zip(sizes.tolist(), counts.tolist())), 256)
    assert n <= 1.02 * (counts @ sizes) / 256 + 1


def test_knapsack_is_best():
    sizes = np.array([3, 5, 7])
    value, pattern = packing.knapsack(sizes, np.array([0.3, 0.52, 0.75]), 16)
    best = max(a * 0.3 + b * 0.52 + c * 0.75 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert abs(value - best) < 1e-9 and pattern @ sizes <= 16
