import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tabularium.llm import chat, queries


def rows(*said):
    return [(c, n, role, text, "x") for c, turns in said for n, (role, text) in enumerate(turns)]


A, B, C = ("user", "hi"), ("assistant", "yes"), ("user", None)


def test_maximal_conversations(spark):
    data = rows((1, [A]), (2, [A, B]), (3, [A, B, C]), (4, [A, B, C]), (5, [B]), (6, [A, C]), (7, [("user", "")]), (8, [("user", ""), A])) + [(None, 0, "user", "hi", "x"), (9, None, None, None, "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, prefixes string")
    got = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert set(got) == {3, 5, 6, 8, 9}
    assert got[3]["n_turns"] == 3 and got[3]["text"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\n<|im_end|>"
    assert chat.render(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [d[:4] for d in data])
    assert {r[0]: r[2] for r in con.execute(chat.SQL).fetchall()} == {k: r["text"] for k, r in got.items()}


def test_hashes_tell_boundaries_apart(spark):
    df = spark.createDataFrame([(1, 0, "user", "a|1:b"), (2, 0, "user", "a"), (2, 1, "1", "b")], "conv_id long, turn long, role string, text string")
    assert chat.render(df).count() == 2


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names and dict(out.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    packed = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    assert 0 < len(kept) < docs.count()


def test_stages_by_planted_cases(spark, sf, tmp_path):
    """Each stage on rows with copies, a leak, nulls, repeated rows and a column with a clashing name."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    source = docs.where("lang = 'en' and length(text) between 800 and 2000").orderBy("doc_id").first()
    planted = [(10_000, source["text"]), (10_001, f"{source['text'][:300]} {item}"), (10_002, None), (10_003, "12 34 !! 56"), (10_004, ""), (None, source["text"] + " more"), (10_005, "The and of. " * 3000), (10_005, "The and of. " * 3000)]
    extra = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in planted], docs.schema)
    df = docs.union(extra).withColumn("component_id", F.lit(7)).withColumn("line_no", F.col("doc_id"))
    stages = dict(corpus_pipeline.STAGES)

    def texts(frame):
        assert frame.columns == df.columns
        found = {}
        for r in frame.collect():
            assert r["component_id"] == 7 and r["line_no"] == r["doc_id"]
            found.setdefault(r["doc_id"], []).append(r["text"])
        return found

    known = stages["language_id"](spark, df, sf)
    known.write.parquet(str(tmp_path / "known"))
    known = spark.read.parquet(str(tmp_path / "known"))
    kept = texts(known)
    assert not {10_002, 10_003, 10_004} & set(kept) and {10_000, 10_001, source["doc_id"], None} <= set(kept)
    clean = {r["doc_id"] for r in docs.where("length(text) > 200 and lang is not null").collect()}
    assert len(clean & set(kept)) >= 0.9 * len(clean)
    lines = texts(stages["line_dedup"](spark, known, sf))
    assert set(lines) == set(kept) and len(lines[10_005]) == len(kept[10_005])
    # the row without an id comes first; the source's other copy loses what they share
    assert lines[10_000] == [""] or len(lines[10_000][0]) < 0.5 * len(source["text"])
    single = texts(stages["simhash_dedup"](spark, known, sf))
    assert 10_000 not in single and None in single and (source["doc_id"] in single or min(single.keys() - {None}) < source["doc_id"])
    assert 10_001 not in texts(stages["decontaminate"](spark, known, sf))
    packed = stages["packing"](spark, known, sf).collect()
    assert {r["doc_id"] for r in packed} == set(kept)


def test_query_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
