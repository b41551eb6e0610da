"""The corpus pipeline, and the registered queries, on the smallest tables."""

from __future__ import annotations

import pytest

import corpus_pipeline
from cardinal.llm import mixing, quality, queries, secrets
from tests.llm.test_operators import grouped

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows(spark, tmp_path):
    words = [" ".join(f"word{(i * 37 + k * k) % 5000}x{k % 17}" for k in range(90)) for i in range(6)]
    texts = [None, "", " \n", words[0], words[0], words[0].upper(), words[1] + " password=hunter22", words[2], words[3], words[3], "short", words[4]]
    ids = [0, 1, 2, 3, 4, 5, 6, None, 8, 8, 9, 10]
    rows = [(i, t, ["en", None][k % 2], ["a", None, "b"][k % 3], len(t or ""), "r", "probability", k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string, p int"
    for part, given in (("odd", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/{part}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{part}/documents.parquet")
        seen = []
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"{tmp_path}/{part}")
            if len(seen) < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
                path = f"{tmp_path}/{part}/{len(seen)}"
                out.write.parquet(path)
                docs = spark.read.parquet(path)
                seen.append(docs.collect())
        assert out.count() == len(seen[-1])
        if given:
            assert sorted(str(r["doc_id"]) for r in seen[0]) == ["10", "3", "4", "6", "8", "8", "None"]  # 5 is all capitals
            assert sorted(str(r["doc_id"]) for r in seen[1]) == ["10", "3", "6", "8", "8", "None"]
            assert [r["text"] for r in seen[2] if r["doc_id"] == 6] == [words[1] + " [SECRET]"]
            assert {r["doc_id"] for r in seen[3]} <= {r["doc_id"] for r in seen[2]}
        else:
            assert not any(seen)


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, data)
        out.write.parquet(f"{tmp_path}/{k}")
        own = docs
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and after, name
        if k < 4:
            assert docs.columns == DOCUMENTS
        if k == 0:
            assert set(after) == {r["doc_id"] for r in quality.score(own).where("kept").collect()}
        if k == 1:
            ids = sorted(before)
            groups = grouped([before[i] for i in ids], 5, 80)
            assert set(after) == {ids[i] for i, (_, c) in groups.items() if i == c}
        if k == 2:
            assert set(after) == set(before)
            assert all(r["text"] == secrets.redact(before[i]) and r["n_chars"] == len(r["text"]) for i, r in after.items())
        if k == 3:
            assert set(after) == {r["doc_id"] for r in mixing.probabilities(own).where("drawn").collect()}
        if k == 4:
            assert set(after) == set(before) and all(r["round_trip"] for r in after.values())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_whole_tables(spark, data, name):
    out = queries.QUERIES[name](spark, data)
    table = {"op3_ann": None, "op4_html_text": "pages", "op9_chat_format": None}.get(name, "documents")
    n = out.count()
    assert n == spark.read.parquet(f"{data}/{table}.parquet").count() if table else n > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cursor = con.execute(queries.ORACLES[name])
    own, columns = [d[0] for d in cursor.description], sorted(df.columns)
    assert sorted(own) == columns
    expected = sorted(repr(tuple(r[own.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected
