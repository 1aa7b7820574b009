import random

import duckdb
import pytest

from sparkseek.llm.mixing import SQL, mix_sources, mixed_documents


def sized(rng, n, sources=("a", "b", "c", None)):
    weights = [12, 3, 1, 1][: len(sources)]
    return [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choices(sources, weights)[0]) for i in range(n)]


def test_agrees_with_sql_and_meets_targets(docs, awkward):
    rows = [*sized(random.Random(1), 400), *((1000 + r[0], *r[1:]) for r in awkward if r[0])]
    got = mix_sources(docs(rows)).toPandas()
    documents = docs(rows).toPandas()  # noqa: F841
    want = duckdb.sql(SQL.replace("documents", "documents")).df()
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    order = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()))
    assert order(got) == order(want)
    assert (got["taken"] <= 2 * got["size"]).all()
    total = got["size"].sum()
    by = got.groupby(got["source"].fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), n=("source_size", "first"))
    assert (by["target"] <= 2 * by["n"] + 1e-6).all()
    assert by["target"].sum() == pytest.approx(1.5 * total)
    assert by.loc["a", "taken"] == pytest.approx(by.loc["a", "target"], rel=0.02)


def test_documents_as_often_as_taken(spark):
    rows = spark.createDataFrame([(i, "x y z", "s" if i % 3 else "t", i, "keep") for i in range(30)], "doc_id long, text string, source string, size int, h string")
    counts = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(rows).collect()}
    out = mixed_documents(rows)
    assert out.columns == rows.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        assert r["size"] == r["doc_id"]
    assert seen == {k: v for k, v in counts.items() if v}


def test_empty_tables_and_texts(docs):
    assert mix_sources(docs([])).count() == 0
    assert mixed_documents(docs([])).count() == 0
    got = mix_sources(docs([(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in got) == [(1, 0, 0), (2, 0, 0)]
