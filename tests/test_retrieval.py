import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtrust.operators import retrieval as r


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, doc_type string, embedding array<float>")


def brute(rows, k, skip_self=True):
    out = set()
    for i, t, v in rows:
        found = []
        for j, u, w in rows:
            if t == u and not (skip_self and i == j):
                a, b = np.array(v, "f4").astype(float), np.array(w, "f4").astype(float)
                if np.any(a) and np.any(b):
                    found.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 10), j))
        out |= {(i, rank, j) for rank, (_, j) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("block_rows", [4, 7, 4096])
def test_top_k_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    rows = [(i, "hot" if i % 5 else "cold", rng.normal(size=8).round(3).tolist()) for i in range(120)]
    # Many exact copies, a zero vector, and a type with fewer rows than k.
    rows += [(1000 + i, "hot", rows[1][2]) for i in range(40)]
    rows += [(2000, "hot", [0.0] * 8), (3000, "rare", [1.0] * 8), (3001, "rare", [2.0] * 8)]
    df = vectors(spark, rows)
    got = r.top_k_similar(df.withColumnRenamed("id", "query_id"), df, 3, exclude_same_id=True, block_rows=block_rows)
    assert {(x["query_id"], x["rank"], x["id"]) for x in got.collect()} == brute(rows, 3)


def test_other_types_do_not_match(spark):
    q = vectors(spark, [(1, "a", [1.0, 0.0])]).withColumnRenamed("id", "query_id")
    assert r.top_k_similar(q, vectors(spark, [(2, "b", [1.0, 0.0])])).collect() == []


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [x[0] for x in df.select(r.cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(0.04), None]


def test_exemplar_text(spark):
    df = spark.createDataFrame(
        [("Acme Corp", "123 Main St", [("Widget A",), ("",), (None,), ("Widget B",)]), (None, "", None)],
        "v string, a string, items array<struct<description:string>>",
    )
    got = [x[0] for x in df.select(r.exemplar_text(F.col("v"), F.col("a"), F.col("items"))).collect()]
    assert got == ["Acme Corp\n123 Main St\nWidget A\nWidget B", ""]


def exemplars(spark):
    rows = [("e%02d" % i, "invoice", "Acme 1 Main" if i < 10 else f"Beta {i}", {"vendor_name": "Acme", "note": None}) for i in range(14)]
    return spark.createDataFrame(rows, "id string, doc_type string, layout_text string, extracted_fields map<string,string>")


def test_copies_of_one_text(spark):
    q = spark.createDataFrame(
        [("q1", "invoice", "Acme 1 Main"), ("q2", "invoice", "Acme 1 Main"), ("q3", "invoice", "  "), ("q4", "bank_statement", "Acme")],
        "query_id string, doc_type string, layout_text string",
    )
    found = r.retrieve_exemplars(q, exemplars(spark), r.letter_profile)
    got = {(x["query_id"], x["rank"], x["id"]) for x in found.collect()}
    assert got == {(n, i + 1, f"e0{i}") for n in ("q1", "q2") for i in range(3)}
    hashed = r.retrieve_exemplars(q, exemplars(spark))
    assert {(x["query_id"], x["rank"], x["id"]) for x in hashed.collect()} == got
    blocks = {x["query_id"]: x["few_shot"] for x in r.few_shot_blocks(found, exemplars(spark)).collect()}
    assert set(blocks) == {"q1", "q2"}
    assert "--- Example 1 (Acme) ---\n  vendor_name: 'Acme'\n" in blocks["q1"] and "Example 3" in blocks["q1"]
    assert "note" not in blocks["q1"]


def test_few_shot_of_nothing(spark):
    df = spark.createDataFrame([([],)], "shots array<struct<rank:int,entries:array<struct<key:string,value:string>>>>")
    assert df.select(r.few_shot_text(F.col("shots"))).first()[0] == ""


def test_off(spark):
    q = spark.createDataFrame([("q1", "invoice", "Acme")], "query_id string, doc_type string, layout_text string")
    assert r.retrieve_exemplars(q, exemplars(spark), None).collect() == []


def test_own_embedder(spark):
    import pandas as pd

    embed = r.pandas_embedding(lambda s: pd.Series([[float(len(t)), 1.0] for t in s]), dim=2)
    df = spark.createDataFrame([("abc",)], "layout_text string")
    assert embed(df, "layout_text").first()["embedding"] == [3.0, 1.0]


def test_small_blocks_share_tasks(spark, monkeypatch):
    """Copies of a row and tasks grow with bundles, not with blocks."""
    from fieldtrust.operators import retrieval

    calls, real = spark.sparkContext.accumulator(0), retrieval._block_product

    def counted(k, exclude):
        product = real(k, exclude)

        def run(q, c):
            calls.add(1)
            return product(q, c)

        return run

    monkeypatch.setattr(retrieval, "_block_product", counted)
    rows = [(i, "a", [float(i % 7), float(i % 11), 1.0]) for i in range(400)]
    corpus = spark.createDataFrame(rows, "id long, doc_type string, embedding array<double>")
    asked = corpus.withColumnRenamed("id", "query_id")
    wanted = sorted(map(tuple, retrieval.top_k_similar(asked, corpus, 3, True).collect()))
    calls.value = 0
    assert sorted(map(tuple, retrieval.top_k_similar(asked, corpus, 3, True, block_rows=16).collect())) == wanted
    assert calls.value <= 2
    monkeypatch.setattr(retrieval, "TASK_ROWS", 64)
    assert sorted(map(tuple, retrieval.top_k_similar(asked, corpus, 3, True, block_rows=16).collect())) == wanted
