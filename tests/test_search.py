"""Exact search for more queries than fit a plan."""

import numpy as np

from quillspark.operators import search


def test_any_number_of_queries(spark):
    rng = np.random.default_rng(2)
    store, asked = rng.integers(-3, 4, (60, 4)) + 0.5, rng.integers(-3, 4, (1100, 4)) + 0.5
    rows = spark.createDataFrame([(i, i, x.tolist()) for i, x in enumerate(store)], "id long, ins_ord long, embedding array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "query_id long, query array<double>")
    score = asked @ store.T / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(store, axis=1))
    got = search.top_k_each(rows, queries, 3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(i, k) for i in range(1100) for k in (1, 2, 3)]
    best = -np.sort(-score, axis=1)
    for r in got:
        assert abs(r["score"] - best[r["query_id"], r["rank"] - 1]) < 1e-9
        assert abs(r["score"] - score[r["query_id"], r["id"]]) < 1e-9


def test_ties_blocks_groups_and_odd_vectors(spark, monkeypatch):
    for name, value in {"QUERY_ROWS": 3, "STORE_ROWS": 7, "STRETCH": 2}.items():
        monkeypatch.setattr(search, name, value)
    vectors = [[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [1.0], [1.0, 1.0], [1.0, 0.0]]
    rows = spark.createDataFrame([(f"v{j}{g}", i * 10 + j, v, g) for g in ("a", "b", None) for i, v in enumerate(vectors) for j in range(2)], "id string, ins_ord long, embedding array<double>, grp string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0])], "query_id int, query array<double>")
    got = {(r["query_id"], r["grp"]): [] for r in search.top_k_groups(rows, queries, 3).collect()}
    for r in search.top_k_groups(rows, queries, 3).orderBy("rank").collect():
        got[r["query_id"], r["grp"]].append(r["ins_ord"])
    assert got == {(q, g): want for g in ("a", "b", None) for q, want in ((1, [0, 1, 10]), (2, [20, 21, 60]))}
    assert search.top_k_groups(rows.limit(0), queries, 3).count() == 0 and search.top_k_groups(rows, queries.limit(0), 3).count() == 0


def test_paths_of_a_document_with_many_headings(spark):
    from pyspark.sql import functions as F

    from quillspark.operators import chunks

    n = 100_000
    heads = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("section"), (F.col("id") % 4 + 1).alias("level"), F.col("id").cast("string").alias("title"))
    got = chunks.heading_paths(heads.unionByName(heads.limit(3).withColumn("doc_id", F.lit("e"))).repartition(5))
    assert got.filter("doc_id = 'd'").count() == n and got.agg(F.max(F.size("section_path"))).first()[0] == 4
    assert got.filter(f"section = {n - 1}").first()["section_path"] == [str(n - 4 + i) for i in range(4)]
    odd = spark.createDataFrame([("d", i, v, str(i)) for i, v in enumerate([1, 3, 2, 3, 0, 9])], "doc_id string, section long, level int, title string")
    assert [r["section_path"] for r in chunks.heading_paths(odd).orderBy("section").collect()] == [["0"], ["0", "1"], ["0", "2"], ["0", "2", "3"], ["4"], ["4", "5"]]
