from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from worktrace.operators import access, vector_index


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")


def brute(vectors, queries, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in queries:
        s = unit @ unit[i]
        out[i] = [j for _, j in sorted((-s[j], j) for j in range(len(s)) if j != i)[:k]]
    return out


def recall(found, want):
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    return sum(len(got.get(i, set()) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(4)
    return (r.normal(size=(40, 24))[r.integers(0, 40, 4000)] + 0.25 * r.normal(size=(4000, 24))).astype(np.float64)


def test_few_cells_are_enough_where_vectors_cluster(spark, clustered, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = frame(spark, clustered)
    vector_index.build(rows, path)
    settings = spark.read.parquet(f"{path}/settings").first()
    queries = rows.filter("id % 50 = 0")
    want = brute(clustered, range(0, 4000, 50), 5)
    assert settings["n"] == 4000 == spark.read.parquet(f"{path}/entries").count()
    assert settings["probes"] <= settings["cells"] / 8
    assert recall(vector_index.search(queries, path), want) >= 0.9
    # vectors whose codes are read for a query, and whose full vectors are
    cells = vector_index._Cells(spark.read.parquet(f"{path}/cells").collect())
    asked = vector_index._usable(queries).select(F.col("id").alias("query_id"), "embedding", F.lit(-2.0).alias("least"))
    probed = asked.mapInArrow(vector_index._probed(cells, settings["probes"]), "cell int, part int, query_id long, q array<double>, least double")
    sizes = spark.read.parquet(f"{path}/cells").select("cell", "n")
    assert probed.join(sizes, "cell").agg(F.sum("n")).first()[0] / 80 < 0.15 * 4000


def test_exact_search_equals_brute_force(spark, clustered, tmp_path):
    vectors = np.concatenate([clustered[:600], clustered[:3], np.random.default_rng(1).normal(size=(200, 24))])
    rows, path = frame(spark, vectors), f"file://{tmp_path}/index"
    vector_index.build(rows, path, cells=20)
    found = {(r["query_id"], r["rank"]): r["id"] for r in vector_index.search(rows.filter("id % 20 = 0"), path, exact=True).collect()}
    want = brute(vectors, range(0, len(vectors), 20), 5)
    assert found == {(i, k + 1): j for i, w in want.items() for k, j in enumerate(w)}


def test_parts_and_blocks_change_nothing(spark, clustered, tmp_path, monkeypatch):
    rows, path = frame(spark, clustered[:500]), f"file://{tmp_path}/index"
    monkeypatch.setattr(vector_index, "PART_ROWS", 60)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 7)
    vector_index.build(rows, path, cells=5)
    assert spark.read.parquet(f"{path}/entries").select("part").distinct().count() > 5
    found = {(r["query_id"], r["rank"]): r["id"] for r in vector_index.search(rows.filter("id < 40"), path, exact=True).collect()}
    assert found == {(i, k + 1): j for i, w in brute(clustered[:500], range(40), 5).items() for k, j in enumerate(w)}


def test_odd_rows(spark, tmp_path):
    schema = "id long, embedding array<float>, cell int"
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (4, None, 1), (5, [-1.0, 0.0], None), (5, [-1.0, 0.0], None)]
    df, path = spark.createDataFrame(rows, schema), f"file://{tmp_path}/index"
    vector_index.build(df, path)
    found = vector_index.search(df, path, k=2, exact=True).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in found) == [(1, 1, 2), (1, 2, 5), (2, 1, 1), (2, 2, 5), (5, 1, 2), (5, 2, 1)]
    empty = f"file://{tmp_path}/empty"
    vector_index.build(df.filter("false"), empty)
    assert vector_index.search(df, empty).count() == 0 == vector_index.search(df, empty, exact=True).count()


def test_recall_on_the_given_table(spark, tmp_path):
    """Vectors without any structure: half of the cells are needed, but only some full vectors a query."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    path = f"file://{tmp_path}/index"
    vector_index.build(table, path)
    queries = table.filter("id % 50 = 0")
    want = {}
    for r in access.most_similar(queries, table).collect():
        want.setdefault(r["query_id"], []).append(r["id"])
    assert recall(vector_index.search(queries, path), want) >= 0.9
