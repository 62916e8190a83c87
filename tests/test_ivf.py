"""The list index: every row is in one list, few lists give nearly all neighbours, and stored lists are pruned."""

import numpy as np

from sonda.operators import ivf


def test_lists(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 4
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id int, v array<double>").repartition(3)
    index = ivf.build(df, "id", "v", 20, fit_rows=600)
    stored = index.write(str(tmp_path / "lists"))
    assert stored.df.count() == 1500 and stored.df.select("id").distinct().count() == 1500
    queries = [x[i].tolist() for i in range(0, 1500, 150)]
    assert ivf.recall(stored, queries, 10, 4) >= 0.9
    assert ivf.recall(stored, queries[:2], 10, 20) == 1
    plan = stored.search(queries[0], 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert ivf.build(df.limit(0), "id", "v", 3).df.count() == 0


def test_generated_vectors(spark, tmp_path):
    from sonda.sources import generate

    df = generate.random_vectors(spark, 100, 6, 3)
    rows = {r["id"]: r["vector"] for r in df.collect()}
    assert len(rows) == 100 and all(len(v) == 6 and all(0 <= x < 1 for x in v) for v in rows.values()) and rows[1] != rows[2]
    assert rows == {r["id"]: r["vector"] for r in generate.random_vectors(spark, 100, 6, 3).repartition(3).collect()}
    df.write.parquet(str(tmp_path / "v"))
    unit = generate.load_vectors(spark, str(tmp_path / "v"), unit=True).first()["vector"]
    assert abs(sum(x * x for x in unit) - 1) < 1e-9


def test_vectors_in_memory(spark):
    from sonda.sources.memory import VectorIndex

    rng = np.random.default_rng(12)
    x, q = rng.normal(size=(400, 6)), rng.normal(size=(7, 6))
    near = lambda d: [np.argsort(r, kind="stable")[:5].tolist() for r in d]
    exact = near(((q[:, None] - x[None]) ** 2).sum(2))
    plain = VectorIndex(spark).fit(x)
    assert plain.query_many(q, 5) == exact == [plain.query(v, 5) for v in q]
    unit = VectorIndex(spark, "cosine", angular=True).fit(x * rng.uniform(1, 9, (400, 1)))
    assert unit.query_many(q, 5) == near(1 - (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None])
    lists = VectorIndex(spark, lists=8, probes=8).fit(x)
    assert lists.query_many(q, 5) == exact and lists.query(q[0], 5) == exact[0]
    few = VectorIndex(spark, lists=8, probes=5).fit(x).query_many(q, 5)
    assert sum(len(set(a) & set(b)) for a, b in zip(few, exact)) >= 0.7 * 35
    assert VectorIndex(spark).fit(x[:3]).query(q[0], 5) == near(((q[:1, None] - x[None, :3]) ** 2).sum(2))[0]
