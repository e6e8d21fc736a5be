import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_index as v

RNG = np.random.default_rng(3)


def written(spark, path, rows, **options):
    df = spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(rows)], "id long, vec array<float>")
    v.write_index(df, str(path), "id", "vec", **options)
    return df


def brute(rows, asked, k):
    units = {i: np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)) for i, x in enumerate(rows) if x is not None and np.any(x)}
    score = {i: round(float(u @ units[asked]), 6) for i, u in units.items()}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


@pytest.fixture(scope="module")
def clustered():
    centres = RNG.normal(size=(40, 16))
    rows = [list(c + 0.15 * RNG.normal(size=16)) for c in centres for _ in range(40)]
    return rows + [None, [0.0] * 16, rows[0], rows[0]]


def test_clustered_vectors_need_few_lists(spark, tmp_path, clustered):
    df = written(spark, tmp_path / "i", clustered)
    about, centroids, rows = v._about(spark, str(tmp_path / "i"))
    assert 20 <= len(centroids) <= 40 and about["probes"] <= 12
    assert rows.count() == len(clustered) and {r["id"] for r in rows.filter("list_no = -1").collect()} == {1600, 1601}
    asked = df.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("vec").alias("vector"))
    found = {}
    for r in v.nearest(spark, str(tmp_path / "i"), asked, 20, block=32).collect():
        found.setdefault(r["query"], {})[r["rank"]] = r["id"]
    share = [len(set(found[q].values()) & set(brute(clustered, q, 20))) / 20 for q in found]
    assert len(found) == 80 and np.mean(share) >= 0.9
    exact = {}
    for r in v.nearest(spark, str(tmp_path / "i"), asked, 20, probes=None, block=32).collect():
        exact.setdefault(r["query"], {})[r["rank"]] = r["id"]
    assert all([exact[q][i] for i in range(1, 21)] == brute(clustered, q, 20) for q in exact) and len(exact) == 80
    one = v.nearest_to(spark, str(tmp_path / "i"), clustered[0], 20)
    assert {0, 1602, 1603} <= {r["id"] for r in one.collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_no" in plan
    assert [r["id"] for r in v.nearest_to(spark, str(tmp_path / "i"), clustered[0], 20, probes=None).collect()] == brute(clustered, 0, 20)
    assert v.nearest_to(spark, str(tmp_path / "i"), [0.0] * 16, 5).count() == 0


def test_recall_on_the_given_vectors(spark):
    from tessera.plans import catalogue

    found, exact = (catalogue.queries()[q](spark, "/root/testdata/sf0.01") for q in ("q04c_knn_index", "q04d_knn_index_exact_batch"))
    both = found.select("query", "vec_id").join(exact.select("query", "vec_id"), ["query", "vec_id"]).count()
    assert both / exact.count() >= 0.9


def test_nothing_to_index(spark, tmp_path):
    for name, rows in (("none", []), ("zero", [None, [0.0, 0.0]]), ("one", [[1.0, 2.0]])):
        df = written(spark, tmp_path / name, rows)
        asked = df.select(F.col("id").alias("query"), F.col("vec").alias("vector"))
        n = 1 if name == "one" else 0
        assert v.nearest(spark, str(tmp_path / name), asked, 3).count() == n
        assert v.nearest_to(spark, str(tmp_path / name), [1.0, 0.0], 3).count() == n


def test_python_holds_one_bounded_block_at_a_time(spark, tmp_path):
    """Not as many blocks, or questions times lists, as an Arrow batch has rows; ties at the last place go by key."""
    import pandas as pd

    batch = pd.DataFrame({"query": np.arange(3000), "vector": list(RNG.normal(size=(3000, 8)))})
    asked = list(v._asking(v._units(RNG.normal(size=(50, 8))), 40)([batch]))
    assert max(map(len, asked)) <= v.SLICE and sum(map(len, asked)) == 3000
    df = written(spark, tmp_path / "t", [[1.0, 0.0]] * 70 + [[0.0, 1.0]] * 30)
    found = v.nearest(spark, str(tmp_path / "t"), df.filter("id in (5, 99)").select(F.col("id").alias("query"), F.col("vec").alias("vector")), 4, probes=None, block=16)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()
    assert sorted((r["query"], r["rank"], r["id"], r["score"]) for r in found.collect()) == [(5, i + 1, i, 1.0) for i in range(4)] + [(99, i + 1, 70 + i, 1.0) for i in range(4)]
