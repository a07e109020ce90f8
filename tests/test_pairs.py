"""Clusterings over blocks of rows against those over a full table of distances, and on more rows than such a table takes."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
from meshlake.operators import graph, pairs, stats


@pytest.fixture(scope="module")
def cloud(spark):
    """Rows around three places, with copies of some."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (70, 3)) / 4 + 5 * rng.integers(0, 3, (70, 1))
    x = np.vstack([x, x[:9], x[:4]])
    return spark.createDataFrame([(int(v), r.tolist()) for v, r in enumerate(x)], "vertex long, features array<double>").repartition(3)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "TILE", 60)


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """20,001 rows, one more than a full table of distances takes."""
    where = tmp_path_factory.mktemp("many")
    duckdb.sql(f"copy (select i as vec_id, [sin(i) * 9 + i % 7 * 100, cos(i * 3) * 9]::float[] as embedding, (i % 10)::int as label from range(20001) t(i)) to '{where}/embeddings.parquet'")
    return str(where)


@pytest.mark.parametrize("init", ["center", "random", [3, 40]])
def test_medoids(spark, cloud, small_blocks, init):
    want = graph.kmedoids(stats.close_pairs(cloud), 3, init)
    got = pairs.medoids(cloud, 3, init)
    assert sorted(got.select("vertex", "center").collect()) == sorted(want.select("vertex", "center").collect())


def test_medoids_of_many_rows(spark, many):
    got = entry_points.queries()["kmedoids"](spark, many).toPandas()
    assert len(got) == 20001 and got["center"].nunique() == 4


@pytest.mark.parametrize("eps", [0.5, 0.75, 1.25])
def test_density_clusters(spark, cloud, small_blocks, eps):
    want = stats.dbscan(stats.close_pairs(cloud).where(f"d <= {eps}"), cloud.select("vertex"), 4)
    got = pairs.density_clusters(cloud, eps, 4)
    assert sorted(got.select("vertex", "cluster").collect()) == sorted(want.select("vertex", "cluster").collect())


def test_density_clusters_of_many_rows(spark, many):
    assert entry_points.queries()["dbscan"](spark, many).count() == 20001


@pytest.mark.parametrize("held", [10**9, 0])
def test_affinity_of_rows(spark, cloud, monkeypatch, held):
    """In memory, and with matrices on disk, as over the table of all pairs."""
    monkeypatch.setattr(stats, "HELD", held)
    close = stats.close_pairs(cloud).selectExpr("cast(0 as long) as `group`", "src", "dst", "-d as weight")
    x = np.array([r["features"] for r in cloud.orderBy("vertex").collect()])
    want = [r["exemplar"] for r in stats.affinity_groups(close).orderBy("vertex").collect()]
    assert stats.affinity_of_rows(x).tolist() == want and len(set(want)) > 1


def test_affinity_makes_no_table_of_pairs(spark, many):
    plan = entry_points.queries()["affinity_clusters"](spark, many)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" in plan
