"""Spatial joins against plain loops, and without large broadcasts."""

import numpy as np
import pytest

import __spark_entry__ as entry_points
from meshlake.operators import spatial

D = "/root/testdata/sf0.1"


@pytest.fixture
def small_broadcasts(spark):
    """A limit that tables of the mesh keep, and the points repeated for each cell around them do not."""
    name = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(name, "256k")
    yield
    spark.conf.unset(name)


def places(rng, n, span=3.0):
    return np.round(rng.uniform(-span, span, (n, 3)) * 4) / 4


def table(spark, name, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"{name} long, x double, y double, z double")


@pytest.mark.parametrize("name", ["nearest_vertex", "nearest_any", "nearest_segment"])
def test_nothing_large_is_broadcast(spark, small_broadcasts, name):
    assert entry_points.queries()[name](spark, D).count() == 20000


@pytest.mark.parametrize("size", [None, 2.5])
def test_nearest_in_chunks(spark, monkeypatch, size):
    monkeypatch.setattr(spatial, "POINTS", 5)
    monkeypatch.setattr(spatial, "ROWS", 4)
    rng = np.random.default_rng(3)
    p, v = places(rng, 60), places(rng, 50)
    d2 = ((p[:, None] - v[None]) ** 2).sum(2)
    want = [(i, int(r.argmin()) if r.min() < 1.44 else None) for i, r in enumerate(d2)]
    got = spatial.nearest_vertex(table(spark, "point", p), table(spark, "vertex", v), 1.2, size)
    assert sorted((r["point"], r["vertex"]) for r in got.collect()) == want
    up = v + [0.0, 0.5, 2.0]
    t = np.clip(((up - v) * (p[:, None] - v)).sum(2) / ((up - v) ** 2).sum(1), 0, 1)
    d = np.linalg.norm(p[:, None] - (v + (up - v) * t[..., None]), axis=2)
    got = spatial.nearest_segment(table(spark, "point", p), table(spark, "vertex", v), table(spark, "vertex", up), 1.1)
    near = {r["point"]: r["dist"] for r in got.collect()}
    assert len(near) == 60
    assert all(near[i] == pytest.approx(r.min()) if r.min() <= 1.1 else near[i] is None for i, r in enumerate(d))
