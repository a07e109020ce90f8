"""Literal fixtures of meshes, gradients and layers."""

import math

import numpy as np
import pytest

from meshlake.functions import geometry as g
from meshlake.operators import align, binning, graph, mesh, spatial, stats
from pyspark.sql import functions as F

CUBE_FACES = [(0, 2, 1), (0, 1, 4), (0, 4, 2), (4, 5, 6), (2, 6, 3), (1, 3, 5), (3, 1, 2), (5, 4, 1), (6, 2, 4), (7, 6, 5), (7, 3, 6), (7, 5, 3)]


def make(spark, vertices, faces, flip=False):
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(vertices)], "vertex long, x double, y double, z double")
    f = spark.createDataFrame([(i, *t) for i, t in enumerate(faces)], "face long, a long, b long, c long")
    return mesh.Mesh(v, f, flip)


def cuboid(spark, size=(1, 1, 1), shift=0.0, flip=False):
    return make(spark, [(x * size[0] + shift, y * size[1] + shift, z * size[2] + shift) for x in (0, 1) for y in (0, 1) for z in (0, 1)], CUBE_FACES, flip)


@pytest.fixture(scope="module")
def triangle(spark):
    return make(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])


def column(df, key, value):
    return [r[value] for r in df.orderBy(key).collect()]


def test_triangle(triangle):
    assert triangle.nvertices() == 3 and triangle.nfaces() == 1
    assert column(mesh.face_sizes(triangle), "face", "size") == pytest.approx([0.5])
    assert column(mesh.vertex_sizes(triangle), "vertex", "size") == pytest.approx([1 / 6] * 3)


@pytest.mark.parametrize("method,want", [("min", [1, 1, 1]), ("max", [2, 1, 2]), ("mean", [1.5, 1, 1.5]), ("median", [1.5, 1, 1.5])])
def test_gradient_of_scalars(spark, triangle, method, want):
    f = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "vertex long, features array<double>")
    assert column(graph.gradient(triangle.vertices, mesh.edges(triangle), f, "euclidean", method), "vertex", "value") == pytest.approx(want)


def test_histogram_intersection(spark, triangle):
    eye = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "vertex long, features array<double>")
    assert column(graph.gradient(triangle.vertices, mesh.edges(triangle), eye, "histogram_intersection"), "vertex", "value") == pytest.approx([0, 0, 0])
    same = spark.createDataFrame([(i, [5.0] * 5) for i in range(3)], "vertex long, features array<double>")
    assert column(graph.gradient(triangle.vertices, mesh.edges(triangle), same, "histogram_intersection"), "vertex", "value") == pytest.approx([1, 1, 1])


def test_isolated_vertex_has_no_value(spark):
    m = make(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 5, 5)], [(0, 1, 2)])
    f = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "vertex long, features array<double>")
    assert column(graph.gradient(m.vertices, mesh.edges(m), f), "vertex", "value")[3] is None


def test_cuboid_volume_and_inflation(spark):
    m = cuboid(spark, (2, 3, 5))
    size = lambda x: mesh.volume(x).first()[0]
    assert size(m) == pytest.approx(-30)
    assert size(cuboid(spark, (2, 3, 5), flip=True)) == pytest.approx(30)
    assert abs(size(mesh.inflate(m, volume_change=10))) == pytest.approx(40, rel=1e-3)
    assert mesh.closed(m).first()[0]
    n = mesh.face_normals(m).collect()
    assert all(sorted(abs(x) for x in r[1:]) == pytest.approx([0, 0, 1]) for r in n)


def test_affine_and_layer(spark):
    m = mesh.apply_affine(cuboid(spark), np.diag([2, 2, 2, 2]))
    assert m.vertices.agg(F.max("x")).first()[0] == pytest.approx(0.5)
    low = make(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 1, 2), (1, 2, 3)])
    up = make(spark, [(0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1)], [(0, 1, 2), (1, 2, 3)])
    assert column(mesh.layer_wedges(low, up), "face", "volume") == pytest.approx([0.5, 0.5])


def test_flat_gradient(spark):
    rng = np.random.default_rng(42)
    v = rng.standard_normal((5, 3))
    m = make(spark, v, [(0, 1, 2), (0, 3, 4)])
    slope = rng.standard_normal(3)
    f = spark.createDataFrame([(i, float(p @ slope)) for i, p in enumerate(v)], "vertex long, f double")
    for r in mesh.face_gradient(m, f).collect():
        a, b, c = (v[i] for i in [(0, 1, 2), (0, 3, 4)][r["face"]])
        n = np.cross(b - a, c - a)
        n /= np.linalg.norm(n)
        assert [r["g_x"], r["g_y"], r["g_z"]] == pytest.approx(slope - n * (slope @ n))


def test_spherical(spark):
    rows = [(0.0, 0.0, 1.0, 1.0, 0.0, 0.0), (0.0, 0.0, -1.0, 1.0, 0.0, math.pi), (1.0, 0.0, 0.0, 1.0, 0.0, math.pi / 2), (0.0, 2.0, 0.0, 2.0, math.pi / 2, math.pi / 2), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double, r double, p double, t double")
    for r in df.select(*g.cart2spherical(F.col("x"), F.col("y"), F.col("z")), "r", "p", "t").collect():
        assert list(r[:3]) == pytest.approx(list(r[3:]))


def test_nearest_and_inside(spark):
    m = cuboid(spark, (4, 4, 4), 0.5)
    p = spark.createDataFrame([(i, x, y, z) for i, (x, y, z) in enumerate([(1.0, 1.0, 1.0), (4.0, 1.0, 4.0), (2.6, 2.6, 2.6), (9.0, 9.0, 9.0)])], "point int, x double, y double, z double")
    assert column(spatial.nearest_vertex(p, m.vertices, 2.1), "point", "vertex") == [0, 5, None, None]
    assert column(spatial.inside(p, m), "point", "inside") == [True, True, True, False]
    assert column(spatial.signed_distance(p, m, 3.0), "point", "dist")[:3] == pytest.approx([-0.5, -0.5, -1.9])


def test_rays_hit_the_cuboid(spark):
    m = cuboid(spark, (10, 10, 10))
    rays = spark.createDataFrame([(i, 5.0, 5.1, 5.3, *d) for i, d in enumerate([(1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.6, 0.0, 0.8)])], "ray int, o_x double, o_y double, o_z double, d_x double, d_y double, d_z double")
    hits = spatial.ray_hits(rays, m, 20.0).orderBy("ray").collect()
    assert [round(r["t"], 6) for r in hits] == [5.0, 5.1, round(4.7 / 0.8, 6)]


def test_voxels_cover_the_shell(spark):
    hit = {(r["i"], r["j"], r["k"]) for r in spatial.voxel_triangles(cuboid(spark, (4, 4, 4), 1.0)).collect()}
    want = {(i, j, k) for i in range(1, 6) for j in range(1, 6) for k in range(1, 6) if {i, j, k} & {1, 5}}
    assert hit == want


def test_shells_slices_and_merge(spark):
    df = spark.createDataFrame([(0.0,), (80.0,), (160.0,)], "b double")
    assert {r["rounded"] for r in binning.shells(df, "b", 100).collect()} == {80.0}
    assert binning.shells(df.where("b <> 80"), "b", 100).select("shell").distinct().count() == 2
    sizes = binning.even_slices(spark.range(15000).withColumnRenamed("id", "o"), "o", 7).groupBy("slice").count().orderBy("slice")
    assert [r["count"] for r in sizes.collect()] == [2143, 2143, 2143, 2142, 2143, 2143, 2143]
    parts = [spark.createDataFrame(list(enumerate(v)), "vertex int, value double") for v in ([1.0, -1.0, -1.0], [-1.0, 2.0, -1.0])]
    assert column(align.merge_parts(parts, ["vertex"], -1.0), "vertex", "value") == [1.0, 2.0, -1.0]


def test_paths_and_components(spark):
    e = spark.createDataFrame([(s, d, w) for a, b, w in [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)] for s, d in ((a, b), (b, a))], "src long, dst long, w double")
    v = spark.range(6).withColumnRenamed("id", "vertex")
    near = graph.roi_distance(v, e, spark.createDataFrame([(0,)], "vertex long")).orderBy("vertex").collect()
    assert [(r["dist"], r["pred"]) for r in near] == [(0.0, None), (1.0, 0), (2.0, 1), (None, None), (None, None), (None, None)]
    assert column(graph.components(v, e), "vertex", "component") == [0, 0, 0, 3, 3, 5]


def test_flood():
    near = [np.array(x) for x in ([1], [0, 2], [1, 3], [2, 4], [3])]
    assert graph.flood(np.array([0.0, 1, 3, 1, 0]), near, np.ones(5)).tolist() == [1, 1, -1, 2, 2]
    assert graph.flood(np.array([0.0, 1, 3, 1, 0]), near, np.ones(5), min_depth=5).tolist() == [1] * 5


def test_affinity_and_correlation(spark):
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 5.2])
    s = -((x[:, None] - x) ** 2)
    np.fill_diagonal(s, -1.0)
    got = stats.affinity(s)
    assert len(set(got[:3])) == 1 and len(set(got[3:])) == 1 and got[0] != got[3]
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 10))
    df = lambda v: spark.createDataFrame([(i, 0, float(t)) for i, t in enumerate(v)], "row int, col int, value double")
    assert stats.correlate_columns(df(a), df(b)).first()["r"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_sigmoid_fit(spark):
    d = np.linspace(-3, 5, 50)
    df = spark.createDataFrame([(float(x), float(1 / (1 + np.exp(-(x - 1.2) / 0.7)))) for x in d], "dist double, value double")
    assert stats.fit_sigmoid(df) == pytest.approx((1.2, 0.7), abs=0.02)


def test_euler_angles_of_small_turns(spark):
    """A turn by less than a millionth about an axis keeps its direction."""
    rows = [(0.7, 3e-7, 0.4), (-0.9, -4e-8, 0.2), (0.3, math.pi - 2e-7, 1.1), (0.5, 0.0, 0.25), (1.2, 1e-5, -0.3)]
    cells = [(i, j) for i in range(3) for j in range(3)]
    entries = lambda m: [m[i][j].alias(f"m{i}{j}") for i, j in cells]
    known = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    df = spark.createDataFrame(rows, "x double, y double, z double").select(*entries(g.euler2mat(*[F.col(c) for c in "xyz"])))
    df = df.select("*", *[a.alias(n) for a, n in zip(g.mat2euler(known), ("phi", "theta", "psi"), strict=True)])
    back = g.euler2mat(*[F.col(c) for c in ("phi", "theta", "psi")])
    got = df.select("phi", "theta", "psi", F.greatest(*[F.abs(F.col(f"m{i}{j}") - back[i][j]) for i, j in cells]).alias("worst")).collect()
    assert all(r["worst"] < 1e-12 for r in got)
    assert got[0]["phi"] == pytest.approx(0.7) and got[0]["theta"] == pytest.approx(3e-7, rel=1e-6) and got[0]["psi"] == pytest.approx(0.4)
