"""Tracking, curves, shapes, orientations, chunked arrays, files and merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.functions import structures
from meshlake.greyordinates import GreyOrdinates
from meshlake.operators import align, binning, cortex, curves, graph, mesh, orientation, spatial, stats, tracking
from meshlake.sources import formats, merging, readers, writers, zarr
from tests.test_mesh import make

STRIP = [(0.0, 0.0), (0.0, 1.0), (0.5, 0.0), (1.0, 1.0), (1.0, 0.0)]


def strip(spark, split=0.5):
    points = [(x, y, 0.0) for x, y in [*STRIP, (split, 1.0)]]
    return make(spark, points, [(0, 1, 2), (1, 2, 5), (3, 2, 5), (2, 3, 4)])


def test_walk_along_a_strip(spark):
    m = strip(spark)
    ways = spark.createDataFrame([(f, x, y, 0.0) for f, (x, y) in enumerate([(0.0, 1.0), (1.0, 0.0), (1.0, 0.0), (0.0, -1.0)])], "face long, g_x double, g_y double, g_z double")
    flat = tracking.flat_directions(m, ways)
    got = [(r["du"], r["dv"]) for r in flat.orderBy("face").collect()]
    assert np.allclose(got, [(1, 0), (0, 1), (0, -1), (-(0.5**0.5), 0.5**0.5)])
    start = spark.createDataFrame([(0, 0, 0.25, 0.25)], "walker int, face long, u double, v double")
    faces = [0]
    now = start
    for _ in range(4):
        now = tracking.surface_step(m, flat, now)
        faces.append(now.first()["face"])
    assert faces == [0, 1, 2, 3, 3]
    end = tracking.track_to_maximum(m, flat, start).first()
    assert end["face"] == 3
    values = spark.createDataFrame([(v, float(v)) for v in range(6)], "vertex long, value double")
    ridge = {r["vertex"]: r["value"] for r in tracking.ridge_values(m, flat, values).collect()}
    assert ridge[2] is None and ridge[4] is None
    assert [ridge[v] for v in (0, 1, 3, 5)] == pytest.approx([4.0] * 4)


def test_rotation_turns_z_where_the_angles_say(spark):
    df = spark.createDataFrame([(0.3, 0.7, 0.2), (-2.0, 3.0, 1.0), (0.0, 0.0, 0.5)], "p double, t double, s double")
    m = g.euler2mat(*[F.col(c) for c in "pts"])
    for r in df.select("p", "t", *[m[i][2] for i in range(3)]).collect():
        assert list(r[2:]) == pytest.approx([np.cos(r[0]) * np.sin(r[1]), np.sin(r[0]) * np.sin(r[1]), np.cos(r[1])])


def test_curves(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 3.0, 0.0)], "vertex long, x double, y double")
    opened, ring = curves.curve(v), curves.curve(v, "closed")
    assert [r["size"] for r in curves.line_lengths(ring).orderBy("face").collect()] == [5.0, 4.0, 3.0]
    assert not curves.curve_closed(opened).first()[0] and curves.curve_closed(ring).first()[0]
    assert [tuple(r)[1:] for r in curves.line_normals(opened).orderBy("face").collect()] == [(-0.8, 0.6), (1.0, 0.0)]
    assert [(r["face"], r["x"], r["y"]) for r in curves.line_crossings(ring, (0.0, 1.0), (1.0, 0.0)).orderBy("face").collect()] == [(0, 0.75, 1.0), (1, 3.0, 1.0)]
    order = curves.as_lines(ring).orderBy("place").collect()
    assert [r["vertex"] for r in order] == [0, 1, 2] and all(r["closed"] for r in order)
    assert opened.ndim == 2 and opened.nfaces() == 2


def test_section_of_a_box_is_a_ring(spark):
    box = cortex.cuboid(spark, (2, 2, 2))
    ring = curves.plane_section(box, (0.0, 0.0, 0.7)).collect()
    assert {r["line"] for r in ring} == {ring[0]["line"]} and all(r["closed"] for r in ring)
    way = [(r["x"], r["y"]) for r in sorted(ring, key=lambda r: r["place"])]
    assert len(way) == 8 and all(np.hypot(a[0] - b[0], a[1] - b[1]) <= 2 for a, b in zip(way, way[1:] + way[:1], strict=True))


def test_clean_and_mask_surface(spark):
    m = make(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 0, 0), (9, 9, 9)], [(0, 1, 2), (0, 3, 2), (1, 3, 2)])
    tidy = curves.clean(m)
    assert tidy.nvertices() == 3 and sorted(tuple(r)[1:] for r in tidy.faces.collect()) == [(0, 1, 2), (0, 1, 2)]
    hull = curves.mask_surface(spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "i long, j long, k long"))
    assert mesh.volume(hull).first()[0] == pytest.approx(2) and mesh.closed(hull).first()[0] and hull.nfaces() == 20


def test_shapes(spark):
    assert mesh.volume(cortex.cuboid(spark, (2, 3, 5))).first()[0] == pytest.approx(-30)
    assert mesh.volume(cortex.cuboid(spark, (2, 3, 5), inward=False)).first()[0] == pytest.approx(30)
    assert cortex.triangle_mesh(spark).nfaces() == 1
    ball = cortex.sphere(spark, 16, 32)
    assert mesh.closed(ball).first()[0] and mesh.volume(ball).first()[0] == pytest.approx(4 / 3 * np.pi, rel=0.03)
    c = cortex.spherical_cortex(spark)
    assert c.hemisphere == "left" and c.primary == "cortex" and c.nfaces() == 2 * 24 * 11
    assert c.volume().first()[0] == pytest.approx(4 / 3 * np.pi * (1 - 0.8**3), rel=0.1)
    p = spark.createDataFrame([(0, 0.1, 0.2, 0.05), (1, 0.0, 0.03, 0.9), (2, 2.0, 2.0, 2.0)], "point int, x double, y double, z double")
    assert [r["n"] for r in c.segment(p).orderBy("point").collect()] == [2, 1, 0]
    assert c.distance(p, 0.3).orderBy("point").collect()[1]["dist"] < 0.2
    with pytest.raises(ValueError):
        cortex.Cortex((cortex.mesh_to_cortex(ball), cortex.mesh_to_cortex(ball, "right")))
    a = cortex.Anatomy("cortex", "left")
    assert str(a) == "CortexLeft" and a.cifti == "CIFTI_STRUCTURE_CORTEX_LEFT" and a.fits(cortex.Anatomy("all", "left", "white"))


def flat_pair(spark, n=7):
    grid = [(x, y) for x in range(n) for y in range(n)]
    faces = [t for x in range(n - 1) for y in range(n - 1) for t in ((x * n + y, (x + 1) * n + y, x * n + y + 1), ((x + 1) * n + y, (x + 1) * n + y + 1, x * n + y + 1))]
    return (make(spark, [(x, y, z) for x, y in grid], faces) for z in (0.0, 2.0))


@pytest.mark.parametrize("algorithm,options", [("closest", {}), ("interp", {}), ("line", {"norient": 40})])
def test_orientation_between_flat_sheets(spark, algorithm, options):
    white, pial = flat_pair(spark)
    depth = white.vertices.select("vertex", (2 * F.col("x")).alias("f"))
    p = spark.createDataFrame([(0, 3.1, 3.2, 0.9)], "point int, x double, y double, z double")
    r = orientation.gyral_coordinates(p, white, pial, depth, algorithm, max_dist=4.0, outside_pial=True, **options).first()
    assert [abs(r[f"radial_{c}"]) for c in "xyz"] == pytest.approx([0, 0, 1], abs=1e-6)
    assert [abs(r[f"sulcal_{c}"]) for c in "xyz"] == pytest.approx([1, 0, 0], abs=1e-6)
    assert [abs(r[f"gyral_{c}"]) for c in "xyz"] == pytest.approx([0, 1, 0], abs=1e-6)
    if algorithm == "line":
        s = orientation.average_line(p, white, pial, depth, 4.0, 200).first()
        assert 2.0 <= s["thickness"] < 2.1 and s["place"] == pytest.approx(0.45, abs=0.02)


def test_facing_vertices_only(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0), (1, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0)], "vertex long, x double, y double, z double, n_x double, n_y double, n_z double")
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "point int, x double, y double, z double")
    assert [spatial.nearest_vertex(p, v, 3.0, facing=k).first()["vertex"] for k in (0, 1, -1)] == [0, 1, 0]


def test_axes_survive_cifti():
    brain = {"kind": "brain", "elements": [("CIFTI_STRUCTURE_CORTEX_LEFT", v, None, None, None) for v in (0, 2, 4)] + [("CIFTI_STRUCTURE_THALAMUS_LEFT", None, i, 1, 0) for i in range(2)], "nvertices": {"CIFTI_STRUCTURE_CORTEX_LEFT": 5}, "shape": [2, 3, 2], "affine": np.eye(4).tolist()}
    axes = {
        "brain": (brain, 5), "scalar": ({"kind": "scalar", "names": ["a", "b", "c"], "tables": [{}] * 3}, 3), "series": ({"kind": "series", "start": 0.3, "step": 0.1, "unit": "HERTZ", "size": 11}, 11),
        "label": ({"kind": "label", "names": ["l"], "tables": [{0: "none", 3: "three"}]}, 1), "parcels": ({"kind": "parcels", "names": ["s", "t"], "members": [{"CIFTI_STRUCTURE_CORTEX_LEFT": [0, 1]}, {"CIFTI_STRUCTURE_CORTEX_LEFT": [3]}]}, 2),
    }
    rng = np.random.default_rng(42)
    for first, n in axes.values():
        for second, m in axes.values():
            values = rng.standard_normal((n, m))
            got, back = formats.read_cifti(formats.write_cifti(values, {0: first, 1: second}))
            assert (got == values).all() and back[0] == first and back[1] == second


def grey(spark):
    rows = [("CIFTI_STRUCTURE_CORTEX_LEFT", "vertex", v, None, None, None, f, float(10 * f + v + 1)) for v in (1, 3) for f in (0, 1)] + [("CIFTI_STRUCTURE_OTHER", "voxel", None, 1, 0, 2, f, 5.0 + f) for f in (0, 1)]
    return GreyOrdinates.from_long(spark.createDataFrame(rows, "structure string, kind string, vertex int, i int, j int, k int, feature int, value double"))


def entries(x):
    return sorted(tuple(r) for r in x.long().fillna(-1).select("structure", "vertex", "i", "feature", "value").collect())


def test_greyordinates_survive_files(spark, tmp_path):
    x = grey(spark)
    for name in ("a.zarr", "a.dscalar.nii", "a.parquet"):
        x.to_filename(f"{tmp_path}/{name}")
        assert entries(GreyOrdinates.from_filename(spark, f"{tmp_path}/{name}")) == entries(x)
    assert x.volume().count() == 2 and x.surface("CIFTI_STRUCTURE_CORTEX_LEFT").count() == 4
    with pytest.raises(ValueError):
        x.surface("CIFTI_STRUCTURE_CORTEX_RIGHT")
    assert [e[-1] for e in entries(x + x)] == [2 * e[-1] for e in entries(x)]
    both = GreyOrdinates.from_filename(spark, f"{tmp_path}/a.zarr@{tmp_path}/a.dscalar.nii")
    assert both.elements.count() == 6 and both.values.count() == 12
    square = GreyOrdinates(spark.createDataFrame([(0, 1, 7.0)], "row long, grey_id long, value double"), x.elements)
    assert tuple(square.transpose().values.select("row", "grey_id", "value").first()) == (1, 0, 7.0)


def test_chunks_are_filled_in_turn(spark, tmp_path):
    path, names = f"{tmp_path}/m.zarr", {"kind": "scalar", "names": list("abcdefg"), "tables": [{}] * 7}
    zarr.create(spark, path, [names, names], (7, 7), (3, 3))
    assert zarr.read(spark, path).count() == 0
    first = spark.createDataFrame([(0, 0, 1.0), (6, 6, 2.0)], "row long, col long, value double")
    zarr.append(first, path)
    zarr.append(spark.createDataFrame([(0, 0, 3.0), (0, 2, 4.0)], "row long, col long, value double"), path)
    assert sorted(map(tuple, zarr.read(spark, path).collect())) == [(0, 0, 3.0), (0, 2, 4.0), (6, 6, 2.0)]
    meta, axes = zarr.describe(spark, path)
    assert meta["shape"] == [7, 7] and axes[0] == names


def test_surfaces_and_labels(spark, tmp_path):
    points, tri = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0.0]]), np.array([[0, 1, 2]])
    back = formats.read_freesurfer(formats.write_freesurfer(points, tri))
    assert (back[0] == points).all() and (back[1] == tri).all()
    for side, name in (("L", "CortexLeft"), ("R", "CortexRight")):
        for kind in ("white", "pial"):
            m = make(spark, points, tri.tolist())
            writers.write_mesh(m.vertices, m.faces, f"{tmp_path}/100.{side}.{kind}.32k.surf.gii", name)
    found = readers.read_hcp(spark, str(tmp_path))
    assert [n for n, *_ in found["L"]] == ["white", "pial"] and found["R"][0][2].count() == 1
    pair = readers.read_surfaces(spark, f"{tmp_path}/100.L.white.32k.surf.gii@{tmp_path}/100.R.white.32k.surf.gii")
    assert set(pair) == {"CortexLeft", "CortexRight"}
    with pytest.raises(ValueError):
        readers.read_surfaces(spark, f"{tmp_path}/100.L.white.32k.surf.gii@{tmp_path}/100.L.pial.32k.surf.gii")
    (tmp_path / "x.label.gii").write_bytes(formats.write_gifti([np.array([0, 2, 2])], ["NIFTI_INTENT_LABEL"], "CortexLeft", {2: ("two", (1.0, 0.0, 0.0, 1.0))}))
    rows, table = readers.read_labels(spark, f"{tmp_path}/x.label.gii")
    assert [r["label"] for r in rows.orderBy("vertex").collect()] == [0, 2, 2] and table.first()["name"] == "two"
    named = align.label_names(rows, table.withColumnRenamed("key", "label")).orderBy("vertex").collect()
    assert [r["name"] for r in named] == [None, "two", "two"]


def test_parts_of_jobs_are_merged(spark, tmp_path):
    for job, at in (("1", 0), ("2", 1)):
        (tmp_path / f"job{job}").mkdir()
        values = np.zeros((2, 2, 2))
        values[at, at, 0] = at + 1
        (tmp_path / f"job{job}" / "a.nii").write_bytes(formats.write_nifti(values))
        (tmp_path / f"job{job}" / "same.txt").write_text("equal")
    (tmp_path / "job1" / "only.txt").write_text("x")
    (tmp_path / "job").mkdir()
    assert merging.merge_jobs(spark, [f"{tmp_path}/jobJOBID"], ["1", "2"], fill=0.0) == ["only.txt"]
    got, _, _ = formats.read_nifti((tmp_path / "job" / "a.nii").read_bytes())
    assert got[0, 0, 0] == 1 and got[1, 1, 0] == 2 and got.sum() == 3 and (tmp_path / "job" / "same.txt").read_text() == "equal"


def test_zeros_stay_out_of_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 6 + [(float(v), 1.0) for v in (1, 2, 3, 4)], "v double, w double")
    assert binning.number_edges(df, "v", 2)[:2] == [1.0, 3.0] and binning.weight_edges(df, "v", "w", 2)[1] == 3.0
    assert binning.number_edges(df, "v", 2, include_zeros=True)[0] == 0.0
    assert {r["bin"] for r in binning.discretise(df, "v", binning.number_edges(df, "v", 2)).where("v = 0").collect()} == {0}
    assert [r["label"] for r in binning.bin_labels(spark, [0.0, 1.5, 2.0]).collect()] == ["0.00 to 1.50", "1.50 to 2.00"]


def test_groups_of_rank_correlations(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, (2, 40)).astype(float)
    df = lambda v: spark.createDataFrame([("s", i, float(t)) for i, t in enumerate(v)], "subject string, feature long, value double")
    names = spark.createDataFrame([(i, "CORTEX_LEFT" if i < 25 else "THALAMUS_RIGHT") for i in range(40)], "feature long, structure string")

    def rank(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, t) + np.searchsorted(order, t, "right") + 1) / 2 for t in v])

    got = {r["group"]: r["rho"] for r in stats.grouped_spearman(df(x), df(y), ["subject"], names).collect()}
    want = lambda s: np.corrcoef(rank(x[s]), rank(y[s]))[0, 1]
    assert got["full"] == pytest.approx(want(slice(None))) and got["cortex"] == pytest.approx(want(slice(0, 25))) and got["right"] == pytest.approx(want(slice(25, 40)))
    assert set(got) == {"full", "CORTEX_LEFT", "cortex", "sub_cortical", "left", "right"}


def test_medoids_cost_and_parcels(spark):
    x = np.array([0.0, 0.1, 0.2, 5.0, 5.1, 5.2])
    f = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "vertex long, features array<double>")
    d = stats.close_pairs(f)
    labels = graph.kmedoids(d, 2, [0, 5])
    assert [r["center"] for r in labels.orderBy("vertex").collect()] == [1, 1, 1, 4, 4, 4]
    assert graph.cluster_cost(d, labels).first()[0] == pytest.approx(0.4)
    assert graph.kmedoids(d, 2, "random").count() == 6
    with pytest.raises(ValueError):
        stats.close_pairs(f, max_rows=5)


def test_watershed_to_a_number_of_parcels(spark):
    depth = [0.0, 1.0, 3.0, 1.0, 0.5, 2.0, 0.4]
    v = spark.createDataFrame([(i, d, 1.0) for i, d in enumerate(depth)], "vertex long, depth double, size double")
    e = spark.createDataFrame([(a, b) for i in range(6) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long")
    out = graph.watershed_parcels(v, e, 2, fill_ridge=True)
    assert out.where("parcel > 0").select("parcel").distinct().count() == 2


def test_numbers_ascii_masks_and_connectomes(spark, tmp_path):
    writers.write_numbers(spark.createDataFrame([(1, 2.5), (0, 1.0)], "n int, v double"), f"{tmp_path}/out.txt", "v", "n")
    assert (tmp_path / "out.txt").read_text() == "1.0 2.5\n"
    (tmp_path / "hemi.L.asc").write_text("0,0,0,0\n1,0,0,1\n2,0,0,1\n")
    mask = readers.read_ascii_mask(spark, f"{tmp_path}/hemi.L.asc")
    assert sorted((r["hemisphere"], r["vertex"]) for r in mask.collect()) == [("left", 1), ("left", 2)]
    model = readers.brain_model(grey(spark).long())
    assert [r["grey_id"] for r in model.orderBy("kind", "vertex").collect()] == [0, 1, 2]
    (tmp_path / "m.dot").write_text("1 2 5\n2 3 7\n3 3 0\n")
    dense = readers.dense_connectome(readers.read_triples(spark, f"{tmp_path}/m.dot"), model).orderBy("src").collect()
    assert [(r["src"], r["dst"], r["value"]) for r in dense] == [(0, 1, 5.0), (1, 2, 7.0)] and dense[1]["col_element"]["kind"] == "voxel"


def test_structures_match_and_voxels_have_keys(spark):
    row = spark.range(1).select(structures.matches(F.lit("all"), F.lit("left"), F.lit("cortex"), F.lit("left")).alias("a"), structures.matches(F.lit("cortex"), F.lit("left"), F.lit("cortex"), F.lit("right")).alias("b"), structures.voxel_key(F.lit(1), F.lit(2), F.lit(3), 10, 20).alias("k")).first()
    assert tuple(row) == (True, False, 1 + 10 * (2 + 20 * 3))


def test_smoothing_of_parts(spark):
    m = strip(spark)
    rows = spark.createDataFrame([("CORTEX_LEFT", v, 0, float(v)) for v in range(6)] + [("THALAMUS", v, 0, 1.0) for v in range(2)], "structure string, vertex long, feature int, value double")
    out = graph.smooth_structures(rows, {"CORTEX_LEFT": m}, 0.4)
    one = graph.smooth_values(mesh.edges(m, weight="distance"), rows.where("structure = 'CORTEX_LEFT'").select("vertex", "value"), 0.4)
    assert {r["vertex"]: r["value"] for r in out.where("structure = 'CORTEX_LEFT'").collect()} == pytest.approx({r["vertex"]: r["value"] for r in one.collect()})
    assert out.where("structure = 'THALAMUS'").count() == 2
    with pytest.raises(ValueError):
        graph.smooth_structures(rows, {"CORTEX_RIGHT": m}, 0.4)


def test_searchlight_border(spark):
    n = 12
    v = spark.createDataFrame([(i, [0.0 if i < 6 else 4.0, 0.1 * (i % 2)]) for i in range(n)], "vertex long, features array<double>")
    e = spark.createDataFrame([(a, b, 1.0) for i in range(n - 1) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, w double")
    parcels = spark.createDataFrame([(i, run, i // (12 - 4 * run)) for i in range(n) for run in (0, 1)], "vertex long, run int, parcel int")
    border = {r["vertex"]: r["border"] for r in stats.searchlight(e, v, parcels).collect()}
    assert border[5] == border[6] == max(border.values()) and border[5] == 1.0 and border[0] == 0.0


def test_radial_transition(spark):
    d = np.linspace(-1.9, 4, 40)
    rows = [(v, float(x), float(1 / (1 + np.exp(-(x - 0.8 - 0.1 * v) / 0.6)))) for v in range(3) for x in d if x != 0] + [(0, -5.0, 1.0), (1, 1.0, None)]
    points = spark.createDataFrame(rows, "vertex long, dist double, radial_index double")
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    got = {r["vertex"]: r for r in stats.radial_transition(points, edges, smooth_weight=1e-4).collect()}
    assert [got[v]["offset"] for v in range(3)] == pytest.approx([0.8, 0.9, 1.0], abs=0.02) and got[1]["width"] == pytest.approx(0.6, abs=0.02)
    assert got[3]["offset"] == pytest.approx(1.0, abs=0.05)


def test_convert(spark, tmp_path):
    from meshlake.greyordinates import convert

    grey(spark).to_filename(f"{tmp_path}/a.zarr")
    convert(spark, f"{tmp_path}/a.zarr", f"{tmp_path}/b.dscalar.nii")
    assert entries(GreyOrdinates.from_filename(spark, f"{tmp_path}/b.dscalar.nii")) == entries(grey(spark))


def test_paths_across_blocks(spark, monkeypatch):
    """A strip of many steps takes few rounds, and blocks of any size give the same paths and ties."""
    from meshlake.operators import graph

    n = 120
    rows = [(i, j, float(w)) for i in range(n) for j, w in ((i + 1, 1.0), (i + 2, 2.0)) if j < n]
    edges = spark.createDataFrame(rows + [(j, i, w) for i, j, w in rows], "src long, dst long, w double")
    sources = spark.createDataFrame([(0,), (n - 1,), (40,)], "vertex long")
    whole = sorted(graph.shortest_paths(edges, sources, max_rounds=2).collect())
    assert [r["root"] for r in whole] == [0] * 21 + [40] * 39 + [40 if i < 80 else n - 1 for i in range(60, n)]
    assert all(r["dist"] == abs(r["vertex"] - r["root"]) for r in whole) and whole[42]["pred"] == 40 and whole[40]["pred"] is None
    monkeypatch.setattr(graph, "BLOCK_EDGES", 100)
    assert sorted(graph.shortest_paths(edges, sources, max_rounds=12).collect()) == whole


def test_stack_meets_in_one_exchange(spark):
    from meshlake.operators import align

    rows = [[(1, 0.5), (1, 0.75), (2, None), (None, 1.0)], [(1, 2.0), (2, 3.0), (3, 4.0)], [(2, 5.0), (1, 6.0), (None, 7.0)]]
    got = align.stack([spark.createDataFrame(r, "vertex long, value double") for r in rows], ["vertex"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 0.5, "stacked_1"), (1, 0.75, "stacked_1"), (2, None, "stacked_1"), (1, 2.0, "stacked_2"), (2, 3.0, "stacked_2"), (2, 5.0, "stacked_3"), (1, 6.0, "stacked_3")]))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_paired_before_groups(spark, monkeypatch):
    """The pairs of values that are written down carry their groups; each pair is joined once, not once a group."""
    from meshlake.operators import stats

    seen = []
    monkeypatch.setattr(stats, "settle", lambda df: seen.append(df.columns) or df)
    a = spark.createDataFrame([("s", f, float(f * f % 7)) for f in range(12)], "subject string, feature long, value double")
    names = spark.createDataFrame([(f, "CORTEX_LEFT" if f % 2 else "BRAIN_STEM") for f in range(12)], "feature long, structure string")
    got = {r["group"]: r["rho"] for r in stats.grouped_spearman(a, a, ["subject"], names).collect()}
    assert seen == [["subject", "group", "x", "y"]] and all(abs(v - 1) < 1e-12 for v in got.values()) and len(got) == 5
