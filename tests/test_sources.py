"""Files survive writing and reading."""

import numpy as np
import pytest

from meshlake.sources import formats, readers, writers
from pyspark.sql import functions as F


def test_nifti_round_trip():
    rng = np.random.default_rng(42)
    for dtype in ("u1", "i2", "i4", "f4", "f8"):
        values = (rng.random((3, 4, 5, 2)) * 100).astype(dtype)
        affine = np.array([[2, 0, 0, -1], [0, 2, 0, 3], [0, 0, 2, 0.5], [0, 0, 0, 1]])
        got, back, _ = formats.read_nifti(formats.write_nifti(values, affine))
        assert (got == values).all() and np.allclose(back, affine)


def test_gifti_round_trip():
    g = formats.read_gifti(formats.write_gifti([np.eye(3), np.array([[0, 1, 2]])], ["NIFTI_INTENT_POINTSET", "NIFTI_INTENT_TRIANGLE"], "CortexLeft", {1: ("one", (1.0, 0.0, 0.0, 1.0))}))
    points, triangles = g.mesh()
    assert (points == np.eye(3)).all() and triangles.tolist() == [[0, 1, 2]]
    assert g.structure() == "CortexLeft" and g.labels[1][0] == "one"


def test_one_voxel_and_one_vertex(spark, tmp_path):
    v = spark.createDataFrame([(1, 1, 1, 0, 10.0)], "i int, j int, k int, feature int, value double")
    writers.write_nifti(v, f"{tmp_path}/v.nii", (3, 4, 5), fill=0.0)
    s = spark.createDataFrame([(1, 0, 10.0)], "vertex int, feature int, value double")
    writers.write_metric(s, f"{tmp_path}/s.func.gii", 30, "CortexLeft", fill=0.0)
    both = readers.read_greyordinates(spark, f"{tmp_path}/v.nii@{tmp_path}/s.func.gii").select("structure", "kind", "vertex", "i", "j", "k", "value").collect()
    assert sorted(map(tuple, both), key=str) == sorted([("OTHER", "voxel", None, 1, 1, 1, 10.0), ("CortexLeft", "vertex", 1, None, None, None, 10.0)], key=str)


def test_failed_write_leaves_nothing(spark, tmp_path):
    v = spark.createDataFrame([(9, 9, 9, 0, 1.0)], "i int, j int, k int, feature int, value double")
    with pytest.raises(IndexError):
        writers.write_nifti(v, f"{tmp_path}/bad.nii", (3, 3, 2))
    assert not list(tmp_path.glob("bad*"))


def test_triples_numbers_and_templates(spark, tmp_path):
    (tmp_path / "m.dot").write_text("1 2 5\n2  1 7\n3 3 0\n")
    assert sorted(map(tuple, readers.read_triples(spark, f"{tmp_path}/m.dot").collect())) == [(0, 1, 5.0), (1, 0, 7.0)]
    (tmp_path / "bvals").write_text("2 2 2 3\n")
    assert [r["value"] for r in readers.read_numbers(spark, f"{tmp_path}/bvals").orderBy("position").collect()] == [2, 2, 2, 3]
    for s in ("a", "b"):
        (tmp_path / f"sub-{s}").mkdir()
        (tmp_path / f"sub-{s}/x_{s}.txt").write_text("1")
    (tmp_path / "sub-a/x_b.txt").write_text("1")
    got = readers.list_template(spark, f"{tmp_path}/sub-{{s}}/x_{{s}}.txt")
    assert sorted(r["s"] for r in got.collect()) == ["a", "b"]


def test_tree_joins_on_shared_variables(spark, tmp_path):
    for s in ("p", "q"):
        (tmp_path / s).mkdir()
        for n, name in enumerate(("thick", "curv")):
            df = spark.createDataFrame([(v, 0, v + n + 1.0) for v in range(3)], "vertex int, feature int, value double")
            writers.write_metric(df, f"{tmp_path}/{s}/{name}.func.gii", 3, "CortexLeft")
    got = readers.read_tree(spark, {n: f"{tmp_path}/{{subject}}/{n}.func.gii" for n in ("thick", "curv")})
    assert got.count() == 6 and got.where("curv = thick + 1").count() == 6
    assert set(got.select("subject").distinct().toPandas()["subject"]) == {"p", "q"}


def test_extension_of_axes():
    assert formats.cifti_extension("scalar", "brain") == ".dscalar.nii" and formats.cifti_extension("x") == ".cifti.nii"


def test_select_vertices(spark):
    assert [r["mask"] for r in writers.select_vertices(spark.range(3).withColumn("vertex", F.col("id")), [1]).orderBy("id").collect()] == [0, 1, 0]
