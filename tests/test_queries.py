"""Queries with SQL twins against DuckDB on the smallest tables; a sample of each kind."""

import duckdb
import pytest

import __spark_entry__ as entry_points

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "gradient_euclidean_median", "gradient_jensenshannon_mean", "gradient_histogram_intersection_max", "mesh_edges", "mesh_vertex_normals",
    "mesh_vertex_gradient", "mesh_submesh_faces", "layer_vertex_wedges", "gyral_bias", "align_combine", "align_stack", "natural_join_outer",
    "parcel_product", "shells", "discretise_number", "discretise_weight", "discretise_regular", "even_slices", "spearman", "pearson",
    "structure_groups", "nearest_vertex", "nearest_segment", "euler_round_trip", "gyral_frame", "structure_names", "ray_hits",
    "euler_matrix", "clean_euler", "surface_step", "plane_section", "mesh_clean", "gradient_partial", "gradient_correlation_mean", "voxel_hits", "voxel_edge_crossings",
    "signed_distance", "enclosing_surfaces", "dbscan", "principal_axis", "point_orientation", "connectome_slice", "discretise_zeros", "anti_join", "spearman_groups",
    "coalesce_frames", "smooth_values", "mesh_smooth_adaptive",
]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: None if isinstance(v, float) and v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr([fix(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    got = entry_points.queries()[name](spark, D)
    want = db.sql(entry_points.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
