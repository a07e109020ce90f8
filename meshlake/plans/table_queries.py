"""Queries of alignment, binning, statistics and scalar functions, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.functions import structures
from meshlake.operators import align, binning, cortex, graph, mesh, orientation, pairs, spatial, stats
from meshlake.plans.catalog import register
from meshlake.plans.mesh_queries import SQL_MESH, SQL_VOXELS, features, lattice, points, rounded


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# alignment
def _spaces(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("vertex"), F.col("o_custkey").alias("i"), F.col("o_totalprice").alias("value"))
    return o.where("vertex % 3 <> 0"), o.where("vertex % 2 = 0"), o.where("vertex % 5 <> 1")


_SP = "WITH a AS (SELECT o_orderkey AS vertex, o_custkey AS i, o_totalprice AS value FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey AS vertex, o_custkey AS i, o_totalprice AS value FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_orderkey AS vertex, o_custkey AS i, o_totalprice AS value FROM orders WHERE o_orderkey % 5 <> 1) "
register("align_overlap", lambda s, d: align.overlap(*_spaces(s, d)[:2], ["vertex"], "i"), _SP + "SELECT a.vertex, a.i AS index_1, b.i AS index_2 FROM a JOIN b USING (vertex)")
register("align_combine", lambda s, d: align.combine(_spaces(s, d), ["vertex"], "i"), _SP + "SELECT a.vertex, a.i AS index_1, b.i AS index_2, c.i AS index_3 FROM a JOIN b USING (vertex) JOIN c USING (vertex)")
register("align_add", lambda s, d: rounded(align.add(*_spaces(s, d)[:2], ["vertex"]), "value", places=2), _SP + "SELECT a.vertex, round(a.value + b.value, 2) AS value FROM a JOIN b USING (vertex)")
register("align_stack", lambda s, d: align.stack([x.select("vertex", "value") for x in _spaces(s, d)], ["vertex"]), _SP + ", k AS (SELECT vertex FROM a JOIN b USING (vertex) JOIN c USING (vertex)) SELECT vertex, value, 'stacked_1' AS layer FROM a JOIN k USING (vertex) UNION ALL SELECT vertex, value, 'stacked_2' FROM b JOIN k USING (vertex) UNION ALL SELECT vertex, value, 'stacked_3' FROM c JOIN k USING (vertex)")
register("align_concatenate", lambda s, d: align.concatenate([x.select("vertex", "value") for x in _spaces(s, d)[:2]], ["vertex"]), _SP + "SELECT vertex, value FROM a UNION ALL SELECT vertex, value FROM b")
register("align_concatenate_rows", lambda s, d: align.concatenate([x.select("vertex", F.lit(0).cast("long").alias("feature"), "value") for x in _spaces(s, d)[:2]], ["vertex"], axis=0), _SP + "SELECT a.vertex, CAST(0 AS BIGINT) AS feature, a.value FROM a JOIN b USING (vertex) UNION ALL SELECT b.vertex, CAST(1 AS BIGINT), b.value FROM a JOIN b USING (vertex)")
register(
    "natural_join",
    lambda s, d: align.natural_join([table(s, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), "n_name"), table(s, d, "region").select(F.col("r_regionkey").alias("region"), "r_name"), table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")]),
    "SELECT n_nationkey AS nation, n_regionkey AS region, n_name, r_name, c_custkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey",
)
register("natural_join_outer", lambda s, d: align.natural_join([table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal"), table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")], how="outer"), "SELECT coalesce(c_custkey, o_custkey) AS k, c_acctbal, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey")
register("anti_join", lambda s, d: align.missing(table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), ["k"]), "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
register("merge_parts", lambda s, d: align.merge_parts([table(s, d, "orders").select(F.col("o_orderkey").alias("vertex"), F.when(F.col("o_orderkey") % 3 == n, F.col("o_totalprice")).otherwise(0.0).alias("value")) for n in range(2)], ["vertex"], 0.0), "SELECT o_orderkey AS vertex, CASE WHEN o_orderkey % 3 IN (0, 1) THEN o_totalprice ELSE 0.0 END AS value FROM orders")


def _parcels(spark, d):
    p = points(spark, d)
    a = p.select("vertex", F.col("label").cast("long").alias("label"))
    b = p.select("vertex", (F.col("vertex") % 7).alias("label"))
    names = lambda df, prefix: df.select("label").distinct().select("label", F.concat(F.lit(prefix), F.col("label")).alias("name"), (F.col("label") / 10).alias("r"), F.lit(0.5).alias("g"), F.lit(0.25).alias("b"), F.lit(1.0).alias("alpha"))
    return align.combine_parcels(a, b, names(a, "a"), names(b, "b"))


_PC = "WITH p AS (SELECT vec_id AS vertex, CAST(label AS BIGINT) la, vec_id % 7 lb FROM embeddings), q AS (SELECT DISTINCT la, lb FROM p), r AS (SELECT la, lb, dense_rank() OVER (ORDER BY la, lb) AS parcel FROM q) "
register("parcel_product", lambda s, d: _parcels(s, d)[0], _PC + "SELECT vertex, CAST(parcel AS INTEGER) AS parcel, CAST(la * 10 + lb - (SELECT min(lb) FROM p) AS BIGINT) AS legacy FROM p JOIN r USING (la, lb)")
register("parcel_product_labels", lambda s, d: rounded(_parcels(s, d)[1], "r", places=6), _PC + "SELECT CAST(parcel AS INTEGER) AS parcel, 'a' || la || ' & b' || lb AS name, round((la / 10.0 + lb / 10.0) / 2, 6) AS r, 0.5::DOUBLE AS g, 0.25::DOUBLE AS b, 1.0::DOUBLE AS alpha FROM r")
register("dense_surface", lambda s, d: align.to_dense(600, points(s, d).where("label <> 2").select("vertex", F.col("embedding")[0].cast("double").alias("value"))), "SELECT g AS vertex, CAST(embedding[1] AS DOUBLE) AS value FROM range(600) t(g) LEFT JOIN embeddings ON vec_id = g AND label <> 2")
register("mask_elements", lambda s, d: align.mask_elements(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("features"))).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0")
register("mask_elements_all", lambda s, d: align.mask_elements(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("features")), rule="all").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")

# binning
register(
    "shells",
    lambda s, d: rounded(binning.shells(table(s, d, "events").select("event_id", "value"), "value", 0.05).select("event_id", "shell", "rounded"), "rounded"),
    "WITH g AS (SELECT event_id, value, CASE WHEN value - lag(value) OVER (ORDER BY value) >= 0.05 THEN 1 ELSE 0 END AS o FROM events), s AS (SELECT *, sum(o) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS shell FROM g) SELECT event_id, CAST(max(shell) OVER (PARTITION BY value) AS BIGINT) AS shell, round(median(value) OVER (PARTITION BY shell), 6) AS rounded FROM s",
)
_ED = "SELECT l_orderkey, l_linenumber, CAST((SELECT count(*) FROM e WHERE e.v <= l_extendedprice) AS INTEGER) AS bin FROM lineitem"


def _bins(edges):
    def run(spark, d):
        df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        return binning.discretise(df, "l_extendedprice", edges(df)).select("l_orderkey", "l_linenumber", "bin")

    return run


register("discretise_regular", _bins(lambda df: binning.regular_edges(df, "l_extendedprice", 10)), "WITH m AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem), e AS (SELECT CASE WHEN k = 10 THEN hi + 1e-8 ELSE lo + k * (hi - lo) / 10 END AS v FROM m, range(11) r(k)) " + _ED)
register("discretise_number", _bins(lambda df: binning.number_edges(df, "l_extendedprice", 10)), "WITH o AS (SELECT l_extendedprice v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem), e AS (SELECT CASE WHEN k = 10 THEN v + 1e-8 ELSE v END AS v FROM o, range(11) t(k) WHERE r = round_even(k * (n - 1) / 10.0, 0)) " + _ED)
register("discretise_weight", _bins(lambda df: binning.weight_edges(df, "l_extendedprice", "l_quantity", 10)), "WITH w AS (SELECT l_extendedprice v, sum(l_quantity) w FROM lineitem GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS upto, sum(w) OVER () AS total FROM w), e AS (SELECT '-infinity'::DOUBLE AS v UNION ALL SELECT min(v) FROM c, range(1, 10) t(k) WHERE upto > k * total / 10 GROUP BY k) " + _ED)
register("discretise_explicit", _bins(lambda df: [1000.0, 20000.0, 50000.0]), "WITH e AS (SELECT unnest([1000.0, 20000.0, 50000.0]) AS v) " + _ED)
register(
    "discretise_zeros",
    lambda s, d: binning.discretise(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), "l_tax", binning.weight_edges(table(s, d, "lineitem"), "l_tax", "l_quantity", 4)).select("l_orderkey", "l_linenumber", "bin"),
    "WITH w AS (SELECT l_tax v, sum(l_quantity) w FROM lineitem WHERE l_tax <> 0 GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS upto, sum(w) OVER () AS total FROM w), e AS (SELECT '-infinity'::DOUBLE AS v UNION ALL SELECT min(v) FROM c, range(1, 4) t(k) WHERE upto > k * total / 4 GROUP BY k) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_tax = 0 THEN 0 ELSE (SELECT count(*) FROM e WHERE e.v <= l_tax) END AS INTEGER) AS bin FROM lineitem",
)
register("even_slices", lambda s, d: binning.even_slices(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", "slice"), "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CAST((SELECT count(*) FROM range(1, 7) t(k) WHERE round_even(k * n / 7.0, 0) <= r) AS INTEGER) AS slice FROM r")


# statistics
def _long(spark, d):
    return points(spark, d).select(F.col("vertex").alias("row"), F.posexplode("embedding").alias("col", "value"))


_LONG = "WITH l AS (SELECT vec_id AS r, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) "
register("pearson", lambda s, d: rounded(stats.correlate_columns(_long(s, d), _long(s, d)), "r"), _LONG + "SELECT CAST(a.c AS INTEGER) AS c1, CAST(b.c AS INTEGER) AS c2, round(corr(a.v, b.v), 6) AS r FROM l a JOIN l b USING (r) GROUP BY 1, 2")
register("connectome_slice", lambda s, d: rounded(stats.VirtualConnectome(_long(s, d))[0:9, 32:], "r"), _LONG + "SELECT CAST(a.c AS INTEGER) AS c1, CAST(b.c AS INTEGER) AS c2, round(corr(a.v, b.v), 6) AS r FROM l a JOIN l b USING (r) WHERE a.c < 9 AND b.c >= 32 GROUP BY 1, 2")
register("pearson_paired", lambda s, d: rounded(stats.correlate_columns(_long(s, d), _long(s, d).withColumn("value", F.col("value") * F.col("value")), collapse=True), "r", places=4), _LONG + "SELECT CAST(c AS INTEGER) AS c1, CAST(c AS INTEGER) AS c2, round(corr(v, v * v), 4) AS r FROM l GROUP BY c")


def _rank_inputs(spark, d):
    e = table(spark, d, "events")
    return e.select("event_type", F.col("event_id").alias("feature"), "value"), e.select("event_type", F.col("event_id").alias("feature"), F.col("user_id").cast("double").alias("value"))


_RK = "WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ry FROM events) "
register("spearman", lambda s, d: rounded(stats.spearman(*_rank_inputs(s, d), ["event_type"]), "rho"), _RK + "SELECT event_type, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1")


def _feature_groups(spark, d):
    """Rank correlations of event values and users, over all events and over those of each structure group."""
    e = table(spark, d, "events")
    name = F.element_at(F.array(*[F.lit(x) for x in ("CORTEX_LEFT", "CORTEX_RIGHT", "THALAMUS_LEFT", "BRAIN_STEM")]), (F.col("event_id") % 4 + 1).cast("int"))
    return rounded(stats.grouped_spearman(*_rank_inputs(spark, d), ["event_type"], e.select(F.col("event_id").alias("feature"), name.alias("structure"))), "rho")


_TAGS = "s AS (SELECT event_id, event_type, value, user_id, ['CORTEX_LEFT','CORTEX_RIGHT','THALAMUS_LEFT','BRAIN_STEM'][event_id % 4 + 1] AS s FROM events), t AS (SELECT 'full' AS g, * FROM s UNION ALL SELECT s, * FROM s WHERE s LIKE '%CORTEX%' UNION ALL SELECT 'cortex', * FROM s WHERE s LIKE '%CORTEX%' UNION ALL SELECT 'sub_cortical', * FROM s WHERE s NOT LIKE '%CORTEX%' UNION ALL SELECT 'left', * FROM s WHERE s LIKE '%LEFT' UNION ALL SELECT 'right', * FROM s WHERE s LIKE '%RIGHT')"
register(
    "spearman_groups",
    _feature_groups,
    f"WITH {_TAGS}, r AS (SELECT event_type, g, rank() OVER (PARTITION BY event_type, g ORDER BY value) + (count(*) OVER (PARTITION BY event_type, g, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY event_type, g ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, g, user_id) - 1) / 2.0 AS ry FROM t) SELECT event_type, g AS \"group\", round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2",
)


def _structures(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("CORTEX_LEFT", "CORTEX_RIGHT", "THALAMUS_LEFT", "BRAIN_STEM")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", "c_acctbal", name.alias("structure"))


register(
    "structure_groups",
    lambda s, d: rounded(stats.structure_groups(_structures(s, d)).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean")), "mean", places=4),
    "WITH s AS (SELECT c_acctbal v, ['CORTEX_LEFT','CORTEX_RIGHT','THALAMUS_LEFT','BRAIN_STEM'][c_nationkey % 4 + 1] AS s FROM customer), t AS (SELECT 'full' g, v FROM s UNION ALL SELECT s, v FROM s WHERE s LIKE '%CORTEX%' UNION ALL SELECT 'cortex', v FROM s WHERE s LIKE '%CORTEX%' UNION ALL SELECT 'sub_cortical', v FROM s WHERE s NOT LIKE '%CORTEX%' UNION ALL SELECT 'left', v FROM s WHERE s LIKE '%LEFT' UNION ALL SELECT 'right', v FROM s WHERE s LIKE '%RIGHT') SELECT g AS \"group\", count(*) AS n, round(avg(v), 4) AS mean FROM t GROUP BY 1",
)
register("normalise", lambda s, d: rounded(stats.normalise(_long(s, d).select(F.col("row").alias("element"), F.col("col").alias("time"), "value")), "value", places=4))


register(
    "dbscan",
    lambda s, d: pairs.density_clusters(features(s, d), 1.25, 4),
    """WITH RECURSIVE f AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT a.v AS src, b.v AS dst FROM f a, f b WHERE list_distance(a.e, b.e) <= 1.25),
core AS (SELECT src AS v FROM n GROUP BY 1 HAVING count(*) >= 4), ce AS (SELECT src, dst FROM n JOIN core p ON p.v = src JOIN core q ON q.v = dst),
reach(v, c) AS (SELECT v, v FROM core UNION SELECT ce.dst, r.c FROM reach r JOIN ce ON ce.src = r.v), lab AS (SELECT v, min(c) AS c FROM reach GROUP BY 1),
bord AS (SELECT src AS v, min(c) AS c FROM n JOIN lab ON lab.v = dst GROUP BY 1)
SELECT f.v AS vertex, coalesce(lab.c, bord.c, -1) AS cluster FROM f LEFT JOIN lab USING (v) LEFT JOIN bord USING (v)""",
)


def _neighbours(spark, d):
    """Similarities of the features of neighbouring vertices."""
    return graph.edge_dissimilarity(mesh.edges(lattice(spark, d)), features(spark, d)).select("src", "dst", F.exp(-F.col("value")).alias("weight"))


register("spectral_clusters", lambda s, d: stats.spectral(_neighbours(s, d), 3))
register("affinity_clusters", lambda s, d: stats.affinity_features(features(s, d).join(points(s, d).select("vertex", F.col("label").cast("long").alias("group")), "vertex")))


def axis_sql(key: str) -> str:
    """Common table expressions from moments mom (key, m00, m01, m02, m11, m12, m22) to main axes ax (key, axis_x, axis_y, axis_z, value), by repeated squaring."""
    tr = "(a*a+b*b+c*c+b*b+d*d+e*e+c*c+e*e+f*f)"
    return f"""sq({key}, it, a, b, c, d, e, f) AS (
  SELECT {key}, 0, m00/(m00+m11+m22), m01/(m00+m11+m22), m02/(m00+m11+m22), m11/(m00+m11+m22), m12/(m00+m11+m22), m22/(m00+m11+m22) FROM mom WHERE m00+m11+m22 > 0
  UNION ALL
  SELECT {key}, it + 1, (a*a+b*b+c*c)/{tr}, (a*b+b*d+c*e)/{tr}, (a*c+b*e+c*f)/{tr}, (b*b+d*d+e*e)/{tr}, (b*c+d*e+e*f)/{tr}, (c*c+e*e+f*f)/{tr} FROM sq WHERE it < 16
), col AS (SELECT {key}, CASE WHEN a >= d AND a >= f THEN a WHEN d >= f THEN b ELSE c END vx, CASE WHEN a >= d AND a >= f THEN b WHEN d >= f THEN d ELSE e END vy, CASE WHEN a >= d AND a >= f THEN c WHEN d >= f THEN e ELSE f END vz FROM sq WHERE it = 16),
un AS (SELECT {key}, vx/sqrt(vx*vx+vy*vy+vz*vz) axis_x, vy/sqrt(vx*vx+vy*vy+vz*vz) axis_y, vz/sqrt(vx*vx+vy*vy+vz*vz) axis_z FROM col),
ax AS (SELECT un.*, axis_x*(m00*axis_x+m01*axis_y+m02*axis_z)+axis_y*(m01*axis_x+m11*axis_y+m12*axis_z)+axis_z*(m02*axis_x+m12*axis_y+m22*axis_z) AS value FROM un JOIN mom USING ({key}))"""


_MOM = ", ".join(f"sum({p}*{q}) AS m{i}{j}" for i, p in enumerate("xyz") for j, q in enumerate("xyz") if i <= j)
register("principal_axis", lambda s, d: rounded(stats.principal_axis(points(s, d).select("label", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")]), ["label"], ("x", "y", "z")), "axis_x", "axis_y", "axis_z", "value", places=5), f"WITH RECURSIVE v AS (SELECT label, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings), mom AS (SELECT label, {_MOM} FROM v GROUP BY 1), {axis_sql('label')} SELECT label, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("axis_x", "axis_y", "axis_z", "value")) + " FROM ax")


def _border(spark, d):
    p = points(spark, d)
    runs = p.select("vertex", F.explode(F.array(*[F.struct(F.lit(k).alias("run"), F.pmod(F.floor(F.col("vertex") / (5 + k)), F.lit(3)).alias("label")) for k in range(4)])).alias("r")).select("vertex", "r.*")
    return rounded(stats.boundary_frequency(runs, mesh.edges(lattice(spark, d)), p), "border")


register("boundary_frequency", _border, f"WITH {SQL_MESH}, r AS (SELECT vertex, k AS run, (vertex // (5 + k)) % 3 AS label FROM verts, range(4) t(k)), x AS (SELECT a.run, src, max(CASE WHEN a.label <> b.label THEN 1 ELSE 0 END) AS b FROM edges JOIN r a ON a.vertex = src JOIN r b ON b.vertex = dst AND b.run = a.run GROUP BY 1, 2) SELECT vertex, round(avg(b), 6) AS border FROM verts LEFT JOIN x ON src = vertex GROUP BY 1")

# scalar functions
_XYZ = "WITH v AS (SELECT vec_id AS vertex, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y, CAST(embedding[3] AS DOUBLE) z FROM embeddings), s AS (SELECT *, sqrt(x*x+y*y+z*z) AS r FROM v) "


def _xyz(spark, d):
    return points(spark, d).select("vertex", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])


register("cart2spherical", lambda s, d: rounded(_xyz(s, d).select("vertex", *[c.alias(n) for c, n in zip(g.cart2spherical(*[F.col(c) for c in "xyz"]), ("r", "phi", "theta"), strict=True)]), "r", "phi", "theta"), _XYZ + "SELECT vertex, round(r, 6) AS r, round(atan2(y, x), 6) AS phi, round(acos(z / r), 6) AS theta FROM s")
register("spherical_round_trip", lambda s, d: rounded(_xyz(s, d).select("vertex", *[c.alias(n) for c, n in zip(g.spherical2cart(*g.cart2spherical(*[F.col(c) for c in "xyz"])), "xyz", strict=True)]), "x", "y", "z"), _XYZ + "SELECT vertex, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s")


def _euler(spark, d):
    # in steps: one expression of all would hold the matrix hundreds of times
    place = [(i, j) for i in range(3) for j in range(3)]
    m = g.euler2mat(*[F.col(c) for c in "xyz"])
    df = _xyz(spark, d).select("vertex", *[m[i][j].alias(f"m{i}{j}") for i, j in place])
    known = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    df = df.select("*", *[a.alias(n) for a, n in zip(g.mat2euler(known), ("phi", "theta", "psi"), strict=True)])
    angles = [F.col(c) for c in ("phi", "theta", "psi")]
    back = g.euler2mat(*angles)
    worst = F.greatest(*[F.abs(known[i][j] - back[i][j]) for i, j in place])
    return df.select("vertex", (worst < 1e-9).alias("same"), ((angles[1] >= 0) & (F.abs(angles[0]) <= 3.15) & (F.abs(angles[2]) <= 3.15)).alias("within"))


register("euler_round_trip", _euler, "SELECT vec_id AS vertex, true AS same, true AS within FROM embeddings")


def _euler_matrix(spark, d):
    m = g.euler2mat(*[F.col(c) for c in "xyz"])
    return rounded(_xyz(spark, d).select("vertex", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)]), *[f"m{i}{j}" for i in range(3) for j in range(3)])


_EUL = _XYZ + ", e AS (SELECT vertex, cos(x)*cos(y)*cos(z)-sin(x)*(-sin(z))*(-1) AS m00, cos(x)*cos(y)*sin(z)-sin(x)*cos(z) AS m01, cos(x)*sin(y) AS m02, sin(x)*cos(y)*cos(z)-cos(x)*sin(z) AS m10, sin(x)*cos(y)*sin(z)+cos(x)*cos(z) AS m11, sin(x)*sin(y) AS m12, -sin(y)*cos(z) AS m20, -sin(y)*sin(z) AS m21, cos(y) AS m22 FROM s) "
_EUL = _EUL.replace("cos(x)*cos(y)*cos(z)-sin(x)*(-sin(z))*(-1)", "cos(x)*cos(y)*cos(z)+sin(x)*sin(z)")
register("euler_matrix", _euler_matrix, _EUL + "SELECT vertex, " + ", ".join(f"round(m{i}{j}, 6) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM e")


def _clean_euler(spark, d):
    angles = g.clean_euler(*[F.col(c) * 3 for c in "xyz"])
    return rounded(_xyz(spark, d).select("vertex", *[a.alias(n) for a, n in zip(angles, ("phi", "theta", "psi"), strict=True)]), "phi", "theta", "psi", places=5)


register(
    "clean_euler",
    _clean_euler,
    _EUL.replace("FROM s) ", "FROM (SELECT vertex, 3*x AS x, 3*y AS y, 3*z AS z FROM s)) ") + "SELECT vertex, round(atan2(m12, m02), 5) AS phi, round(acos(greatest(-1, least(1, m22))), 5) AS theta, round(atan2(-m21, -m20), 5) AS psi FROM e",
)


def _coalesced(spark, d):
    p = points(spark, d)
    one = lambda k, gone: p.select("vertex", *[F.when(F.col("label") == gone, F.lit(0.0)).otherwise(F.col("embedding")[k + n].cast("double")).alias(c) for n, c in enumerate("xyz")])
    return rounded(align.coalesce_frames([one(0, 3).where("vertex % 2 = 0"), one(3, 4)], ["vertex"], ["x", "y", "z"]), "x", "y", "z")


register("coalesce_frames", _coalesced, "SELECT vec_id AS vertex, " + ", ".join(f"round(CASE WHEN vec_id % 2 = 0 AND label <> 3 THEN CAST(embedding[{n}] AS DOUBLE) WHEN label <> 4 THEN CAST(embedding[{n + 3}] AS DOUBLE) ELSE 0.0 END, 6) AS {c}" for n, c in enumerate("xyz", 1)) + " FROM embeddings")


def _frame(spark, d):
    df = points(spark, d).select("vertex", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("a_x", "a_y", "a_z", "b_x", "b_y", "b_z"))])
    r, t, s = g.make_perpendicular(g.vec("a"), g.vec("b"))
    return rounded(df.select("vertex", *[x.alias(f"{n}_{c}") for n, v in zip("rts", (r, g.align(t, g.vec("b")), s), strict=True) for x, c in zip(v, "xyz", strict=True)]), *[f"{n}_{c}" for n in "rts" for c in "xyz"])


register(
    "gyral_frame",
    _frame,
    "WITH v AS (SELECT vec_id AS vertex, CAST(embedding[1] AS DOUBLE) ax, CAST(embedding[2] AS DOUBLE) ay, CAST(embedding[3] AS DOUBLE) az, CAST(embedding[4] AS DOUBLE) bx, CAST(embedding[5] AS DOUBLE) b_y, CAST(embedding[6] AS DOUBLE) bz FROM embeddings), "
    "r AS (SELECT vertex, ax/sqrt(ax*ax+ay*ay+az*az) rx, ay/sqrt(ax*ax+ay*ay+az*az) ry, az/sqrt(ax*ax+ay*ay+az*az) rz, bx, b_y, bz FROM v), "
    "p AS (SELECT *, bx-rx*(bx*rx+b_y*ry+bz*rz) px, b_y-ry*(bx*rx+b_y*ry+bz*rz) py, bz-rz*(bx*rx+b_y*ry+bz*rz) pz FROM r), "
    "t AS (SELECT vertex, rx, ry, rz, px/sqrt(px*px+py*py+pz*pz) tx, py/sqrt(px*px+py*py+pz*pz) ty, pz/sqrt(px*px+py*py+pz*pz) tz FROM p) "
    "SELECT vertex, round(rx,6) r_x, round(ry,6) r_y, round(rz,6) r_z, round(tx,6) t_x, round(ty,6) t_y, round(tz,6) t_z, round(ry*tz-rz*ty,6) s_x, round(rz*tx-rx*tz,6) s_y, round(rx*ty-ry*tx,6) s_z FROM t",
)


def _named(spark, d):
    df = _structures(spark, d).select("c_custkey", F.concat(F.lit("CIFTI_STRUCTURE_"), "structure").alias("name"))
    s = structures.parse_structure(F.col("name"))
    return df.select("c_custkey", s["primary"].alias("primary"), s["hemisphere"].alias("hemisphere"), structures.gifti_name(s["primary"], s["hemisphere"]).alias("gifti"), structures.cifti_name(s["primary"], s["hemisphere"]).alias("cifti"))


register("structure_names", _named, "SELECT c_custkey, ['cortex','cortex','thalamus','brain_stem'][c_nationkey % 4 + 1] AS \"primary\", ['left','right','left','both'][c_nationkey % 4 + 1] AS hemisphere, ['CortexLeft','CortexRight','ThalamusLeft','BrainStem'][c_nationkey % 4 + 1] AS gifti, 'CIFTI_STRUCTURE_' || ['CORTEX_LEFT','CORTEX_RIGHT','THALAMUS_LEFT','BRAIN_STEM'][c_nationkey % 4 + 1] AS cifti FROM customer")

# spatial joins
_PT = "pt AS (SELECT p_partkey AS point, (p_partkey % 97) / 4.0 AS x, (p_partkey % 71) / 4.0 AS y, (p_size - 25) / 10.0 AS z FROM part)"


def _points(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("point"), ((k % 97) / 4.0).alias("x"), ((k % 71) / 4.0).alias("y"), ((F.col("p_size") - 25) / 10.0).alias("z"))


register(
    "nearest_vertex",
    lambda s, d: rounded(spatial.nearest_vertex(_points(s, d), lattice(s, d).vertices, 2.0), "dist"),
    f"WITH {SQL_MESH}, {_PT}, c AS (SELECT point, vertex, (pt.x-v.x)*(pt.x-v.x)+(pt.y-v.y)*(pt.y-v.y)+(pt.z-v.z)*(pt.z-v.z) AS d2 FROM pt, verts v), b AS (SELECT point, arg_min(vertex, (d2, vertex)) AS vertex, min(d2) AS d2 FROM c WHERE d2 < 4 GROUP BY 1) SELECT point, b.vertex, round(sqrt(b.d2), 6) AS dist FROM pt LEFT JOIN b USING (point)",
)
register("nearest_any", lambda s, d: rounded(spatial.nearest_any(_points(s, d), lattice(s, d).vertices, 1.0), "dist"), f"WITH {SQL_MESH}, {_PT}, c AS (SELECT point, vertex, (pt.x-v.x)*(pt.x-v.x)+(pt.y-v.y)*(pt.y-v.y)+(pt.z-v.z)*(pt.z-v.z) AS d2 FROM pt, verts v) SELECT point, arg_min(vertex, (d2, vertex)) AS vertex, round(sqrt(min(d2)), 6) AS dist FROM c GROUP BY 1")


def _raised(m, by):
    return m.vertices.select("vertex", "x", "y", (F.col("z") + by).alias("z"))


register(
    "nearest_segment",
    lambda s, d: rounded(spatial.nearest_segment(_points(s, d), lattice(s, d).vertices, _raised(lattice(s, d), 1.0), 1.5), "dist"),
    f"WITH {SQL_MESH}, {_PT}, c AS (SELECT point, vertex, sqrt((pt.x-v.x)*(pt.x-v.x)+(pt.y-v.y)*(pt.y-v.y)+power(pt.z-v.z-least(1, greatest(0, pt.z-v.z)), 2)) AS d FROM pt, verts v), b AS (SELECT point, arg_min(vertex, (d, vertex)) AS vertex, min(d) AS d FROM c WHERE d <= 1.5 GROUP BY 1) SELECT point, b.vertex, round(b.d, 6) AS dist FROM pt LEFT JOIN b USING (point)",
)
register("bounding", lambda s, d: rounded(spatial.bounding(lattice(s, d), 0.5), "low_x", "low_y", "low_z"), f"WITH {SQL_MESH} SELECT " + ", ".join(f"round(min({c}), 6) AS low_{c}, CAST(greatest(1, ceil((max({c}) - min({c})) / 0.5)) AS BIGINT) AS n_{c}" for c in "xyz") + " FROM verts")
register("voxel_triangles", lambda s, d: spatial.voxel_triangles(lattice(s, d)), f"WITH {SQL_MESH}, {SQL_VOXELS} SELECT i, j, k, face FROM hit")
register("voxel_hits", lambda s, d: spatial.hits_per_voxel(spatial.voxel_triangles(lattice(s, d))), f"WITH {SQL_MESH}, {SQL_VOXELS} SELECT i, j, k, count(*) AS nhit FROM hit GROUP BY ALL")
register("voxel_triangles_fine", lambda s, d: spatial.hits_per_voxel(spatial.voxel_triangles(lattice(s, d), 2.0)), f"WITH {SQL_MESH.replace('verts AS (SELECT', 'verts AS (SELECT vertex, x / 2 AS x, y / 2 AS y, z / 2 AS z FROM (SELECT', 1).replace('FROM embeddings),', 'FROM embeddings)),', 1)}, {SQL_VOXELS} SELECT i, j, k, count(*) AS nhit FROM hit GROUP BY ALL")


def _down(spark, d):
    return _points(spark, d).select(F.col("point").alias("ray"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.lit(5.0).alias("o_z"), F.lit(0.0).alias("d_x"), F.lit(0.0).alias("d_y"), F.lit(-1.0).alias("d_z"))


register(
    "ray_hits",
    lambda s, d: rounded(spatial.ray_hits(_down(s, d), lattice(s, d), 10.0).select("ray", "t"), "t", places=4),
    f"WITH {SQL_MESH}, {_PT}, h AS (SELECT point, 5.0 - (az + ((pt.x-ax)*(cy-ay)-(pt.y-ay)*(cx-ax))/((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))*(bz-az) + ((bx-ax)*(pt.y-ay)-(by_-ay)*(pt.x-ax))/((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))*(cz-az)) AS t, ((pt.x-ax)*(cy-ay)-(pt.y-ay)*(cx-ax))/((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) AS u, ((bx-ax)*(pt.y-ay)-(by_-ay)*(pt.x-ax))/((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax)) AS v FROM pt, tri) "
    "SELECT pt.point AS ray, round(min(CASE WHEN u >= -1e-5 AND v >= -1e-5 AND u + v <= 1 + 2e-5 AND t >= 0 AND t <= 10 THEN t END), 4) AS t FROM pt LEFT JOIN h USING (point) GROUP BY 1",
)
#: boxes that points are inside of or not: lower corner and size
BOX, SMALL = ((2.1, 1.3, -1.05), (15.2, 12.4, 2.2)), ((4.1, 3.3, -0.55), (9.2, 7.4, 1.2))


def _box(spark, box):
    return cortex.cuboid(spark, box[1], box[0])


def _within(box) -> str:
    return " AND ".join(f"{c} > {lo} AND {c} < {lo + size}" for c, lo, size in zip("xyz", *box, strict=True))


_OUT = "sqrt(" + "+".join(f"power(greatest(({lo})-{c}, 0, {c}-({lo + size})), 2)" for c, lo, size in zip("xyz", *BOX, strict=True)) + ")"
_DEEP = "least(" + ", ".join(f"{c}-({lo}), ({lo + size})-{c}" for c, lo, size in zip("xyz", *BOX, strict=True)) + ")"
register("inside", lambda s, d: spatial.inside(_points(s, d), _box(s, BOX)), f"WITH {_PT} SELECT point, {_within(BOX)} AS inside FROM pt")
register("signed_distance", lambda s, d: rounded(spatial.signed_distance(_points(s, d), _box(s, BOX), 2.0), "dist", places=5), f"WITH {_PT}, d AS (SELECT point, CAST(CASE WHEN {_within(BOX)} THEN -({_DEEP}) ELSE {_OUT} END AS DOUBLE) AS dist FROM pt) SELECT point, round(CASE WHEN abs(dist) <= 2 THEN dist END, 5) AS dist FROM d")
register("enclosing_surfaces", lambda s, d: spatial.enclosing_surfaces(_points(s, d), [_box(s, BOX), _box(s, SMALL)]), f"WITH {_PT} SELECT point, CAST({_within(BOX)} AS INTEGER) + CAST({_within(SMALL)} AS INTEGER) AS n FROM pt")
register(
    "voxel_edge_crossings",
    lambda s, d: spatial.voxel_edge_crossings(lattice(s, d)),
    f"""WITH {SQL_MESH}, {SQL_VOXELS},
l0 AS (SELECT i, j, k, n AS dim, dx, dy, dz, i-ax sx, j-ay sy, k-az sz, bx-ax e1x, by_-ay e1y, bz-az e1z, cx-ax e2x, cy-ay e2y, cz-az e2z FROM hit JOIN tri USING (face), (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) t(n, dx, dy, dz)),
l1 AS (SELECT *, dy*e2z-dz*e2y hx, dz*e2x-dx*e2z hy, dx*e2y-dy*e2x hz, sy*e1z-sz*e1y qx, sz*e1x-sx*e1z qy, sx*e1y-sy*e1x qz FROM l0),
l2 AS (SELECT *, e1x*hx+e1y*hy+e1z*hz AS det FROM l1),
l3 AS (SELECT i, j, k, dim, (sx*hx+sy*hy+sz*hz)/det u, (dx*qx+dy*qy+dz*qz)/det v, (e2x*qx+e2y*qy+e2z*qz)/det t FROM l2 WHERE abs(det) > 1e-12)
SELECT DISTINCT i, j, k, CAST(dim AS INTEGER) AS dim FROM l3 WHERE u >= -1e-5 AND v >= -1e-5 AND u + v <= 1 + 2e-5 AND t >= 0 AND t <= 1""",
)
_VN = "vn AS (SELECT vertex, sum(nx/len) sx, sum(ny/len) sy, sum(nz/len) sz FROM inc JOIN unitn USING (face) GROUP BY 1), vu AS (SELECT vertex, sx/sqrt(sx*sx+sy*sy+sz*sz) ux, sy/sqrt(sx*sx+sy*sy+sz*sz) uy, sz/sqrt(sx*sx+sy*sy+sz*sz) uz FROM vn)"
register(
    "point_orientation",
    lambda s, d: rounded(spatial.point_orientation(_points(s, d), lattice(s, d).vertices, mesh.vertex_normals(lattice(s, d))), "axis_x", "axis_y", "axis_z", "value", places=4),
    f"WITH RECURSIVE {SQL_MESH}, {_PT}, {_VN}, w AS (SELECT point, (pt.x-v.x)*(pt.x-v.x)+(pt.y-v.y)*(pt.y-v.y)+(pt.z-v.z)*(pt.z-v.z) AS d2, ux, uy, uz FROM pt, verts v JOIN vu USING (vertex)), v AS (SELECT point, ux/sqrt(d2) AS x, uy/sqrt(d2) AS y, uz/sqrt(d2) AS z FROM w WHERE d2 > 0 AND d2 <= 9), mom AS (SELECT point, {_MOM} FROM v GROUP BY 1), {axis_sql('point')} SELECT point, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("axis_x", "axis_y", "axis_z", "value")) + " FROM ax",
)


def _between(spark, d):
    """Two surfaces, the outer one above the inner one, and a depth on them."""
    m = lattice(spark, d)
    depth = points(spark, d).select("vertex", F.col("embedding")[1].cast("double").alias("f"))
    return m, mesh.Mesh(_raised(m, 2.0), m.faces), depth


_FRAME = [f"{k}_{c}" for k in ("radial", "sulcal", "gyral") for c in "xyz"]
register("orientation_closest", lambda s, d: rounded(orientation.gyral_coordinates(_points(s, d), *_between(s, d), algorithm="closest", max_dist=3.0, outside_pial=True), *_FRAME, places=4))
register("orientation_interp", lambda s, d: rounded(orientation.gyral_coordinates(_points(s, d), *_between(s, d), algorithm="interp", max_dist=3.0, outside_pial=True), *_FRAME, places=4))
register("orientation_line", lambda s, d: rounded(orientation.gyral_coordinates(_points(s, d), *_between(s, d), algorithm="line", max_dist=4.0, outside_pial=True, norient=12), *_FRAME, places=4))
