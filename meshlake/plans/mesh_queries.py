"""Queries on the lattice mesh over ``embeddings``, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import curves, graph, mesh, pairs, spatial, tracking
from meshlake.plans.catalog import register

W = 25

#: Common table expressions of the lattice mesh in DuckDB.
SQL_MESH = """
verts AS (SELECT vec_id AS vertex, CAST(vec_id % 25 AS DOUBLE) AS x, CAST(vec_id // 25 AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS z FROM embeddings),
corner AS (SELECT vertex v FROM verts WHERE vertex % 25 < 24 AND vertex + 26 <= (SELECT max(vertex) FROM verts)),
faces AS (SELECT 2 * v AS face, v AS a, v + 1 AS b, v + 25 AS c FROM corner UNION ALL SELECT 2 * v + 1, v + 1, v + 26, v + 25 FROM corner),
inc AS (SELECT face, a AS vertex FROM faces UNION ALL SELECT face, b FROM faces UNION ALL SELECT face, c FROM faces),
edges AS (SELECT DISTINCT i.vertex AS src, j.vertex AS dst FROM inc i JOIN inc j USING (face) WHERE i.vertex <> j.vertex),
tri AS (SELECT face, a, b, c, va.x ax, va.y ay, va.z az, vb.x bx, vb.y by_, vb.z bz, vc.x cx, vc.y cy, vc.z cz
        FROM faces JOIN verts va ON va.vertex = a JOIN verts vb ON vb.vertex = b JOIN verts vc ON vc.vertex = c),
nrm AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM tri),
unitn AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS len FROM nrm)
"""


def _apart_sql() -> str:
    """Whether an axis separates a triangle (pa, pb, pc around a voxel's centre) from the unit cube."""
    p = {k: [f"p{k}{c}" for c in "xyz"] for k in "abc"}
    out = []
    for s, e in ("ab", "bc", "ca"):
        way = [f"({p[e][n]}-{p[s][n]})" for n in range(3)]
        for axis in range(3):
            d1, d2 = (n for n in range(3) if n != axis)
            across = ", ".join(f"{p[k][d1]}*{way[d2]}-{p[k][d2]}*{way[d1]}" for k in "abc")
            out += [f"least({across}) > (abs({way[d1]})+abs({way[d2]}))/2", f"greatest({across}) < -(abs({way[d1]})+abs({way[d2]}))/2"]
    out.append("abs(nx*pax+ny*pay+nz*paz) > (abs(nx)+abs(ny)+abs(nz))/2")
    return " OR ".join(out)


def _voxels_sql() -> str:
    tri, names = {"x": ("ax", "bx", "cx"), "y": ("ay", "by_", "cy"), "z": ("az", "bz", "cz")}, dict(zip("xyz", "ijk", strict=True))
    spans = [f"unnest(generate_series(CAST(floor(least({', '.join(t)})+0.5) AS BIGINT), CAST(greatest(floor(least({', '.join(t)})+0.5), ceil(greatest({', '.join(t)})-0.5)) AS BIGINT))) AS {names[c]}" for c, t in tri.items()]
    shift = ", ".join(f"{t[n]}-{names[c]} AS p{k}{c}" for c, t in tri.items() for n, k in enumerate("abc"))
    return f"v1 AS (SELECT *, {spans[0]} FROM nrm), v2 AS (SELECT *, {spans[1]} FROM v1), v3 AS (SELECT *, {spans[2]} FROM v2), v4 AS (SELECT *, {shift} FROM v3), hit AS (SELECT i, j, k, face FROM v4 WHERE NOT ({_apart_sql()}))"


#: Voxels that triangles meet: hit (i, j, k, face).
SQL_VOXELS = _voxels_sql()


def points(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").withColumnRenamed("vec_id", "vertex")


def lattice(spark, d) -> mesh.Mesh:
    return mesh.lattice(points(spark, d).select("vertex", "embedding"), F.col("embedding")[0], W)


def features(spark, d, positive: bool = False):
    one = (lambda x: F.abs(x.cast("double"))) if positive else (lambda x: x.cast("double"))
    return points(spark, d).select("vertex", F.transform("embedding", one).alias("features"))


def rounded(df, *names, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


#: For each metric: per-entry terms p, q and the aggregate over them.
SQL_METRICS = {
    "histogram_intersection": "sum(least(a.x / a.s, b.x / b.s))",
    "braycurtis": "sum(abs(a.x - b.x)) / sum(abs(a.x + b.x))",
    "canberra": "sum(CASE WHEN abs(a.x) + abs(b.x) = 0 THEN 0 ELSE abs(a.x - b.x) / (abs(a.x) + abs(b.x)) END)",
    "cityblock": "sum(abs(a.x - b.x))",
    "correlation": "1 - sum((a.x - a.m) * (b.x - b.m)) / sqrt(sum((a.x - a.m) * (a.x - a.m)) * sum((b.x - b.m) * (b.x - b.m)))",
    "cosine": "1 - sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x))",
    "euclidean": "sqrt(sum((a.x - b.x) * (a.x - b.x)))",
    "hamming": "avg(CASE WHEN a.x <> b.x THEN 1.0 ELSE 0.0 END)",
    "jaccard": "sum(CASE WHEN a.x <> b.x AND (a.x <> 0 OR b.x <> 0) THEN 1.0 ELSE 0 END) / sum(CASE WHEN a.x <> 0 OR b.x <> 0 THEN 1.0 ELSE 0 END)",
    "jensenshannon": "sqrt(greatest(0, sum(CASE WHEN a.x > 0 THEN a.x / a.s * ln(2 * (a.x / a.s) / (a.x / a.s + b.x / b.s)) ELSE 0 END + CASE WHEN b.x > 0 THEN b.x / b.s * ln(2 * (b.x / b.s) / (a.x / a.s + b.x / b.s)) ELSE 0 END) / 2))",
    "minkowski": "sqrt(sum((a.x - b.x) * (a.x - b.x)))",
    "sqeuclidean": "sum((a.x - b.x) * (a.x - b.x))",
}
POSITIVE = {"histogram_intersection", "jensenshannon"}


def gradient_query(metric: str, method: str):
    def run(spark, d):
        m = lattice(spark, d)
        return rounded(graph.gradient(m.vertices, mesh.edges(m), features(spark, d, metric in POSITIVE), metric, method), "value")

    x = "abs(CAST(e AS DOUBLE))" if metric in POSITIVE else "CAST(e AS DOUBLE)"
    red = {"min": "min", "max": "max", "mean": "avg", "median": "median"}[method]
    sql = f"""WITH {SQL_MESH},
raw AS (SELECT vec_id AS vertex, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS e FROM embeddings),
f AS (SELECT vertex, i, {x} AS x, sum({x}) OVER (PARTITION BY vertex) AS s, avg({x}) OVER (PARTITION BY vertex) AS m FROM raw),
d AS (SELECT e.src, e.dst, {SQL_METRICS[metric]} AS value FROM edges e JOIN f a ON a.vertex = e.src JOIN f b ON b.vertex = e.dst AND b.i = a.i GROUP BY 1, 2)
SELECT vertex, round({red}(value), 6) AS value FROM verts LEFT JOIN d ON src = vertex GROUP BY vertex"""
    return run, sql


for _metric in SQL_METRICS:
    for _method in ("min", "max", "mean", "median"):
        register(f"gradient_{_metric}_{_method}", *gradient_query(_metric, _method))


def on_mesh(f):
    return lambda spark, d: f(lattice(spark, d))


register("mesh_incidence", on_mesh(mesh.incidence), f"WITH {SQL_MESH} SELECT vertex, face FROM inc")
register("mesh_edges", on_mesh(lambda m: rounded(mesh.edges(m, weight="distance"), "w")), f"WITH {SQL_MESH} SELECT src, dst, round(sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)), 6) AS w FROM edges JOIN verts p ON p.vertex = src JOIN verts q ON q.vertex = dst")
register("mesh_edges_diagonal", on_mesh(lambda m: mesh.edges(m, include_diagonal=True, weight=2.5)), f"WITH {SQL_MESH} SELECT DISTINCT i.vertex AS src, j.vertex AS dst, CAST(2.5 AS DOUBLE) AS w FROM inc i JOIN inc j USING (face)")
register("mesh_face_adjacency", on_mesh(mesh.face_adjacency), f"WITH {SQL_MESH} SELECT i.face, j.face AS other, count(*) AS shared FROM inc i JOIN inc j USING (vertex) GROUP BY 1, 2")
register(
    "mesh_neighbour_faces",
    on_mesh(lambda m: mesh.neighbour_faces(m).select("face", F.array_join("neighbours", ",").alias("neighbours"))),
    f"WITH {SQL_MESH}, adj AS (SELECT i.face, j.face AS other FROM inc i JOIN inc j USING (vertex) GROUP BY 1, 2 HAVING count(*) = 2), l AS (SELECT faces.face, coalesce(string_agg(CAST(other AS VARCHAR), ',' ORDER BY other), '') AS s, count(other) AS n FROM faces LEFT JOIN adj USING (face) GROUP BY 1) "
    "SELECT face, s || CASE WHEN n = 0 THEN '-1,-1,-1' ELSE repeat(',-1', CAST(3 - n AS INTEGER)) END AS neighbours FROM l",
)
register("mesh_face_sizes", on_mesh(lambda m: rounded(mesh.face_sizes(m), "size")), f"WITH {SQL_MESH} SELECT face, round(len / 2, 6) AS size FROM unitn")
register("mesh_vertex_sizes", on_mesh(lambda m: rounded(mesh.vertex_sizes(m), "size")), f"WITH {SQL_MESH} SELECT vertex, round(sum(len / 2) / 3, 6) AS size FROM inc JOIN unitn USING (face) GROUP BY 1")
register("mesh_face_normals", on_mesh(lambda m: rounded(mesh.face_normals(m), "n_x", "n_y", "n_z")), f"WITH {SQL_MESH} SELECT face, round(nx/len, 6) AS n_x, round(ny/len, 6) AS n_y, round(nz/len, 6) AS n_z FROM unitn")
_VN = "vn AS (SELECT vertex, sum(nx/len) sx, sum(ny/len) sy, sum(nz/len) sz FROM inc JOIN unitn USING (face) GROUP BY 1)"
register("mesh_vertex_normals", on_mesh(lambda m: rounded(mesh.vertex_normals(m), "n_x", "n_y", "n_z")), f"WITH {SQL_MESH}, {_VN} SELECT vertex, round(sx/sqrt(sx*sx+sy*sy+sz*sz), 6) AS n_x, round(sy/sqrt(sx*sx+sy*sy+sz*sz), 6) AS n_y, round(sz/sqrt(sx*sx+sy*sy+sz*sz), 6) AS n_z FROM vn")
register("mesh_volume", on_mesh(lambda m: rounded(mesh.volume(m), "volume", places=4)), f"WITH {SQL_MESH} SELECT round(sum(ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6, 4) AS volume FROM tri")
register("mesh_closed", on_mesh(mesh.closed), f"WITH {SQL_MESH}, e AS (SELECT least(i.vertex, j.vertex) s, greatest(i.vertex, j.vertex) t, count(*) / 2 AS n FROM inc i JOIN inc j USING (face) WHERE i.vertex <> j.vertex GROUP BY 1, 2) SELECT count(*) FILTER (WHERE n = 1) = 0 AS closed FROM e")


def scalar(spark, d):
    return points(spark, d).select("vertex", F.col("embedding")[1].cast("double").alias("f"))


_GRAD = """sc AS (SELECT vec_id AS vertex, CAST(embedding[2] AS DOUBLE) AS f FROM embeddings),
gr AS (SELECT t.*, bx-ax e1x, by_-ay e1y, bz-az e1z, cx-ax e2x, cy-ay e2y, cz-az e2z, sb.f-sa.f d1, sc2.f-sa.f d2 FROM tri t JOIN sc sa ON sa.vertex = a JOIN sc sb ON sb.vertex = b JOIN sc sc2 ON sc2.vertex = c),
gm AS (SELECT *, e1x*e1x+e1y*e1y+e1z*e1z g11, e1x*e2x+e1y*e2y+e1z*e2z g12, e2x*e2x+e2y*e2y+e2z*e2z g22 FROM gr),
gg AS (SELECT face, (d1*g22-d2*g12)/(g11*g22-g12*g12) AS al, (d2*g11-d1*g12)/(g11*g22-g12*g12) AS be, e1x, e1y, e1z, e2x, e2y, e2z FROM gm),
grad AS (SELECT face, al*e1x+be*e2x AS g_x, al*e1y+be*e2y AS g_y, al*e1z+be*e2z AS g_z FROM gg)"""
register("mesh_face_gradient", lambda s, d: rounded(mesh.face_gradient(lattice(s, d), scalar(s, d)), "g_x", "g_y", "g_z"), f"WITH {SQL_MESH}, {_GRAD} SELECT face, round(g_x, 6) AS g_x, round(g_y, 6) AS g_y, round(g_z, 6) AS g_z FROM grad")
register("mesh_vertex_gradient", lambda s, d: rounded(mesh.vertex_gradient(lattice(s, d), scalar(s, d)), "g_x", "g_y", "g_z"), f"WITH {SQL_MESH}, {_GRAD} SELECT vertex, round(sum(g_x)/3, 6) AS g_x, round(sum(g_y)/3, 6) AS g_y, round(sum(g_z)/3, 6) AS g_z FROM inc JOIN grad USING (face) GROUP BY 1")


def _even(spark, d):
    return points(spark, d).where("vertex % 25 < 12").select("vertex", (-F.col("vertex")).alias("position"))


_SUB = "keep AS (SELECT vertex, row_number() OVER (ORDER BY -vertex) - 1 AS number FROM verts WHERE vertex % 25 < 12)"
register("mesh_submesh_vertices", lambda s, d: mesh.submesh(lattice(s, d), _even(s, d)).vertices.select("vertex", "x", "y", F.round("z", 6).alias("z")), f"WITH {SQL_MESH}, {_SUB} SELECT number AS vertex, x, y, round(z, 6) AS z FROM verts JOIN keep USING (vertex)")
register("mesh_submesh_faces", lambda s, d: mesh.submesh(lattice(s, d), _even(s, d)).faces, f"WITH {SQL_MESH}, {_SUB} SELECT face, ka.number AS a, kb.number AS b, kc.number AS c FROM faces JOIN keep ka ON ka.vertex = a JOIN keep kb ON kb.vertex = b JOIN keep kc ON kc.vertex = c")
register("mesh_apply_affine", on_mesh(lambda m: rounded(mesh.apply_affine(m, [[2, 0, 0, 1], [0, 4, 0, 0], [0, 0, -0.5, 3], [0, 0, 0, 1]]).vertices, "x", "y", "z")), f"WITH {SQL_MESH} SELECT vertex, round((x - 1) / 2, 6) AS x, round(y / 4, 6) AS y, round((z - 3) / -0.5, 6) AS z FROM verts")


def _upper(m):
    return mesh.Mesh(m.vertices.select("vertex", "x", "y", (F.col("z") + 1 + F.col("x") * 0.1).alias("z")), m.faces, m.flip)


_UP = "up AS (SELECT vertex, x, y, z + 1 + x * 0.1 AS z FROM verts), lay AS (SELECT t.*, ua.x uax, ua.y uay, ua.z uaz, ub.x ubx, ub.y uby, ub.z ubz, uc.x ucx, uc.y ucy, uc.z ucz FROM tri t JOIN up ua ON ua.vertex = a JOIN up ub ON ub.vertex = b JOIN up uc ON uc.vertex = c)"


def _det(p, q, r):
    """|det| of three points relative to the first upper corner."""
    n = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz"), "ub": ("ubx", "uby", "ubz"), "uc": ("ucx", "ucy", "ucz")}
    (px, py, pz), (qx, qy, qz), (rx, ry, rz) = ([f"({v}-{o})" for v, o in zip(n[k], ("uax", "uay", "uaz"), strict=True)] for k in (p, q, r))
    return f"abs({px}*({qy}*{rz}-{qz}*{ry})+{py}*({qz}*{rx}-{qx}*{rz})+{pz}*({qx}*{ry}-{qy}*{rx}))/6"


_WEDGE = f"wed AS (SELECT face, a, b, c, {_det('a', 'b', 'c')} + {_det('ub', 'uc', 'b')} + {_det('uc', 'b', 'c')} AS volume FROM lay)"
register("layer_wedges", on_mesh(lambda m: rounded(mesh.layer_wedges(m, _upper(m)).select("face", "volume"), "volume")), f"WITH {SQL_MESH}, {_UP}, {_WEDGE} SELECT face, round(volume, 6) AS volume FROM wed")
register("layer_vertex_wedges", on_mesh(lambda m: rounded(mesh.layer_vertex_wedges(m, _upper(m)), "volume")), f"WITH {SQL_MESH}, {_UP}, {_WEDGE} SELECT vertex, round(sum(volume)/3, 6) AS volume FROM inc JOIN wed USING (face) GROUP BY 1")
register("cortex_volume", on_mesh(lambda m: rounded(mesh.layer_wedges(m, _upper(m)).agg(F.sum("volume").alias("volume")), "volume", places=4)), f"WITH {SQL_MESH}, {_UP}, {_WEDGE} SELECT round(sum(volume), 4) AS volume FROM wed")


def _bias(spark, d):
    m = lattice(spark, d)
    curvature = points(spark, d).select("vertex", F.col("embedding")[2].cast("double").alias("curvature"), (F.col("label") != 3).alias("use"))
    return rounded(mesh.gyral_bias(m, _upper(m), curvature, 0.05), "bias")


register(
    "gyral_bias",
    _bias,
    f"WITH {SQL_MESH}, {_UP}, {_WEDGE}, vw AS (SELECT vertex, sum(volume)/3 AS v FROM inc JOIN wed USING (face) GROUP BY 1), "
    "usz AS (SELECT face, sqrt(power((uby-uay)*(ucz-uaz)-(ubz-uaz)*(ucy-uay),2)+power((ubz-uaz)*(ucx-uax)-(ubx-uax)*(ucz-uaz),2)+power((ubx-uax)*(ucy-uay)-(uby-uay)*(ucx-uax),2))/2 AS s FROM lay), "
    "vs AS (SELECT vertex, sum(s)/3 AS s FROM inc JOIN usz USING (face) GROUP BY 1), "
    "r AS (SELECT vertex, v / s AS ratio, CAST(embedding[3] AS DOUBLE) AS curvature, label <> 3 AS use FROM vw JOIN vs USING (vertex) JOIN embeddings ON vec_id = vertex) "
    "SELECT vertex, round(CASE WHEN use THEN ratio / (SELECT avg(ratio) FROM r WHERE use AND abs(curvature) < 0.05) END, 6) AS bias FROM r",
)
register(
    "mesh_smooth_step",
    on_mesh(lambda m: rounded(mesh.smooth_step(m, 0.5).vertices, "x", "y", "z")),
    f"WITH {SQL_MESH}, nb AS (SELECT src AS vertex, avg(x) x, avg(y) y, avg(z) z FROM edges JOIN verts ON vertex = dst GROUP BY 1) SELECT v.vertex, round(coalesce((nb.x + v.x)/2, v.x), 6) AS x, round(coalesce((nb.y + v.y)/2, v.y), 6) AS y, round(coalesce((nb.z + v.z)/2, v.z), 6) AS z FROM verts v LEFT JOIN nb USING (vertex)",
)


def _smooth_sql(steps: list[float]) -> str:
    """Smoothing steps, one after another, as common table expressions s1, s2, ..."""
    out, before = [], "verts"
    for n, k in enumerate(steps, 1):
        out.append(f"n{n} AS (SELECT src AS vertex, avg(x) x, avg(y) y, avg(z) z FROM edges JOIN {before} ON vertex = dst GROUP BY 1), s{n} AS (SELECT v.vertex, " + ", ".join(f"coalesce({k} * n.{c} + (1 - {k}) * v.{c}, v.{c}) AS {c}" for c in "xyz") + f" FROM {before} v LEFT JOIN n{n} n USING (vertex))")
        before = f"s{n}"
    return ", ".join(out)


register("mesh_smooth", on_mesh(lambda m: rounded(mesh.smooth(m, 2, 0.5, expand=-0.4, settle=graph.settle).vertices, "x", "y", "z")), f"WITH {SQL_MESH}, {_smooth_sql([0.5, -0.4, 0.5, -0.4])} SELECT vertex, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s4 WHERE vertex IN (SELECT vertex FROM inc)")


def _adaptive_sql(steps: int, step: float) -> str:
    """Smoothing steps, each followed by one that undoes its shrinking by how much normals vary around a vertex."""
    out, before = [], "verts"
    for n in range(1, steps + 1):
        out.append(_smooth_sql([step]).replace("n1 ", f"na{n} ").replace("s1 ", f"sa{n} ").replace("FROM verts v", f"FROM {before} v").replace("JOIN verts ON", f"JOIN {before} ON"))
        now = f"sa{n}"
        out.append(
            f"tr{n} AS (SELECT face, (q.y-p.y)*(r.z-p.z)-(q.z-p.z)*(r.y-p.y) nx, (q.z-p.z)*(r.x-p.x)-(q.x-p.x)*(r.z-p.z) ny, (q.x-p.x)*(r.y-p.y)-(q.y-p.y)*(r.x-p.x) nz FROM faces JOIN {now} p ON p.vertex = a JOIN {now} q ON q.vertex = b JOIN {now} r ON r.vertex = c), "
            f"fu{n} AS (SELECT face, nx/sqrt(nx*nx+ny*ny+nz*nz) nx, ny/sqrt(nx*nx+ny*ny+nz*nz) ny, nz/sqrt(nx*nx+ny*ny+nz*nz) nz FROM tr{n}), "
            f"vs{n} AS (SELECT vertex, sum(nx) sx, sum(ny) sy, sum(nz) sz FROM inc JOIN fu{n} USING (face) GROUP BY 1), "
            f"qs{n} AS (SELECT vertex, -{step} / (2 * {step} * avg(1 - power((nx*sx+ny*sy+nz*sz)/sqrt(sx*sx+sy*sy+sz*sz), 2)) + 1) AS k FROM inc JOIN fu{n} USING (face) JOIN vs{n} USING (vertex) GROUP BY 1), "
            f"nb{n} AS (SELECT src AS vertex, avg(x) x, avg(y) y, avg(z) z FROM edges JOIN {now} ON vertex = dst GROUP BY 1), "
            f"sb{n} AS (SELECT v.vertex, " + ", ".join(f"coalesce(k * n.{c} + (1 - k) * v.{c}, v.{c}) AS {c}" for c in "xyz") + f" FROM {now} v LEFT JOIN nb{n} n USING (vertex) LEFT JOIN qs{n} USING (vertex))"
        )
        before = f"sb{n}"
    return ", ".join(out)


register("mesh_smooth_adaptive", on_mesh(lambda m: rounded(mesh.smooth(m, 2, 0.5, settle=graph.settle).vertices, "x", "y", "z")), f"WITH {SQL_MESH}, {_adaptive_sql(2, 0.5)} SELECT vertex, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sb2 WHERE vertex IN (SELECT vertex FROM inc)")
register("mesh_inflate", on_mesh(lambda m: rounded(mesh.inflate(m, shift=0.5).vertices, "x", "y", "z")), f"WITH {SQL_MESH}, {_VN} SELECT v.vertex, round(x + coalesce(0.5*sx/sqrt(sx*sx+sy*sy+sz*sz), 0), 6) AS x, round(y + coalesce(0.5*sy/sqrt(sx*sx+sy*sy+sz*sz), 0), 6) AS y, round(z + coalesce(0.5*sz/sqrt(sx*sx+sy*sy+sz*sz), 0), 6) AS z FROM verts v LEFT JOIN vn USING (vertex)")
register("mesh_plane_crossings", on_mesh(lambda m: rounded(mesh.plane_crossings(m, (0.0, 3.5, 0.0), (0.0, 1.0, 0.0)), "x", "y", "z")), f"WITH {SQL_MESH}, de AS (SELECT face, least(i.vertex, j.vertex) u, greatest(i.vertex, j.vertex) v FROM inc i JOIN inc j USING (face) WHERE i.vertex < j.vertex) SELECT face, u, v, round(p.x+(q.x-p.x)*(p.y-3.5)/((p.y-3.5)-(q.y-3.5)), 6) AS x, round(p.y+(q.y-p.y)*(p.y-3.5)/((p.y-3.5)-(q.y-3.5)), 6) AS y, round(p.z+(q.z-p.z)*(p.y-3.5)/((p.y-3.5)-(q.y-3.5)), 6) AS z FROM de JOIN verts p ON p.vertex = u JOIN verts q ON q.vertex = v WHERE (p.y < 3.5) <> (q.y < 3.5)")


def _rays(spark):
    return spark.createDataFrame([(i, 2.3 + i, 1.7 + i, 9.0, 0.01, 0.02, -1.0) for i in range(10)], "ray int, o_x double, o_y double, o_z double, d_x double, d_y double, d_z double")


_MT = "SELECT ray, face, az, dx, dy, dz, ox-ax sx, oy-ay sy, oz-az sz, bx-ax e1x, by_-ay e1y, bz-az e1z, cx-ax e2x, cy-ay e2y, cz-az e2z FROM tri, ray"
register(
    "mesh_line_intersections",
    lambda s, d: rounded(mesh.line_intersections(lattice(s, d), _rays(s)), "t"),
    f"""WITH {SQL_MESH}, ray AS (SELECT CAST(i AS INTEGER) AS ray, 2.3+i ox, 1.7+i oy, 9.0 oz, 0.01 dx, 0.02 dy, -1.0 dz FROM range(10) r(i)),
r0 AS ({_MT}),
r1 AS (SELECT *, dy*e2z-dz*e2y hx, dz*e2x-dx*e2z hy, dx*e2y-dy*e2x hz, sy*e1z-sz*e1y qx, sz*e1x-sx*e1z qy, sx*e1y-sy*e1x qz FROM r0),
r2 AS (SELECT *, e1x*hx+e1y*hy+e1z*hz AS det FROM r1),
r3 AS (SELECT ray, face, (sx*hx+sy*hy+sz*hz)/det u, (dx*qx+dy*qy+dz*qz)/det v, (e2x*qx+e2y*qy+e2z*qz)/det t FROM r2 WHERE abs(det) > 1e-12)
SELECT ray, face, round(CAST(t AS DOUBLE), 6) AS t FROM r3 WHERE u >= -1e-5 AND v >= -1e-5 AND u + v <= 1 + 2e-5""",
)

# graphs
_EW = "ew AS (SELECT src, dst, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS w FROM edges JOIN verts p ON p.vertex = src JOIN verts q ON q.vertex = dst)"


def _roi(spark, d):
    m = lattice(spark, d)
    roi = points(spark, d).where("label = 0").select("vertex")
    return m, mesh.edges(m, weight="distance"), roi


def _roi_query(spark, d):
    m, e, roi = _roi(spark, d)
    return rounded(graph.roi_distance(m.vertices, e, roi).select("vertex", "dist"), "dist", places=4)


register(
    "roi_distance",
    _roi_query,
    f"""WITH RECURSIVE {SQL_MESH}, {_EW},
walk(vertex, dist, step) AS (
  SELECT vec_id, CAST(0 AS DOUBLE), 0 FROM embeddings WHERE label = 0
  UNION ALL
  SELECT vertex, dist, step FROM (
    SELECT e.dst AS vertex, min(w.dist + e.w) AS dist, w.step + 1 AS step FROM walk w JOIN ew e ON e.src = w.vertex WHERE w.step < 40 GROUP BY e.dst, w.step)
)
SELECT v.vertex, round(min(dist), 4) AS dist FROM verts v LEFT JOIN walk USING (vertex) GROUP BY 1""",
)


def _project(spark, d):
    m, e, roi = _roi(spark, d)
    near = graph.roi_distance(m.vertices, e, roi)
    return graph.project_nearest(near, points(spark, d).select("vertex", (F.col("vertex") * F.col("vertex")).cast("double").alias("value")))


register(
    "roi_projection",
    _project,
    f"""WITH RECURSIVE {SQL_MESH}, {_EW},
walk(vertex, root, dist, step) AS (
  SELECT vec_id, vec_id, CAST(0 AS DOUBLE), 0 FROM embeddings WHERE label = 0
  UNION ALL
  SELECT vertex, root, dist, step FROM (
    SELECT e.dst AS vertex, w.root, min(w.dist + e.w) AS dist, w.step + 1 AS step FROM walk w JOIN ew e ON e.src = w.vertex WHERE w.step < 40 GROUP BY e.dst, w.root, w.step)
), best AS (SELECT vertex, arg_min(root, (dist, root)) AS root FROM walk GROUP BY 1)
SELECT v.vertex, CAST(root * root AS DOUBLE) AS value FROM verts v LEFT JOIN best USING (vertex)""",
)
register(
    "mesh_components",
    lambda s, d: graph.components(lattice(s, d).vertices, mesh.edges(lattice(s, d)), points(s, d).where("label in (0, 1, 2, 3)").select("vertex")),
    f"""WITH RECURSIVE {SQL_MESH}, m AS (SELECT vec_id AS vertex FROM embeddings WHERE label IN (0, 1, 2, 3)),
e AS (SELECT src, dst FROM edges JOIN m p ON p.vertex = src JOIN m q ON q.vertex = dst),
reach(vertex, component) AS (SELECT vertex, vertex FROM m UNION SELECT e.dst, r.component FROM reach r JOIN e ON e.src = r.vertex)
SELECT vertex, min(component) AS component FROM reach GROUP BY 1""",
)


def _walk_sql(name: str, start: str) -> str:
    """Common table expressions of the distances along edges from one vertex: d<name> (vertex, dist)."""
    return f"""w{name}(vertex, dist, step) AS (
  SELECT vertex, CAST(0 AS DOUBLE), 0 FROM ({start})
  UNION ALL
  SELECT vertex, dist, step FROM (SELECT e.dst AS vertex, min(w.dist + e.w) AS dist, w.step + 1 AS step FROM w{name} w JOIN ew e ON e.src = w.vertex WHERE w.step < 80 GROUP BY e.dst, w.step)
), d{name} AS (SELECT vertex, min(dist) AS dist FROM w{name} GROUP BY 1)"""


register(
    "voronoi_parcels",
    lambda s, d: graph.voronoi_parcels(lattice(s, d).vertices, mesh.edges(lattice(s, d), weight="distance"), 2),
    f"WITH RECURSIVE {SQL_MESH}, {_EW}, {_walk_sql('0', 'SELECT CAST(0 AS BIGINT) AS vertex')}, {_walk_sql('1', 'SELECT arg_max(vertex, (dist, -vertex)) AS vertex FROM d0')} SELECT vertex, CAST(CASE WHEN d0.dist <= d1.dist THEN 0 ELSE 1 END AS INTEGER) AS parcel FROM d0 JOIN d1 USING (vertex)",
)


def _medoids_sql(k: int, loops: int) -> str:
    """Medoid clustering with its loops written out; once labels stay, further loops change nothing."""
    out = [
        "f AS (SELECT vec_id AS v, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "d AS (SELECT a.v AS src, b.v AS dst, list_distance(a.e, b.e) AS d FROM f a, f b)",
        "sh AS (SELECT src, dst, d / sum(d) OVER (PARTITION BY src) AS s FROM d)", f"c0 AS (SELECT dst AS center FROM sh GROUP BY 1 ORDER BY sum(s), dst LIMIT {k})",
    ]
    for n in range(1, loops + 1):
        out.append(f"l{n} AS (SELECT src AS vertex, arg_min(dst, (d, dst)) AS center FROM d JOIN c{n - 1} ON center = dst GROUP BY 1)")
        out.append(f"k{n} AS (SELECT p.center, src AS v, sum(d) AS cost FROM d JOIN l{n} p ON p.vertex = src JOIN l{n} q ON q.vertex = dst AND q.center = p.center GROUP BY 1, 2)")
        out.append(f"c{n} AS (SELECT arg_min(v, (cost, v)) AS center FROM k{n} GROUP BY k{n}.center)")
    return f"WITH {', '.join(out)} SELECT vertex, center FROM l{loops}"


register("kmedoids", lambda s, d: pairs.medoids(features(s, d), 4), _medoids_sql(4, 6))


def _smooth_values(spark, d):
    m = lattice(spark, d)
    return rounded(graph.smooth_values(mesh.edges(m, weight="distance"), scalar(spark, d).withColumnRenamed("f", "value"), 0.5), "value")


register(
    "smooth_values",
    _smooth_values,
    f"""WITH RECURSIVE {SQL_MESH}, {_EW}, sc AS (SELECT vec_id AS vertex, CAST(embedding[2] AS DOUBLE) AS f FROM embeddings),
lp AS (SELECT src, dst, w FROM ew UNION ALL SELECT vertex, vertex, 0.0 FROM verts),
p AS (SELECT greatest(1, CAST(round_even(0.25 / power(median(w) / 6, 2), 0) AS BIGINT)) AS steps FROM lp),
k AS (SELECT src, dst, CASE WHEN src = dst THEN 2.0 ELSE exp(-w * w / (2 * 0.25 / (SELECT steps FROM p))) END AS k FROM lp),
it(step, vertex, value) AS (
  SELECT CAST(0 AS BIGINT), vertex, f FROM sc
  UNION ALL
  SELECT step, vertex, value FROM (SELECT it.step + 1 AS step, k.src AS vertex, sum(k.k * it.value) / sum(k.k) AS value FROM it JOIN k ON k.dst = it.vertex WHERE it.step < (SELECT steps FROM p) GROUP BY it.step, k.src)
)
SELECT vertex, round(value, 6) AS value FROM it WHERE step = (SELECT steps FROM p)""",
)


def _watershed(spark, d):
    m = lattice(spark, d)
    v = m.vertices.join(mesh.vertex_sizes(m), "vertex").join(scalar(spark, d), "vertex").select("vertex", F.col("f").alias("depth"), "size")
    return graph.watershed(v, mesh.edges(m), 0.1, 2.0)


register("watershed", _watershed)


def _sparse_min(spark, d):
    m = lattice(spark, d)
    e = graph.edge_dissimilarity(mesh.edges(m), features(spark, d)).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.round("value", 6).alias("value"))
    return graph.sparse_min(e, "col")


register(
    "sparse_min",
    _sparse_min,
    f"WITH {SQL_MESH}, f AS (SELECT vec_id AS vertex, unnest(generate_series(1, 64)) AS i, unnest(embedding) AS e FROM embeddings), d AS (SELECT src, dst, round(sqrt(sum((CAST(a.e AS DOUBLE)-b.e)*(CAST(a.e AS DOUBLE)-b.e))), 6) AS v FROM edges JOIN f a ON a.vertex = src JOIN f b ON b.vertex = dst AND b.i = a.i GROUP BY 1, 2) SELECT dst AS col, min(v) AS value, arg_min(src, (v, src)) AS row FROM d GROUP BY 1",
)


def _directions(m, scalar_):
    return tracking.flat_directions(m, mesh.face_gradient(m, scalar_))


def _centres(m):
    return m.faces.select(F.col("face").alias("start"), "face", F.lit(1 / 3).alias("u"), F.lit(1 / 3).alias("v"))


def _one_step(spark, d):
    m = lattice(spark, d)
    return rounded(tracking.surface_step(m, _directions(m, scalar(spark, d)), _centres(m)), "u", "v")


_SIDE = "CASE WHEN t1 = t THEN 1 WHEN t2 = t THEN 2 ELSE 3 END"
register(
    "surface_step",
    _one_step,
    f"""WITH {SQL_MESH}, {_GRAD},
di AS (SELECT face, al / sqrt(al*al + be*be) AS du, be / sqrt(al*al + be*be) AS dv FROM gg),
ti AS (SELECT face, du, dv, CASE WHEN abs(dv) >= 1e-8 AND -1/(3*dv) > 1e-8 THEN -1/(3*dv) END t1, CASE WHEN abs(du) >= 1e-8 AND -1/(3*du) > 1e-8 THEN -1/(3*du) END t2, CASE WHEN abs(du+dv) >= 1e-8 AND 1/(3*(du+dv)) > 1e-8 THEN 1/(3*(du+dv)) END t3 FROM di),
st AS (SELECT *, least(t1, t2, t3) AS t FROM ti),
hit AS (SELECT st.face, du, dv, t, {_SIDE} AS side, CASE {_SIDE} WHEN 3 THEN b ELSE a END AS p, CASE {_SIDE} WHEN 1 THEN b ELSE c END AS q FROM st JOIN faces USING (face)),
mv AS (SELECT *, 1.0/3 + du*t AS nu, 1.0/3 + dv*t AS nv FROM hit),
r AS (SELECT *, greatest(0, least(1, CASE WHEN side = 1 THEN nu ELSE nv END)) AS r FROM mv),
nx AS (SELECT r.face, min(o.face) AS next FROM r JOIN faces o ON o.face <> r.face AND r.p IN (o.a, o.b, o.c) AND r.q IN (o.a, o.b, o.c) GROUP BY 1)
SELECT r.face AS start, coalesce(next, r.face) AS face,
       round(CASE WHEN next IS NULL THEN nu WHEN p = o.b THEN 1 - r WHEN q = o.b THEN r ELSE 0 END, 6) AS u,
       round(CASE WHEN next IS NULL THEN nv WHEN p = o.c THEN 1 - r WHEN q = o.c THEN r ELSE 0 END, 6) AS v
FROM r LEFT JOIN nx USING (face) LEFT JOIN faces o ON o.face = next""",
)


def _tracks(spark, d):
    """Where walks uphill from the middle of every face end."""
    m = lattice(spark, d)
    return rounded(tracking.track_to_maximum(m, _directions(m, scalar(spark, d)), _centres(m)), "u", "v", places=4)


register("track_to_maximum", _tracks)
register("ridge_values", lambda s, d: rounded(tracking.from_ridge(lattice(s, d), scalar(s, d), scalar(s, d).withColumnRenamed("f", "value")), "value", places=4))


# curves, clean meshes and sections
def _curve(spark, d):
    return curves.curve(points(spark, d).select("vertex", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")))


_CV = "cv AS (SELECT vec_id AS vertex, CAST(embedding[1] AS DOUBLE) x, CAST(embedding[2] AS DOUBLE) y FROM embeddings), ln AS (SELECT p.vertex AS face, p.x ax, p.y ay, q.x bx, q.y AS b_y FROM cv p JOIN cv q ON q.vertex = p.vertex + 1)"
register("curve_lengths", lambda s, d: rounded(curves.line_lengths(_curve(s, d)), "size"), f"WITH {_CV} SELECT face, round(sqrt((ax-bx)*(ax-bx)+(ay-b_y)*(ay-b_y)), 6) AS size FROM ln")
register("curve_normals", lambda s, d: rounded(curves.line_normals(_curve(s, d)), "n_x", "n_y"), f"WITH {_CV} SELECT face, round((ay-b_y)/sqrt((ax-bx)*(ax-bx)+(ay-b_y)*(ay-b_y)), 6) AS n_x, round((bx-ax)/sqrt((ax-bx)*(ax-bx)+(ay-b_y)*(ay-b_y)), 6) AS n_y FROM ln")
register("curve_closed", lambda s, d: curves.curve_closed(_curve(s, d)), f"WITH {_CV}, e AS (SELECT face AS v FROM ln UNION ALL SELECT face + 1 FROM ln), n AS (SELECT count(*) c FROM e GROUP BY v) SELECT count(*) FILTER (WHERE c = 1) = 0 AS closed FROM n")
register("curve_crossings", lambda s, d: rounded(curves.line_crossings(_curve(s, d), (0.01, 0.02), (1.0, 0.5)), "x", "y"), f"WITH {_CV}, o AS (SELECT *, (ax-0.01)*0.5-(ay-0.02) AS sa, (bx-0.01)*0.5-(b_y-0.02) AS sb FROM ln) SELECT face, round(CAST(ax+sa/(sa-sb)*(bx-ax) AS DOUBLE), 6) AS x, round(CAST(ay+sa/(sa-sb)*(b_y-ay) AS DOUBLE), 6) AS y FROM o WHERE sa * sb < 0")
register("curve_lines", lambda s, d: curves.as_lines(_curve(s, d)), "SELECT min(vec_id) OVER () AS line, row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id AS vertex, false AS closed FROM embeddings")
register(
    "plane_section",
    on_mesh(lambda m: rounded(curves.plane_section(m, (0.0, 3.5, 0.0), (0.0, 1.0, 0.0)).select("place", "u", "v", "x", "y", "z", "closed"), "x", "y", "z")),
    f"WITH {SQL_MESH}, de AS (SELECT DISTINCT least(i.vertex, j.vertex) u, greatest(i.vertex, j.vertex) v FROM inc i JOIN inc j USING (face) WHERE i.vertex < j.vertex), c AS (SELECT u, v, p.x+(q.x-p.x)/2 AS x, 3.5::DOUBLE AS y, p.z+(q.z-p.z)/2 AS z FROM de JOIN verts p ON p.vertex = u JOIN verts q ON q.vertex = v WHERE (p.y < 3.5) <> (q.y < 3.5)) SELECT row_number() OVER (ORDER BY x) - 1 AS place, u, v, round(x, 6) AS x, y, round(z, 6) AS z, false AS closed FROM c",
)


def _soup(m):
    """Every face with corners of its own."""
    c = mesh.corners(m)
    rows = c.select("face", F.explode(F.array(*[F.struct((F.col("face") * 3 + n).alias("vertex"), *[F.col(f"{k}_{x}").alias(x) for x in "xyz"]) for n, k in enumerate("abc")])).alias("p")).select("p.*")
    return mesh.Mesh(rows, m.faces.select("face", *[(F.col("face") * 3 + n).alias(k) for n, k in enumerate("abc")]))


register("mesh_clean", on_mesh(lambda m: curves.clean(_soup(m)).faces), f"WITH {SQL_MESH}, o AS (SELECT face, a, b, c FROM faces), own AS (SELECT face * 3 AS k, a AS v FROM o UNION ALL SELECT face * 3 + 1, b FROM o UNION ALL SELECT face * 3 + 2, c FROM o), kept AS (SELECT v, min(k) AS k FROM own GROUP BY 1) SELECT face, x.k AS a, y.k AS b, z.k AS c FROM o JOIN kept x ON x.v = a JOIN kept y ON y.v = b JOIN kept z ON z.v = c")


def _mask_surface(spark, d):
    hull = curves.mask_surface(spatial.voxel_triangles(lattice(spark, d)))
    hull = mesh.Mesh(graph.settle(hull.vertices), graph.settle(hull.faces))
    return mesh.volume(hull).join(mesh.closed(hull)).join(hull.faces.agg(F.count(F.lit(1)).alias("faces"))).select(F.round("volume", 4).alias("volume"), "closed", "faces")  # one row each


register("mask_surface", _mask_surface, f"WITH {SQL_MESH}, {SQL_VOXELS}, b AS (SELECT DISTINCT i, j, k FROM hit), s AS (SELECT i + di AS i, j + dj AS j, k + dk AS k FROM b, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(di, dj, dk)), e AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.i = s.i AND b.j = s.j AND b.k = s.k)) SELECT round(CAST((SELECT count(*) FROM b) AS DOUBLE), 4) AS volume, true AS closed, 2 * (SELECT count(*) FROM e) AS faces")


def _partial_gradient(spark, d):
    """On a part of a surface, over the features of other structures alone."""
    m, p = lattice(spark, d), points(spark, d)
    values = p.where("label <> 2").select("vertex", F.posexplode("embedding").alias("feature", "value"))
    sides = F.when(F.col("feature") % 2 == 0, "CORTEX_LEFT").otherwise("CORTEX_RIGHT")
    return rounded(graph.partial_gradient(m, values.withColumn("feature_structure", sides), "CORTEX_LEFT", exclude_same_region=True), "value")


register(
    "gradient_partial",
    _partial_gradient,
    f"WITH {SQL_MESH}, f AS (SELECT vec_id AS vertex, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE label <> 2), inner_faces AS (SELECT * FROM inc WHERE face NOT IN (SELECT face FROM inc JOIN embeddings ON vec_id = vertex WHERE label = 2)), e AS (SELECT DISTINCT i.vertex AS src, j.vertex AS dst FROM inner_faces i JOIN inner_faces j USING (face) WHERE i.vertex <> j.vertex), "
    "d AS (SELECT src, dst, sqrt(sum((a.x-b.x)*(a.x-b.x))) AS v FROM e JOIN f a ON a.vertex = src JOIN f b ON b.vertex = dst AND b.i = a.i WHERE a.i % 2 = 1 GROUP BY 1, 2) SELECT v.vec_id AS vertex, round(median(d.v), 6) AS value FROM embeddings v LEFT JOIN d ON src = v.vec_id WHERE label <> 2 GROUP BY 1",
)
