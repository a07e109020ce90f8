"""Spatial joins through a grid of cells: nearest vertices and segments, voxels and triangles, rays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.operators import mesh as ms
from meshlake.operators.graph import settle, unsettle


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


#: Points, and rows around them, that meet at once at most, and such meetings that travel to Python at once.
POINTS, ROWS, MEETINGS = 4096, 2048, 100


def paired(points: DataFrame, rows: DataFrame, size: float, work: Callable[[dict, dict], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``work`` gives for the ``points`` (point, x, y, z, …) of each cell and the ``rows`` (ci, cj, ck, order, …) of that cell and those around it.

    Both reach it as arrays by column, points in chunks of POINTS and rows in chunks of
    ROWS, in their ``order``; missing numbers are NaN. No side is broadcast, and a point
    is not repeated for the cells around it. The result is written down.
    """
    cells = ["ci", "cj", "ck"]
    filled = lambda df, names: [F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) if df.schema[c].dataType.simpleString() == "double" else F.col(c) for c in names]
    lists = lambda names, mark: [F.collect_list(c).alias(f"{mark}_{c}") for c in names]
    chunk = lambda by, order, n: F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / n)
    mine, theirs = points.columns, [c for c in rows.columns if c not in cells]
    placed = points.where("x is not null and y is not null and z is not null").select(*filled(points, mine), *[cell(c, size).alias(n) for c, n in zip("xyz", cells, strict=True)])
    groups = settle(placed.withColumn("chunk", chunk(cells, "point", POINTS)).groupBy(*cells, "chunk").agg(*lists(mine, "p")))
    around = groups.select(*cells, "chunk")
    for c in cells:
        around = around.withColumn("o", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"n{c}", F.col(c) + F.col("o")).drop("o")
    near = around.join(rows.select(*[F.col(c).alias(f"n{c}") for c in cells], *filled(rows, theirs)).hint("merge"), [f"n{c}" for c in cells])
    near = near.withColumn("part", chunk([*cells, "chunk"], "order", ROWS)).groupBy(*cells, "chunk", "part").agg(*lists(theirs, "r"))
    both = near.join(groups.hint("merge"), [*cells, "chunk"]).select(*[f"p_{c}" for c in mine], *[f"r_{c}" for c in theirs])

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                yield from work({c: np.asarray(row[f"p_{c}"]) for c in mine}, {c: np.asarray(row[f"r_{c}"]) for c in theirs})

    conf, name = points.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, MEETINGS)
    try:
        return settle(both.mapInPandas(run, schema))
    finally:
        conf.set(name, before)
        unsettle(groups)


def tiles(p: dict, n: int, most: int = 1_000_000) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Points by runs that meet ``n`` rows in ``most`` pairs at most: (run, columns of x, y, z)."""
    step = max(1, most // max(n, 1))
    for lo in range(0, len(p["x"]), step):
        at = slice(lo, lo + step)
        yield at, [p[c][at, None] for c in "xyz"]


def kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def vertex_cells(vertices: DataFrame, size: float) -> DataFrame:
    """Vertices as rows for ``paired``."""
    return vertices.select(*vertices.columns, F.col("vertex").alias("order"), *[cell(c, size).alias(n) for c, n in zip("xyz", ("ci", "cj", "ck"), strict=True)])


def least(points: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """Points with the least (value, vertex) that was found for each, m; null without one."""
    best = found.groupBy("point").agg(F.min(F.struct(value, "vertex")).alias("m"))
    return points.select("point").join(best.hint("merge"), "point", "left")


def nearest_vertex(points: DataFrame, vertices: DataFrame, max_dist: float, cell_size: float | None = None, facing: int = 0) -> DataFrame:
    """(point, vertex, dist) of the nearest vertex within ``max_dist`` (strictly); null beyond. Ties take the lowest vertex.

    ``facing`` 1 or -1 takes only vertices (with n_x, n_y, n_z) whose normal points along
    or against the way from the point to them.

    Both sides meet by cells of ``max_dist``, or of ``cell_size`` if that is larger.
    """
    size, normals = float(max(cell_size or max_dist, max_dist)), [f"n_{c}" for c in "xyz"] if facing else []

    def work(p, v):
        for at, o in tiles(p, len(v["x"])):
            d2 = sum((o[n] - v[c]) ** 2 for n, c in enumerate("xyz"))
            out = ~(d2 < max_dist * max_dist)
            if facing:
                out |= ~(sum((v[c] - o[n]) * v[f"n_{c}"] for n, c in enumerate("xyz")) * facing > 0)
            d2[out] = np.inf
            # rows come by vertex, so that the first least is the lowest
            best = d2.argmin(1)
            d2 = d2[np.arange(len(best)), best]
            hit = np.isfinite(d2)
            yield pd.DataFrame({"point": p["point"][at][hit], "d2": d2[hit], "vertex": v["vertex"][best[hit]]})

    found = paired(points.select("point", *"xyz"), vertex_cells(vertices.select("vertex", *"xyz", *normals), size), size, work, f"point {kind(points, 'point')}, d2 double, vertex {kind(vertices, 'vertex')}")
    return least(points, found, "d2").select("point", F.col("m.vertex").alias("vertex"), F.sqrt("m.d2").alias("dist"))


def nearest_any(points: DataFrame, vertices: DataFrame, start: float, rounds: int = 32) -> DataFrame:
    """(point, vertex, dist) at any distance: the reach doubles for the points that found nothing."""
    left, found, reach = points, None, start
    for _ in range(rounds):
        got = settle(nearest_vertex(left, vertices, reach))
        hit = got.where("vertex is not null")
        found = hit if found is None else found.unionByName(hit)
        left = settle(left.join(got.where("vertex is null").hint("merge"), "point", "left_semi"))
        if left.isEmpty():
            break
        reach *= 2
    return found


def nearest_segment(points: DataFrame, lower: DataFrame, upper: DataFrame, max_dist: float, cell_size: float = 1.0) -> DataFrame:
    """(point, vertex, dist) of the nearest segment from a lower to an upper vertex of one number, within ``max_dist``."""
    size = float(max(cell_size, max_dist))
    rows = lower.select("vertex", *[F.col(c).alias(f"s_{c}") for c in "xyz"]).join(upper.select("vertex", *[F.col(c).alias(f"e_{c}") for c in "xyz"]).hint("merge"), "vertex").withColumn("order", F.col("vertex"))
    for c, name in zip("xyz", ("ci", "cj", "ck"), strict=True):
        rows = rows.withColumn(name, F.explode(F.sequence(cell(F.least(f"s_{c}", f"e_{c}"), size), cell(F.greatest(f"s_{c}", f"e_{c}"), size))))

    def work(p, s):
        way = [s[f"e_{c}"] - s[f"s_{c}"] for c in "xyz"]
        long = way[0] * way[0] + way[1] * way[1] + way[2] * way[2]
        for at, o in tiles(p, len(long)):
            along = way[0] * (o[0] - s["s_x"]) + way[1] * (o[1] - s["s_y"]) + way[2] * (o[2] - s["s_z"])
            t = np.clip(np.divide(along, long, out=np.zeros_like(along), where=np.broadcast_to(long > 0, along.shape)), 0.0, 1.0)
            d = [o[n] - (s[f"s_{c}"] + way[n] * t) for n, c in enumerate("xyz")]
            d = np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            d[~(d <= max_dist)] = np.inf
            best = d.argmin(1)
            d = d[np.arange(len(best)), best]
            hit = np.isfinite(d)
            yield pd.DataFrame({"point": p["point"][at][hit], "d": d[hit], "vertex": s["vertex"][best[hit]]})

    found = paired(points.select("point", *"xyz"), rows, size, work, f"point {kind(points, 'point')}, d double, vertex {kind(lower, 'vertex')}")
    return least(points, found, "d").select("point", F.col("m.vertex").alias("vertex"), F.col("m.d").alias("dist"))


def bounding(mesh: ms.Mesh, resolution: float = 1.0) -> DataFrame:
    """One row: lower corner and number of voxels along each axis of the mesh's bounding box."""
    return mesh.vertices.agg(*[F.min(c).alias(f"low_{c}") for c in "xyz"], *[F.greatest(F.lit(1), F.ceil((F.max(c) - F.min(c)) / resolution)).alias(f"n_{c}") for c in "xyz"])


def _separated(corners: list[g.Vec], normal: g.Vec) -> Column:
    """Whether an axis separates the unit cube around the origin from a triangle."""
    out = None
    edges = [g.sub(corners[1], corners[0]), g.sub(corners[2], corners[1]), g.sub(corners[0], corners[2])]
    for e in edges:
        for axis in range(3):
            d1, d2 = (k for k in range(3) if k != axis)
            across = [p[d1] * e[d2] - p[d2] * e[d1] for p in corners]
            radius = (F.abs(e[d1]) + F.abs(e[d2])) / 2
            apart = (F.least(*across) > radius) | (F.greatest(*across) < -radius)
            out = apart if out is None else out | apart
    plane = F.abs(g.dot(normal, corners[0])) > (F.abs(normal[0]) + F.abs(normal[1]) + F.abs(normal[2])) / 2
    return out | plane


def voxel_triangles(mesh: ms.Mesh, resolution: float = 1.0) -> DataFrame:
    """(i, j, k, face): the voxels of a size, centred on whole multiples of it, that each triangle meets.

    Candidates are the voxels of a triangle's bounding box; nine edge axes and the
    normal separate the others.
    """
    if resolution != 1.0:
        mesh = ms.Mesh(mesh.vertices.select("vertex", *[(F.col(c) / float(resolution)).alias(c) for c in "xyz"]), mesh.faces, mesh.flip)
    rows = ms.corners(mesh)
    for c, name in zip("xyz", "ijk", strict=True):
        low, high = F.least(f"a_{c}", f"b_{c}", f"c_{c}"), F.greatest(f"a_{c}", f"b_{c}", f"c_{c}")
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor(low + 0.5), F.greatest(F.floor(low + 0.5), F.ceil(high - 0.5)))))
    shifted = [g.sub(g.vec(k), tuple(F.col(n).cast("double") for n in "ijk")) for k in "abc"]
    normal = g.cross(g.sub(shifted[1], shifted[0]), g.sub(shifted[2], shifted[0]))
    return rows.where(~_separated(shifted, normal)).select("i", "j", "k", "face")


def hits_per_voxel(index: DataFrame) -> DataFrame:
    return index.groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("nhit"))


def ray_voxels(o: np.ndarray, d: np.ndarray, max_dist: float) -> np.ndarray:
    """(rays, steps, 3): the voxels that rays (origins, directions) pass: one for each stretch between crossings of voxel borders."""
    ends, cuts = o + d * max_dist, [np.zeros((len(o), 1)), np.full((len(o), 1), max_dist)]
    for n in range(3):
        first = np.floor(np.minimum(o[:, n], ends[:, n]) + 0.5)
        borders = first[:, None] + np.arange(int(max_dist * np.abs(d[:, n]).max(initial=0)) + 3) - 0.5
        moves = np.abs(d[:, n]) * max_dist > 1e-12
        t = (borders - o[:, n, None]) / np.where(moves, d[:, n], 1.0)[:, None]
        cuts.append(np.where(moves[:, None] & (t >= 0) & (t <= max_dist), t, max_dist))
    ts = np.sort(np.hstack(cuts), axis=1)
    at = o[:, None] + ((ts[:, :-1] + ts[:, 1:]) / 2)[..., None] * d[:, None]
    return np.copysign(np.floor(np.abs(at) + 0.5), at).astype(np.int64)


def _first(o: np.ndarray, d: np.ndarray, tri: dict, max_dist: float, facing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ray, t, face) of the first of some triangles, given by the voxels (i, j, k) they meet, that each ray meets."""
    low = [tri[c].min() for c in "ijk"]
    span = [tri[c].max() - x + 1 for c, x in zip("ijk", low, strict=True)]
    number = lambda v: ((v[0] - low[0]) * span[1] + v[1] - low[1]) * span[2] + v[2] - low[2]
    key = number([tri[c] for c in "ijk"])
    order = np.argsort(key, kind="stable")
    key = key[order]
    passed = np.moveaxis(ray_voxels(o, d, max_dist), 2, 0)
    held = np.all([(v >= x) & (v < x + n) for v, x, n in zip(passed, low, span, strict=True)], axis=0)
    ray = np.nonzero(held)[0]
    want = number([v[held] for v in passed])
    start = np.searchsorted(key, want, "left")
    count = np.searchsorted(key, want, "right") - start
    row = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - start, count)]
    ray = np.repeat(ray, count)
    a, b, c = (np.vstack([tri[f"{k}_{x}"][row] for x in "xyz"]) for k in "abc")
    way, cross = d[ray].T, lambda u, v: np.vstack([u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]])
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    e1, e2, s = b - a, c - a, o[ray].T - a
    h, q = cross(way, e2), cross(s, e1)
    det = dot(e1, h)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v, t = dot(s, h) / det, dot(way, q) / det, dot(e2, q) / det
    hit = (np.abs(det) > 1e-12) & (u >= -1e-5) & (v >= -1e-5) & (u + v <= 1 + 2e-5) & (t >= 0) & (t <= max_dist)
    if facing:
        hit &= dot(cross(e1, e2), way) * facing > 0
    ray, t, face = ray[hit], t[hit], tri["face"][row[hit]]
    order = np.lexsort((face, t, ray))
    order = order[np.diff(ray[order], prepend=-1) != 0]
    return ray[order], t[order], face[order]


def first_hits(origins: DataFrame, mesh: ms.Mesh, max_dist: float, facing: int = 0, ways: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(point, way, t, face): the first triangle within ``max_dist`` on the ray from each of ``origins`` (point, x, y, z, d_x, d_y, d_z).

    With ``ways`` rays leave each origin in all those directions, numbered by ``way``
    (else 0). Origins meet the triangles of the voxels around them by cells.
    """
    size = float(max_dist) + 1
    rows = voxel_triangles(mesh).join(ms.corners(mesh).hint("merge"), "face")
    rows = rows.select("face", F.col("face").alias("order"), *"ijk", *[f"{k}_{c}" for k in "abc" for c in "xyz"], *[cell(c, size).alias(n) for c, n in zip("ijk", ("ci", "cj", "ck"), strict=True)])
    turn = -facing if mesh.flip else facing

    def work(p, tri):
        n = len(ways) if ways else 1
        step = max(1, 1_000_000 // max(len(tri["face"]), 3 * int(max_dist + 3)) // n)
        for lo in range(0, len(p["x"]), step):
            at = slice(lo, lo + step)
            o = np.repeat(np.vstack([p[c][at] for c in "xyz"]).T, n, axis=0)
            d = np.tile(np.array(ways, float), (len(o) // n, 1)) if ways else np.vstack([p[f"d_{c}"][at] for c in "xyz"]).T
            ray, t, face = _first(o, d, tri, float(max_dist), turn)
            yield pd.DataFrame({"point": p["point"][at][ray // n], "way": ray % n, "t": t, "face": face})

    found = paired(origins, rows, size, work, f"point {kind(origins, 'point')}, way int, t double, face {kind(mesh.faces, 'face')}")
    return found.groupBy("point", "way").agg(F.min(F.struct("t", "face")).alias("m")).select("point", "way", "m.*")


def ray_hits(rays: DataFrame, mesh: ms.Mesh, max_dist: float, facing: int = 0) -> DataFrame:
    """(ray, face, t, x, y, z): the first triangle on each ray (unit directions) within ``max_dist``.

    ``facing`` 1 or -1 takes only triangles whose normal points along or against it.
    Rays and triangles meet in voxels, so neither side is broadcast.
    """
    whole = rays.where("d_x is not null and d_y is not null and d_z is not null")
    origins = whole.select(F.col("ray").alias("point"), *[F.col(f"o_{c}").alias(c) for c in "xyz"], *[f"d_{c}" for c in "xyz"])
    best = first_hits(origins, mesh, max_dist, facing).select(F.col("point").alias("ray"), "face", "t")
    out = rays.join(best.hint("merge"), "ray", "left")
    return out.select("ray", "face", "t", *[(F.col(f"o_{c}") + F.col("t") * F.col(f"d_{c}")).alias(c) for c in "xyz"])


def inside(points: DataFrame, mesh: ms.Mesh) -> DataFrame:
    """(point, inside): whether a line upwards meets the mesh an odd number of times.

    Points and triangles meet by the columns of unit cells in the plane.
    """
    tri = ms.corners(mesh)
    for c, name in zip("xy", ("ci", "cj"), strict=True):
        low, high = F.least(f"a_{c}", f"b_{c}", f"c_{c}"), F.greatest(f"a_{c}", f"b_{c}", f"c_{c}")
        tri = tri.withColumn(name, F.explode(F.sequence(F.floor(low), F.floor(high))))
    # a slight tilt keeps lines off edges shared by two triangles
    p = points.select("point", F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.col("z").alias("o_z"), F.floor("x").alias("ci"), F.floor("y").alias("cj"))
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    o = (F.col("o_x") + 1.3e-7, F.col("o_y") + 2.9e-7, F.col("o_z"))
    e1, e2 = g.sub(g.vec("b"), g.vec("a")), g.sub(g.vec("c"), g.vec("a"))
    h = g.cross(up, e2)
    det, s = g.dot(e1, h), g.sub(o, g.vec("a"))
    q = g.cross(s, e1)
    u, v, t = (F.try_divide(x, det) for x in (g.dot(s, h), g.dot(up, q), g.dot(e2, q)))
    met = p.join(tri, ["ci", "cj"]).where((u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0)).groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    return points.select("point").join(met, "point", "left").select("point", (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def point_triangle_distance(p: g.Vec, a: g.Vec, b: g.Vec, c: g.Vec) -> Column:
    """Distance of a point from a triangle: to its plane where the foot lies within, else to the nearest edge."""
    n = g.cross(g.sub(b, a), g.sub(c, a))
    side = lambda x, y: g.dot(g.cross(g.sub(y, x), g.sub(p, x)), n) >= 0
    within = side(a, b) & side(b, c) & side(c, a) & (g.norm(n) > 0)
    border = F.least(g.point_segment(p, a, b), g.point_segment(p, b, c), g.point_segment(p, c, a))
    return F.when(within, F.abs(F.try_divide(g.dot(n, g.sub(p, a)), g.norm(n)))).otherwise(border)


def signed_distance(points: DataFrame, mesh: ms.Mesh, max_dist: float, cell_size: float = 1.0) -> DataFrame:
    """(point, dist): distance from the mesh, negative inside; null beyond ``max_dist``."""
    tri = ms.corners(mesh)
    for c, name in zip("xyz", ("ci", "cj", "ck"), strict=True):
        low, high = F.least(f"a_{c}", f"b_{c}", f"c_{c}") - max_dist, F.greatest(f"a_{c}", f"b_{c}", f"c_{c}") + max_dist
        tri = tri.withColumn(name, F.explode(F.sequence(cell(low, cell_size), cell(high, cell_size))))
    p = points.select("point", *[F.col(c).alias(f"p_{c}") for c in "xyz"], *[cell(c, cell_size).alias(n) for c, n in zip("xyz", ("ci", "cj", "ck"), strict=True)])
    d = point_triangle_distance(g.vec("p"), *map(g.vec, "abc"))
    best = p.join(tri, ["ci", "cj", "ck"]).groupBy("point").agg(F.min(d).alias("d")).where(F.col("d") <= max_dist)
    return inside(points, mesh).join(best, "point", "left").select("point", F.when(F.col("inside"), -F.col("d")).otherwise(F.col("d")).alias("dist"))


def enclosing_surfaces(points: DataFrame, meshes: list[ms.Mesh]) -> DataFrame:
    """(point, n): how many of the surfaces enclose each point."""
    out = points.select("point", F.lit(0).alias("n"))
    for m in meshes:
        out = out.join(inside(points, m), "point").select("point", (F.col("n") + F.col("inside").cast("int")).alias("n"))
    return out


def voxel_edge_crossings(mesh: ms.Mesh) -> DataFrame:
    """(i, j, k, dim): voxel edges, from a voxel centre to the next along an axis, that cross the mesh."""
    index, found = voxel_triangles(mesh), None
    tri = ms.corners(mesh)
    for n, c in enumerate("xyz"):
        d = tuple(F.lit(1.0 if n == m else 0.0) for m in range(3))
        o = tuple(F.col(k).cast("double") for k in "ijk")
        hit, t = g.line_triangle(o, d, *map(g.vec, "abc"), one_sided=True)
        here = index.join(tri, "face").where(hit & (t <= 1)).select("i", "j", "k", F.lit(n).alias("dim")).distinct()
        found = here if found is None else found.unionByName(here)
    return found


def moments(weight: np.ndarray, v: dict, name: str) -> dict:
    """Sums over rows, for each point, of squared weights (points by rows) times products of a vector's entries; rows without it count nothing."""
    from meshlake.operators.stats import MOMENTS

    n = np.vstack([v[f"{name}_{c}"] for c in "xyz"])
    known = ~np.isnan(n).any(0)
    w2, n = np.where(known, weight * weight, 0.0), np.where(known, n, 0.0)
    return {"any": (w2 > 0).any(1), **{f"{name}{i}{j}": w2 @ (n[i] * n[j]) for i, j in MOMENTS}}


def point_orientation(points: DataFrame, vertices: DataFrame, normals: DataFrame, power: float = -1.0, max_dist: float = 3.0) -> DataFrame:
    """(point, axis, value): the main axis of the vertices' normals around a point, weighted by distance to a power."""
    from meshlake.operators.stats import MOMENTS, main_axis

    size = float(max_dist)
    rows = vertices.select("vertex", *"xyz").join(normals.select("vertex", "n_x", "n_y", "n_z").where("n_x is not null").hint("merge"), "vertex")

    def work(p, v):
        for at, o in tiles(p, len(v["x"])):
            d = np.sqrt(sum((o[n] - v[c]) ** 2 for n, c in enumerate("xyz")))
            near = (d > 0) & (d <= max_dist)
            m = moments(np.where(near, np.where(near, d, 1.0) ** power, 0.0), v, "n")
            hit = m.pop("any")
            yield pd.DataFrame({"point": p["point"][at][hit], **{k: x[hit] for k, x in m.items()}})

    schema = f"point {kind(points, 'point')}, " + ", ".join(f"n{i}{j} double" for i, j in MOMENTS)
    return main_axis(paired(points.select("point", *"xyz"), vertex_cells(rows, size), size, work, schema), ["point"], "n")
