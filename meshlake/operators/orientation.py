"""Radial, sulcal and gyral directions at points between two surfaces: by points, by lines or from the nearest vertex."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.operators import mesh as ms
from meshlake.operators import spatial
from meshlake.operators.stats import MOMENTS, main_axis, principal_axis


def vertex_weights(offset: g.Vec, normal: g.Vec, power: float = -1.0, side: int = 0) -> Column:
    """Distance to a power; 0 for vertices whose normal points along (side 1) or against (side -1) the way from the point."""
    weight = F.pow(g.norm(offset), F.lit(float(power)))
    if not side:
        return weight
    return F.when(g.dot(offset, normal) * side > 0, F.lit(0.0)).otherwise(weight)


def vertex_field(mesh: ms.Mesh, depth: DataFrame) -> DataFrame:
    """(vertex, x, y, z, n_*, g_*): vertices with their normal and the gradient of ``depth`` (vertex, f) around them."""
    return mesh.vertices.join(ms.vertex_normals(mesh), "vertex").join(ms.vertex_gradient(mesh, depth), "vertex")


def average_point(points: DataFrame, white: ms.Mesh, pial: ms.Mesh, depth: DataFrame, max_dist: float, power: float = -1.0, flip: bool = False) -> DataFrame:
    """(point, radial_*, tangential_*): main axes of the vertices' normals and gradients around points.

    Vertices within ``max_dist`` weigh by their distance to a power; those of the outer
    surface only where their normal points away from the point (towards it with
    ``flip``). Points and vertices meet in grid cells, which give sums for each point.
    """
    size, parts = float(max_dist), []
    names = {"n": "radial", "g": "tangential"}
    for mesh, side in ((white, 0), (pial, -1 if flip else 1)):

        def work(p, v, side=side):
            for at, o in spatial.tiles(p, len(v["x"])):
                offset = [v[c] - o[n] for n, c in enumerate("xyz")]
                d = np.sqrt(offset[0] * offset[0] + offset[1] * offset[1] + offset[2] * offset[2])
                near = (d > 0) & (d <= max_dist)
                if side:
                    # side 1 leaves out what points against the way from the point, -1 what points along it
                    near &= ~(sum(x * v[f"n_{c}"] for x, c in zip(offset, "xyz", strict=True)) * -side > 0)
                w = np.where(near, np.where(near, d, 1.0) ** power, 0.0)
                found = {k: spatial.moments(w, v, k) for k in names}
                hit = found["n"]["any"] | found["g"]["any"]
                yield pd.DataFrame({"point": p["point"][at][hit], **{(f"{k}_any" if m == "any" else m): x[hit] for k, f in found.items() for m, x in f.items()}})

        schema = f"point {spatial.kind(points, 'point')}, " + ", ".join(f"{k}_any boolean, " + ", ".join(f"{k}{i}{j} double" for i, j in MOMENTS) for k in names)
        parts.append(spatial.paired(points.select("point", *"xyz"), spatial.vertex_cells(vertex_field(mesh, depth), size), size, work, schema))
    sums = reduce(DataFrame.unionByName, parts)
    axes = [main_axis(sums.where(f"{k}_any"), ["point"], k).select("point", *[F.col(f"axis_{c}").alias(f"{name}_{c}") for c in "xyz"]) for k, name in names.items()]
    return axes[0].join(axes[1].hint("merge"), "point")


def _axes(rows: DataFrame, radial: str, tangential: str, weight: str) -> DataFrame:
    axis = lambda k, name: principal_axis(rows.where(f"{k}_x is not null"), ["point"], (f"{k}_x", f"{k}_y", f"{k}_z"), weight).select("point", *[F.col(f"axis_{c}").alias(f"{name}_{c}") for c in "xyz"])
    return axis(radial, "radial").join(axis(tangential, "tangential").hint("merge"), "point")


def average_line(points: DataFrame, white: ms.Mesh, pial: ms.Mesh, depth: DataFrame, max_dist: float, norient: int = 100, power: float = -1.0) -> DataFrame:
    """(point, radial_*, tangential_*, thickness, place) from straight lines through points that join the surfaces.

    Along ``norient`` even directions the ray one way meets the inner surface and the ray
    the other way the outer one. Normals and gradients of the two faces are interpolated
    by distance and weighted by the line's length to a power. ``thickness`` is the length of the
    shortest line and ``place`` (0 to 0.5) where on it the point is.
    """
    ways = g.fibonacci_sphere(norient)
    if norient > 10_000:
        raise ValueError("at most 10000 directions")
    origins = points.select("point", *"xyz")
    inner = spatial.first_hits(origins, white, max_dist, ways=ways)
    outer = spatial.first_hits(origins, pial, max_dist, ways=[(-x, -y, -z) for x, y, z in ways])
    field = lambda m, k: ms.face_normals(m).join(ms.face_gradient(m, depth), "face").select(F.col("face").alias(f"face_{k}"), *[F.col(f"{a}_{c}").alias(f"{k}{a}_{c}") for a in "ng" for c in "xyz"]).hint("merge")
    hit = lambda h, k: h.select("point", "way", F.col("face").alias(f"face_{k}"), F.col("t").alias(f"t_{k}"))
    both = hit(inner, "w").join(hit(outer, "p").hint("merge"), ["point", "way"]).join(field(white, "w"), "face_w").join(field(pial, "p"), "face_p")
    both = both.withColumn("length", F.col("t_w") + F.col("t_p")).where("length > 0")
    for a in "ng":
        mix = tuple((F.col("t_w") * F.col(f"p{a}_{c}") + F.col("t_p") * F.col(f"w{a}_{c}")) / F.col("length") for c in "xyz")
        for c, m in zip("xyz", g.unit(mix), strict=True):
            both = both.withColumn(f"{a}_{c}", m)
    rows = both.select("point", F.pow("length", F.lit(float(power))).alias("w"), "length", "t_w", "t_p", *[f"{a}_{c}" for a in "ng" for c in "xyz"])
    short = rows.groupBy("point").agg(F.min(F.struct("length", F.least("t_w", "t_p").alias("less"))).alias("m"))
    return _axes(rows, "n", "g", "w").join(short.hint("merge"), "point").select("point", *[f"{k}_{c}" for k in ("radial", "tangential") for c in "xyz"], F.col("m.length").alias("thickness"), (F.col("m.less") / F.col("m.length")).alias("place"))


def closest_vertex(points: DataFrame, white: ms.Mesh, pial: ms.Mesh, depth: DataFrame, max_dist: float) -> DataFrame:
    """(point, radial_*, tangential_*): the normal and gradient at the nearest vertex of whichever surface is nearer."""
    found = []
    for k, m in (("w", white), ("p", pial)):
        near = spatial.nearest_vertex(points, m.vertices, max_dist).select("point", F.col("vertex").alias("at"), F.col("dist").alias(f"dist_{k}"))
        field = vertex_field(m, depth).drop("x", "y", "z")
        found.append(near.join(field.hint("merge"), F.col("at") == F.col("vertex"), "left").select("point", f"dist_{k}", *[F.col(f"{a}_{c}").alias(f"{k}{a}_{c}") for a in "ng" for c in "xyz"]))
    both = found[0].join(found[1].hint("merge"), "point")
    inner = F.col("dist_p").isNull() | (F.col("dist_w") <= F.col("dist_p"))
    pick = lambda a: g.unit(tuple(F.when(inner, F.col(f"w{a}_{c}")).otherwise(F.col(f"p{a}_{c}")) for c in "xyz"))
    return both.select("point", *[x.alias(f"{name}_{c}") for a, name in (("n", "radial"), ("g", "tangential")) for c, x in zip("xyz", pick(a), strict=True)])


def frame(field: DataFrame, rough: DataFrame | None = None) -> DataFrame:
    """(point, radial_*, sulcal_*, gyral_*): directions made perpendicular, turned to agree with a rough field if given."""
    if rough is not None:
        field = field.join(rough.select("point", *[F.col(f"{k}_{c}").alias(f"r{k}_{c}") for k in ("radial", "tangential") for c in "xyz"]).hint("merge"), "point")
        aligned = {f"{k}_{c}": x for k in ("radial", "tangential") for c, x in zip("xyz", g.align(g.vec(k), g.vec(f"r{k}")), strict=True)}
        field = field.withColumns(aligned)
    three = g.make_perpendicular(g.vec("radial"), g.vec("tangential"))
    return field.select("point", *[x.alias(f"{name}_{c}") for name, v in zip(("radial", "sulcal", "gyral"), three, strict=True) for c, x in zip("xyz", v, strict=True)])


def gyral_coordinates(points: DataFrame, white: ms.Mesh, pial: ms.Mesh, depth: DataFrame, algorithm: str = "line", max_dist: float = 10.0, outside_pial: bool = False, **options) -> DataFrame:
    """The frame of each point within the outer surface, by ``line``, ``interp`` or ``closest``."""
    if not outside_pial:
        points = points.join(spatial.inside(points, pial).where("inside"), "point", "left_semi")
    rough = closest_vertex(points, white, pial, depth, max_dist)
    if algorithm == "closest":
        return frame(rough)
    if algorithm not in ("line", "interp"):
        raise ValueError("algorithm is line, interp or closest")
    make = average_line if algorithm == "line" else average_point
    return frame(make(points, white, pial, depth, max_dist, **options), rough)


def split_frame(field: DataFrame) -> dict[str, DataFrame]:
    """The three vector fields (point, x, y, z) of a frame, by name."""
    return {k: field.select("point", *[F.col(f"{k}_{c}").alias(c) for c in "xyz"]) for k in ("radial", "sulcal", "gyral")}
