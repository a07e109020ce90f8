"""Curves (vertices and the lines between them), clean meshes and traced plane sections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators import mesh as ms
from meshlake.operators.graph import LOCAL_ROWS, components


@dataclass(frozen=True)
class Curve:
    """Vertices (vertex, x, y[, z]) and lines (face, a, b)."""

    vertices: DataFrame
    faces: DataFrame

    @property
    def ndim(self) -> int:
        return len(self.vertices.columns) - 1

    def nvertices(self) -> int:
        return self.vertices.count()

    def nfaces(self) -> int:
        return self.faces.count()


def curve(vertices: DataFrame, kind: str = "open") -> Curve:
    """The curve through vertices in the order of their numbers, 0 to n - 1; ``closed`` joins the last to the first."""
    last = vertices.agg(F.max("vertex").alias("last"))
    v = vertices.select("vertex").join(last)  # one row
    if kind == "open":
        lines = v.where("vertex < last").select(F.col("vertex").alias("face"), F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"))
    else:
        lines = v.select(F.col("vertex").alias("face"), F.col("vertex").alias("a"), F.pmod(F.col("vertex") + 1, F.col("last") + 1).alias("b"))
    return Curve(vertices, lines)


def line_ends(c: Curve) -> DataFrame:
    """Lines with the coordinates of their ends (a_x ... b_z)."""
    names, out = c.vertices.columns[1:], c.faces
    for k in "ab":
        out = out.join(c.vertices.select(F.col("vertex").alias(k), *[F.col(x).alias(f"{k}_{x}") for x in names]), k)
    return out


def line_lengths(c: Curve) -> DataFrame:
    """(face, size)."""
    square = sum(((F.col(f"a_{x}") - F.col(f"b_{x}")) * (F.col(f"a_{x}") - F.col(f"b_{x}")) for x in c.vertices.columns[1:]), F.lit(0.0))
    return line_ends(c).select("face", F.sqrt(square).alias("size"))


def line_normals(c: Curve) -> DataFrame:
    """(face, n_x, n_y) of a curve in the plane; null for lines of no length."""
    if c.ndim != 2:
        raise ValueError("lines have a normal in the plane only")
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    size = F.sqrt(dx * dx + dy * dy)
    return line_ends(c).select("face", F.try_divide(-dy, size).alias("n_x"), F.try_divide(dx, size).alias("n_y"))


def curve_closed(c: Curve) -> DataFrame:
    """One row: whether no vertex has one line alone."""
    n = c.faces.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
    return n.agg((F.coalesce(F.sum((F.col("count") == 1).cast("int")), F.lit(0)) == 0).alias("closed"))


def line_crossings(c: Curve, position: tuple[float, float], direction: tuple[float, float]) -> DataFrame:
    """(face, x, y): where the endless line through ``position`` crosses the lines of a curve in the plane."""
    side = lambda k: (F.col(f"{k}_x") - float(position[0])) * float(direction[1]) - (F.col(f"{k}_y") - float(position[1])) * float(direction[0])
    sa, sb = side("a"), side("b")
    t = F.try_divide(sa, sa - sb)
    place = [(F.col(f"a_{x}") + t * (F.col(f"b_{x}") - F.col(f"a_{x}"))).alias(x) for x in "xy"]
    return line_ends(c).where(((sa > 0) & (sb < 0)) | ((sa < 0) & (sb > 0))).select("face", *place)


def trace(links: DataFrame) -> DataFrame:
    """(line, place, vertex, closed): the vertices of undirected ``links`` (a, b) in order along their lines.

    Each vertex is on two links at most. A line starts at its lower end, a closed one at
    its lowest vertex towards the lower neighbour. A line is put in order in one task;
    one of more than LOCAL_ROWS vertices is refused.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    near = both.groupBy(F.col("a").alias("vertex")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    if near.where(F.size("near") > 2).limit(1).count():
        raise ValueError("a vertex is on more than two links")
    comp = components(near.select("vertex"), both.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rows = near.join(comp, "vertex").select(F.col("component").alias("line"), "vertex", "near")
    largest = comp.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > LOCAL_ROWS:
        raise ValueError(f"a line has {largest} vertices; at most {LOCAL_ROWS} can be put in order")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {v: list(n) for v, n in zip(pdf["vertex"], pdf["near"], strict=True)}
        ends = sorted(v for v, n in near.items() if len(n) == 1)
        at, seen = (ends or sorted(near))[0], []
        before = None
        while at is not None and (not seen or at != seen[0]):
            seen.append(at)
            at, before = next((n for n in near[at] if n != before), None), at
        return pd.DataFrame({"line": pdf["line"].iloc[0], "place": np.arange(len(seen)), "vertex": seen, "closed": not ends})

    return rows.groupBy("line").applyInPandas(order, "line long, place long, vertex long, closed boolean")


def as_lines(c: Curve) -> DataFrame:
    """(line, place, vertex, closed): the lines of a curve; a vertex without lines is one by itself."""
    alone = c.vertices.select("vertex").join(c.faces.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "vertex", "left_anti")
    return trace(c.faces).unionByName(alone.select(F.col("vertex").alias("line"), F.lit(0).cast("long").alias("place"), "vertex", F.lit(False).alias("closed")))


def clean(mesh: ms.Mesh, tolerance: float = 1e-6) -> ms.Mesh:
    """The mesh with vertices of equal coordinates (to ``tolerance``) merged into the lowest, and without faces that thereby lose a corner and vertices without a face."""
    spot = [F.round(F.col(c) / tolerance).alias(f"k_{c}") for c in "xyz"]
    merged = mesh.vertices.select("vertex", F.min("vertex").over(Window.partitionBy(*spot)).alias("kept"))
    faces = mesh.faces
    for k in "abc":
        faces = faces.join(merged.select(F.col("vertex").alias(k), F.col("kept").alias(f"new_{k}")), k)
    faces = faces.select("face", *[F.col(f"new_{k}").alias(k) for k in "abc"]).where("a <> b and b <> c and a <> c")
    return ms.drop_isolated(ms.Mesh(mesh.vertices, faces, mesh.flip))


def plane_section(mesh: ms.Mesh, position=(0.0, 0.0, 0.0), normal=(0.0, 0.0, 1.0)) -> DataFrame:
    """(line, place, u, v, x, y, z, closed): the polylines in which a plane cuts a mesh, point by point in order.

    Points are numbered by the mesh edge (u, v) they are on.
    """
    cuts = ms.plane_crossings(mesh, position, normal)
    last = mesh.vertices.agg((F.max("vertex") + 1).alias("n")).first()[0] or 1
    cuts = cuts.withColumn("point", F.col("u") * int(last) + F.col("v"))
    links = cuts.groupBy("face").agg(F.min("point").alias("a"), F.max("point").alias("b"))
    points = cuts.select("point", "u", "v", "x", "y", "z").dropDuplicates(["point"])
    order = trace(links).withColumnRenamed("vertex", "point")
    return order.join(points, "point").select(F.col("line"), "place", "u", "v", "x", "y", "z", "closed")


def mask_surface(voxels: DataFrame) -> ms.Mesh:
    """The closed surface around voxels (i, j, k): the squares between voxels inside and outside, two triangles each.

    Voxels are unit cubes around whole numbers; normals point outwards.
    """
    inside = voxels.select("i", "j", "k").distinct()
    # corner offsets of the six squares, seen from outside against the clock
    squares = {(1, 0, 0): [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)], (-1, 0, 0): [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)], (0, 1, 0): [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)], (0, -1, 0): [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)], (0, 0, 1): [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], (0, 0, -1): [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)]}
    sides = F.array(*[F.struct(*[(F.col(c) + d).alias(f"o{c}") for c, d in zip("ijk", side, strict=True)], F.array(*[F.struct(*[(F.col(c) + o).alias(c) for c, o in zip("ijk", corner, strict=True)]) for corner in at]).alias("q"), F.lit(n).alias("n")) for n, (side, at) in enumerate(squares.items())])
    every = inside.select("i", "j", "k", F.explode(sides).alias("s")).select("i", "j", "k", "s.*")
    outer = inside.select(F.col("i").alias("oi"), F.col("j").alias("oj"), F.col("k").alias("ok"))
    border = every.join(outer, ["oi", "oj", "ok"], "left_anti")
    from meshlake.operators.binning import running

    spots = border.select(F.explode("q").alias("s")).select("s.i", "s.j", "s.k").distinct()
    numbered = running(spots.withColumn("n", F.lit(1)), order=("i", "j", "k")).select("i", "j", "k", F.col("before").cast("long").alias("vertex"))
    halves = F.array(F.struct(F.lit(0).alias("h"), F.col("q")[0].alias("a"), F.col("q")[1].alias("b"), F.col("q")[2].alias("c")), F.struct(F.lit(1).alias("h"), F.col("q")[0].alias("a"), F.col("q")[2].alias("b"), F.col("q")[3].alias("c")))
    tri = border.select("i", "j", "k", "n", F.explode(halves).alias("t")).select(F.xxhash64("i", "j", "k", "n", "t.h").alias("face"), "t.a", "t.b", "t.c")
    for c in "abc":
        tri = tri.join(numbered.select(F.struct("i", "j", "k").alias(c), F.col("vertex").alias(f"v{c}")), c).drop(c)
    vertices = numbered.select("vertex", *[(F.col(n) - 0.5).cast("double").alias(c) for n, c in zip("ijk", "xyz", strict=True)])
    return ms.Mesh(vertices, tri.select("face", *[F.col(f"v{c}").alias(c) for c in "abc"]))
