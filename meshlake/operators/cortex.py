"""Stacks of surfaces with one set of faces, their anatomy, and simple shapes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.functions import geometry as g
from meshlake.operators import mesh as ms
from meshlake.operators import spatial


@dataclass(frozen=True)
class Anatomy:
    """The structure that a surface stands for; ``all`` fits any primary, no secondary any other."""

    primary: str = "all"
    hemisphere: str = "both"
    secondary: str | None = None
    geometry: str | None = None

    def fits(self, other: "Anatomy") -> bool:
        second = self.secondary is None or other.secondary is None or self.secondary == other.secondary
        return (self.primary == other.primary or "all" in (self.primary, other.primary)) and second and self.hemisphere == other.hemisphere

    def __str__(self) -> str:
        side = "" if self.hemisphere == "both" else self.hemisphere.capitalize()
        return "".join(w.capitalize() for w in self.primary.split("_")) + side

    @property
    def cifti(self) -> str:
        side = "" if self.hemisphere == "both" else f"_{self.hemisphere.upper()}"
        return f"CIFTI_STRUCTURE_{self.primary.upper()}{side}"


@dataclass(frozen=True)
class CorticalMesh:
    """A mesh with its anatomy, which sub-meshes and moved meshes keep."""

    mesh: ms.Mesh
    anatomy: Anatomy = field(default_factory=Anatomy)

    def submesh(self, keep: DataFrame) -> "CorticalMesh":
        return CorticalMesh(ms.submesh(self.mesh, keep), self.anatomy)

    def apply_affine(self, affine) -> "CorticalMesh":
        return CorticalMesh(ms.apply_affine(self.mesh, affine), self.anatomy)


@dataclass(frozen=True)
class CorticalLayer:
    """The room between two surfaces of the same faces."""

    lower: CorticalMesh
    upper: CorticalMesh

    @property
    def hemisphere(self) -> str:
        return self.lower.anatomy.hemisphere

    @property
    def structure(self) -> str:
        return self.lower.anatomy.primary

    def nvertices(self) -> int:
        return self.lower.mesh.nvertices()

    def nfaces(self) -> int:
        return self.lower.mesh.nfaces()

    def wedge_volume(self, atpoint: bool = False) -> DataFrame:
        """(face, volume), or (vertex, volume) with a third of each face around a vertex."""
        if atpoint:
            return ms.layer_vertex_wedges(self.lower.mesh, self.upper.mesh)
        return ms.layer_wedges(self.lower.mesh, self.upper.mesh).select("face", "volume")

    def volume(self) -> DataFrame:
        """One row: the whole room."""
        return self.wedge_volume().agg(F.sum("volume").alias("volume"))


@dataclass(frozen=True)
class Cortex:
    """Surfaces of the same faces from the inmost to the outmost."""

    surfaces: tuple[CorticalMesh, ...]

    def __post_init__(self):
        if len(self.surfaces) < 2:
            raise ValueError("a cortex has two surfaces or more")
        first = self.surfaces[0].anatomy
        if not all(first.fits(s.anatomy) for s in self.surfaces):
            raise ValueError("the surfaces are of different structures")

    @property
    def primary(self) -> str:
        return self.surfaces[0].anatomy.primary

    @property
    def hemisphere(self) -> str:
        return self.surfaces[0].anatomy.hemisphere

    def nvertices(self) -> int:
        return self.surfaces[0].mesh.nvertices()

    def nfaces(self) -> int:
        return self.surfaces[0].mesh.nfaces()

    def layers(self) -> list[CorticalLayer]:
        return [CorticalLayer(a, b) for a, b in zip(self.surfaces, self.surfaces[1:], strict=False)]

    def wedge_volume(self, atpoint: bool = False) -> DataFrame:
        """The layers' wedges, summed for each face or vertex."""
        key, out = "vertex" if atpoint else "face", None
        for layer in self.layers():
            one = layer.wedge_volume(atpoint)
            out = one if out is None else out.unionByName(one)
        return out.groupBy(key).agg(F.sum("volume").alias("volume"))

    def volume(self) -> DataFrame:
        return self.wedge_volume().agg(F.sum("volume").alias("volume"))

    def segment(self, points: DataFrame) -> DataFrame:
        """(point, n): how many of the surfaces enclose each point."""
        return spatial.enclosing_surfaces(points, [s.mesh for s in self.surfaces])

    def distance(self, points: DataFrame, max_dist: float, affine=None, mask: str | None = None) -> DataFrame:
        """(point, vertex, dist) of the nearest line from an inmost to an outmost vertex.

        ``affine`` takes points (voxel numbers) to the surfaces' space; ``mask`` names a
        column of points that must be true.
        """
        if mask is not None:
            points = points.where(F.col(mask))
        if affine is not None:
            moved = g.affine_mult(affine, tuple(F.col(c) for c in "xyz"))
            points = points.select("point", *[m.alias(c) for m, c in zip(moved, "xyz", strict=True)])
        return spatial.nearest_segment(points, self.surfaces[0].mesh.vertices, self.surfaces[-1].mesh.vertices, max_dist)


def _mesh(spark: SparkSession, vertices, faces) -> ms.Mesh:
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(vertices)], "vertex long, x double, y double, z double")
    f = spark.createDataFrame([(i, *map(int, t)) for i, t in enumerate(faces)], "face long, a long, b long, c long")
    return ms.Mesh(v, f)


def triangle_mesh(spark: SparkSession) -> ms.Mesh:
    """The triangle (0, 0), (1, 0), (0, 1)."""
    return _mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])


def cuboid(spark: SparkSession, size=(1, 1, 1), shift=(0.0, 0.0, 0.0), inward: bool = True) -> ms.Mesh:
    """A box of eight vertices and twelve faces from ``shift`` on."""
    corner = [tuple(o + s * b for o, s, b in zip(shift, size, (x, y, z), strict=True)) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
    faces = []
    for axis in range(3):  # vertex numbers are 4 x + 2 y + z; each side is a square of four
        one, two = 4 >> (axis + 1) % 3, 4 >> (axis + 2) % 3
        for far in (0, 4 >> axis):
            a, b, c, d = far, far + one, far + one + two, far + two
            faces += [(a, b, c), (a, c, d)] if bool(far) != inward else [(a, c, b), (a, d, c)]
    return _mesh(spark, corner, faces)


def sphere(spark: SparkSession, rings: int = 12, sectors: int = 24, radius: float = 1.0) -> ms.Mesh:
    """A closed sphere of rings of vertices between two poles; normals point outwards."""
    points = [(0.0, 0.0, radius)]
    for r in range(1, rings):
        theta = np.pi * r / rings
        points += [(radius * np.sin(theta) * np.cos(2 * np.pi * s / sectors), radius * np.sin(theta) * np.sin(2 * np.pi * s / sectors), radius * np.cos(theta)) for s in range(sectors)]
    points.append((0.0, 0.0, -radius))
    at = lambda r, s: 1 + (r - 1) * sectors + s % sectors
    faces = [(0, at(1, s), at(1, s + 1)) for s in range(sectors)] + [(len(points) - 1, at(rings - 1, s + 1), at(rings - 1, s)) for s in range(sectors)]
    for r in range(1, rings - 1):
        for s in range(sectors):
            faces += [(at(r, s), at(r + 1, s), at(r + 1, s + 1)), (at(r, s), at(r + 1, s + 1), at(r, s + 1))]
    return _mesh(spark, points, faces)


def mesh_to_cortex(mesh: ms.Mesh, hemisphere: str = "left") -> CorticalMesh:
    return CorticalMesh(mesh, Anatomy("cortex", hemisphere))


def spherical_cortex(spark: SparkSession, inner: float = 0.8, outer: float = 1.0, hemisphere: str = "left") -> Cortex:
    """Two concentric spheres."""
    return Cortex(tuple(mesh_to_cortex(sphere(spark, radius=r), hemisphere) for r in (inner, outer)))
