"""Arrays over voxels and vertices: entries (row, grey_id, value) with an element table and the axes of the other dimension."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators import align
from meshlake.sources import formats, readers, writers, zarr

KEYS = ["structure", "kind", "vertex", "i", "j", "k"]
SCHEMA = "grey_id long, structure string, kind string, vertex int, i int, j int, k int"


@dataclass(frozen=True)
class GreyOrdinates:
    """``values`` (row, grey_id, value), ``elements`` (grey_id, structure, kind, vertex, i, j, k) and the row axis.

    The axis of rows is a description as in ``formats.read_cifti`` or none. The shape of
    the voxel space and the sizes of surfaces go along in ``space``.
    """

    values: DataFrame
    elements: DataFrame
    rows: dict | None = None
    space: dict | None = None

    # sources
    @classmethod
    def from_filename(cls, spark: SparkSession, path: str, **options) -> "GreyOrdinates":
        """Any file, by its name: chunked arrays, CIFTI, GIFTI, NIfTI, or Parquet of long rows; several joined by ``@``."""
        parts = path.split("@")
        if len(parts) > 1:
            first, *others = (cls.from_filename(spark, p, **options) for p in parts)
            for o in others:
                first = first.concatenate(o)
            return first
        if path.rstrip("/").endswith(".zarr"):
            return cls.from_zarr(spark, path)
        out = cls.from_long(readers.read_greyordinates(spark, path, **options))
        if re.search(r"\.d\w+\.nii$", path):
            _, axes = formats.read_cifti(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
            keep = {k: axes[1][k] for k in ("shape", "affine", "nvertices") if k in axes[1]}
            return replace(out, rows=axes[0], space=keep)
        return out

    @classmethod
    def from_long(cls, rows: DataFrame) -> "GreyOrdinates":
        """From rows (structure, kind, vertex, i, j, k, feature, value)."""
        elements = readers.brain_model(rows)
        same = [rows[k].eqNullSafe(elements[k]) for k in KEYS]
        on = same[0]
        for s in same[1:]:
            on = on & s
        return cls(rows.join(elements, on).select(F.col("feature").cast("long").alias("row"), "grey_id", "value"), elements)

    @classmethod
    def from_zarr(cls, spark: SparkSession, path: str) -> "GreyOrdinates":
        _, axes = zarr.describe(spark, path)
        e = spark.createDataFrame([(n, x[0], "voxel" if x[1] is None else "vertex", *x[1:]) for n, x in enumerate(axes[1]["elements"])], SCHEMA)
        keep = {k: axes[1][k] for k in ("shape", "affine", "nvertices") if k in axes[1]}
        return cls(zarr.read(spark, path).withColumnRenamed("col", "grey_id"), e, axes[0], keep or None)

    # views
    def long(self) -> DataFrame:
        """Rows with elements, in the schema of the readers."""
        out = self.values.join(self.elements, "grey_id")
        return out.select(F.lit(None).cast("string").alias("path"), *KEYS, F.col("row").cast("int").alias("feature"), F.lit(None).cast("string").alias("name"), "value")

    def volume(self) -> DataFrame:
        """(i, j, k, feature, value) of the voxels."""
        return self.long().where("kind = 'voxel'").select("i", "j", "k", "feature", "value")

    def surface(self, structure: str) -> DataFrame:
        """(vertex, feature, value) of one surface; none of that name is an error."""
        out = self.long().where((F.col("kind") == "vertex") & (F.col("structure") == structure))
        if out.isEmpty():
            raise ValueError(f"no vertices of {structure}")
        return out.select("vertex", "feature", "value")

    def transpose(self) -> "GreyOrdinates":
        """A square array over the same elements both ways, turned."""
        return replace(self, values=self.values.select(F.col("grey_id").alias("row"), F.col("row").alias("grey_id"), "value"))

    # algebra
    def __add__(self, other: "GreyOrdinates") -> "GreyOrdinates":
        """Sums on the elements that both have."""
        mine, theirs = (x.long().fillna(-1, ["vertex", "i", "j", "k"]) for x in (self, other))
        both = align.add(mine, theirs, [*KEYS, "feature"])
        null = lambda c: F.when(F.col(c) != -1, F.col(c)).alias(c)
        return self.from_long(both.select("structure", "kind", *map(null, ("vertex", "i", "j", "k")), "feature", "value"))

    def concatenate(self, other: "GreyOrdinates") -> "GreyOrdinates":
        """The elements of both, one after the other."""
        shift = self.elements.agg(F.coalesce(F.max("grey_id") + 1, F.lit(0))).first()[0]
        moved = lambda t: t.withColumn("grey_id", F.col("grey_id") + int(shift))
        return replace(self, values=self.values.unionByName(moved(other.values)), elements=self.elements.unionByName(moved(other.elements)))

    # sinks
    def axes(self) -> list[dict]:
        """Descriptions of both axes; the element table is brought to the driver (an axis of a file is a header)."""
        rows = self.elements.orderBy("grey_id").select("structure", "vertex", "i", "j", "k").collect()
        if len(rows) > writers.MAX_ELEMENTS:
            raise ValueError("too many elements for a file's header")
        brain = {"kind": "brain", "elements": [tuple(r) for r in rows], **(self.space or {})}
        n = (self.values.agg(F.max("row")).first()[0] or 0) + 1
        return [self.rows or {"kind": "scalar", "names": [str(k) for k in range(n)], "tables": [{}] * n}, brain]

    def to_filename(self, path: str) -> None:
        """Write by name: ``.zarr``, CIFTI (``.d….nii``), GIFTI, NIfTI, or else a Parquet table of long rows."""
        entries = self.values.select("row", F.col("grey_id").alias("col"), "value")
        if path.endswith(".zarr"):
            axes = self.axes()
            n = len(axes[0]["names"]) if "names" in axes[0] else axes[0]["size"] if "size" in axes[0] else len(axes[0]["elements"])
            zarr.write(entries, path, axes, (n, len(axes[1]["elements"])))
        elif re.search(r"\.d\w+\.nii$", path):
            writers.write_cifti(entries, path, self.axes())
        elif path.endswith(".gii"):
            names = [r[0] for r in self.elements.select("structure").distinct().limit(2).collect()]
            if len(names) != 1:
                raise ValueError("a surface file has one structure")
            size = (self.space or {}).get("nvertices", {}).get(names[0]) or self.elements.agg(F.max("vertex") + 1).first()[0]
            writers.write_metric(self.surface(names[0]), path, int(size), names[0])
        elif re.search(r"\.nii(\.gz)?$", path):
            shape = (self.space or {}).get("shape") or [int(x) + 1 for x in self.elements.agg(F.max("i"), F.max("j"), F.max("k")).first()]
            writers.write_nifti(self.volume(), path, tuple(shape), (self.space or {}).get("affine"))
        else:
            writers.write_table(self.long().drop("path", "name"), path)

    @classmethod
    def empty(cls, spark: SparkSession, path: str, rows: dict, elements: dict, dtype: str = "<f8") -> None:
        """A new chunked array without values, to be filled by ``zarr.append``."""
        n = len(rows["names"]) if "names" in rows else rows["size"] if "size" in rows else len(rows["elements"])
        zarr.create(spark, path, [rows, elements], (n, len(elements["elements"])), dtype=dtype)


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Write what one file holds as another, each in the format that its name says."""
    GreyOrdinates.from_filename(spark, source).to_filename(target)
