"""Files to DataFrames. Bytes are read by Spark (any store it can read) and parsed in tasks, a file each."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.sources import formats

ELEMENTS = "path string, structure string, kind string, vertex int, i int, j int, k int, feature int, name string, value double"


def _per_file(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                for out in rows(file, bytes(content)):
                    out.insert(0, "path", file)
                    yield out.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def _masked(values: np.ndarray, rule: str, mask_values) -> np.ndarray:
    """Rows of (elements, features) that are not masked."""
    real = ~np.isnan(values)
    for m in mask_values:
        if m == m:
            real &= values != m
    return real.any(1) if rule == "any" else real.all(1)


def _long(frame: pd.DataFrame, values: np.ndarray, names: list[str | None]):
    for n in range(values.shape[1]):
        yield frame.assign(feature=n, name=names[n], value=values[:, n])


def read_nifti(spark: SparkSession, path: str, mask_values=(0, float("nan")), rule: str = "any") -> DataFrame:
    """Volumes as rows of their unmasked voxels; trailing dimensions are features."""

    def rows(_, data):
        values, _, _ = formats.read_nifti(data)
        values = values.astype(float).reshape(*(values.shape + (1, 1, 1))[:3], -1, order="F")
        flat = values.reshape(-1, values.shape[3])
        keep = np.flatnonzero(_masked(flat, rule, mask_values))
        i, j, k = np.unravel_index(keep, values.shape[:3])
        yield from _long(pd.DataFrame({"structure": "OTHER", "kind": "voxel", "i": i, "j": j, "k": k, "vertex": pd.array([None] * len(i), "Int32")}), flat[keep], [None] * flat.shape[1])

    return _per_file(spark, path, rows, ELEMENTS)


def read_gifti(spark: SparkSession, path: str, mask_values=(0, float("nan")), rule: str = "any") -> DataFrame:
    """Surface values as rows of their unmasked vertices; arrays are features."""

    def rows(_, data):
        g = formats.read_gifti(data)
        values = np.column_stack([a.reshape(len(a), -1) for a in g.arrays]).astype(float)
        keep = np.flatnonzero(_masked(values, rule, mask_values))
        none = pd.array([None] * len(keep), "Int32")
        yield from _long(pd.DataFrame({"structure": g.structure(), "kind": "vertex", "vertex": keep, "i": none, "j": none, "k": none}), values[keep], [m.get("Name") for m in g.meta] if len(g.meta) == values.shape[1] else [None] * values.shape[1])

    return _per_file(spark, path, rows, ELEMENTS)


def read_cifti(spark: SparkSession, path: str) -> DataFrame:
    """Dense CIFTI files (columns are brain models) as rows; rows' names are those of the other axis, labels decoded to ``name``."""

    def rows(file, data):
        matrix, axes = formats.read_cifti(data)
        if axes[1]["kind"] != "brain":
            raise ValueError(f"{file}: the last axis has no brain models")
        e = pd.DataFrame(axes[1]["elements"], columns=["structure", "vertex", "i", "j", "k"]).astype({c: "Int32" for c in ("vertex", "i", "j", "k")})
        e["kind"] = np.where(e["vertex"].isna(), "voxel", "vertex")
        other = axes[0]
        names = other.get("names") or ([str(other["start"] + other["step"] * n) for n in range(other["size"])] if other["kind"] == "series" else [None] * len(matrix))
        for n, row in enumerate(matrix):
            label = other["tables"][n] if other["kind"] == "label" else None
            yield e.assign(feature=n, name=[label.get(int(v)) for v in row] if label else names[n], value=row.astype(float))

    return _per_file(spark, path, rows, ELEMENTS)


def read_greyordinates(spark: SparkSession, paths: str, **options) -> DataFrame:
    """Files joined by ``@``, each by its extension, one after another."""
    found = None
    for p in paths.split("@"):
        if p.rstrip("/").endswith(".zarr"):
            from meshlake.greyordinates import GreyOrdinates

            one = GreyOrdinates.from_zarr(spark, p).long()
            found = one if found is None else found.unionByName(one)
            continue
        kind = read_cifti if re.search(r"\.d\w+\.nii$", p) else read_gifti if re.search(r"\.gii(\.gz)?$", p) else read_nifti if re.search(r"\.nii(\.gz)?$", p) else None
        one = spark.read.parquet(p) if kind is None else kind(spark, p) if kind is read_cifti else kind(spark, p, **options)
        found = one if found is None else found.unionByName(one)
    return found


def _surface(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """Structure, points and triangles of a GIFTI or FreeSurfer surface."""
    if data[:3] == b"\xff\xff\xfe":
        return ("unknown", *formats.read_freesurfer(data))
    g = formats.read_gifti(data)
    return (g.structure(), *g.mesh())


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, structure, vertex, x, y, z) and faces (path, structure, face, a, b, c) of surface files."""

    def vertices(_, data):
        structure, p, _t = _surface(data)
        p = p.astype(float)
        yield pd.DataFrame({"structure": structure, "vertex": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    def faces(_, data):
        structure, _p, t = _surface(data)
        yield pd.DataFrame({"structure": structure, "face": np.arange(len(t)), "a": t[:, 0], "b": t[:, 1], "c": t[:, 2]})

    return _per_file(spark, path, vertices, "path string, structure string, vertex long, x double, y double, z double"), _per_file(spark, path, faces, "path string, structure string, face long, a long, b long, c long")


def read_surfaces(spark: SparkSession, paths: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Vertices and faces by structure, from one or two surface files joined by ``@``; twice the same structure is an error."""
    out = {}
    for p in paths.split("@"):
        vertices, faces = read_mesh(spark, p)
        for r in vertices.select("structure").distinct().collect():
            if r["structure"] in out:
                raise ValueError(f"two surfaces are {r['structure']}")
            one = F.col("structure") == r["structure"]
            out[r["structure"]] = (vertices.where(one), faces.where(one))
    return out


def read_hcp(spark: SparkSession, folder: str) -> dict[str, list[tuple[str, DataFrame, DataFrame]]]:
    """For R and L the (name, vertices, faces) of the white, midthickness (where there is one) and pial surfaces of a folder."""
    vertices, faces = read_mesh(spark, f"{folder.rstrip('/')}/*.surf.gii")
    parts = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    files = {(r["side"], r["name"]): r["path"] for r in vertices.select("path", parts[1].alias("side"), parts[2].alias("name")).distinct().orderBy(F.desc("path")).collect()}
    out = {}
    for side in "RL":
        out[side] = []
        for name in ("white", "midthickness", "pial"):
            path = files.get((side, name))
            if path is None:
                if name == "midthickness":
                    continue
                raise OSError(f"no {name} surface of {side} in {folder}")
            out[side].append((name, vertices.where(F.col("path") == path), faces.where(F.col("path") == path)))
    return out


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Surface labels: rows (path, structure, vertex, feature, label) and the label table (path, structure, key, name, rgba)."""

    def rows(_, data):
        g = formats.read_gifti(data)
        for n, a in enumerate(g.arrays):
            yield pd.DataFrame({"structure": g.structure(), "vertex": np.arange(len(a)), "feature": n, "label": a.astype("i8")})

    def table(_, data):
        g = formats.read_gifti(data)
        yield pd.DataFrame({"structure": g.structure(), "key": list(g.labels), "name": [v[0] for v in g.labels.values()], "rgba": [list(v[1]) for v in g.labels.values()]})

    return _per_file(spark, path, rows, "path string, structure string, vertex int, feature int, label long"), _per_file(spark, path, table, "path string, structure string, key int, name string, rgba array<double>")


def brain_model(elements: DataFrame) -> DataFrame:
    """Elements (structure, kind, vertex, i, j, k) with their number ``grey_id``: surfaces by vertex, then voxels in z-major order."""
    from meshlake.operators.binning import running

    keyed = elements.select("structure", "kind", "vertex", "i", "j", "k").distinct().withColumn("n", F.lit(1))
    return running(keyed, order=("kind", "structure", "vertex", "k", "j", "i")).withColumnRenamed("before", "grey_id").drop("n")


def dense_connectome(triples: DataFrame, rows: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(src, dst, value) with the elements of numbered triples (row, col, value); ``rows`` and ``columns`` are (grey_id, …) tables."""
    columns = rows if columns is None else columns
    side = lambda t, k: t.select(F.col("grey_id").alias(k), F.struct(*[c for c in t.columns if c != "grey_id"]).alias(f"{k}_element"))
    return triples.join(side(rows, "row"), "row").join(side(columns, "col"), "col").select(F.col("row").alias("src"), F.col("col").alias("dst"), "row_element", "col_element", "value")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Sparse matrices in text (row col value, from 1; the last row may hold the shape with value 0) as (row, col, value) from 0."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select((parts[0].cast("long") - 1).alias("row"), (parts[1].cast("long") - 1).alias("col"), parts[2].cast("double").alias("value"))
    return rows.where("value <> 0")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, value) of whitespace-separated numbers in text files."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("position", "value"))
    return lines.where("value <> ''").withColumn("value", F.col("value").cast("double"))


def read_ascii_mask(spark: SparkSession, path: str) -> DataFrame:
    """(path, hemisphere, vertex) of text masks with lines ``x,y,z,value`` whose value is not 0; the side is in the file's name."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("vertex", "line")).where("trim(line) <> ''")
    value = F.element_at(F.split("line", r"[,\s]+"), -1).cast("double")
    name = F.element_at(F.split("path", "/"), -1)
    side = F.when(name.contains("L") & ~name.contains("R"), "left").when(name.contains("R") & ~name.contains("L"), "right")
    return lines.where(value != 0).select("path", side.alias("hemisphere"), "vertex")


def template_pattern(template: str) -> tuple[str, str, list[str]]:
    """Glob, regular expression and variables of a path template with {variables}."""
    parts = re.split(r"\{(\w+)\}", template)
    names = list(dict.fromkeys(parts[1::2]))
    seen, pattern = set(), ""
    for n, p in enumerate(parts):
        if n % 2 == 0:
            pattern += re.escape(p)
        elif p in seen:
            pattern += f"\\{names.index(p) + 1}"
        else:
            seen.add(p)
            pattern += "([^/]+)"
    return re.sub(r"\{\w+\}", "*", template), pattern + "$", names


def list_template(spark: SparkSession, template: str) -> DataFrame:
    """(path, …variables) of the files that a template matches."""
    glob, pattern, names = template_pattern(template)
    files = spark.read.format("binaryFile").load(glob).select("path")
    files = files.where(F.col("path").rlike(pattern))
    return files.select("path", *[F.regexp_extract("path", pattern, n + 1).alias(v) for n, v in enumerate(names)])


def read_tree(spark: SparkSession, templates: dict[str, str], how: str = "inner") -> DataFrame:
    """Values of the files of several templates: each template's files with their variables as columns, then joined on what they share."""
    from meshlake.operators.align import natural_join

    frames = []
    for name, template in templates.items():
        files = list_template(spark, template)
        values = read_greyordinates(spark, template_pattern(template)[0]).join(files, "path").drop("path", "name")
        frames.append(values.withColumnRenamed("value", name))
    filled = [f.fillna(-1, subset=["vertex", "i", "j", "k"]) for f in frames]
    return natural_join(filled, how)
