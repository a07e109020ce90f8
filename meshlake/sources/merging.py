"""Files that jobs wrote in parts, merged into one: single images, whole folders, or all names that begin alike."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.sources import formats
from meshlake.sources.writers import put_bytes


def merge_images(contents: list[bytes], fill: float | None = None) -> bytes:
    """One image of several of one shape: equal files as they are, else the last part's value that is not the fill.

    Without a fill it is the last image's first voxel; where that is NaN, any finite value counts.
    """
    if all(c == contents[0] for c in contents[1:]):
        return contents[0]
    images = [formats.read_nifti(c) for c in contents]
    outside = images[-1][0].flat[0] if fill is None else fill
    out = np.full(images[0][0].shape, outside, images[0][0].dtype)
    for values, _, _ in images:
        use = np.isfinite(values) if not np.isfinite(outside) else values != outside
        out[use] = values[use]
    return formats.write_nifti(out, images[0][1])


def _merged(files: DataFrame, parts: int, fill: float | None) -> DataFrame:
    """(name, content, parts) for files (path, content, name, part); a name's files meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        whole = len(pdf) == parts
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "content": [merge_images([bytes(c) for c in pdf["content"]], fill) if whole else b""], "parts": [len(pdf)]})

    return files.select("name", "part", "content").groupBy("name").applyInPandas(run, "name string, content binary, parts long")


def merge_basenames(spark: SparkSession, basenames: list[str], out: str, fill: float | None = None) -> list[str]:
    """Merge all files whose paths begin with each basename into files that begin with ``out``.

    Returns the rest of the names that not all parts have; nothing is written for them.
    """
    files = None
    for n, base in enumerate(basenames):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base.rstrip('/')}/" if base.endswith("/") else f"{base}*").select("path", "content")
        plain = F.regexp_replace("path", r"^file:/+", "/")
        start = base.split(":", 1)[-1] if base.startswith("file:") else base
        one = one.withColumn("name", F.element_at(F.split(plain, f"\\Q{start}\\E", 2), 2)).withColumn("part", F.lit(n))
        files = one if files is None else files.unionByName(one)
    missing = []
    for r in _merged(files, len(basenames), fill).toLocalIterator():  # one file at a time
        if r["parts"] == len(basenames):
            put_bytes(spark, f"{out}{r['name']}", bytes(r["content"]))
        else:
            missing.append(r["name"])
    return sorted(missing)


def merge_directories(spark: SparkSession, folders: list[str], out: str, fill: float | None = None) -> list[str]:
    return merge_basenames(spark, [f"{f.rstrip('/')}/" for f in folders], f"{out.rstrip('/')}/", fill)


def merge_files(spark: SparkSession, paths: list[str], out: str, fill: float | None = None) -> None:
    """Merge single images in the order given."""
    found = {r["path"].rsplit("/", 1)[-1]: r["path"] for r in spark.read.format("binaryFile").load(paths).select("path").collect()}
    if len(found) < len({p.rsplit("/", 1)[-1] for p in paths}):
        raise FileNotFoundError("not all parts are there")
    contents = [bytes(spark.read.format("binaryFile").load(p).first()["content"]) for p in paths]
    put_bytes(spark, out, merge_images(contents, fill))


def merge_jobs(spark: SparkSession, names: list[str], jobs: list[str], fill: float | None = None) -> list[str]:
    """Merge for each name its parts, with JOBID replaced by each job, as a folder, a file or a beginning of names."""
    missing = []
    jvm = spark.sparkContext._jvm
    for name in names:
        if "JOBID" not in name:
            raise ValueError("every name holds JOBID")
        paths, out = [name.replace("JOBID", j) for j in jobs], name.replace("JOBID", "")
        kinds = []
        for p in paths:
            where = jvm.org.apache.hadoop.fs.Path(p)
            store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            kinds.append("none" if not store.exists(where) else "folder" if store.getFileStatus(where).isDirectory() else "file")
        if len(set(kinds)) > 1:
            raise OSError(f"{name} is a folder for some jobs and not for others")
        if kinds[0] == "folder":
            missing += merge_directories(spark, paths, out, fill)
        elif kinds[0] == "file":
            merge_files(spark, paths, out, fill)
        else:
            missing += merge_basenames(spark, paths, out, fill)
    return missing
