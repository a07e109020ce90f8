"""Chunked arrays with labelled axes on disk, in the directory layout of zarr format 2.

A group holds the array ``data`` in chunks and an attribute for each axis. Chunks are
written and read in tasks, one file each, so an array of any size needs no task that
holds it whole. Compression is zlib or none.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.sources.writers import put_bytes


def _axis(axis: dict | None) -> dict | None:
    """An axis description in plain lists and numbers."""
    return None if axis is None else json.loads(json.dumps(axis, default=lambda x: x.item() if hasattr(x, "item") else list(x)))


def create(spark: SparkSession, path: str, axes: list[dict | None], shape: tuple[int, ...], chunks: tuple[int, ...] | None = None, dtype: str = "<f8", fill: float | None = float("nan"), compress: bool = True) -> None:
    """An empty array: its description, without chunks; what has no chunk reads as the fill."""
    chunks = chunks or tuple(min(n, 1024) or 1 for n in shape)
    plain = "NaN" if fill is not None and fill != fill else fill
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": {"id": "zlib", "level": 1} if compress else None, "fill_value": plain, "order": "C", "filters": None}
    put_bytes(spark, f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    put_bytes(spark, f"{path}/.zattrs", json.dumps({"axes": [_axis(a) for a in axes]}).encode())
    put_bytes(spark, f"{path}/data/.zarray", json.dumps(meta).encode())


def describe(spark: SparkSession, path: str) -> tuple[dict, list[dict | None]]:
    """The array's description and its axes."""

    def text(name: str) -> str:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    return json.loads(text("data/.zarray")), json.loads(text(".zattrs")).get("axes", [])


def write(df: DataFrame, path: str, axes: list[dict | None], shape: tuple[int, int], chunks: tuple[int, int] | None = None, dtype: str = "<f8", fill: float = float("nan"), compress: bool = True) -> None:
    """Entries (row, col, value) as the array of a new group; the rest is the fill."""
    spark = df.sparkSession
    create(spark, path, axes, shape, chunks, dtype, fill, compress)
    append(df, path)


def append(df: DataFrame, path: str) -> None:
    """Entries (row, col, value) into an array: whole chunks, each put down by one task."""
    spark = df.sparkSession
    meta, _ = describe(spark, path)
    (cr, cc), dtype, fill = meta["chunks"], meta["dtype"], float(meta["fill_value"] if meta["fill_value"] is not None else 0)
    rows = df.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    rows = rows.withColumn("i", F.floor(F.col("row") / cr)).withColumn("j", F.floor(F.col("col") / cc))
    old = chunk_table(spark, path)
    if old is not None:
        rows = rows.select("row", "col", "value", "i", "j", F.lit(1).alias("turn")).unionByName(_entries(old, meta).join(rows.select("i", "j").distinct(), ["i", "j"], "left_semi").withColumn("turn", F.lit(0)))
    else:
        rows = rows.withColumn("turn", F.lit(1))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn", kind="stable")
        out = np.full((cr, cc), fill)
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        out[pdf["row"] - i * cr, pdf["col"] - j * cc] = pdf["value"]
        raw = np.ascontiguousarray(out.astype(dtype)).tobytes()
        return pd.DataFrame({"name": [f"{i}.{j}"], "content": [zlib.compress(raw, 1) if meta["compressor"] else raw]})

    blobs = rows.groupBy("i", "j").applyInPandas(build, "name string, content binary")
    for r in blobs.toLocalIterator():  # one chunk at a time
        put_bytes(spark, f"{path}/data/{r['name']}", bytes(r["content"]))


def chunk_table(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, content) of the chunks that are there; none if there are none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/data/[0-9]*")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where):
        return None
    return spark.read.format("binaryFile").load(f"{path}/data/[0-9]*").select("path", "content")


def _entries(chunks: DataFrame, meta: dict) -> DataFrame:
    (cr, cc), (nr, nc), dtype = meta["chunks"], meta["shape"], meta["dtype"]
    packed = meta["compressor"] is not None

    def run(batches):
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                i, j = (int(x) for x in file.rsplit("/", 1)[-1].split("."))
                raw = zlib.decompress(bytes(content)) if packed else bytes(content)
                block = np.frombuffer(raw, dtype).reshape(cr, cc)[: nr - i * cr, : nc - j * cc].astype(float)
                r, c = np.indices(block.shape)
                yield pd.DataFrame({"row": (r + i * cr).ravel(), "col": (c + j * cc).ravel(), "value": block.ravel(), "i": i, "j": j})

    return chunks.mapInPandas(run, "row long, col long, value double, i long, j long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of all entries in chunks that were written and that are not the fill."""
    meta, _ = describe(spark, path)
    found = chunk_table(spark, path)
    if found is None:
        return spark.createDataFrame([], "row long, col long, value double")
    fill = meta["fill_value"]
    keep = F.col("value").isNotNull() & ~F.isnan("value")
    if fill != "NaN":
        keep &= F.col("value") != float(fill or 0)
    return _entries(found, meta).select("row", "col", "value").where(keep)
