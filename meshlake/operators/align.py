"""Alignment of element spaces: key joins, stacks, concatenations, merges and label products."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.binning import running

KEYS = ("structure", "kind", "vertex", "i", "j", "k")


def shared_keys(*frames: DataFrame, keys: Sequence[str] = KEYS) -> list[str]:
    """The key columns that all frames have."""
    return [k for k in keys if all(k in f.columns for f in frames)]


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Elements in both spaces, with their index in each (index_1, index_2)."""
    return a.select(*keys, F.col(index).alias("index_1")).join(b.select(*keys, F.col(index).alias("index_2")), list(keys))


def combine(spaces: Sequence[DataFrame], keys: Sequence[str], index: str) -> DataFrame:
    """Elements common to all spaces, with their index in each (index_1, ...)."""
    numbered = [s.select(*keys, F.col(index).alias(f"index_{n}")) for n, s in enumerate(spaces, 1)]
    return reduce(lambda x, y: x.join(y, list(keys)), numbered)


def add(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of the values of two arrays on their common elements."""
    return a.select(*keys, F.col("value").alias("x")).join(b.select(*keys, F.col("value").alias("y")), list(keys)).select(*keys, (F.col("x") + F.col("y")).alias("value"))


def stack(arrays: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """A new leading axis ``layer`` (stacked_1, ...), on the elements that all arrays have."""
    rows = reduce(DataFrame.unionByName, [a.select(*keys, "value", F.lit(n).alias("n")) for n, a in enumerate(arrays, 1)])
    rows = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
    # one exchange: an element's rows meet, and stay if they come from all arrays
    same = Window.partitionBy(*keys)
    seen = reduce(Column.__and__, [F.max(F.col("n") == n).over(same) for n in range(1, len(arrays) + 1)])
    return rows.withColumn("seen", seen).where("seen").select(*keys, "value", F.concat(F.lit("stacked_"), F.col("n")).alias("layer"))


def concatenate(arrays: Sequence[DataFrame], keys: Sequence[str], axis: int = -1) -> DataFrame:
    """Arrays end to end: elements (axis -1), or rows ``feature`` on the common elements (axis 0)."""
    if axis == -1:
        return reduce(DataFrame.unionByName, arrays)
    common = reduce(lambda x, y: x.join(y, list(keys)), [a.select(*keys).distinct() for a in arrays])
    shift, out = F.lit(0).cast("long"), []
    sizes = [a.agg(F.coalesce(F.max("feature") + 1, F.lit(0)).cast("long").alias("n")) for a in arrays]
    for n, a in enumerate(arrays):
        here = a.join(common, list(keys), "left_semi")
        for m in range(n):
            here = here.join(F.broadcast(sizes[m].withColumnRenamed("n", f"n{m}")))
        total = sum((F.col(f"n{m}") for m in range(n)), shift)
        out.append(here.select(*keys, (F.col("feature") + total).alias("feature"), "value"))
    return reduce(DataFrame.unionByName, out)


def natural_join(frames: Sequence[DataFrame], how: str = "inner", keys: Sequence[str] | None = None) -> DataFrame:
    """Frames joined one after another on whichever keys both sides have."""

    def one(x: DataFrame, y: DataFrame) -> DataFrame:
        on = [k for k in (keys or x.columns) if k in x.columns and k in y.columns]
        if not on:
            raise ValueError("no key in common")
        return x.join(y, on, how)

    return reduce(one, frames)


def combine_parcels(a: DataFrame, b: DataFrame, labels_a: DataFrame, labels_b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The product of two parcellations (vertex, label) and its label table.

    The parcel of a pair of labels is its rank among the pairs present; ``legacy`` is the
    decimal composition a * 10^digits + b - min(b), which can give two pairs one number.
    Labels are (label, name, r, g, b, alpha); names are joined and colours averaged.
    """
    both = a.select("vertex", F.col("label").alias("la")).join(b.select("vertex", F.col("label").alias("lb")), "vertex")
    span = both.agg(F.min("lb").alias("low"), F.greatest(F.max("lb") - F.min("lb"), F.lit(1)).alias("span"))
    factor = F.pow(F.lit(10.0), F.ceil(F.log10(F.col("span").cast("double")))).cast("long")
    pairs = both.select("la", "lb").distinct().join(F.broadcast(span)).withColumn("legacy", F.col("la") * factor + F.col("lb") - F.col("low"))
    # ranked by ranges of the pairs; the span is one row
    pairs = running(pairs.withColumn("n", F.lit(1)), order=("la", "lb")).withColumn("parcel", (F.col("before") + 1).cast("int")).drop("low", "span", "n", "before")
    parcels = both.join(pairs, ["la", "lb"]).select("vertex", "parcel", "legacy")
    rename = lambda t, s: t.select(*[F.col(c).alias(f"{c}_{s}") for c in ("label", "name", "r", "g", "b", "alpha")])
    named = pairs.join(rename(labels_a, "1"), F.col("la") == F.col("label_1")).join(rename(labels_b, "2"), F.col("lb") == F.col("label_2"))
    table = named.select("parcel", F.concat_ws(" & ", "name_1", "name_2").alias("name"), *[((F.col(f"{c}_1") + F.col(f"{c}_2")) / 2).alias(c) for c in ("r", "g", "b", "alpha")])
    return parcels, table


def merge_parts(parts: Sequence[DataFrame], keys: Sequence[str], fill: float | None = None) -> DataFrame:
    """Partial results laid over each other: the value of the last part that is not the fill (null or NaN: never a value)."""
    rows = reduce(DataFrame.unionByName, [p.select(*keys, "value", F.lit(n).alias("part")) for n, p in enumerate(parts)])
    real = F.col("value").isNotNull() & ~F.isnan("value")
    if fill is not None:
        real = real & (F.col("value") != fill)
    best = F.max_by("value", F.when(real, F.col("part")))
    return rows.groupBy(*keys).agg(F.coalesce(best, F.lit(fill).cast("double")).alias("value"))


def coalesce_frames(frames: Sequence[DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """For each element the first frame whose vector is finite and not all zero."""

    def valid(suffix: int) -> Column:
        cs = [F.col(f"{c}_{suffix}") for c in columns]
        finite = reduce(Column.__and__, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in cs])
        return finite & reduce(Column.__or__, [c != 0 for c in cs])

    named = [f.select(*keys, *[F.col(c).alias(f"{c}_{n}") for c in columns]) for n, f in enumerate(frames)]
    joined = reduce(lambda x, y: x.join(y, list(keys), "full"), named)
    pick = lambda c: F.coalesce(*[F.when(valid(n), F.col(f"{c}_{n}")) for n in range(len(frames))], F.lit(0.0))
    return joined.select(*keys, *[pick(c).alias(c) for c in columns])


def label_names(values: DataFrame, table: DataFrame) -> DataFrame:
    """Values (…, label) with the names of a label table (label, name)."""
    return values.join(table.select("label", "name"), "label", "left")


def missing(source: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose keys are not in ``present``."""
    return source.join(present.select(*keys).distinct(), list(keys), "left_anti")


def to_dense(size: int, values: DataFrame, key: str = "vertex", fill: float | None = None) -> DataFrame:
    """All elements 0..size-1 with their value or the fill."""
    whole = values.sparkSession.range(size).withColumnRenamed("id", key)
    return whole.join(values.select(key, "value"), key, "left").select(key, F.coalesce("value", F.lit(fill).cast("double")).alias("value"))


def mask_elements(values: DataFrame, column: str = "features", rule: str = "any") -> DataFrame:
    """Elements of which any (or all) entries are neither 0 nor NaN nor null."""
    real = lambda x: F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))
    return values.where(F.exists(column, real) if rule == "any" else F.forall(column, real))
