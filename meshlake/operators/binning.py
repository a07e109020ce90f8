"""Gap clustering, discretising and even slices of one-dimensional values, in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.operators.graph import settle


def distinct_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, n): each value with its rows; what sorts and runs below work on."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def running(df: DataFrame, partitions: int | None = None, weight: str = "n", order: tuple[str, ...] = ("v",)) -> DataFrame:
    """(v, …, before): with the sum of ``weight`` over the rows before, in the order of some columns, by ranges.

    Values are dealt out by range; sums run within ranges, and one row for each range
    carries the sums before it, so that no task sorts all values.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down: the bounds of ranges are drawn anew each time they are computed
    ranged = settle(df.repartitionByRange(n, *order).withColumn("p", F.spark_partition_id()))
    inner = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("p").agg(F.sum(weight).alias("s"))
    outer = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = sums.select("p", F.coalesce(F.sum("s").over(outer), F.lit(0)).alias("base"))
    return ranged.withColumn("inner", F.coalesce(F.sum(weight).over(inner), F.lit(0))).join(F.broadcast(base), "p").withColumn("before", F.col("base") + F.col("inner")).drop("p", "inner", "base")


def shells(df: DataFrame, value: str, delta: float, keep_type: bool = False) -> DataFrame:
    """Rows with ``shell`` (0, 1, …) and ``rounded``: values chained by gaps below ``delta``, and their median.

    Gaps are found among distinct values; a shell's median is that of its rows.
    """
    v = distinct_counts(df, value)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settle(v.repartitionByRange(n, "v").withColumn("p", F.spark_partition_id()))
    ends = ranged.groupBy("p").agg(F.max("v").alias("last"))
    outer = Window.orderBy("p")
    ends = ends.select("p", F.lag("last").over(outer).alias("last"))
    inner = Window.partitionBy("p").orderBy("v")
    gaps = ranged.join(F.broadcast(ends), "p").withColumn("prev", F.coalesce(F.lag("v").over(inner), F.col("last")))
    opens = gaps.select("v", F.when(F.col("prev").isNotNull() & (F.col("v") - F.col("prev") >= delta), 1).otherwise(0).alias("opens"))
    numbered = running(opens, weight="opens").select("v", (F.col("before") + F.col("opens")).alias("shell"))
    rows = df.join(numbered, F.col(value).cast("double") == F.col("v"), "left").drop("v")
    # the middle one or two rows of a shell, by running counts of distinct values
    placed = running(v.join(numbered, "v").select("v", "n", "shell")).withColumn("upto", F.col("before") + F.col("n"))
    span = placed.groupBy("shell").agg(F.min("before").alias("first"), F.max("upto").alias("last")).withColumnRenamed("shell", "s")
    low, high = F.floor((F.col("first") + F.col("last") - 1) / 2), F.ceil((F.col("first") + F.col("last") - 1) / 2)
    holds = lambda r: (F.col("before") <= r) & (r < F.col("upto"))
    middle = placed.join(span, placed["shell"] == span["s"]).where(holds(low) | holds(high))
    median = middle.groupBy("shell").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("rounded"))
    out = rows.join(median, "shell", "left")
    return out.withColumn("rounded", F.col("rounded").cast(df.schema[value].dataType)) if keep_type else out


def regular_edges(df: DataFrame, value: str, nbins: int) -> list[float]:
    low, high = df.agg(F.min(value), F.max(value)).first()
    return [low + k * (high - low) / nbins for k in range(nbins)] + [high + 1e-8]


def number_edges(df: DataFrame, value: str, nbins: int, include_zeros: bool = False) -> list[float]:
    """Edges at the ranks rint(k (n - 1) / nbins): as many rows in each bin. Zeros count only if included."""
    df = df if include_zeros else df.where(F.col(value) != 0)
    counts = running(distinct_counts(df, value)).withColumn("upto", F.col("before") + F.col("n"))
    n = counts.agg(F.sum("n")).first()[0]
    ranks = [int(round(k * (n - 1) / nbins)) for k in range(nbins + 1)]
    wanted = counts.sparkSession.createDataFrame([(k, r) for k, r in enumerate(ranks)], "k int, r long")
    found = counts.join(F.broadcast(wanted), (F.col("before") <= F.col("r")) & (F.col("r") < F.col("upto"))).select("k", "v").collect()
    edges = [v for _, v in sorted((r["k"], r["v"]) for r in found)]
    return edges[:-1] + [edges[-1] + 1e-8]


def weight_edges(df: DataFrame, value: str, weight: str, nbins: int, include_zeros: bool = False) -> list[float]:
    """Inner edges at the least value whose running weight is more than k / nbins of all; outer edges are infinite."""
    df = df if include_zeros else df.where(F.col(value) != 0)
    w = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(F.col(weight).cast("double")).alias("w"))
    upto = running(w, weight="w").withColumn("upto", F.col("before") + F.col("w"))
    total = upto.agg(F.sum("w")).first()[0]
    bounds = upto.sparkSession.createDataFrame([(k, k * total / nbins) for k in range(1, nbins)], "k int, b double")
    found = upto.join(F.broadcast(bounds), F.col("upto") > F.col("b")).groupBy("k").agg(F.min("v").alias("v")).collect() if nbins > 1 else []
    return [float("-inf"), *[v for _, v in sorted((r["k"], r["v"]) for r in found)], float("inf")]


def discretise(df: DataFrame, value: str, edges: list[float], include_zeros: bool = False) -> DataFrame:
    """Rows with ``bin``: the edges at or below the value (0: below the first, or masked)."""
    v = F.col(value).cast("double")
    inside = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v))
    return df.withColumn("bin", F.when(v.isNull() | F.isnan(v), F.lit(None)).when(F.lit(not include_zeros) & (v == 0), 0).otherwise(inside))


def bin_labels(spark, edges: list[float]) -> DataFrame:
    """(bin, label): ``low to high`` with two decimals."""
    return spark.createDataFrame([(k, f"{a:.2f} to {b:.2f}") for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False), 1)], "bin int, label string")


def even_slices(df: DataFrame, order: str, parts: int) -> DataFrame:
    """Rows with ``slice`` 0..parts-1: consecutive runs with bounds at rint(k n / parts)."""
    ranked = running(df.withColumn("v", F.col(order)).withColumn("n", F.lit(1))).withColumnRenamed("before", "row")
    n = df.count()
    bounds = [round(k * n / parts) for k in range(1, parts)]
    inside = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("row"))) if bounds else F.lit(0)
    return ranked.withColumn("slice", inside).drop("v", "n")
