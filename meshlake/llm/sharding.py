"""Shards by extendible hashing: a directory of hash prefixes that splits where a bucket is too large.

A row's hash is a run of bits from its key, followed by bits from its number in the
table as written down. A bucket holds the rows of one prefix. While its bytes exceed
the limit it splits on the next bit, and no other bucket does. Rows of one key share
all key bits; if they alone exceed the limit, their buckets go on to split on the
bits of the row numbers.

Bytes are summed for prefixes of ``step`` bits at a time, for oversized buckets
only. The directory is a table, written down round by round; the driver holds none of it.

Defined results: a bucket of one row is never split, so a row larger than the limit
is a shard of its own; a bucket of several rows that is too large at 120 bits still stays
whole (rows whose hashes agree in all bits). A null key hashes like the text ``null``. Null and empty texts
count ``overhead`` bytes. Repeated rows are rows of their own. An empty table gives an
empty result. Other columns of the input are not read. While no bucket is too large,
all rows are in the shard of the empty prefix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEY_BITS = 60  #: hexadecimal digits of the key's MD5 that are used, times four


@dataclass(frozen=True)
class ShardParams:
    limit: int = 1 << 20  #: bytes of a shard at most
    overhead: int = 16  #: bytes of a row besides its text
    step: int = 8  #: bits by which a round of counting goes deeper
    broadcast_entries: int = 1_000_000  #: directory entries sent to every task at most


def prefix(depth: int):
    """The first ``depth`` bits of a row's hash, as text of 0 and 1."""
    return F.substring("bits", 1, depth)


def hashed(docs: DataFrame, p: ShardParams) -> DataFrame:
    """(doc_id, bytes, bits) of every row, written down so that row numbers stay."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + p.overhead
    digest = lambda c: F.lpad(F.conv(F.substring(F.md5(c), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")
    rows = docs.select("doc_id", size.alias("bytes"), F.monotonically_increasing_id().alias("row"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")
    return materialise(rows.select("doc_id", "bytes", F.concat(digest(key), digest(F.col("row").cast("string").cast("binary"))).alias("bits")), "hashed")


def assign_shards(docs: DataFrame, p: ShardParams | None = None) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes) of every row of ``docs`` (doc_id, text).

    A round counts the leaves ``step`` bits below its open buckets (the first round as
    many bits as the mean bucket needs), sums them for the buckets between, and gives
    each leaf the shallowest bucket that fits; leaves without one are open for the next.
    """
    p = p or ShardParams()
    rows = hashed(docs, p)
    total, n = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    if total <= p.limit or n <= 1:
        return rows.select("doc_id", "bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(total).cast("long").alias("shard_bytes"))
    depth, step, some, out = 0, max(p.step, min(30, (total // p.limit).bit_length() + 1)), rows, []
    small = lambda t: F.broadcast(t) if t.count() <= p.broadcast_entries else t
    while True:
        deeper = min(depth + step, 2 * KEY_BITS)
        leaves = materialise(some.groupBy(prefix(deeper).alias("leaf")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")), "leaves")
        above = leaves.withColumn("depth", F.explode(F.sequence(F.lit(depth + 1), F.lit(deeper)))).withColumn("shard", F.expr("substring(leaf, 1, depth)"))
        buckets = above.groupBy("shard", "depth").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("rows"))
        fits = (F.col("shard_bytes") <= p.limit) | (F.col("rows") == 1) | (F.col("depth") >= 2 * KEY_BITS)
        own = above.select("leaf", "shard").join(buckets.where(fits), "shard").groupBy("leaf").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("s"))
        entries = materialise(leaves.select("leaf").join(own, "leaf", "left").select("leaf", "s.shard", "s.depth", "s.shard_bytes"), "directory")
        found = small(entries.where("shard is not null"))
        out.append(some.join(found, prefix(deeper) == F.col("leaf")).select("doc_id", "bytes", "shard", "depth", "shard_bytes"))
        heads = entries.where("shard is null").select("leaf")
        if heads.isEmpty():
            return reduce(DataFrame.unionByName, out)
        some, depth, step = rows.join(small(heads), prefix(deeper) == F.col("leaf"), "left_semi"), deeper, p.step


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, at most 1 MiB of text and row overhead each."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op7_sharding": """
WITH RECURSIVE h AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS bytes,
         ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS k
  FROM documents
), b(depth, k, bytes, doc_id, shard, total, n) AS (
  SELECT 0, k, bytes, doc_id, '', sum(bytes) OVER (), count(*) OVER () FROM h
  UNION ALL
  SELECT depth + 1, k, bytes, doc_id,
         shard || CAST((k >> (59 - depth)) & 1 AS VARCHAR),
         sum(bytes) OVER (PARTITION BY shard || CAST((k >> (59 - depth)) & 1 AS VARCHAR)),
         count(*) OVER (PARTITION BY shard || CAST((k >> (59 - depth)) & 1 AS VARCHAR))
  FROM b WHERE total > 1048576 AND n > 1 AND depth < 60
)
SELECT doc_id, bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(total AS BIGINT) AS shard_bytes
FROM b WHERE total <= 1048576 OR n = 1
""",
}
