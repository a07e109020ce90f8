"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

Terms are the lower-case runs of letters and digits of a text. The lexicon holds the
terms whose document frequency is within a band given as shares of the distinct texts
(the band of inverse document frequencies): at most (mean distinct terms of a text)
/ ``least_share`` terms, whatever the corpus. Copies of a text count once, so that they do not push
their own terms out. Of a text, the distinct terms that are
in the lexicon are sorted (by their 64-bit hashes), and one hash is taken of those in each of several random
subsets of the lexicon. A text with fewer than ``few`` terms in the band takes those
more frequent than the band as well. Subsets keep from a half to a small part of the lexicon, so
that both short and long texts have subsets that an edit leaves alone.

Two fingerprints are alike by the share of subsets with equal hashes, among the
subsets in which either text has a term, at the rate where that share is largest.

Defined results: a text without such terms is fingerprinted by its very
characters (``e:``); such fingerprints are alike (1) only when equal. A null text is empty. Equal texts have
equal fingerprints; repeated rows are equal rows. Rows are ordered by doc_id (nulls
first) and then by a hash of the text; rows equal in both count as one document and
get equal results. In a table of one document the next document is itself. An empty
table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, materialise


@dataclass(frozen=True)
class IMatchParams:
    """Band of document shares, and the random subsets: ``each`` for each rate 1/2, 1/4, ..."""

    least_share: float = 0.0005
    most_share: float = 0.05
    least_documents: int = 2
    rates: int = 8
    each: int = 6
    few: int = 3  #: terms in the band below which the more frequent ones are taken as well
    broadcast_terms: int = 500_000  #: terms of a lexicon sent to every task at most
    broadcast_texts: int = 500_000  #: hashes of repeated texts sent to every task at most


def terms(text: Column) -> Column:
    """Distinct terms of a text, as an array."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def distinct_texts(rows: DataFrame, p: IMatchParams) -> DataFrame:
    """Rows (doc_id, text), those of one text but for one: by a narrow table of the texts that several ids have."""
    h = F.xxhash64("text")
    keys = rows.select(h.alias("t"), F.xxhash64("doc_id").alias("o"))
    several = keys.groupBy("t").agg(F.min("o").alias("one"), F.count(F.lit(1)).alias("times")).where("times > 1")
    several = materialise(several.select("t", "one"), "repeated")
    several = F.broadcast(several) if several.count() <= p.broadcast_texts else several
    own = rows.select("text", h.alias("h"), F.xxhash64("doc_id").alias("o")).join(several, F.col("h") == F.col("t"), "left")
    return own.where(F.col("one").isNull() | (F.col("one") == F.col("o"))).select("text")


def lexicon(texts: DataFrame, p: IMatchParams) -> DataFrame:
    """(term, h, subsets, frequent): terms within the band or more frequent, their hashes and the bits of the subsets they are in."""
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    low, high = max(p.least_documents, p.least_share * n), max(p.least_documents, p.most_share * n)
    inside = counts.where(F.col("df") >= low).select("term", F.xxhash64("term").alias("h"), (F.col("df") > high).alias("frequent"))
    bits = F.lit(0).cast("long")
    for k in range(p.rates * p.each):
        rate = 2 ** (k // p.each + 1)
        chosen = F.pmod(F.xxhash64(F.lit(k), F.col("term")), F.lit(rate)) == 0
        bits = bits.bitwiseOR(F.when(chosen, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    found = materialise(inside.withColumn("subsets", bits), "lexicon")
    return F.broadcast(found) if found.count() <= p.broadcast_terms else found


#: What ``xxhash64`` gives for an empty array: its fixed seed.
NONE = 42


def fingerprint(found: Column, p: IMatchParams) -> Column:
    """The fingerprint of a text with these terms of the lexicon (sorted array of h, subsets, frequent)."""
    inside = lambda t, m: t["subsets"].bitwiseAND(m) != F.lit(0).cast("long")

    def of_rate(chosen: Column, r: int) -> Column:
        """Hashes of a rate's subsets, among the terms that are in any of them."""
        bits = [1 << (r * p.each + i) for i in range(p.each)]
        some = F.filter(chosen, lambda t: inside(t, F.lit(sum(bits)).cast("long")))
        masks = F.array(*[F.lit(x).cast("long") for x in bits])
        # the array of one binds the filtered terms, so that they are not filtered anew for each subset
        return F.flatten(F.transform(F.array(some), lambda s: F.transform(masks, lambda m: F.xxhash64(F.filter(s, lambda t: inside(t, m))))))

    band = F.filter(found, lambda t: ~t["frequent"])
    chosen = F.transform(F.array(F.struct(band.alias("band"), found.alias("every"))), lambda x: F.when(F.size(x["band"]) >= p.few, x["band"]).otherwise(x["every"]))
    hashes = F.flatten(F.transform(chosen, lambda c: F.concat(*[of_rate(c, r) for r in range(p.rates)])))
    parts = F.transform(hashes, lambda h: F.when(h == NONE, F.lit("-")).otherwise(F.substring(F.lpad(F.lower(F.hex(h)), 16, "0"), 9, 8)))
    return F.when(F.size(found) > 0, F.concat(F.lit("i:"), F.concat_ws(".", parts)))


def fingerprints(texts: DataFrame, words: DataFrame, p: IMatchParams) -> DataFrame:
    """(kid, h, kind, fact, fingerprint) for rows (kid, h, kind, fact, text); fact goes along.

    The rows of a text stay in their task: its terms are laid out, met with the
    lexicon and put together again under the partitioning the rows came with.
    """
    # the row that carries the fact has a term of its own that no lexicon has, so that such rows don't meet in one task
    first = F.array(F.struct(F.concat(F.lit(" "), F.col("h").cast("string")).alias("term"), F.concat(F.coalesce("fact", F.lit("")), F.lit("/"), F.md5("text")).alias("fact")))
    rest = F.transform(terms(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit(None).cast("string").alias("fact")))
    laid = texts.select("kid", "h", "kind", F.explode(F.concat(first, rest)).alias("x")).select("kid", "h", "kind", "x.term", "x.fact")
    met = laid.join(words.withColumnRenamed("h", "word"), "term", "left").where("subsets is not null or fact is not null")
    entry = F.when(F.col("subsets").isNotNull(), F.struct(F.col("word").alias("h"), "subsets", "frequent"))
    out = met.groupBy("kid", "h", "kind").agg(F.sort_array(F.collect_set(entry)).alias("found"), F.max("fact").alias("fact"))
    fact, plain = F.substring_index("fact", "/", 1), F.substring_index("fact", "/", -1)
    return out.select("kid", "h", "kind", fact.alias("fact"), F.coalesce(fingerprint(F.col("found"), p), F.concat(F.lit("e:"), plain)).alias("fingerprint"))


def agreement(a: Column, b: Column) -> Column:
    """For each subset: 2 if the hashes are equal, 1 if only one has a term or they differ, 0 if neither has one; null for other kinds of fingerprints."""
    x, y = (F.split(F.substr(c, F.lit(3)), r"\.") for c in (a, b))
    codes = F.zip_with(x, y, lambda u, v: F.when((u != "-") & (u == v), 2).when((u != "-") | (v != "-"), 1).otherwise(0))
    return F.when(a.startswith("i:") & b.startswith("i:"), codes)


def likeness(same: Column, codes: Column, p: IMatchParams) -> Column:
    """Equal subset hashes, as a share of the subsets that either fingerprint has, at the rate where that is most.

    A rate counts with three such subsets or more; if none has so many, all count together.
    """
    used = lambda c: F.size(F.filter(c, lambda k: k > 0))
    share = lambda c: F.try_divide(F.size(F.filter(c, lambda k: k == 2)).cast("double"), used(c))
    rates = F.transform(F.sequence(F.lit(0), F.lit(p.rates - 1)), lambda r: F.slice(codes, r * p.each + 1, F.lit(p.each)))
    best = F.array_max(F.transform(rates, lambda c: F.when(used(c) >= 3, share(c))))
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(best, share(codes), F.lit(0.0)))


def next_in_order(keys: DataFrame, partitions: int) -> DataFrame:
    """Rows (doc_id, kid, h, ...) with the key of the next row: (nk, nh), the first after the last.

    Rows are range-partitioned; neighbours are found within partitions, and across
    them by a table with one row for each partition.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ranged = materialise(keys.repartitionByRange(partitions, *order).withColumn("p", F.spark_partition_id()), "ordered")
    here = F.struct("kid", "h")
    inner = Window.partitionBy("p").orderBy(*order)
    ends = ranged.groupBy("p").agg(F.min_by(here, F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("head"))
    across = Window.orderBy("p")  # one row for each partition of the range
    ends = ends.select("p", F.coalesce(F.lead("head").over(across), F.first("head").over(across)).alias("head"))
    ranged = ranged.withColumn("next", F.lead(here).over(inner)).join(F.broadcast(ends), "p")
    ranged = ranged.withColumn("next", F.coalesce("next", "head"))
    return ranged.select(*keys.columns, F.col("next.kid").alias("nk"), F.col("next.h").alias("nh"))


def edited_fingerprints(docs: DataFrame, p: IMatchParams | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text.

    Texts are shuffled once, by key, and the first quarters of the next texts once.
    """
    p = p or IMatchParams()
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = lexicon(distinct_texts(rows, p), p)
    # keys without nulls: whether there is an id is part of the text's hash
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("kid"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")
    keys = rows.groupBy("doc_id", "kid", "h").agg(F.first(F.length("text")).cast("long").alias("n"), F.count(F.lit(1)).alias("times"))
    order = materialise(next_in_order(keys, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "next")
    free_shuffles(spark)
    before = order.select(F.col("nk").alias("kid"), F.col("nh").alias("h"), F.col("kid").alias("to_kid"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    # each text meets what it gives to the text before it, and then what the text after it gives
    texts = rows.select("kid", "h", "text").join(before, ["kid", "h"])
    gifts = texts.select(F.col("to_kid").alias("kid"), F.col("to_h").alias("h"), F.substr("text", F.lit(1), F.col("take")).alias("head")).groupBy("kid", "h").agg(F.first("head").alias("head"))
    pairs = texts.select("kid", "h", "text", F.concat_ws("|", "to_kid", "to_h").alias("before")).join(gifts, ["kid", "h"])
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), "head")
    pairs = pairs.select("kid", "h", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("fact"), "text"), F.struct(F.lit(1).alias("kind"), F.sha2(F.encode(edited, "utf-8"), 256).alias("fact"), edited.alias("text")))).alias("x"))
    named = fingerprints(pairs.select("kid", "h", "x.*"), words, p)
    only = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    named = named.groupBy("kid", "h").agg(only(0, "fact").alias("before"), only(1, "fact").alias("edited_sha256"), only(0, "fingerprint").alias("fingerprint"), only(1, "fingerprint").alias("edited_fingerprint"))
    named = materialise(named, "fingerprints")
    free_shuffles(spark)
    # each fingerprint goes to the text before it
    to = [F.substring_index("before", "|", k).cast("long") for k in (1, -1)]
    after = named.select(to[0].alias("kid"), to[1].alias("h"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["kid", "h"])
    out = named.drop("before").join(order, ["kid", "h"]).join(after, ["kid", "h"])
    pairs_of = {"near_edited": F.col("edited_fingerprint"), "near_next": F.col("next_fingerprint")}
    mine = F.col("fingerprint")
    out = out.select("*", *[agreement(mine, other).alias(f"{name}_codes") for name, other in pairs_of.items()])
    near = [likeness(mine == other, F.col(f"{name}_codes"), p).alias(name) for name, other in pairs_of.items()]
    out = out.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", *near, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return out.drop("time")


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
