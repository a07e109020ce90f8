"""Exact n-gram Jaccard self-join by vertical partitioning of the global n-gram order.

The n-grams of a document are 64-bit hashes. In the global order those come first that
are not known to be frequent, by hash, and then the frequent ones, the rarest first.
Of their first n-grams in that order (as many as they may lack, one, and some spare
ones) two similar sets have one more in common than there are spare ones, so documents
that share so many are the candidates; of n-grams that make large groups a set may leave
out as many as are spare. A sketch of each set, of which every difference of two sets turns one bit, rules
candidates out that differ in more bits than a similar pair may. For the pairs left,
the order is cut into fragments, overlaps are counted fragment by fragment and summed
per pair, and the sum decides.

Which n-grams are frequent is counted within tasks; that only orders them, and any order
gives the same links. Equal sets are one class with one representative. Pairs whose ends
are already connected by verified ones need no count. In a group of many sets that share
a first n-gram no pairs are formed of all with all: each member is counted against one
pivot, the member with most such n-grams. Where that leaves a group in several
components, members are told apart by what they differ from the pivot in:
|x ^ y| = |(x ^ p) ^ (y ^ p)|, so two sets of which one is not similar to the pivot can
only be similar if they share enough of their differences, and a prefix of the rarest
differences finds those pairs. Components are exact; links inside a component need not
all be enumerated.

Defined results: null and empty texts, or texts without words, have an empty set and
are linked with nothing, their component being their own id. With fewer words than
an n-gram has, the whole sequence is the one n-gram. Repeated rows are rows of one
class. A null doc_id takes part with its text; its component is the least non-null
id of its component, or null. An empty table gives an empty result. Other columns of
the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_shuffles, materialise, portions, texts_of, word_hashes
from .components import component_labels

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: lower-cases A-Z and makes tab, line ends and the like a blank
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
SKETCH = 8  #: words of 64 bits of a sketch


@dataclass(frozen=True)
class JoinParams:
    """n-gram length, least similarity in hundredths, and shape of the search."""

    words: int = 5
    percent: int = 80
    common_key: int = 32  #: sets from which on an n-gram is frequent, and its group large
    spare: int = 3  #: first n-grams beyond those needed, and one more for every eight of these
    frequent: int = 1 << 20  #: frequent n-grams known by name at most, the most frequent; others are ordered by hash
    count_rows: int = 1_500_000  #: n-grams counted at once in a task
    count_fragments: int = 4  #: fragments in which overlaps of a pair are counted
    broadcast_ids: int = 1_000_000  #: ids sent to every task at most, else a shuffled join
    batch_bytes: int = 250_000


def needed(n: int, p: JoinParams) -> int:
    """First n-grams of a set of n of which a similar set has one at least: as many as it may lack, and one."""
    return n + 1 + (-p.percent * n) // 100


def spared(n: int, p: JoinParams) -> int:
    """First n-grams taken beyond those; no more for smaller sets."""
    return min(p.spare + needed(n, p) // 8, n - needed(n, p))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for j in range(k):
        out = mix(out * M1 + h[j : len(h) - k + 1 + j])
    return out


def ngram_sets(texts: list, k: int, batch_bytes: int = 250_000):
    """Sorted distinct 64-bit hashes of the word n-grams of each whole text (bytes, str or None)."""
    for lo, hi in portions(texts, batch_bytes):
        h, at = word_hashes(texts[lo:hi], LOWER)
        every = chain(h, k) if len(h) >= k else h[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            g = np.sort(every[a : b - k + 1] if b - a >= k else chain(h[a:b], b - a) if b > a else h[:0])
            yield g[np.append(True, g[1:] != g[:-1])] if len(g) > 1 else g


def ngrams(text: str | None, k: int) -> np.ndarray:
    """The set of one text."""
    return next(iter(ngram_sets([text], k)))


def signature(grams: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(np.bitwise_xor.reduce(grams * M1)[None] + np.uint64(len(grams)))[0].astype(np.int64))


def second_signature(grams: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(grams), dtype=np.uint64)[None])[0].astype(np.int64))


def sketch(grams: np.ndarray) -> list[int]:
    """For each of some numbers of bits whether an odd number of n-grams falls on it: two sets differ in no more bits than n-grams."""
    bits = np.bincount((mix(grams ^ M3) >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def frequent_ngrams(docs: DataFrame, p: JoinParams) -> np.ndarray:
    """The n-grams that many texts have, as far as tasks see them repeated: the rarest first.

    A task counts ``count_rows`` n-grams at a time and tells of those it meets twice;
    their sums are n-grams of that many texts at least.
    """

    def run(batches):
        seen, held, size = set(), [], 0

        def told():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])], ["g", "n"])

        for b in batches:
            for g in ngram_sets(texts_of(b), p.words, p.batch_bytes):
                if len(g) and (sig := signature(g)) not in seen:
                    seen.add(sig)
                    held.append(g)
                    size += len(g)
                    if size >= p.count_rows:
                        yield told()
                        seen, held, size = set(), [], 0
        if held:
            yield told()

    counts = docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= p.common_key).orderBy(F.col("n").desc(), "g").limit(p.frequent)
    return top.select("g").toPandas()["g"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def read_sets(docs: DataFrame, frequent: np.ndarray, p: JoinParams) -> DataFrame:
    """(doc_id, bytes, n, sig, sig2, first, light, slack, sketch) of every row; the last four once a task for each set.

    ``first`` has the first n-grams in the global order, of which ``light`` are not
    frequent; ``slack`` is the least number of spare ones that it or a similar set has.
    """
    spark = docs.sparkSession
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], order))

    def run(batches):
        known, rank = shared.value
        seen = set()
        for b in batches:
            rows, texts = [], texts_of(b)
            for g in ngram_sets(texts, p.words, p.batch_bytes):
                if not len(g):
                    rows.append((0, 0, 0, None, 0, 0, None))
                    continue
                sig, rest = signature(g), (None, 0, 0, None)
                if sig not in seen:
                    seen.add(sig)
                    size = needed(len(g), p) + spared(len(g), p)
                    at = np.minimum(np.searchsorted(known, g), max(0, len(known) - 1))
                    heavy = known[at] == g if len(known) else np.zeros(len(g), bool)
                    light = g[~heavy][:size]
                    if len(light) < size:
                        light_n, own = len(light), rank[at[heavy]]
                        first = np.concatenate([light, g[heavy][np.argsort(own)][: size - light_n]])
                    else:
                        light_n, first = size, light
                    rest = (first.view(np.int64), light_n, spared(-(-p.percent * len(g) // 100), p), sketch(g))
                rows.append((len(g), sig, second_signature(g), *rest))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "bytes", "n", "sig", "sig2", "first", "light", "slack", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bytes long, n int, sig long, sig2 long, first array<long>, light int, slack int, sketch array<long>")


def cut_fragments(docs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """(sig, fragment, grams) of the sets of ``nodes`` (sig, doc_id, bytes), read again from their texts."""
    wanted = nodes.select("doc_id", "bytes", F.col("sig").alias("want"))
    if wanted.count() <= p.broadcast_ids:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (F.octet_length(docs["text"]) == wanted["bytes"])).select("text", "want")

    def cut(batches):
        edges = (np.arange(1, p.count_fragments, dtype=np.uint64) << np.uint64(32)) // np.uint64(p.count_fragments) << np.uint64(32)
        for b in batches:
            rows = []
            for g, want in zip(ngram_sets(texts_of(b), p.words, p.batch_bytes), b.column("want").to_pylist(), strict=True):
                if len(g) and signature(g) == want:
                    rows += [(want, i, part.view(np.int64)) for i, part in enumerate(np.split(g, np.searchsorted(g, edges)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["sig", "fragment", "grams"])

    return materialise(texts.mapInArrow(cut, "sig long, fragment int, grams array<long>"), "fragments")


def as_pairs(rows: DataFrame, p: JoinParams, x: str = "x", y: str = "y", nx: str = "nx", ny: str = "ny") -> DataFrame:
    """(a, b, na, nb) once for each pair of sets x and y of sizes nx and ny that may be similar."""
    fit = rows.where(F.least(nx, ny) * 100 >= p.percent * F.greatest(nx, ny))
    first = F.col(x) > F.col(y)
    return fit.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb")).distinct()


def similar_pairs(pairs: DataFrame, fragments: DataFrame, p: JoinParams) -> DataFrame:
    """Those of ``pairs`` (a, b, na, nb) that are similar, by sums of their fragments' overlaps.

    Fragments are counted one after another. What two sets differ by in the fragments
    counted so far can only grow, so a pair goes no further once that exceeds what a
    similar pair of their sizes may differ by.
    """
    t = p.percent
    left = materialise(pairs.select("a", "b", "na", "nb", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("differ")), "pairs")
    for k in range(p.count_fragments):
        part = fragments.where(F.col("fragment") == k)
        x, y = (part.select(F.col("sig").alias(c), F.col("grams").alias(f"g{c}")) for c in "ab")
        both = left.join(x, "a").join(y, "b")
        here = F.size(F.array_intersect("ga", "gb"))
        counted = both.select("a", "b", "na", "nb", (F.col("shared") + here).alias("shared"), (F.col("differ") + F.size("ga") + F.size("gb") - 2 * here).alias("differ"))
        # repeated rows of one text give equal counts
        counted = counted.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("na", "nb", "shared", "differ")])
        before, left = left, materialise(counted.where(F.col("differ") * (100 + t) <= (100 - t) * (F.col("na") + F.col("nb"))), "counted")
        discard(before)
        free_shuffles(pairs.sparkSession)
    return left.where(F.col("shared") * 100 >= t * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def shared_ngrams(sets: DataFrame, p: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Rows (key, sig, n, place, free) of the first n-grams of two sets or more, and (key, sig, n) of those of large groups.

    Of two similar sets' first n-grams more are common than either's slack. ``free`` is
    the slack that its n-grams in large groups leave a set: where some is left, the set
    does without those groups, as more than ``free`` others are common with a similar set.
    N-grams known as frequent make large groups whatever their count, so that the
    window below has only such keys as no task met often.
    """
    laid = sets.where("first is not null").select("sig", "n", "light", "slack", F.posexplode("first").alias("place", "key"))
    key = Window.partitionBy("key")
    rows = laid.where("place < light").select("key", "sig", "n", "slack", "place")
    rows = rows.withColumn("low", F.min("sig").over(key)).withColumn("high", F.max("sig").over(key)).withColumn("large", F.count(F.lit(1)).over(key) >= p.common_key)
    rows = materialise(rows.where("low < high").drop("low", "high").distinct(), "shared-ngrams")
    large = laid.where("place >= light").select("key", "sig", "n", "slack").distinct().unionByName(rows.where("large").select("key", "sig", "n", "slack"))
    large = materialise(large, "in-large-groups")
    taken = large.groupBy("sig").agg(F.count(F.lit(1)).alias("taken"))
    taken = materialise(taken, "taken")
    taken = F.broadcast(taken) if taken.count() <= p.broadcast_ids else taken
    free = F.col("slack") - F.coalesce("taken", F.lit(0))
    small = rows.where("not large").join(taken, "sig", "left").select("key", "sig", "n", "place", free.alias("free"))
    return small, large.join(taken, "sig").where(free < 0).select("key", "sig", "n")


def pairs_by_ngram(small: DataFrame, p: JoinParams) -> DataFrame:
    """Candidates of groups that are not large: those that have as many first n-grams in common as similar sets must.

    Of the smaller set fewer first n-grams are looked at, as its overlap is a larger share of it.
    """
    t = p.percent
    x, y = (small.select("key", F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("place").alias(f"p{c}"), F.col("free").alias(f"free_{c}")) for c in "xy")
    larger = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") > F.col("y")))
    fit = F.col("ny") * 100 >= t * F.col("nx")
    most = lambda n: n + 1 - F.ceil(t * n / 100 - 1e-9)
    spare = F.least(p.spare + F.floor(most(F.col("ny")) / 8), F.col("ny") - most(F.col("ny")))
    indexed = F.col("py") < F.col("ny") - F.ceil(2 * t * F.col("ny") / (100 + t) - 1e-9) + 1 + spare
    met = x.join(y, "key").where(larger & fit & indexed).groupBy("x", "y").agg(F.count(F.lit(1)).alias("keys"), *[F.first(c).alias(c) for c in ("nx", "ny", "free_x", "free_y")])
    return as_pairs(met.where(F.col("keys") > F.greatest("free_x", "free_y", F.lit(0))), p)


def near_pairs(pairs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """Those of ``pairs`` whose sketches differ in no more bits (``bits``) than a similar pair may in n-grams."""
    t = p.percent
    a, b = (nodes.select(F.col("sig").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH)])
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", bits.alias("bits"))
    return both.where(F.col("bits") * (100 + t) <= (100 - t) * (F.col("na") + F.col("nb")))


def nearest_pairs(pairs: DataFrame) -> DataFrame:
    """For each set the pair whose sketches differ least."""
    ends = pairs.select("*", F.explode(F.array("a", "b")).alias("end"))
    best = ends.groupBy("end").agg(F.min(F.struct("bits", "a", "b", "na", "nb")).alias("m"))
    return best.select("m.a", "m.b", "m.na", "m.nb").distinct()


def links_by_difference(members: DataFrame, fragments: DataFrame, p: JoinParams) -> DataFrame:
    """Similar pairs (a, b) among ``members`` (pivot, np, x, nx, label) of one pivot and different labels.

    With D the difference from the pivot, r = (100 - t) / (100 + t) and s = |D| - r n,
    x and y are similar only if |Dx & Dy| >= (sx + sy) / 2 =: o. At least one of a pair
    of different labels is apart, not similar to the pivot: an apart set is looked up
    against all, the others against the apart only, so s of the partner is at least
    ``sl`` or ``su``. As |Dx| - |Dy| <= r (nx + ny), also o >= |Dx| - r nx (1 + 100 / t).
    So the first |D| - o + 1 of each in one order, what the pivot lacks before what it
    has, have an n-gram in common, and of the first such one enough are left in both.
    For those pairs the overlaps of what the pivot lacks and of what it has are counted
    apart and summed: |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|.
    """
    t = p.percent
    star = members.where("x <> pivot")
    x, y = (fragments.select(F.col("sig").alias(c), "fragment", F.col("grams").alias(g)) for c, g in (("x", "gx"), ("pivot", "gp")))
    both = star.join(x, "x").join(y, ["pivot", "fragment"])
    parts = both.select("pivot", "np", "x", "nx", "label", "fragment", F.array_except("gx", "gp").alias("more"), F.array_except("gp", "gx").alias("less")).dropDuplicates(["pivot", "x", "fragment"])
    whole = parts.groupBy("pivot", "x").agg(*[F.first(c).alias(c) for c in ("label", "nx", "np")], F.flatten(F.collect_list("more")).alias("more"), F.flatten(F.collect_list("less")).alias("less"))
    whole = whole.withColumn("d", F.size("more") + F.size("less"))
    whole = materialise(whole.withColumn("s", F.col("d") * (100 + t) - F.col("nx") * (100 - t)).withColumn("apart", F.col("s") > F.col("np") * (100 - t)), "differences")
    least = whole.groupBy("pivot").agg(F.min("s").alias("sl"), F.min(F.when(F.col("apart"), F.col("s"))).alias("su"))
    least = least.where("su is not null")
    far = F.ceil(F.col("d") - F.col("nx") * ((100 - t) / t) - 1e-9)
    most = F.when(F.col("apart"), F.col("sl")).otherwise(F.col("su"))
    need = F.greatest(F.lit(1), F.ceil((F.col("s") + most) / (2 * (100 + t)) - 1e-9), far)
    order = F.concat(F.sort_array("more"), F.sort_array("less"))
    size = F.greatest(F.lit(0), F.col("d") - need + 1).cast("int")
    rows = whole.join(least, "pivot").select("pivot", "x", "label", "apart", "d", "s", F.posexplode(F.slice(order, F.lit(1), size)).alias("rank", "g"))
    rows = materialise(rows, "prefixes")
    index = rows.select("pivot", "g", F.col("x").alias("y"), F.col("label").alias("ly"), F.col("s").alias("sy"), (F.col("d") - F.col("rank")).alias("rest_y"))
    probe = rows.where("apart").select("pivot", "g", "x", "label", "s", (F.col("d") - F.col("rank")).alias("rest"))
    enough = F.least("rest", "rest_y") * (2 * (100 + t)) >= F.col("s") + F.col("sy")
    found = probe.join(index, ["pivot", "g"]).where((F.col("label") != F.col("ly")) & enough).select("pivot", "x", "y").distinct()
    x, y = (whole.select("pivot", F.col("x").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("more", "less", "d", "nx")]) for c in "xy")
    both = found.join(x, ["pivot", "x"]).join(y, ["pivot", "y"])
    shared = F.size(F.array_intersect("more_x", "more_y")) + F.size(F.array_intersect("less_x", "less_y"))
    similar = both.where((F.col("d_x") + F.col("d_y") - 2 * shared) * (100 + t) <= (100 - t) * (F.col("nx_x") + F.col("nx_y")))
    return similar.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def ngram_components(docs: DataFrame, p: JoinParams | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs`` (doc_id, text)."""
    p = p or JoinParams()
    spark = docs.sparkSession
    sets = materialise(read_sets(docs, frequent_ngrams(docs, p), p), "sets")
    small, large = shared_ngrams(sets, p)
    large = materialise(large, "large")
    free_shuffles(spark)
    fame = large.groupBy("sig").agg(F.count(F.lit(1)).alias("fame"))
    pivots = large.join(fame, "sig").groupBy("key").agg(F.max(F.struct("fame", "sig", "n")).alias("p"))
    pivots = materialise(pivots.select("key", F.col("p.sig").alias("pivot"), F.col("p.n").alias("np")), "pivots")
    stars = large.join(F.broadcast(pivots) if pivots.count() <= p.broadcast_ids else pivots, "key")
    stars = materialise(stars.select(F.col("sig").alias("x"), F.col("n").alias("nx"), "pivot", "np").distinct(), "stars")
    pairs = pairs_by_ngram(small, p).unionByName(as_pairs(stars.where("x <> pivot"), p, y="pivot", ny="np")).distinct()
    pairs = materialise(pairs, "candidates")
    free_shuffles(spark)
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(stars.select("x")).distinct()
    nodes = sets.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("doc_id", "bytes")).alias("d"), F.first("sketch", ignorenulls=True).alias("sketch"))
    nodes = materialise(nodes.select("sig", "d.doc_id", "d.bytes", "sketch"), "nodes")
    near = materialise(near_pairs(pairs, nodes, p), "near")
    discard(pairs, large, pivots)
    members = near.select(F.col("a").alias("sig")).union(near.select("b")).union(stars.select("x")).distinct()
    fragments = cut_fragments(docs, nodes.join(members, "sig", "left_semi"), p)
    free_shuffles(spark)
    # first the nearest pair of each set; what these connect needs no further count
    links = materialise(similar_pairs(nearest_pairs(near), fragments, p), "links")
    labels = component_labels(links)
    side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    apart = near.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    links, labels = more_links(links, labels, similar_pairs(apart.select("a", "b", "na", "nb"), fragments, p))
    discard(near)
    free_shuffles(spark)
    members = stars.join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    mixed = members.groupBy("pivot").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("pivot")
    members = materialise(members.join(mixed, "pivot", "left_semi").select("pivot", "np", "x", "nx", "label"), "members")
    if not members.isEmpty():
        links, labels = more_links(links, labels, links_by_difference(members, fragments, p))
    discard(fragments, stars, members)
    free_shuffles(spark)
    # two sets of one 64-bit signature stay two classes
    classes = materialise(sets.where("n > 0").groupBy("sig", "sig2", "n").agg(F.min("doc_id").alias("class_id")), "classes")
    least = labels.join(classes, labels.node == classes.sig).groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = classes.join(labels.withColumnRenamed("node", "sig"), "sig", "left").join(least, "label", "left")
    named = named.select("sig", "sig2", "n", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    rows = sets.select("doc_id", "n", "sig", "sig2").join(named, ["sig", "sig2", "n"], "left")
    whole = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), whole("component_id"), whole("class_id"))


def more_links(links: DataFrame, labels: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links so far and the components they make."""
    found = materialise(found, "found")
    if found.isEmpty():
        return links, labels
    links = materialise(links.unionByName(found), "links")
    return links, component_labels(links)


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at four-word shingles and a similarity of 0.85."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), JoinParams(words=4, percent=85))
