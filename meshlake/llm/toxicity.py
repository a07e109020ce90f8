"""Toxicity scores by non-negative positive-unlabelled learning.

A linear numpy classifier over word and word-beginning presence is trained from
confirmed toxic documents (P) and unlabelled text (U) with the class-prior
corrected risk ``pi * R+(P) + max(0, R-(U) - pi * R-(P))``; where the second part
falls below zero, the step goes against it. All rows take part in the choice of
features and in every step, P and U as far as the caller allows them.

Defined results: a null or empty text has no features, so its score is that of the
intercept. Repeated rows and ties are scored alike, row by row. An empty table gives
an empty result. With no confirmed toxic document the score is exactly 0 everywhere. Label
rows with a null id or label are ignored; of several labels of one id, the largest
counts. Equal rows of an id count once in training. Other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, Remembers, bound_batches, crc_mod, csr, materialise, sum_rows, temporary

WORD = re.compile(r"[^\W\d_]+")
BITS = 20


#: Confirmed ids, or repeated ones, that are sent to every task at most; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000
ENTRIES = 1_000_000  #: of a block of training rows, about
#: Blocks of no more entries (4 bytes each) are added up by the driver, which spares small tables a job a step; the sums are the same.
DRIVER_ENTRIES = 4_000_000
EXACT = float(1 << 22)  #: terms of sums are whole numbers of its inverse: their order changes nothing


@dataclass(frozen=True)
class ToxicityParams:
    """Size of the model and of its training."""

    features: int = 6_000  #: 65,536 at most
    min_documents: int = 3
    least_difference: float = 0.5  #: of a feature's shares in P and U, in units of its spread
    steps: int = 300
    rate: float = 0.05
    l2: float = 2e-4


_WORD, _BEGINNING = zlib.crc32(b"w"), zlib.crc32(b"p")


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: the word, and its beginnings of 5 and 6 letters."""
    mask, n, plain = (1 << BITS) - 1, len(word), word.encode()
    own = zlib.crc32(plain, _WORD) & mask
    if n <= 5:
        return (own,)
    five = zlib.crc32(word[:5].encode(), _BEGINNING)
    return (own, five & mask) if n == 6 else (own, five & mask, zlib.crc32(word[5].encode(), five) & mask)


def document_features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    found: set[int] = set()
    for w in set(WORD.findall((text or "").lower())):
        found.update(word_features(w))
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class ToxicityModel(Remembers):
    feature: np.ndarray  #: sorted feature numbers
    weight: np.ndarray
    bias: float | None  #: none where nothing could be learned: all scores are 0

    def score(self, texts) -> np.ndarray:
        """Probability of toxicity for each text, by a lookup of each distinct word."""
        if self.bias is None:
            return np.zeros(len(texts))
        of, known = self.cache(lambda: (dict(zip(self.feature.tolist(), range(len(self.feature)), strict=True)), {}))
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            hit: set[int] = set()
            for w in set(WORD.findall((text or "").lower())):
                f = known.get(w)
                if f is None:
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    f = known[w] = tuple(of[x] for x in word_features(w) if x in of)
                if f:
                    hit.update(f)
            out[i] = self.bias + (self.weight[np.fromiter(hit, np.int64, len(hit))].sum() if hit else 0.0)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def block_of(rows: list[np.ndarray], in_p: bool, in_u: bool) -> tuple:
    """Training rows (fewer than 65,536, each sorted places of features) by row and by feature."""
    flat, at = csr(rows)
    order = np.argsort(flat, kind="stable")
    own, n = np.unique(flat, return_counts=True)
    row = np.repeat(np.arange(len(rows), dtype=np.uint16), np.diff(at))[order]
    return in_p, in_u, flat.astype(np.uint16), at, row, own, np.concatenate([[0], np.cumsum(n)])


def block_sums(blocks, w: np.ndarray, b: float) -> np.ndarray:
    """For P, then for U: sums of log(1 + e^z) and of sigmoid(z), the number of rows, and sums of sigmoid(z) by feature."""
    out = np.zeros((2, 3 + len(w)))
    for in_p, in_u, flat, at, row, own, by in blocks:
        z = sum_rows(w[flat], at) + b
        sig = np.rint(EXACT / (1 + np.exp(-np.clip(z, -30, 30)))) / EXACT
        loss = (np.rint(np.logaddexp(0, z) * EXACT) / EXACT).sum()
        of_features = sum_rows(sig[row], by)
        for k in np.flatnonzero([in_p, in_u]):
            out[k, :3] += loss, sig.sum(), len(z)
            out[k, 3 + own] += of_features
    return out


def nnpu_descend(sums, in_p: np.ndarray, prior: float, p: ToxicityParams, feature: np.ndarray) -> ToxicityModel:
    """Fit by the non-negative risk estimator; ``sums(w, b)`` are ``block_sums`` of all rows, ``in_p`` the rows of P that have each feature."""
    w, b = np.zeros(len(feature)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, p.steps + 1):
        (loss_p, sig_p, n_p), (loss_u, sig_u, n_u) = (found := sums(w, b))[:, :3]
        of_p, of_u = found[:, 3:]
        # logistic loss: l(z) = log(1 + e^-z); as a negative l(-z); l(z) - l(-z) is linear
        if loss_u / n_u - prior * loss_p / n_p >= 0:
            g = np.append(of_u / n_u - prior * in_p / n_p, sig_u / n_u - prior)
        else:
            g = np.append(prior * of_p / n_p - of_u / n_u, prior * sig_p / n_p - sig_u / n_u)
        g[:-1] += p.l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return ToxicityModel(feature, w, float(b))


def nnpu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, p: ToxicityParams, feature: np.ndarray) -> ToxicityModel:
    """Fit on documents given as places in ``feature``, in this process."""
    if not positive or not unlabelled or prior <= 0:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), None)
    blocks = [block_of(rows[a : a + 60_000], k, not k) for rows, k in ((positive, True), (unlabelled, False)) for a in range(0, len(rows), 60_000)]
    return nnpu_descend(lambda w, b: block_sums(blocks, w, b), np.bincount(csr(positive)[0], minlength=len(feature)), prior, p, feature)


def choose_features(sample: DataFrame, n_positive: int, n_unlabelled: int, p: ToxicityParams) -> np.ndarray:
    """The features (sorted) whose shares in P and U differ most, in units of their spread; counted in tasks."""
    each = sample.select("confirmed", "drawn", F.explode("features").alias("f"))
    counts = each.groupBy("f").agg(F.sum(F.col("confirmed").cast("int")).alias("in_p"), F.sum(F.col("drawn").cast("int")).alias("in_u"))
    rate_p, rate_u = (F.col("in_p") + 0.5) / (n_positive + 1), (F.col("in_u") + 0.5) / (n_unlabelled + 1)
    spread = F.sqrt(rate_u * (1 - F.least(rate_u, F.lit(0.999))) / n_positive + rate_p / n_positive)
    z = F.abs((rate_p - rate_u) / spread).alias("z")
    found = counts.where(F.col("in_p") + F.col("in_u") >= p.min_documents).select("f", z).where(F.col("z") > p.least_difference)
    return np.sort(np.array([r["f"] for r in found.orderBy(F.col("z").desc(), "f").limit(p.features).select("f").collect()], np.int64))


def distinct_rows(texts: DataFrame) -> DataFrame:
    """The distinct rows (doc_id, text); only those of repeated ids are compared."""
    twice = materialise(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    n = twice.count()
    if not n:
        return texts
    twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    return texts.join(twice, "doc_id", "left_anti").unionByName(texts.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def training_blocks(sample: DataFrame, feature: np.ndarray):
    """An RDD of ``block_of`` for all rows (confirmed, features), on the executors' disks; confirmed rows are in P and U, others in U."""
    place = np.full(1 << BITS, -1, np.int32)
    place[feature] = np.arange(len(feature))
    shared = sample.sparkSession.sparkContext.broadcast(place)

    def places(batches):
        for b in batches:
            column = b.column("features")
            at, flat = column.offsets.to_numpy(), shared.value[column.values.to_numpy()]
            kept = np.concatenate([[0], np.cumsum(flat >= 0)])[at]
            flat = flat[at[0] : at[-1]]
            rows = np.split(flat[flat >= 0].astype(np.uint16), (kept - kept[0])[1:-1]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("confirmed"), pa.array([r.tobytes() for r in rows], pa.binary())], ["confirmed", "at"])

    def blocks(rows):
        held, size = {True: [], False: []}, {True: 0, False: 0}
        for confirmed, at in rows:
            held[confirmed].append(np.frombuffer(at, np.uint16))
            size[confirmed] += len(at) // 2
            if size[confirmed] >= ENTRIES or len(held[confirmed]) >= 60_000:
                yield block_of(held[confirmed], confirmed, True)
                held[confirmed], size[confirmed] = [], 0
        for confirmed, some in held.items():
            if some:
                yield block_of(some, confirmed, True)

    # a step's tasks are few and long, twice as many as cores, whatever the input
    parts = sample.select("confirmed", "features").mapInArrow(places, "confirmed boolean, at binary").coalesce(2 * sample.sparkSession.sparkContext.defaultParallelism)
    return parts.rdd.mapPartitions(blocks).persist(StorageLevel.DISK_ONLY), shared


def fit_toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None, train=None) -> ToxicityModel:
    """Train from ``labels`` (doc_id, toxic) and ``docs`` (doc_id, text).

    ``train`` is a predicate on doc_id. P is every document that it allows and labels
    confirm as toxic; U is every document that it allows, whatever its labels. Features
    are counted and chosen in tasks, and each step of the training adds up all rows
    there; the driver gets two numbers a feature from each task.
    """
    p = p or ToxicityParams()
    spark = docs.sparkSession
    nothing = nnpu_fit([], [], 0, p, np.zeros(0, np.int64))
    train = F.lit(True) if train is None else train
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_labels, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not n_toxic:
        return nothing
    confirmed = known.where("toxic = 1").select("doc_id", F.lit(True).alias("confirmed"))
    confirmed = F.broadcast(confirmed) if n_toxic <= BROADCAST_IDS else confirmed

    def read(batches):
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                hit: set[int] = set()
                for w in set(WORD.findall((text or "").lower())):
                    f = known.get(w)
                    if f is None:
                        if len(known) > CACHE_WORDS:
                            known.clear()
                        f = known[w] = word_features(w)
                    hit.update(f)
                found.append(np.sort(np.fromiter(hit, np.int32, len(hit))))
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *found])
            yield pa.RecordBatch.from_arrays([b.column("confirmed"), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["confirmed", "features"])

    bound_batches(spark)
    with temporary(spark):
        texts = distinct_rows(docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).where(train))
        flagged = texts.join(confirmed, "doc_id", "left").select("text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
        sample = materialise(flagged.mapInArrow(read, "confirmed boolean, features array<int>"), "toxic-features")
        sizes = {r["confirmed"]: r["count"] for r in sample.groupBy("confirmed").count().collect()}
        if not sizes.get(True):
            return nothing
        feature = choose_features(sample.withColumn("drawn", F.lit(True)), sizes[True], sum(sizes.values()), p)
        blocks, shared = training_blocks(sample, feature)

        def count(found):
            total = np.zeros(len(feature) + 2)
            for is_p, _, flat, at, *_ in found:
                total[:-2] += np.bincount(flat, minlength=len(feature)) if is_p else 0
                total[-2:] += len(flat), len(at)
            return [total]

        def added(part):
            parts = blocks.mapPartitions(part)
            return sum(parts.collect()) if parts.getNumPartitions() <= 64 else parts.treeReduce(np.add)

        try:
            total = added(count)
            few = blocks.collect() if total[-2:].sum() <= DRIVER_ENTRIES else None
            sums = lambda w, b: added(lambda found: [block_sums(found, w, b)]) if few is None else block_sums(few, w, b)
            return nnpu_descend(sums, total[:-2], min(0.9, n_toxic / n_labels), p, feature)
        finally:
            blocks.unpersist()
            shared.destroy()


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], threshold: float = 0.5, names: tuple[str, str] = ("toxicity_score", "toxicity_predicted")) -> DataFrame:
    """Columns ``keep`` of each row, with score and decision of its whole text in columns ``names``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        for b in batches:
            scores = pa.array(shared.value.score(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), scores], [*keep, names[0]])

    schema = T.StructType([*source.select(*keep).schema, T.StructField(names[0], T.DoubleType())])
    return source.mapInArrow(run, schema).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of held-out ids (crc32 mod 5 is 0) are not used."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, train=crc_mod("doc_id", 5) != 0)
    out = score_toxicity(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"))
