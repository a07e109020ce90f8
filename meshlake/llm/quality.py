"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a text are its words as written, its runs of other characters and, where at
least a quarter of its words repeat the word before, one term for each such repeat. Hashed
terms are weighted by TF-IDF with document frequencies of the whole table, and projected
on the leading singular vectors of the labelled sample, found by a distributed
randomised SVD. The labelled vectors, at most about ``max_labelled``, go to every task,
which takes exact cosine products of its documents with all of them, in blocks, and lets
the nearest vote, weighted by similarity.

Defined results: null and empty texts, and texts of blanks, have one term of their own
and are scored by it like any other. Repeated rows are scored alike. Equal similarities
take the labelled rows in order of their ids, then of their terms. With no labelled row
the score is 0.5. Of several labels of an id the least quality counts. Other columns of
the input are not read.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordIds, add_counts, below_fraction, bound_batches, bounded_rows, crc_mod, csr, discard, free_shuffles, materialise
from .latent import randomised_basis, times, unit

BITS = 15
SIZE = 1 << BITS
SYMBOLS = 1 << 10  #: the first numbers are those of runs of other characters, the last that of repeats
AGAIN = SIZE - 1
TERM = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]+")


@dataclass(frozen=True)
class QualityParams:
    """Bound of the labelled sample, and shape of the space and of the vote."""

    max_labelled: int = 6_000
    rank: int = 48
    rounds: int = 3  #: power iterations
    neighbours: int = 25
    power: float = 4.0  #: of the similarity, as the weight of a vote
    block: int = 512
    seed: int = 11


class TermIds(WordIds):
    """Words are numbered from SYMBOLS on, runs of other characters below."""

    def __missing__(self, term: bytes) -> int:
        h = zlib.crc32(term)
        number = self[term] = SYMBOLS + h % (AGAIN - SYMBOLS) if term[:1].isalnum() or term[:1] >= b"\x80" else h % SYMBOLS
        return number


_terms = TermIds(BITS)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term numbers of a whole text and how often each occurs."""
    ids = _terms(TERM.findall((text or "").encode()) or [b""])
    found, n = np.unique(ids, return_counts=True)
    words = ids[ids >= SYMBOLS]
    again = int((words[1:] == words[:-1]).sum())
    if again and 4 * again >= len(words):
        found, n = np.append(found, AGAIN), np.append(n, again)
    return found, n


def weighted_row(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of a text, of unit length."""
    ids, n = term_counts(text)
    w = (1 + np.log(n)) * idf[ids]
    return ids, (w / max(1e-9, float(np.sqrt((w * w).sum())))).astype(np.float32)


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    label: np.ndarray
    params: QualityParams

    def project(self, texts) -> np.ndarray:
        rows = [weighted_row(t, self.idf) for t in texts]
        flat, at = csr([r[0] for r in rows])
        return unit(times(flat, np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.float32), at, self.basis))

    def score(self, texts) -> np.ndarray:
        if not len(self.label):
            return np.full(len(texts), 0.5)
        x, out, k = self.project(texts), np.empty(len(texts)), min(self.params.neighbours, len(self.label))
        for a in range(0, len(x), self.params.block):
            sim = x[a : a + self.params.block] @ self.vectors.T
            near = nearest(sim, k)
            s = np.maximum(np.take_along_axis(sim, near, 1), 1e-3).astype(float) ** self.params.power
            out[a : a + len(sim)] = (s * self.label[near]).sum(1) / s.sum(1)
        return np.clip(out, 0, 1)


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """The k columns of each row with the largest values; of equal values the first columns."""
    if k >= sim.shape[1]:
        return np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(sim, near, 1).min(1)
    for i in np.flatnonzero((sim >= least[:, None]).sum(1) > k):  # equal values on both sides of the cut
        above = np.flatnonzero(sim[i] > least[i])
        near[i] = np.concatenate([above, np.flatnonzero(sim[i] == least[i])[: k - len(above)]])
    return near


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, for each term number, of documents that have it: over all rows."""

    def count(batches):
        total = np.zeros(SIZE + 1, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total[term_counts(t)[0]] += 1
            total[SIZE] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    total = add_counts(docs.select("text").mapInArrow(count, "counts binary"), SIZE + 1)
    return int(total[SIZE]), total[:SIZE]


def fit_quality(docs: DataFrame, labels: DataFrame, p: QualityParams | None = None, train=None) -> QualityModel:
    """Fit on a bounded sample of the labelled rows that ``train`` (on doc_id) allows."""
    p = p or QualityParams()
    spark = docs.sparkSession
    train = F.lit(True) if train is None else train
    n, df = document_frequencies(docs)
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(train).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n_labels = known.count()
    empty = QualityModel(idf, np.zeros((SIZE, p.rank), np.float32), np.zeros((0, p.rank), np.float32), np.zeros(0), p)
    if not n_labels:
        return empty
    chosen = known.where(below_fraction(["doc_id"], p.max_labelled / n_labels, p.seed))  # about max_labelled ids at most
    rows = bounded_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), p.max_labelled, p.seed)

    def read(batches):
        for b in batches:
            found = [weighted_row(t, idf) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "f": [f.astype(np.int32).tobytes() for f, _ in found], "w": [w.tobytes() for _, w in found]})

    sample = materialise(rows.mapInPandas(read, "doc_id long, quality int, f binary, w binary").repartition(4), "labelled")
    basis = randomised_basis(sample.select("f", "w"), SIZE, p.rank, p.rounds, p.seed)
    shared = spark.sparkContext.broadcast(basis)

    def project(batches):
        for b in batches:
            flat, at = csr([np.frombuffer(x, np.int32).astype(np.int64) for x in b["f"]])
            vectors = unit(times(flat, np.frombuffer(b"".join(b["w"]), np.float32), at, shared.value))
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "terms": b["f"], "v": [v.tobytes() for v in vectors]})

    found = sample.mapInPandas(project, "doc_id long, quality int, terms binary, v binary").orderBy("doc_id", "terms").select("quality", "v").toPandas()
    shared.destroy()
    discard(sample)
    free_shuffles(spark)
    if not len(found):
        return empty
    vectors = np.frombuffer(b"".join(found["v"]), np.float32).reshape(-1, p.rank)
    return QualityModel(idf, basis, vectors, (found["quality"].to_numpy() == 1).astype(float), p)


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str], threshold: float = 0.7, names: tuple[str, str] = ("quality_score", "quality_predicted")) -> DataFrame:
    """Columns ``keep`` of each row, with score and decision of its whole text in columns ``names``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            scores = np.concatenate([shared.value.score(texts[a : a + 500]) for a in range(0, len(texts), 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores)], [*keep, names[0]])

    schema = T.StructType([*source.select(*keep).schema, T.StructField(names[0], T.DoubleType())])
    return source.mapInArrow(run, schema).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of held-out ids (crc32 mod 4 is 2) are not used."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, train=crc_mod("doc_id", 4) != 2)
    out = score_quality(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
