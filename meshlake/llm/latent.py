"""TF-IDF weighting and randomised SVD over sparse rows, in numpy, in bounded blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import csr, sum_rows

BLOCK = 100_000  #: entries multiplied at once


def times(flat: np.ndarray, weight: np.ndarray, at: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sparse rows (feature numbers, weights, offsets) times a dense matrix of features."""
    out = np.zeros((len(at) - 1, dense.shape[1]), np.float32)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        a, b = at[i], at[j]
        out[i:j] = sum_rows(dense[flat[a:b]] * weight[a:b, None], at[i : j + 1] - a)
        i = j
    return out


def times_transposed(flat: np.ndarray, weight: np.ndarray, at: np.ndarray, dense: np.ndarray, n_features: int) -> np.ndarray:
    """The transpose of the sparse rows times a dense matrix of rows."""
    out = np.zeros((n_features, dense.shape[1]), np.float32)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for a in range(0, len(flat), BLOCK):
        f, w, r = flat[a : a + BLOCK], weight[a : a + BLOCK], row[a : a + BLOCK]
        order = np.argsort(f, kind="stable")
        f, part = f[order], dense[r[order]] * w[order, None]
        first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        if len(first):
            out[f[first]] += np.add.reduceat(part, first, axis=0)
    return out


def probe(n: int, width: int, seed: int) -> np.ndarray:
    """A Gaussian test matrix, the same on every machine."""
    return np.random.default_rng(seed).standard_normal((n, width), dtype=np.float32)


def orthonormal(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, by their Gram matrix, twice; dependent columns become zero."""
    for _ in range(2):
        gram = np.zeros((y.shape[1],) * 2)
        for a in range(0, len(y), 8192):
            part = y[a : a + 8192].astype(np.float64)
            gram += part.T @ part
        values, vectors = np.linalg.eigh(gram)
        keep = values > max(values.max(), 0) * 1e-10
        y = y @ (vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)).astype(np.float32)
    return y


def randomised_basis(rows: DataFrame, size: int, rank: int, rounds: int, seed: int) -> np.ndarray:
    """The leading right singular vectors (size, rank) of the sparse rows of a table.

    ``rows`` has feature numbers ``f`` (int32) and weights ``w`` (float32) as binary. Each
    round sends the current basis to the tasks, which add up their rows' share of
    A'(A Q); the driver adds the tasks' shares one at a time and orthonormalises the sum.
    """
    spark, width = rows.sparkSession, rank + 8
    q = orthonormal(probe(size, width, seed))

    def step(q, gram):
        shared = spark.sparkContext.broadcast(q)

        def run(batches):
            y = np.zeros((width, width) if gram else (size, width), np.float32)
            for b in batches:
                flat, at = csr([np.frombuffer(x, np.int32).astype(np.int64) for x in b["f"]])
                weight = np.frombuffer(b"".join(b["w"]), np.float32)
                aq = times(flat, weight, at, shared.value)
                y += aq.T @ aq if gram else times_transposed(flat, weight, at, aq, size)
            yield pd.DataFrame({"y": [y.tobytes()]})

        total = np.zeros((width, width) if gram else (size, width), np.float32)
        for r in rows.mapInPandas(run, "y binary").toLocalIterator():
            total += np.frombuffer(r[0], np.float32).reshape(total.shape)
        shared.destroy()
        return total

    for _ in range(rounds):
        q = orthonormal(step(q, False))
    _, vectors = np.linalg.eigh(step(q, True).astype(np.float64))
    return (q @ vectors[:, ::-1][:, :rank].astype(np.float32)).astype(np.float32)


def nystrom_basis(multiply, size: int, rank: int, rounds: int, seed: int) -> np.ndarray:
    """The leading right singular vectors (size, rank) of A, where ``multiply`` gives A'A Q for a dense Q of size rows.

    After ``rounds`` products Y = A'A Q, the last is also the Nystrom form Y (Q'Y)^-1 Y' of
    A'A, whose vectors need no further pass over the rows; dependent ones become zero.
    """
    q = orthonormal(probe(size, rank + 8, seed))
    for k in range(rounds):
        q = orthonormal(y) if k else q
        y = multiply(q)
    core = q.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 0) * 1e-6
    root = y @ (vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0))
    values, vectors = np.linalg.eigh(root.T @ root)
    keep = values > max(values.max(), 0) * 1e-10
    return (root @ (vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0))[:, ::-1][:, :rank]).astype(np.float32)


def gathered_sums(table: np.ndarray, index: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of ``table[index[start[i] : start[i] + size[i]]]``; whole rows are added step by step, which a reduction does not.

    Sums of more than 64 rows are made of parts; sums are taken 1,024 at a time, longest first, so that they stay in the cache.
    """
    parts = -(-size // 64)
    first = np.cumsum(parts) - parts
    number = np.arange(parts.sum()) - np.repeat(first, parts)
    begin, n = np.repeat(start, parts) + 64 * number, np.minimum(64, np.repeat(size, parts) - 64 * number)
    order = np.argsort(-n.astype(np.int8), kind="stable")
    begin, n = begin[order], n[order]
    sums = np.empty((len(n), table.shape[1]), table.dtype)
    some, more = np.empty((2, 1024, table.shape[1]), table.dtype)
    for a in range(0, len(n), 1024):
        b = begin[a : a + 1024]
        reach = np.searchsorted(-n[a : a + 1024], -np.arange(n[a]), "left")  # sums longer than k
        np.take(table, index[b], axis=0, out=some[: len(b)], mode="clip")
        for k in range(1, n[a]):
            np.take(table, index[b[: reach[k]] + k], axis=0, out=more[: reach[k]], mode="clip")
            some[: reach[k]] += more[: reach[k]]
        sums[order[a : a + 1024]] = some[: len(b)]
    if (parts == 1).all():
        return sums
    out = np.zeros((len(size), table.shape[1]), table.dtype)
    out[parts == 1] = sums[first[parts == 1]]
    many = np.flatnonzero(parts > 1)
    if len(many):
        out[many] = gathered_sums(sums, np.arange(len(sums)), first[many], parts[many])
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
