"""Language of words and documents by a linear-chain conditional random field.

Each word has features of its beginnings and endings, its character n-grams and its
entry in a lexicon of words that mostly occur in one language; transitions between
the languages of neighbouring words are learned with their weights, from documents
whose words are all taken to be in the document's language, joined into code-switched
training sequences. Forward-backward gives each word's probabilities of the
languages. A document's language is that with the largest sum over its words.

A sequence is a line of text; lines of more than ``longest`` words are cut at that
length. Words without a letter take no part.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Ties
go to the first language in alphabetical order. Repeated rows are predicted alike.
With no labelled row every text is ``und``. An empty table gives an empty result.
Other columns of the input are not read.
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

from .common import CACHE_WORDS, Remembers, below_fraction, bound_batches, crc_mod, csr, sum_rows

BITS = 17
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LangParams:
    """Bounds of the training sample and of the training."""

    max_documents: int = 3_000  #: labelled documents in training, about
    words_each: int = 120  #: words taken of a training document, in runs from all over it
    run_words: int = 20  #: words of such a run
    max_languages: int = 500  #: languages learned, those with most documents
    lexicon: int = 20_000  #: words of the lexicon at most
    epochs: int = 4
    batch: int = 128
    rate: float = 0.08
    l2: float = 1e-6
    switch: float = 0.1  #: chance of a change of language at a joint of training pieces
    longest: int = 256
    batch_words: int = 400_000
    seed: int = 3


def word_features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a lower-case word."""
    mask = (1 << BITS) - 1
    h = lambda s: zlib.crc32(s.encode()) & mask
    out = [h("bias")]
    out += [h("p" + word[:k]) for k in (1, 2, 3, 4) if k <= len(word)]
    out += [h("s" + word[-k:]) for k in (1, 2, 3, 4) if k <= len(word)]
    marked = f"^{word}$"
    out += [h("g" + marked[i : i + k]) for k in (2, 3) for i in range(len(marked) - k + 1)]
    if word in lexicon:
        out.append(h(f"x{lexicon[word]}"))
    if len(word) <= 4:
        out.append(h("w" + word))
    return out


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc_step(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Registers of crc32 after one more character each, in UTF-8."""
    byte = lambda state, b: CRC[(state ^ b) & 255] ^ state >> 8
    if code.max(initial=0) < 0x80:
        return byte(state, code)
    lead = np.select([code < 0x80, code < 0x800, code < 0x10000], [code, 0xC0 | code >> 6, 0xE0 | code >> 12], 0xF0 | code >> 18)
    state = byte(state, lead)
    for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        at = np.flatnonzero(code >= least)
        state[at] = byte(state[at], 0x80 | code[at] >> shift & 63)
    return state


def features_of_words(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` of words of a letter or more, one after another, and their offsets; hashed together."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size + 2) - size - 1  # of the words, behind their marks
    begun = lambda kind, n: np.full(n, zlib.crc32(kind) ^ 0xFFFFFFFF, np.uint32)
    row, parts = np.arange(n), []
    put = lambda rows, state: parts.append((rows, (~state & np.uint32((1 << BITS) - 1)).astype(np.int64)))
    put(row, begun(b"bias", n))
    some, state = row, begun(b"p", n)
    for k in range(1, 5):
        long = size[some] >= k
        some, state = some[long], state[long]
        state = crc_step(state, code[start[some] + k - 1])
        put(some, state)
    for k in range(1, 5):
        some = np.flatnonzero(size >= k)
        state = begun(b"s", len(some))
        for j in range(k):
            state = crc_step(state, code[start[some] + size[some] - k + j])
        put(some, state)
    owner, left = np.repeat(row, size + 2), np.repeat(start + size + 1, size + 2) - np.arange(len(code))  # characters to the end
    state = crc_step(begun(b"g", len(code)), code)
    for k in (2, 3):
        state = crc_step(state[:-1], code[k - 1 :]) if len(state) else state
        whole = np.flatnonzero(left[: len(state)] >= k)
        put(owner[whole], state[whole])
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    entry = {c: zlib.crc32(f"x{c}".encode()) ^ 0xFFFFFFFF for _, c in known}
    put(np.array([i for i, _ in known], np.int64), np.array([entry[c] for _, c in known], np.uint32))
    for k in range(1, 5):
        some = np.flatnonzero(size == k)
        state = begun(b"w", len(some))
        for j in range(k):
            state = crc_step(state, code[start[some] + j])
        put(some, state)
    rows, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    return found[np.argsort(rows, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def forward_backward(emit: np.ndarray, at: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals (words, labels) of sequences given by offsets; emit, first and step are weights in log space."""
    n, k = emit.shape
    out = np.empty((n, k))
    if not n:
        return out
    e = np.exp(emit - emit.max(1, keepdims=True))
    a, t = np.exp(first - first.max()), np.exp(step - step.max())
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], at[:-1][order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than i
    fwd = np.empty((n, k))
    state = None
    for i in range(size[0]):
        m = live[i]
        pos = start[:m] + i
        state = a * e[pos] if i == 0 else (state[:m] @ t) * e[pos]
        state /= state.sum(1, keepdims=True)
        fwd[pos] = state
    back = np.ones((len(size), k))
    for i in range(size[0] - 1, -1, -1):
        m = live[i]
        pos = start[:m] + i
        out[pos] = fwd[pos] * back[:m]
        if i:
            nxt = (e[pos] * back[:m]) @ t.T
            back[:m] = nxt / nxt.sum(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


@dataclass
class LangModel(Remembers):
    languages: list[str]
    weight: np.ndarray  #: (features, languages)
    first: np.ndarray
    step: np.ndarray
    lexicon: dict[str, int]
    params: LangParams

    def emissions(self, words: list[str]) -> np.ndarray:
        """Weights (words, languages), by a lookup of each word."""
        row, table = self.cache(lambda: ({}, []))
        if len(row) > CACHE_WORDS:
            row.clear()
            table.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in row]
        for a in range(0, len(fresh), 20_000):
            some = fresh[a : a + 20_000]
            flat, at = features_of_words(some, self.lexicon)
            table.append(sum_rows(self.weight[flat], at))
            for w in some:
                row[w] = len(row)
        if len(table) > 1:
            table[:] = [np.concatenate(table)]
        return table[0][np.fromiter(map(row.__getitem__, words), np.int64, len(words))]

    def label_words(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """The words of a text with the probabilities of the languages for each."""
        words, at = sequences(text, self.params.longest)
        return words, forward_backward(self.emissions(words), np.array(at), self.first, self.step) if words else np.zeros((0, len(self.languages)))

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and its share of the words' probabilities for each text."""
        names, scores, i = [], np.zeros(len(texts)), 0
        while i < len(texts):
            words, at, owner, lo = [], [0], [], i
            while i < len(texts) and (len(words) < self.params.batch_words or i == lo):
                w, ends = sequences(texts[i], self.params.longest)
                at += [len(words) + x for x in ends[1:]]
                owner.append(len(w))
                words += w
                i += 1
            if not self.languages or not words:
                names += ["und"] * (i - lo)
                continue
            marginal = forward_backward(self.emissions(words), np.array(at), self.first, self.step)
            total = sum_rows(marginal, np.concatenate([[0], np.cumsum(owner)]))
            best = total.argmax(1)
            for j, n in enumerate(owner):
                names.append(self.languages[best[j]] if n else "und")
                scores[lo + j] = min(1.0, total[j, best[j]] / n) if n else 0.0
        return names, scores


def letter_words(text: str) -> list[str]:
    """The words of a text: runs of letters, or of letters and marks like them that hold a letter."""
    found = WORD.findall(text)
    # \w also has numbers such as fractions, which are no letters
    return found if "".join(found).isalpha() else [w for w in found if any(map(str.isalpha, w))]


def sequences(text: str | None, longest: int) -> tuple[list[str], list[int]]:
    """Lower-case words of a text and the offsets of its sequences."""
    words, at = [], [0]
    for line in (text or "").lower().split("\n"):
        words += letter_words(line)
        while len(words) - at[-1] > longest:
            at.append(at[-1] + longest)
        if len(words) > at[-1]:
            at.append(len(words))
    return words, at


def train_crf(rows: list[tuple[str, list[str]]], p: LangParams) -> LangModel:
    """Fit on (language, words) of documents by stochastic gradients of the likelihood."""
    languages = sorted({r[0] for r in rows})
    k = len(languages)
    if not k:
        return LangModel([], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), {}, p)
    number = {x: i for i, x in enumerate(languages)}
    seen: dict[str, np.ndarray] = {}
    for lang, words in rows:
        for w in set(words):
            seen.setdefault(w, np.zeros(k))[number[lang]] += 1
    total = np.maximum(1, np.bincount([number[r[0]] for r in rows], minlength=k))
    lexicon = {}
    for w, c in sorted(seen.items(), key=lambda x: (-x[1].sum(), x[0])):
        share = c / total
        if c.sum() >= 3 and share.max() >= 0.8 * share.sum() and len(lexicon) < p.lexicon:
            lexicon[w] = int(share.argmax())
    rng = np.random.default_rng(p.seed)
    vocabulary = {w: i for i, w in enumerate(seen)}
    flat, at = csr([np.array(word_features(w, lexicon)) for w in vocabulary])
    # code-switched sequences: pieces of documents, joined
    pieces = []
    for lang, words in rows:
        a = 0
        while a < len(words):
            n = int(rng.integers(3, 25))
            pieces.append((number[lang], [vocabulary[w] for w in words[a : a + n]]))
            a += n
    weight, first, step = np.zeros((1 << BITS, k)), np.zeros(k), np.eye(k)
    square = [np.full_like(x, 1e-3) for x in (weight, first, step)]
    by_lang = [[q for q in pieces if q[0] == c] for c in range(k)]
    for _ in range(p.epochs):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), p.batch):
            ids, labels, ends = [], [], [0]
            for j in order[lo : lo + p.batch]:
                c, words = pieces[j]
                while True:
                    ids += words
                    labels += [c] * len(words)
                    if rng.random() >= p.switch or not by_lang[other := int(rng.integers(k))]:
                        break
                    c, words = by_lang[other][int(rng.integers(len(by_lang[other])))]
                ends.append(len(ids))
            ids, labels, ends = np.array(ids), np.array(labels), np.array(ends)
            words, back = np.unique(ids, return_inverse=True)
            sizes = at[words + 1] - at[words]
            used = np.concatenate([flat[at[w] : at[w + 1]] for w in words])
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            emit = sum_rows(weight[used], offsets)[back]
            m = forward_backward(emit, ends, first, step)
            # expected transitions from neighbouring marginals, exactly: p(i, j) from the pair potentials
            left = np.setdiff1d(np.arange(len(ids) - 1), ends[1:-1] - 1)
            pair = expected_pairs(emit, ends, first, step, left)
            gold = np.zeros_like(m)
            gold[np.arange(len(ids)), labels] = 1
            g_emit = np.zeros((len(words), k))
            np.add.at(g_emit, back, m - gold)
            features, where = np.unique(used, return_inverse=True)
            g_weight = np.zeros((len(features), k))
            np.add.at(g_weight, where, np.repeat(g_emit, sizes, axis=0))
            g_first = (m - gold)[ends[:-1]].sum(0)
            g_step = pair - np.bincount(labels[left] * k + labels[left + 1], minlength=k * k).reshape(k, k)
            scale = 1 / (len(ends) - 1)
            for target, grad, acc, rows_ in ((weight, g_weight * scale + p.l2 * weight[features], square[0], features), (first, g_first * scale, square[1], slice(None)), (step, g_step * scale, square[2], slice(None))):
                acc[rows_] += grad * grad
                target[rows_] -= p.rate * grad / np.sqrt(acc[rows_])
    return LangModel(languages, weight.astype(np.float32), first, step, lexicon, p)


def expected_pairs(emit, at, first, step, left) -> np.ndarray:
    """Expected counts of label pairs at words ``left`` and the words after them."""
    k = emit.shape[1]
    e, t = np.exp(emit - emit.max(1, keepdims=True)), np.exp(step - step.max())
    fwd, back = _messages(e, at, np.exp(first - first.max()), t)
    joint = fwd[left][:, :, None] * t[None] * (e[left + 1] * back[left + 1])[:, None, :]
    return (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(left) else np.zeros((k, k))


def _messages(e, at, a, t):
    fwd, back = np.empty_like(e), np.ones_like(e)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, start = size[order], at[:-1][order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left")
    state = None
    for i in range(size[0]):
        pos = start[: live[i]] + i
        state = a * e[pos] if i == 0 else (state[: live[i]] @ t) * e[pos]
        state /= state.sum(1, keepdims=True)
        fwd[pos] = state
    for i in range(size[0] - 1, 0, -1):
        pos = start[: live[i]] + i
        nxt = (e[pos] * back[pos]) @ t.T
        back[pos - 1] = nxt / nxt.sum(1, keepdims=True)
    return fwd, back


def word_runs(words: list[str], seed: int, p: LangParams) -> list[str]:
    """All words of a short text; of a longer one ``words_each``, in runs at random places of equal parts of it."""
    if len(words) <= p.words_each:
        return words
    rng, n, out = np.random.default_rng([p.seed, seed]), max(1, p.words_each // p.run_words), []
    size = p.words_each // n
    for k in range(n):
        lo, hi = k * len(words) // n, (k + 1) * len(words) // n
        a = int(rng.integers(lo, max(lo, hi - size) + 1))
        out += words[a : a + size]
    return out


def fit_langid(docs: DataFrame, p: LangParams | None = None, train=None) -> LangModel:
    """Fit on a bounded sample of the rows (doc_id, text, lang) that ``train`` (on doc_id) allows."""
    p = p or LangParams()
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(F.lit(True) if train is None else train)
    top = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(p.max_languages)
    sizes = {r["lang"]: r["count"] for r in top.collect()}
    if not sizes:
        return train_crf([], p)
    # as many of each language, as far as there are
    each = p.max_documents / len(sizes)
    drawn = F.lit(False)
    for lang, n in sorted(sizes.items()):
        drawn |= (F.col("lang") == lang) & below_fraction(["doc_id", "text"], each / n, p.seed)
    chosen = known.where(drawn).select("doc_id", "lang", "text").dropDuplicates()

    def read(batches):
        for b in batches:
            words = [word_runs(letter_words((t or "").lower()), int(i) & (1 << 64) - 1, p) for i, t in zip(b["doc_id"], b["text"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang": b["lang"], "words": [" ".join(w) for w in words]})

    rows = chosen.mapInPandas(read, "doc_id long, lang string, words string").collect()
    return train_crf([(r[1], r[2].split()) for r in sorted(tuple(r) for r in rows) if r[2]], p)


def predict_language(docs: DataFrame, model: LangModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of each row, with the language of its whole text and its score."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))

    def run(batches):
        for b in batches:
            names, scores = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)], [*keep, "lang_pred", "lang_score"])

    schema = T.StructType([*source.select(*keep).schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 4 = 2 are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_langid(docs, train=crc_mod("doc_id", 4) != 2)
    out = predict_language(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
