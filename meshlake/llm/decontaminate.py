"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of two neighbouring blocks of words, benchmark items into
passages of that length. Passages are weighted by TF-IDF with document frequencies of
the whole corpus (words of items weigh no less than by their frequency among the items,
however many rows hold them), and projected on the leading singular vectors that a distributed
randomised SVD finds for all passages of the corpus together with all items. Every
passage of every document is compared with all items by the cosine of their latent
vectors. Of these candidates go on those whose surroundings hold enough of the item's
informative words at all, which no passage that alignment accepts can lack.
For each candidate the words of the item and of the text around the passage are
aligned by their longest common subsequence. An item leaks if most of its words and
of its informative words stand there in order; below ``copy`` also most of its
answer (the column ``answer`` if the benchmark has it, else the item's last words),
so that paraphrases count and chance overlaps do not.

Frequencies, SVD, search and alignment cover all rows and whole texts. Items are searched in blocks of
``block_items`` passages, so any number of items can be given. Tests measure the
recall of the candidates against alignment of all passages.

Defined results: null and empty texts and items have no words and never match; rows
with a null doc_id are searched and reported with a null id, and so are items with a
null item_id. Repeated rows are
reported once for each item, ties take the first place in the text. An empty table of
documents or items gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_counts, bound_batches, csr, free_shuffles, portions, texts_of, word_hashes
from .latent import gathered_sums, nystrom_basis, unit

BITS = 15
SIZE = 1 << BITS
FIXED = float(1 << 40)  #: of fixed-point sums; their weights together stay below 2 ** 20
#: lower-cases A-Z and makes ASCII punctuation and controls a blank
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


@dataclass(frozen=True)
class LeakParams:
    block: int = 16  #: words of a block; a passage is two
    rank: int = 64
    rounds: int = 2  #: power iterations
    corpus: int = 8_000  #: weight of all corpus passages together in the SVD, in passages; items weigh as so many at most
    item_weight: int = 64  #: weight of an item's passage in the SVD against one of the corpus
    plain: float = 0.1  #: words of no item in more than this share of the documents have no weight
    few: int = 20  #: words in no more documents than this always count
    cosine: float = 0.3  #: least cosine of a candidate
    copy: float = 0.8  #: share of the item's words in order, from which on it is a copy
    paraphrase: float = 0.55  #: the same for a paraphrase
    informative: float = 0.5  #: share of the informative words in order
    answer: float = 0.5  #: share of the answer's words in order, for a paraphrase
    answer_words: int = 8
    frequent: float = 0.02  #: words in more than this share of the documents are not informative
    block_items: int = 20_000
    batch_bytes: int = 250_000
    seed: int = 5


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SIZE - 1)).astype(np.int64)


def common_subsequence(masks: dict, n: int, other: list) -> int:
    """Length of the longest common subsequence; masks[word] has the bits of its places in the first sequence of n words."""
    full = (1 << n) - 1
    v = full
    for w in other:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Item:
    item_id: int | None
    words: list
    informative: list
    answer: list

    def __post_init__(self):
        self.at, self.at_informative, self.at_answer = places(self.words), places(self.informative), places(self.answer)


def passages(at: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in the concatenated words of texts, of all pairs of neighbouring blocks (or the one block of a short text)."""
    count = -(-np.diff(at) // block)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(at[:-1], count) + number * block
    whole, ends = np.repeat(count, count), np.append(starts[1:], at[-1])
    first = np.flatnonzero((number < whole - 1) | (whole == 1))
    return starts[first], ends[np.minimum(first + (whole[first] > 1), len(ends) - 1)] if len(first) else ends[:0]


def halves(start: np.ndarray, end: np.ndarray, block: int, n: int) -> tuple[np.ndarray, ...]:
    """Starts and sizes of the blocks, each once, that make up passages of n words; each passage's first and second block, and whether it has two."""
    half = np.minimum(start + block, end)
    edges = np.unique(np.concatenate([start, half]))
    edges = edges[edges < n]
    stop = np.minimum(np.append(edges[1:], n), edges + block)
    last = np.searchsorted(edges, end)  # a block ends with its passage, or where the next one starts
    stop[last[(last > 0)] - 1] = np.minimum(stop[last[(last > 0)] - 1], end[last > 0])
    return edges, stop - edges, np.searchsorted(edges, start), np.searchsorted(edges, half), half < end


def latent(ids: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, weight: np.ndarray, block: int) -> np.ndarray:
    """Sums of the table's rows over the words of passages, each block summed once; rows of words without weight are zero."""
    edges, size, first, second, two = halves(start, end, block, len(ids))
    sums = gathered_sums(table, ids, edges, size)
    out = sums[first] if len(start) else np.zeros((0, table.shape[1]), np.float32)
    out[two] += sums[second[two]]
    return out


def totals(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of one value a word over passages."""
    run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return run[end] - run[start]


def frequencies(docs: DataFrame) -> np.ndarray:
    """Documents with each feature; the last two entries are the documents and the passages-to-be in words."""

    def count(batches):
        total = np.zeros(SIZE + 2, np.int64)
        for b in batches:
            texts = texts_of(b)
            for lo, hi in portions(texts, 250_000):
                hashes, at = word_hashes(texts[lo:hi], PLAIN)
                pairs = np.unique(np.repeat(np.arange(hi - lo) * SIZE, np.diff(at)) + features_of(hashes))
                total[:SIZE] += np.bincount(pairs % SIZE, minlength=SIZE)
                total[SIZE + 1] += len(hashes)
            total[SIZE] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    return add_counts(docs.select("text").mapInArrow(count, "counts binary"), SIZE + 2)


def gram_times(rows: DataFrame, idf: np.ndarray, q: np.ndarray, p: LeakParams) -> np.ndarray:
    """A'A q over the passages of all ``rows`` (text, weight), TF-IDF rows of unit length times the root of the weight.

    Tasks read and cut the texts anew, so no passage is kept; there are twice as many as
    cores, whatever the input, and each sends one vector for each column of q. These are
    summed in fixed point, so that the order in which they come changes nothing.
    """
    spark, width = rows.sparkSession, q.shape[1]
    shared = spark.sparkContext.broadcast((q * idf[:, None], idf))

    def add(y, ids, start, end, weight, table, idf):
        """Adds the share of some passages: the weighted sums of passages go back to their words by way of the blocks."""
        edges, size, first, second, two = halves(start, end, p.block, len(ids))
        sums = gathered_sums(table, ids, edges, size)
        x = sums[first]
        x[two] += sums[second[two]]
        x *= (weight / np.maximum(totals(idf[ids] ** 2, start, end), 1e-18)).astype(np.float32)[:, None]
        back = np.zeros_like(sums)
        back[first] += x  # passages differ in their first blocks, and so in their second ones
        back[second[two]] += x[two]
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        n = np.bincount(ids, minlength=SIZE)
        f = np.flatnonzero(n)
        y[f] += gathered_sums(back, np.repeat(np.arange(len(edges)), size)[order], (np.cumsum(n) - n)[f], n[f])

    def run(batches):
        table, idf = shared.value
        y = np.zeros((SIZE, width), np.float32)
        for b in batches:
            texts, weight = texts_of(b), b.column("weight").to_numpy()
            for lo, hi in portions(texts, 4 * p.batch_bytes):
                hashes, at = word_hashes(texts[lo:hi], PLAIN)
                ids = features_of(hashes)
                start, end = passages(at, p.block)
                own = weight[lo:hi][np.searchsorted(at, start, "right") - 1]
                for c in range(0, len(start), 16_384):  # a very long text is taken in parts
                    s, e = start[c : c + 16_384], end[c : c + 16_384]
                    add(y, ids[s[0] : e[-1]], s - s[0], e - s[0], own[c : c + 16_384], table, idf)
        fixed = np.rint((y * idf[:, None]).T.astype(np.float64) * FIXED).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([v.tobytes() for v in fixed])], ["j", "y"])

    def combine(batches):
        total: dict = {}
        for b in batches:
            for j, y in zip(b.column("j").to_pylist(), b.column("y").to_pylist(), strict=True):
                total[j] = total.get(j, 0) + np.frombuffer(y, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["j", "y"])

    bound_batches(spark)
    parts = rows.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "j int, y binary")
    out = np.zeros((SIZE, width), np.float32)
    for r in parts.repartition(8, "j").mapInArrow(combine, "j int, y binary").toLocalIterator():
        out[:, r["j"]] = np.frombuffer(r["y"], np.int64) / FIXED
    shared.destroy()
    free_shuffles(spark)
    return out


def _searches(docs: DataFrame, benchmark: DataFrame, p: LeakParams, candidates_only: bool = False):
    """For each block of items, a function from texts to its hits (row, item_id, cosine, overlap, informative, answer, place)."""
    spark = docs.sparkSession
    if benchmark.isEmpty() or docs.isEmpty():
        return
    counts = frequencies(docs)
    free_shuffles(spark)
    n, n_words, df = max(1, int(counts[SIZE])), int(counts[SIZE + 1]), counts[:SIZE]
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).dropDuplicates()
    in_items = frequencies(items)
    n_items = int(in_items[SIZE])
    # words of items always count, and at least by their rarity among the items: an item in many rows makes its own words frequent
    own = np.log((n_items + 1) / (in_items[:SIZE] + 1))
    idf = np.log((n + 1) / (df + 1)) + 0.01
    idf = np.where(in_items[:SIZE] > 0, np.maximum(idf, own), np.where(df > max(p.few, p.plain * n), 0, idf)).astype(np.float32)
    blocks = max(1, -(-(2 * n_items + int(in_items[SIZE + 1]) // p.block) // p.block_items))
    # all passages of the corpus weigh as much together as ``corpus`` ones, and items no more than so many
    weight = lambda rows, w: rows.select(F.col("text").cast("string").alias("text"), F.lit(float(w)).alias("weight"))
    rows = weight(docs, min(1.0, p.corpus * p.block / max(1, n_words))).unionByName(weight(items, p.item_weight * min(1.0, p.corpus / n_items)))
    basis = nystrom_basis(lambda q: gram_times(rows, idf, q, p), SIZE, p.rank, p.rounds, p.seed)
    table = spark.sparkContext.broadcast((basis * idf[:, None], idf * idf))
    free_shuffles(spark)
    rare = df <= max(p.few, p.frequent * n)

    for k in range(blocks):
        part = []
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator() if blocks > 1 else items.collect():
            w, end = (word_hashes([r[c]], PLAIN)[0] for c in ("text", "answer"))
            if len(w):
                answer_words = end if len(end) else w[-p.answer_words :]
                part.append(Item(r["item_id"], w.tolist(), w[rare[features_of(w)]].tolist(), answer_words.tolist()))
        part.sort(key=lambda i: (i.item_id is not None, i.item_id or 0, i.words))
        if not part:
            continue
        flat, at = csr([features_of(np.array(i.words, np.uint64)) for i in part])
        start, end = passages(at, p.block)
        vectors = latent(flat, start, end, *table.value, p.block)
        vectors = unit(vectors)
        owner = np.searchsorted(at, start, "right") - 1
        offset = start - at[owner]
        known = np.zeros(SIZE, np.float32)
        known[flat] = table.value[1][flat]
        shared = spark.sparkContext.broadcast((part, vectors, owner, offset, known, Witnesses(part, df, p)))
        yield _search(shared, table, p, candidates_only)


def find_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams | None = None, candidates_only: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, cosine, overlap, informative, answer, place) of documents that hold an item.

    ``overlap``, ``informative`` and ``answer`` are the shares found in order, and
    ``place`` is the word at which the passage starts. ``candidates_only`` leaves out
    the alignment's decision.
    """
    schema = "doc_id long, item_id long, cosine double, overlap double, informative double, answer double, place long"
    names, kinds = [c.split()[0] for c in schema.split(", ")], [pa.int64()] * 2 + [pa.float64()] * 4 + [pa.int64()]

    def listed(search):
        def run(batches):
            for b in batches:
                ids = b.column("doc_id").to_pylist()
                rows = [(ids[i], *hit) for i, *hit in search(texts_of(b))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names)

        return run

    found = docs.sparkSession.createDataFrame([], schema)
    for search in _searches(docs, benchmark, p or LeakParams(), candidates_only):
        found = found.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(listed(search), schema))
    best = F.max_by(F.struct(*names[2:]), F.struct("overlap", "cosine", -F.col("place")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, p: LeakParams | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found."""

    def clean(search):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[i for i, *_ in search(texts_of(b))]] = False
                yield b.filter(pa.array(keep))

        return run

    kept = docs
    for search in _searches(docs, benchmark, p or LeakParams()):
        kept = kept.mapInArrow(clean(search), docs.schema)
    return kept


def _search(shared, table, p: LeakParams, candidates_only: bool):
    def align(item: Item, around: list):
        """Shares found in order in the words around the place where the item would begin."""
        n = len(item.words)
        informative = common_subsequence(item.at_informative, len(item.informative), around) / len(item.informative) if item.informative else 1.0
        if informative < p.informative and not candidates_only:
            return 0.0, informative, 0.0
        overlap = common_subsequence(item.at, n, around) / n
        return overlap, informative, common_subsequence(item.at_answer, len(item.answer), around) / len(item.answer)

    def search(texts: list) -> list[tuple]:
        items, vectors, owner, offset, known, witnesses = shared.value
        length = np.array([len(i.words) for i in items])
        furthest = np.zeros(len(items), np.int64)
        np.maximum.at(furthest, owner, offset)
        out = []
        for first, last in portions(texts, p.batch_bytes):
            hashes, at = word_hashes(texts[first:last], PLAIN)
            flat, best = features_of(hashes), {}
            seen = None if candidates_only else witnesses.find(hashes)
            held = None if seen is None or seen[2] is None else witnesses.by_run(seen[2], furthest + length // 4 + 2 * p.block, length + length // 4 + 2 * p.block)[:, owner]
            alone = last - first == 1
            step = max(p.block, p.batch_bytes // 2 // p.block * p.block)
            for lo in range(0, max(1, len(flat)), step) if alone else (0,):
                # a single very long text is taken in parts that share a block
                hi = min(len(flat), lo + step + p.block) if alone else len(flat)
                ids = flat[lo:hi]
                start, end = passages(np.array([0, hi - lo]) if alone else at, p.block)
                squares, shared_squares = totals(table.value[1][ids], start, end), totals(known[ids], start, end)
                # the cosine with any item is at most the share of the words that items have
                near = (squares > 0) & (shared_squares >= p.cosine**2 * squares) if p.cosine > 0 else np.ones(len(start), bool)
                start, end = start[near], end[near]
                x, starts = unit(latent(ids, start, end, *table.value, p.block)), start + lo
                rows, home = max(1, 2_000_000 // max(1, len(vectors))), np.searchsorted(at, starts, "right") - 1
                for c in range(0, len(x), rows):
                    sim = x[c : c + rows] @ vectors.T
                    close = sim >= p.cosine
                    if held is not None:  # spares the many whose surroundings lack the item's words the exact count
                        close &= held[starts[c : c + rows] // 16]
                    i, j = np.divmod(np.flatnonzero(close), sim.shape[1])
                    s, begin, doc = np.minimum(sim[i, j], 1), starts[c + i], home[c + i]
                    slack = length[owner[j]] // 4 + 2 * p.block
                    left = begin - offset[j]
                    left, right = np.maximum(at[doc], left - slack), np.minimum(at[doc + 1], np.maximum(at[doc], left + length[owner[j]] + slack))
                    if seen is not None:
                        few = witnesses.enough(seen, owner[j], left, right)
                        i, j, s, begin, doc, left, right = (v[few] for v in (i, j, s, begin, doc, left, right))
                    for k in range(len(i)):
                        item = items[owner[j[k]]]
                        overlap, informative, answer = align(item, hashes[left[k] : right[k]].tolist())
                        ok = candidates_only or (informative >= p.informative and (overlap >= p.copy or (overlap >= p.paraphrase and answer >= p.answer)))
                        key = (first + int(doc[k]), item.item_id)
                        if ok and (key not in best or (overlap, s[k]) > (best[key][3], best[key][2])):
                            best[key] = (*key, float(s[k]), overlap, informative, answer, int(begin[k] - at[doc[k]]))
            out += best.values()
        return out

    return search


class Witnesses:
    """Words that an accepted passage must hold enough of: an item's informative words, or its rarer ones where it has none.

    Their longest common subsequence with a stretch of text is at most the number of
    words of the stretch that are among them.
    """

    def __init__(self, items: list[Item], df: np.ndarray, p: LeakParams):
        words, need = [], []
        for i in items:
            own, least = i.informative, p.informative * len(i.informative)
            if not own:  # the rarest three in five of all words: the rest cannot make up for them
                count = df[features_of(np.array(i.words, np.uint64))]
                top = np.sort(count)[len(count) * 3 // 5]
                own = [w for w, c in zip(i.words, count, strict=True) if c <= top]
                least = p.paraphrase * len(i.words) - (len(i.words) - len(own))
            words.append(own)
            need.append(max(1, np.ceil(least - 1e-9)))
        self.need = np.array(need)
        pairs = sorted({(w, k) for k, own in enumerate(words) for w in own})
        word = np.array([w for w, _ in pairs], np.uint64)
        self.word, first = np.unique(word, return_index=True)
        self.item, self.at = np.array([k for _, k in pairs], np.int64), np.append(first, len(pairs))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray | None]:
        """Sorted (item, place) of all words of ``hashes`` that are some item's, as one number, the base of it, and running counts of each item by runs of 16 words, where these are few."""
        base, runs = len(hashes) + 1, len(hashes) // 16 + 2
        if not len(self.word):
            return np.zeros(0, np.int64), base, None
        w = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        place = np.flatnonzero(self.word[w] == hashes)
        a, n = self.at[w[place]], self.at[w[place] + 1] - self.at[w[place]]
        entry = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        item, place = self.item[entry], np.repeat(place, n)
        counts = None
        if len(self.need) * runs <= 4_000_000:
            counts = np.bincount(item * runs + place // 16 + 1, minlength=len(self.need) * runs).astype(np.int32).reshape(-1, runs).cumsum(1, dtype=np.int32)
        return np.sort(item * base + place), base, counts

    def by_run(self, counts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """For each run of 16 words and each item, whether a stretch from ``before`` words ahead of a place there to ``after`` behind it may hold as many of its words as needed."""
        last = counts.shape[1] - 1
        run, out = np.arange(last + 1), np.empty((len(self.need), last + 1), bool)
        for k, (b, a) in enumerate(zip(-(-before // 16), -(-(after + 15) // 16), strict=True)):
            out[k] = counts[k, np.minimum(run + a, last)] - counts[k, np.maximum(run - b, 0)] >= self.need[k]
        return np.ascontiguousarray(out.T)

    def enough(self, seen: tuple[np.ndarray, int, np.ndarray | None], item: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places, among the stretches (item, left, right), of those that hold as many of the item's words as needed."""
        keys, base, counts = seen
        need, some = self.need[item], np.arange(len(item))
        if counts is not None:  # the whole runs that a stretch touches hold no fewer
            some = np.flatnonzero(counts[item, -(-right // 16)] - counts[item, left // 16] >= need)
            item, left, right, need = item[some], left[some], right[some], need[some]
        held = np.searchsorted(keys, item * base + right) - np.searchsorted(keys, item * base + left)
        return some[held >= need]


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, with the items and the shares found."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
