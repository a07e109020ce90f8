"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of tokens in table order. Every window (sequence) of
``length`` tokens takes from each queue its target share; what rounding leaves is
carried as a deficit to later windows. The plan is drawn up once, from the totals of
the queues: it is a list of phases, each a cycle of windows that repeats until a
queue runs low, and a document's place follows from the tokens queued before it. So
deficits run on across windows and partitions with no task seeing a whole queue.

Only the last window can be partly filled; it is cut into sequences whose lengths
are powers of two, so nothing is padded.

Defined results: a null or empty text is its end token alone. A null source is a
queue of its own. Repeated rows are packed once each. An empty table gives an empty
result. A target of 0 or less, or none, lets a queue in only when the others are
empty. Other columns of the input are not read. A null doc_id is carried along.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class PackParams:
    """Window length, end token, targets by source (none: shares of the tokens present)."""

    tokenizer: str
    length: int = 2048
    end_id: int = 1
    targets: dict | None = None
    cycle: int = 1024  #: windows in which rounding deficits come back to zero, at most
    broadcast_rows: int = 200_000  #: rows of the queue offsets sent to every task at most
    max_sources: int = 5_000  #: queues planned one by one, the largest; all further sources are one queue


_ENCODER: dict = {}
PROBE = "It's  a 1st\n\n trial: \u00e9\u4e2d\U0001f600 <|end|>\t don't "


def encoder(path: str):
    """A function from a text to its ids by the tokenizer file, once a process.

    Added tokens of the file (such as its end of text) are recognised in texts, as the
    tokenizer does by default. For a byte-level BPE without further steps, other texts'
    ids are those of its ranks under the file's own split pattern, which ``tiktoken`` finds several times as fast; a probe
    is encoded both ways, and where they differ the tokenizer itself is used.
    """
    if path not in _ENCODER:
        import json

        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        plain = lambda text: slow.encode(text, add_special_tokens=False).ids
        _ENCODER[path] = plain
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space"):
            import public_tokenizers
            import tiktoken

            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letter = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in printable)}
            added = {t["content"] for t in spec.get("added_tokens", ())}
            ranks = {bytes(letter[x] for x in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            if fast(PROBE) == plain(PROBE):
                # a text with one of the file's added tokens in it goes to the tokenizer itself
                _ENCODER[path] = lambda text: plain(text) if any(t in text for t in added) else fast(text)
    return _ENCODER[path]


def encode(texts: list[str], path: str, end_id: int) -> list[np.ndarray]:
    """Token ids of each text and its end token."""
    one = encoder(path)
    return [np.array([*one(t), end_id], np.uint32) for t in texts]


@dataclass
class Phase:
    """``repeat`` cycles of len(table) windows from ``window`` on; table[w, s] tokens of source s."""

    window: int
    repeat: int
    table: np.ndarray
    base: np.ndarray  #: tokens of each source that earlier phases took
    before: np.ndarray = field(init=False)  #: tokens of a source taken before window w of a cycle
    shift: np.ndarray = field(init=False)  #: offset of a source's part in window w

    def __post_init__(self):
        zero = np.zeros((1, self.table.shape[1]), np.int64)
        self.before = np.concatenate([zero, np.cumsum(self.table, axis=0)])
        self.shift = np.cumsum(self.table, axis=1) - self.table


def shares(weight: np.ndarray, total: int) -> np.ndarray:
    """Integers in proportion to ``weight`` that sum to ``total``, by largest remainders."""
    exact = weight / weight.sum() * total
    out = np.floor(exact).astype(np.int64)
    order = np.argsort(-(exact - out), kind="stable")
    out[order[: total - out.sum()]] += 1
    return out


def cycle_table(quota: np.ndarray, windows: int, length: int) -> np.ndarray:
    """Deficit round-robin over one cycle: row w holds what window w takes of each queue."""
    table, taken = np.zeros((windows, len(quota)), np.int64), np.zeros(len(quota), np.int64)
    for w in range(windows):
        deficit = quota * (w + 1) / windows - taken
        take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), quota - taken)
        room = length - take.sum()
        while room > 0:  # the largest deficits take what is left, a token each
            open_ = np.flatnonzero(taken + take < quota)
            first = open_[np.argsort(-(deficit - take)[open_], kind="stable")][:room]
            take[first] += 1
            room -= len(first)
        while room < 0:
            some = np.flatnonzero(take > 0)
            first = some[np.argsort((deficit - take)[some], kind="stable")][:-room]
            take[first] -= 1
            room += len(first)
        table[w], taken = take, taken + take
    return table


def plan_windows(totals: np.ndarray, targets: np.ndarray, length: int, cycle: int) -> list[Phase]:
    """Phases that use up all queues; all windows but the last are full."""
    left, taken, window, phases = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []
    weight = np.maximum(targets.astype(float), 0)

    def add(table, repeat):
        nonlocal window, left, taken
        phases.append(Phase(window, repeat, table, taken.copy()))
        used = table.sum(0) * repeat
        window, left, taken = window + len(table) * repeat, left - used, taken + used

    size = max(1, min(cycle, 400_000 // max(1, len(totals))))
    while left.sum() >= length:
        w = np.where(left > 0, weight, 0)
        w = w if w.sum() > 0 else (left > 0).astype(float)
        quota = shares(w, length * size)
        repeat = int((left[quota > 0] // quota[quota > 0]).min())
        if repeat:
            add(cycle_table(quota, size, length), repeat)
        elif size > 1:
            size = max(1, size // 4)
        else:  # a queue ends within this window: it gives its rest, the others fill up
            take = np.minimum(quota, left)
            while take.sum() < length:
                room, open_ = length - take.sum(), left - take
                more = np.where(open_ > 0, np.maximum(w, w.sum() * 1e-9 + 1e-12), 0)
                take = take + np.minimum(open_, shares(more, int(room)))
            add(take[None], 1)
    rest = left.copy()
    for bit in range(int(left.sum()).bit_length() - 1, -1, -1):
        if (part := 1 << bit) <= rest.sum():
            ends = np.minimum(np.maximum(part - (np.cumsum(rest) - rest), 0), rest)
            add(ends[None], 1)
            rest = rest - ends
    return phases


class Plan:
    """Phases, with the tokens of each source that come before them."""

    def __init__(self, phases: list[Phase]):
        self.phases, self.bases = phases, np.array([p.base for p in phases])


def cut(start: int, n: int, source: int, plan: Plan) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of the pieces of tokens start..start+n of a queue."""
    out, x, end = [], start, start + n
    phases, bases = plan.phases, plan.bases
    k = int(np.searchsorted(bases[:, source], x, "right")) - 1
    while x < end:
        p = phases[k]
        per, at = int(p.before[-1, source]), x - int(p.base[source])
        if per == 0 or at >= per * p.repeat:
            k += 1
            continue
        turn, r = divmod(at, per)
        col = p.before[:, source]
        w = int(np.searchsorted(col, r, "right")) - 1
        while x < end and w < len(p.table):
            stop = turn * per + int(col[w + 1])
            size = min(end - x, stop - at)
            if size > 0:
                out.append((x - start, size, p.window + turn * len(p.table) + w, int(p.shift[w, source]) + (at - turn * per - int(col[w]))))
                x, at = x + size, at + size
            w += 1
    return out


def pack(docs: DataFrame, p: PackParams) -> DataFrame:
    """Pieces of all documents (doc_id, text, source): see ``op6_packing`` for the columns."""
    spark = docs.sparkSession

    def tokenise(batches):
        part, queued = TaskContext.get().partitionId(), {}
        for b in batches:
            texts, names, docs_ = ([x or "" for x in b.column("text").to_pylist()], *(b.column(c).to_pylist() for c in ("source", "doc_id")))
            for a in range(0, len(texts), 256):
                rows = []
                for ids, name, doc in zip(encode(texts[a : a + 256], p.tokenizer, p.end_id), names[a : a + 256], docs_[a : a + 256], strict=True):
                    before = queued.get(name, 0)
                    queued[name] = before + len(ids)
                    small = ids.max() < 65536
                    rows.append((doc, name, part, before, len(ids), small, (ids.astype(np.uint16) if small else ids).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "source", "part", "before", "n", "small", "ids"])

    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    schema = "doc_id long, source string, part int, before long, n long, small boolean, ids binary"
    tokens = materialise(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).mapInArrow(tokenise, schema), "tokens")
    chunks = tokens.groupBy("source", "part").agg(F.sum("n").alias("chunk"))
    by_source = chunks.groupBy("source").agg(F.sum("chunk").alias("total"))
    wanted = [k for k, v in (p.targets or {}).items() if v > 0 and k is not None]
    top = by_source.orderBy(F.coalesce(F.col("source").isin(wanted), F.lit(False)).desc(), F.col("total").desc(), "source").limit(p.max_sources).collect()
    names = sorted((r["source"] for r in top), key=lambda s: (s is not None, s or ""))
    total = {r["source"]: r["total"] for r in top}
    totals = [total[s] for s in names]
    targets = totals if p.targets is None else [p.targets.get(s, 0) for s in names]
    order = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("chunk").over(order), F.lit(0)).alias("base")
    rest = 0
    if len(names) == p.max_sources:
        planned = F.broadcast(spark.createDataFrame([(s, True) for s in names], "name string, planned boolean"))
        chunks = materialise(chunks.join(planned, F.col("source").eqNullSafe(F.col("name")), "left").drop("name"), "chunks")
        rest = chunks.where("planned is null").agg(F.sum("chunk")).first()[0] or 0
    if rest:
        # the other sources are one queue: by bucket, source and part; only the totals of the buckets are summed on the driver
        others = chunks.where("planned is null").withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(1024)))
        at, begins = 0, []
        for r in others.groupBy("bucket").agg(F.sum("chunk").alias("n")).orderBy("bucket").collect():
            begins.append((r["bucket"], at))
            at += r["n"]
        inside = Window.partitionBy("bucket").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
        others = others.join(F.broadcast(spark.createDataFrame(begins, "bucket long, begin long")), "bucket")
        others = others.select("source", "part", (F.col("begin") + F.coalesce(F.sum("chunk").over(inside), F.lit(0))).alias("base"))
        offsets = chunks.where("planned").select("source", "part", base).unionByName(others)
        totals = [*totals, rest]
        if p.targets is None:
            targets = totals
        else:
            more = [s for s in p.targets if s not in total]
            here = [r["source"] for r in by_source.where(F.coalesce(F.col("source").isin(more), F.lit(False))).collect()] if more else []
            targets = [*targets, sum(p.targets[s] for s in here)]
    else:
        offsets = chunks.select("source", "part", base)
    shared = spark.sparkContext.broadcast((Plan(plan_windows(np.array(totals, np.int64), np.array(targets, float), p.length, p.cycle)), {s: i for i, s in enumerate(names)}))
    offsets = materialise(offsets, "offsets")
    offsets = offsets.withColumnsRenamed({"source": "s", "part": "q"})
    if offsets.count() <= p.broadcast_rows:
        offsets = F.broadcast(offsets)
    placed = tokens.join(offsets, tokens["source"].eqNullSafe(offsets["s"]) & (tokens["part"] == offsets["q"]))
    placed = placed.select("doc_id", "source", (F.col("base") + F.col("before")).alias("at"), "n", "small", "ids")

    def place(batches):
        plan, number = shared.value
        for b in batches:
            cols = [[] for _ in range(7)]
            for doc, source, at, n, small, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "at", "n", "small", "ids")), strict=True):
                raw = memoryview(np.frombuffer(ids, np.uint16 if small else np.uint32).astype("<u4").tobytes())
                for start, size, window, offset in cut(at, n, number.get(source, len(number)), plan):
                    for c, v in zip(cols, (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, window, offset), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed to windows of 2048 tokens in the proportions of their sources."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), PackParams(public_tokenizers.path("byte_bpe_50k.json")))
