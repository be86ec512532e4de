"""Benchmark decontamination by Wu-Manber search over words.

Every window of n consecutive words of a benchmark item is a pattern. A table gives for each block
of two words how far the search may jump before a pattern could end: blocks in no pattern skip a
whole window. Where the jump is nil, the block's bucket and the window's hash select the patterns to
test, and comparing the words themselves confirms. Many stretches of text move through the tables in step, as numpy arrays.

The benchmark is written once in blocks of about ``BLOCK_CHARS`` characters, longer items in overlapping pieces; each block is compiled on
the driver and sent to the workers, which hold one at a time. A larger benchmark means more passes over a slice of texts, not larger tables
or more stages.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pick, remove, scratch, slices
from .words import ALNUM, Words, mix64, sequence_hash

WINDOW = 8
BLOCK_CHARS = 1 << 20
LANE = 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Patterns:
    """Windows of one length m: jumps by block, buckets by last block, and the windows' words."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set[str]], hashes: dict[bytes, int]):
        self.m, self.width = m, min(2, m)
        words = np.array([[hashes[w] for w in win] for win in windows], np.uint64).reshape(-1, m)
        self.bits = int(np.clip(np.ceil(np.log2(8 * words.size + 1)), 10, 24))
        self.jump = np.full(1 << self.bits, m - self.width + 1, np.uint8 if m < 255 else np.int32)
        for end in range(self.width - 1, m):
            slot = self.slot(self.block(words[:, end - 1] if self.width == 2 else None, words[:, end]))
            np.minimum.at(self.jump, slot, m - 1 - end)
        self.bucket = np.unique(self.block(words[:, m - 2] if self.width == 2 else None, words[:, m - 1]))
        full = np.array([sequence_hash(w, m)[0] for w in words], np.uint64)
        order = np.argsort(full, kind="stable")
        self.full, listed = full[order], list(windows.items())
        self.tests = [(b" ".join(listed[i][0]), sorted(listed[i][1])) for i in order]

    def block(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return mix64(last * _B) if before is None else mix64(before * _A + last * _B)

    def slot(self, block: np.ndarray) -> np.ndarray:
        return block >> np.uint64(64 - self.bits)

    def search(self, words: Words) -> Iterator[tuple[int, list[str]]]:
        """(index of the first word, items) of every occurrence; windows don't cross rows."""
        m, h = self.m, words.hash
        begin, stop = words.first[:-1] + m - 1, words.first[1:]
        lanes = np.maximum(0, -(-(stop - begin) // LANE))
        if not lanes.sum():
            return
        nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = np.repeat(begin, lanes) + nth * LANE
        stop = np.minimum(np.repeat(stop, lanes), pos + LANE)
        found = []
        while len(pos):
            block = self.block(h[pos - 1] if self.width == 2 else None, h[pos])
            jump = self.jump[self.slot(block)].astype(np.int64)
            nil = jump == 0
            if nil.any():
                at, block = pos[nil], block[nil]
                k = np.minimum(np.searchsorted(self.bucket, block), len(self.bucket) - 1)
                found.append(at[self.bucket[k] == block])
                jump[nil] = 1
            pos = pos + jump
            on = pos < stop
            pos, stop = pos[on], stop[on]
        if not found:
            return
        first = np.sort(np.concatenate(found)) - m + 1
        full = np.zeros(len(first), np.uint64)
        for k in range(m):
            full = mix64(full * np.uint64(0x9E3779B97F4A7C15) + h[first + k])
        k = np.minimum(np.searchsorted(self.full, full), len(self.full) - 1)
        for i, t in zip(first[self.full[k] == full].tolist(), k[self.full[k] == full].tolist()):
            if b" ".join(words.text(j) for j in range(i, i + m)) == self.tests[t][0]:
                yield i, self.tests[t][1]


def compile_patterns(items: list[tuple[str, str | None]], n: int = WINDOW) -> list[Patterns]:
    """Patterns of (id, text) items, by length: an item of fewer than n words is one window; without words, none."""
    words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    hashes: dict[bytes, int] = {}
    for k, (item, _) in enumerate(items):
        a, b = int(words.first[k]), int(words.first[k + 1])
        own = [words.text(i) for i in range(a, b)]
        hashes.update(zip(own, words.hash[a:b].tolist()))
        m = min(n, b - a)
        for i in range(b - a - m + 1 if m else 0):
            by_length[m][tuple(own[i : i + m])].add(item)
    return [Patterns(m, w, hashes) for m, w in sorted(by_length.items())]


_MARKS = {"n_words": "bigint", "spans": "array<struct<begin:int,end:int>>", "items": "array<string>", "full_hits": "bigint"}


def annotate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, every row and column of it, and four columns more (they replace columns of those names): ``n_words``, ``spans``
    (word ranges inside occurrences, merged), ``items`` (ids with occurring windows, as strings, sorted) and ``full_hits`` (occurrences
    of windows of n words, not of shorter items).

    A null text has no words. A null item id goes by the empty string; items repeated under one id count once.
    Repeated documents and nulls are kept. An empty benchmark hits nothing, an empty table gives an empty one. A very long text is one
    stretch of words after another, in one task.
    """
    spark = docs.sparkSession
    items = pick(benchmark, item=item_col, text=item_text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string"))
    own = [c for c in docs.columns if c not in _MARKS]
    state = docs.select(*[F.col(f"`{c}`") for c in own], *[(F.lit(0) if t == "bigint" else F.array()).cast(t).alias(c) for c, t in _MARKS.items()])
    parts = items.mapInArrow(_pieces(n, block_chars), "item string, text string")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    if blocks == 1:
        read, path = [parts], None
    else:
        path = scratch(spark, "benchmark")
        parts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")).write.partitionBy("block").parquet(path)
        written = spark.read.schema("item string, text string, block int").parquet(path)
        read = [written.where(F.col("block") == b).select("item", "text") for b in range(blocks)]
    sent = [spark.sparkContext.broadcast(compile_patterns([(r.item, r.text) for r in part.collect()], n)) for part in read]
    if path:
        remove(spark, path)
    return state.mapInArrow(_scan(sent, own.index(text_col), len(own), n), state.schema)


def _pieces(n: int, block_chars: int):
    """Items longer than a block as pieces of whole words, each with the n - 1 words before it, so that no window is lost or added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Words(pa.array([text], pa.string()), ALNUM) if text and len(text) > block_chars else None
                if words is None or len(words.start) < n:
                    ids.append(item)
                    texts.append(text)
                    continue
                data = text.encode()
                cuts = [0, *(int(i) for i in np.flatnonzero(np.diff(words.start // block_chars)) + 1), len(words.start)]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    first = max(0, x - n + 1)
                    if y - first >= n:  # fewer words hold no window; those with them stand in the next piece
                        ids.append(item)
                        texts.append(data[words.start[first] : words.end[y - 1]].decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["item", "text"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col`` and the columns that annotate() adds, for each row of docs."""
    return annotate(pick(docs, **{id_col: id_col, "text": text_col}), benchmark, n, **options).drop("text")


def _scan(sent, text_at: int, own: int, n: int):
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], whole.schema.names[text_at], SLICE_BYTES if len(sent) == 1 else 8 * SLICE_BYTES):
                words = Words(batch.column(text_at), ALNUM)
                change = np.zeros(len(words.start) + 1, np.int32)
                items = [set(x) for x in batch.column(own + 2).to_pylist()]
                full = batch.column(own + 3).to_pylist()
                first, touched = words.first, set()
                for row, old in enumerate(batch.column(own + 1).to_pylist()):
                    for s in old:
                        touched.add(row)
                        change[first[row] + s["begin"]] += 1
                        change[first[row] + s["end"]] -= 1
                for block in sent:
                    for p in block.value:
                        for i, ids in p.search(words):
                            change[i] += 1
                            change[i + p.m] -= 1
                            row = int(np.searchsorted(first, i, "right")) - 1
                            touched.add(row)
                            items[row].update(ids)
                            full[row] += p.m == n
                    if len(sent) > 1:
                        block.__dict__.pop("_value", None)  # one block's tables at a time; the file of the broadcast stays
                hit = np.cumsum(change)[:-1] > 0
                spans: list[list[dict]] = [[] for _ in items]
                for row in touched:
                    edge = np.diff(np.concatenate([[0], hit[first[row] : first[row + 1]].astype(np.int8), [0]]))
                    spans[row] = [{"begin": a, "end": b} for a, b in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]
                marks = [pa.array(np.diff(first), pa.int64()), pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(full, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], *marks], whole.schema.names)

    return run


def leaked():
    """A document to leave out: it holds a whole window of some item, or passages of two items, however short these are."""
    return (F.col("full_hits") > 0) | (F.size("items") >= 2)


def n_hit(spans: str = "spans"):
    """Words inside spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
