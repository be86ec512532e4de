"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of the model holds a white space marker after another character, merges never
cross from a word into the next marker, so a text splits into chunks (markers and the word after
them) whose segmentations are independent. Each distinct chunk is segmented and decoded once by
the library; ids and strings are joined back by position. A model without that property is
refused, as is one that rewrites text before it segments it.

Memory: a task's table starts anew once its chunks pass ``TABLE_BYTES``, and goes with the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pick, release, slices

MARK = "▁"
TABLE_BYTES = 32 << 20
#: Bytes of text whose chunks a worker lists at once; the lists take some 16 times as much.
TEXT_BYTES = SLICE_BYTES // 4
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
_processors: dict = {}


def splits_at_markers(processor) -> bool:
    """Whether chunks can be segmented on their own: pieces don't cross markers, and texts aren't rewritten."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    probe = "a  Bé 　Å\t\n x "
    return not any(MARK in p.lstrip(MARK) for p in pieces) and processor.decode(processor.encode(probe)) == probe and processor.encode("", out_type=str) == []


class _Decoded(dict):
    """What a chunk decodes to: itself with blanks for markers, unless it is held here."""

    def __missing__(self, chunk: str) -> str:
        return chunk.replace(MARK, " ")


class ChunkTable:
    def __init__(self, model: str):
        if model not in _processors:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=model)
            if not splits_at_markers(sp):
                raise ValueError("pieces of this model can cross white space markers")
            _processors[model] = sp
        self.sp = _processors[model]
        self.first, self.last = self.sp.bos_id(), self.sp.eos_id()
        self.ids: dict[str, bytes] = {}
        self.words = _Decoded()
        self.held = 0

    def learn(self, chunks: list[str]) -> None:
        """Add the chunks that the table lacks; starts anew when it is full."""
        if self.held > TABLE_BYTES:
            self.ids, self.words, self.held = {}, _Decoded(), 0
        new = list({c for c in chunks if c not in self.ids})
        # The library puts a marker before a text, so each chunk goes in without its first one.
        for c, ids in zip(new, self.sp.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)):
            if len(c) == 1:
                ids = [self.sp.piece_to_id(MARK)]
            self.ids[c] = np.array(ids, "<i4").tobytes()
            self.held += 180 + 4 * len(c) + 4 * len(ids)  # an entry of the dictionary, while it grows, and two objects
            word = " " + self.sp.decode(ids) if len(c) > 1 else " "
            if word != c.replace(MARK, " "):
                self.words[c] = word
                self.held += 180 + 4 * len(word)

    @staticmethod
    def chunks(text: str) -> list[str]:
        text = MARK + text.replace(" ", MARK) if text else ""
        return _CHUNKS.findall(text)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Ids, without ends, and decoded strings. The lists of chunks, many times the size of the texts, go on return."""
        docs = [self.chunks(t or "") for t in texts]
        self.learn([c for d in docs for c in d])
        plain = map(self.words.keys().isdisjoint, docs)
        decoded = [(t or "").replace(MARK, " ") if p else "".join(map(self.words.__getitem__, d))[1:] for t, d, p in zip(texts, docs, plain)]
        return [b"".join(map(self.ids.__getitem__, d)) for d in docs], decoded


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True, packed: bool = False) -> DataFrame:
    """``id_col``, ``ids array<int>`` as the library encodes the whole text (with begin and end ids if ``ends``), and
    ``decoded``, what the library's decode(ids) returns.

    packed: ids as little-endian unsigned 32-bit integers in a binary column, which Spark digests without a second worker.
    A null text is an empty one, with no ids but the ends. Repeated rows and null ids are kept;
    other columns are dropped, whatever their names. An empty table gives an empty table. A very long text is read whole, by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        head, tail = (np.array([i] if ends else [], "<i4").tobytes() for i in (table.first, table.last))
        for batch in slices(batches, "text", TEXT_BYTES):
            ids, texts = table.encode(batch.column(1).to_pylist())
            ids = [head + x + tail for x in ids]
            if packed:
                listed = pa.array(ids, pa.binary())
            else:
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed, pa.array(texts, pa.string())], ["id", "ids", "decoded"])
        del table
        release()

    rows = pick(df, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids {'binary' if packed else 'array<int>'}, decoded string").withColumnRenamed("id", id_col)


def digests() -> list[Column]:
    """``n_tokens``, ``decoded_sha256`` and ``ids_sha256`` of rows that encode() gave with packed ids."""
    n = (F.octet_length("ids") / 4).cast("bigint")
    return [n.alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("ids", 256).alias("ids_sha256")]
