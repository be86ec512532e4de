"""Length-delimited binary records of token ids.

A file holds records back to back: the payload's length (unsigned 64-bit), the masked CRC-32C of
those eight bytes, the payload, and its masked CRC-32C, all little-endian. The payload is a doc id
(signed 64-bit, the lowest value for null), a byte for the width of an id, and the ids.
A second file of the same name with ``.idx`` holds the offset of each record (unsigned 64-bit) for shuffled reads.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SLICE_BYTES, pick, slices
from .shards import MANIFEST, ShardFile, dealt, manifest_batch, opened, publish, ranges

FILE_BYTES = 128 << 20
TASK_BYTES = 16 << 20
TABLE_WORDS = 400_000
NO_ID = -(1 << 63)

# --- checksums ---------------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)  # the reflected Castagnoli polynomial
    return t


_T0 = _byte_table()
_BLOCK = 512
_ZEROS = bytes(_BLOCK)


def _after(steps: int, table: np.ndarray) -> np.ndarray:
    """A table of registers after so many more zero bytes."""
    for _ in range(steps):
        table = (table >> 8) ^ _T0[table & 0xFF]
    return table


#: What two bytes add to a register once both are taken.
_T2 = _after(2, np.arange(1 << 16, dtype=np.uint32))
#: What each byte of a register becomes after a whole block.
_SKIP = [_after(_BLOCK, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)).tolist() for i in range(4)]


def crc32c(data: bytes) -> int:
    """CRC-32C of some bytes."""
    if len(data) < 4:
        crc = 0xFFFFFFFF
        for b in data:
            crc = (crc >> 8) ^ int(_T0[(crc ^ b) & 0xFF])
        return crc ^ 0xFFFFFFFF
    return crc32c_all([data])[0]


def _through(rows: np.ndarray) -> np.ndarray:
    """The register that each row of two-byte numbers leaves, from a register of zeros; all rows go through the table in step."""
    state = np.zeros(len(rows), np.uint32)
    low, at, step = state.view("<u2")[::2], np.empty(len(rows), np.intp), np.empty(len(rows), np.uint32)
    for pair in np.ascontiguousarray(rows.T):
        np.bitwise_xor(low, pair, out=at, casting="unsafe")
        _T2.take(at, out=step, mode="clip")
        np.right_shift(state, 16, out=state)
        np.bitwise_xor(state, step, out=state)
    return state


def _crc32c_sizes(sizes: np.ndarray) -> list[int]:
    """CRC-32C of each of some unsigned 64-bit numbers."""
    return (_through((sizes.astype("<u8") ^ np.uint64(0xFFFFFFFF)).view("<u2").reshape(-1, 4)) ^ np.uint32(0xFFFFFFFF)).tolist()


def crc32c_all(parts: list) -> list[int]:
    """CRC-32C of each of some byte strings of four bytes or more.

    A register of zeros ignores leading zeros, so each is padded in front to whole blocks; the blocks of all of them then go
    through the table in step, two bytes at a time, and what blocks give is chained for each string.
    """
    if not parts:
        return []
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    blocks = -(-sizes // _BLOCK)
    lead = (blocks * _BLOCK - sizes).tolist()
    padded = np.frombuffer(bytearray().join(chain.from_iterable(zip([_ZEROS[:n] for n in lead], parts))), np.uint8)
    first = np.cumsum(blocks * _BLOCK) - sizes
    for i in range(4):
        padded[first + i] ^= 0xFF
    states, at, out = _through(padded.view("<u2").reshape(-1, _BLOCK // 2)).tolist(), 0, []
    s0, s1, s2, s3 = _SKIP
    for n in blocks.tolist():
        crc = 0
        for block in states[at : at + n]:
            crc = s0[crc & 255] ^ s1[crc >> 8 & 255] ^ s2[crc >> 16 & 255] ^ s3[crc >> 24] ^ block
        at += n
        out.append(crc ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frames(payloads: list[bytes]) -> list[bytes]:
    """The record of each payload (of four bytes or more)."""
    checks = _crc32c_sizes(np.fromiter(map(len, payloads), np.uint64, len(payloads)))
    return [b"".join((struct.pack("<QI", len(p), masked(a)), p, struct.pack("<I", masked(b)))) for a, p, b in zip(checks, payloads, crc32c_all(payloads))]


def frame(payload: bytes) -> bytes:
    return frames([payload])[0]


def unframe(stream, together: int = SLICE_BYTES) -> Iterator[bytes]:
    """The payloads of a stream, checked some MB ``together``; a short or wrong record is an error."""
    heads, bodies, held = [], [], 0
    while head := stream.read(12):
        n = struct.unpack("<Q", head[:8])[0] if len(head) == 12 else 0
        if len(head) < 12 or n > together and struct.unpack("<I", head[8:])[0] != masked(crc32c(head[:8])):
            raise ValueError("a record's length is damaged")
        body = stream.read(n + 4)
        if len(body) < n + 4:
            _check(heads, bodies)
            raise ValueError("a record is damaged")
        heads.append(head)
        bodies.append(body)
        held += len(body)
        if held > together:
            _check(heads, bodies)
            yield from (b[:-4] for b in bodies)
            heads, bodies, held = [], [], 0
    _check(heads, bodies)
    yield from (b[:-4] for b in bodies)


def _check(heads: list[bytes], bodies: list[bytes]) -> None:
    stated = [struct.unpack("<I", h[8:])[0] for h in heads], [struct.unpack("<I", b[-4:])[0] for b in bodies]
    if stated[0] != [masked(c) for c in _crc32c_sizes(np.array([struct.unpack("<Q", h[:8])[0] for h in heads], np.uint64))]:
        raise ValueError("a record's length is damaged")
    if any(len(b) < 8 for b in bodies) or stated[1] != [masked(c) for c in crc32c_all([memoryview(b)[:-4] for b in bodies])]:
        raise ValueError("a record is damaged")


# --- encoding ----------------------------------------------------------------------------------

_encoders: dict[str, "WordEncoder"] = {}
#: Letters that normalization and lower-casing leave as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_PLAIN_WORD, _STOP = "^[a-zß-öø-ÿ]+[.,]?$", "([.,])$"
#: A word of such letters, and marks of ASCII after it: the library splits there, so both have ids of their own. Apostrophes can start a
#: pre-token with letters, and < a special token.
_TAILED, _TAIL = r"^([a-zß-öø-ÿ]+)[!-&(-/:;=-@\[-`{-~]+$", r"^[a-zß-öø-ÿ]+"
#: Marks that can be composed with a letter A-Z before them (U+0300 to U+036F): there, lower-casing first is not the same.
_MARKS = r"\xcc|\xcd[\x80-\xaf]"


class WordEncoder:
    """Ids of whole texts for a tokenizer that lower-cases and drops white space: each distinct word goes to the library once.

    Such a tokenizer never joins across a blank, so a text's ids are those of its words in turn.
    Texts with the mark of a special token go to the library whole, and so does every text if the
    tokenizer's file shows another normalizer.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed"
        self.special = {t["content"][:2] for t in spec["added_tokens"]}
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.table: dict[str, bytes] = {}
        self.again: set[str] = set()
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.letter = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printed)}
        ids = lambda t: self.lib.encode(t, add_special_tokens=False).ids
        self.stops = {c: ids(c) for c in ".,"}
        probes = ("a", "word", "the.", "straße,", "coração", "x,", "unlikelihoodness.")
        self.direct = self.by_word and all(self.plain(x) == ids(x) for x in probes)
        self.fast, self.last = self._splitter(spec) if self.direct else (None, None)
        if self.fast:
            self.learn(list(probes))
            if any(np.frombuffer(self.table[x], f"<u{self.width}").tolist() != ids(x) for x in probes):
                self.fast = None
            self.table = {}
        marks = ["".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"), ".", ",", "$$$", "!?", "_", "/-"]
        self.tails = bool(self.fast) and all(ids(a + b) == ids(a) + ids(b) for a in ("a", "word", "straße", "coração") for b in [*marks, *marks[0]])

    def _splitter(self, spec: dict):
        """(the library's model, splitting at blanks only; which ids end a word), if ids tell where words end."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix:
            return None, None
        fast = Tokenizer(self.lib.model)
        fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = np.zeros(self.lib.get_vocab_size() + 1, bool)
        last[[i for t, i in self.lib.get_vocab().items() if t.endswith(suffix)]] = True
        return fast, last

    def plain(self, word: str) -> list[int] | None:
        """The ids of a word of Latin small letters, with or without a stop, from the library's model itself: such a word is one pre-token, a
        stop another, so the library's slow splitting can be spared. None for other words."""
        stop = self.stops.get(word[-1:], [])
        letters = word[:-1] if stop else word
        if not _PLAIN.fullmatch(letters):
            return None
        if not letters.isascii():
            letters = "".join(map(self.letter.__getitem__, letters.encode()))
        return [t.id for t in self.lib.model.tokenize(letters)] + stop

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``width`` each."""
        col = pa.array(texts, pa.large_string())
        whole = np.zeros(len(texts), bool)
        if not self.by_word:
            whole[:] = True
        else:
            for s in self.special:
                whole |= pa.compute.match_substring(col, s).to_numpy(zero_copy_only=False)
        marked = pa.compute.match_substring_regex(col.cast(pa.large_binary()), _MARKS).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for rows, lower in ((~whole & ~marked, True), (~whole & marked, False)):
            at = np.flatnonzero(rows)
            if len(at):
                for i, x in zip(at.tolist(), self._by_word(col.take(pa.array(at)), lower)):
                    out[i] = x
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, f"<u{self.width}").tobytes()
        return out

    def _by_word(self, col: pa.Array, lower: bool) -> list[bytes]:
        """Words are split, numbered and put together again in Arrow's own code; Python sees each distinct word of the texts once."""
        col = pa.compute.replace_substring(pa.compute.ascii_lower(col) if lower else col, "\n", " ")
        lists = pa.compute.split_pattern(col, " ")
        coded = lists.flatten().dictionary_encode()
        ids = self._of_words(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        edges = np.frombuffer(offsets, np.int64)[: len(ids) + 1][lists.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def _of_words(self, col: pa.Array) -> pa.Array:
        """The ids of distinct words; one with marks at its end shares the table's entry of the word without them."""
        if not self.tails:
            return pa.array(self.known(col.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        heads = pa.compute.replace_substring_regex(col, _TAILED, r"\1")
        tailed = pa.compute.not_equal(heads, col)
        tails = pa.compute.replace_substring_regex(col.filter(tailed), _TAIL, "").dictionary_encode()
        heads = heads.dictionary_encode()
        ends = self.known(tails.dictionary.to_numpy(zero_copy_only=False).tolist())
        out = pa.array(self.known(heads.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(heads.indices)
        if not ends:
            return out
        both = pa.compute.binary_join_element_wise(out.filter(tailed), pa.array(ends, pa.large_binary()).take(tails.indices), pa.scalar(b"", pa.large_binary()))
        return pa.compute.replace_with_mask(out, tailed, both)

    def known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, learnt where the table lacks them.

        A full table starts anew with the words that were met again while its last quarter filled up: those are the frequent ones.
        """
        if len(self.table) > TABLE_WORDS:
            # Where they alone would fill half of it, none is frequent.
            self.table = {w: self.table[w] for w in self.again if w in self.table} if len(self.again) <= TABLE_WORDS // 2 else {}
            self.again = set()
        table = self.table
        out = list(map(table.get, words))
        lacking = [i for i, x in enumerate(out) if x is None]
        if len(table) > TABLE_WORDS * 3 // 4 and len(self.again) <= TABLE_WORDS // 2:
            self.again.update(w for w, x in zip(words, out) if x is not None)
        self.learn([words[i] for i in lacking])
        for i in lacking:
            out[i] = table[words[i]]
        return out

    def learn(self, new: list[str]) -> None:
        """Add words that the table lacks."""
        table, kind = self.table, f"<u{self.width}"
        if self.fast and new:
            col = pa.array(new, pa.string())
            plain = pa.compute.match_substring_regex(col, _PLAIN_WORD)
            known = col.filter(plain)
            parts = pa.compute.add(pa.compute.match_substring_regex(known, _STOP).cast(pa.int64()), 1).to_numpy()
            spaced = pa.compute.replace_substring_regex(known, _STOP, r" \1").to_numpy(zero_copy_only=False).tolist()
            found = self.fast.encode_batch_fast([" ".join(spaced[a : a + 100]) for a in range(0, len(spaced), 100)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in found), kind)
            edges = ((np.flatnonzero(self.last[ids])[np.cumsum(parts) - 1] + 1) * self.width).tolist()
            data = ids.tobytes()
            table.update(zip(known.to_numpy(zero_copy_only=False).tolist(), [data[x:y] for x, y in zip([0, *edges], edges)]))
            new = col.filter(pa.compute.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            for w, e in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False)):
                table[w] = np.array(e.ids, kind).tobytes()


# --- writing and reading -----------------------------------------------------------------------


def write_records(df: DataFrame, base: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, range_bytes: int | None = None) -> DataFrame:
    """Encode the texts and write them below ``base`` in ascending id order; returns the manifest.

    Texts, not ids, are dealt out by exact ranges of the id, as they are smaller; each task sorts its
    ranges and starts a new file with each, and past ``file_bytes``. Names and bytes of the files depend on the rows alone. Null
    ids come first, a null text is empty, repeated ids stand next to each other (null texts first, the others in the order of a
    hash). Other columns are dropped. An empty table writes no file. A long text is one record, held in memory by its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        end = b"" if end_id is None else np.array([end_id], f"<u{encoder.width}").tobytes()
        out = index = None
        shard, seq = -1, 0
        for batch in slices(batches, "text"):
            docs = batch.column(1).to_pylist()
            data = [d + end for d in encoder.ids([t or "" for t in batch.column(2).to_pylist()])]
            packed = frames([struct.pack("<qB", d, encoder.width) + x for d, x in zip(docs, data)])
            for now, record, ids in zip(batch.column(0).to_pylist(), packed, data):
                if now != shard:
                    if out is not None:
                        yield manifest_batch([out.close(), index.close()])
                    out, shard, seq = None, now, 0
                if out is None:
                    out, index = ShardFile(base, shard, seq, ".rec"), ShardFile(base, shard, seq, ".idx")
                index.write(struct.pack("<Q", out.bytes))
                out.write(record, 1, len(ids) // encoder.width)
                if out.bytes > file_bytes:
                    yield manifest_batch([out.close(), index.close()])
                    out, seq = None, seq + 1
        if out is not None:
            yield manifest_batch([out.close(), index.close()])

    rows = pick(df, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string"))
    rows = rows.withColumn("tie", F.when(F.col("text").isNull(), F.lit(NO_ID)).otherwise(F.xxhash64("text")))
    bounds = ranges(rows, F.coalesce(F.octet_length("text"), F.lit(0)) + 16, range_bytes)
    files = dealt(rows, bounds).sortWithinPartitions("shard", "id", "tie", "text").select("shard", "id", "text").mapInArrow(run, MANIFEST)
    return publish(df.sparkSession, files, base, "tokens")


def read_records(spark: SparkSession, base: str, packed: bool = False) -> DataFrame:
    """doc_id, start (ids of all records before it) and ids, from the files that the manifest lists.

    packed: ids as little-endian unsigned 32-bit integers in a binary column, which Spark moves and digests as a whole.
    A task reads files of ``TASK_BYTES`` together, or fewer where that would leave cores idle.
    """
    files = spark.read.parquet(f"{base}/manifest").where(F.col("path").endswith(".rec"))
    # One row for each file: its start is the sum of the ids of the files before it.
    files = files.withColumn("start", F.sum("units").over(Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{root}/{path}", compression=None, buffer_size=1 << 20) as stream:
                    docs, starts, parts, held = [], [], [], 0
                    for payload in unframe(stream):
                        doc, width = struct.unpack("<qB", payload[:9])
                        ids = np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4" if packed else np.int32)
                        docs.append(None if doc == NO_ID else doc)
                        starts.append(start)
                        parts.append(ids)
                        start += len(ids)
                        held += ids.nbytes
                        if held > SLICE_BYTES:
                            yield _batch(docs, starts, parts, packed=packed)
                            docs, starts, parts, held = [], [], [], 0
                    if docs:
                        yield _batch(docs, starts, parts, packed=packed)

    n, size = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = min(n, max(size // TASK_BYTES, 4 * spark.sparkContext.defaultParallelism))
    spread = files.select("path", "start").repartition(max(1, tasks))
    return spread.mapInArrow(run, f"doc_id bigint, start bigint, ids {'binary' if packed else 'array<int>'}")


def read_shuffled(spark: SparkSession, base: str, seed: int = 0, open_files: int = 32) -> DataFrame:
    """doc_id, ids, and ``place`` (the place in the shuffled order, a random 64-bit number): the records in an order that depends on
    the seed only, each read at its offset from the index. Partitions hold consecutive stretches of that order.

    Only places and offsets are sorted; records are read where they are wanted, with at most ``open_files`` files open in a task.
    """
    files = spark.read.parquet(f"{base}/manifest").where(F.col("path").endswith(".idx"))

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    while data := stream.read(SLICE_BYTES):
                        at = pa.array(np.frombuffer(data, "<u8").astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array([path[:-4] + ".rec"] * len(at), pa.string()), at], ["path", "at"])

    def placed(rows: list[tuple]) -> pa.RecordBatch:
        _check([h for _, h, _ in rows], [b for _, _, b in rows])
        heads = [struct.unpack("<qB", b[:9]) for _, _, b in rows]
        parts = [np.frombuffer(memoryview(b)[9:-4], f"<u{width}").astype(np.int32) for (_, width), (_, _, b) in zip(heads, rows)]
        return _batch([None if d == NO_ID else d for d, _ in heads], [p for p, _, _ in rows], parts, "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        files: dict = {}
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for path, at, place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                stream = files.pop(path, None) or fs.open_input_file(f"{root}/{path}")
                files[path] = stream  # the last used one stands last
                if len(files) > open_files:
                    files.pop(next(iter(files))).close()
                stream.seek(at)
                head = stream.read(12)
                rows.append((place, head, stream.read(struct.unpack("<Q", head[:8])[0] + 4)))
                held += len(rows[-1][2])
                if held > SLICE_BYTES:
                    yield placed(rows)
                    rows, held = [], 0
            if rows:
                yield placed(rows)
        for stream in files.values():
            stream.close()

    order = files.select("path").repartition(max(1, files.count())).mapInArrow(offsets, "path string, at bigint").withColumn("place", F.xxhash64(F.lit(seed), "path", "at"))
    return order.repartitionByRange("place", "path", "at").sortWithinPartitions("place", "path", "at").mapInArrow(run, "doc_id bigint, place bigint, ids array<int>")


def _batch(docs: list, starts: list, parts: list, name: str = "start", packed: bool = False) -> pa.RecordBatch:
    values = np.concatenate(parts)
    offsets = np.cumsum([0, *map(len, parts)])
    if packed:
        offsets = (offsets * 4).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    else:
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), ids], ["doc_id", name, "ids"])
