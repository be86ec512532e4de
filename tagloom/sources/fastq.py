"""FASTQ as a Spark data source: ``spark.read.format("fastq")`` and ``df.write.format("fastq")``.

Reading: options path and path2 name the files of first and second mates, several separated by commas (files of
one run, in order). Compressed files can't be split, so each file, or pair of files, is one task; runs
come in many. ``ord`` counts reads from 0 within a file pair and adds ``FILE_STEP`` for each file before it. Mates are zipped in the
reader, which checks that both files end together and that names agree. skip and limit are applied while reading a single file pair.

Writing: every task writes one segment for each file it has reads of; the segments of a file are joined in task
order (gzip members may follow each other) under its final name: by write_fastq() in one task a file, otherwise in the commit. So order is
kept without a shuffle, and a failed or repeated task leaves nothing behind.
"""

from __future__ import annotations

import gzip
import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import FastqError, OutputError, PairError
from ..plans.config import Options, Sheet

FILE_STEP = 1 << 40
BATCH = 8192


def filesystem(path: str):
    """(file system, path) of a path or URI, for any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def exists(path: str) -> bool:
    from pyarrow import fs as pafs

    fs, at = filesystem(path)
    return fs.get_file_info(at).type == pafs.FileType.File


def content(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed bytes of a plain or gzip file, piece by piece."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as raw:
        head = raw.read(2)
    with fs.open_input_stream(at, compression=None) as raw:
        stream = gzip.GzipFile(fileobj=raw) if head == b"\x1f\x8b" else raw
        while data := stream.read(size):
            yield data


def records(path: str) -> Iterator[tuple[str, str, str]]:
    """(name, sequence, quality) of a plain or gzip FASTQ file; sequences are upper-cased, other bytes stay (as Latin-1)."""
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as raw:
        head = raw.read(2)
    with fs.open_input_stream(at, compression=None) as raw:
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if head == b"\x1f\x8b" else raw, 1 << 20)
        n = 0
        while first := stream.readline():
            if not first.strip():
                continue
            n += 1
            seq, plus, qual = stream.readline().rstrip(b"\r\n"), stream.readline(), stream.readline().rstrip(b"\r\n")
            if first[:1] != b"@" or plus[:1] != b"+":
                raise FastqError(f"{path}: record {n} is no FASTQ record")
            if len(seq) != len(qual):
                raise FastqError(f"{path}: record {n} has {len(seq)} bases and {len(qual)} qualities")
            yield first[1:].rstrip(b"\r\n").decode("latin-1"), seq.upper().decode("latin-1"), qual.decode("latin-1")


def plain_id(name: str) -> str:
    cut = min([i for i in (name.find(" "), name.find("\t")) if i >= 0], default=len(name))
    name = name[:cut]
    return name[:-2] if name.endswith(("/1", "/2")) else name


def arrays(path: str, size: int = 1 << 22) -> Iterator[list[pa.Array]]:
    """The names, sequences and qualities of a file, some MB at a time, as string arrays.

    Lines are split, trimmed and upper-cased by Arrow. Where a stretch isn't records of four ASCII lines, records() takes over from the
    first record not yet given: it knows blank lines and other bytes, and says what is wrong.
    """
    pc, rest, done = pa.compute, b"", 0
    for data in chain(content(path, size), [None]):
        if data is None:
            if not rest:
                return
            text, rest = rest + (b"" if rest.endswith(b"\n") else b"\n"), b""
        else:
            text = rest + data
        raw = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(raw == 10)
        n = len(ends) // 4 * 4
        if data is not None and not n:
            rest = text
            continue
        starts = np.concatenate([[0], ends + 1])
        if data is None and starts[n] < len(text) or (raw >= 128).any() or len(text) >= 1 << 31:
            break
        rest = text[starts[n] :] if data is not None else b""
        lines = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(starts[: n + 1].astype(np.int32).tobytes()), pa.py_buffer(text)])
        name, seq, plus, qual = (pc.ascii_rtrim(lines.take(pa.array(np.arange(k, n, 4))), characters="\r\n") for k in range(4))
        whole = pc.all(pc.and_(pc.and_(pc.starts_with(name, "@"), pc.starts_with(plus, "+")), pc.equal(pc.binary_length(seq), pc.binary_length(qual)))).as_py()
        if n and not whole:
            break
        if n:
            yield [pc.utf8_slice_codeunits(name, 1), pc.ascii_upper(seq), qual]
            done += n // 4
    else:
        return
    rows = islice(records(path), done, None)
    while part := list(islice(rows, BATCH)):
        yield [pa.array(c, pa.string()) for c in zip(*part)]


def plain_ids(names: pa.Array) -> pa.Array:
    """plain_id() of each name."""
    pc = pa.compute
    return pc.replace_substring_regex(pc.replace_substring_regex(names, "^([^ \t]*).*$", r"\1"), "/[12]$", "")


def paired_arrays(path1: str, path2: str) -> Iterator[list[pa.Array]]:
    """The arrays of both mates side by side, checked: both files end together and names agree."""
    streams, held, n = (arrays(path1), arrays(path2)), [None, None], 0
    while True:
        for k in (0, 1):
            while held[k] is None or not len(held[k][0]):
                held[k] = next(streams[k], None)
                if held[k] is None:
                    break
        if held[0] is None and held[1] is None:
            return
        if held[0] is None or held[1] is None:
            raise PairError(f"{'R1' if held[0] is None else 'R2'} ended before {'R2' if held[0] is None else 'R1'} at record {n + 1}")
        size = min(len(held[0][0]), len(held[1][0]))
        one, two = ([c.slice(0, size) for c in h] for h in held)
        same = pa.compute.equal(plain_ids(one[0]), plain_ids(two[0]))
        if not pa.compute.all(same).as_py():
            at = same.to_pylist().index(False)
            raise PairError(f"record {n + at + 1}: mates are named {one[0][at].as_py()!r} and {two[0][at].as_py()!r}")
        yield [*one, *two]
        n += size
        held = [[c.slice(size) for c in h] for h in held]


@dataclass
class _Files(InputPartition):
    path: str
    path2: str | None
    first: int

    def __init__(self, path, path2, first):
        super().__init__((path, path2, first))
        self.path, self.path2, self.first = path, path2, first


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        one = [p for p in options.get("path", "").split(",") if p]
        two = [p for p in options.get("path2", "").split(",") if p]
        if not one:
            raise FastqError("the option path is missing")
        if two and len(two) != len(one):
            raise PairError("path and path2 name different numbers of files")
        if two and set(one) & set(two):
            raise PairError("a file can't hold both mates")
        self.skip, self.limit = int(options.get("skip", 0)), int(options.get("limit", 0))
        if (self.skip or self.limit) and len(one) > 1:
            raise FastqError("skip and limit take one file or pair of files")
        self.files = [_Files(p, two[i] if two else None, i * FILE_STEP) for i, p in enumerate(one)]
        self.paired = bool(two)

    def partitions(self):
        return self.files

    def read(self, partition):
        parts = paired_arrays(partition.path, partition.path2) if self.paired else arrays(partition.path)
        names = [f"{m}_{f}" for m in (("r1", "r2") if self.paired else ("r1",)) for f in ("name", "seq", "qual")]
        at, stop = 0, self.skip + self.limit if self.limit else None
        for columns in parts:
            n = len(columns[0])
            a, b = max(self.skip - at, 0), n if stop is None else min(stop - at, n)
            for x in range(a, b, BATCH):
                size = min(BATCH, b - x)
                ords = pa.array(np.arange(size, dtype=np.int64) + (partition.first + at + x))
                yield pa.RecordBatch.from_arrays([ords, *(c.slice(x, size) for c in columns)], ["ord", *names])
            at += n
            if stop is not None and at >= stop:
                return


#: The list of a write's segments, by file and in order; it stands once the write has succeeded.
LIST = "segments.tsv"


def join(fs, root: str, staging: str, name: str, segments: list[str]) -> None:
    """Put segments behind each other and give the result its name; a lone one is only renamed. May be repeated: a file that has its name is done."""
    from pyarrow import fs as pafs

    if len(segments) == 1:
        if fs.get_file_info(f"{root}/{segments[0]}").type == pafs.FileType.File:
            fs.move(f"{root}/{segments[0]}", f"{root}/{name}")
        return
    temp = f"{root}/{staging}/{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        for s in segments:
            with fs.open_input_stream(f"{root}/{s}", compression=None) as part:
                while data := part.read(1 << 22):
                    out.write(data)
    fs.move(temp, f"{root}/{name}")


@dataclass
class _Segments(WriterCommitMessage):
    partition: int
    files: dict = field(default_factory=dict)


class FastqWriter(DataSourceArrowWriter):
    """Writes columns file (relative path) and text."""

    def __init__(self, options: dict):
        self.base, self.level = options["path"], int(options.get("level", 6))
        self.plain = options.get("gzip", "true").lower() == "false"
        self.staging = options.get("staging") or f"_staging-{uuid.uuid4().hex}"
        self.join = options.get("join", "true").lower() == "true"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = filesystem(self.base)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)
        partition, token = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, files = {}, {}
        try:
            for batch in iterator:
                by_file: dict[str, list[str]] = {}
                for name, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist()):
                    by_file.setdefault(name, []).append(text)
                for name, texts in by_file.items():
                    if name not in out:
                        files[name] = f"{self.staging}/{partition:05d}-{token}-{len(files)}"
                        raw = fs.open_output_stream(f"{root}/{files[name]}", compression=None)
                        out[name] = (raw, raw if self.plain else gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=self.level, mtime=0))
                    out[name][1].write("".join(texts).encode("latin-1"))
        finally:
            for raw, packed in out.values():
                if packed is not raw:
                    packed.close()
                raw.close()
        return _Segments(partition, files)

    def commit(self, messages):
        fs, root = filesystem(self.base)
        parts: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, segment in m.files.items():
                parts.setdefault(name, []).append(segment)
        if not parts:
            return
        if self.join:
            for name, segments in parts.items():
                join(fs, root, self.staging, name, segments)
            fs.delete_dir(f"{root}/{self.staging}")
        else:
            with fs.open_output_stream(f"{root}/{self.staging}/{LIST}", compression=None) as out:
                out.write("".join(f"{name}\t{segment}\n" for name, segments in parts.items() for segment in segments).encode())

    def abort(self, messages):
        from pyarrow import fs as pafs

        fs, root = filesystem(self.base)
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        mates = ("r1", "r2") if self.options.get("path2") else ("r1",)
        return "ord bigint, " + ", ".join(f"{m}_{f} string" for m in mates for f in ("name", "seq", "qual"))

    def reader(self, schema):
        return FastqReader(self.options)

    def writer(self, schema, overwrite):
        return FastqWriter(self.options)


def read_fastq(spark: SparkSession, path: str, path2: str | None = None, skip: int = 0, limit: int = 0) -> DataFrame:
    spark.dataSource.register(FastqSource)
    options = {"path": path, "skip": skip, "limit": limit} | ({"path2": path2} if path2 else {})
    return spark.read.format("fastq").options(**options).load()


def file_name(prefix: str, label: str, mate: str | None, gz: bool) -> str:
    return f"{prefix}_{label}{f'_{mate}' if mate else ''}.{'fastq.gz' if gz else 'fastq'}"


def check_prefix(prefix: str) -> str:
    if not prefix.strip() or "/" in prefix or "\\" in prefix or prefix.strip() in (".", ".."):
        raise OutputError(f"{prefix!r} can't begin file names")
    return prefix


def plan_outputs(out_dir: str, prefix: str, sheet: Sheet, options: Options, paired: bool, gz: bool = True, summary: str | None = None) -> list[str]:
    """Every file that a run may write, matched or not; the summary last."""
    labels = [] if options.counts_only else [s.label for s in sheet.samples] + ([] if options.discard_unassigned else ["unassigned"])
    files = [os.path.join(out_dir, file_name(prefix, n, m, gz)) for n in labels for m in (("R1", "R2") if paired else (None,))]
    return [*files, summary or os.path.join(out_dir, f"{prefix}.summary.tsv")]


def preflight(planned: list[str], inputs: list[str], force: bool) -> None:
    """Refuse outputs that collide, that would overwrite an input (even with force), or that exist (without it)."""
    real = [os.path.realpath(p) for p in planned]
    if len(set(real)) < len(real):
        raise OutputError("two outputs would share a file")
    if hit := set(real) & {os.path.realpath(p) for p in inputs}:
        raise OutputError(f"{sorted(hit)[0]} is an input")
    if not force and (there := [p for p in planned if os.path.exists(p)]):
        raise OutputError(f"{there[0]} exists")


def write_fastq(df: DataFrame, out_dir: str, prefix: str, paired: bool, gz: bool = True, level: int = 6) -> None:
    """Write the reads of a demux plan, one file for each label and mate with reads, in input order."""
    from ..functions.reads import fastq_text

    df.sparkSession.dataSource.register(FastqSource)
    text = lambda m: fastq_text(F.col(f"{m}_name"), F.col(f"{m}_seq"), F.col(f"{m}_qual"))
    ext = "fastq.gz" if gz else "fastq"
    mates = (("r1", "_R1"), ("r2", "_R2")) if paired else (("r1", ""),)
    rows = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{prefix}_"), "label", F.lit(f"{suffix}.{ext}")).alias("file"), text(m).alias("text")) for m, suffix in mates]))
    staging = f"_staging-{uuid.uuid4().hex}"
    df.select(rows.alias("x")).select("x.file", "x.text").write.format("fastq").mode("append").options(path=out_dir, level=level, gzip=str(gz).lower(), staging=staging, join="false").save()
    _join_all(df.sparkSession, out_dir, staging)


def _join_all(spark: SparkSession, out_dir: str, staging: str) -> None:
    """Join the segments of a write, one task a file; the driver reads their list only."""
    from pyarrow import fs as pafs

    fs, root = filesystem(out_dir)
    if fs.get_file_info(f"{root}/{staging}/{LIST}").type != pafs.FileType.File:
        return  # no task had rows
    parts: dict[str, list[str]] = {}
    with fs.open_input_stream(f"{root}/{staging}/{LIST}", compression=None) as stream:
        for line in stream.read().decode().splitlines():
            name, segment = line.split("\t")
            parts.setdefault(name, []).append(segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out_dir)
        for batch in batches:
            for name, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                join(fs, root, staging, name, segments)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"])

    files = spark.createDataFrame(list(parts.items()), "file string, segments array<string>").repartition(len(parts))
    files.mapInArrow(run, "file string").count()
    fs.delete_dir(f"{root}/{staging}")


def head(spark: SparkSession, path: str, path2: str, out: str, out2: str, n: int, level: int = 1) -> None:
    """The first n pairs of two files, as two gzip files; input that ends before is an error, and nothing is written."""
    from ..functions.reads import fastq_text

    df = read_fastq(spark, path, path2, limit=n)
    if (have := df.count()) < n:
        raise FastqError(f"the input ends after {have} pairs")
    for m, target in (("r1", out), ("r2", out2)):
        folder, _, name = target.rpartition("/")
        text = df.select(F.lit(name).alias("file"), fastq_text(F.col(f"{m}_name"), F.col(f"{m}_seq"), F.col(f"{m}_qual")).alias("text"))
        text.write.format("fastq").mode("append").options(path=folder or ".", level=level).save()
