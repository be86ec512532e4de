"""WARC archives: a deterministic sharded writer and its reader.

Records are sorted by ranges of the page id. Of records with equal payloads the one of largest id
is a response and the others are revisits of it. Which they are is found from digests alone; those notes
then travel with the pages through the one exchange of payloads, each beside its page.
Every record is a gzip member of its own; a range starts a file, and another past a compressed size. Ranges are cut at exact
running totals of the sorted ids, headers and digests are generated from the payload: the same rows give the same
files, whatever their order, the tasks and the partitions were.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, pick, remove, slices
from .shards import MANIFEST, ShardFile, dealt, manifest_batch, opened, publish, ranges

FILE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)
_SPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {page}')}>"


def record(page: int, url: str | None, payload: bytes, refers: int | None, date: str) -> bytes:
    """The bytes of one record: a response, or a revisit of page ``refers``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    digest = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    head = {"WARC-Type": "response" if refers is None else "revisit", "WARC-Record-ID": record_id(page), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if page != NO_ID:
        head["X-Page-ID"] = str(page)
    if refers is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers)} | ({"X-Refers-To-Page-ID": str(refers)} if refers != NO_ID else {})
    head |= {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"".join(["WARC/1.1\r\n".encode(), "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode(), b"\r\n", block, b"\r\n\r\n"])


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers) of every row whose payload also stands under a larger id. pages: id, digest, n."""
    large = pages.where(F.col("n") >= min_bytes).select("id", "digest")
    last = large.groupBy("digest").agg(F.max("id").alias("refers"), F.min("id").alias("least")).where("refers <> least").drop("least")
    # A digest with many copies makes its partition large; the adaptive join splits it, rows are small.
    return large.join(last, "digest").where("id <> refers").select("id", "digest", "refers").distinct()


def write_warc(df: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z", level: int = 6, range_bytes: int | None = None) -> DataFrame:
    """Write one record for each row below ``base``; returns the manifest of the files.

    A null payload is empty. Payloads under ``min_bytes`` are always responses. Null ids come first, as one
    id lower than any other. Of rows with equal id and payload the first is the response (unless a larger id has it) and the
    rest revisit that id. A null url leaves its header out; blanks in a url are escaped. Other columns are dropped. A very long
    payload is one record, held in memory by its task. An empty table gives an empty manifest and no file. ``range_bytes``: as for
    shards.ranges(). Rows of one id and payload stay in one range; those of one id alone, null included, are spread by their digests.
    """
    pages = pick(df, id=id_col, url=url_col, html=payload_col).select(F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    keys, keys_path = materialize(df.sparkSession, pages.select("id", "digest", F.octet_length("html").alias("n")), "digests")
    tie = F.xxhash64("digest").alias("tie")
    bounds = ranges(keys.select("id", tie, "n"), F.col("n") + 512, range_bytes)
    notes, notes_path = materialize(df.sparkSession, revisits(keys, min_bytes), "revisits")
    none = F.lit(None)
    both = pages.select("id", tie, "digest", F.lit(1).alias("kind"), "url", "html", none.cast("bigint").alias("refers")).unionByName(
        notes.select("id", tie, "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "refers")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, seq, key, refers = None, -1, 0, None, None
        for batch in slices(batches, "html"):
            for now, page, digest, kind, url, html, to in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if key != (page, digest):
                    key, refers = (page, digest), None
                if kind == 0:
                    refers = to
                    continue
                if now != shard:
                    if out:
                        yield manifest_batch([out.close()])
                    out, shard, seq = None, now, 0
                payload = html.encode()
                out = out or ShardFile(base, shard, seq, ".warc.gz")
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(record(page, url, payload, refers, date)) + packer.flush())
                if len(payload) >= min_bytes and refers is None:
                    refers = page
                if out.bytes > file_bytes:
                    yield manifest_batch([out.close()])
                    out, seq = None, seq + 1
        if out:
            yield manifest_batch([out.close()])

    rows = dealt(both, bounds).sortWithinPartitions("shard", "id", "tie", "digest", "kind", "url").select("shard", "id", "digest", "kind", "url", "html", "refers")
    manifest = publish(df.sparkSession, rows.mapInArrow(run, MANIFEST), base, "pages")
    remove(df.sparkSession, keys_path, notes_path)
    return manifest


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked; a cut member is an error."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if parts:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """(page id, url, record type, payload or None, payload size, payload digest, page id referred to) of a record, checked."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = body[: int(fields["Content-Length"])]
    digest = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    if lines[0] != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n" or "sha1:" + digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError("a record is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(http.decode().lower().split("content-length: ")[1].split("\r\n")[0])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda k: int(fields[k]) if k in fields else None
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != told or digest(payload) != stated):
        raise ValueError("a payload is damaged")
    return number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload if response else None, told, stated, number("X-Refers-To-Page-ID")


def read_warc(spark: SparkSession, base: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest lists: page_id, url, record_type, payload (binary, null for revisits), payload_bytes, payload_digest, refers_to."""
    files = spark.read.parquet(f"{base}/manifest").select("path")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        for paths in batches:
            for path in paths.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        r = parse(data)
                        rows.append(r if payloads else (*r[:3], None, *r[4:]))
                        held += 200 + (len(data) if payloads else 0)
                        if held > SLICE_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    schema = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)
