"""Sharded files from Spark tasks: temporary names, a manifest that commits, then final names.

A task writes each file under a name with a token of its own attempt, so a lost or repeated
attempt never touches another's file. The manifest, a table written by Spark's own committer, lists
the files of the attempts that counted; only those get their final names. Publishing may be
repeated: a file that has its final name already is left as it is.

Which rows share a shard is found from the rows alone: ``ranges()`` cuts the sorted keys at every multiple of a
number of bytes, counted exactly over all rows, so neither the number of partitions nor the order of the input moves a shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, remove

MANIFEST = "partition int, seq int, temp string, records bigint, units bigint, bytes bigint, sha256 string"

#: Bytes of input in a range at least; ranges are made larger, up to ``RANGE_FULL``, once there are ``RANGES_FEW`` of them, and beyond
#: that once there are ``RANGES`` (what is sent to every task: 16 bytes a range).
RANGE_BYTES, RANGE_FULL = 2 << 20, 256 << 20
RANGES_FEW, RANGES = 1 << 10, 1 << 16


def ranges(rows: DataFrame, size: Column, range_bytes: int | None = None) -> np.ndarray:
    """The least (id, tie) of each range, ascending. rows: id, tie (bigint, not null); size: bytes of a row.

    A range ends with the key in which the running total of sizes, in key order, passes a multiple of ``range_bytes``; rows of
    equal keys stay together. Left out, that is ``RANGE_BYTES``, doubled by the total of all sizes as said there. Only one
    total for each partition and the bounds themselves reach the driver.
    """
    spark = rows.sparkSession
    keys = rows.select("id", "tie", size.cast("bigint").alias("n")).groupBy("id", "tie").agg(F.sum("n").alias("n"))
    placed, path = materialize(spark, keys.repartitionByRange("id", "tie").withColumn("part", F.spark_partition_id()), "keys")
    totals = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())
    whole = sum(n for _, n in totals)
    if range_bytes is None:
        range_bytes = RANGE_BYTES
        while whole > range_bytes * (RANGES_FEW if range_bytes < RANGE_FULL else RANGES):
            range_bytes *= 2
    before = np.cumsum([0, *(n for _, n in totals)])
    offsets = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before)], "part int, offset bigint")
    running = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("id", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = placed.withColumn("before", running).join(F.broadcast(offsets), "part").withColumn("cell", F.floor((F.col("before") + F.col("offset")) / F.lit(range_bytes)))
    least = cells.groupBy("cell").agg(F.min(F.struct("id", "tie")).alias("k")).select("k.id", "k.tie").collect()
    remove(spark, path)
    return np.array(sorted((r.id, r.tie) for r in least), np.int64).reshape(-1, 2)


def find_range(bounds: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The range of each key: that of the last bound not above it."""
    low, high = (np.searchsorted(bounds[:, 0], ids, side) for side in ("left", "right"))
    out = high - 1
    several = np.flatnonzero(low < high)
    for a in np.unique(low[several]):
        rows = several[low[several] == a]
        out[rows] = a - 1 + np.searchsorted(bounds[a : high[rows[0]], 1], ties[rows], "right")
    return np.maximum(out, 0)


def dealt(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """rows, with their range as ``shard``, one exchange away from their source: a range's rows are in one partition."""
    sent = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def shard(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(find_range(sent.value, ids.to_numpy(), ties.to_numpy()).astype(np.int32))

    return rows.withColumn("shard", shard("id", "tie")).repartition(max(1, len(bounds)), "shard")


def opened(uri: str):
    """(file system, path) of a URI, for any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardFile:
    """One file under its temporary name; counts and digests what is written."""

    def __init__(self, base: str, partition: int, seq: int, suffix: str):
        import hashlib

        fs, root = opened(base)
        fs.create_dir(f"{root}/temp", recursive=True)
        self.partition, self.seq = partition, seq
        self.temp = f"temp/{partition:05d}-{seq:05d}.{uuid.uuid4().hex}{suffix}"
        self.out = fs.open_output_stream(f"{root}/{self.temp}", compression=None)
        self.bytes = self.records = self.units = 0
        self.sha = hashlib.sha256()

    def write(self, data: bytes, records: int = 1, units: int = 0) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += records
        self.units += units

    def close(self) -> tuple:
        self.out.close()
        return self.partition, self.seq, self.temp, self.records, self.units, self.bytes, self.sha.hexdigest()


def manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in MANIFEST.split(", ")])


def publish(spark: SparkSession, files: DataFrame, base: str, stem: str) -> DataFrame:
    """Write the manifest, give its files their final names, and return it with ``path`` (relative to base)."""
    name = F.concat(F.format_string(f"{stem}-%05d-%05d", "partition", "seq"), F.regexp_extract("temp", r"^[^.]*\.[0-9a-f]*(.*)$", 1))
    files.withColumn("path", name).write.mode("overwrite").parquet(f"{base}/manifest")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = opened(base)
        for batch in batches:
            for temp, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if fs.get_file_info(f"{root}/{temp}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{path}")
                elif fs.get_file_info(f"{root}/{path}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{base}/{path}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    manifest = spark.read.parquet(f"{base}/manifest")
    manifest.select("temp", "path").mapInArrow(rename, "n bigint").agg(F.sum("n")).collect()
    remove(spark, f"{base}/temp")
    return manifest
