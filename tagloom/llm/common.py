"""Helpers shared by the operators: tables, shared scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; bounds its temporary arrays.
SLICE_BYTES = 2 << 20
#: Words, of 64 bits, of a filter on ids; a filter is a broadcast table of so many rows at most.
FILTER_WORDS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder of its own; anything else is an error, as executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tagloom-"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    uri = path.getFileSystem(conf).makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back: its lineage ends there, so a lost executor costs a reread only."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, whatever else df carries."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def _place(name: str) -> tuple[Column, Column]:
    """(word, bits) of an id in a filter."""
    h = F.xxhash64(F.col(f"`{name}`"))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, at).bitwiseAND(63).cast("int")) for at in (32, 38, 44, 50)]
    return F.pmod(h, F.lit(FILTER_WORDS).cast("bigint")), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _filtered(rows: DataFrame, ids: DataFrame, name: str, how: str) -> tuple[DataFrame, Column]:
    """rows joined with a Bloom filter of ids, and whether the filter has a row's id: true for all that are there, and for few others."""
    word, bits = _place(name)
    held = ids.select(word.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_held"))
    out = rows.withColumn("_word", word).withColumn("_bits", bits).join(F.broadcast(held), "_word", how)
    return out, F.coalesce(F.col("_held").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))


def about(rows: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """The rows whose ``name`` is among that of ids, with a few others: what a join on it need not move goes before the exchange.

    Some millions of ids leave few others. With far more the filter fills up and lets all rows pass: the join moves more, and is right still.
    """
    out, has = _filtered(rows, ids, name, "inner")
    return out.where(has).select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, name: str = "id") -> DataFrame:
    """The rows whose ``name`` is not among that of ids, nulls included: an anti join that moves only rows that the filter of ids has."""
    out, has = _filtered(rows, ids, name, "left")
    some = out.where(has).select(*rows.columns).join(ids.select(name).hint("merge"), name, "left_anti").select(*rows.columns)
    return out.where(~has).select(*rows.columns).unionByName(some)


def release() -> None:
    """Give free memory of this worker back to the system: workers are used again by later tasks and stages, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of the text column, or one row. Free memory is released batch by batch."""
    for batch in batches:
        release()
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        yield batch.slice(begin)
    release()


def packed(col: pa.Array):
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    import numpy as np

    col = pa.compute.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
