"""Digests of id lists, for result tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def id_digests(df: DataFrame, ids: str, sha256: str | None = None, crc32: str | None = None) -> DataFrame:
    """df with the digest columns named, over ``ids`` as little-endian unsigned 32-bit integers, in place of ``ids``."""
    keep = [f for f in df.schema if f.name != ids]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *([f"`{sha256}` string"] if sha256 else []), *([f"`{crc32}` bigint"] if crc32 else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            at = col.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            parts = [data[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:])]
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            names = [f.name for f in keep]
            if sha256:
                cols.append(pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()))
                names.append(sha256)
            if crc32:
                cols.append(pa.array([zlib.crc32(p) for p in parts], pa.int64()))
                names.append(crc32)
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, schema)
