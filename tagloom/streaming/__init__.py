"""The demultiplexing plan over reads that keep arriving.

The plan is narrow and keeps no state, so it runs on a stream as it is; only the metrics accumulate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Options, Sheet
from ..plans.demux import demux


def demux_stream(reads: DataFrame, sheet: Sheet, options: Options, paired: bool) -> DataFrame:
    """The plan over a streaming DataFrame of reads. Ranges of input order have no meaning there."""
    return demux(reads, sheet, options.but(skip_reads=0, max_reads=0), paired)


def running_counts(plan: DataFrame) -> DataFrame:
    """label, status and count so far, for a sink in update or complete mode."""
    return plan.where(~F.col("too_short")).groupBy("label", "status").agg(F.count("*").alias("count"))
