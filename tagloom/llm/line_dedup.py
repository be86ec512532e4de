"""Line dedup by site-relative frequency, in DataFrame functions only.

A line (trimmed of blanks) is boilerplate of its host when the share of the host's pages that hold it exceeds ``ratio`` by more than
chance explains: by ``SIGMAS`` standard deviations of a share of ``ratio`` among so many pages. So no host is too small: four pages of ten
are enough, and the more pages a host has, the closer to ``ratio`` a share may be. A line of a single page repeats nothing.
Lines are counted by two 64-bit hashes, so only fixed-width keys are shuffled, after partial counts. A host can have
no more boilerplate lines than lines-per-page / ratio, so they fit in one array; that
table is broadcast where its counted lines stay under ``BROADCAST_LINES``, and otherwise joined
with salted hosts, so that one large host is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

RATIO = 0.08
SIGMAS = 3.0
MIN_PAGES = 1
MIN_LINES = 2
#: 16 bytes a line: a broadcast of a few MB at most.
BROADCAST_LINES = 200_000
SALTS = 64
_BLANKS = " \t\r\x0b\x0c"


def _key(line: Column) -> Column:
    line = F.btrim(line, F.lit(_BLANKS))
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def variance(ratio: float = RATIO, sigmas: float = SIGMAS) -> float:
    """What the square of the pages beyond ``ratio`` must exceed, for each page of the host."""
    return sigmas * sigmas * ratio * (1 - ratio)


def boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_lines: int = MIN_LINES, sigmas: float = SIGMAS) -> DataFrame:
    """The keys of boilerplate lines: host, a, b, pages (with the line), total (pages of the host). Null is a host of its own."""
    pages = df.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    real = F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    keys = pages.select("host", F.explode(F.array_distinct(F.transform(real, _key))).alias("k")).select("host", "k.a", "k.b")
    counts = keys.groupBy("host", "a", "b").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_lines)
    totals = pages.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages).withColumnRenamed("host", "site")
    beyond = F.col("pages") - F.lit(ratio) * F.col("total")
    both = counts.join(totals, F.col("host").eqNullSafe(F.col("site")))
    return both.where((beyond > 0) & (beyond * beyond > F.lit(variance(ratio, sigmas)) * F.col("total"))).drop("site")


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_lines: int = MIN_LINES, sigmas: float = SIGMAS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """df, every row and column of it, with ``text_col`` less its host's boilerplate lines, and two columns more:
    ``lines_total`` and ``lines_dropped`` (they replace columns of those names).

    Kept lines stay as they are, blank lines too; a text of nothing but boilerplate becomes empty. A null text stays null, with 0 lines.
    Each row is a page, repeated rows included; null hosts are one host. An empty table gives an empty one. A line that stands twice on a
    page counts once. A very long text is one row of the scan, split within its task.
    """
    spark = df.sparkSession
    found, _ = materialize(spark, boilerplate(df, host_col, text_col, ratio, min_pages, min_lines, sigmas), "boilerplate")
    sites = found.groupBy(F.col("host").alias("__site")).agg(F.collect_list(F.struct("a", "b")).alias("__keys"))
    host, text = F.col(f"`{host_col}`"), F.col(f"`{text_col}`")
    if found.count() <= broadcast_lines:
        rows = df.join(F.broadcast(sites), host.eqNullSafe(F.col("__site")), "left")
    else:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
        sites = sites.withColumn("__of", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        rows = salted.join(sites, host.eqNullSafe(F.col("__site")) & (F.col("__salt") == F.col("__of")), "left").drop("__salt", "__of")
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("__keys"), _key(x)))
    new = F.when(F.col("__keys").isNull(), text).otherwise(F.array_join(kept, "\n"))
    total = F.coalesce(F.size(F.when(text.isNotNull(), _lines(text)).otherwise(F.array().cast("array<string>"))), F.lit(0))
    left = F.when(F.col("__keys").isNull() | text.isNull(), total).otherwise(F.size(kept))
    old = [c for c in df.columns if c not in ("lines_total", "lines_dropped")]
    return rows.select(
        *[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in old],
        total.cast("bigint").alias("lines_total"),
        (total - left).cast("bigint").alias("lines_dropped"),
    )
