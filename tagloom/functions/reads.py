"""Expressions on names, sequences and labels of reads; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that some file systems reserve.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def read_id(name: Column) -> Column:
    """The name up to its first blank or tab, without a final /1 or /2."""
    return F.regexp_replace(F.regexp_extract(name, r"^([^ \t]*)", 1), r"/[12]$", "")


def revcomp(seq: Column) -> Column:
    """The reverse complement, upper case; whatever is not A, C, G or T gives N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def file_label(text: Column) -> Column:
    """text as part of a file name."""
    safe = F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")
    safe = F.when(safe == "", F.lit("unnamed")).otherwise(safe)
    return F.when(F.upper(safe).isin(*RESERVED), F.concat(F.lit("_"), safe)).otherwise(safe)


def count_text(n: Column) -> Column:
    """A count with separators of thousands."""
    return F.format_number(n, 0)


def hamming(a: Column, b: Column) -> Column:
    """Mismatches between two strings over their common length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + (a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))).cast("int")))


def with_umi(name: Column, umi: Column) -> Column:
    """name with the UMI appended: blanks (not tabs) become underscores, and the tag rbc: goes before the first UMI. An empty UMI changes nothing."""
    tag = F.when(F.contains(name, F.lit("rbc:")), F.lit("")).otherwise(F.lit("rbc:"))
    return F.when(F.length(umi) == 0, name).otherwise(F.concat(F.translate(name, " ", "_"), tag, umi))


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    """The four lines of a record."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual, F.lit("\n"))


def at_positions(seq: Column, positions: list[int]) -> Column:
    """The bases at fixed positions (from 0), joined."""
    return F.concat(*[F.substring(seq, p + 1, 1) for p in positions]) if positions else F.lit("")


def one_hot(seq: Column, start: Column | int, width: int) -> Column:
    """Up to 15 bases from start (1-based) as a BIGINT with a hex digit for each: A 1, C 2, G 4, T 8, any other 0."""
    part = F.substr(seq, F.lit(start) if isinstance(start, int) else start, F.lit(width))
    return F.conv(F.translate(F.regexp_replace(part, "[^ACGT]", "N"), "ACGTN", "12480"), 16, 10).cast("bigint")
