"""The demultiplexing plan: one lazy DataFrame from raw reads to trimmed, named and assigned ones.

Matching sees the raw read. Then mates are put in order, UMIs taken, barcodes and the TSO cut off as
integer bounds, ends trimmed, and only then are sequences and qualities cut, once. Rows are never dropped: too short and
unassigned reads carry flags, as the metrics count them. Every step is narrow, so the plan has no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import with_umi
from ..operators.match import match, pin
from ..operators.trim import trims
from .config import UNASSIGNED, Mode, Options, Sheet


def select_range(df: DataFrame, options: Options) -> DataFrame:
    """Reads from the skipped ones on, as many as are wanted (0: all), by input order."""
    if options.skip_reads:
        df = df.where(F.col("ord") >= options.skip_reads)
    if options.max_reads:
        df = df.where(F.col("ord") < options.skip_reads + options.max_reads)
    return df


def _of_sample(values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("sample_id"))


def _umi(read: str, positions: list[list[int]], offset: Column | int = 0) -> Column:
    """Bases at the sample's UMI positions; an empty string where it has none."""
    if not any(positions):
        return F.lit("")
    patterns = [tuple(p) for p in positions]
    out = F.lit("")
    for p in sorted(set(patterns)):
        ids = [i for i, q in enumerate(patterns) if q == p]
        if p:
            out = F.when(F.col("sample_id").isin(ids), F.concat(*[F.substr(F.col(read), F.lit(offset) + (x + 1) if isinstance(offset, int) else offset + (x + 1), F.lit(1)) for x in p])).otherwise(out)
    return out


def demux(df: DataFrame, sheet: Sheet, options: Options, paired: bool) -> DataFrame:
    """ord, status, sample_id, label, distance, swapped, umi, quality_trimmed, adapter_trimmed, too_short, and r1_name, r1_seq, r1_qual (and r2_*) as they are written."""
    mates = ("r1", "r2") if paired else ("r1",)
    df = pin(match(select_range(df, options), sheet, options, paired), "status", "sample_id", "distance", "swapped")
    fields = ("name", "seq", "qual")
    if paired and options.canonicalize:
        df = df.withColumns({f"{m}_{f}": F.when(F.col("swapped"), F.col(f"{o}_{f}")).otherwise(F.col(f"{m}_{f}")) for m, o in (("r1", "r2"), ("r2", "r1")) for f in fields})
    assigned = F.col("status") == "match"
    own = sheet.samples
    dual = sheet.mode == Mode.DUAL
    length1 = F.when(assigned, _of_sample([s.barcode1.length for s in own]))
    length2 = F.when(assigned, _of_sample([s.barcode2.length for s in own])) if dual else F.lit(None).cast("int")
    umi1, umi2 = [s.barcode1.umi for s in own], [s.barcode2.umi if dual else [] for s in own]
    apart = paired and dual and not options.canonicalize  # a swapped pair keeps its mates, so barcodes stand the other way round
    if apart:
        umi = F.when(F.col("swapped"), F.concat(_umi("r2_seq", umi1), _umi("r1_seq", umi2))).otherwise(F.concat(_umi("r1_seq", umi1), _umi("r2_seq", umi2)))
    elif paired:
        umi = F.concat(_umi("r1_seq", umi1), _umi("r2_seq", umi2))
    else:
        umi = F.concat(_umi("r1_seq", umi1), _umi("r1_seq", umi2, F.length("r1_seq") - length2) if any(umi2) else F.lit(""))
    df = df.withColumn("umi", F.when(assigned, umi).otherwise(F.lit("")))

    # What is left of each mate: __a to __b, counted from 0.
    bounds = {f"__a_{m}": F.lit(0) for m in mates} | {f"__b_{m}": F.length(f"{m}_seq") for m in mates}
    if not options.keep_barcodes:
        if paired:
            fronts = {"r1": length1, "r2": length2} if dual else {"r1": length1}
            if apart:
                fronts = {"r1": F.when(F.col("swapped"), length2).otherwise(length1), "r2": F.when(F.col("swapped"), length1).otherwise(length2)}
            for m, front in fronts.items():
                bounds[f"__a_{m}"] = F.when(front.isNotNull() & (F.length(f"{m}_seq") >= front), front).otherwise(F.lit(0))
        else:
            n = F.length("r1_seq")
            end = n - F.when(length2.isNotNull() & (n >= length1 + length2), length2).otherwise(F.lit(0)) if dual else n
            bounds["__b_r1"] = end
            bounds["__a_r1"] = F.when(length1.isNotNull() & (end >= length1), length1).otherwise(F.lit(0))
    df = df.withColumns(bounds)
    if options.tso:
        total = len(options.tso.pattern)
        fits = F.col("__b_r1") - F.col("__a_r1") >= total
        found = F.concat(*[F.substr(F.col("r1_seq"), F.col("__a_r1") + (p + 1), F.lit(1)) for p in options.tso.umi]) if options.tso.umi else F.lit("")
        df = df.withColumns({"r1_name": F.when(fits, with_umi(F.col("r1_name"), found)).otherwise(F.col("r1_name")), "__a_r1": F.col("__a_r1") + F.when(fits, F.lit(total)).otherwise(F.lit(0))})

    cut = lambda m, f: F.substr(F.col(f"{m}_{f}"), F.col(f"__a_{m}") + 1, F.col(f"__b_{m}") - F.col(f"__a_{m}"))
    df = df.withColumns({f"{m}_{f}": cut(m, f) for m in mates for f in ("seq", "qual")})
    adapters = {"r1": options.adapter_r1, "r2": options.adapter_r2}
    df = df.withColumns({f"__t_{m}": trims(F.col(f"{m}_seq"), F.col(f"{m}_qual"), options.quality_cutoff3, options.quality_cutoff5, options.nextseq, adapters[m], options.min_overlap, options.error_rate) for m in mates})
    kept = lambda m, f: F.substr(F.col(f"{m}_{f}"), F.col(f"__t_{m}.start") + 1, F.col(f"__t_{m}.stop") - F.col(f"__t_{m}.start"))
    any_ = lambda f: F.greatest(*[F.col(f"__t_{m}.{f}") for m in mates]) if paired else F.col(f"__t_r1.{f}")
    short = [F.col(f"__t_{m}.stop") - F.col(f"__t_{m}.start") < options.min_length for m in mates]
    flags = {"quality_trimmed": any_("quality"), "adapter_trimmed": any_("adapter"), "too_short": short[0] | short[1] if paired else short[0]}
    df = pin(df, *(f"__t_{m}" for m in mates))
    df = df.withColumns(flags | {"label": F.coalesce(_of_sample([s.label for s in own]), F.lit(UNASSIGNED))})
    out = [F.col(c) for c in ("ord", "status", "sample_id", "label", "distance", "swapped", "umi", *flags)]
    for m in mates:
        out += [with_umi(F.col(f"{m}_name"), F.col("umi")).alias(f"{m}_name"), kept(m, "seq").alias(f"{m}_seq"), kept(m, "qual").alias(f"{m}_qual")]
    return df.select(*out)


def written(df: DataFrame, options: Options) -> DataFrame:
    """The reads that go to files."""
    if options.counts_only:
        return df.where(F.lit(False))
    df = df.where(~F.col("too_short"))
    return df.where(F.col("sample_id").isNotNull()) if options.discard_unassigned else df


