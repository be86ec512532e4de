"""Metrics of a run, as one partial and final aggregate, and the check of an input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Rows of the summary in order, but for the samples, which follow match_rate.
HEAD = ("total_reads", "assigned", "unassigned", "ambiguous", "quality_trimmed", "adapter_trimmed", "too_short", "five_prime_matched_three_prime_missing", "orientation_canonical", "orientation_swapped")
TAIL = ("matched_before_filter", "no_match_before_filter", "ambiguous_after_filter")


def _flags(paired: bool) -> dict:
    matched, left = F.col("status") == "match", ~F.col("too_short")
    never = F.lit(False)
    return {
        "total_reads": F.lit(True),
        "assigned": matched & left,
        "unassigned": ~matched & left,
        "ambiguous": F.col("status") == "ambiguous",
        "quality_trimmed": F.col("quality_trimmed"),
        "adapter_trimmed": F.col("adapter_trimmed"),
        "too_short": F.col("too_short"),
        "five_prime_matched_three_prime_missing": never,
        "orientation_canonical": matched & ~F.col("swapped") if paired else never,
        "orientation_swapped": matched & F.col("swapped") if paired else never,
        "matched_before_filter": matched,
        "no_match_before_filter": F.col("status") == "none",
        "ambiguous_after_filter": (F.col("status") == "ambiguous") & left,
    }


def counters(df: DataFrame, paired: bool) -> DataFrame:
    """label (null where no sample matched) and its counters. A pair counts once; trims are counted before the length filter, assignments after it."""
    label = F.when(F.col("status") == "match", F.col("label"))
    return df.groupBy(label.alias("label")).agg(*[F.count_if(c).alias(n) for n, c in _flags(paired).items()])


def sample_counts(df: DataFrame) -> DataFrame:
    """label and count of assigned reads that were long enough; samples without any are left out."""
    count = F.count_if((F.col("status") == "match") & ~F.col("too_short"))
    return df.groupBy("label").agg(count.alias("count")).where("count > 0")


def metrics(df: DataFrame, paired: bool) -> DataFrame:
    """metric and count: the counters and a row sample:<label> for each sample with reads. The reads are aggregated once."""
    names = [*HEAD, *TAIL]
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("count")) for c in names]
    own = F.struct(F.concat(F.lit("sample:"), "label").alias("metric"), F.col("assigned").alias("count"))
    long = counters(df, paired).select(F.explode(F.array(*rows, own)).alias("x")).select("x.*").where("metric is not null")
    found = long.groupBy("metric").agg(F.sum("count").alias("count")).where("count > 0 or metric not like 'sample:%'")
    zero = df.sparkSession.createDataFrame([(c, 0) for c in names], "metric string, count bigint")
    return found.unionByName(zero).groupBy("metric").agg(F.sum("count").alias("count"))


#: Samples whose counters are observed one by one; with more, the reads are aggregated apart.
OBSERVED = 400


def observed(df: DataFrame, paired: bool, labels: list[str]) -> tuple[DataFrame, Observation]:
    """(df, what it will have counted once an action has read all of it): the counters, in the pass that writes the reads."""
    seen = Observation()
    flags = _flags(paired)
    own = {f"sample:{x}": flags["assigned"] & (F.col("label") == x) for x in labels}
    return df.observe(seen, *[F.count_if(c).alias(n) for n, c in (flags | own).items()]), seen


def summary_tsv(df: DataFrame, paired: bool) -> str:
    """The summary file. What is collected has a row for each counter and sample."""
    return summary_text({r.metric: r["count"] for r in metrics(df, paired).collect()})


def summary_text(rows: dict[str, int]) -> str:
    """The summary file of these counters; samples without reads are left out."""
    rate = lambda a: f"{rows[a] / rows['total_reads'] if rows['total_reads'] else 0:.6f}"
    out = [("metric", "count"), *((m, rows[m]) for m in HEAD), ("match_rate", rate("assigned"))]
    out += sorted(((m, c) for m, c in rows.items() if m.startswith("sample:") and c), key=lambda x: x[0].encode())
    out += [*((m, rows[m]) for m in TAIL), ("assignment_rate_before_filter", rate("matched_before_filter"))]
    return "".join(f"{m}\t{c}\n" for m, c in out)


def rates(df: DataFrame, paired: bool) -> DataFrame:
    """metric and rate (six decimals, as text): reads assigned after the length filter, and matched before it, of all."""
    names = {"match_rate": "assigned", "assignment_rate_before_filter": "matched_before_filter"}
    flags = _flags(paired)
    one = df.agg(F.count("*").alias("n"), *[F.count_if(flags[f]).alias(m) for m, f in names.items()])
    share = lambda m: F.format_string("%.6f", F.when(F.col("n") > 0, F.col(m) / F.col("n")).otherwise(F.lit(0.0)))
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), share(m).alias("rate")) for m in names])).alias("x")).select("x.*")


def human(summary: str) -> str:
    """The text of a summary file as a table for people: counts with separators, shares of all reads, samples by name."""
    rows = dict(line.split("\t") for line in summary.splitlines()[1:])
    total = max(1, int(rows["total_reads"]))
    listed = [("reads", "total_reads"), ("assigned", "assigned"), ("unassigned", "unassigned"), ("  of these ambiguous", "ambiguous_after_filter"), ("ambiguous before the length filter", "ambiguous"), ("quality trimmed", "quality_trimmed"), ("adapter trimmed", "adapter_trimmed"), ("too short", "too_short")]
    if int(rows["orientation_canonical"]) + int(rows["orientation_swapped"]):
        listed += [("mates in order", "orientation_canonical"), ("mates swapped", "orientation_swapped")]
    out = [f"{title:<36}{int(rows[m]):>16,}" + ("" if m == "total_reads" else f"{100 * int(rows[m]) / total:>9.2f} %") for title, m in listed]
    samples = [(m[7:], int(c)) for m, c in rows.items() if m.startswith("sample:")]
    return "\n".join([*out, *(["", "reads by sample"] if samples else []), *(f"  {name:<34}{count:>16,}" for name, count in samples)]) + "\n"


def validate(df: DataFrame, paired: bool) -> DataFrame:
    """records, bases, min_length and max_length (over both mates; null without records)."""
    mates = ("r1", "r2") if paired else ("r1",)
    n = [F.length(f"{m}_seq") for m in mates]
    low, high = (F.least(*n), F.greatest(*n)) if paired else (n[0], n[0])
    return df.agg(F.count("*").alias("records"), F.coalesce(F.sum(sum(n[1:], n[0]).cast("bigint")), F.lit(0).cast("bigint")).alias("bases"), F.min(low).cast("bigint").alias("min_length"), F.max(high).cast("bigint").alias("max_length"))
