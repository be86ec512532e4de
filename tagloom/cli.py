"""Command line: ``python -m tagloom.cli demux ...`` and ``... validate ...``."""

from __future__ import annotations

import argparse
import os
import sys

from .errors import ConfigError, DemuxError, OutputError
from .operators import summary
from .plans.config import ADAPTER_R1, ADAPTER_R2, Options, Tso
from .plans.demux import demux, written
from .sources.fastq import check_prefix, plan_outputs, preflight, read_fastq, write_fastq
from .sources.samples import read_sheet


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagloom")
    commands = top.add_subparsers(dest="command", required=True)
    d, v = commands.add_parser("demux"), commands.add_parser("validate")
    for p in (d, v):
        p.add_argument("-i", "--input", required=True)
        p.add_argument("-I", "--input2", "--i2")
    d.add_argument("-b", "--barcodes", required=True)
    d.add_argument("-o", "--out-dir", default=".")
    d.add_argument("-p", "--prefix", default="tagloom")
    d.add_argument("--compression-level", type=int, default=6)
    d.add_argument("--mismatches-1", "--m1", "--mismatches-5", dest="mismatches1", type=int, default=0)
    d.add_argument("--mismatches-2", "--m2", "--mismatches-3", dest="mismatches2", type=int, default=0)
    d.add_argument("--min-mismatch-delta", dest="min_delta", type=int, default=0)
    d.add_argument("--orientation", choices=("both", "canonical", "swapped"), default="both")
    d.add_argument("--tso-pattern")
    d.add_argument("-a", "--adapter-r1", default=ADAPTER_R1)
    d.add_argument("--adapter-r2", default=ADAPTER_R2)
    d.add_argument("-q", "--quality-cutoff-3", dest="quality_cutoff3", type=int, default=0)
    d.add_argument("--quality-cutoff-5", "--q5", dest="quality_cutoff5", type=int, default=0)
    d.add_argument("-l", "--min-length", type=int, default=0)
    d.add_argument("--min-adapter-overlap", dest="min_overlap", type=int, default=3)
    d.add_argument("--adapter-error-rate", dest="error_rate", type=float, default=0.1)
    d.add_argument("-t", "--threads", type=int, default=4)
    d.add_argument("--chunk-reads", type=int, default=4096)
    d.add_argument("--max-reads", type=int, default=0)
    d.add_argument("--skip-reads", type=int, default=0)
    d.add_argument("--summary")
    d.add_argument("--log-level", choices=("error", "warn", "info", "debug", "trace"), default="info")
    for flag, aliases in (("no-gzip", ()), ("discard-unassigned", ()), ("counts-only", ()), ("keep-barcodes", ("--kbc",)), ("no-canonicalize", ()), ("no-adapter", ()), ("nextseq", ()), ("force", ()), ("quiet", ())):
        d.add_argument(f"--{flag}", *aliases, action="store_true")
    return top


def session(threads: int):
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{threads}]")).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(threads)).getOrCreate()


def run_demux(args: argparse.Namespace, spark=None) -> str:
    """Run, write the files and the summary; returns the summary's text."""
    if args.threads < 1 or args.chunk_reads < 1:
        raise ConfigError("threads and chunk reads must be at least 1")
    if not 1 <= args.compression_level <= 9:
        raise ConfigError("the compression level must be between 1 and 9")
    if args.input2 and os.path.realpath(args.input) == os.path.realpath(args.input2):
        raise ConfigError("both inputs are the same file")
    options = Options(
        **{k: getattr(args, k) for k in ("mismatches1", "mismatches2", "min_delta", "orientation", "keep_barcodes", "quality_cutoff3", "quality_cutoff5", "nextseq", "min_length", "min_overlap", "error_rate", "skip_reads", "max_reads", "discard_unassigned", "counts_only")},
        canonicalize=not args.no_canonicalize,
        tso=Tso(args.tso_pattern) if args.tso_pattern is not None else None,
        adapter_r1=None if args.no_adapter else args.adapter_r1,
        adapter_r2=None if args.no_adapter else args.adapter_r2,
    )
    sheet = read_sheet(args.barcodes, options.mismatches1, options.mismatches2)
    for w in () if args.quiet else sheet.warnings:
        print(f"warning: {w}", file=sys.stderr)
    prefix, paired, gz = check_prefix(args.prefix), bool(args.input2), not args.no_gzip
    planned = plan_outputs(args.out_dir, prefix, sheet, options, paired, gz, args.summary)
    preflight(planned, [args.input, args.barcodes, *([args.input2] if paired else [])], args.force)
    if args.summary and not os.path.isdir(os.path.dirname(os.path.abspath(args.summary))):
        raise OutputError(f"the folder of {args.summary} is missing")
    os.makedirs(args.out_dir, exist_ok=True)
    if args.force:
        for p in planned:
            if os.path.exists(p):
                os.remove(p)
    spark = spark or session(args.threads)
    reads = read_fastq(spark, args.input, args.input2, options.skip_reads, options.max_reads)
    plan = demux(reads, sheet, options.but(skip_reads=0, max_reads=0), paired)
    labels = [x.label for x in sheet.samples]
    if options.counts_only or len(labels) > summary.OBSERVED:
        if not options.counts_only:
            write_fastq(written(plan, options), args.out_dir, prefix, paired, gz, args.compression_level)
        text = summary.summary_tsv(plan, paired)
    else:
        plan, seen = summary.observed(plan, paired, labels)
        write_fastq(written(plan, options), args.out_dir, prefix, paired, gz, args.compression_level)
        text = summary.summary_text(seen.get)
    with open(planned[-1], "w", encoding="utf-8") as f:
        f.write(text)
    if not args.quiet:
        print(summary.human(text), file=sys.stderr)
    return text


def run_validate(args: argparse.Namespace, spark=None) -> str:
    paired = bool(args.input2)
    row = summary.validate(read_fastq(spark or session(4), args.input, args.input2), paired).first()
    na = lambda x: "NA" if x is None else x
    rows = [("records", row.records), ("bases", row.bases), ("min_length", na(row.min_length)), ("max_length", na(row.max_length)), ("paired", str(paired).lower()), ("status", "OK")]
    return "".join(f"{k}\t{v}\n" for k, v in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "demux":
            run_demux(args)
        else:
            print(run_validate(args), end="")
        return 0
    except (DemuxError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # a reader's error arrives wrapped by Spark
        told = [line for line in str(e).splitlines() if any(k in line for k in ("FastqError", "PairError"))]
        print(f"error: {told[-1].strip() if told else e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
