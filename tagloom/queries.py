"""The read-processing queries over reads derived from the orders and nation tables, each with the SQL that gives the same rows.

The reads' definition is one SQL text that Spark and DuckDB both run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import reads as R
from .operators import qc, summary
from .operators.match import match
from .operators.trim import allowed_errors, trims
from .plans.config import ADAPTER_R1, ADAPTER_R2, Barcode, Options, Sample, Sheet, Tso
from .plans.demux import demux, select_range, written
from .sources.fastq import FILE_STEP, exists, file_name, head, read_fastq, write_fastq
from .sources.samples import parse_sheet
from .sources.shared import scratch


def _hex(x: str) -> str:
    return f"translate({x}, '0123456789abcdef', 'ACGTACGTACGTACGT')"


SAMPLES = f"""SELECT CAST(n_nationkey AS INT) AS sample_id, n_name AS name,
  {_hex("substr(md5(concat('b1', n_name)), 1, 8)")} AS bc1, {_hex("substr(md5(concat('b2', n_name)), 1, 8)")} AS bc2 FROM nation"""

PAIRS = f"""SELECT ord, concat('read', CAST(ord AS STRING), '/1') AS r1_name, r1_seq,
  translate(substr(concat(h, reverse(h), h), 1, length(r1_seq)), '0123456789abcdef', '!+5:?ABCDEFGHIII') AS r1_qual,
  concat('read', CAST(ord AS STRING), '/2') AS r2_name, r2_seq,
  translate(substr(concat(reverse(h), h, h), 1, length(r2_seq)), '0123456789abcdef', '!+5:?ABCDEFGHIII') AS r2_qual
FROM (SELECT ord, h,
    concat(CASE WHEN substr(h, 2, 1) >= '8' THEN p2 ELSE p1 END, substr(i1, 1, CAST(8 + ord % 25 AS INT)), substr('{ADAPTER_R1}', 1, CAST(ord % 31 AS INT))) AS r1_seq,
    concat(CASE WHEN substr(h, 2, 1) >= '8' THEN p1 ELSE p2 END, substr(i2, 1, CAST(8 + ord % 23 AS INT)), substr('{ADAPTER_R2}', 1, CAST(ord % 29 AS INT))) AS r2_seq
  FROM (SELECT ord, h, {_hex("md5(concat('x', CAST(ord AS STRING)))")} AS i1, {_hex("md5(concat('y', CAST(ord AS STRING)))")} AS i2,
      CASE WHEN substr(h, 1, 1) < '3' THEN {_hex("substr(h, 9, 8)")} WHEN substr(h, 3, 1) < '4' THEN concat(substr(bc1, 1, 3), 'N', substr(bc1, 5, 4)) ELSE bc1 END AS p1,
      CASE WHEN substr(h, 4, 1) < '4' THEN concat(substr(bc2, 1, 6), 'A', substr(bc2, 8, 1)) ELSE bc2 END AS p2
    FROM (SELECT o_orderkey AS ord, CAST(o_orderkey % 25 AS INT) AS sid, md5(concat('h', CAST(o_orderkey AS STRING))) AS h FROM orders) seed
    JOIN ({SAMPLES}) s ON s.sample_id = seed.sid) mix) reads"""


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables behind the reads. The keys of orders are dealt to all cores where the file has fewer row groups; reads are derived from them afterwards."""
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "nation")}
    return out | {"orders": out["orders"].select("o_orderkey").repartition(spark.sparkContext.defaultParallelism)}


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t, df in _views(spark, sf_dir).items():
        df.createOrReplaceTempView(t)
    return spark.sql(sql)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, SAMPLES)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PAIRS)


def sheet(spark: SparkSession, sf_dir: str, single: bool = False, umi: bool = False) -> Sheet:
    """The samples as a sheet (25 rows); with umi, the 4th base of barcode 1 and the 7th of barcode 2 are UMI positions."""
    rows = sorted(samples(spark, sf_dir).collect())  # 25 rows
    mark = lambda b, i: b[:i] + "N" + b[i + 1 :] if umi else b
    return Sheet(tuple(Sample(r.sample_id, r.name, Barcode(mark(r.bc1, 3)), None if single else Barcode(mark(r.bc2, 6))) for r in rows))


def single_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-end reads with both barcodes: the first mate, with the sample's second barcode at its 3' end."""
    return _run(spark, sf_dir, SINGLE)


SINGLE = f"""SELECT ord, r1_name, concat(r1_seq, bc2) AS r1_seq, concat(r1_qual, 'IIIIIIII') AS r1_qual
FROM ({PAIRS}) p JOIN ({SAMPLES}) s ON s.sample_id = CAST(p.ord % 25 AS INT)"""

_STATUS = ("ord", "status", "sample_id", "distance", "swapped")
MM1, MM4 = Options(mismatches1=1, mismatches2=1), Options(mismatches1=4, mismatches2=4)


def _match(options: Options, single: bool = False, paired: bool = True):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pairs(spark, sf_dir) if paired or single else single_reads(spark, sf_dir)
        return match(df, sheet(spark, sf_dir, single), options, paired).select(*_STATUS)

    return query


def _plan(options: Options, *columns, umi: bool = False):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return demux(pairs(spark, sf_dir), sheet(spark, sf_dir, umi=umi), options, True).select(*columns)

    return query


NO_TRIM = Options(adapter_r1=None, adapter_r2=None)
FULL = MM1.but(quality_cutoff3=20, quality_cutoff5=10, min_length=12)


def validate_pe(spark, sf_dir):
    return summary.validate(pairs(spark, sf_dir), True)


def validate_se(spark, sf_dir):
    return summary.validate(pairs(spark, sf_dir).select("ord", "r1_seq"), False)


def read_id_normalize(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("ord", R.read_id(F.concat("r1_name", F.lit(" 1:N:0"))).alias("value"), R.read_id(F.concat("r2_name", F.lit("\tx"))).alias("plain"))


def revcomp(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", R.revcomp("r1_seq").alias("value"))


def sanitize_label(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", R.file_label(F.concat("name", F.lit(" / lane:1"))).alias("value"))


def hamming_mates(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", R.hamming(F.col("r1_seq").substr(1, 16), F.col("r2_seq").substr(1, 16)).cast("bigint").alias("value"))


def sheet_geometry(spark, sf_dir):
    return qc.geometry(samples(spark, sf_dir)).select("id_a", "id_b", *[F.col(c).cast("bigint").alias(c) for c in ("d1", "d2", "d")])


def _quality(**options):
    def query(spark, sf_dir):
        t = trims(F.col("r1_seq"), F.col("r1_qual"), **options)
        return pairs(spark, sf_dir).select("ord", t.alias("t")).select("ord", F.col("t.start").alias("start"), F.col("t.stop").alias("stop"))

    return query


def _edited(mate: str) -> str:
    """Reads whose tail is the adapter with one base missing, or one inserted, or one changed, by ord."""
    a = ADAPTER_R1 if mate == "r1" else ADAPTER_R2
    tail = f"CASE ord % 4 WHEN 0 THEN '{a[:6] + a[7:18]}' WHEN 1 THEN '{a[:9] + 'T' + a[9:15]}' WHEN 2 THEN '{a[:5] + 'C' + a[6:]}' ELSE '{a[:4] + a[5:13] + 'G' + a[13:]}' END"
    return f"SELECT ord, substr(concat(substr({mate}_seq, 1, CAST(20 + ord % 9 AS INT)), {tail}), 1, CAST(18 + ord % 37 AS INT)) AS seq FROM ({PAIRS}) p"


def _adapter(mate: str, edited: bool):
    a = ADAPTER_R1 if mate == "r1" else ADAPTER_R2

    def query(spark, sf_dir):
        df = _run(spark, sf_dir, _edited(mate) if edited else f"SELECT ord, {mate}_seq AS seq FROM ({PAIRS}) p")
        t = trims(F.col("seq"), F.col("seq"), adapter=a)
        return df.select("ord", t.alias("t")).select("ord", F.when(F.col("t.adapter"), F.col("t.stop")).cast("bigint").alias("read_start"))

    return query


def length_filter(spark, sf_dir):
    return demux(pairs(spark, sf_dir), sheet(spark, sf_dir), NO_TRIM.but(min_length=20), True).where(~F.col("too_short")).select("ord")


def skip_limit(spark, sf_dir):
    return select_range(pairs(spark, sf_dir), Options(skip_reads=100, max_reads=500)).select("ord")


def per_sample_counts(spark, sf_dir):
    return summary.sample_counts(demux(pairs(spark, sf_dir), sheet(spark, sf_dir), NO_TRIM.but(min_length=20), True))


def summary_metrics(spark, sf_dir):
    return summary.metrics(demux(pairs(spark, sf_dir), sheet(spark, sf_dir), NO_TRIM.but(mismatches1=1, mismatches2=1, min_length=20), True), True)


def demux_full(spark, sf_dir):
    """Every step at once: matching with a mismatch, both trims, the length filter, and the metrics over them."""
    return summary.metrics(demux(pairs(spark, sf_dir), sheet(spark, sf_dir), FULL, True), True)


def fastq_render(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", R.fastq_text(F.col("r1_name"), F.col("r1_seq"), F.col("r1_qual")).alias("text"))


def mismatch_audit(spark, sf_dir):
    return qc.mismatch_audit(pairs(spark, sf_dir), sheet(spark, sf_dir))


def chimeric_pairs(spark, sf_dir):
    """Mates of neighbouring pairs exchanged for every third pair, so that chimeras occur."""
    return qc.chimeras(_run(spark, sf_dir, CHIMERIC), sheet(spark, sf_dir))


CHIMERIC = f"""SELECT a.ord, a.r1_seq, b.r2_seq FROM ({PAIRS}) a JOIN (SELECT ord - 1 AS ord, r2_seq FROM ({PAIRS}) q WHERE ord % 3 = 1) b ON a.ord = b.ord
UNION ALL SELECT ord, r1_seq, r2_seq FROM ({PAIRS}) c WHERE ord % 3 <> 0"""


def compare_runs(spark, sf_dir):
    p, s = pairs(spark, sf_dir), sheet(spark, sf_dir)
    count = lambda o: summary.sample_counts(demux(p, s, o, True))
    return qc.compare_counts(count(NO_TRIM), count(NO_TRIM.but(mismatches1=1, mismatches2=1)).where("label <> 'FRANCE'"))


def baseline_diff(spark, sf_dir):
    p, s = pairs(spark, sf_dir), sheet(spark, sf_dir)
    run = lambda o: summary.metrics(demux(p, s, o, True), True)
    return qc.baseline_diff(run(NO_TRIM), run(NO_TRIM.but(orientation="canonical")))


def collapse_swapped(spark, sf_dir):
    d = match(pairs(spark, sf_dir), sheet(spark, sf_dir), Options(), True).where("status = 'match'")
    label = F.concat(F.col("sample_id").cast("string"), F.when(F.col("swapped"), "_swapped").otherwise(""))
    return qc.collapse_swapped(d.groupBy(label.alias("label")).agg(F.count("*").alias("count")))


def peer_sheet(spark, sf_dir):
    return qc.peer_sheet(samples(spark, sf_dir), swapped=True)


def output_digests(spark, sf_dir):
    """Records and bytes of every output file of a run, by label and mate."""
    d = demux(pairs(spark, sf_dir), sheet(spark, sf_dir), NO_TRIM, True)
    text = lambda m: F.length(R.fastq_text(F.col(f"{m}_name"), F.col(f"{m}_seq"), F.col(f"{m}_qual")))
    rows = F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("mate"), text(m).alias("n")) for m in ("r1", "r2")]))
    return d.select("label", rows.alias("x")).groupBy("label", F.col("x.mate").alias("mate")).agg(F.count("*").alias("records"), F.sum("x.n").alias("bytes"))


def fastq_roundtrip(spark, sf_dir):
    """The pairs written as FASTQ files by the sink and read back by the source: records of each file pair."""
    base = scratch(spark, "fastq")
    p = pairs(spark, sf_dir).withColumn("label", F.lit("all")).orderBy("ord")
    write_fastq(p, base, "run", True)
    return read_fastq(spark, f"{base}/run_all_R1.fastq.gz", f"{base}/run_all_R2.fastq.gz").drop("ord")


def _sample_files(spark, sf_dir) -> tuple[str, Sheet, DataFrame]:
    """(folder, sheet, plan) of a run that wrote a pair of files for each sample and one for unassigned reads."""
    base, s = scratch(spark, "samples"), sheet(spark, sf_dir)
    plan = demux(pairs(spark, sf_dir), s, NO_TRIM.but(min_length=20), True)
    write_fastq(written(plan, NO_TRIM).orderBy("ord"), base, "run", True)  # after the joins, under which a sort would be dropped
    return base, s, plan


def sample_files(spark, sf_dir):
    """Records and SHA-256 of the content of every file that the per-sample sink writes, from the files."""
    base, s, _ = _sample_files(spark, sf_dir)
    files = [f"{base}/{file_name('run', label, m, True)}" for label in [*(x.label for x in s.samples), "unassigned"] for m in ("R1", "R2")]
    return qc.file_digests(spark, [f for f in files if exists(f)]).withColumn("path", F.element_at(F.split("path", "/"), -1))


def output_verification(spark, sf_dir):
    """The output checks over a run's files, read back with damage of every kind: ids, order, sequences, lost and foreign records."""
    base, s, plan = _sample_files(spark, sf_dir)
    labels = [x for x in [*(x.label for x in s.samples), "unassigned"] if exists(f"{base}/{file_name('run', x, 'R1', True)}")]
    one, two = (",".join(f"{base}/{file_name('run', x, m, True)}" for x in labels) for m in ("R1", "R2"))
    out = read_fastq(spark, one, two).withColumnRenamed("ord", "place")
    out = out.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), (F.col("place") / FILE_STEP).cast("int") + 1))
    n = F.regexp_extract("r1_name", "([0-9]+)", 1).cast("bigint")
    out = out.where(n % 107 != 0).withColumns({
        "place": F.when(n % 109 == 0, F.col("place") + FILE_STEP // 2).otherwise(F.col("place")),
        "r1_seq": F.when(n % 101 == 0, F.concat(F.lit("N"), "r1_seq")).otherwise(F.col("r1_seq")),
        "r2_name": F.when(n % 97 == 0, F.lit("other/2")).otherwise(F.col("r2_name")),
        "r1_name": F.when(n % 103 == 0, F.concat(F.lit("lost"), "r1_name")).otherwise(F.col("r1_name")),
    })
    counts = written(plan, NO_TRIM).groupBy("label").agg(F.count("*").alias("count"))
    return qc.verify_output(pairs(spark, sf_dir), out, s, counts)


def run_parity(spark, sf_dir):
    """Files whose content differs between a run and one that also matches with a mismatch, by content digests of what would be written."""
    p, s = pairs(spark, sf_dir), sheet(spark, sf_dir)

    def run(options):
        d = written(demux(p, s, options, True), options)
        return d.groupBy(F.col("label").alias("path")).agg(F.sum(F.crc32(F.concat("r1_name", F.lit(" "), "r1_seq", F.lit(" "), "r2_seq").cast("binary"))).cast("string").alias("sha256"))

    return qc.same_content(run(NO_TRIM), run(NO_TRIM.but(orientation="canonical"))).select("path")


def expected_gate(spark, sf_dir):
    """The gate on six counts: those of an exact run expected of a run with mismatches."""
    p, s = pairs(spark, sf_dir), sheet(spark, sf_dir)
    run = lambda o: summary.metrics(demux(p, s, o, True), True)
    want = {r.metric: r["count"] for r in run(NO_TRIM).where(F.col("metric").isin(*GATED)).collect()}
    return qc.expected_counts(run(NO_TRIM.but(mismatches1=1, mismatches2=1)), want)


GATED = ("total_reads", "assigned", "unassigned", "orientation_canonical", "orientation_swapped", "adapter_trimmed")


def representative_samples(spark, sf_dir):
    """Of all samples but France, so that their number is even."""
    return qc.representative_samples(per_sample_counts(spark, sf_dir).where("label <> 'FRANCE'"))


def extra_by_sample(spark, sf_dir):
    return qc.extra_by_sample(pairs(spark, sf_dir), sheet(spark, sf_dir))


def summary_rates(spark, sf_dir):
    return summary.rates(demux(pairs(spark, sf_dir), sheet(spark, sf_dir), FULL, True), True)


def sheet_parse(spark, sf_dir):
    """The samples as a sheet file with other names of its columns, parsed."""
    rows = sorted(samples(spark, sf_dir).collect())  # 25 rows
    text = "Sample Name,BC-1,note,i5\n" + "".join(f" {r.name} ,{r.bc1.lower()},x,{r.bc2}\n" for r in rows)
    return spark.createDataFrame([(s.id, s.name, s.label, s.barcode1.raw, s.barcode2.raw) for s in parse_sheet(text).samples], "sample_id int, name string, label string, bc1 string, bc2 string")


def strip_se(spark, sf_dir):
    return demux(single_reads(spark, sf_dir), sheet(spark, sf_dir), NO_TRIM, False).select("ord", "r1_name", "r1_seq", "r1_qual")


def umi_se(spark, sf_dir):
    return demux(single_reads(spark, sf_dir), sheet(spark, sf_dir, umi=True), NO_TRIM, False).select("ord", "umi", "r1_name")


def discard_unassigned(spark, sf_dir):
    o = NO_TRIM.but(discard_unassigned=True, min_length=20)
    return written(demux(pairs(spark, sf_dir), sheet(spark, sf_dir), o, True), o).select("ord")


def count_text(spark, sf_dir):
    return validate_pe(spark, sf_dir).select(R.count_text(F.col("records")).alias("records"), R.count_text(F.col("bases")).alias("bases"))


def at_positions(spark, sf_dir):
    return pairs(spark, sf_dir).select("ord", R.at_positions(F.col("r1_seq"), [0, 3, 6]).alias("value"))


def fastq_head(spark, sf_dir):
    """The first 200 pairs of a pair of files, as files, read back."""
    base = scratch(spark, "head")
    write_fastq(pairs(spark, sf_dir).withColumn("label", F.lit("all")).orderBy("ord"), base, "run", True)
    head(spark, f"{base}/run_all_R1.fastq.gz", f"{base}/run_all_R2.fastq.gz", f"{base}/head_R1.fastq.gz", f"{base}/head_R2.fastq.gz", 200)
    return read_fastq(spark, f"{base}/head_R1.fastq.gz", f"{base}/head_R2.fastq.gz").drop("ord")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "per_sample_counts": per_sample_counts,
    "summary_metrics": summary_metrics,
    "demux_full": demux_full,
    "validate_pe": validate_pe,
    "validate_se": validate_se,
    "read_id_normalize": read_id_normalize,
    "revcomp": revcomp,
    "sanitize_label": sanitize_label,
    "hamming_mates": hamming_mates,
    "sheet_geometry": sheet_geometry,
    "match_exact_pe": _match(Options()),
    "match_mm1_pe": _match(MM1),
    "match_mm4_pe": _match(MM4),
    "match_canonical_only": _match(MM1.but(orientation="canonical")),
    "match_swapped_only": _match(MM1.but(orientation="swapped")),
    "match_margin_pe": _match(MM4.but(min_delta=5)),
    "match_single_pe": _match(Options(mismatches1=1), single=True),
    "match_single_se": _match(Options(mismatches1=2), single=True, paired=False),
    "match_dual_se": _match(MM1, paired=False),
    "canonicalize_strip": _plan(NO_TRIM, "ord", "r1_name", "r1_seq", "r2_seq"),
    "keep_order_strip": _plan(NO_TRIM.but(canonicalize=False), "ord", "r1_seq", "r2_seq"),
    "umi_extract": _plan(NO_TRIM, "ord", "umi", "r1_name", "r2_name", umi=True),
    "tso_trim": _plan(NO_TRIM.but(tso=Tso("NNNII")), "ord", "r1_name", "r1_seq"),
    "quality_trim_3p": _quality(cutoff3=20),
    "quality_trim_5p3p": _quality(cutoff3=20, cutoff5=25),
    "nextseq_trim": _quality(cutoff3=20, nextseq=True),
    "adapter_trim_r1": _adapter("r1", False),
    "adapter_trim_r2": _adapter("r2", False),
    "adapter_trim_r1_edited": _adapter("r1", True),
    "adapter_trim_r2_edited": _adapter("r2", True),
    "length_filter": length_filter,
    "skip_limit": skip_limit,
    "fastq_render": fastq_render,
    "mismatch_audit": mismatch_audit,
    "chimeric_pairs": chimeric_pairs,
    "compare_runs": compare_runs,
    "baseline_diff": baseline_diff,
    "collapse_swapped": collapse_swapped,
    "peer_sheet": peer_sheet,
    "output_digests": output_digests,
    "fastq_roundtrip": fastq_roundtrip,
    "umi_and_tso": _plan(NO_TRIM.but(tso=Tso("NNNII")), "ord", "umi", "r1_name", "r2_name", "r1_seq", umi=True),
    **{f.__name__: f for f in (sample_files, output_verification, run_parity, expected_gate, representative_samples, extra_by_sample, summary_rates, sheet_parse, strip_se, umi_se, discard_unassigned, count_text, at_positions, fastq_head)},
}


# --- the same in SQL -----------------------------------------------------------------------------


def _mismatches(seq: str, bc: str, end: bool = False, umi: int | None = None) -> str:
    """Mismatches of a barcode of 8 against a read's first or last bases; null where the read is shorter."""
    start = lambda i: f"length({seq}) - 8 + {i}" if end else str(i)
    return f"CASE WHEN length({seq}) >= 8 THEN " + " + ".join(f"(substr({seq}, {start(i)}, 1) <> substr({bc}, {i}, 1))::INT" for i in range(1, 9) if i != umi) + " END"


def _match_sql(reads: str, m1: int, m2: int | None, arms: str = "both", delta: int = 0, end: bool = False, paired: bool = True, umi: bool = False) -> str:
    """Every read against every sample and arm; the best eligible distance, its rivals, and the verdict."""
    u1, u2 = (4, 7) if umi else (None, None)
    one = []
    if m2 is None:
        one.append(("FALSE", _mismatches("r1_seq", "bc1"), "0"))
    elif end:
        one.append(("FALSE", _mismatches("r1_seq", "bc1"), _mismatches("r1_seq", "bc2", True)))
    else:
        if arms != "swapped":
            one.append(("FALSE", _mismatches("r1_seq", "bc1", umi=u1), _mismatches("r2_seq", "bc2", umi=u2)))
        if arms != "canonical":
            one.append(("TRUE", _mismatches("r2_seq", "bc1", umi=u1), _mismatches("r1_seq", "bc2", umi=u2)))
    every = " UNION ALL ".join(f"SELECT ord, sample_id AS sid, {s} AS swap, {a} AS d1, {b} AS d2 FROM reads, samples" for s, a, b in one)
    return f"""WITH reads AS MATERIALIZED ({reads}), samples AS ({SAMPLES}), d AS ({every}),
t AS (SELECT ord, sid, swap, d1 + d2 AS dist, d1 <= {m1} AND d2 <= {m2 or 0} AS ok FROM d),
per AS (SELECT ord, sid, min(dist) FILTER (ok) AS good, min(dist) AS any_d, min(dist * 2 + swap::INT) FILTER (ok) % 2 = 1 AS swap FROM t GROUP BY ord, sid),
b AS (SELECT ord, min(good) AS best FROM per GROUP BY ord),
w AS (SELECT b.ord, b.best, count(*) FILTER (good = best) AS n, min(sid) FILTER (good = best) AS sid, bool_or(swap) FILTER (good = best) AS swap FROM b JOIN per USING (ord) GROUP BY b.ord, b.best),
r AS (SELECT w.*, (SELECT min(any_d) FROM per WHERE per.ord = w.ord AND per.sid <> w.sid) AS rival FROM w),
m AS (SELECT reads.ord, CASE WHEN best IS NULL THEN 'none' WHEN n > 1 OR ({delta} > 0 AND coalesce(rival <= best OR rival - best < {delta}, FALSE)) THEN 'ambiguous' ELSE 'match' END AS status, sid, best, swap FROM reads LEFT JOIN r USING (ord)),
matched AS (SELECT ord, status, CASE WHEN status = 'match' THEN sid END AS sample_id, best::INT AS distance, status = 'match' AND swap AS swapped FROM m)
"""


def _verdict(*a, **k) -> str:
    return _match_sql(*a, **k) + "SELECT * FROM matched"


#: From the verdict to mates in order, with both barcodes cut off.
_STRIPPED = """, x AS (SELECT p.ord, status, sample_id, swapped, s.name AS label,
  CASE WHEN swapped THEN r2_name ELSE r1_name END AS n1, CASE WHEN swapped THEN r1_name ELSE r2_name END AS n2,
  CASE WHEN swapped THEN r2_seq ELSE r1_seq END AS s1, CASE WHEN swapped THEN r1_seq ELSE r2_seq END AS s2
  FROM reads p JOIN matched USING (ord) LEFT JOIN samples s USING (sample_id)),
y AS (SELECT *, CASE WHEN status = 'match' THEN substr(s1, 9) ELSE s1 END AS c1, CASE WHEN status = 'match' THEN substr(s2, 9) ELSE s2 END AS c2 FROM x)
"""


def _metrics_sql(where: str, cte: str, quality: str = "FALSE", adapter: str = "FALSE") -> str:
    """metric and count over rows y of a run. where: the length filter, as what survives; quality and adapter: what counts as trimmed."""
    plain = {
        "total_reads": "TRUE", "assigned": f"status = 'match' AND {where}", "unassigned": f"status <> 'match' AND {where}", "ambiguous": "status = 'ambiguous'", "quality_trimmed": quality, "adapter_trimmed": adapter,
        "too_short": f"NOT ({where})", "five_prime_matched_three_prime_missing": "FALSE", "orientation_canonical": "status = 'match' AND NOT swapped", "orientation_swapped": "status = 'match' AND swapped",
        "matched_before_filter": "status = 'match'", "no_match_before_filter": "status = 'none'", "ambiguous_after_filter": f"status = 'ambiguous' AND {where}",
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({v}) AS count FROM y" for k, v in plain.items())
    return f"{cte} SELECT * FROM ({rows} UNION ALL SELECT concat('sample:', label), count(*) FROM y WHERE status = 'match' AND {where} GROUP BY label)"


_LONG = "least(length(c1), length(c2)) >= 20"


def _counts_sql(where: str, cte: str, name: str) -> str:
    return f"{name} AS (SELECT label, count(*) AS count FROM ({cte} SELECT * FROM y) WHERE status = 'match' AND {where} GROUP BY label)"


def _quality_sql(cutoff3: int, cutoff5: int, nextseq: bool = False, reads: str = f"SELECT ord, r1_seq AS seq, r1_qual AS qual FROM ({PAIRS})") -> str:
    """Running sums from either end; what follows a negative sum doesn't count; the first highest sum above zero cuts."""
    q = "ascii(substr(qual, i, 1)) - 33"
    gain3 = f"CASE WHEN substr(seq, i, 1) = 'G' THEN 1 ELSE {cutoff3} - ({q}) END" if nextseq else f"{cutoff3} - ({q})"
    if not cutoff3 and not nextseq:
        gain3 = "-1"
    gain5 = f"{cutoff5} - ({q})" if cutoff5 else "-1"
    side = lambda gain, order: f"""SELECT ord, coalesce(min(k) FILTER (s = top AND s > 0), 0) AS cut FROM (SELECT *, max(s) FILTER (low >= 0) OVER (PARTITION BY ord) AS top FROM (
      SELECT *, min(s) OVER (PARTITION BY ord ORDER BY k) AS low FROM (SELECT ord, k, sum(g) OVER (PARTITION BY ord ORDER BY k) AS s FROM (SELECT ord, {order} AS k, {gain} AS g FROM b)))) WHERE low >= 0 GROUP BY ord"""  # noqa: E731
    return f"""WITH r AS MATERIALIZED ({reads}), b AS (SELECT ord, seq, qual, unnest(range(1, length(seq) + 1)) AS i FROM r),
five AS ({side(gain5, 'i')}), three AS ({side(gain3, 'length(seq) + 1 - i')}),
z AS (SELECT ord, coalesce(five.cut, 0) AS a, length(seq) - coalesce(three.cut, 0) AS z FROM r LEFT JOIN five USING (ord) LEFT JOIN three USING (ord))
SELECT ord, CASE WHEN a >= z THEN 0 ELSE a END::INT AS start, CASE WHEN a >= z THEN 0 ELSE z END::INT AS stop FROM z"""


def _adapter_sql(reads: str, adapter: str, overlap: int = 3, rate: float = 0.1) -> str:
    m, allowed = len(adapter), allowed_errors(len(adapter), rate)
    top = max(allowed)
    ok = lambda n: f"({allowed})[{n} + 1]"
    edits = ", ".join(f"CASE WHEN l - {i} >= {overlap} THEN {{'d': levenshtein(w, substr('{adapter}', 1, l - {i})), 'j': l - {i}}} END" for i in range(top, -1, -1))
    return f"""WITH r AS MATERIALIZED ({reads}),
k AS (SELECT ord, seq, unnest(range(greatest(0, greatest(0, length(seq) - {m + 8}) - {m}), length(seq))) AS k FROM r),
p AS (SELECT *, substr(seq, k + 1, l) AS w FROM (SELECT *, least(length(seq) - k, {m}) AS l FROM k) WHERE l >= {overlap}),
h AS (SELECT *, hamming(w, substr('{adapter}', 1, l)) AS h FROM p),
e AS (SELECT *, CASE WHEN h > {ok('l')} AND {ok('l')} > 0 THEN list_min(list_filter([{edits}], lambda x: x IS NOT NULL)) END AS e FROM h),
c AS (SELECT ord, k, l AS j, h AS errors FROM e WHERE h <= {ok('l')} UNION ALL SELECT ord, k, e.j, e.d FROM e WHERE e IS NOT NULL AND e.d <= {ok('e.j')}),
best AS (SELECT ord, arg_min(k, [-j, errors, k]) AS k FROM c GROUP BY ord)
SELECT ord, k::BIGINT AS read_start FROM r LEFT JOIN best USING (ord)"""


def _umi_name(name: str, umi: str) -> str:
    return f"CASE WHEN {umi} = '' THEN {name} ELSE concat(translate({name}, ' ', '_'), CASE WHEN contains({name}, 'rbc:') THEN '' ELSE 'rbc:' END, {umi}) END"


def _trimmed_sql(cte: str, cutoff3: int, cutoff5: int) -> str:
    """From mates in order without barcodes to what both trims leave: y with the lengths l1 and l2, and whether each trim took anything."""
    out = cte.replace("WHEN swapped THEN r2_name ELSE r1_name END AS n1", "WHEN swapped THEN r2_qual ELSE r1_qual END AS q1, CASE WHEN swapped THEN r1_qual ELSE r2_qual END AS q2, CASE WHEN swapped THEN r2_name ELSE r1_name END AS n1")
    out = out.replace("\ny AS (SELECT *,", "\ny0 AS (SELECT *, CASE WHEN status = 'match' THEN substr(q1, 9) ELSE q1 END AS u1, CASE WHEN status = 'match' THEN substr(q2, 9) ELSE q2 END AS u2,")
    for m, adapter in (("1", ADAPTER_R1), ("2", ADAPTER_R2)):
        out += f""", qa{m} AS ({_quality_sql(cutoff3, cutoff5, reads=f"SELECT ord, c{m} AS seq, u{m} AS qual FROM y0")}),
aa{m} AS ({_adapter_sql(f"SELECT ord, substr(c{m}, start + 1, stop - start) AS seq FROM y0 JOIN qa{m} USING (ord)", adapter)})"""
    return f"""{out}, y AS (SELECT y0.*, qa1.start > 0 OR qa1.stop < length(c1) OR qa2.start > 0 OR qa2.stop < length(c2) AS cut, aa1.read_start IS NOT NULL OR aa2.read_start IS NOT NULL AS found,
  coalesce(aa1.read_start, qa1.stop - qa1.start) AS l1, coalesce(aa2.read_start, qa2.stop - qa2.start) AS l2 FROM y0 JOIN qa1 USING (ord) JOIN qa2 USING (ord) JOIN aa1 USING (ord) JOIN aa2 USING (ord))
"""


def _oracles() -> dict[str, str]:
    exact = _match_sql(PAIRS, 0, 0) + _STRIPPED
    mm1 = _match_sql(PAIRS, 1, 1) + _STRIPPED
    canonical = _match_sql(PAIRS, 0, 0, "canonical") + _STRIPPED
    total = "sum(length(r1_seq) + length(r2_seq))::BIGINT"
    audit = f"WITH a AS ({_verdict(PAIRS, 0, 0)}), b AS ({_verdict(PAIRS, 1, 1)})"
    full, kept = _trimmed_sql(mm1, 20, 10), "l1 >= 12 AND l2 >= 12"
    gated = ", ".join(f"'{g}'" for g in GATED)
    file_text = lambda n, s, q: f"concat('@', {n}, chr(10), {s}, chr(10), '+', chr(10), {q}, chr(10))"
    quals = exact.replace("WHEN swapped THEN r2_name ELSE r1_name END AS n1", "WHEN swapped THEN r2_qual ELSE r1_qual END AS q1, CASE WHEN swapped THEN r1_qual ELSE r2_qual END AS q2, CASE WHEN swapped THEN r2_name ELSE r1_name END AS n1")
    quals = quals.replace("\ny AS (SELECT *,", "\ny AS (SELECT *, CASE WHEN status = 'match' THEN substr(q1, 9) ELSE q1 END AS u1, CASE WHEN status = 'match' THEN substr(q2, 9) ELSE q2 END AS u2,")
    named = "coalesce(replace(label, ' ', '_'), 'unassigned')"
    matched_se = _match_sql(SINGLE, 1, 1, end=True).replace("d1 <= 1 AND d2 <= 1", "d1 <= 0 AND d2 <= 0")
    umi_se = f"WITH reads AS MATERIALIZED ({SINGLE}), samples AS ({SAMPLES}), v AS (SELECT ord, count(*) AS n FROM reads, samples WHERE {_mismatches('r1_seq', 'bc1', umi=4)} = 0 AND {_mismatches('r1_seq', 'bc2', True, umi=7)} = 0 GROUP BY ord)"
    rc = lambda x: f"reverse(translate(regexp_replace(upper({x}), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))"
    return {
        "per_sample_counts": f"{exact} SELECT label, count(*) AS count FROM y WHERE status = 'match' AND {_LONG} GROUP BY label",
        "summary_metrics": _metrics_sql(_LONG, mm1),
        "validate_pe": f"SELECT count(*) AS records, {total} AS bases, min(least(length(r1_seq), length(r2_seq))) AS min_length, max(greatest(length(r1_seq), length(r2_seq))) AS max_length FROM ({PAIRS})",
        "validate_se": f"SELECT count(*) AS records, sum(length(r1_seq))::BIGINT AS bases, min(length(r1_seq)) AS min_length, max(length(r1_seq)) AS max_length FROM ({PAIRS})",
        "read_id_normalize": f"SELECT ord, concat('read', ord) AS value, concat('read', ord) AS plain FROM ({PAIRS})",
        "revcomp": f"SELECT ord, {rc('r1_seq')} AS value FROM ({PAIRS})",
        "sanitize_label": f"SELECT sample_id, regexp_replace(concat(name, ' / lane:1'), '[^A-Za-z0-9._-]', '_', 'g') AS value FROM ({SAMPLES})",
        "hamming_mates": f"SELECT ord, hamming(substr(r1_seq, 1, 16), substr(r2_seq, 1, 16)) AS value FROM ({PAIRS})",
        "sheet_geometry": f"WITH s AS ({SAMPLES}) SELECT a.sample_id AS id_a, b.sample_id AS id_b, hamming(a.bc1, b.bc1) AS d1, hamming(a.bc2, b.bc2) AS d2, hamming(a.bc1, b.bc1) + hamming(a.bc2, b.bc2) AS d FROM s a JOIN s b ON a.sample_id < b.sample_id",
        "match_exact_pe": _verdict(PAIRS, 0, 0),
        "match_mm1_pe": _verdict(PAIRS, 1, 1),
        "match_mm4_pe": _verdict(PAIRS, 4, 4),
        "match_canonical_only": _verdict(PAIRS, 1, 1, "canonical"),
        "match_swapped_only": _verdict(PAIRS, 1, 1, "swapped"),
        "match_margin_pe": _verdict(PAIRS, 4, 4, delta=5),
        "match_single_pe": _verdict(PAIRS, 1, None),
        "match_single_se": _verdict(PAIRS, 2, None),
        "match_dual_se": _verdict(SINGLE, 1, 1, end=True),
        "canonicalize_strip": f"{exact} SELECT ord, n1 AS r1_name, c1 AS r1_seq, c2 AS r2_seq FROM y",
        "keep_order_strip": f"{exact} SELECT ord, CASE WHEN swapped THEN c2 ELSE c1 END AS r1_seq, CASE WHEN swapped THEN c1 ELSE c2 END AS r2_seq FROM y",
        "umi_extract": _match_sql(PAIRS, 0, 0, umi=True) + _STRIPPED + f", u AS (SELECT *, CASE WHEN status = 'match' THEN concat(substr(s1, 4, 1), substr(s2, 7, 1)) ELSE '' END AS umi FROM y) SELECT ord, umi, {_umi_name('n1', 'umi')} AS r1_name, {_umi_name('n2', 'umi')} AS r2_name FROM u",
        "tso_trim": f"{exact} SELECT ord, CASE WHEN length(c1) >= 5 THEN {_umi_name('n1', 'substr(c1, 1, 3)')} ELSE n1 END AS r1_name, CASE WHEN length(c1) >= 5 THEN substr(c1, 6) ELSE c1 END AS r1_seq FROM y",
        "quality_trim_3p": _quality_sql(20, 0),
        "quality_trim_5p3p": _quality_sql(20, 25),
        "nextseq_trim": _quality_sql(20, 0, True),
        "adapter_trim_r1": _adapter_sql(f"SELECT ord, r1_seq AS seq FROM ({PAIRS})", ADAPTER_R1),
        "adapter_trim_r2": _adapter_sql(f"SELECT ord, r2_seq AS seq FROM ({PAIRS})", ADAPTER_R2),
        "adapter_trim_r1_edited": _adapter_sql(_edited("r1"), ADAPTER_R1),
        "adapter_trim_r2_edited": _adapter_sql(_edited("r2"), ADAPTER_R2),
        "length_filter": f"{exact} SELECT ord FROM y WHERE {_LONG}",
        "skip_limit": f"SELECT ord FROM ({PAIRS}) WHERE ord >= 100 AND ord < 600",
        "fastq_render": f"SELECT ord, concat('@', r1_name, chr(10), r1_seq, chr(10), '+', chr(10), r1_qual, chr(10)) AS text FROM ({PAIRS})",
        "mismatch_audit": f"{audit} SELECT CASE WHEN a.status = 'match' THEN 'exact' WHEN b.status = 'match' THEN concat('new_distance_', b.distance) WHEN b.status = 'ambiguous' THEN 'ambiguous' ELSE 'unmatched' END AS category, count(*) AS count FROM a JOIN b USING (ord) GROUP BY 1",
        "chimeric_pairs": f"""WITH s AS ({SAMPLES}), c AS (SELECT code, list(DISTINCT id) AS ids FROM (SELECT bc1 AS code, sample_id AS id FROM s UNION ALL SELECT bc2, sample_id FROM s) GROUP BY code)
SELECT ord FROM ({CHIMERIC}) p JOIN c a ON a.code = substr(r1_seq, 1, 8) JOIN c b ON b.code = substr(r2_seq, 1, 8) WHERE NOT list_has_any(a.ids, b.ids)""",
        "compare_runs": f"WITH {_counts_sql('TRUE', exact, 'a')}, {_counts_sql('TRUE', mm1, 'b')} SELECT label, coalesce(a.count, 0) AS count_a, coalesce(b.count, 0) AS count_b, coalesce(b.count, 0) - coalesce(a.count, 0) AS difference FROM a FULL JOIN (SELECT * FROM b WHERE label <> 'FRANCE') b USING (label)",
        "baseline_diff": f"WITH a AS ({_metrics_sql('TRUE', exact)}), b AS ({_metrics_sql('TRUE', canonical)}) SELECT metric, a.count AS a, b.count AS b FROM a FULL JOIN b USING (metric) WHERE a.count IS DISTINCT FROM b.count",
        "collapse_swapped": f"SELECT sample_id::VARCHAR AS label, count(*) AS count FROM ({_verdict(PAIRS, 0, 0)}) WHERE status = 'match' GROUP BY 1",
        "peer_sheet": f"WITH s AS ({SAMPLES}) SELECT concat(bc1, ',', {rc('bc2')}, ':', name) AS line FROM s UNION ALL SELECT concat(bc2, ',', {rc('bc1')}, ':', name, '_swapped') FROM s",
        "output_digests": f"{exact} SELECT coalesce(replace(label, ' ', '_'), 'unassigned') AS label, mate, count(*) AS records, sum(CASE mate WHEN 'R1' THEN length(n1) + 2 * length(c1) ELSE length(n2) + 2 * length(c2) END + 6)::BIGINT AS bytes FROM y, (SELECT unnest(['R1', 'R2']) AS mate) GROUP BY 1, 2",
        "fastq_roundtrip": f"SELECT r1_name, r1_seq, r1_qual, r2_name, r2_seq, r2_qual FROM ({PAIRS})",
        "demux_full": _metrics_sql(kept, full, "cut", "found"),
        "summary_rates": f"{full} SELECT 'match_rate' AS metric, printf('%.6f', count(*) FILTER (status = 'match' AND {kept}) / count(*)) AS rate FROM y UNION ALL SELECT 'assignment_rate_before_filter', printf('%.6f', count(*) FILTER (status = 'match') / count(*)) FROM y",
        "sample_files": f"{quals} SELECT concat('run_', {named}, '_', mate, '.fastq.gz') AS path, count(*) AS records, sha256(string_agg(CASE mate WHEN 'R1' THEN {file_text('n1', 'c1', 'u1')} ELSE {file_text('n2', 'c2', 'u2')} END, '' ORDER BY ord)) AS sha256 FROM y, (SELECT unnest(['R1', 'R2']) AS mate) WHERE {_LONG} GROUP BY 1, mate",
        "output_verification": f"""{exact}, o AS (SELECT {named} AS label, ord AS n, status, CASE WHEN ord % 103 <> 0 THEN ord END AS ord, CASE WHEN ord % 109 = 0 THEN ord + 1000000000000 ELSE ord END AS place FROM y WHERE {_LONG}),
l AS (SELECT *, max(ord) OVER (PARTITION BY label ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o WHERE n % 107 <> 0)
SELECT 'mate_ids' AS problem, count(*) FILTER (n % 97 = 0 OR n % 103 = 0) AS count FROM l UNION ALL SELECT 'not_in_input', count(*) FILTER (n % 103 = 0) FROM l UNION ALL SELECT 'out_of_order', count(*) FILTER (ord < last) FROM l
UNION ALL SELECT 'no_prefix', count(*) FILTER (status = 'match' AND n % 101 = 0 AND n % 103 <> 0) FROM l UNION ALL SELECT 'counts', count(DISTINCT label) FROM o WHERE n % 107 = 0""",
        "run_parity": f"WITH a AS ({exact} SELECT label, ord FROM y), b AS ({canonical} SELECT label, ord FROM y), d AS (SELECT DISTINCT coalesce(x.label, 'unassigned') AS path FROM (SELECT ord, unnest([a.label, b.label]) AS label FROM a JOIN b USING (ord) WHERE a.label IS DISTINCT FROM b.label) x) SELECT path FROM d",
        "expected_gate": f"WITH a AS ({_metrics_sql('TRUE', exact)}), b AS ({_metrics_sql('TRUE', mm1)}) SELECT metric, a.count AS expected, b.count AS found FROM a JOIN b USING (metric) WHERE a.count <> b.count AND metric IN ({gated})",
        "representative_samples": f"WITH c AS (SELECT label, count, row_number() OVER (ORDER BY count, label) - 1 AS k, count(*) OVER () AS n FROM ({exact} SELECT label, count(*) AS count FROM y WHERE status = 'match' AND label <> 'FRANCE' AND {_LONG} GROUP BY label)) SELECT CASE WHEN k = 0 THEN 'min' WHEN k = n // 2 THEN 'median' ELSE 'max' END AS which, label, count FROM c WHERE k IN (0, n // 2, n - 1)",
        "extra_by_sample": f"{audit} SELECT b.sample_id, count(*) AS count FROM a JOIN b USING (ord) WHERE a.status <> 'match' AND b.status = 'match' GROUP BY 1",
        "sheet_parse": f"SELECT sample_id, name, replace(name, ' ', '_') AS label, bc1, bc2 FROM ({SAMPLES})",
        "strip_se": f"{matched_se} SELECT ord, r1_name, CASE WHEN status = 'match' THEN substr(r1_seq, 9, length(r1_seq) - 16) ELSE r1_seq END AS r1_seq, CASE WHEN status = 'match' THEN substr(r1_qual, 9, length(r1_seq) - 16) ELSE r1_qual END AS r1_qual FROM reads JOIN matched USING (ord)",
        "umi_se": f"{umi_se}, u AS (SELECT ord, r1_name, CASE WHEN n = 1 THEN concat(substr(r1_seq, 4, 1), substr(r1_seq, length(r1_seq) - 1, 1)) ELSE '' END AS umi FROM reads LEFT JOIN v USING (ord)) SELECT ord, umi, {_umi_name('r1_name', 'umi')} AS r1_name FROM u",
        "umi_and_tso": _match_sql(PAIRS, 0, 0, umi=True) + _STRIPPED + f", u AS (SELECT *, CASE WHEN status = 'match' THEN concat(substr(s1, 4, 1), substr(s2, 7, 1)) ELSE '' END AS umi, CASE WHEN length(c1) >= 5 THEN {_umi_name('n1', 'substr(c1, 1, 3)')} ELSE n1 END AS t1 FROM y) SELECT ord, umi, {_umi_name('t1', 'umi')} AS r1_name, {_umi_name('n2', 'umi')} AS r2_name, CASE WHEN length(c1) >= 5 THEN substr(c1, 6) ELSE c1 END AS r1_seq FROM u",
        "discard_unassigned": f"{exact} SELECT ord FROM y WHERE status = 'match' AND {_LONG}",
        "count_text": f"SELECT format('{{:,}}', count(*)) AS records, format('{{:,}}', {total}) AS bases FROM ({PAIRS})",
        "at_positions": f"SELECT ord, concat(substr(r1_seq, 1, 1), substr(r1_seq, 4, 1), substr(r1_seq, 7, 1)) AS value FROM ({PAIRS})",
        "fastq_head": f"SELECT r1_name, r1_seq, r1_qual, r2_name, r2_seq, r2_qual FROM ({PAIRS}) ORDER BY ord LIMIT 200",
    }


ORACLE_SQL = _oracles()
