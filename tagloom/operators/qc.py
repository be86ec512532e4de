"""Quality control over runs: mismatch audits, chimeras, comparisons of counts and outputs, sheet geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import read_id
from ..plans.config import Options, Sheet
from ..sources.shared import scratch
from .match import match


def mismatch_audit(df: DataFrame, sheet: Sheet) -> DataFrame:
    """category and count of pairs: assigned exactly, newly with one mismatch a barcode (at distance 1 or 2), ambiguous, or still without match."""
    keys = ["ord", "r1_seq", "r2_seq"]
    exact = match(df.select(*keys), sheet, Options(), True).select(*keys, F.col("status").alias("exact"))
    both = match(exact, sheet, Options(mismatches1=1, mismatches2=1), True)
    category = (
        F.when(F.col("exact") == "match", "exact").when(F.col("status") == "match", F.concat(F.lit("new_distance_"), F.col("distance").cast("string"))).when(F.col("status") == "ambiguous", "ambiguous").otherwise("unmatched")
    )
    return both.groupBy(category.alias("category")).agg(F.count("*").alias("count"))


def extra_by_sample(df: DataFrame, sheet: Sheet) -> DataFrame:
    """sample_id and count of the pairs that one mismatch a barcode adds."""
    keys = ["ord", "r1_seq", "r2_seq"]
    exact = match(df.select(*keys), sheet, Options(), True).select(*keys, F.col("status").alias("exact"))
    both = match(exact, sheet, Options(mismatches1=1, mismatches2=1), True)
    return both.where("exact <> 'match' and status = 'match'").groupBy("sample_id").agg(F.count("*").alias("count"))


def chimeras(df: DataFrame, sheet: Sheet) -> DataFrame:
    """Pairs (ord) whose mates both start with a known barcode of either column, but of no sample in common. The sheet is bounded by its file."""
    rows = [(b.raw, s.id) for s in sheet.samples for b in (s.barcode1, s.barcode2) if b]
    width = len(sheet.samples[0].barcode1.raw)
    known = df.sparkSession.createDataFrame(rows, "code string, id int").groupBy("code").agg(F.collect_set("id").alias("ids"))
    one, two = (F.broadcast(known.select(F.col("code").alias(f"code{i}"), F.col("ids").alias(f"ids{i}"))) for i in (1, 2))
    out = df.select("ord", F.substring("r1_seq", 1, width).alias("p1"), F.substring("r2_seq", 1, width).alias("p2"))
    out = out.join(one, F.col("p1") == F.col("code1")).join(two, F.col("p2") == F.col("code2"))
    return out.where(~F.arrays_overlap("ids1", "ids2")).select("ord")


def compare_counts(a: DataFrame, b: DataFrame, key: str = "label") -> DataFrame:
    """key, count_a, count_b and difference of two tables of counts; what one lacks counts 0 there."""
    left, right = a.select(key, F.col("count").alias("count_a")), b.select(key, F.col("count").alias("count_b"))
    out = left.join(right, key, "full").select(key, F.coalesce("count_a", F.lit(0)).alias("count_a"), F.coalesce("count_b", F.lit(0)).alias("count_b"))
    return out.withColumn("difference", F.col("count_b") - F.col("count_a"))


def collapse_swapped(counts: DataFrame, key: str = "label") -> DataFrame:
    """Counts of <name>_swapped added to those of <name>."""
    return counts.groupBy(F.regexp_replace(key, "_swapped$", "").alias(key)).agg(F.sum("count").alias("count"))


def baseline_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a and b of every metric that differs between two summaries or that one of them lacks."""
    left, right = a.select("metric", F.col("count").alias("a")), b.select("metric", F.col("count").alias("b"))
    return left.join(right, "metric", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def geometry(df_samples: DataFrame) -> DataFrame:
    """id_a, id_b, d1, d2 and d: pairwise Hamming distances of the samples' barcodes (samples: sample_id, bc1, bc2). The sheet is small, so pairs are few."""
    diff = lambda x, y: F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda s, i: s + (F.substr(F.col(x), i, F.lit(1)) != F.substr(F.col(y), i, F.lit(1))).cast("int"))
    a = df_samples.select(F.col("sample_id").alias("id_a"), F.col("bc1").alias("a1"), F.col("bc2").alias("a2"))
    b = df_samples.select(F.col("sample_id").alias("id_b"), F.col("bc1").alias("b1"), F.col("bc2").alias("b2"))
    out = a.join(F.broadcast(b), F.col("id_a") < F.col("id_b")).select("id_a", "id_b", diff("a1", "b1").alias("d1"), diff("a2", "b2").alias("d2"))
    return out.withColumn("d", F.col("d1") + F.col("d2"))


def representative_samples(counts: DataFrame) -> DataFrame:
    """The samples of lowest, middle and highest count (which, label, count) among those with reads; ties go by label. The middle one of
    an even number is the upper one. A sample that would stand twice stands once, under the first of its roles."""
    from pyspark.sql import Window

    some = counts.where("count > 0")
    ranked = some.withColumn("rank", F.row_number().over(Window.orderBy("count", "label")) - 1).crossJoin(F.broadcast(some.agg(F.count("*").alias("n"))))  # a row for each sample
    which = F.when(F.col("rank") == 0, "min").when(F.col("rank") == F.floor(F.col("n") / 2), "median").when(F.col("rank") == F.col("n") - 1, "max")
    return ranked.withColumn("which", which).where("which is not null").select("which", "label", "count")


#: Places that are put in order together, as a power of two.
STRETCH = 12


def with_last(rows: DataFrame) -> DataFrame:
    """rows (label, place, ord and others) and last: the highest ord among those of lower places of their label. Places are whole numbers.

    One label may have most rows, so no task takes a label: rows are dealt by stretches of 2**STRETCH places. What precedes a stretch comes
    from the highest ord of each stretch before it.
    """
    from pyspark.sql import Window

    before = lambda *keys: Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, -1)
    names = rows.columns
    rows = rows.withColumn("stretch", F.struct("label", F.shiftright("place", STRETCH).alias("at"))).drop("label")  # a struct, as = on it holds for nulls
    tops = rows.groupBy("stretch").agg(F.max("ord").alias("top"))
    tops = tops.select("stretch", F.max("top").over(before("stretch.label", "stretch.at")).alias("carry"))  # a row for each stretch
    rows = rows.withColumn("near", F.max("ord").over(before("stretch", "place"))).join(tops, "stretch", "left")
    return rows.withColumns({"label": F.col("stretch.label"), "last": F.greatest("near", "carry")}).select(*names, "last")


def verify_output(raw: DataFrame, out: DataFrame, sheet: Sheet, counts: DataFrame) -> DataFrame:
    """problem and count of everything wrong with the output of a paired run that cuts barcodes, for five checks:

    mates whose ids differ; samples whose records are not as many as counts (label, count) say; pairs that the input lacks; pairs that follow
    one of a later place in the input; mates that are no prefix of the input's, in order and without its barcodes.
    raw: ord and r1_*, r2_*; out: label, place (of a record in its sample's files), r1_name, r1_seq, r2_name, r2_seq. What the checks find of
    each record is written to the shared folder first.
    """
    own = out.withColumn("id", read_id(F.col("r1_name")))
    source = raw.select(read_id(F.col("r1_name")).alias("id"), "ord", F.col("r1_seq").alias("x1"), F.col("r2_seq").alias("x2"))
    rows = own.join(source, "id", "left")
    codes = sheet.samples
    table = out.sparkSession.createDataFrame([(s.label, s.barcode1.raw, s.barcode2.raw) for s in codes], "label string, b1 string, b2 string")
    rows = rows.join(F.broadcast(table), "label", "left")  # a row for each sample
    plain = F.startswith("x1", "b1") & F.startswith("x2", "b2")
    one, two = F.when(plain, F.col("x1")).otherwise(F.col("x2")), F.when(plain, F.col("x2")).otherwise(F.col("x1"))
    cut = lambda x, b: F.substr(x, F.length(b) + 1)
    here = F.col("b1").isNotNull() & F.col("x1").isNotNull()
    fits = F.startswith(cut(one, F.col("b1")), F.col("r1_seq")) & F.startswith(cut(two, F.col("b2")), F.col("r2_seq"))
    swapped = F.startswith("x1", "b2") & F.startswith("x2", "b1")
    checks = {
        "mate_ids": F.col("id") != read_id(F.col("r2_name")),
        "not_in_input": F.col("x1").isNull(),
        "no_prefix": here & ~((plain | swapped) & fits),
    }
    path = scratch(out.sparkSession, "verify")  # two passes need the joined rows, and files are read afresh by each plan
    rows = rows.select("label", "place", "ord", *[c.alias(n) for n, c in checks.items()])
    rows.write.parquet(path)
    rows = with_last(out.sparkSession.read.schema(rows.schema).parquet(path))
    checks = {n: F.col(n) for n in checks} | {"out_of_order": F.col("ord") < F.col("last")}
    found = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    long = found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(n).alias("count")) for n in ("mate_ids", "not_in_input", "out_of_order", "no_prefix")])).alias("x")).select("x.*")
    written = out.groupBy("label").agg(F.count("*").alias("count"))
    wrong = compare_counts(counts, written).agg(F.count_if(F.col("difference") != 0).alias("count")).select(F.lit("counts").alias("problem"), "count")
    return long.unionByName(wrong)


def file_digests(spark, paths: list[str]) -> DataFrame:
    """path, records and sha256 (of the decompressed content) of FASTQ files, one task a file, streamed.

    A file whose lines are no multiple of four is an error.
    """
    import hashlib

    import pyarrow as pa

    from ..errors import FastqError
    from ..sources.fastq import content

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                sha, lines, last = hashlib.sha256(), 0, b"\n"
                for data in content(path):
                    sha.update(data)
                    lines += data.count(b"\n")
                    last = data
                lines += not last.endswith(b"\n")
                if lines % 4:
                    raise FastqError(f"{path}: {lines} lines are no multiple of 4")
                rows.append((path, lines // 4, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["path", "records", "sha256"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(run, "path string, records bigint, sha256 string")


def same_content(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """key, sha256 of a and of b, for every file that one of two runs lacks or that differs."""
    left, right = a.select(key, F.col("sha256").alias("a")), b.select(key, F.col("sha256").alias("b"))
    return left.join(right, key, "full").where(~F.col("a").eqNullSafe(F.col("b")))


def expected_counts(metrics: DataFrame, expected: dict[str, int]) -> DataFrame:
    """metric, expected and found of every gate that fails."""
    want = metrics.sparkSession.createDataFrame(list(expected.items()), "metric string, expected bigint")
    return want.join(metrics, "metric", "left").select("metric", "expected", F.col("count").alias("found")).where(~F.col("expected").eqNullSafe(F.col("found")))


def peer_sheet(df_samples: DataFrame, swapped: bool = False) -> DataFrame:
    """line: the sheet as bc1,RC(bc2):name rows for a peer tool, with rows of both barcodes exchanged if wanted."""
    from ..functions.reads import revcomp

    plain = df_samples.select(F.concat("bc1", F.lit(","), revcomp(F.col("bc2")), F.lit(":"), "name").alias("line"))
    return plain.unionByName(df_samples.select(F.concat("bc2", F.lit(","), revcomp(F.col("bc1")), F.lit(":"), "name", F.lit("_swapped")).alias("line"))) if swapped else plain
