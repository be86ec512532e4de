import gzip
import random

import numpy as np
import pytest

from tagloom import cli, queries
from tagloom.errors import ConfigError, DemuxError, FastqError, OutputError, SampleSheetError
from tagloom.operators import match as matching
from tagloom.operators import qc, summary, trim
from tagloom.plans.config import Barcode, Options, Sample, Sheet, Tso
from tagloom.plans.demux import demux, written
from tagloom.sources import fastq
from tagloom.sources.fastq import head, read_fastq, write_fastq
from tagloom.sources.samples import parse_sheet


def sheet(*rows):
    return Sheet(tuple(Sample(i, f"s{i}", Barcode(a), Barcode(b) if b else None) for i, (a, b) in enumerate(rows)))


def distance(seq, bc, end=False):
    if len(seq) < bc.length:
        return None
    part = seq[-bc.length :] if end else seq[: bc.length]
    return sum(b != "N" and b != s for s, b in zip(part, bc.raw))


def brute(r1, r2, sh, o):
    """(status, sample, distance, swapped) straight from the definition."""
    per = []
    for s in sh.samples:
        arms = []
        for arm, (x, y) in enumerate(((r1, r2), (r2, r1)) if r2 is not None and s.barcode2 else ((r1, r1),)):
            if r2 is not None and s.barcode2 and o.orientation != "both" and (o.orientation == "canonical") != (arm == 0):
                continue
            d1 = distance(x, s.barcode1)
            d2 = (distance(y, s.barcode2, r2 is None) if s.barcode2 else 0)
            if d1 is not None and d2 is not None:
                arms.append((d1 + d2, arm, d1 <= o.mismatches1 and d2 <= o.mismatches2))
        good = min((a[:2] for a in arms if a[2]), default=None)
        per.append((s.id, good, min((a[0] for a in arms), default=None)))
    found = sorted((g[0], i, g[1]) for i, g, _ in per if g)
    if not found:
        return "none", None, None, False
    best, sid, arm = found[0]
    if len(found) > 1 and found[1][0] == best:
        return "ambiguous", None, best, False
    rivals = [d for i, _, d in per if i != sid and d is not None]
    if o.min_delta and rivals and (min(rivals) <= best or min(rivals) - best < o.min_delta):
        return "ambiguous", None, best, False
    return "match", sid, best, arm == 1


def run_match(spark, reads, sh, o, paired):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(reads)], "ord bigint, r1_seq string" + (", r2_seq string" if paired else ""))
    return [(r.status, r.sample_id, r.distance, r.swapped) for r in matching.match(df, sh, o, paired).orderBy("ord").collect()]


CASES = [
    (Options(), True, [("ACGTACGT", "TTTTGGGG"), ("ACGTACGA", "CCCCAAAA"), ("GGGGTTTT", "ACGTACGT")]),
    (Options(mismatches1=2, mismatches2=1), True, [("ACGTACGT", "TTTTGGGG"), ("ACGTANGA", "CCNCAAAA"), ("GGGGTT", "ACGTACGTACGTACGTAC")]),
    (Options(mismatches1=3, mismatches2=3, min_delta=2), True, [("ACGTACGT", "TTTTGGGG"), ("ACGAACGA", "TTTTGGCC"), ("GGGGTTTT", "ACGTACGT")]),
    (Options(mismatches1=3, mismatches2=3, orientation="swapped"), True, [("ACGTACGT", "TTTTGGGG"), ("ACGAACGA", "TTTTGGCC")]),
    (Options(mismatches1=2, min_delta=1), True, [("ACGTA", None), ("ACCTA", None), ("NNCTAG", None)]),
    (Options(mismatches1=1, mismatches2=1), False, [("ACGT", "TTGG"), ("ACGA", "TTGC"), ("CAGT", "GGTT")]),
    (Options(mismatches1=1), False, [("ACGTACGTACGTACGTACGT", None), ("ACGTACGTACGTACGTACGA", None)]),
]


@pytest.mark.parametrize("options,paired,codes", CASES)
def test_matching_against_the_definition(spark, monkeypatch, options, paired, codes):
    rng = random.Random(41)
    sh = sheet(*codes)

    def read():
        a, b = rng.choice(codes)
        s = rng.choice([a, b or a]) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(6))) + rng.choice(["", b or ""])
        s = "".join(rng.choice("ACGTN") if rng.random() < 0.12 else c for c in s.replace("N", rng.choice("ACGT")))
        return s[: rng.randrange(3, 30)] if rng.random() < 0.2 else s

    reads = [(read(), read()) if paired else (read(),) for _ in range(250)]
    want = [brute(r[0], r[1] if paired else None, sh, options) for r in reads]
    assert run_match(spark, reads, sh, options, paired) == want
    monkeypatch.setattr(matching, "UNROLL", 0)  # the fold over an array of samples
    assert run_match(spark, reads, sh, options, paired) == want


def test_margin_truth_table(spark):
    for codes, m, delta, status in ((("AAAA", "AAAT"), 0, 0, "match"), (("AAAA", "AAAT"), 0, 1, "match"), (("AAAA", "AAAT"), 0, 2, "ambiguous"), (("AAAT", "AATA"), 1, 0, "ambiguous"), (("AAAT", "TTTT"), 1, 3, "match"), (("AAAT", "TTTT"), 1, 4, "ambiguous"), (("TTTT", "CCCC"), 1, 0, "none")):
        assert run_match(spark, [("AAAA",)], sheet(*[(c, None) for c in codes]), Options(mismatches1=m, min_delta=delta), False)[0][0] == status


def slow_quality(seq, qual, c3, c5, nextseq):
    q, n = [ord(c) - 33 for c in qual], len(qual)
    start, stop = 0, n
    if c5 and not nextseq:
        s = top = 0
        for i in range(n):
            s += c5 - q[i]
            if s < 0:
                break
            if s > top:
                top, start = s, i + 1
    if c3 or nextseq:
        s = top = 0
        for i in range(n - 1, -1, -1):
            s += 1 if nextseq and seq[i] == "G" else c3 - q[i]
            if s < 0:
                break
            if s > top:
                top, stop = s, i
    return (0, 0) if start >= stop else (start, stop)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row


def slow_adapter(read, adapter, overlap, rate):
    n, m = len(read), len(adapter)
    allowed, found = trim.allowed_errors(m, rate), []
    for k in range(max(0, max(0, n - (m + 8)) - m), n):
        length = min(n - k, m)
        if length < overlap:
            continue
        wrong = sum(a != b for a, b in zip(read[k:], adapter))
        if wrong <= allowed[length]:
            found.append((-length, wrong, k))
            continue
        errors, j = min((d, j) for j, d in enumerate(edits(read[k : k + length], adapter[:length])) if j >= overlap)
        if errors <= allowed[j]:
            found.append((-j, errors, k))
    return min(found)[2] if found else -1


def test_trimming_against_the_loops():
    rng = random.Random(43)
    reads = []
    for i in range(1500):
        a = list("AGATCGGAAGAGCACACGTCTGAA")
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(a))
            a[at : at + rng.randrange(2)] = rng.choice("ACGT") * rng.randrange(2)
        reads.append(("".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 40))) + "".join(a)[: rng.randrange(0, 26)] + rng.choice(["", "", "GGGGG", "ACG"]))[: rng.randrange(70)])
    quals = ["".join(chr(33 + rng.randrange(41)) for _ in r) for r in reads]
    for c3, c5, nextseq in ((20, 0, False), (0, 15, False), (25, 25, False), (20, 9, True), (0, 0, True), (0, 0, False)):
        out = trim.trim_batch(reads, quals, c3, c5, nextseq, None, 3, 0.1)
        assert list(zip(out["start"].tolist(), out["stop"].tolist())) == [slow_quality(s, q, c3, c5, nextseq) for s, q in zip(reads, quals)]
    for overlap, rate in ((3, 0.1), (1, 0.2), (5, 0.0), (3, 0.3)):
        s, n = trim.matrix([r.encode() for r in reads])
        assert trim.adapter_starts(s, n, "AGATCGGAAGAGCACACGTCTGAA", overlap, rate).tolist() == [slow_adapter(r, "AGATCGGAAGAGCACACGTCTGAA", overlap, rate) for r in reads]
    assert trim.trim_batch([], [], 20, 0, False, "ACGT", 3, 0.1)["start"].size == 0
    assert np.array(trim.allowed_errors(24, 0.1))[[9, 10, 19, 20]].tolist() == [0, 1, 1, 2]


def test_sheet_rules():
    good = parse_sheet("﻿Sample Name, BC-1 ,i5,extra\n a ,acgt, ttga,x\nb,ACGA,TTGC\n")
    assert [(s.name, s.barcode1.raw, s.barcode2.raw) for s in good.samples] == [("a", "ACGT", "TTGA"), ("b", "ACGA", "TTGC")] and good.mode == "dual"
    assert parse_sheet("sample,barcode1,barcode2\na,AC,\nb,AG,\n").mode == "single"
    for bad in ("", "x,y\n1,2", "sample,barcode1\n,AC", "sample,barcode1\na,AC\na,AG", "sample,barcode1\nUnassigned,AC", "sample,barcode1\na b,AC\na_b,AG", "sample,barcode1\na,", "sample,barcode1\na,AXC", "sample,barcode1\na,NNN", "sample,barcode1\na,AC\nb,AC", "sample,barcode1\n", "sample,barcode1,barcode2\na,AC,GG\nb,AG,"):
        with pytest.raises(SampleSheetError):
            parse_sheet(bad)
    with pytest.raises(SampleSheetError):
        parse_sheet("sample,barcode1\na,ANC", 3)


def test_option_bounds():
    for bad in ({"error_rate": -0.1}, {"error_rate": float("nan")}, {"min_overlap": 0}, {"quality_cutoff3": 256}, {"min_delta": -1}):
        with pytest.raises(ConfigError):
            Options(**bad)
    with pytest.raises(ConfigError):
        Tso("NX")
    assert Options(adapter_r1="  ").adapter_r1 is None and Tso(" nni ").umi == [0, 1]


def write(path, rows, gz=False):
    data = "".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows).encode()
    path.write_bytes(gzip.compress(data) if gz else data)
    return str(path)


def run_cli(spark, *args):
    return cli.run_demux(cli.parser().parse_args(["demux", *map(str, args)]), spark)


def test_demux_end_to_end(spark, tmp_path):
    codes = [("AAGTCCAA", "GGAGTACT"), ("GACCTGAA", "GGACTTGG")]
    book = tmp_path / "s.csv"
    book.write_text("SampleNumber,Barcode1,Barcode2\n" + "".join(f"s{i},{a},{b}\n" for i, (a, b) in enumerate(codes)))
    (a1, b1), (a2, b2) = codes
    insert = "ACGTTGCATT"
    mates = [(a1 + insert, b1 + insert), (b2 + insert, a2 + insert), ("T" * 18, "C" * 18), (a1 + "ACG", b1 + insert), ("A", "C")]
    r1 = write(tmp_path / "r1.fastq.gz", [(f"r{i}/1", x.lower() if i == 0 else x, "I" * len(x)) for i, (x, _) in enumerate(mates)], True)
    r2 = write(tmp_path / "r2.fastq", [(f"r{i}/2", y, "I" * len(y)) for i, (_, y) in enumerate(mates)])
    out = tmp_path / "out"
    text = run_cli(spark, "-i", r1, "-I", r2, "-b", book, "-o", out, "-p", "run", "-l", 5, "--no-adapter")
    rows = dict(line.split("\t") for line in text.splitlines())
    assert rows["total_reads"] == "5" and rows["assigned"] == "2" and rows["too_short"] == "2" and rows["orientation_swapped"] == "1" and rows["match_rate"] == "0.400000" and rows["sample:s0"] == "1"
    assert gzip.decompress((out / "run_s1_R1.fastq.gz").read_bytes()).decode() == f"@r1/2\n{insert}\n+\n{'I' * 10}\n"
    assert gzip.decompress((out / "run_s0_R1.fastq.gz").read_bytes()).decode().startswith("@r0/1\n" + insert)
    assert sorted(p.name for p in out.iterdir()) == sorted([f"run_{s}_{m}.fastq.gz" for s in ("s0", "s1", "unassigned") for m in ("R1", "R2")] + ["run.summary.tsv"])
    assert text == (out / "run.summary.tsv").read_text()
    with pytest.raises(OutputError):
        run_cli(spark, "-i", r1, "-I", r2, "-b", book, "-o", out, "-p", "run")
    again = run_cli(spark, "-i", r1, "-I", r2, "-b", book, "-o", out, "-p", "run", "--force", "--counts-only", "--skip-reads", 1, "--max-reads", 2)
    assert dict(line.split("\t") for line in again.splitlines())["total_reads"] == "2"
    with pytest.raises(ConfigError):
        run_cli(spark, "-i", r1, "-I", r1, "-b", book)
    check = cli.run_validate(cli.parser().parse_args(["validate", "-i", r1, "-I", r2]), spark)
    assert check.splitlines()[0] == "records\t5" and "min_length\t1" in check and "paired\ttrue" in check


def test_single_end_umi_and_tso(spark, tmp_path):
    sh = Sheet((Sample(0, "a", Barcode("ANCG"), Barcode("TTN")),))
    reads = [(0, "x y", "ATCG" + "GGCCAATTGG" + "TTA", "I" * 17), (1, "z", "GGGGGG", "I" * 6)]
    df = spark.createDataFrame(reads, "ord bigint, r1_name string, r1_seq string, r1_qual string")
    out = demux(df, sh, Options(adapter_r1=None, tso=Tso("NNI")), False).orderBy("ord").collect()
    assert (out[0].umi, out[0].r1_name, out[0].r1_seq) == ("TA", "x_yrbc:GGTA", "CAATTGG")
    assert (out[1].status, out[1].r1_name, out[1].r1_seq) == ("none", "zrbc:GG", "GGG")


def test_bad_inputs(spark, tmp_path):
    one = write(tmp_path / "a.fastq", [("r1/1", "ACGT", "IIII"), ("r2/1", "ACGT", "IIII")])
    for name, rows in (("b", [("r1/2", "AC", "II")]), ("c", [("r1/2", "AC", "II"), ("zz/2", "AC", "II")])):
        with pytest.raises(Exception, match="PairError"):
            fastq.read_fastq(spark, one, write(tmp_path / name, rows)).collect()
    with pytest.raises(Exception, match="FastqError"):
        fastq.read_fastq(spark, write(tmp_path / "d", [("r", "ACG", "II")])).collect()
    assert fastq.read_fastq(spark, write(tmp_path / "e", [])).count() == 0
    with pytest.raises(DemuxError):
        fastq.check_prefix("a/b")


def test_summary_invariants_and_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from tagloom import streaming

    path = "/root/testdata/sf0.001"
    sh, p = queries.sheet(spark, path), queries.pairs(spark, path)
    o = queries.FULL.but(mismatches1=4, mismatches2=4)
    plan = demux(p, sh, o, True).cache()
    rows = {r.metric: r["count"] for r in summary.metrics(plan, True).collect()}
    assert rows["total_reads"] == rows["matched_before_filter"] + rows["no_match_before_filter"] + rows["ambiguous"] == rows["assigned"] + rows["unassigned"] + rows["too_short"]
    assert sum(c for m, c in rows.items() if m.startswith("sample:")) == rows["assigned"] and rows["orientation_canonical"] + rows["orientation_swapped"] == rows["matched_before_filter"]
    assert rows["ambiguous_after_filter"] <= rows["unassigned"] and rows["ambiguous"] > 0 and rows["adapter_trimmed"] > 0 and rows["quality_trimmed"] > 0
    assert written(plan, o).count() == rows["total_reads"] - rows["too_short"]
    p.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    q = streaming.running_counts(streaming.demux_stream(stream, sh, o, True)).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").where("status = 'match'").agg(F.sum("count")).first()[0] == rows["assigned"]


def test_import_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tagloom", tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'match_mm1_pe' in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_sink_joins_segments_of_many_tasks_in_order(spark, tmp_path):
    rows = [(i, "a" if i % 3 else "b", f"read{i}", "ACGT" * (i % 5 + 1), "IIII" * (i % 5 + 1)) for i in range(500)]
    df = spark.createDataFrame(rows, "ord bigint, label string, r1_name string, r1_seq string, r1_qual string").repartition(9).orderBy("ord")
    write_fastq(df, str(tmp_path), "run", False)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["run_a.fastq.gz", "run_b.fastq.gz"]
    for label in "ab":
        names = [r.r1_name for r in read_fastq(spark, str(tmp_path / f"run_{label}.fastq.gz")).orderBy("ord").collect()]
        assert names == [n for _, x, n, *_ in rows if x == label]
    write_fastq(df.limit(0), str(tmp_path / "none"), "run", False)
    assert not (tmp_path / "none").exists() or not [p for p in (tmp_path / "none").iterdir() if p.suffix == ".gz"]


def test_file_digests_count_records_and_refuse_broken_files(spark, tmp_path):
    import gzip
    import hashlib

    text = "".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(7)).encode()
    (tmp_path / "a.fastq").write_bytes(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text[:40]) + gzip.compress(text[40:]))
    (tmp_path / "c.fastq").write_bytes(text + b"@r8\nAC")
    (tmp_path / "d.fastq").write_bytes(b"")
    got = {r.path[-10:].split("/")[-1]: (r.records, r.sha256) for r in qc.file_digests(spark, [str(tmp_path / n) for n in ("a.fastq", "b.fastq.gz", "d.fastq")]).collect()}
    want = hashlib.sha256(text).hexdigest()
    assert got == {"a.fastq": (7, want), "b.fastq.gz": (7, want), "d.fastq": (0, hashlib.sha256(b"").hexdigest())}
    with pytest.raises(Exception, match="no multiple of 4"):
        qc.file_digests(spark, [str(tmp_path / "c.fastq")]).collect()
    one, two = (spark.createDataFrame(x, "path string, sha256 string") for x in ([("a", "1"), ("b", "2")], [("a", "1"), ("b", "3"), ("c", "4")]))
    assert sorted(map(tuple, qc.same_content(one, two).collect())) == [("b", "2", "3"), ("c", None, "4")]


def test_head_of_a_short_input_is_an_error(spark, tmp_path):
    for m in "12":
        (tmp_path / f"r{m}.fastq").write_text("".join(f"@r{i}/{m}\nACGT\n+\nIIII\n" for i in range(5)))
    paths = [str(tmp_path / x) for x in ("r1.fastq", "r2.fastq", "o1.fastq.gz", "o2.fastq.gz")]
    with pytest.raises(FastqError, match="after 5 pairs"):
        head(spark, *paths, 6)
    assert not (tmp_path / "o1.fastq.gz").exists()
    head(spark, *paths, 3)
    assert [r.r1_name for r in read_fastq(spark, *paths[2:]).orderBy("ord").collect()] == ["r0/1", "r1/1", "r2/1"]


def test_representative_samples(spark):
    picks = lambda rows: {r.which: r.label for r in qc.representative_samples(spark.createDataFrame(rows, "label string, count bigint")).collect()}
    assert picks([("a", 5), ("b", 1), ("c", 9), ("d", 7), ("z", 0)]) == {"min": "b", "median": "d", "max": "c"}
    assert picks([("a", 5), ("b", 1), ("c", 9)]) == {"min": "b", "median": "a", "max": "c"}
    assert picks([("a", 5), ("z", 0)]) == {"min": "a"} and picks([("z", 0)]) == {} and picks([("b", 2), ("a", 2)]) == {"min": "a", "median": "b"}


def test_human_summary():
    rows = {m: 0 for m in (*summary.HEAD, *summary.TAIL)} | {"total_reads": 1_234_567, "assigned": 1_000_000, "unassigned": 234_567, "orientation_canonical": 10}
    text = "metric\tcount\n" + "".join(f"{m}\t{c}\n" for m, c in rows.items()) + "match_rate\t0.81\nsample:s1\t999999\nsample:s2\t1\n"
    lines = [line.split() for line in summary.human(text).splitlines()]
    assert ["reads", "1,234,567"] in lines and ["assigned", "1,000,000", "81.00", "%"] in lines and ["s1", "999,999"] in lines and ["mates", "in", "order", "10", "0.00", "%"] in lines
    none = "metric\tcount\n" + "".join(f"{m}\t0\n" for m in rows)
    assert "sample" not in summary.human(none) and "mates" not in summary.human(none)


def test_reader_by_arrow_against_the_plain_loop(tmp_path):
    rng = random.Random(9)
    rows = [(f"read{i} x:{i}" + ("/1" if i % 2 else ""), "".join(rng.choice("ACGTn") for _ in range(rng.randrange(0, 90)))) for i in range(3000)]
    text = "".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in rows).encode()
    cases = {"plain": text, "crlf": text.replace(b"\n", b"\r\n"), "no_end": text[:-1], "cut": text[:70_000], "bytes": text.replace(b"read777 ", b"read\xe9 "), "empty": b"", "blank": b"\n\n@a\nA\n+\nI\n\n\n@b\nC\n+\nI\n\n", "wrong": text[: text.index(b"@read90 ")] + b"@x\nAC\n+\nI\n" + text, "lines": text[: text.index(b"@read90 ")] + b"@x\nAC\nAC\nII\n" + text}

    def told(rows):
        got = []
        try:
            for r in rows:
                got.append(r)
        except FastqError as e:
            got.append(str(e))
        return got

    for name, data in cases.items():
        path = tmp_path / name
        path.write_bytes(gzip.compress(data) if name == "crlf" else data)
        want = told(fastq.records(str(path)))
        for size in (1 << 22, 997, 30_000):
            got = told(tuple(r) for b in fastq.arrays(str(path), size) for r in zip(*(c.to_pylist() for c in b)))
            # Rows come in batches, so an error may stand before some rows that precede it in the file.
            assert got == want if not isinstance(want[-1:][0] if want else None, str) else got[-1] == want[-1] and got[:-1] == want[: len(got) - 1], (name, size)
    ids = ["a/1", "a b/1", "a\tb", "a/2 c", "/1", "", "x/3"]
    assert fastq.plain_ids(__import__("pyarrow").array(ids)).to_pylist() == [fastq.plain_id(x) for x in ids]


def test_order_of_output_by_stretches_against_the_loop(spark, monkeypatch):
    from pyspark.sql import functions as F

    late = lambda df: qc.with_last(df).agg(F.count_if(F.col("ord") < F.col("last"))).first()[0]
    rng = random.Random(17)
    rows = [(rng.choice(["a", "a", "a", "b", "", None]), place + k * fastq.FILE_STEP, None if rng.random() < 0.1 else place * 3 + rng.choice([0, 0, 0, -40, 400])) for k in (-1, 0, 2) for place in range(300)]
    rng.shuffle(rows)
    last, want = {}, 0
    for label, _, ord_ in sorted(rows, key=lambda r: r[1]):
        if ord_ is not None:
            want += ord_ < last.get(label, ord_)
            last[label] = max(ord_, last.get(label, ord_))
    df = spark.createDataFrame(rows, "label string, place bigint, ord bigint")
    for stretch in (0, 3, 16):
        monkeypatch.setattr(qc, "STRETCH", stretch)
        assert late(df) == want > 100
    assert late(df.limit(0)) == 0


def test_no_task_of_the_output_checks_takes_a_whole_label(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(qc, "STRETCH", 8, raising=False)
    n, sc = 20_000, spark.sparkContext
    raw = spark.range(n).select(F.col("id").alias("ord"), *[x for m in "12" for x in (F.concat(F.lit("r"), "id", F.lit(f"/{m}")).alias(f"r{m}_name"), F.lit("ACGTTGCA").alias(f"r{m}_seq"))])
    # Every 50th pair stands 1,000 places later than it should, so that it follows later ones.
    out = raw.select(F.when(F.col("ord") % 50 == 0, F.col("ord") * 2 + 2_001).otherwise(F.col("ord") * 2).alias("place"), F.lit("unassigned").alias("label"), "r1_name", "r1_seq", "r2_name", "r2_seq")
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("output checks", "")
        counts = spark.createDataFrame([("unassigned", n)], "label string, count bigint")
        got = {r.problem: r["count"] for r in qc.verify_output(raw, out, sheet(("ACGTACGT", "TTTTGGGG")), counts).collect()}
    finally:
        sc._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {"mate_ids": 0, "not_in_input": 0, "out_of_order": n // 50, "no_prefix": 0, "counts": 0}
    tracker, store, most = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for stage in {s for j in tracker.getJobIdsForGroup("output checks") for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 1000)
        for i in range(tasks.size()):
            if (metrics := tasks.apply(i).taskMetrics()).isDefined():
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    assert n // 16 < most < n // 3  # of a side of the join, a 16th each
