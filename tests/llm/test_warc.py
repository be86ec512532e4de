import base64
import collections
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import queries, warc

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    rows = [(i, f"http://h/{i} x\r\n", f"<p>{'é' * (i % 7)}{'same' if i % 3 else i}</p>") for i in range(200)]
    rows += [(300, None, None), (301, "u", ""), (5, "again", "<p>ééééésame</p>"), (5, "other", "<p>new</p>"), (None, "no id", "<p>same</p>"), (None, None, None), (400, "long", "x" * 300_000)]
    return spark.createDataFrame(rows, PAGES)


def test_query_against_brute_force(spark, tables):
    df = pages(spark)
    out = queries.op5_warc(spark, tables(pages=df))
    data = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    last = {}
    for page, body in data:
        low = page if page is not None else warc.NO_ID
        last[body] = max(low, last.get(body, low))
    want, seen = collections.Counter(), set()
    for page, body in sorted(data, key=lambda x: x[0] is not None):
        response = (page if page is not None else warc.NO_ID) == last[body] and body not in seen
        if response:
            seen.add(body)
        refers = None if response or last[body] == warc.NO_ID else last[body]
        want[page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", refers] += 1
    assert collections.Counter(tuple(r) for r in out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == want


def test_files_are_deterministic_rolled_and_committed(spark, tmp_path):
    df = pages(spark)
    first = warc.write_warc(df, f"file://{tmp_path}/a", file_bytes=3000).collect()
    second = warc.write_warc(df.repartition(7).withColumn("id", F.lit(1)).withColumn("kind", F.lit("x")), f"file://{tmp_path}/b", file_bytes=3000)
    whole = lambda d, rows: b"".join(gzip.decompress((tmp_path / d / r.path).read_bytes()) for r in sorted(rows, key=lambda r: (r.partition, r.seq)))
    assert whole("a", first) == whole("b", second.collect()) and len(first) > 1
    assert not (tmp_path / "a/temp").exists() and {p.name for p in (tmp_path / "a").glob("*.warc.gz")} == {r.path for r in first}
    back = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/a").where("record_type = 'response'").collect()}
    assert back[400].payload == b"x" * 300_000 and back[400].url == "long" and back[199].url == "http://h/199%20x%0D%0A"


def test_small_payloads_empty_table_and_damage(spark, tmp_path):
    df = pages(spark)
    warc.write_warc(df, f"file://{tmp_path}/m", min_bytes=1 << 20)
    assert warc.read_warc(spark, f"file://{tmp_path}/m").where("record_type = 'revisit'").count() == 0
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    data = warc.record(1, "u", b"body", None, "1970-01-01T00:00:00Z")
    assert warc.parse(data)[3] == b"body"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"body", b"b0dy"))


def test_file_names_and_digests_depend_on_the_rows_alone(spark, tmp_path):
    rows = [(i % 700 if i % 5 else None, f"http://h/{i % 11}", f"<p>{'y' * (i % 90)}{i % 300}</p>") for i in range(1500)]
    df, seen, partitions = spark.createDataFrame(rows, PAGES), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, part, n in (("a", df, partitions), ("b", df, partitions), ("c", df.orderBy(F.rand(1)).repartition(5), partitions), ("d", df.repartition(3), "3"), ("e", df, "17")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            manifest = warc.write_warc(part, f"file://{tmp_path}/{name}", file_bytes=20_000, range_bytes=90_000)
            seen.append(sorted((r.path, r.records, r.bytes, r.sha256) for r in manifest.collect()))
            for path, _, size, digest in seen[-1]:
                data = (tmp_path / name / path).read_bytes()
                assert len(data) == size and hashlib.sha256(data).hexdigest() == digest
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert all(s == seen[0] for s in seen) and len({p.split("-")[1] for p, *_ in seen[0]}) > 4 and sum(r for _, r, *_ in seen[0]) == 1500
