"""The queries opN_<name> over the test tables, with production parameters and no limit, and their SQL."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table
from .line_dedup import variance

TOKENIZERS = os.path.dirname(public_tokenizers.path("piece_bpe_32k.model"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_density

    out = html_density.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "lines_total", "lines_dropped")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    out = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("bigint")
    return out.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    base = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), base)
    return warc.read_warc(spark, base, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import piece_table

    out = piece_table.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), packed=True)
    return out.select("doc_id", *piece_table.digests())


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    out = pii.spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import records

    base = scratch(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), base, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    out = records.read_records(spark, base, packed=True)
    return out.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import crf

    docs = table(spark, sf_dir, "documents")
    out = crf.score(docs, crf.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    out = license_scan.scan(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct("found.license"))
    listed = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"), (F.size(x["lacking"]) + F.size(x["extra"])).cast("string"))), ",")
    restricted = F.arrays_overlap(names, F.array(*map(F.lit, license_scan.RESTRICTED)))
    return out.select("doc_id", "n_blocks", F.array_join(names, ",").alias("licenses"), listed.alias("findings"), restricted.alias("restricted"))


_QUERIES = (op1_near_duplicates, op2_html_text, op3_line_dedup, op4_decontamination, op5_warc, op6_sentencepiece, op7_personal_data, op8_token_records, op9_quality_rules, op10_license_scan)
QUERIES = {f.__name__: f for f in _QUERIES}

_BLANKS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> ''))) AS line
  FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
found AS (
  SELECT l.source, list(line) AS boiler
  FROM (SELECT source, line, count(*) AS pages FROM lines GROUP BY source, line HAVING count(*) >= 2) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE pages - 0.08::DOUBLE * total > 0 AND (pages - 0.08::DOUBLE * total) * (pages - 0.08::DOUBLE * total) > {variance()!r}::DOUBLE * total GROUP BY l.source),
cut AS (
  SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS old,
    CASE WHEN f.boiler IS NULL THEN string_split(d.text, chr(10))
         ELSE list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(f.boiler, trim(x, {_BLANKS}))) END AS new
  FROM documents d LEFT JOIN found f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, array_to_string(new, chr(10)) AS text, coalesce(len(old), 0)::BIGINT AS lines_total, coalesce(len(old) - len(new), 0)::BIGINT AS lines_dropped FROM cut""",
    "op4_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s
  FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM dwin JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex),
b AS (SELECT hex, top, array_to_string(list_transform(string_split(hex, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM m)
SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * k + 1, 1)::INT + 8 * substr(bits, 5 * k + 2, 1)::INT + 4 * substr(bits, 5 * k + 3, 1)::INT + 2 * substr(bits, 5 * k + 4, 1)::INT + substr(bits, 5 * k + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN b USING (hex)""",
}
