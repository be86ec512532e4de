import collections
import hashlib
import importlib.util
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import piece_table, queries, records

PIECES, WORDS = f"{queries.TOKENIZERS}/piece_bpe_32k.model", f"{queries.TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


TEXTS = st.text(st.sampled_from(list("ab eéÉ▁ \n\t.,'sİ<|>😀　你1")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_chunks_join_to_the_library_result(text):
    table = piece_table.ChunkTable(PIECES)
    chunks = table.chunks(text)
    table.learn(chunks)
    ids = table.sp.encode(text)
    assert np.frombuffer(b"".join(table.ids[c] for c in chunks), "<i4").tolist() == ids
    assert "".join(table.words[c] for c in chunks)[1:] == table.sp.decode(ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_join_to_the_library_result(text):
    encoder = records.WordEncoder.of(WORDS)
    assert encoder.by_word
    assert np.frombuffer(encoder.ids([text])[0], "<u2").tolist() == encoder.lib.encode(text, add_special_tokens=False).ids


def test_sentencepiece_query_against_the_library(spark, odd, tables, sp):
    out = queries.op6_sentencepiece(spark, tables(documents=odd))
    got = collections.Counter(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want = collections.Counter()
    for r in odd.collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert got == want


def test_sentencepiece_empty_and_clashing_columns(spark, none, odd):
    assert piece_table.encode(none, PIECES).count() == 0
    clash = odd.withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x")).withColumn("id", F.lit(2))
    out = piece_table.encode(clash, PIECES, ends=False)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.where("doc_id = 4").count() == 2


def test_record_query_against_the_library(spark, odd, tables, lib):
    out = queries.op8_token_records(spark, tables(documents=odd))
    got = collections.Counter(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = collections.Counter(), 0
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want[r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
        start += len(ids)
    assert got == want


def test_records_roll_index_and_empty(spark, odd, none, tmp_path):
    base = f"file://{tmp_path}/r"
    manifest = records.write_records(odd, base, WORDS, file_bytes=1000)
    names = {r.path: r for r in manifest.collect()}
    assert sum(n.endswith(".rec") for n in names) > 1 and not (tmp_path / "r/temp").exists()
    for name, row in names.items():
        data = (tmp_path / "r" / name).read_bytes()
        assert hashlib.sha256(data).hexdigest() == row.sha256 and len(data) == row.bytes
        if name.endswith(".idx"):
            body = (tmp_path / "r" / name.replace(".idx", ".rec")).read_bytes()
            at = struct.unpack(f"<{len(data) // 8}Q", data)
            assert all(next(records.unframe(__import__("io").BytesIO(body[a:]))) for a in at)
    records.write_records(none, f"file://{tmp_path}/e", WORDS)
    assert records.read_records(spark, f"file://{tmp_path}/e").count() == 0


def test_checksums_and_damage():
    import io

    assert records.crc32c(b"123456789") == 0xE3069283 and records.crc32c(b"") == 0
    assert records.crc32c(bytes(32)) == 0x8A9136AA and records.crc32c(b"\xff" * 32) == 0x62A8AB43

    def slow(data, crc=0xFFFFFFFF):
        for b in data:
            crc = (crc >> 8) ^ int(records._T0[(crc ^ b) & 255])
        return crc ^ 0xFFFFFFFF

    for n in (1, 3, 4, 511, 512, 513, 5000):
        data = bytes(i * 7 & 255 for i in range(n))
        assert records.crc32c(data) == slow(data)
    whole = records.frame(b"payload")
    assert list(records.unframe(io.BytesIO(whole))) == [b"payload"]
    for bad in (whole[:-1], whole[:14] + b"X" + whole[15:], b"\x01" + whole[1:]):
        with pytest.raises(ValueError):
            list(records.unframe(io.BytesIO(bad)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdefghijklmnopqrstuvwxyzßàéîõüÿø÷æ.,")), min_size=1, max_size=25))
def test_plain_words_match_the_library(word):
    encoder = records.WordEncoder.of(WORDS)
    assert encoder.direct
    found = encoder.plain(word)
    assert found is None or found == encoder.lib.encode(word, add_special_tokens=False).ids


#: Letters with marks that compose with a small letter only, marks in any order, Hangul letters and syllables, title-case letters.
COMPOSING = st.text(st.sampled_from(list("abYHTWJEO \n.,'sé") + [chr(c) for c in (0x30A, 0x331, 0x308, 0x30C, 0x301, 0x300, 0x338, 0x323, 0x344, 0x345, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x1C5, 0x1C8, 0x1F2, 0x178, 0x130, 0x131, 0x17F, 0x3A3, 0x3C2, 0x212B, 0xFB01, 0xAD, 0xF71)]), max_size=30)


@settings(max_examples=2000, deadline=None)
@given(COMPOSING)
def test_composing_marks_join_to_the_library_result(text):
    encoder = records.WordEncoder.of(WORDS)
    assert np.frombuffer(encoder.ids([text])[0], "<u2").tolist() == encoder.lib.encode(text, add_special_tokens=False).ids


def test_letters_whose_capital_has_no_composed_form():
    encoder = records.WordEncoder.of(WORDS)
    texts = [a + m for a in "YHTWJ" for m in "\u030a\u0331\u0308\u030c"]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.ids(texts)] == [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_depend_on_the_rows_alone(spark, tmp_path):
    rng = __import__("random").Random(3)
    df = spark.createDataFrame([(rng.randrange(900) if i % 5 else None, f"text {'x' * rng.randrange(60)} {i % 211}") for i in range(1500)], "doc_id bigint, text string")
    seen, partitions = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for name, rows, n in (("a", df, partitions), ("b", df, partitions), ("c", df.orderBy(F.rand(1)).repartition(5), partitions), ("d", df.repartition(3), "3"), ("e", df, "17")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            manifest = records.write_records(rows, f"file://{tmp_path}/{name}", WORDS, file_bytes=4000, range_bytes=9000)
            seen.append(sorted((r.path, r.records, r.bytes, r.sha256) for r in manifest.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert all(s == seen[0] for s in seen) and len({p.split("-")[1] for p, *_ in seen[0]}) > 4 and len(seen[0]) > 20


def test_shuffled_reads_follow_the_index(spark, odd, none, tmp_path):
    base = f"file://{tmp_path}/s"
    records.write_records(odd, base, WORDS, file_bytes=500)
    plain = collections.Counter((r.doc_id, tuple(r.ids)) for r in records.read_records(spark, base).collect())
    one, two = ([(r.place, r.doc_id, tuple(r.ids)) for r in records.read_shuffled(spark, base, seed, open_files=2).collect()] for seed in (0, 1))
    assert [p for p, *_ in one] == sorted(p for p, *_ in one) and [d for _, *d in one] != [d for _, *d in two]
    assert collections.Counter((d, i) for _, d, i in one) == collections.Counter((d, i) for _, d, i in two) == plain
    records.write_records(none, f"file://{tmp_path}/n", WORDS)
    assert records.read_shuffled(spark, f"file://{tmp_path}/n").count() == 0


#: Words with marks at their end, before and inside, contractions, marks of special tokens and letters beyond the plain ones.
TAILED = st.lists(st.sampled_from([*"abstremß éÑ1 \n$#*!.,?_-/'<|>=~&%\\`^\u0338\u0301", "'s", "'re", "<|", "$$$", "...", ". ", " the"]), max_size=30).map("".join)


@settings(max_examples=1500, deadline=None)
@given(TAILED)
def test_words_with_marks_join_to_the_library_result(text):
    encoder = records.WordEncoder.of(WORDS)
    assert encoder.tails
    assert np.frombuffer(encoder.ids([text])[0], "<u2").tolist() == encoder.lib.encode(text, add_special_tokens=False).ids


def test_words_with_marks_share_an_entry():
    encoder = records.WordEncoder(WORDS)
    texts = ["stretta stretta. stretta$$$ Stretta,### stretta'", "it's don't. x$$$ $$$"]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.ids(texts)]
    assert got == [encoder.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(encoder.table) == {"stretta", ".", "$$$", ",###", "stretta'", "it's", "don't.", "x"}


def test_packed_reads_hold_the_same_ids_in_fewer_tasks(spark, odd, none, tmp_path):
    from tagloom.llm.digests import id_digests

    base = f"file://{tmp_path}/p"
    manifest = records.write_records(odd.unionByName(spark.range(600).selectExpr("id + 1000 AS doc_id", "concat('text ', id) AS text"), allowMissingColumns=True), base, WORDS, file_bytes=30)
    files = manifest.where("path LIKE '%.rec'").count()
    packed, plain = records.read_records(spark, base, packed=True), records.read_records(spark, base)
    assert dict(packed.dtypes)["ids"] == "binary" and dict(plain.dtypes)["ids"] == "array<int>"
    assert packed.rdd.getNumPartitions() == plain.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism < files
    want = id_digests(plain.withColumn("n", F.size("ids")), "ids", crc32="crc")
    got = packed.select("doc_id", "start", (F.octet_length("ids") / 4).cast("int").alias("n"), F.crc32("ids").alias("crc"))
    assert got.count() == 600 + odd.count() and collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    records.write_records(odd.where("text IS NULL"), f"file://{tmp_path}/q", WORDS, end_id=None)
    assert {bytes(r.ids) for r in records.read_records(spark, f"file://{tmp_path}/q", packed=True).collect()} == {b""}
    records.write_records(none, f"file://{tmp_path}/e", WORDS)
    assert records.read_records(spark, f"file://{tmp_path}/e", packed=True).count() == 0


def test_a_full_table_keeps_the_words_met_again(lib, monkeypatch):
    monkeypatch.setattr(records, "TABLE_WORDS", 80)
    encoder, lacked, learn = records.WordEncoder(WORDS), collections.Counter(), records.WordEncoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (lacked.update(new), learn(encoder, new))[1])
    once = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(900)]
    texts = [" ".join(["frequent", "words.", "Éclair!!", *once[i : i + 9]]) for i in range(0, 900, 9)]
    for text in texts:
        assert np.frombuffer(encoder.ids([text])[0], "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(encoder.table) <= 80 + 13
    assert lacked["frequent"] == 1 and lacked[once[0]] == 1


def test_sizes_share_the_checksum_of_their_bytes():
    sizes = [0, 1, 9, 512, 65535, 1 << 32, (1 << 64) - 1]
    assert records._crc32c_sizes(np.array(sizes, np.uint64)) == [records.crc32c(struct.pack("<Q", n)) for n in sizes]


def test_packed_ids_hold_the_same_ids_and_take_one_worker(spark, odd, none, tables):
    from tagloom.llm.digests import id_digests

    packed, plain = piece_table.encode(odd, PIECES, packed=True), piece_table.encode(odd, PIECES)
    assert dict(packed.dtypes)["ids"] == "binary" and dict(plain.dtypes)["ids"] == "array<int>"
    want = id_digests(plain.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")), "ids", sha256="ids_sha256")
    got = packed.select("doc_id", *piece_table.digests())
    assert got.dtypes == want.dtypes and collections.Counter(map(tuple, got.collect())) == collections.Counter(map(tuple, want.collect()))
    assert {bytes(r.ids) for r in piece_table.encode(odd.where("text IS NULL"), PIECES, ends=False, packed=True).collect()} == {b""}
    assert piece_table.encode(none, PIECES, packed=True).count() == 0
    stages = [queries.op6_sentencepiece(spark, tables(documents=odd))]
    if importlib.util.find_spec("corpus_pipeline"):
        import corpus_pipeline

        stages.append(corpus_pipeline.encode(spark, odd, ""))
    for out in stages:
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_chunks_that_decode_to_themselves_hold_no_string(sp, odd, monkeypatch):
    table = piece_table.ChunkTable(PIECES)
    table.encode(["plain words  in a text.", None, ""])
    assert len(table.ids) == 5 and not table.words
    texts = [r.text or "" for r in odd.collect()]
    for limit in (piece_table.TABLE_BYTES, 0):
        monkeypatch.setattr(piece_table, "TABLE_BYTES", limit)
        for part in ([t] for t in texts):
            ids, decoded = table.encode(part)
            assert [np.frombuffer(x, "<i4").tolist() for x in ids] == [sp.encode(t) for t in part]
            assert decoded == [sp.decode(sp.encode(t)) for t in part]
