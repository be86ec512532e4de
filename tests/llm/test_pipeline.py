import importlib.util
import random

import pytest

from tests.llm.conftest import DOCUMENTS, prose

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not there", allow_module_level=True)

import corpus_pipeline  # noqa: E402


def test_stages_against_what_was_planted(spark, odd, tables):
    rng = random.Random(37)
    items = [(i, prose(rng, 30, 5000)) for i in range(10)]
    para = lambda: "\n".join(prose(rng, rng.randrange(15, 30), 5000).capitalize() + "." for _ in range(5))
    clean = [(i, para(), "en", f"s{i % 3}", 7) for i in range(300)]
    junk = [(1000 + i, "\n".join(" ".join(f"{w}$$$" for w in prose(rng, 20).split()) for _ in range(5)), "en", "s0", 7) for i in range(80)]
    copies = [(2000 + i, clean[i][1] + (" changed" if i % 2 else ""), "en", "s1", 7) for i in range(40)]
    leaks = [(3000 + i, clean[200 + i][1][:200] + " " + items[i % 10][1] + "\n" + para(), "en", "s2", 7) for i in range(20)]
    menu = [(4000 + i, "Home | About | Contact\n" + para(), "en", "s0", 7) for i in range(40)]
    frame = spark.createDataFrame([*clean, *junk, *copies, *leaks, *menu], DOCUMENTS).unionByName(odd)
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, *_ in [*clean[::2], *junk[::2]]], "doc_id bigint, quality int, toxic int")
    path = tables(documents=frame, labels=labels, benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    docs, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, path).cache()
        seen[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert seen[name] <= before
        assert name == "sentencepiece" or docs.dtypes == frame.dtypes
        if name == "line dedup":
            texts = {r.doc_id: r for r in docs.collect()}
            assert seen[name] == before and not any("Home | About" in r.text for r in texts.values())
            assert texts[0].text == clean[0][1] and texts[0].n_chars == 7 and texts[4000].n_chars == len(texts[4000].text)
    good = {d for d, *_ in [*clean, *copies, *leaks, *menu]}
    assert not seen["quality rules"] & {d for d, *_ in junk} and len(good - seen["quality rules"]) <= 0.02 * len(good)
    assert seen["line dedup"] - seen["near-dedup"] == {2000 + i for i in range(40) if i in seen["line dedup"] and 2000 + i in seen["line dedup"]}
    assert seen["near-dedup"] - seen["decontamination"] == {d for d, *_ in leaks} & seen["near-dedup"]
    assert seen["sentencepiece"] == seen["decontamination"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).select("doc_id").collect()} == seen["sentencepiece"]


def test_empty_tables(spark, none, tables):
    path = tables(documents=none, labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, path).count() == 0
