import collections
import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import common, minhash, queries
from tagloom.llm.common import without
from tagloom.llm.components import components
from tests.llm.conftest import DOCUMENTS, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, k, percent=80):
    """n and component of each row; rows of one id and one text are one document."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
            root[find(j)] = find(i)
    low = collections.defaultdict(list)
    for i in range(len(rows)):
        low[find(i)].append(rows[i][0])
    out = collections.Counter()
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(low[find(i)])
        out[d, len(sets[i]), c, d is None or d == c] += 1
    return out


def corpus(rng):
    """Texts alone; groups of exact copies; a chain in which only neighbours are alike; a large group of near copies; a passage that many share."""
    docs = [prose(rng, rng.randrange(5, 80)) for _ in range(60)]
    same = prose(rng, 40)
    docs += [same] * 25 + [same.upper(), same.replace(" ", "\n\t")]
    chain = prose(rng, 90, 5000).split()
    for _ in range(12):
        docs.append(" ".join(chain))
        for _ in range(3):
            chain[rng.randrange(len(chain))] = f"n{rng.randrange(10**6)}"
    base = prose(rng, 120, 5000).split()
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"m{rng.randrange(10**6)}"
        docs.append(" ".join(own))
    passage = prose(rng, 60, 5000)
    docs += [f"{passage} {prose(rng, 30, 9000)}" for _ in range(80)]
    rng.shuffle(docs)
    return docs


def test_query_against_brute_force(spark, odd, tables):
    rng = random.Random(17)
    frame = spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(corpus(rng))], DOCUMENTS).unionByName(odd)
    out = queries.op1_near_duplicates(spark, tables(documents=frame))
    want = brute([(r.doc_id, r.text) for r in frame.collect()], 2)
    assert collections.Counter(tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()) == want


def test_five_word_shingles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "MEMBERS", 4)
    rng = random.Random(19)
    rows = [(i, t) for i, t in enumerate(corpus(rng))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit("x")))
    assert collections.Counter(tuple(r) for r in out.collect()) == brute(rows, 5)


def test_empty(spark, none):
    assert minhash.near_duplicates(none).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(23)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    low = {x: x for p in links for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: low[x] for x in touched}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bounds_lose_few_pairs_at_the_threshold():
    rng = np.random.default_rng(29)
    bounds = minhash.Bounds(minhash.LENGTH, 0.8, minhash.MISS)
    packed = lambda x: x[:, ::2] | x[:, 1::2] << 4
    left = rng.integers(0, 16, (4000, minhash.LENGTH)).astype(np.uint8)
    at = np.arange(4000)
    for s, low, high in ((0.8, 0.97, 1.0), (0.9, 1.0, 1.0), (0.6, 0.0, 0.0)):
        right = np.where(rng.random(left.shape) < s, left, rng.integers(0, 16, left.shape).astype(np.uint8))
        assert low <= len(bounds.survivors(packed(left), packed(right), at, at)) / 4000 <= high


def test_bounds_lose_no_pair_of_many_at_the_threshold():
    rng = np.random.default_rng(37)
    bounds, at = minhash.Bounds(minhash.LENGTH, 0.8, minhash.MISS), np.arange(4000)
    left = rng.integers(0, 16, (4000, minhash.LENGTH)).astype(np.uint8)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 16, left.shape).astype(np.uint8))
    packed = lambda x: x[:, ::2] | x[:, 1::2] << 4
    assert len(bounds.survivors(packed(left), packed(right), at, at)) == 4000


def test_minima_estimate_similarity():
    rng = np.random.default_rng(31)
    hasher, pool = minhash.Hasher(40, 6, minhash.LENGTH), rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = hasher.minima(pool[:1000]), hasher.minima(pool[200:])
    assert abs((a == b).mean() - 800 / 1200) < 0.06


def written(spark):
    """Bytes that all shuffles of the session have written."""
    jvm = spark.sparkContext._jsc.sc()
    jvm.listenerBus().waitUntilEmpty(30_000)
    found = jvm.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_only_texts_of_pairs_are_moved(spark, tables):
    rng = random.Random(41)
    rows = [(i, " ".join(f"{rng.getrandbits(240):060x}" for _ in range(1000)), None, None, None) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " changed", None, None, None) for i in range(3)] + [(None, "no id", None, None, None)]
    path = tables(documents=spark.createDataFrame(rows, DOCUMENTS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = written(spark)
    out = without(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id"), "doc_id").select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == list(range(150)) and len(out) == 151
    assert 0 < written(spark) - before < sum(len(r[1]) for r in rows) / 2


def test_filters_of_ids_keep_joins_exact(spark, monkeypatch):
    rng = random.Random(43)
    for kind, of in (("bigint", lambda i: i * 7919 - 500_000), ("string", lambda i: f"d{i}")):
        rows = spark.createDataFrame([(of(rng.randrange(2000)) if i % 9 else None, i) for i in range(3000)], f"doc_id {kind}, n int")
        ids = spark.createDataFrame([(of(rng.randrange(3000)),) for _ in range(300)], f"doc_id {kind}")
        wanted = {r.doc_id for r in ids.collect()}
        for words in (1, 8, common.FILTER_WORDS):
            monkeypatch.setattr(common, "FILTER_WORDS", words)
            some = common.about(rows, ids, "doc_id")
            assert some.columns == rows.columns and {r.n for r in rows.collect() if r.doc_id in wanted} <= {r.n for r in some.collect()}
            assert sorted(r.n for r in without(rows, ids, "doc_id").collect()) == [r.n for r in rows.orderBy("n").collect() if r.doc_id not in wanted]
        assert without(rows, ids.limit(0), "doc_id").count() == 3000 and common.about(rows, ids.limit(0), "doc_id").count() == 0
