"""MinHash near-dedup with sequential Bayesian verification.

1. Each text's set of word shingles gives a 128-bit key of the set, band keys and a signature of four
   bits for each permutation. Texts of equal sets form a class; only its smallest id goes on.
2. Classes that share a band key are candidates. Each is first paired with the smallest id of its bucket, one pair for each member.
   Signatures of a pair are compared batch by batch; a pair goes once the posterior probability
   that its similarity reaches the threshold falls below ``MISS``. Survivors are verified on the full sets.
3. Verified links give components. A bucket that still holds several components has pairs left: members outside its
   largest component are compared with it and with each other, in blocks of ``BLOCK``, except within a
   component, where a link could change nothing. Members of surviving pairs, not the pairs, go on to the
   block's task with their texts, where full sets confirm the links; components follow again.
4. Buckets with more than ``HOT`` blocks of such members (texts that share a long passage, say, but are not alike enough) are not
   compared block by block. Their members' shingles are put in one order, the rarest first; of two sets alike enough, some
   shingle stands among the first ninth of the smaller one and the first fifth of the larger one. Only members that meet
   so go on, as pairs, to the signatures and to the full sets. What a group shares stands last, so it makes no pairs.

So no pair that could join two components is left untested, and copies never expand into all pairs.
With 40 bands of 6 rows, a pair of similarity 0.8 shares no band with probability 5e-6. The longer a
signature, the fewer pairs just below the threshold are left to verify: a text that is nearly but not quite like
many copies has to be held against each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, materialize, pick, remove, slices
from .components import components
from .words import NOT_SPACE, Words, mix64, sequence_hash

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 6
#: Permutations of a signature; the first bands * rows make the band keys.
LENGTH = 1280
MISS = 1e-6
BATCH = 64
BLOCK = 256
#: Shingles of a block; one of longer texts has fewer of them.
MASS = 1 << 20
#: Blocks of a bucket's members outside its largest component, beyond which rare shingles choose the pairs.
HOT = 4
#: Counters of shingles, by their last bits: only how early a shingle stands depends on them.
SLOTS = 1 << 16
#: Pairs of one text that a task verifies at most; more are dealt to several tasks.
MEMBERS = 256
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text's word hashes, sorted; a shorter text is one shingle, none is empty."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(k, len(h))
    return np.unique(sequence_hash(h, n) ^ np.uint64(n))


class Hasher:
    def __init__(self, bands: int, rows: int, length: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = (rng.integers(0, 1 << 32, length, np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
        self.add = rng.integers(0, 1 << 32, length, np.uint64).astype(np.uint32)[:, None]

    def minima(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 256):  # what stays in a core's cache
            v = self.mul * x[a : a + 256]
            v += self.add
            np.minimum(out, v.min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima[:, : self.bands * self.rows].reshape(-1, self.bands, self.rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), m.shape[:2])
        for r in range(self.rows):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
        return out.view(np.int64)

    def bytes(self, minima: np.ndarray) -> np.ndarray:
        """Four bits of each minimum, two minima to a byte."""
        four = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
        return four[:, ::2] | four[:, 1::2] << 4


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches in n signature entries that leave similarity >= threshold a posterior of at least ``miss``.

    An entry of four bits matches with probability p = s + (1 - s) / 16; with a uniform prior, P(p >= q | m of n) is
    P(Bin(n + 1, q) <= m).
    """
    q, tail = min(threshold + (1 - threshold) / 16, 1 - 1e-12), 0.0
    for m in range(n + 1):
        ways = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
        tail += math.exp(ways + m * math.log(q) + (n + 1 - m) * math.log1p(-q))
        if tail >= miss:
            return m
    return n


class Bounds:
    def __init__(self, length: int, threshold: float, miss: float):
        self.steps = [(a, min(a + BATCH, length)) for a in range(0, length, BATCH)]
        self.least = [least_matches(b, threshold, miss) for _, b in self.steps]

    def survivors(self, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs (left[i], right[j]) of signature rows no batch prunes: positions in i."""
        on = np.arange(len(i))
        m = np.zeros(len(i), np.int32)
        for (a, b), least in zip(self.steps, self.least):
            apart = left[i[on], a // 2 : b // 2] ^ right[j[on], a // 2 : b // 2]
            m = m + ((apart & 15) == 0).sum(1) + (apart < 16).sum(1)
            go = m >= least
            on, m = on[go], m[go]
        return on


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def signatures(docs: DataFrame, k: int, bands: int, rows: int, length: int) -> DataFrame:
    """id, n (size of the set), ka, kb (a key of the set), bands and sig of every row of docs (id, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bands, rows, length)
        for batch in slices(batches, "text"):
            words = Words(batch.column(1), NOT_SPACE)
            n, ka, kb, minima = [], [], [], np.zeros((batch.num_rows, length), np.uint32)
            for r, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                s = shingles(words.hash[a:b], k)
                n.append(len(s))
                ka.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                kb.append(int(mix64(s ^ _SALT).sum(dtype=np.uint64).view(np.int64)))
                if len(s):
                    minima[r] = hasher.minima(s)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * batch.num_rows + 1, bands, dtype=np.int32)), pa.array(hasher.keys(minima).reshape(-1)))
            sig = pa.array([x.tobytes() for x in hasher.bytes(minima)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), keys, sig], ["id", "n", "ka", "kb", "bands", "sig"])

    return docs.mapInArrow(run, f"id {kind}, n bigint, ka bigint, kb bigint, bands array<bigint>, sig binary")


def _similar_size(a: str, b: str, threshold: float):
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - 1e-6


def prune(pairs: DataFrame, reps: DataFrame, length: int, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that the comparison of signatures doesn't rule out."""
    left = about(reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), pairs, "a")
    right = about(reps.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), pairs, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(length, threshold, miss)
        for batch in batches:
            at = np.arange(batch.num_rows)
            on = pa.array(bounds.survivors(_matrix(batch.column(2), length // 2), _matrix(batch.column(3), length // 2), at, at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(1).take(on)], ["a", "b"])

    kind = reps.schema["id"].dataType.simpleString()
    both = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    A text meets its partners in tasks of about ``MEMBERS`` of them, sorted so that it comes first; a
    task holds one set at a time. docs: id, text.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    wanted = dealt.select(F.col("b").alias("id"), "a", "part", F.lit(1).alias("role")).unionByName(dealt.select(F.col("a").alias("id"), "a", "part", F.lit(0).alias("role")).distinct())
    # The same join at every size: one shuffle of the texts of pairs, none to the driver.
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = wanted.join(about(docs, ids).hint("merge"), "id").select("a", "part", "role", "id", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in slices(batches, "text"):
            words = Words(batch.column(4), NOT_SPACE)
            out: list[tuple] = []
            heads = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for r, (a, part, role, b) in enumerate(heads):
                s = shingles(words.hash[words.first[r] : words.first[r + 1]], k)
                if key != (a, part):
                    key, own = (a, part), []
                if role == 0:
                    own.append(s)
                    continue
                for t in own:
                    common = len(s) + len(t) - len(np.union1d(s, t))
                    if len(s) and 100 * common >= percent * (len(s) + len(t) - common):
                        out.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], batch.column(0).type), pa.array([p[1] for p in out], batch.column(3).type)], ["a", "b"])

    kind = docs.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"a {kind}, b {kind}")


def divided(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, id, n) of buckets with several components: also component, top (the largest component), major and minor
    (blocks of its members, and of the others)."""
    named = buckets.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    counts = named.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("mass"))
    split = counts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("c").alias("c"), F.sum("mass").alias("mass"), F.max(F.struct("c", "component", "mass")).alias("top")).where("kinds > 1")
    blocks = lambda c, mass: F.ceil(F.greatest(c / BLOCK, mass / MASS))
    split = split.select("key", F.col("top.component").alias("top"), blocks(F.col("top.c"), F.col("top.mass")).alias("major"), blocks(F.col("c") - F.col("top.c"), F.col("mass") - F.col("top.mass")).alias("minor"))
    return named.join(split, "key")


def met(hot: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members of hot buckets, of different components, that can be alike enough: prefix filtering on full sets.

    hot: id, component; docs: id, text. Any order of shingles gives every such pair; the rarest first makes them few. With
    t = percent / 100, sets of sizes x <= y that are alike enough have t (x + y) / (1 + t) shingles in common, so the first
    x - 2 t x / (1 + t) + 1 of the one and the first y - t y + 1 of the other meet. One row for each of these goes through a shuffle.
    In a shingle's group, members of its largest component are not held against each other.
    """
    spark, kind = docs.sparkSession, hot.schema["id"].dataType.simpleString()
    texts, path = materialize(spark, hot.join(about(docs, hot).hint("merge"), "id").select("id", "component", "text"), "hot")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, "text"):
            words = Words(batch.column(2), NOT_SPACE)
            for a, b in zip(words.first[:-1], words.first[1:]):
                total += np.bincount((shingles(words.hash[a:b], k) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "c"])

    often = np.zeros(SLOTS, np.int64)
    for r in texts.mapInArrow(count, "slot bigint, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).collect():  # SLOTS rows at most
        often[r.slot] = r.c
    sent = spark.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(2), NOT_SPACE)
            keys, own, sizes, early = [], [], [], []
            for r, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                s = shingles(words.hash[a:b], k)
                n = len(s)
                if not n:
                    continue
                s = s[np.lexsort((s, sent.value[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))]
                long, short = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                keys.append(s[:long])
                own.append(np.full(long, r))
                sizes.append(np.full(long, n))
                early.append(np.arange(long) < short)
            if keys:
                at = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(early))], ["key", "id", "component", "n", "early"])

    rows, rows_path = materialize(spark, texts.mapInArrow(prefixes, f"key bigint, id {kind}, component {kind}, n bigint, early boolean"), "prefixes")
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.max("early").alias("early"))
    tops = counts.groupBy("key").agg(F.count("*").alias("kinds"), F.max("early").alias("any"), F.max(F.struct("c", "component")).alias("top")).where("kinds > 1 and any").select("key", F.col("top.component").alias("top"))
    shared = rows.join(tops, "key").withColumn("big", F.col("component") == F.col("top"))
    small, large = (shared.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "big", "early")]) for x in "xy")
    alike = (F.col("component_x") != F.col("component_y")) & (F.struct("n_x", "id_x") < F.struct("n_y", "id_y")) & (100 * F.col("n_x") >= percent * F.col("n_y"))
    both = small.where("early_x and not big_x").join(large, "key").where(alike)
    both = both.unionByName(small.where("early_x and big_x").join(large.where("not big_y"), "key").where(alike))
    pairs, _ = materialize(spark, both.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct(), "met")
    remove(spark, path, rows_path)
    return pairs


def across(rows: DataFrame, reps: DataFrame, length: int, threshold: float, miss: float) -> DataFrame:
    """The members of each block task that share a bucket with a member of another component which signatures don't rule out.

    rows: as from divided(). In a bucket of several components, its largest is the
    majority; the others are compared with it and with each other, block by block. A pair counts in the
    first bucket that it shares. At most the task's own rows come out, whatever the number of pairs.
    """
    rows = rows.withColumn("big", F.col("component") == F.col("top"))
    mine = F.pmod(F.xxhash64("id", "key"), F.when(F.col("big"), F.col("major")).otherwise(F.col("minor")))
    rows = rows.withColumn("block", mine)
    to = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    # A task is (kind, i, j): majority block i with minority block j, or minority blocks i <= j.
    with_major = F.transform(F.when(F.col("big"), to("minor")).otherwise(to("major")), lambda x: F.struct(F.lit(0).alias("t"), F.when(F.col("big"), F.col("block")).otherwise(x).alias("i"), F.when(F.col("big"), x).otherwise(F.col("block")).alias("j")))
    with_minor = F.when(F.col("big"), F.array().cast("array<struct<t:int,i:bigint,j:bigint>>")).otherwise(F.transform(to("minor"), lambda x: F.struct(F.lit(1).alias("t"), F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j"))))
    tasks = rows.select("key", "id", "component", "big", F.explode(F.concat(with_major, with_minor)).alias("task")).select("key", "task.*", "id", "component", "big")
    full = tasks.join(about(reps.select("id", "n", "bands", "sig"), rows).hint("merge"), "id").select(*_TASK, "id", "component", "big", "n", "bands", "sig").repartition(*_TASK).sortWithinPartitions(*_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(length, threshold, miss)
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            starts = _group_starts(whole)
            rest = whole.slice(starts[-1]) if len(starts) else None
            for x, y in zip(starts[:-1], starts[1:]):
                yield from _touched(whole.slice(x, y - x), bounds, threshold)
        if rest is not None:
            yield from _touched(rest, bounds, threshold)

    return full.mapInArrow(run, full.schema)


_TASK = ("key", "t", "i", "j")


def _group_starts(rows: pa.Table) -> np.ndarray:
    """Where the groups of equal (key, t, i, j) start."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in _TASK:
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _candidates(rows: pa.Table, bounds: Bounds, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of one task's pairs to verify: of two components, first met in this bucket, not ruled out by signatures."""
    component, n, big = (rows.column(c).to_numpy() for c in ("component", "n", "big"))
    if rows.column("t")[0].as_py() == 0:
        p, q = np.meshgrid(np.flatnonzero(big), np.flatnonzero(~big), indexing="ij")
        i, j = p.ravel(), q.ravel()
    else:
        i, j = np.triu_indices(len(rows), 1)
    ok = (component[i] != component[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-6)
    i, j = i[ok], j[ok]
    if not len(i):
        return i, j
    sig = _matrix(rows.column("sig").combine_chunks(), bounds.steps[-1][1] // 2)
    on = bounds.survivors(sig, sig, i, j)
    i, j = i[on], j[on]
    bands = np.array(rows.column("bands").to_pylist(), np.int64)
    key, first = rows.column("key")[0].as_py(), np.zeros(len(i), bool)
    for x in range(0, len(i), 4096):
        p = bands[i[x : x + 4096]]
        at = (p == bands[j[x : x + 4096]]).argmax(axis=1)
        first[x : x + 4096] = p[np.arange(len(p)), at] == key
    return i[first], j[first]


def _touched(rows: pa.Table, bounds: Bounds, threshold: float) -> Iterator[pa.RecordBatch]:
    i, j = _candidates(rows, bounds, threshold)
    if len(i):
        yield from rows.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()


def joined(members: DataFrame, docs: DataFrame, k: int, length: int, threshold: float, miss: float, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of each block task, confirmed on full sets.

    members: as from across(); docs: id, text. Two components that a link of the task has joined
    need no second link there, so a task gives fewer links than it has members. A task holds the sets of two blocks.
    """
    kind = members.schema["id"].dataType.simpleString()
    texts = members.join(about(docs, members).hint("merge"), "id").select(*members.columns, "text").repartition(*_TASK).sortWithinPartitions(*_TASK, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(length, threshold, miss)
        task, held, sets = None, [], []
        for batch in slices(batches, "text"):
            words = Words(batch.column(batch.num_columns - 1), NOT_SPACE)
            rows = pa.Table.from_batches([batch]).drop_columns(["text"])
            starts = np.append(_group_starts(rows), len(rows))
            for x, y in zip(starts[:-1], starts[1:]):
                now = tuple(rows.column(c)[x].as_py() for c in _TASK)
                if task is not None and now != task:
                    yield from _confirmed(pa.concat_tables(held).combine_chunks(), sets, bounds, threshold, percent)
                    held, sets = [], []
                task = now
                held.append(rows.slice(x, y - x))
                sets.extend(shingles(words.hash[words.first[r] : words.first[r + 1]], k) for r in range(x, y))
        if held:
            yield from _confirmed(pa.concat_tables(held).combine_chunks(), sets, bounds, threshold, percent)

    return texts.mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(rows: pa.Table, sets: list[np.ndarray], bounds: Bounds, threshold: float, percent: int) -> Iterator[pa.RecordBatch]:
    """Verified links of one task, until its components are joined as far as they can be."""
    ids = rows.column("id").to_pylist()
    # An id's row comes once for each of its repeated rows in the documents.
    once = [r for r in range(len(ids)) if not r or ids[r] != ids[r - 1] or not np.array_equal(sets[r], sets[r - 1])]
    rows, sets, ids = rows.take(pa.array(once)), [sets[r] for r in once], [ids[r] for r in once]
    component = rows.column("component").to_pylist()
    root = {c: c for c in component}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    a, b = [], []
    for i, j in zip(*(v.tolist() for v in _candidates(rows, bounds, threshold))):
        p, q = find(component[i]), find(component[j])
        if p == q:
            continue
        s, t = sorted((sets[i], sets[j]), key=len)
        if not len(s):
            continue
        common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
        if 100 * common >= percent * (len(s) + len(t) - common):
            root[p] = q
            a.append(ids[i])
            b.append(ids[j])
    if a:
        kind = rows.column("id").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, length: int = LENGTH, miss: float = MISS) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for each row of docs.

    Words are lower-cased in A-Z and split at ASCII white space. A text without words, or null, is linked with nothing. A row
    without id can't be named by a link: its component is null, and it is kept. Repeated rows share a component
    and their ``kept``; other columns are dropped, whatever their names. An empty table gives an empty one. A very long text is read whole;
    a task holds the sets of two blocks, or of one pair. With ``miss`` 0 no pair of a bucket is pruned by signatures.
    """
    spark, percent = docs.sparkSession, round(100 * threshold)
    texts = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string"))
    sigs, sigs_path = materialize(spark, signatures(texts, k, bands, rows, length), "signatures")
    named = sigs.where("id is not null and n > 0")
    first = named.groupBy("ka", "kb", "n").agg(F.min(F.struct("id", "bands", "sig")).alias("r"))
    reps, reps_path = materialize(spark, first.select("ka", "kb", "n", "r.*"), "classes")

    rows_of = reps.select(F.explode("bands").alias("key"), "id", "n")
    shared = rows_of.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("low")).where("c > 1").select("key", F.col("low.id").alias("low"), F.col("low.n").alias("low_n"))
    buckets, buckets_path = materialize(spark, rows_of.join(shared, "key"), "buckets")
    star = buckets.where("id <> low").where(_similar_size("n", "low_n", threshold)).select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    tested, tested_path = materialize(spark, prune(star, reps, length, threshold, miss), "pairs")
    links, links_path = materialize(spark, verify(tested, texts, k, percent), "verified")
    labels = components(links)

    rows, rows_path = materialize(spark, divided(buckets.select("key", "id", "n"), labels), "divided")
    hot = rows.where(F.col("minor") > HOT)
    members, members_path = materialize(spark, across(rows.where(F.col("minor") <= HOT), reps, length, threshold, miss), "members")
    found, found_path = materialize(spark, joined(members, texts, k, length, threshold, miss, percent), "verified")
    links = links.unionByName(found)
    spent = [buckets_path, tested_path, links_path, rows_path, members_path, found_path]
    if hot.limit(1).count():
        # Links found by now join components, so fewer pairs are left to find.
        labels = components(links)
        now = hot.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        more, more_path = materialize(spark, prune(met(now, texts, k, percent), reps, length, threshold, miss), "pairs")
        late, late_path = materialize(spark, verify(more, texts, k, percent), "verified")
        links = links.unionByName(late)
        spent += [more_path, late_path]
    labels = components(links)

    classes = reps.select("ka", "kb", "n", "id").join(labels, "id", "left").select("ka", "kb", "n", F.coalesce("component", "id").alias("component"))
    # A class of many copies makes its partition large; the adaptive join splits it, rows are small.
    out = sigs.select("id", "n", "ka", "kb").join(classes, ["ka", "kb", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    result, _ = materialize(spark, out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept")), "near-duplicates")
    remove(spark, sigs_path, reps_path, *spent)
    return result.withColumnRenamed("id", id_col)
