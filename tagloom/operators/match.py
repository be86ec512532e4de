"""Barcode matching: a small table of samples against every read, row by row and without a shuffle.

Three physical forms share one result. With no mismatches and one barcode length, broadcast hash
joins on the prefixes; for a moderate number of samples, distances unrolled into column expressions; for many,
a fold over an array of samples. A read's prefix becomes a BIGINT with one hot digit a base, so a distance is the
number of informative bases less the bits it shares with the barcode's mask.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import one_hot
from ..plans.config import Barcode, Mode, Options, Orientation, Sheet

WIDTH = 15
#: Sample and orientation pairs beyond which the distances aren't unrolled.
UNROLL = 160
_NONE = (1 << 62) - 1
#: A key holds distance, orientation and sample: distance * STEP + orientation * HALF + sample.
HALF = 1 << 24
STEP = HALF << 1
_HOT = {"A": 1, "C": 2, "G": 4, "T": 8, "N": 0}


def masks(barcode: Barcode) -> list[tuple[int, int, int]]:
    """(offset, width, mask) of the barcode in pieces of up to 15 bases."""
    out = []
    for a in range(0, barcode.length, WIDTH):
        piece = barcode.raw[a : a + WIDTH]
        out.append((a, len(piece), reduce(lambda m, b: m << 4 | _HOT[b], piece, 0)))
    return out


class Encoded:
    """Encodings of reads as columns of the plan, each computed once."""

    def __init__(self):
        self.columns: dict[str, Column] = {}

    def name(self, read: str, three_prime: bool, length: int, offset: int, width: int) -> str:
        name = f"__enc_{read}_{'3' if three_prime else '5'}_{length if three_prime else 0}_{offset}_{width}"
        if name not in self.columns:
            start = F.length(read) - length + 1 + offset if three_prime else F.lit(1 + offset)
            self.columns[name] = F.when(F.length(read) >= length if three_prime else F.length(read) >= offset + width, one_hot(F.col(read), start, width))
        return name

    def piece(self, *key) -> Column:
        return F.col(self.name(*key))

    def distance(self, read: str, barcode: Barcode, three_prime: bool = False) -> str:
        """Mismatches at informative positions, as SQL; null where the read is shorter than the barcode."""
        out = str(barcode.informative)
        for a, w, m in masks(barcode):
            out += f" - bit_count({self.name(read, three_prime, barcode.length, a, w)} & {m}L)"
        return f"({out})"


def pin(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns taken as they are from here on: filters and projections above don't repeat their expressions.

    Pushed through a projection, a filter repeats what it filters on; over unrolled distances that
    would grow with every step. An expression that names the partition isn't repeated.
    """
    return df.withColumns({c: F.when(F.spark_partition_id() >= 0, F.col(c)) for c in columns})


def _arms(sheet: Sheet, paired: bool, orientation: Orientation) -> list[tuple[int, str, str | None, bool]]:
    """(number, read of the first barcode, read of the second or none, second at the 3' end)."""
    if sheet.mode == Mode.SINGLE:
        return [(0, "r1_seq", None, False)]
    if not paired:
        return [(0, "r1_seq", "r1_seq", True)]
    both = [(0, "r1_seq", "r2_seq", False), (1, "r2_seq", "r1_seq", False)]
    return [a for a in both if orientation == Orientation.BOTH or (a[0] == 0) == (orientation == Orientation.CANONICAL)]


def match(df: DataFrame, sheet: Sheet, options: Options, paired: bool) -> DataFrame:
    """df with ``status`` (match, ambiguous or none), ``sample_id``, ``distance`` and ``swapped``.

    The smallest eligible total distance wins; a tie of two samples is ambiguous, one of two orientations of a sample
    is canonical. With a margin, a match needs its closest competitor, eligible or not, to be that much further off.
    """
    arms = _arms(sheet, paired, options.orientation)
    if exact_form(sheet, options, paired):
        return _exact(df, sheet, arms)
    size = len(sheet.samples)
    encoded = Encoded()
    if size * len(arms) <= UNROLL:
        eligible, raw = _unrolled(sheet, options, arms, encoded)
    else:
        eligible, raw = _folded(sheet, options, arms, encoded)
    df = df.withColumns(encoded.columns).withColumn("__keys", F.sort_array(eligible))
    if options.min_delta:
        df = df.withColumn("__raw", F.sort_array(raw))
    df = pin(df, "__keys", *(["__raw"] if options.min_delta else []))
    best, second = F.col("__keys")[0], F.get("__keys", F.lit(1))
    steps = lambda k: F.floor(k / F.lit(STEP))
    found = best < _NONE
    tied = found & second.isNotNull() & (second < _NONE) & (steps(second) == steps(best))
    sample = best.bitwiseAND(F.lit(HALF - 1)).cast("int")
    if options.min_delta:
        first, next_ = F.col("__raw")[0], F.get("__raw", F.lit(1))
        rival = F.when(first.bitwiseAND(F.lit(HALF - 1)) == sample, next_).otherwise(first)
        close = rival.isNotNull() & (rival < _NONE) & (steps(rival) - steps(best) < F.lit(max(1, options.min_delta)))
        tied = tied | (found & close)
    status = F.when(~found, "none").when(tied, "ambiguous").otherwise("match")
    won = status == "match"
    return df.withColumns(
        {"status": status, "sample_id": F.when(won, sample), "distance": F.when(found, steps(best).cast("int")), "swapped": won & (best.bitwiseAND(F.lit(HALF)) != 0)}
    ).drop("__keys", "__raw", *encoded.columns)


def _unrolled(sheet, options, arms, encoded):
    """The keys of all samples, written as one SQL expression: building them call by call would take longer than many a query."""
    eligible, raw = [], []
    for s in sheet.samples:
        good, any_ = [], []
        for arm, read1, read2, end in arms:
            d1 = encoded.distance(read1, s.barcode1)
            ok, total = f"{d1} <= {options.mismatches1}", d1
            if read2:
                d2 = encoded.distance(read2, s.barcode2, end)
                ok, total = f"{ok} AND {d2} <= {options.mismatches2}", f"{d1} + {d2}"
            key = f"CAST({total} AS BIGINT) * {STEP}L + {arm * HALF + s.id}L"
            good.append(f"CASE WHEN {ok} THEN {key} ELSE {_NONE}L END")
            any_.append(f"coalesce({key}, {_NONE}L)")
        eligible.append(f"least({', '.join(good)})" if len(good) > 1 else good[0])
        raw.append(f"least({', '.join(any_)})" if len(any_) > 1 else any_[0])
    return F.expr(f"array({', '.join(eligible)})"), F.expr(f"array({', '.join(raw)})") if options.min_delta else None


def _folded(sheet, options, arms, encoded):
    """As _unrolled, over an array of samples: every piece of every length is encoded once, and a sample's masks name theirs."""
    at: dict[tuple, int] = {}

    def pieces(read: str, barcode: Barcode, end: bool) -> list[dict]:
        out = []
        for a, w, m in masks(barcode):
            key = (read, end, barcode.length if end else 0, a, w)
            at.setdefault(key, len(at))
            encoded.piece(read, end, barcode.length, a, w)
            out.append({"at": at[key], "mask": m})
        return out

    rows = []
    for s in sheet.samples:
        rows.append({"id": s.id, "arms": [{"arm": arm, "n1": s.barcode1.informative, "p1": pieces(r1, s.barcode1, False), "n2": s.barcode2.informative if r2 else 0, "p2": pieces(r2, s.barcode2, end) if r2 else []} for arm, r1, r2, end in arms]})
    piece = "array<struct<at:int,mask:bigint>>"
    table = F.from_json(F.lit(json.dumps(rows)), f"array<struct<id:bigint,arms:array<struct<arm:bigint,n1:int,p1:{piece},n2:int,p2:{piece}>>>>")
    codes = F.array(*[encoded.piece(r, e, n, a, w) for (r, e, n, a, w) in at])
    distance = lambda n, p: n - F.aggregate(p, F.lit(0), lambda s, x: s + F.bit_count(F.get(codes, x["at"]).bitwiseAND(x["mask"])))

    def key(sample, arm, good: bool):
        d1, d2 = distance(arm["n1"], arm["p1"]), distance(arm["n2"], arm["p2"])
        value = (d1 + d2).cast("bigint") * F.lit(STEP) + arm["arm"] * F.lit(HALF) + sample["id"]
        ok = (d1 <= options.mismatches1) & (d2 <= options.mismatches2) if good else value.isNotNull()
        return F.when(ok, value).otherwise(F.lit(_NONE))

    def keys(good: bool) -> Column:
        return F.transform(table, lambda s: F.array_min(F.transform(s["arms"], lambda a: key(s, a, good))))

    return keys(True), keys(False)


def exact_form(sheet: Sheet, options: Options, paired: bool) -> bool:
    """Whether equality of prefixes decides: two barcodes on two mates, one length each, no UMI, no mismatches, no margin."""
    lengths = {(s.barcode1.length, s.barcode2.length if s.barcode2 else 0) for s in sheet.samples}
    umi = any(s.barcode1.umi or s.barcode2 and s.barcode2.umi for s in sheet.samples)
    return paired and sheet.mode == Mode.DUAL and len(lengths) == 1 and not umi and not (options.mismatches1 or options.mismatches2 or options.min_delta)


def _exact(df: DataFrame, sheet: Sheet, arms) -> DataFrame:
    """One broadcast hash join for each orientation; barcode pairs are unique, so no row multiplies. The sheet is bounded by its file."""
    spark = df.sparkSession
    first = sheet.samples[0]
    lengths = (first.barcode1.length, first.barcode2.length)
    hits = []
    for arm, read1, read2, _ in arms:
        rows = {f"__a{arm}": [s.barcode1.raw for s in sheet.samples], f"__b{arm}": [s.barcode2.raw for s in sheet.samples], f"__hit{arm}": pa.array([s.id for s in sheet.samples], pa.int32())}
        table = spark.createDataFrame(pa.table(rows))  # from Arrow: a local relation, not a job of its own
        on = (F.substring(read1, 1, lengths[0]) == F.col(f"__a{arm}")) & (F.substring(read2, 1, lengths[1]) == F.col(f"__b{arm}"))
        df = df.join(F.broadcast(table), on, "left").drop(f"__a{arm}", f"__b{arm}")
        hits.append((arm, F.col(f"__hit{arm}")))
    canonical = next((h for a, h in hits if a == 0), F.lit(None).cast("int"))
    swapped = next((h for a, h in hits if a == 1), F.lit(None).cast("int"))
    status = F.when(canonical.isNull() & swapped.isNull(), "none").when(canonical.isNotNull() & swapped.isNotNull() & (canonical != swapped), "ambiguous").otherwise("match")
    won = status == "match"
    return df.withColumns(
        {"status": status, "sample_id": F.when(won, F.coalesce(canonical, swapped)), "distance": F.when(status != "none", F.lit(0)), "swapped": won & canonical.isNull()}
    ).drop(*[f"__hit{a}" for a, *_ in arms])
