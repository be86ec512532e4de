"""Quality and 3' adapter trimming of whole batches of reads as numpy matrices, behind one Arrow-backed UDF a mate.

Adapters: for every placement k of the adapter against the read's last bases, the overlap is L = min(n - k, m).
A placement holds if its mismatches stay within the errors allowed for L; failing that, if some adapter prefix
of j >= min_overlap bases is within the errors allowed for j of read[k : k + L] in edit distance. More overlap
wins, then fewer errors, then the smaller k. Placements are only looked at where one of e + 1
pieces of the adapter stands exactly within e places of its own, as it must with e errors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reads handled as one matrix.
ROWS = 4096
TRIM = "start int, stop int, quality boolean, adapter boolean"


def allowed_errors(length: int, rate: float) -> list[int]:
    """Errors allowed in an overlap of 0 to length bases; the rate is a 32-bit float."""
    return [int(np.floor(np.float32(i) * np.float32(rate))) for i in range(length + 1)]


def matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths), padded with zeros."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    width = max(1, int(n.max(initial=0)))
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width), n


def _first_best(gain: np.ndarray, real: np.ndarray) -> np.ndarray:
    """How many places to cut: running sums stop below zero, the first strict maximum above zero counts."""
    total = np.cumsum(np.where(real, gain, 0), axis=1, dtype=np.int64)
    alive = real & (np.minimum.accumulate(total, axis=1) >= 0)
    score = np.where(alive, total, 0)
    at = score.argmax(axis=1)
    return np.where(score[np.arange(len(score)), at] > 0, at + 1, 0)


def quality_bounds(qual: np.ndarray, n: np.ndarray, cutoff3: int, cutoff5: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) after trimming both ends on their own; (0, 0) where nothing is left. A cutoff of 0 leaves its end."""
    q, at = qual.astype(np.int64) - 33, np.arange(qual.shape[1])
    start = _first_best(cutoff5 - q, at < n[:, None]) if cutoff5 else np.zeros(len(n), np.int64)
    stop = n - (_first_best(cutoff3 - _reversed(q, n), at < n[:, None]) if cutoff3 else 0)
    gone = start >= stop
    return np.where(gone, 0, start), np.where(gone, 0, stop)


def nextseq_bounds(seq: np.ndarray, qual: np.ndarray, n: np.ndarray, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """The 3' end only; a G counts as just below the cutoff, whatever its quality."""
    gain = np.where(seq == ord("G"), 1, cutoff - (qual.astype(np.int64) - 33))
    return np.zeros(len(n), np.int64), n - _first_best(_reversed(gain, n), np.arange(seq.shape[1]) < n[:, None])


def _reversed(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.take_along_axis(x, np.maximum(n[:, None] - 1 - np.arange(x.shape[1]), 0), axis=1)


def banded_distances(window: np.ndarray, length: np.ndarray, adapter: np.ndarray, e: int) -> np.ndarray:
    """Edit distances of the first ``length`` bases of each row to the adapter prefixes of length - e to length bases; exact where they are at most e."""
    rows, far = len(window), e + 1 + len(adapter)
    row = np.full((rows, 2 * e + 1), far, np.int32)  # column d: the prefix of i + d - e bases
    row[:, e:] = np.arange(e + 1)
    out = np.full((rows, e + 1), far, np.int32)
    for i in range(1, int(length.max(initial=0)) + 1):
        new = np.full_like(row, far)
        for d in range(2 * e + 1):
            j = i + d - e
            if 1 <= j <= len(adapter):
                new[:, d] = row[:, d] + (window[:, i - 1] != adapter[j - 1])
            elif j == 0:
                new[:, d] = i
            if d < 2 * e:
                np.minimum(new[:, d], row[:, d + 1] + 1, out=new[:, d])
            if d:
                np.minimum(new[:, d], new[:, d - 1] + 1, out=new[:, d])
            if not 0 <= j <= len(adapter):
                new[:, d] = far
        row = new
        done = length == i
        out[done] = row[done, : e + 1]
    return out


_CODE = np.full(256, 4, np.int32)
_CODE[[65, 67, 71, 84]] = range(4)
#: Bases of a seed at most: three bits each.
SEED = 6


def placements(seq: np.ndarray, zone: list[tuple[int, np.ndarray]], adapter: np.ndarray, allowed: np.ndarray, min_overlap: int) -> np.ndarray:
    """Which placements of the adapter can hold. zone: for each number e of errors, the placements whose overlap allows so many.

    The first bases that every match of a zone takes in are cut into e + 1 pieces; with e errors at most, one
    piece stands unchanged, within e places of its own. Other characters than A, C, G, T count as one here.
    """
    e_max, m, width = max(e for e, _ in zone), len(adapter), seq.shape[1]
    codes = np.full((len(seq), e_max + width + m + e_max + SEED), 7, np.int32)
    codes[:, e_max : e_max + width] = _CODE[seq]
    grams, own = {1: codes}, _CODE[adapter]
    for k in range(2, SEED + 1):
        grams[k] = (grams[k - 1][:, :-1] << 3) | codes[:, k - 1 :]
    out = np.zeros(seq.shape, bool)
    for e, here in zone:
        low = max(min_overlap, int(np.flatnonzero(allowed == e)[0]) - e)
        size = min(SEED, low // (e + 1))
        if not size:
            out |= here
            continue
        near = np.zeros(seq.shape, bool)
        for i in range(e + 1):
            x = low * i // (e + 1)
            value = 0
            for c in own[x : x + size].tolist():
                value = value << 3 | c
            hit = grams[size] == value
            for shift in range(e_max + x - e, e_max + x + e + 1):
                near |= hit[:, shift : shift + width]
        out |= near & here
    return out


def adapter_starts(seq: np.ndarray, n: np.ndarray, adapter: str, min_overlap: int, rate: float) -> np.ndarray:
    """Where the adapter starts in each read, or -1."""
    a = np.frombuffer(adapter.encode(), np.uint8)
    m, rows, width = len(a), len(seq), seq.shape[1]
    allowed = np.array(allowed_errors(m, rate))
    at = np.arange(width)
    overlap = np.minimum(n[:, None] - at, m)
    first = np.maximum(0, np.maximum(0, n - (m + 8)) - m)
    open_ = (at >= first[:, None]) & (at < n[:, None]) & (overlap >= min_overlap)
    none = np.full(rows, -1, np.int64)
    if not open_.any():
        return none
    limit = allowed[np.clip(overlap, 0, m)]
    zone = [(int(e), open_ & (limit == e)) for e in np.unique(allowed[min_overlap:])]
    r, k = np.nonzero(placements(seq, zone, a, allowed, min_overlap))
    padded = np.concatenate([seq, np.zeros((rows, m), np.uint8)], axis=1)
    window, length, most = padded[r[:, None], k[:, None] + np.arange(m)], overlap[r, k].astype(np.int64), limit[r, k]
    wrong = ((window != a) & (np.arange(m) < length[:, None])).sum(axis=1)
    # A key orders candidates: more overlap, fewer errors, smaller start.
    big = width + 1
    key = lambda j, errors, k: (j * (m + 1) + (m - errors)) * big + (width - k)
    best, plain = none.copy(), wrong <= most
    np.maximum.at(best, r[plain], key(length[plain], wrong[plain], k[plain]))
    rest = ~plain & (most > 0) & (key(length, 0, k) > best[r])
    for e in np.unique(most[rest]):
        one = np.flatnonzero(rest & (most == e))
        j = length[one, None] + np.arange(-int(e), 1)
        dist = np.where(j >= min_overlap, banded_distances(window[one], length[one], a, int(e)), m + width)
        low = dist.argmin(axis=1)
        errors, j = dist[np.arange(len(one)), low], j[np.arange(len(one)), low]
        ok = (errors <= allowed[np.clip(j, 0, m)]) & (j >= min_overlap)
        np.maximum.at(best, r[one[ok]], key(j[ok], errors[ok], k[one[ok]]))
    return np.where(best >= 0, width - best % big, -1)


def trim_batch(seqs: list[str], quals: list[str], cutoff3: int, cutoff5: int, nextseq: bool, adapter: str | None, min_overlap: int, rate: float) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {"start": [], "stop": [], "quality": [], "adapter": []}
    for i in range(0, len(seqs), ROWS):
        s, n = matrix([x.encode("latin-1", "replace") for x in seqs[i : i + ROWS]])
        q, _ = matrix([x.encode("latin-1", "replace") for x in quals[i : i + ROWS]])
        if nextseq:
            start, stop = nextseq_bounds(s, q, n, cutoff3)
        else:
            start, stop = quality_bounds(q, n, cutoff3, cutoff5)
        cut = (start > 0) | (stop < n)
        found = np.full(len(n), -1)
        if adapter:
            moved = np.take_along_axis(s, np.minimum(start[:, None] + np.arange(s.shape[1]), s.shape[1] - 1), axis=1)
            left = stop - start
            moved = np.where(np.arange(s.shape[1]) < left[:, None], moved, 0)
            found = adapter_starts(moved, left, adapter, min_overlap, rate)
            stop = np.where(found >= 0, start + found, stop)
        for name, v in (("start", start), ("stop", stop), ("quality", cut), ("adapter", found >= 0)):
            out[name].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, bool if k in ("quality", "adapter") else np.int64) for k, v in out.items()}


def trims(seq: Column, qual: Column, cutoff3: int = 0, cutoff5: int = 0, nextseq: bool = False, adapter: str | None = None, min_overlap: int = 3, rate: float = 0.1) -> Column:
    """struct<start, stop, quality, adapter>: what is left of a read after both trims, and whether each took anything."""
    if not (cutoff3 or cutoff5 or nextseq or adapter):
        return F.struct(F.lit(0).alias("start"), F.length(seq).alias("stop"), F.lit(False).alias("quality"), F.lit(False).alias("adapter"))

    @F.pandas_udf(TRIM)
    def run(seqs: pd.Series, quals: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(trim_batch(seqs.tolist(), quals.tolist(), cutoff3, cutoff5, nextseq, adapter, min_overlap, rate))

    return run(seq, qual)
