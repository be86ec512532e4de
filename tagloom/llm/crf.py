"""Quality rules: a linear-chain conditional random field marks each line content or boilerplate.

Base counts come from the whole text. Lines with a word form a sequence; each has binary features of its
shape. Viterbi decoding gives the likeliest labelling, and the share of characters in content
lines decides whether a document stays.

Only documents are labelled, so the labels of training lines are latent. Each line has evidence for content, in log-odds: what its
shape says (``EVIDENCE``) plus what its document's label says (``OF_DOCUMENT``), which alone can't outweigh a clear shape. Gradient
ascent raises the likelihood of that evidence: the expected counts under the field given the evidence, less those under the field. So
good documents may hold boilerplate lines and bad ones content, and the field learns changes between them. It is fitted on at most
``TRAIN_DOCS`` labelled documents, those of lowest hash of the id, and ``TRAIN_PARTS`` stretches of ``TRAIN_LINES`` lines of each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices

TRAIN_DOCS = 3000
#: Lines of a training sequence; a longer document gives several.
TRAIN_LINES = 40
#: Stretches of one document at most, evenly spread over it.
TRAIN_PARTS = 25
MIN_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _LOUD, _LINK = bytes(range(48, 58)), b"!?", b"@/\\=_~^{}[]"
_BLANK = b" \t\n\x0b\x0c\r"
_NOTICE = (b"licen", b"copyright", b"cookie", b"all rights", b"subscribe", b"privacy", b"click", b"share")
FEATURES = 40
#: Log-odds that a line with a feature is content: symbols, loud marks, capitals, digits, marks of links, words, distinct words, end, repeats, notices, addresses.
EVIDENCE = {7: -0.7, 8: -2.5, 9: -4.0, 11: -0.2, 12: -2.0, 13: -3.0, 16: -1.0, 17: -3.0, 21: -1.5, 23: -0.3, 24: -1.0, 25: -3.0, 26: -1.0, 28: 1.0, 29: 1.5, 30: -3.0, 31: -0.3, 33: 1.0, 34: -3.0, 37: -2.0, 38: -1.0}
OF_DOCUMENT = {1: 1.5, 0: -1.0}


def _steps(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def line_mask(line: bytes, seen: bool, place: int, count: int) -> int:
    """The features of a line as bits."""
    n, words = len(line), line.split()
    shape = lambda chars: (n - len(line.translate(None, chars))) / n
    upper, lower = shape(_UPPER), shape(_LOWER)
    on = [0, 1 + _steps(n, 20, 60, 150, 400), 6 + _steps(shape(SYMBOLS), 1e-9, 0.02, 0.06), 10 + _steps(shape(_LOUD), 1e-9, 0.02, 0.06)]
    on += [14 + _steps(upper / (upper + lower) if upper + lower else 0, 0.1, 0.3, 0.7), 18 + _steps(shape(_DIGIT), 1e-9, 0.05, 0.2), 22 + _steps(shape(_LINK), 1e-9, 0.02, 0.06)]
    on += [26 + _steps(len(words), 3, 8, 20), 30 + _steps(len(set(words)) / len(words), 0.4, 0.7)]
    on += [b for b, yes in ((33, line[-1:] in b".!?:;\"')"), (34, seen), (35, place == 0), (36, place == count - 1), (37, any(w in line.lower() for w in _NOTICE)), (38, b"http" in line or b"www." in line), (39, count == 1)) if yes]
    return sum(1 << b for b in on)


def lines_of(text: str) -> tuple[list[bytes], list[bool]]:
    """The lines with a word, trimmed, and whether the untrimmed line equals an earlier one."""
    lines, repeated, seen = [], [], set()
    for raw in text.encode().split(b"\n"):
        if line := raw.strip(_BLANK):
            lines.append(line)
            repeated.append(raw in seen)
            seen.add(raw)
    return lines, repeated


def masks_of(lines: list[bytes], repeated: list[bool]) -> list[int]:
    return [line_mask(x, r, i, len(lines)) for i, (x, r) in enumerate(zip(lines, repeated))]


@dataclass
class Field:
    """Weights of features by label (0 boilerplate, 1 content) and of pairs of neighbouring labels."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self):
        self.known: dict[int, tuple[float, float]] = {}

    def scores(self, mask: int) -> tuple[float, float]:
        if mask not in self.known:
            if len(self.known) > 100_000:
                self.known = {}
            rows = self.emit[[b for b in range(FEATURES) if mask >> b & 1]].sum(0)
            self.known[mask] = float(rows[0]), float(rows[1])
        return self.known[mask]

    def decode(self, masks: list[int]) -> list[int]:
        """The likeliest labels; of equal ones, content."""
        (a, b), (c, d) = self.move.tolist()
        s0 = s1 = 0.0
        back = []
        for i, mask in enumerate(masks):
            e0, e1 = self.scores(mask)
            if i:
                f0, f1 = s1 + c >= s0 + a, s1 + d >= s0 + b
                back.append((f0, f1))
                s0, s1 = (s1 + c if f0 else s0 + a) + e0, (s1 + d if f1 else s0 + b) + e1
            else:
                s0, s1 = e0, e1
        if not masks:
            return []
        out = [int(s1 >= s0)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def evidence(mask: int, label: int) -> float:
    """The log-odds that a line of a document of this label is content."""
    return OF_DOCUMENT[label] + sum(w for b, w in EVIDENCE.items() if mask >> b & 1)


def _marginals(e: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the sum over labellings, P(label) of each line, expected pairs of neighbours) of each sequence."""
    n, width, _ = e.shape
    fwd, bwd = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    fwd[:, 0] = e[:, 0]
    for i in range(1, width):
        step = np.logaddexp(fwd[:, i - 1, 0, None] + move[0], fwd[:, i - 1, 1, None] + move[1]) + e[:, i]
        fwd[:, i] = np.where(real[:, i, None], step, fwd[:, i - 1])
    for i in range(width - 2, -1, -1):
        ahead = e[:, i + 1] + bwd[:, i + 1]
        step = np.logaddexp(move[:, 0] + ahead[:, 0, None], move[:, 1] + ahead[:, 1, None])
        bwd[:, i] = np.where(real[:, i + 1, None], step, 0)
    total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    node = np.exp(fwd + bwd - total[:, None, None]) * real[..., None]
    pair = np.zeros((n, 2, 2))
    for a in range(2):
        for b in range(2):
            pair[:, a, b] = (np.exp(fwd[:, :-1, a] + move[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - total[:, None]) * real[:, 1:]).sum(1)
    return total, node, pair


def fit(sequences: list[tuple[list[int], int]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Train on (masks of lines, document's label) by Adam on the likelihood of the evidence; classes weigh alike."""
    parts = [(m[i : i + TRAIN_LINES], y) for m, y in sequences for i in range(0, len(m), TRAIN_LINES)]
    if len({y for _, y in parts}) < 2:
        return Field()
    n, width = len(parts), max(len(m) for m, _ in parts)
    masks, told = np.zeros((n, width), np.uint64), np.zeros((n, width, 2))
    for k, (m, y) in enumerate(parts):
        masks[k, : len(m)] = m
        told[k, : len(m), 1] = [evidence(x, y) for x in m]
    size = np.array([len(m) for m, _ in parts])
    real = np.arange(width) < size[:, None]
    x = ((masks[..., None] >> np.arange(FEATURES, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    y = np.array([v for _, v in parts])
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())) * n / 2
    params, m1, m2 = np.zeros(2 * FEATURES + 4), np.zeros(2 * FEATURES + 4), np.zeros(2 * FEATURES + 4)
    for t in range(1, rounds + 1):
        emit, move = params[:-4].reshape(FEATURES, 2), params[-4:].reshape(2, 2)
        e = x @ emit
        _, node, pair = _marginals(e, move, real)
        _, likely, pairs = _marginals(e + told, move, real)
        grad_e = np.einsum("nlf,nlk,n->fk", x, likely - node, weight, optimize=True)
        grad_m = np.einsum("nab,n->ab", pairs - pair, weight)
        grad = np.concatenate([grad_e.ravel(), grad_m.ravel()]) / n - decay * params
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        params = params + rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Field(params[:-4].reshape(FEATURES, 2).copy(), params[-4:].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN_DOCS) -> Field:
    """A field from at most ``limit`` labelled documents, half of either class. Without both classes, all lines are content.

    An id labelled twice counts once, by its lower label; of several texts of one id, one is taken by a fixed order. Null ids, labels
    and texts are left out. At most ``limit`` labels and ``limit * TRAIN_PARTS * TRAIN_LINES`` lines' features reach the driver.
    """
    known = pick(labels, id=id_col, y=label_col).where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    rank = F.xxhash64("id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(rank, "id").limit(limit // 2)
        chosen = part if chosen is None else chosen.union(part)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # at most `limit` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            masks = [stretches(masks_of(*lines_of(t or ""))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.list_(pa.int64()))], ["id", "y", "masks"])

    kind = known.schema["id"].dataType.simpleString()
    texts = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("id", F.col("y").cast("int"), "text")
    rows = texts.mapInArrow(run, f"id {kind}, y int, masks array<bigint>").groupBy("id", "y").agg(F.min("masks").alias("masks")).collect()
    return fit([(r.masks, r.y) for r in sorted(rows, key=lambda r: r.id) if r.masks])


def stretches(masks: list[int]) -> list[int]:
    """The masks of a training document: all, or of a very long one ``TRAIN_PARTS`` stretches at even distances."""
    parts = -(-len(masks) // TRAIN_LINES)
    if parts <= TRAIN_PARTS:
        return masks
    starts = [k * parts // TRAIN_PARTS * TRAIN_LINES for k in range(TRAIN_PARTS)]
    return [m for a in starts for m in masks[a : a + TRAIN_LINES]]


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    words = raw.split()  # of bytes: by ASCII white space only
    blanks = len(raw) - len(raw.translate(None, _BLANK))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        count, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeats += i + 3 - max(reach, i)
                reach = i + 3
    return len(words), len(text) - blanks, symbols, sum(lines_of(text)[1]), repeats


def judge(text: str, model: Field, min_share: float) -> tuple:
    """The base counts, whether they fail, the labels of lines, the content's share and the verdict."""
    counts = base_counts(text)
    lines, repeated = lines_of(text)
    labels = model.decode(masks_of(lines, repeated))
    whole = sum(map(len, lines))
    share = sum(len(x) for x, y in zip(lines, labels) if y) / whole if whole else 0.0
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    return *counts, failed, labels, share, not failed and share >= min_share


def keep(docs: DataFrame, model: Field, text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of docs, with all their columns, whose text score() would keep.

    A null or empty text fails the base rules and goes. Repeated rows are judged alike, null ids don't matter, an empty table gives an
    empty one. A very long text is read whole. Columns named like those of score() are left as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.emit, model.move))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array([judge(t.as_py() or "", model, min_share)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each row of docs: the base counts, ``base_failed``, ``line_labels`` (of lines with a word, 1 for content),
    ``content_share`` (of their characters; 0 without any) and ``kept``.

    A null text has no words and fails. Repeated rows and null ids are kept, other columns dropped, whatever their names. An empty
    table gives an empty one, a very long text is read whole. Of equally likely labellings the one ending in content counts.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.emit, model.move))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "line_labels", "content_share", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                for col, v in zip(out, judge(text or "", model, min_share)):
                    col.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int8()), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, line_labels array<tinyint>, content_share double, kept boolean"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
