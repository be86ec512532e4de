"""The sample sheet: a small CSV, read and checked row by row on the driver."""

from __future__ import annotations

import csv
import io

from ..errors import ConfigError, SampleSheetError
from ..plans.config import UNASSIGNED, Barcode, Sample, Sheet

# The names that columns go by, once lower-cased and joined by underscores.
SAMPLE = ("samplenumber", "sample_number", "sample", "sample_name", "sampleid", "sample_id", "name")
BARCODE1 = ("barcode1", "barcode_1", "bc1", "bc_1", "index1", "index_1", "i7")
BARCODE2 = ("barcode2", "barcode_2", "bc2", "bc_2", "index2", "index_2", "i5")


def _columns(header: list[str]) -> dict[str, int]:
    """Where the known columns stand; of two of a kind the last counts."""
    found = {}
    for i, cell in enumerate(header):
        name = cell.strip().lstrip("﻿").strip().lower().replace(" ", "_").replace("-", "_")
        for kind, names in (("sample", SAMPLE), ("barcode1", BARCODE1), ("barcode2", BARCODE2)):
            if name in names:
                found[kind] = i
    return found


def parse_sheet(text: str, mismatches1: int = 0, mismatches2: int = 0) -> Sheet:
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    if not rows:
        raise SampleSheetError("the sample sheet is empty")
    columns = _columns(rows[0])
    for kind in ("sample", "barcode1"):
        if kind not in columns:
            raise SampleSheetError(f"the sample sheet has no column for {kind}")

    def cell(row: list[str], kind: str) -> str:
        at = columns.get(kind)
        return row[at].strip() if at is not None and at < len(row) else ""

    def barcode(value: str, line: int) -> Barcode:
        try:
            return Barcode(value.upper())
        except ConfigError as e:
            raise SampleSheetError(f"line {line}: {e}") from None

    samples, names, labels, pairs = [], set(), {}, set()
    for k, row in enumerate(rows[1:]):
        line, name = k + 2, cell(row, "sample")
        if not name:
            raise SampleSheetError(f"line {line}: the sample has no name")
        if name in names:
            raise SampleSheetError(f"line {line}: sample {name!r} stands twice")
        one, two = cell(row, "barcode1"), cell(row, "barcode2")
        own = Sample(k, name, Barcode("A"))
        if own.label.lower() == UNASSIGNED:
            raise SampleSheetError(f"line {line}: sample {name!r} would take the name of unassigned reads")
        if own.label in labels:
            raise SampleSheetError(f"line {line}: samples {labels[own.label]!r} and {name!r} would share files")
        if not one:
            raise SampleSheetError(f"line {line}: sample {name!r} has no first barcode")
        sample = Sample(k, name, barcode(one, line), barcode(two, line) if two else None)
        pair = (sample.barcode1.raw, sample.barcode2.raw if sample.barcode2 else None)
        if pair in pairs:
            raise SampleSheetError(f"line {line}: the barcodes of {name!r} stand twice")
        samples.append(sample)
        names.add(name)
        labels[own.label] = name
        pairs.add(pair)
    if not samples:
        raise SampleSheetError("the sample sheet has no samples")
    if len({s.barcode2 is None for s in samples}) > 1:
        raise SampleSheetError("some samples have a second barcode and some have none")
    if mismatches1 > max(s.barcode1.informative for s in samples):
        raise SampleSheetError("more mismatches are allowed than the first barcodes have informative bases")
    if samples[0].barcode2 and mismatches2 > max(s.barcode2.informative for s in samples):
        raise SampleSheetError("more mismatches are allowed than the second barcodes have informative bases")
    both = {s.barcode1.raw for s in samples} & {s.barcode2.raw for s in samples if s.barcode2}
    warnings = (f"{len(both)} sequences are first and second barcodes at once",) if both else ()
    return Sheet(tuple(samples), warnings)


def read_sheet(path: str, mismatches1: int = 0, mismatches2: int = 0) -> Sheet:
    with open(path, encoding="utf-8-sig", newline="") as f:
        return parse_sheet(f.read(), mismatches1, mismatches2)
