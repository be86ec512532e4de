"""Options of a run, checked when they are built, and the sample sheet's entries."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from enum import StrEnum

from ..errors import ConfigError
from ..functions.reads import RESERVED

UNASSIGNED = "unassigned"
# The adapters trimmed unless others are named.
ADAPTER_R1 = "AGATCGGAAGAGCACACGTCTGAA"
ADAPTER_R2 = "AGATCGGAAGAGCGTCGTG"


class Mode(StrEnum):
    SINGLE = "single"
    DUAL = "dual"


class Orientation(StrEnum):
    BOTH = "both"
    CANONICAL = "canonical"
    SWAPPED = "swapped"


@dataclass(frozen=True)
class Barcode:
    """A barcode pattern: N positions carry a UMI and aren't compared."""

    raw: str

    def __post_init__(self):
        if not re.fullmatch("[ACGTN]+", self.raw):
            raise ConfigError(f"barcode {self.raw!r} holds other letters than A, C, G, T and N")
        if not self.informative:
            raise ConfigError(f"barcode {self.raw!r} has no informative base")

    @property
    def length(self) -> int:
        return len(self.raw)

    @property
    def informative(self) -> int:
        return sum(b != "N" for b in self.raw)

    @property
    def umi(self) -> list[int]:
        return [i for i, b in enumerate(self.raw) if b == "N"]


@dataclass(frozen=True)
class Sample:
    id: int
    name: str
    barcode1: Barcode
    barcode2: Barcode | None = None

    @property
    def label(self) -> str:
        return label(self.name)


def label(name: str) -> str:
    """A sample's name as part of a file name."""
    safe = re.sub(r"[^A-Za-z0-9._-]", "_", name) or "unnamed"
    return "_" + safe if safe.upper() in RESERVED else safe


@dataclass(frozen=True)
class Tso:
    """A 5' pattern of N (UMI) and I (ignored) positions that is cut off."""

    pattern: str

    def __post_init__(self):
        object.__setattr__(self, "pattern", self.pattern.strip().upper())
        if not re.fullmatch("[NI]+", self.pattern):
            raise ConfigError("the TSO pattern takes N and I only")

    @property
    def umi(self) -> list[int]:
        return [i for i, b in enumerate(self.pattern) if b == "N"]


def adapter(text: str | None) -> str | None:
    """An adapter as it is searched; a blank one is none."""
    text = (text or "").strip().upper()
    return text or None


@dataclass(frozen=True)
class Options:
    """All that steers a run but its inputs and samples."""

    mismatches1: int = 0
    mismatches2: int = 0
    min_delta: int = 0
    orientation: Orientation = Orientation.BOTH
    keep_barcodes: bool = False
    canonicalize: bool = True
    tso: Tso | None = None
    adapter_r1: str | None = ADAPTER_R1
    adapter_r2: str | None = ADAPTER_R2
    quality_cutoff3: int = 0
    quality_cutoff5: int = 0
    nextseq: bool = False
    min_length: int = 0
    min_overlap: int = 3
    error_rate: float = 0.1
    skip_reads: int = 0
    max_reads: int = 0
    discard_unassigned: bool = False
    counts_only: bool = False

    def __post_init__(self):
        object.__setattr__(self, "orientation", Orientation(self.orientation))
        object.__setattr__(self, "adapter_r1", adapter(self.adapter_r1))
        object.__setattr__(self, "adapter_r2", adapter(self.adapter_r2))
        for name in ("mismatches1", "mismatches2", "min_delta", "min_length", "skip_reads", "max_reads"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 0:
                raise ConfigError(f"{name} takes a whole number of 0 or more")
        for name in ("quality_cutoff3", "quality_cutoff5"):
            if not 0 <= getattr(self, name) <= 255:
                raise ConfigError(f"{name} takes 0 to 255")
        if self.min_overlap < 1:
            raise ConfigError("min_overlap must be at least 1")
        if not (math.isfinite(self.error_rate) and 0 <= self.error_rate <= 1):
            raise ConfigError("error_rate must be between 0 and 1")

    def but(self, **changes) -> "Options":
        return replace(self, **changes)


@dataclass(frozen=True)
class Sheet:
    """The samples of a run; dual if they have two barcodes."""

    samples: tuple[Sample, ...]
    warnings: tuple[str, ...] = field(default=())

    @property
    def mode(self) -> Mode:
        return Mode.DUAL if self.samples[0].barcode2 else Mode.SINGLE
