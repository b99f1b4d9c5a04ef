"""Flags of alignment records and the settings of a pileup."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntFlag

from covagrid.errors import BadParameter


class Flag(IntFlag):
    """Bits of the FLAG field that filters can name."""

    PAIRED = 1
    PROPER_PAIR = 2
    UNMAPPED = 4
    MATE_UNMAPPED = 8
    REVERSE = 16
    READ1 = 64
    READ2 = 128
    SECONDARY = 256
    QC_FAIL = 512
    DUPLICATE = 1024
    SUPPLEMENTARY = 2048


DEFAULT_EXCLUDED = Flag.SECONDARY | Flag.QC_FAIL | Flag.DUPLICATE | Flag.UNMAPPED
_BY_NAME = {flag.name.replace("_", ""): flag for flag in Flag}


def parse_flags(text: str) -> int:
    """A mask from a number (also hexadecimal) or from names in any case, with or without - and _, split by commas."""
    mask = 0
    for part in filter(None, (p.strip() for p in text.split(","))):
        try:
            mask |= int(part, 0)
        except ValueError:
            name = part.upper().replace("-", "").replace("_", "")
            if name not in _BY_NAME:
                raise BadParameter(f"no flag is called {part!r}") from None
            mask |= _BY_NAME[name]
    return mask


COVERED, BY_REFERENCE, EVERYTHING = "covered", "by_reference", "everything"


@dataclass(frozen=True)
class PileupParams:
    """regions: NAME[:START[-END]], split by commas; emit: which coordinates get a row; max_depth 0: no cap.

    bin_width: coordinates that one aggregation group of reads spans; it changes no result.
    """

    regions: str | None = None
    emit: str = COVERED
    max_depth: int = 8000
    ignore_overlaps: bool = False
    count_orphans: bool = False
    include_flags: int = 0
    exclude_flags: int = int(DEFAULT_EXCLUDED)
    min_mapping_quality: int = 0
    min_base_quality: int = 13
    no_baq: bool = False
    redo_baq: bool = False
    strict: bool = True
    bin_width: int = 1000

    def __post_init__(self):
        if self.redo_baq and self.no_baq:
            raise BadParameter("redoing base alignment qualities excludes not using them")
        if self.emit not in (COVERED, BY_REFERENCE, EVERYTHING):
            raise BadParameter(f"emit is none of the three modes: {self.emit!r}")
        if self.max_depth < 0 or self.bin_width < 1:
            raise BadParameter("the depth cap can't be negative and a bin spans at least one coordinate")
