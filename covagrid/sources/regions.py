"""Region strings, and intervals of references."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from covagrid.errors import BadRegion

INTERVALS = "interval_ord int, tid int, name string, start long, stop long"
_LAST = (1 << 63) - 2
#: A comma between regions; one before exactly three digits that end a number is part of the number.
_BETWEEN = re.compile(r",(?!\d{3}(?:,\d{3})*(?:-|,|$))")


@dataclass(frozen=True)
class Region:
    """Zero-based start and last position; `_LAST` for the reference's end."""

    name: str
    start: int
    last: int


def _number(text: str, region: str) -> int:
    try:
        value = int(text.replace(",", ""))
    except ValueError:
        raise BadRegion(f"{text!r} in {region!r} is not a coordinate") from None
    if value < 0:
        raise BadRegion(f"{region!r} has a negative coordinate")
    return value


def parse_region(text: str) -> Region:
    """``NAME``, ``NAME:START`` (to the reference's end) or ``NAME:START-END``, one-based and inclusive; 0 counts as 1."""
    name, colon, span = text.partition(":")
    if not name or (colon and not span):
        raise BadRegion(f"{text!r} lacks a name or coordinates")
    if not colon:
        return Region(name, 0, _LAST)
    first, dash, second = span.partition("-")
    if not first or (dash and not second):
        raise BadRegion(f"{text!r} lacks a coordinate")
    start = max(1, _number(first, text))
    if not dash:
        return Region(name, start - 1, _LAST)
    end = _number(second, text)
    if end < start:
        raise BadRegion(f"{text!r} ends before it starts")
    return Region(name, start - 1, end - 1)


def parse_regions(text: str) -> list[Region]:
    found = [parse_region(part.strip()) for part in _BETWEEN.split(text) if part.strip()]
    if not found:
        raise BadRegion("no region is given")
    return found


def resolve(spark: SparkSession, refs: list[tuple[int, str, int]], regions: str | None) -> DataFrame:
    """The intervals in the order asked for, or all references; refs: (tid, name, length). Not sorted, not merged."""
    if regions is None:
        rows = [(k, tid, name, 0, length) for k, (tid, name, length) in enumerate(refs)]
    else:
        by_name = {name: (tid, length) for tid, name, length in refs}
        rows = []
        for k, region in enumerate(parse_regions(regions)):
            if region.name not in by_name:
                raise BadRegion(f"no reference is called {region.name!r}")
            tid, length = by_name[region.name]
            rows.append((k, tid, region.name, region.start, max(region.start, min(region.last + 1, length))))
    return spark.createDataFrame(rows, INTERVALS)


def chunks(length: int, workers: int, least: int = 250_000) -> list[tuple[int, int]]:
    """How an interval is cut for a number of workers: whole if shorter than `least`, else in parts of length/workers + 1."""
    size = length if length < least else length // workers + 1
    return [(a, min(length, a + size)) for a in range(0, length, max(1, size))]
