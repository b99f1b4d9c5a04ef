"""Pileups of sequence alignments on Spark: settings, engine, outputs and errors."""

from covagrid.errors import BadParameter, BadRecord, BadRegion, PileupError, SourceNotFound, UnsortedInput
from covagrid.operators.outputs import Histogram, Pileup, PileupOutput
from covagrid.params import BY_REFERENCE, COVERED, EVERYTHING, Flag, PileupParams, parse_flags
from covagrid.plans.engine import PileupEngine, PileupQuery

__all__ = [
    "BY_REFERENCE", "COVERED", "EVERYTHING", "BadParameter", "BadRecord", "BadRegion", "Flag", "Histogram", "Pileup", "PileupEngine", "PileupError", "PileupOutput", "PileupParams", "PileupQuery", "SourceNotFound", "UnsortedInput", "parse_flags",
]
