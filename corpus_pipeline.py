"""A training corpus from `documents` in five stages, each over all that the one before kept.

The quality classifier rejects documents, line dedup cuts repeated passages, near-dedup keeps one document of each group,
decontamination drops documents that hold a benchmark item, and best-fit packing lays the rest out in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covagrid.llm.common import cut, made, release, table
from covagrid.llm.decontaminate import decontaminated
from covagrid.llm.line_dedup import dedup_lines
from covagrid.llm.near_copies import near_dedup
from covagrid.llm.packing import pack_documents
from covagrid.llm.quality import quality_filter
from covagrid.llm.queries import tokenizer_path
from covagrid.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and blank texts stay, as nothing speaks against them."""
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from later documents; n_chars, where there is one, follows the text. No document goes."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles the smallest doc_id stays.

    Blank texts are one group. Anchors of a covering code on a wide SimHash nominate, exact similarity confirms.
    """
    return near_dedup(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item with edits up to a tenth of it go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


_PLAIN = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", leaks), ("packing", packing)]


_past: list[str] = []  # scratch tables of earlier stages


def _alone(stage):
    """The stage, after deleting the scratch tables of earlier stages: their results are written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(ship(spark), _past)
        before = made()
        out = stage(spark, docs, sf_dir)
        _past[:] = [path for path in made() if path not in before]
        return out

    return run_stage


STAGES = [(name, _alone(stage)) for name, stage in _PLAIN]

#: SQL has no tokenizer, XXH64 or classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows are written and read again, and what is read no more is deleted.

    Nulls in any column, empty and very long texts, repeated rows and an empty table pass through as each stage says.
    """
    docs, last = table(ship(spark), sf_dir, "documents"), []
    for name, stage in _PLAIN[:-1]:
        before = set(made())
        docs = cut(stage(spark, docs, sf_dir), name)
        *scratch, written = (path for path in made() if path not in before)
        release(spark, scratch + last)
        last = [written]
    return _PLAIN[-1][1](spark, docs, sf_dir)
