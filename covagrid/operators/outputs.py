"""What is computed of the cells at a position: the pileup row, the histogram row, or a format of one's own."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covagrid.operators.cells import strand

KEYS = ("interval_ord", "bin", "p")


class PileupOutput(Protocol):
    """A row format.

    `aggregates` are Column aggregates over a position's cells, of which `ok` marks those of sufficient quality; `empty`
    has what a coordinate without cells shows; `text` is the line that a row is written as.
    """

    dealt: bool  # whether the reads are first dealt out by bin, for aggregates that can't be merged cheaply

    def columns(self, cells: DataFrame) -> DataFrame: ...

    def aggregates(self) -> list[Column]: ...

    def finish(self, rows: DataFrame) -> DataFrame: ...

    def empty(self) -> dict[str, Column]: ...

    def text(self) -> Column: ...


def printable(quality: Column) -> Column:
    return F.chr(F.when(quality > 93, 126).otherwise(quality + 33))


def deleted_bases() -> Column:
    """The reference bases behind a cell that its read lacks; N where none is known."""
    known = F.coalesce(F.expr("substring(ref_part, cast(p - `from` + 2 as int), cast(gap as int))"), F.lit(""))
    return F.rpad(known, F.col("gap").cast("int"), "N")


class Pileup:
    """depth, bases and quals as strings in read order."""

    dealt = True

    def columns(self, cells: DataFrame) -> DataFrame:
        ref = F.expr("substring(ref_part, cast(p - `from` + 1 as int), 1)")
        base = (
            F.when(F.col("skipped"), F.when(F.col("reverse"), "<").otherwise(">")).when(F.col("deleted"), "*").when(F.col("base") == "", "n")
            .when(F.upper("base") == F.upper(ref), F.when(F.col("reverse"), ",").otherwise(".")).otherwise(strand(F.col("base")))
        )
        head = F.when(F.col("head"), F.concat(F.lit("^"), printable(F.col("mapq")))).otherwise("")
        ins = F.when(F.col("ins") != "", F.concat(F.lit("+"), F.length("ins").cast("string"), "ins")).otherwise("")
        gap = F.when(F.col("gap") > 0, F.concat(F.lit("-"), F.col("gap").cast("string"), strand(deleted_bases()))).otherwise("")
        return cells.withColumns({"cell": F.concat(head, base, ins, gap, F.when(F.col("tail"), "$").otherwise("")), "mark": printable(F.col("q"))})

    def aggregates(self) -> list[Column]:
        return [F.collect_list(F.when(F.col("ok"), F.struct("read_ord", "cell", "mark"))).alias("found")]

    def finish(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("found", F.sort_array("found"))  # compiled, where array_sort calls a lambda for each comparison
        # the field of an array of structs is the array of that field
        return rows.select(*KEYS, F.size("found").alias("depth"), F.array_join("found.cell", "").alias("bases"), F.array_join("found.mark", "").alias("quals"))

    def empty(self) -> dict[str, Column]:
        return {"depth": F.lit(0), "bases": F.lit(""), "quals": F.lit("")}

    def text(self) -> Column:
        starred = [F.when(F.col(c) == "", "*").otherwise(F.col(c)) for c in ("bases", "quals")]
        return F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "ref", F.col("depth").cast("string"), *starred)


CLASSES = ("a", "g", "c", "t", "n")


class Histogram:
    """Counts of bases, gaps and skips, and of distinct insertions and deletions in the order they are first seen."""

    dealt = False

    def __init__(self, strict: bool = True):
        self.strict = strict

    def columns(self, cells: DataFrame) -> DataFrame:
        base = F.when(F.col("base") == "", "n").otherwise(F.lower("base"))
        other = F.raise_error(F.concat(F.lit("a base is none of A, C, G, T and N: "), "base")).cast("string") if self.strict else F.lit("n")
        kind = F.when(F.col("skipped"), "refskip").when(F.col("deleted"), "gap").when(base.isin(*CLASSES), base).when(F.col("ok"), other)
        return cells.withColumns({"kind": kind, "inserted": F.when(F.col("ok") & (F.col("ins") != ""), F.struct("read_ord", F.upper("ins").alias("seq"))), "lost": F.when(F.col("ok") & (F.col("gap") > 0), F.struct("read_ord", deleted_bases().alias("seq")))})

    def aggregates(self) -> list[Column]:
        counts = [F.count_if(F.col("ok")).alias("depth"), *(F.count_if(F.col("ok") & (F.col("kind") == k)).alias(k) for k in (*CLASSES, "gap", "refskip"))]
        return [*counts, F.collect_list("inserted").alias("inserted"), F.collect_list("lost").alias("lost")]

    def finish(self, rows: DataFrame) -> DataFrame:
        def counted(name: str) -> Column:
            seqs = F.transform(F.sort_array(F.col(name)), lambda x: x["seq"])
            return F.transform(F.array_distinct(seqs), lambda s: F.struct(F.size(F.filter(seqs, lambda x: x == s)).alias("cnt"), s.alias("seq")))

        return rows.withColumns({"insertions": counted("inserted"), "deletions": counted("lost")}).drop("inserted", "lost")

    def empty(self) -> dict[str, Column]:
        none = F.array().cast("array<struct<cnt:int,seq:string>>")
        return {**{k: F.lit(0).cast("long") for k in ("depth", *CLASSES, "gap", "refskip")}, "insertions": none, "deletions": none}

    def text(self) -> Column:
        def listed(name: str) -> Column:
            return F.concat(F.lit("["), F.array_join(F.transform(name, lambda x: F.concat(x["cnt"].cast("string"), x["seq"])), " "), F.lit("]"))

        return F.concat_ws("\t", "chrom", *(F.col(c).cast("string") for c in ("pos", "depth", *CLASSES, "gap", "refskip")), listed("insertions"), listed("deletions"))
