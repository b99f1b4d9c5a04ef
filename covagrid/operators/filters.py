"""Which reads count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covagrid.params import Flag, PileupParams

SPANNING = ("M", "D", "N", "=", "X")
QUERY = ("M", "I", "S", "=", "X")


def has(flag: Flag) -> Column:
    return F.col("flag").bitwiseAND(F.lit(int(flag))) != 0


def span(cigar: Column, ops: tuple[str, ...] = SPANNING) -> Column:
    """The lengths of the operations in `ops`, added up."""
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda total, x: total + F.when(x["op"].isin(*ops), x["len"]).otherwise(0))


def admissible(params: PileupParams) -> Column:
    """Mapped reads with a mapped mate that pass the flag masks, the orphan rule and the mapping quality."""
    keep = ~has(Flag.UNMAPPED) & ~has(Flag.MATE_UNMAPPED) & (F.col("mapq") >= params.min_mapping_quality)
    if not params.count_orphans:
        keep = keep & ~(has(Flag.PAIRED) & ~has(Flag.PROPER_PAIR))
    if params.include_flags:
        keep = keep & (F.col("flag").bitwiseAND(F.lit(params.include_flags)) != 0)
    if params.exclude_flags:
        keep = keep & (F.col("flag").bitwiseAND(F.lit(params.exclude_flags)) == 0)
    return keep


def filter_reads(reads: DataFrame, params: PileupParams) -> DataFrame:
    """Reads that count, with `stop`, the position after their last."""
    return reads.filter(admissible(params)).withColumn("stop", F.col("pos") + span(F.col("cigar"))).filter("stop > pos and tid >= 0")


def in_intervals(reads: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """A row for each read, interval that it overlaps and bin of `width` positions that both touch: lo to hi of them.

    Intervals are cut to bins too, so the join is by equal (tid, bin) whatever their number.
    """
    spread = reads.withColumn("bin", F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.col("stop") - 1) / width))))
    cells = intervals.filter("stop > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    cells = cells.select("interval_ord", F.col("tid").alias("cell_tid"), "name", F.col("bin").alias("cell_bin"), F.greatest("start", F.col("bin") * width).alias("from"), F.least("stop", (F.col("bin") + 1) * width).alias("to"))
    joined = spread.join(cells, (spread["tid"] == cells["cell_tid"]) & (spread["bin"] == cells["cell_bin"]))
    return joined.withColumns({"lo": F.greatest("pos", "from"), "hi": F.least("stop", "to")}).filter("hi > lo").drop("cell_tid", "cell_bin", "from", "to")


def unsorted_reads(reads: DataFrame) -> DataFrame:
    """Reads that start before the read ahead of them in the file, or on an earlier reference.

    Neighbours are compared within blocks of read_ord, then the blocks' ends within blocks of blocks, and so on: four
    levels of 16 bits hold all, and no task holds more than a block of what the level below left.
    """
    read = F.struct("read_ord", "tid", "pos")
    level = reads.filter("tid >= 0").select(F.col("read_ord").alias("key"), read.alias("first"), read.alias("last"))
    found = None
    for _ in range(4):
        level = level.withColumn("above", F.shiftright("key", 16))
        ahead = level.withColumn("ahead", F.lag("last").over(Window.partitionBy("above").orderBy("key")))
        wrong = ahead.filter(F.struct("ahead.tid", "ahead.pos") > F.struct("first.tid", "first.pos")).select("first.*")
        found = wrong if found is None else found.unionByName(wrong)
        level = level.groupBy("above").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumnRenamed("above", "key")
    return found


def mean_read_length(reads: DataFrame, first: int = 10) -> DataFrame:
    """The mean length of the first reads' sequences, 0 without reads."""
    return reads.orderBy("read_ord").limit(first).agg(F.coalesce(F.floor(F.avg(F.length("seq"))), F.lit(0)).alias("mean_length"))
