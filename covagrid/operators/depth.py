"""The depth cap: later reads are dropped where too many earlier ones are still in view."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024


def cap_depth(reads: DataFrame, most: int) -> DataFrame:
    """`reads` without those that come when `most` admitted reads are live; 0 is no cap.

    A read is live until the position after its last has passed, and the first read of a position always enters. Only
    where a bin and its left neighbour's edge could hold `most` reads can the cap bind; runs of such bins are islands.
    Each island is swept in order of position and file, with the ends of live reads in a heap of at most about `most`;
    reads that start elsewhere are admitted and only seen by the islands they reach into.
    """
    if not most:
        return reads
    first, last = F.floor(F.col("pos") / BIN), F.floor(F.col("stop") / BIN)  # one past the end: it is live there
    full = reads.select("tid", F.explode(F.sequence(first, last)).alias("bin")).groupBy("tid", "bin").count().filter(F.col("count") >= most)
    ordered = Window.partitionBy("tid").orderBy("bin")
    islands = full.withColumn("fresh", (F.col("bin") - F.lag("bin", 1, -2).over(ordered) > 1).cast("long")).withColumn("island", F.sum("fresh").over(ordered))
    islands = islands.select(F.col("tid").alias("island_tid"), F.col("bin").alias("island_bin"), "island")
    touched = reads.withColumn("touch", F.explode(F.sequence(first, last))).join(islands, (F.col("tid") == F.col("island_tid")) & (F.col("touch") == F.col("island_bin")))
    mine = touched.withColumn("starts", F.col("touch") == first)
    once = mine.groupBy("tid", "island", "read_ord").agg(F.max("starts").alias("starts"), F.min("pos").alias("pos"), F.min("stop").alias("stop"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, at, here = None, [], None, 0
        for batch in batches:
            dropped = []
            for tid, island, read_ord, starts, pos, stop in zip(*(batch.column(n).to_pylist() for n in ("tid", "island", "read_ord", "starts", "pos", "stop")), strict=True):
                if (tid, island) != key:
                    key, ends, at = (tid, island), [], None
                if pos != at:
                    at, here = pos, 0
                    while ends and ends[0] < pos:  # reads that end just before are still counted
                        heapq.heappop(ends)
                if starts and here and len(ends) >= most:
                    dropped.append((tid, read_ord))
                    continue
                heapq.heappush(ends, stop)
                here += 1
            if dropped:
                yield pa.RecordBatch.from_arrays([pa.array(np.array([d[k] for d in dropped]), t) for k, t in ((0, pa.int32()), (1, pa.int64()))], ["drop_tid", "drop_ord"])

    swept = once.select("tid", "island", "read_ord", "starts", "pos", "stop").repartition("tid", "island").sortWithinPartitions("tid", "island", "pos", "read_ord").mapInArrow(sweep, "drop_tid int, drop_ord long")
    return reads.join(swept, (F.col("tid") == F.col("drop_tid")) & (F.col("read_ord") == F.col("drop_ord")), "left_anti")
