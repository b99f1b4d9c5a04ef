"""Helpers that the corpus operators share: tables in the shared folder, Arrow batches, byte texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covagrid.scratch import BATCH_BYTES, SENT_BYTES, bound_batches, cut, made, release, scratch_path, shared_dir, sized  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(pc.cast(column, kind), b"").to_pylist()


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a function of one batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, mask: Callable[[pa.Array], list[bool]]) -> DataFrame:
    """The rows of `df`, all columns, for which `mask` of the text column says so."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(mask(batch.column("text")), pa.bool_()))

    return map_batches(df, each, df.schema)


def keep_numbered(rows: DataFrame, numbers: DataFrame, tag: str, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None, schema=None) -> DataFrame:
    """The rows of `rows` whose row_no is in `numbers`, without a shuffle of `rows`; or what `each` makes of them.

    row_no comes from monotonically_increasing_id, so it rises within each task's part of a written table. The numbers
    are sorted and written; a task then reads only the files whose range its own rows touch, by an index that has a
    row for each file.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, tag)
    numbers.select("row_no").repartitionByRange("row_no").sortWithinPartitions("row_no").write.parquet(path)
    stored = spark.read.schema("row_no long").parquet(path)
    index = sorted((r[1], r[2], r[0]) for r in stored.groupBy(F.input_file_name()).agg(F.min("row_no"), F.max("row_no")).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=2)
        def held(uri: str) -> np.ndarray:
            files, place = fs.FileSystem.from_uri(uri)
            return pq.read_table(place, columns=["row_no"], filesystem=files).column("row_no").to_numpy()

        for batch in batches:
            mine = batch.column("row_no").to_numpy()
            keep = np.zeros(len(mine), bool)
            for part in np.unique(mine >> 33):  # a task may read the parts of several writers
                own = (mine >> 33) == part
                low, high = mine[own].min(), mine[own].max()
                for first, last, uri in index:
                    if first <= high and last >= low:
                        keep |= own & np.isin(mine, held(uri))
            if keep.any():
                kept = batch.filter(pa.array(keep))
                if each is None:
                    yield kept
                else:  # here and not in a second map, which would keep a second worker busy
                    yield from each(kept)

    return rows.mapInArrow(run, rows.schema if each is None else schema)
