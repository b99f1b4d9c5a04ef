"""Tables in the folder that driver and executors share, and the size of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may name none, and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="covagrid-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes of rows that go to a Python worker at once; a batch of ten thousand long texts would take a multiple of this memory.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold up to BATCH_BYTES, or less if it says so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, f"{BATCH_BYTES + 1}b"))) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is still there when the process ends is deleted then."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/covagrid-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.unregister(_sweep)
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        release(spark, made())


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it again, which ends its lineage."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """The scratch tables of this process that nothing has deleted."""
    return list(_made)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; only for callers that know nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _made.remove(path)


#: Bytes of a table that may be sent to every task.
SENT_BYTES = 8 << 20


def sized(written: DataFrame, most: int = SENT_BYTES) -> DataFrame:
    """A written table with a hint for joins: sent to every task if its values take up to `most` bytes, else merged."""
    widths = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16) * F.greatest(F.size(f.name), F.lit(0)) if isinstance(f.dataType, T.ArrayType) else F.lit(8) for f in written.schema.fields]
    bytes_ = written.agg(F.sum(sum(widths, F.lit(16)))).first()[0] or 0
    return F.broadcast(written) if bytes_ <= most else written.hint("merge")
