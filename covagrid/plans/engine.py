"""The pileup as one lazy plan: filter, rewrite qualities, cap, expand to cells, aggregate, fill coordinates, order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from covagrid.errors import UnsortedInput
from covagrid.operators.cells import explode_cells, explode_operations
from covagrid.operators.depth import cap_depth
from covagrid.operators.filters import filter_reads, in_intervals, unsorted_reads
from covagrid.operators.outputs import KEYS, Histogram, Pileup, PileupOutput
from covagrid.operators.qualities import apply_bq, merge_overlaps
from covagrid.operators.realign import reach, realign
from covagrid.params import BY_REFERENCE, COVERED, PileupParams
from covagrid.scratch import release, scratch_path
from covagrid.sources.fasta import build_index, chunked, read_fasta
from covagrid.sources.regions import resolve
from covagrid.sources.sam import is_bam, read_sam


class PileupEngine:
    """Settings and a reference; `submit` gives it reads.

    reference: the path of a FASTA file, or a table (name, seq).
    """

    def __init__(self, spark: SparkSession, params: PileupParams = PileupParams(), reference: str | DataFrame | None = None):
        self.spark, self.params, self.reference = spark, params, reference

    def submit(self, source: str | DataFrame, refs: list[tuple[int, str, int]] | None = None) -> PileupQuery:
        """source: the path of a SAM or BAM file, told apart by how it begins, or a table of reads with its references (tid, name, length).

        SAM files must be sorted, which one pass over reference and position of their reads checks; an index says so of BAM.
        """
        if isinstance(source, str):
            if is_bam(source):
                from covagrid.sources.bam import read_bam

                source, refs = read_bam(self.spark, source, self.params.regions)
            else:
                source, refs = read_sam(self.spark, source)
                wrong = unsorted_reads(source).first()
                if wrong is not None:
                    raise UnsortedInput(f"the read at {refs[wrong['tid']][1]}:{wrong['pos'] + 1} starts before the one ahead of it")
        return PileupQuery(self, source, refs or [])


class PileupQuery:
    def __init__(self, engine: PileupEngine, reads: DataFrame, refs: list[tuple[int, str, int]]):
        self.engine, self.reads, self.refs = engine, reads, refs
        self.intervals = resolve(engine.spark, refs, engine.params.regions)

    def usable_reads(self) -> DataFrame:
        """The reads that count, with the qualities that count."""
        params, reference = self.engine.params, self.engine.reference
        reads = cap_depth(filter_reads(self.reads, params), params.max_depth)  # by places alone, so ahead of what costs more
        if reference is not None and not params.no_baq:
            # as many names as there are references
            names = [r[0] for r in build_index(reference)] if isinstance(reference, str) else [r[0] for r in reference.select("name").distinct().collect()]
            known = F.coalesce(F.col("rname").isin(*names), F.lit(False))
            needed = known if params.redo_baq else known & F.col("bq").isNull()
            if not params.redo_baq:
                reads = apply_bq(reads, known)
            farthest = filter_reads(self.reads, params).filter(needed).agg(F.max(reach())).first()[0]
            if farthest is not None:  # some read has no tag to go by
                reads = realign(reads, self._chunks(int(farthest) + params.bin_width), needed, params.bin_width)
        return reads if params.ignore_overlaps else merge_overlaps(reads)

    def _chunks(self, ahead: int) -> DataFrame | None:
        reference, width = self.engine.reference, self.engine.params.bin_width
        if reference is None:
            return None
        rows = read_fasta(self.engine.spark, reference, width, ahead) if isinstance(reference, str) else chunked(reference, width, ahead)
        return rows.select(F.col("name").alias("ref_name"), F.col("chunk").alias("ref_bin"), F.col("seq").alias("ref_seq"))

    def cells(self, dealt: bool = True) -> DataFrame:
        """A row for each read and position that the intervals cover; `ok` if its quality suffices."""
        params = self.engine.params
        keep = ["read_ord", "tid", "pos", "stop", "mapq", "flag", "cigar", "seq", "qual"]
        reads = in_intervals(self.usable_reads().select(keep), self.intervals, params.bin_width)
        if dealt:  # reads are shuffled, not cells: grouping by (interval, bin, p) needs no other exchange
            reads = reads.repartition("interval_ord", "bin")
        ops = explode_operations(reads)
        if self.engine.reference is not None:
            longest = self.reads.select(F.max(F.aggregate("cigar", F.lit(0), lambda t, x: t + F.when(x["op"] == "D", x["len"]).otherwise(0)))).first()[0] or 0
            chunks = self._chunks(int(longest) + 1)
            ops = ops.join(chunks, (F.col("name") == F.col("ref_name")) & (F.col("bin") == F.col("ref_bin")), "left")
            ops = ops.withColumn("ref_part", F.expr(f"substring(ref_seq, cast(`from` - bin * {params.bin_width} + 1 as int), cast(`to` - `from` + gap + 1 as int))")).drop("ref_seq", "ref_name", "ref_bin")
        else:
            ops = ops.withColumn("ref_part", F.lit(None).cast("string"))
        cells = explode_cells(ops, ["interval_ord", "bin", "from", "ref_part"])
        return cells.withColumn("ok", F.col("q") >= params.min_base_quality)

    def rows(self, output: PileupOutput) -> DataFrame:
        """A row for each position with cells, before coordinates are filled."""
        cells = output.columns(self.cells(output.dealt))
        return output.finish(cells.groupBy(*KEYS).agg(*output.aggregates()))

    def spine(self) -> DataFrame:
        """Every coordinate of every interval, cut at bins so that no task makes a long sequence."""
        width = self.engine.params.bin_width
        bins = self.intervals.filter("stop > start").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
        return bins.withColumn("p", F.explode(F.sequence(F.greatest("start", F.col("bin") * width), F.least("stop", (F.col("bin") + 1) * width) - 1))).select(*KEYS)

    def to_df(self, output: PileupOutput) -> DataFrame:
        """interval_ord, chrom, pos (from 1), ref and the output's columns; not sorted."""
        params, rows = self.engine.params, self.rows(output)
        if params.emit != COVERED:
            spine = self.spine()
            if params.emit == BY_REFERENCE:
                spine = spine.join(rows.select("interval_ord").distinct(), "interval_ord", "left_semi")
            empty = output.empty()
            rows = spine.join(rows, [*KEYS], "left").select(*KEYS, *(F.coalesce(F.col(c), empty[c]).alias(c) for c in rows.columns if c not in KEYS))
        rows = rows.join(self.intervals.select("interval_ord", F.col("name").alias("chrom")), "interval_ord")
        chunks, width = self._chunks(0), params.bin_width
        if chunks is not None:
            rows = rows.join(chunks, (F.col("chrom") == F.col("ref_name")) & (F.col("bin") == F.col("ref_bin")), "left")
            base = F.expr(f"substring(ref_seq, cast(p - bin * {width} + 1 as int), 1)")
            ref = F.when(F.coalesce(base, F.lit("")) == "", "N").otherwise(base)
        else:
            ref = F.lit("N")
        others = [c for c in rows.columns if c not in (*KEYS, "chrom", "ref_name", "ref_bin", "ref_seq")]
        return rows.select("interval_ord", "chrom", (F.col("p") + 1).alias("pos"), ref.alias("ref"), *others)

    def plp(self) -> DataFrame:
        return self.to_df(Pileup())

    def histo(self) -> DataFrame:
        return self.to_df(Histogram(self.engine.params.strict))

    def text(self, output: PileupOutput) -> DataFrame:
        """The lines in order: by interval as asked for, then position."""
        return self.to_df(output).orderBy("interval_ord", "pos").select(output.text().alias("value"))

    def write(self, path: str, output: PileupOutput) -> None:
        """Ordered part files; what lies at `path` is replaced.

        The lines are written to the shared folder ahead of the sort, whose sampling would compute all cells once more.
        """
        spark = self.engine.spark
        held = scratch_path(spark, "lines")
        self.to_df(output).select("interval_ord", "pos", output.text().alias("value")).write.parquet(held)
        spark.read.schema("interval_ord int, pos long, value string").parquet(held).orderBy("interval_ord", "pos").select("value").write.mode("overwrite").text(path)
        release(spark, [held])

    def iterate(self, output: PileupOutput) -> Iterator[Row]:
        """The rows in order, one partition at a time."""
        return self.to_df(output).orderBy("interval_ord", "pos").toLocalIterator()
