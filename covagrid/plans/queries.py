"""The registered pileup queries over the read view, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covagrid.operators.depth import cap_depth
from covagrid.operators.filters import admissible, filter_reads, in_intervals, mean_read_length, span, unsorted_reads
from covagrid.operators.cells import operations
from covagrid.operators.qualities import apply_bq, merge_overlaps
from covagrid.params import BY_REFERENCE, EVERYTHING, Flag, PileupParams
from covagrid.plans import file_queries
from covagrid.plans.engine import PileupEngine, PileupQuery
from covagrid.plans.read_view import CELLS_SQL, GAP, INS, PLP_SQL, REFS, read_view, reference
from covagrid.sources.regions import chunks, resolve

REGIONS = "NO:100-220,AF:50,RF:1000-1100,RF:1050-1200"
_PLAIN = {"ignore_overlaps": True, "no_baq": True, "max_depth": 0, "bin_width": 100}  # few coordinates, each deep


def _query(spark: SparkSession, sf_dir: str, with_reference: bool = False, **params) -> PileupQuery:
    engine = PileupEngine(spark, PileupParams(**(_PLAIN | params)), reference(spark) if with_reference else None)
    return engine.submit(read_view(spark, sf_dir), REFS)


def _brief(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("chrom", "pos", F.col("depth").cast("long").alias("depth"), *more)


def flag_filter(spark, sf_dir):
    params = PileupParams(include_flags=int(Flag.REVERSE | Flag.PAIRED), exclude_flags=int(Flag.DUPLICATE), count_orphans=True)
    return read_view(spark, sf_dir).filter(admissible(params)).groupBy("rname", "flag").agg(F.count(F.lit(1)).alias("n"))


def orphan_filter(spark, sf_dir):
    return read_view(spark, sf_dir).filter(admissible(PileupParams(exclude_flags=0))).groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").alias("mapq_sum"))


def mapq_filter(spark, sf_dir):
    return read_view(spark, sf_dir).filter(admissible(PileupParams(min_mapping_quality=30))).groupBy("mapq").agg(F.count(F.lit(1)).alias("n"))


def ref_span(spark, sf_dir):
    return read_view(spark, sf_dir).select("rname", span(F.col("cigar")).alias("span")).groupBy("rname", "span").agg(F.count(F.lit(1)).alias("n"))


def cigar_operations(spark, sf_dir):
    kept = filter_reads(read_view(spark, sf_dir), PileupParams())
    rows = kept.select("rname", "pos", F.explode(operations(F.col("cigar"))).alias("o")).filter(F.col("o.op").isin("M", "D", "N"))
    return rows.groupBy("rname", "o.op").agg(F.count(F.lit(1)).alias("n"), F.sum("o.len").alias("len_sum"), F.sum("o.ref_off").alias("ref_sum"), F.sum("o.query_off").alias("query_sum"))


def region_resolve(spark, sf_dir):
    return resolve(spark, REFS, REGIONS).select(F.col("interval_ord").cast("long").alias("interval_ord"), "name", "start", "stop")


def region_overlap(spark, sf_dir):
    reads = in_intervals(filter_reads(read_view(spark, sf_dir), PileupParams()), resolve(spark, REFS, REGIONS), 64)
    return reads.groupBy(F.col("interval_ord").cast("long").alias("interval_ord")).agg(F.count_distinct("read_ord").alias("n_reads"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))


def cover_explode(spark, sf_dir):
    cells = _query(spark, sf_dir).cells(dealt=False)
    return cells.groupBy((F.col("p") + 1).alias("pos")).agg(F.count(F.lit(1)).alias("cells"), F.sum("q").alias("q_sum"), F.count_if("head").alias("heads"), F.count_if("tail").alias("tails"), F.count_if("deleted").alias("gaps"), F.count_if("skipped").alias("skips"))


def depth_covered(spark, sf_dir):
    return _brief(_query(spark, sf_dir, min_base_quality=0).histo())


def depth_min_quality(spark, sf_dir):
    return _brief(_query(spark, sf_dir, min_base_quality=30).histo())


def depth_regions(spark, sf_dir):
    rows = _query(spark, sf_dir, regions=REGIONS).histo()
    return rows.select(F.col("interval_ord").cast("long").alias("interval_ord"), "chrom", "pos", F.col("depth").cast("long").alias("depth"))


def emit_by_reference(spark, sf_dir):
    return _brief(_query(spark, sf_dir, emit=BY_REFERENCE).histo())


def emit_everything(spark, sf_dir):
    return _brief(_query(spark, sf_dir, emit=EVERYTHING, with_reference=True).histo(), "ref")


def histo_counts(spark, sf_dir):
    rows = _query(spark, sf_dir).histo()
    return rows.select("chrom", "pos", *(F.col(c).cast("long").alias(c) for c in ("depth", "a", "g", "c", "t", "n", "gap", "refskip")))


def histo_indels(spark, sf_dir):
    rows = _query(spark, sf_dir, with_reference=True).histo()
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat(x["cnt"].cast("string"), x["seq"]))), " ").alias(c)
    return rows.select("chrom", "pos", listed("insertions"), listed("deletions")).filter("insertions <> '' or deletions <> ''")


def plp_text(spark, sf_dir):
    return _query(spark, sf_dir, with_reference=True).plp().select("chrom", "pos", "ref", F.col("depth").cast("long").alias("depth"), "bases", "quals")


def baq_apply(spark, sf_dir):
    reads = read_view(spark, sf_dir).withColumn("bq", F.expr("array_join(transform(qual, (q, i) -> chr(64 + (q + i) % 7)), '')"))
    return apply_bq(reads, F.col("rname") != "NO").groupBy("rname").agg(F.sum(F.aggregate("qual", F.lit(0).cast("long"), lambda t, q: t + q)).alias("q_sum"))


def plp_default(spark, sf_dir):
    """The pileup with what is on by default: base alignment qualities from the model, merged mates, the depth cap."""
    return _brief(_query(spark, sf_dir, with_reference=True, ignore_overlaps=False, no_baq=False, max_depth=8000).plp(), "ref", "bases", "quals")


def baq_realign(spark, sf_dir):
    """Qualities of all reads after the model alone."""
    reads = _query(spark, sf_dir, with_reference=True, no_baq=False).usable_reads()
    return reads.groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("qual", F.lit(0).cast("long"), lambda t, q: t + q)).alias("q_sum"))


def overlap_rewrite(spark, sf_dir):
    reads = merge_overlaps(filter_reads(read_view(spark, sf_dir), PileupParams()))
    return reads.groupBy("rname").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("qual", F.lit(0).cast("long"), lambda t, q: t + q)).alias("q_sum"))


def depth_cap(spark, sf_dir):
    reads = cap_depth(filter_reads(read_view(spark, sf_dir), PileupParams()), 20)
    return reads.groupBy("rname", "pos").agg(F.count(F.lit(1)).alias("n"))


def sort_check(spark, sf_dir):
    """Lines in the order of their orders are not in the order of their positions."""
    number = F.col("qname").cast("long") * 8 + F.col("read_ord") % 8
    once = read_view(spark, sf_dir).groupBy(number.alias("read_ord")).agg(F.min("pos").alias("pos")).withColumn("tid", F.lit(0))
    return unsorted_reads(once).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


def read_length_sample(spark, sf_dir):
    rows = mean_read_length(read_view(spark, sf_dir), 10)
    return rows.select(F.col("mean_length").cast("long").alias("mean_length"))


def interval_chunks(spark, sf_dir):
    return spark.createDataFrame([(n, a, b) for n in (2700, 1_000_000) for a, b in chunks(n, 3)], "length long, start long, stop long")


_MASK = "flag & 1796 = 0 AND NOT (flag & 1 = 1 AND flag & 2 = 0)"
_INTERVALS = "intervals(interval_ord, name, start, stop) AS (VALUES (0::BIGINT, 'NO', 99::BIGINT, 220::BIGINT), (1, 'AF', 49, 2700), (2, 'RF', 999, 1100), (3, 'RF', 1049, 1200))"
_COORDINATES = "spine AS (SELECT name AS chrom, tid, unnest(range(2700)) AS p FROM (VALUES ('AF', 0), ('AO', 1), ('NF', 2), ('NO', 3), ('RF', 4), ('RO', 5)) v(name, tid))"
_DEPTH = f"{CELLS_SQL} SELECT rname AS chrom, p + 1 AS pos, count(*) FILTER (WHERE quality >= {{0}}) AS depth FROM cells GROUP BY rname, p"
_INDELS = "coalesce((SELECT string_agg(c || s, ' ' ORDER BY c || s) FROM (SELECT count(*)::VARCHAR AS c, s FROM unnest({0}) u(s) GROUP BY s)), '')"

#: Reads of one (reference, name) in order, one waiting at a time: a read meets the waiting one or waits itself.
OVERLAP_SQL = (
    "WITH RECURSIVE" + CELLS_SQL.lstrip().removeprefix("WITH")
    + """, paired AS (SELECT *, row_number() OVER (PARTITION BY tid, l_orderkey ORDER BY read_ord, l_partkey, l_suppkey) AS nth FROM kept WHERE flag & 2 = 2),
walk AS (
  SELECT tid, l_orderkey, 0::BIGINT AS nth, 0::BIGINT AS waits, 0::BIGINT AS with_nth, 0::BIGINT AS waits_to FROM (SELECT DISTINCT tid, l_orderkey FROM paired)
  UNION ALL
  SELECT w.tid, w.l_orderkey, p.nth, CASE WHEN w.waits > 0 AND w.waits_to > p.pos THEN 0 ELSE p.nth END, CASE WHEN w.waits > 0 AND w.waits_to > p.pos THEN w.waits ELSE 0 END, p.stop
  FROM walk w JOIN paired p ON p.tid = w.tid AND p.l_orderkey = w.l_orderkey AND p.nth = w.nth + 1
), mates AS (
  SELECT a.tid, a.rname, a.l_orderkey, a.read_ord AS a_ord, a.l_partkey AS a_part, a.l_suppkey AS a_supp, b.read_ord AS b_ord, b.l_partkey AS b_part, b.l_suppkey AS b_supp,
         list_reduce(list_transform(string_split(a.l_orderkey::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda h, x: (h * 31 + x) & 4294967295) AS h0
  FROM walk w JOIN paired a ON a.tid = w.tid AND a.l_orderkey = w.l_orderkey AND a.nth = w.with_nth JOIN paired b ON b.tid = w.tid AND b.l_orderkey = w.l_orderkey AND b.nth = w.nth WHERE w.with_nth > 0
), h1 AS (SELECT *, (h0 - (h0 << 15) - 1) & 4294967295 AS v FROM mates), h2 AS (SELECT * REPLACE (xor(v, v >> 10) AS v) FROM h1), h3 AS (SELECT * REPLACE ((v + (v << 3)) & 4294967295 AS v) FROM h2),
h4 AS (SELECT * REPLACE (xor(v, v >> 6) AS v) FROM h3), h5 AS (SELECT * REPLACE ((v - (v << 11) - 1) & 4294967295 AS v) FROM h4), named AS (SELECT *, xor(v, v >> 16) & 1 = 1 AS keeps FROM h5),
lined AS (SELECT *, (l_suppkey + 3 * q) % 42 AS own FROM cells),
met AS (
  SELECT m.rname, m.keeps, a.op AS a_op, b.op AS b_op, a.own AS x, b.own AS y, a.base = b.base AS same
  FROM named m JOIN lined a ON a.tid = m.tid AND a.read_ord = m.a_ord AND a.l_partkey = m.a_part AND a.l_suppkey = m.a_supp JOIN lined b ON b.tid = m.tid AND b.read_ord = m.b_ord AND b.l_partkey = m.b_part AND b.l_suppkey = m.b_supp AND b.p = a.p
), changes AS (
  SELECT rname, CASE WHEN a_op = 'M' AND b_op = 'M' THEN CASE WHEN same THEN least(x + y, 200) ELSE floor(greatest(x, y)::DOUBLE * 0.8::DOUBLE) END - x - y
                     WHEN a_op = 'M' AND b_op = 'D' THEN CASE WHEN keeps THEN floor(x::DOUBLE * 0.8::DOUBLE) ELSE 0 END - x
                     WHEN a_op = 'D' AND b_op = 'M' THEN CASE WHEN keeps THEN 0 ELSE floor(y::DOUBLE * 0.8::DOUBLE) END - y ELSE 0 END AS change
  FROM met
)
SELECT rname, count(*) AS n, (sum(q_all) + coalesce((SELECT sum(change) FROM changes c WHERE c.rname = k.rname), 0))::BIGINT AS q_sum
FROM (SELECT rname, list_sum([(l_suppkey + 3 * i) % 42 for i in range(n)]) AS q_all FROM kept) k GROUP BY rname
"""
)
#: At each position as many of its reads enter as the cap leaves room for, one at least; a read leaves after the position past its end.
CAP_SQL = (
    "WITH RECURSIVE" + CELLS_SQL.lstrip().removeprefix("WITH")
    + """, starts AS (SELECT rname, pos, list(stop ORDER BY read_ord) AS stops FROM kept GROUP BY rname, pos),
walk AS (
  SELECT rname, -1::BIGINT AS place, []::BIGINT[] AS live, 0::BIGINT AS n FROM (SELECT DISTINCT rname FROM kept)
  UNION ALL
  SELECT rname, place + 1, list_concat(live, stops[1 : enter]), enter
  FROM (SELECT *, CASE WHEN len(stops) = 0 THEN 0 ELSE least(len(stops), greatest(1, 20 - len(live))) END AS enter
        FROM (SELECT w.rname, w.place, list_filter(w.live, lambda e: e >= w.place + 1) AS live, coalesce(s.stops, []) AS stops FROM walk w LEFT JOIN starts s ON s.rname = w.rname AND s.pos = w.place + 1 WHERE w.place < 2700))
)
SELECT rname, place AS pos, n FROM walk WHERE n > 0
"""
)

SQL = {
    "flag_filter": f"{CELLS_SQL} SELECT rname, flag, count(*) AS n FROM reads WHERE flag & 17 <> 0 AND flag & 1024 = 0 GROUP BY rname, flag",
    "orphan_filter": f"{CELLS_SQL} SELECT rname, count(*) AS n, sum(mapq)::BIGINT AS mapq_sum FROM reads WHERE NOT (flag & 1 = 1 AND flag & 2 = 0) GROUP BY rname",
    "mapq_filter": f"{CELLS_SQL} SELECT mapq, count(*) AS n FROM kept WHERE mapq >= 30 GROUP BY mapq",
    "ref_span": f"{CELLS_SQL} SELECT rname, stop - pos AS span, count(*) AS n FROM spans GROUP BY rname, stop - pos",
    "cigar_operations": f"{CELLS_SQL} SELECT rname, op, count(*) AS n, sum(len)::BIGINT AS len_sum, sum(ref_off)::BIGINT AS ref_sum, sum(query_off)::BIGINT AS query_sum FROM segments GROUP BY rname, op",
    "region_resolve": f"WITH {_INTERVALS} SELECT * FROM intervals",
    "region_overlap": f"{CELLS_SQL}, {_INTERVALS} SELECT interval_ord, count(DISTINCT read_ord) AS n_reads, sum(least(k.stop, v.stop) - greatest(pos, start))::BIGINT AS covered FROM kept k JOIN intervals v ON k.rname = v.name AND k.pos < v.stop AND k.stop > v.start GROUP BY interval_ord",
    "cover_explode": f"{CELLS_SQL} SELECT p + 1 AS pos, count(*) AS cells, sum(quality)::BIGINT AS q_sum, count(*) FILTER (WHERE p = pos) AS heads, count(*) FILTER (WHERE p = stop - 1) AS tails, count(*) FILTER (WHERE op = 'D') AS gaps, count(*) FILTER (WHERE op = 'N') AS skips FROM cells GROUP BY cells.p",
    "depth_covered": _DEPTH.format(0),
    "depth_min_quality": _DEPTH.format(30),
    "depth_regions": f"{CELLS_SQL}, {_INTERVALS} SELECT interval_ord, rname AS chrom, p + 1 AS pos, count(*) FILTER (WHERE quality >= 13) AS depth FROM cells JOIN intervals v ON rname = v.name AND p >= start AND p < v.stop GROUP BY interval_ord, rname, p",
    "emit_by_reference": f"{CELLS_SQL}, {_COORDINATES} SELECT s.chrom, s.p + 1 AS pos, count(*) FILTER (WHERE quality >= 13) AS depth FROM spine s LEFT JOIN cells c ON c.rname = s.chrom AND c.p = s.p WHERE s.chrom IN (SELECT rname FROM kept) GROUP BY s.chrom, s.p",
    "emit_everything": f"{CELLS_SQL}, {_COORDINATES} SELECT s.chrom, s.p + 1 AS pos, count(*) FILTER (WHERE quality >= 13) AS depth, substr('ACGT', ((5 * s.p + min(s.tid)) % 4 + 1)::INT, 1) AS ref FROM spine s LEFT JOIN cells c ON c.rname = s.chrom AND c.p = s.p GROUP BY s.chrom, s.p",
    "histo_counts": f"{CELLS_SQL} SELECT rname AS chrom, p + 1 AS pos, count(*) FILTER (WHERE quality >= 13) AS depth, "
    + ", ".join(f"count(*) FILTER (WHERE quality >= 13 AND op = 'M' AND base = '{b.upper()}') AS {b}" for b in "agctn")
    + ", count(*) FILTER (WHERE quality >= 13 AND op = 'D') AS gap, count(*) FILTER (WHERE quality >= 13 AND op = 'N') AS refskip FROM cells GROUP BY rname, p",
    "histo_indels": f"{CELLS_SQL}, g AS (SELECT rname AS chrom, p + 1 AS pos, coalesce(list({INS}) FILTER (WHERE ins AND quality >= 13), []) AS i, coalesce(list({GAP}) FILTER (WHERE gap > 0 AND quality >= 13), []) AS d FROM cells GROUP BY rname, p) "
    f"SELECT chrom, pos, {_INDELS.format('i')} AS insertions, {_INDELS.format('d')} AS deletions FROM g WHERE len(i) > 0 OR len(d) > 0",
    "plp_text": PLP_SQL,
    "baq_apply": f"{CELLS_SQL} SELECT rname, sum(CASE WHEN rname = 'NO' THEN q ELSE greatest(q - (q + i) % 7, 0) END)::BIGINT AS q_sum FROM (SELECT rname, i, (l_suppkey + 3 * i) % 42 AS q FROM (SELECT rname, l_suppkey, unnest(range(n)) AS i FROM reads)) GROUP BY rname",
    "overlap_rewrite": OVERLAP_SQL,
    "depth_cap": CAP_SQL,
    "sort_check": f"{CELLS_SQL}, o AS (SELECT l_orderkey * 8 + l_linenumber AS k, min(pos) AS pos FROM reads GROUP BY 1), w AS (SELECT pos, lag(pos) OVER (ORDER BY k) AS ahead FROM o) SELECT count(*) AS n, sum(pos)::BIGINT AS pos_sum FROM w WHERE ahead > pos",
    "read_length_sample": f"{CELLS_SQL} SELECT floor(avg(n))::BIGINT AS mean_length FROM (SELECT n FROM spans ORDER BY read_ord LIMIT 10)",
    "interval_chunks": "SELECT * FROM (VALUES (2700::BIGINT, 0::BIGINT, 2700::BIGINT), (1000000, 0, 333334), (1000000, 333334, 666668), (1000000, 666668, 1000000)) v(length, start, stop)",
}
_ALL = (flag_filter, orphan_filter, mapq_filter, ref_span, cigar_operations, region_resolve, region_overlap, cover_explode, depth_covered, depth_min_quality, depth_regions, emit_by_reference, emit_everything, histo_counts, histo_indels, plp_text, baq_apply, baq_realign, plp_default, overlap_rewrite, depth_cap, sort_check, read_length_sample, interval_chunks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{f.__name__: f for f in _ALL}, **file_queries.queries()}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **file_queries.SQL}
