"""Order lines as alignment records, so that every operator runs on the star-schema tables.

All fields are integer formulas of the line: six references from flag and status, the position from the ship date, the
length from the quantity, five kinds of CIGAR from the part, and bases and qualities from part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covagrid.sources.sam import CIGAR

NAMES = ("AF", "AO", "NF", "NO", "RF", "RO")
LENGTH = 2700
REFS = [(tid, name, LENGTH) for tid, name in enumerate(NAMES)]


def read_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    threads = spark.sparkContext.defaultParallelism
    if line.rdd.getNumPartitions() < threads:  # a small file is a task or two, and a line becomes many cells
        line = line.repartition(threads)
    n, a = F.col("n"), F.floor(F.col("n") / 2)
    number = lambda c: F.col(c).cast("int")
    kind = F.when(n < 8, 0).otherwise(F.col("l_partkey") % 5)
    bit = lambda mask, c, m: F.when(F.col(c) % m == 0, mask).otherwise(0)
    rows = line.select(
        (F.datediff("l_shipdate", F.lit("1995-01-01")).cast("long")).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("rname"), number("l_quantity").alias("n"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )
    cigar = (
        F.when(kind == 1, F.array(_op("M", a), _op("D", F.lit(2)), _op("M", n - a))).when(kind == 2, F.array(_op("M", a), _op("I", F.lit(2)), _op("M", n - a - 2)))
        .when(kind == 3, F.array(_op("S", F.lit(2)), _op("M", n - 2))).when(kind == 4, F.array(_op("M", a), _op("N", F.lit(3)), _op("M", n - a))).otherwise(F.array(_op("M", n)))
    )
    tid = F.array_position(F.array(*(F.lit(x) for x in NAMES)), F.col("rname")).cast("int") - 1
    # base q is ACGT at (part + 7 q) mod 4, quality q is (supplier + 3 q) mod 42: stretches of a repeated pattern
    seq = F.repeat(F.lit("TGCA"), 14).substr((4 - F.col("l_partkey") % 4).cast("int"), n)
    first = (F.col("l_suppkey") % 42).cast("int")
    patterns = F.array(*(F.array(*(F.lit((c + 3 * q) % 42) for q in range(70))) for c in range(3)))
    qual = F.slice(F.get(patterns, first % 3), F.floor(first / 3).cast("int") + 1, n)
    flag = bit(16, "l_linenumber", 2) + bit(1024, "l_partkey", 37) + bit(512, "l_suppkey", 41) + bit(256, "l_partkey", 43) + bit(1, "l_partkey", 2) + bit(2, "l_partkey", 4)
    return rows.select(
        (F.col("pos") * (1 << 48) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("read_ord"), F.col("l_orderkey").cast("string").alias("qname"), flag.alias("flag"), tid.alias("tid"), "rname", "pos", (F.col("l_suppkey") % 61).cast("int").alias("mapq"),
        cigar.cast(CIGAR).alias("cigar"), tid.alias("mtid"), F.col("pos").alias("mpos"), F.lit(0).cast("long").alias("tlen"), seq.alias("seq"), qual.alias("qual"), F.lit(None).cast("string").alias("bq"),
    )


def _op(op: str, length):
    return F.struct(F.lit(op).alias("op"), length.cast("int").alias("len"))


def reference(spark: SparkSession) -> DataFrame:
    bases = F.array(*(F.lit(c) for c in "ACGT"))
    rows = spark.createDataFrame(REFS, "tid int, name string, length long")
    return rows.select("name", F.array_join(F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda p: F.get(bases, ((5 * p + F.col("tid")) % 4).cast("int"))), "").alias("seq"))


#: The same as DuckDB tables: reads, segments (spanning operations with what follows them) and cells.
CELLS_SQL = """
WITH reads AS (
  SELECT datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))::BIGINT AS pos, l_returnflag || l_linestatus AS rname, CAST(l_quantity AS INT) AS n, CAST(l_quantity AS INT) // 2 AS a, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN CAST(l_quantity AS INT) < 8 THEN 0 ELSE l_partkey % 5 END AS kind, (l_suppkey % 61)::INT AS mapq, l_linenumber % 2 = 0 AS reverse,
         (list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], l_returnflag || l_linestatus) - 1)::INT AS tid,
         (CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN l_partkey % 37 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_suppkey % 41 = 0 THEN 512 ELSE 0 END + CASE WHEN l_partkey % 43 = 0 THEN 256 ELSE 0 END
          + CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 4 = 0 THEN 2 ELSE 0 END)::INT AS flag
  FROM lineitem
), spans AS (
  SELECT *, pos * 281474976710656 + l_orderkey * 8 + l_linenumber AS read_ord, pos + CASE kind WHEN 1 THEN n + 2 WHEN 2 THEN n - 2 WHEN 3 THEN n - 2 WHEN 4 THEN n + 3 ELSE n END AS stop FROM reads
), kept AS (SELECT * FROM spans WHERE flag & 1796 = 0 AND NOT (flag & 1 = 1 AND flag & 2 = 0)),
segments AS (
  SELECT *, 'M' AS op, CASE kind WHEN 0 THEN n WHEN 3 THEN n - 2 ELSE a END AS len, 0 AS ref_off, CASE kind WHEN 3 THEN 2 ELSE 0 END AS query_off, kind = 2 AS ins, CASE kind WHEN 1 THEN 2 ELSE 0 END AS gap FROM kept
  UNION ALL SELECT *, CASE kind WHEN 1 THEN 'D' ELSE 'N' END, CASE kind WHEN 1 THEN 2 ELSE 3 END, a, a, false, 0 FROM kept WHERE kind IN (1, 4)
  UNION ALL SELECT *, 'M', CASE kind WHEN 2 THEN n - a - 2 ELSE n - a END, CASE kind WHEN 1 THEN a + 2 WHEN 2 THEN a ELSE a + 3 END, CASE kind WHEN 2 THEN a + 2 ELSE a END, false, 0 FROM kept WHERE kind IN (1, 2, 4)
), places AS (SELECT *, unnest(range(len)) AS i FROM segments),
cells AS (
  SELECT tid, rname, pos + ref_off + i AS p, read_ord, op, mapq, reverse, pos, stop, CASE WHEN op = 'M' THEN query_off + i ELSE query_off END AS q, ins AND i = len - 1 AS ins, CASE WHEN i = len - 1 THEN gap ELSE 0 END AS gap, l_partkey, l_suppkey,
         substr('ACGT', ((l_partkey + 7 * CASE WHEN op = 'M' THEN query_off + i ELSE query_off END) % 4 + 1)::INT, 1) AS base, (l_suppkey + 3 * CASE WHEN op = 'M' THEN query_off + i ELSE query_off END) % 42 AS quality,
         substr('ACGT', ((5 * (pos + ref_off + i) + tid) % 4 + 1)::INT, 1) AS ref
  FROM places
)
"""
INS = "substr('ACGT', ((l_partkey + 7 * (q + 1)) % 4 + 1)::INT, 1) || substr('ACGT', ((l_partkey + 7 * (q + 2)) % 4 + 1)::INT, 1)"
GAP = "substr('ACGT', ((5 * (p + 1) + tid) % 4 + 1)::INT, 1) || substr('ACGT', ((5 * (p + 2) + tid) % 4 + 1)::INT, 1)"
PLP_SQL = f"""{CELLS_SQL}, drawn AS (
  SELECT rname, tid, p, read_ord, quality >= 13 AS ok, chr((quality + 33)::INT) AS mark,
         CASE WHEN p = pos THEN '^' || chr(mapq + 33) ELSE '' END
         || CASE WHEN op = 'N' THEN CASE WHEN reverse THEN '<' ELSE '>' END WHEN op = 'D' THEN '*' WHEN base = ref THEN CASE WHEN reverse THEN ',' ELSE '.' END WHEN reverse THEN lower(base) ELSE base END
         || CASE WHEN ins THEN '+2' || CASE WHEN reverse THEN lower({INS}) ELSE {INS} END ELSE '' END
         || CASE WHEN gap > 0 THEN '-2' || CASE WHEN reverse THEN lower({GAP}) ELSE {GAP} END ELSE '' END
         || CASE WHEN p = stop - 1 THEN '$' ELSE '' END AS cell, ref
  FROM cells
)
SELECT rname AS chrom, p + 1 AS pos, min(ref) AS ref, count(*) FILTER (WHERE ok) AS depth, coalesce(string_agg(cell, '' ORDER BY read_ord, cell, mark) FILTER (WHERE ok), '') AS bases, coalesce(string_agg(mark, '' ORDER BY read_ord, cell, mark) FILTER (WHERE ok), '') AS quals
FROM drawn GROUP BY rname, p
"""
