"""From reads to cells: one row for each read and covered position, by closed forms over the CIGAR.

Every operation's place in the reference and in the read is a prefix sum of lengths, so a cell needs no cursor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covagrid.operators.filters import QUERY, SPANNING, span
from covagrid.params import Flag


def operations(cigar: Column) -> Column:
    """The operations with `ref_off` and `query_off`, the lengths before them in reference and read."""
    return F.transform(cigar, lambda x, k: F.struct(x["op"].alias("op"), x["len"].cast("long").alias("len"), span(F.slice(cigar, 1, k)).alias("ref_off"), span(F.slice(cigar, 1, k), QUERY).alias("query_off")))


def strand(text: Column) -> Column:
    return F.when(F.col("reverse"), F.lower(text)).otherwise(F.upper(text))


def explode_operations(reads: DataFrame) -> DataFrame:
    """A row for each read and operation that covers positions in [lo, hi), with what its last cell shows besides.

    ins: bases (and * for pads) inserted after it; gap: how many deleted bases follow. Insertions and pads run up to
    the next other operation; a deletion behind such a run shows the length of its first operation.
    """
    letters = F.array_join(F.transform("cigar", lambda x: x["op"]), "")
    listed = reads.withColumns({"letters": letters, "reverse": F.col("flag").bitwiseAND(F.lit(int(Flag.REVERSE))) != 0})
    rows = listed.select("*", F.posexplode("cigar").alias("k", "o")).filter(F.col("o.op").isin(*SPANNING))
    ahead, first = F.slice("cigar", F.lit(1), F.col("k")), F.col("k") == 0
    rows = rows.withColumns({"op": F.col("o.op"), "len": F.col("o.len").cast("long"), "op_start": F.col("pos") + F.when(first, 0).otherwise(span(ahead)), "query": F.when(first, 0).otherwise(span(ahead, QUERY)).cast("long")})
    rows = rows.withColumn("op_stop", F.col("op_start") + F.col("len")).withColumns({"from": F.greatest("lo", "op_start"), "to": F.least("hi", "op_stop")}).filter("to > from")
    # most operations are followed by none of these, and what stands in the branches is then not evaluated
    follows = F.expr("substring(letters, k + 2, 1)")
    rest = F.expr("substring(letters, k + 2)")
    run = F.length(F.regexp_extract(rest, "^[IP]*", 0))
    added = operations(F.slice("cigar", F.col("k") + 2, run))
    next_base = F.col("query") + F.when(F.col("op").isin(*QUERY), F.col("len")).otherwise(0)

    def read(x: Column) -> Column:
        return F.col("seq").substr((next_base + x["query_off"] + 1).cast("int"), x["len"].cast("int"))

    # what is past the end of the sequence is unknown
    text = F.array_join(F.transform(added, lambda x: F.when(x["op"] == "P", F.repeat(F.lit("*"), x["len"].cast("int"))).otherwise(F.rpad(strand(read(x)), x["len"].cast("int"), "n"))), "")
    inserts = follows.isin("I", "P") & F.regexp_extract(rest, "^[IP]*", 0).contains("I")
    deletes = span(F.slice("cigar", F.col("k") + 2, F.length(F.regexp_extract(rest, "^D*", 0))))
    behind = F.get(F.col("cigar"), F.col("k") + 1 + run)
    gap = F.when(follows == "D", F.when(F.col("op") != "D", deletes)).when(inserts, F.when(behind["op"] == "D", behind["len"].cast("long")))
    rows = rows.withColumns({"ins": F.when(inserts, text).otherwise(""), "gap": F.coalesce(gap, F.lit(0).cast("long")), "bases": F.when(F.col("op").isin("D", "N"), "").otherwise(F.expr("substring(seq, cast(query + 1 as int), cast(len as int))"))})
    return rows.drop("cigar", "letters", "k", "o", "seq", "len")


def explode_cells(operations_: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each position of each operation: `keep`, p, base ('' past the sequence), q (0 past the qualities),
    deleted, skipped, head, tail, and ins and gap of an operation's last position.

    A cell in a deletion or skip has the quality of the read's next base.
    """
    rows = operations_.withColumn("p", F.explode(F.sequence("from", F.col("to") - 1)))
    gone = F.col("op").isin("D", "N")
    last = F.col("p") == F.col("op_stop") - 1
    place = F.col("query") + F.when(gone, 0).otherwise(F.col("p") - F.col("op_start"))
    return rows.select(
        *keep, "p", F.expr("substring(bases, cast(p - op_start + 1 as int), 1)").alias("base"), F.coalesce(F.get("qual", place.cast("int")), F.lit(0)).alias("q"), (F.col("op") == "D").alias("deleted"), (F.col("op") == "N").alias("skipped"),
        (F.col("p") == F.col("pos")).alias("head"), (F.col("p") == F.col("stop") - 1).alias("tail"), F.when(last, F.col("ins")).otherwise("").alias("ins"), F.when(last, F.col("gap")).otherwise(0).alias("gap"), "reverse", "mapq", "read_ord",
    )
