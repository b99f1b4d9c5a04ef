"""Repeated passages removed by overlapping three-line windows; DataFrame functions only.

A text is cut into short lines, which end with a line feed or with the end of a sentence; white space around them is left
out of comparisons. Two kinds of windows are hashed: every three consecutive short lines with enough characters, and every
three whole lines. A window that occurs more than once in all documents keeps its first occurrence (smallest doc_id, then
place); the short lines of its later ones are covered, and covered lines that touch merge to spans, which are cut from the
text. Hashes that occur once, which most do, are dropped after an exchange of the bare hashes; equal hashes collapse to
one row before it, and the occurrences of the others join the table of repeated ones, a join whose hot keys Spark splits.
Texts are not shuffled while the spans are few enough to be sent to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import cut, sized

WHITE = " \n"


_MARK = "\u0001"


def short_lines(text: Column) -> Column:
    """Pieces that make up the text: each ends with a line feed, or with a mark that ends a sentence and a space."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    # a text that has the mark itself takes the slower way
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, r"(?<=\n)|(?<=[.!?] )", -1)).otherwise(F.split(marked, _MARK, -1))


def _windows(texts: DataFrame, width: int, least_chars: int) -> DataFrame:
    """doc_id, version, begin, end (numbers of short lines) and a hash of 128 bits of every window."""
    cells = texts.select("doc_id", "version", short_lines(F.col("text")).alias("p"))
    n = F.size("p")
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.endswith(F.get("p", i), F.lit("\n")) | (i == n - 1))
    cells = cells.select("doc_id", "version", F.transform("p", lambda x: F.btrim(x, F.lit(WHITE))).alias("t"), ends.alias("e"))

    def hashed(kind: str, begin: Column, end: Column) -> Column:
        some = F.slice("t", begin + 1, end - begin)
        return F.struct(begin.alias("begin"), end.alias("end"), F.xxhash64(F.lit(kind), some).alias("h1"), F.xxhash64(some, F.lit(kind)).alias("h2"))

    def long(i: Column) -> Column:
        return sum((F.length(F.get("t", i + k)) for k in range(1, width)), F.length(F.get("t", i))) >= least_chars

    def starts(j: Column) -> Column:
        return F.when(j == 0, 0).otherwise(F.get("e", j - 1) + 1)

    def full(j: Column) -> Column:
        begin = starts(j)
        return F.exists(F.slice("t", begin + 1, F.get("e", j + width - 1) + 1 - begin), lambda x: x != "")

    def every(over: str, counts, window) -> Column:
        return F.when(F.size(over) >= width, F.transform(F.filter(F.sequence(F.lit(0), F.size(over) - width), counts), window)).otherwise(F.array())

    short = every("t", long, lambda i: hashed("short", i, i + width))
    whole = every("e", full, lambda j: hashed("whole", starts(j), F.get("e", j + width - 1) + 1))
    return cells.select("doc_id", "version", F.explode(F.concat(short, whole)).alias("w")).select("doc_id", "version", "w.begin", "w.end", "w.h1", "w.h2")


def covered_spans(texts: DataFrame, width: int = 3, least_chars: int = 100) -> DataFrame:
    """(doc_id, version, spans): merged ranges [start, end) of short lines that later occurrences cover, of documents with any."""
    every = cut(_windows(texts, width, least_chars), "windows")
    hashes = every.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hashes = cut(hashes.select("h1"), "hashes").hint("merge")
    windows = cut(every.join(hashes, "h1"), "nominees")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "begin", "end")
    repeated = windows.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = cut(repeated.select("h1", "h2", F.col("first.doc_id").alias("first_doc"), F.col("first.version").alias("first_version"), F.col("first.begin").alias("first_begin"), F.col("first.end").alias("first_end")), "repeated").hint("merge")
    same = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("version") == F.col("first_version"))
    later = windows.join(repeated, ["h1", "h2"]).filter(~(same & (F.col("begin") == F.col("first_begin"))))
    # an occurrence that overlaps its own first one leaves the first one's lines
    begin = F.when(same, F.greatest("begin", "first_end")).otherwise(F.col("begin"))
    marks = later.select("doc_id", "version", F.explode(F.sequence(begin, F.col("end") - 1)).alias("at"))
    lists = marks.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("at")).alias("m"))
    m = F.col("m")
    starts = F.filter(m, lambda x, i: (i == 0) | (x > F.get(m, i - 1) + 1))
    ends = F.transform(F.filter(m, lambda x, i: (i == F.size(m) - 1) | (F.get(m, i + 1) > x + 1)), lambda x: x + 1)
    return lists.select("doc_id", "version", F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("spans"))


def dedup_lines(docs: DataFrame, width: int = 3, removed: str | None = None, least_chars: int = 100) -> DataFrame:
    """`docs` with the covered short lines cut from `text`; its other columns are as they were.

    removed: a name for one more column, the number of short lines cut. Windows of nothing but white space don't count,
    those of short lines only from `least_chars` characters on. Texts of fewer than `width` short lines, empty and null
    ones stay as they are; a text whose lines are all covered becomes empty. Null doc_ids come last in the order of
    occurrences. Rows that repeat both doc_id and text are one document and keep the same lines; rows that repeat a doc_id
    with different texts are ordered by a hash of the text. Other columns may have any names. A long text is cut in one
    row and takes time in proportion to its length. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    spans = covered_spans(rows.select("doc_id", "version", "text").filter("text is not null"), width, least_chars)
    spans = sized(cut(spans.select(F.col("doc_id").alias("of"), F.col("version").alias("of_version"), "spans"), "spans"))
    joined = rows.join(spans, rows["doc_id"].eqNullSafe(spans["of"]) & (rows["version"] == spans["of_version"]), "left")
    s, n = F.col("spans"), F.size(F.col("spans"))
    cells = F.col("pieces")

    def between(i: Column) -> Column:
        """The short lines from the end of a span to the start of the next."""
        begin = F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])
        end = F.when(i == n, F.size(cells)).otherwise(F.get(s, i)["start"])
        return F.array_join(F.slice(cells, begin + 1, end - begin), "")

    kept = F.array_join(F.transform(F.sequence(F.lit(0), n), between), "")
    cutting = joined.withColumn("pieces", F.when(s.isNotNull(), short_lines(F.col("text"))))
    text = F.when(s.isNull(), F.col("text")).otherwise(kept)
    gone = F.coalesce(F.aggregate(s, F.lit(0), lambda total, x: total + x["end"] - x["start"]), F.lit(0))
    columns = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return cutting.select(*columns, *([gone.alias(removed)] if removed else []))
