"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and other columns with clashing names."""

import corpus_pipeline
import pytest
from covagrid.llm.common import made, shared_dir
from covagrid.llm.decontaminate import benchmark_matches, decontaminated
from covagrid.llm.exact_dedup import exact_dedup
from covagrid.llm.html_extract import main_texts
from covagrid.llm.license_scan import license_notices
from covagrid.llm.line_dedup import dedup_lines
from covagrid.llm.near_copies import near_dedup
from covagrid.llm.packing import pack_documents
from covagrid.llm.quality import quality_filter, quality_scores
from covagrid.llm.queries import RULES, tokenizer_path
from covagrid.llm.simhash import simhash_dedup, simhash_groups
from covagrid.llm.url_filter import url_verdicts
from covagrid.llm.warc import warc_round_trip
from tokenizers import Tokenizer

LONG = "word " * 60_000 + "\n" + "\n".join(f"line {k % 50}" for k in range(20_000))
CLASH = "print string, row string, version int, spans string, task int, place int, chosen string, ids string, item_id int, of string, lines string, h1 long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
ROWS = [(1, "a b c\nd e f\ng h i"), (1, "a b c\nd e f\ng h i"), (2, None), (3, ""), (None, "a b c\nd e f\ng h i"), (None, None), (4, " \n\t "), (5, LONG), (1, "another text"), (6, "\u4e2d\u6587 \U0001f600 e\u0301")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, None, None, None, *[None] * 12) for d, t in rows], DOCS)


def items(spark, rows=((0, "a b c d e f g h i"), (None, "another text"), (2, None), (2, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


DOCUMENT_OPERATORS = {
    "pack": lambda s, d: pack_documents(d, tokenizer_path(), 512),
    "quality": lambda s, d: quality_scores(d),
    "quality_filter": lambda s, d: quality_filter(d),
    "lines": lambda s, d: dedup_lines(d),
    "licenses": lambda s, d: license_notices(d),
    "exact": lambda s, d: exact_dedup(d),
    "matches": lambda s, d: benchmark_matches(d, items(s)),
    "decontaminated": lambda s, d: decontaminated(d, items(s)),
    "simhash": lambda s, d: simhash_groups(d),
    "simhash_dedup": lambda s, d: simhash_dedup(d),
    "near_dedup": lambda s, d: near_dedup(d),
}
#: How many rows come of ROWS.
COUNTS = {"quality": 10, "lines": 10, "exact": 10, "simhash": 10, "matches": 4, "decontaminated": 6, "licenses": 0, "simhash_dedup": 5, "near_dedup": 5, "quality_filter": 6, "pack": 236}


@pytest.mark.parametrize("name", sorted(DOCUMENT_OPERATORS))
def test_odd_documents(spark, name):
    assert len(DOCUMENT_OPERATORS[name](spark, docs(spark)).collect()) == COUNTS[name]


def test_every_piece_of_odd_documents_is_packed(spark):
    ids_of = Tokenizer.from_file(tokenizer_path())
    sizes = [len(ids_of.encode(text or "", add_special_tokens=False).ids) + 1 for _, text in ROWS]
    packed = DOCUMENT_OPERATORS["pack"](spark, docs(spark)).collect()
    assert len(packed) == sum(-(-n // 512) for n in sizes) and sum(r.length for r in packed) == sum(sizes)


def test_a_very_long_text_is_read_whole(spark):
    """What stands at the end of a text of a million characters counts."""
    tail = "Licensed under the MIT License."
    long = docs(spark, [(1, "ab cd " * 200_000 + "\n" + tail), (2, "ab cd " * 200_000 + "\n" + tail[:-1] + "!"), (3, "ab cd " * 200_000 + "\n" + tail)])
    assert sorted(r.start for r in license_notices(long).filter("license = 'MIT'").collect()) == [1_200_001] * 3
    assert sorted((r.doc_id, r.edits) for r in benchmark_matches(long, items(spark, [(0, tail)])).collect()) == [(1, 0), (2, 1), (3, 0)]
    assert {r.doc_id: r.keep_id for r in exact_dedup(long).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id for r in near_dedup(long).collect()} == {1, 2}
    prints = {r.doc_id: r.fingerprint for r in simhash_groups(long).collect()}
    assert prints[1] == prints[3] != prints[2]  # the bits of two shingles that alternate tie but for the end


@pytest.mark.parametrize("name", sorted(DOCUMENT_OPERATORS))
def test_no_documents(spark, name):
    assert DOCUMENT_OPERATORS[name](spark, docs(spark, [])).collect() == []


def test_an_empty_benchmark_matches_nothing(spark):
    assert benchmark_matches(docs(spark), items(spark, [])).count() == 0
    assert decontaminated(docs(spark), items(spark, [])).count() == len(ROWS)


def test_repeated_rows_and_null_ids_are_told_apart(spark):
    exact = exact_dedup(docs(spark)).collect()
    same = [r for r in exact if r.group_size == 3]
    assert sorted((r.doc_id is None, r.kept) for r in same if r.kept) == [(False, True)] and len(same) == 3
    blank = [r for r in exact if r.group_size == 4]
    assert {r.keep_id for r in blank} == {4}
    groups = simhash_groups(docs(spark)).collect()
    assert {r.component_id for r in groups if r.fingerprint == "0" * 16} == {2}
    kept = simhash_dedup(docs(spark)).collect()
    assert sum(r.text == ROWS[0][1] for r in kept) == 1
    cut = dedup_lines(docs(spark)).collect()
    assert [r.text for r in cut if r.doc_id == 1 and r.text != "another text"] == [ROWS[0][1]] * 2
    assert [r.text for r in cut if r.doc_id is None] in ([None, ""], ["", None])


def test_all_columns_stay(spark):
    for name in ("quality_filter", "lines", "decontaminated", "simhash_dedup", "near_dedup"):
        assert DOCUMENT_OPERATORS[name](spark, docs(spark)).columns == docs(spark).columns


PAGES = "page_id long, url string, html string, host string, path string, rule string, text string, sha1 string, furniture string, payload string"


@pytest.mark.parametrize("rows", [[], [(1, None, None), (1, None, None), (None, "http://a.com/en/", "<p>x"), (2, "", ""), (3, "http://a.com/en/" + "x" * 50_000, "<div>" * 5000 + "deep"), (4, "http://..com/en/", "<<>><p <a href='>")]])
def test_odd_pages(spark, rows):
    pages = spark.createDataFrame([(*r, *[None] * 7) for r in rows], PAGES)
    rules = spark.createDataFrame([*RULES, (None, "block"), ("", "block"), ("/x", "block"), ("com/en/", "allow")], "rule string, verdict string")
    for out in (url_verdicts(pages, rules), main_texts(pages), warc_round_trip(pages)):
        assert out.count() == len(rows)
    assert url_verdicts(pages, rules.limit(0)).filter("verdict = 'allow'").count() == len(rows)
    if rows:
        said = {r.page_id: r.rule for r in url_verdicts(pages, rules).collect()}
        assert said[None] == "com/en/" and said[1] is None
        types = [r.record_type for r in warc_round_trip(pages).collect()]
        assert types.count("response") == 4


@pytest.mark.parametrize("rows", [[], ROWS])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(made())
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "piece").collect()
    # texts of single letters and of one word go first, blank texts are one group, another text is an item
    assert sorted({r.doc_id for r in out}) == ([2, 6] if rows else [])
    left = [path for path in made() if path not in before]
    assert {path.rpartition("/")[2].split("-")[1] for path in left} <= {"decontamination", "pieces", "counts", "ranks"}


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_pipeline_stages_agree_with_run(spark, small):
    frame, sizes = spark.read.parquet(f"{small}/documents.parquet"), []
    columns = frame.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, frame, small).toPandas()
        sizes.append(len(rows))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert list(rows.columns) == columns
            frame = spark.createDataFrame(rows.to_dict("records"), frame.schema)
    assert sizes[0] >= sizes[2] >= sizes[3] and sizes[0] == sizes[1]
    assert corpus_pipeline.run(spark, small).count() == sizes[-1]
