"""Each corpus operator against a brute-force version of itself, an exact round trip, or held-out labels."""

import base64
import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from covagrid.llm import exact_dedup as exact
from covagrid.llm import common, decontaminate, html_extract, license_scan, near_copies, packing, quality, simhash, url_filter, warc
from covagrid.llm.common import shared_dir
from covagrid.llm.decontaminate import align, benchmark_matches, codes, decontaminated, gram_hashes, normal
from covagrid.llm.line_dedup import dedup_lines
from covagrid.llm.near_copies import Bands, clusters, near_dedup, wide_print
from covagrid.llm.queries import RULES, queries, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

VOCABULARY = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "so") for b in ("dar", "fen", "gil", "hop", "jun", "tik")]


def prose(rng, n, per_line=12):
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) + "." for k in range(0, n, per_line))


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)


# 1


def verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, said in rules:
        rule_host, slash, tail = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + tail):
            fits.append((len(rule), rule, said))
    best = max(fits) if fits else (0, None, "allow")
    return host, path, best[1], best[2]


def test_url_verdicts(spark):
    urls = ["http://a.example.com/en/742", "HTTP://EXAMPLE.com/en/", "x://example.com/en/7#q", "http://com/en/x?y", "https://notcom/en/", "http://b.example.net/de/81", "http://example.net/de/", "http://org/es", "http://w.org/es/?a://b", "no url", "", None, "http://", "://.com/en/", "http://\u00c9.ORG/es/1", "a://b://com/en/"]
    rows = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), spark.createDataFrame(RULES, "rule string, verdict string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {k: verdict(u, RULES) for k, u in enumerate(urls)}


def test_bloom_filter_loses_nothing_and_passes_little(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = 4000 * url_filter.BITS_PER_KEY // 256
    blocks = url_filter.bloom_blocks(keys.filter("key like 'k%' and cast(substring(key, 2) as int) < 2000"), "key", n // 2)
    passed = {int(r.key[1:]) for r in url_filter.maybe_listed(keys, "key", blocks, n // 2).collect()}
    assert set(range(2000)) <= passed
    assert len(passed) < 2000 + 60


# 2


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 5, 30, 200])) for _ in range(120)] + ["", None, "Stra\u00dfe \u03a3\u03a3 <|endoftext|> it's '90s \u00b2\u00bd \u4e2d", "A\x1cb\x85c", "same text", "same text"]
    capacity = 64
    packed = packing.pack_documents(frame(spark, texts), tokenizer_path(), capacity, keep_ids=True)
    rows = packed.collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    parts, where = defaultdict(dict), defaultdict(list)
    for r in rows:
        parts[r.doc_id][r.piece] = r
        where[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(r.ids)
    for k, text in enumerate(texts):
        pieces = [parts[k][i] for i in range(len(parts[k]))]
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in pieces] == [capacity * i for i in range(len(pieces))]
        assert all(p.length == capacity for p in pieces[:-1])
    for spans in where.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= capacity
    assert len(where) <= 1.1 * sum(r.length for r in rows) / capacity + 1
    filled = packing.sequences(packed, capacity).collect()
    assert sum(r.used for r in filled) == sum(r.length for r in rows) and all(len(r.ids) == capacity for r in filled)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_steps_equal_best_fit_one_by_one(counts):
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [g for g in gaps if g >= length]
            gap = min(fitting) if fitting else 40
            if fitting:
                gaps.remove(gap)
            gaps.append(gap - length)
    plan = packing.best_fit(counts, 40)
    used = set()
    for k, (length, rank, first, each, _) in enumerate(plan.tolist()):
        stop = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == length else counts[length]
        used |= {first + (r - rank) // each for r in range(rank, stop)}
    assert len(used) == len(gaps)


# 3


def test_quality_agrees_with_held_out_labels(spark, tables, small):
    rows = {r.doc_id: r for r in queries()["op3_quality_classifier"](spark, small).collect()}
    labels = tables.execute("SELECT doc_id, quality FROM labels").fetchall()
    good = [rows[d].kept for d, q in labels if q == 1]
    bad = [not rows[d].kept for d, q in labels if q == 0]
    assert sum(good) / len(good) > 0.97
    assert sum(bad) / len(bad) > 0.8
    assert len(rows) == tables.execute("SELECT count(*) FROM documents").fetchall()[0][0]


def test_em_finds_the_better_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.8
    cast = lambda right: np.where(rng.random(4000) < right, np.where(truth, 1, 2), np.where(truth, 2, 1))
    patterns, counts = np.unique(np.stack([cast(0.97), cast(0.95), cast(0.95), cast(0.6)], axis=1), axis=0, return_counts=True)
    good = quality.estimate(patterns, counts.astype(float))
    at = {tuple(p): g for p, g in zip(patterns.tolist(), good, strict=True)}
    assert at[(1, 1, 1, 2)] > 0.9 > 0.1 > at[(2, 2, 2, 1)]


def plain_em(rows, rounds):
    """EM over single rows in plain Python, the bad class without rows that have no vote against them."""
    good = [1.0 if 2 not in r else 0.5 ** r.count(2) * (r.count(2) < len(r)) for r in rows]
    unseen = [[0.0] * 3 for _ in rows[0]]
    for _ in range(rounds):
        prior = (sum(good) + 1) / (len(rows) + 2)
        shares = []
        for weights, extra in ((good, [[0.0] * 3] * len(unseen)), ([1 - g for g in good], unseen)):
            tallies = [[1 + extra[k][v] + sum(w for w, r in zip(weights, rows, strict=True) if r[k] == v) for v in range(3)] for k in range(len(rows[0]))]
            shares.append([[x / sum(t) for x in t] for t in tallies])
        silent = 1.0
        for labeller in shares[1]:
            silent *= 1 - labeller[2]
        fresh = []
        for r in rows:
            a, b = prior, (1 - prior) / (1 - silent)
            for k, v in enumerate(r):
                a, b = a * shares[0][k][v], b * shares[1][k][v]
            fresh.append(1.0 if 2 not in r else a / (a + b))
        missing = sum(1 - g for g in fresh) * silent / (1 - silent)
        unseen = [[missing * x[0] / (1 - x[2]), missing * x[1] / (1 - x[2]), 0.0] for x in shares[1]]
        good = fresh
    return good


@pytest.mark.parametrize("rounds", [1, 7, 40])
def test_em_over_patterns_is_em_over_rows(rounds):
    rng = random.Random(rounds)
    rows = []
    for _ in range(300):
        bad = rng.random() < 0.3
        rows.append(tuple(rng.choices([0, 1, 2], [2, 1, 3] if bad and k < 3 else [3, 5, 0.3])[0] for k in range(5)))
    patterns, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    found = quality.estimate(patterns, counts.astype(float), rounds)
    assert np.allclose(found[inverse.ravel()], plain_em(rows, rounds), atol=2e-6)


def test_votes_do_not_change_with_the_length_alone():
    rng = random.Random(31)
    for text in (prose(rng, 400), "buy now! " * 100, "".join(rng.choice("#$%ab \n") for _ in range(3000)), "one two three four. " * 50):
        own = [quality.votes(x, x.split()) for x in ((text + "\n").encode() * k for k in (1, 3, 30, 300))]
        for short, long in zip(own, own[1:], strict=False):  # more of the same may bring a vote, but never takes or turns one
            assert all(a in (0, b) for a, b in zip(short, long, strict=True))
        assert own[-1] == own[-2]


def test_the_sample_does_not_depend_on_the_partitions(spark):
    rng = random.Random(32)
    docs = frame(spark, [prose(rng, 40) for _ in range(150)] + [f"@@ ## {k} !! $$ %% " * 6 for k in range(50)])
    some = [{r.doc_id: (r.score, r.posterior) for r in quality.quality_scores(docs.repartition(n), train_rows=30).collect()} for n in (1, 5)]
    assert some[0] == some[1]
    assert min(s for k, (s, _) in some[0].items() if k < 150) > 0.5 > max(s for k, (s, _) in some[0].items() if k >= 150)


def test_where_nothing_is_bad_all_stays(spark):
    rng = random.Random(3)
    docs = frame(spark, [prose(rng, 60) for _ in range(40)] + ["Word.", "", None])
    assert quality.quality_filter(docs).count() == 43


# 4


def cut_lines(texts, least):
    first, covered, pieces = {}, defaultdict(set), []
    for k, text in enumerate(texts):
        short = re.sub(r"(\n|[.!?] )", r"\1\0", text or "").split("\0")
        pieces.append(short)
        ends = [i for i, x in enumerate(short) if x.endswith("\n") or i == len(short) - 1]
        bare = [x.strip(" \n") for x in short]
        windows = [("whole", tuple(bare[a:b]), a, b) for a, b in ((ends[j - 1] + 1 if j else 0, ends[j + 2] + 1) for j in range(len(ends) - 2))]
        windows += [("short", tuple(bare[i : i + 3]), i, i + 3) for i in range(len(short) - 2) if len("".join(bare[i : i + 3])) >= least]
        for kind, body, a, b in sorted(windows, key=lambda w: w[2:]):
            if not any(body):
                continue
            if (kind, body) in first:
                doc, end = first[kind, body]
                covered[k] |= set(range(max(a, end) if doc == k else a, b))
            else:
                first[kind, body] = (k, b)
    return [None if t is None else "".join(x for i, x in enumerate(pieces[k]) if i not in covered[k]) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "sent"), [(1, 8 << 20), (2, 8 << 20), (3, 0)])
def test_line_dedup(spark, seed, sent, monkeypatch):
    """With tables sent to every task, and merged."""
    monkeypatch.setattr(common.sized, "__defaults__", (sent,))
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(30)]
    texts += ["".join(rng.choice(["Ab. ", "Cd! ", "ef", "\n", " "]) for _ in range(rng.randint(0, 16))) for _ in range(40)]
    texts += [None, "", "\n\n\n\n", "z\nz\nz\nz\nz\nz\nz", "a\nb", "a\nb\nc\n", "a. b. c. a. b. c. a. b. c. ", "a. b\x01. c. a. b\x01. c. \x01"]
    for least in (1, 6, 100):
        found = {r.doc_id: r.text for r in dedup_lines(frame(spark, texts), least_chars=least).collect()}
        assert [found[k] for k in range(len(texts))] == cut_lines(texts, least)


def test_a_passage_is_found_whatever_its_lines(spark):
    rng = random.Random(44)
    passage = ". ".join(" ".join(rng.choice(VOCABULARY) for _ in range(9)) for _ in range(7)) + ". "
    texts = [f"{prose(rng, 40)}\n{passage}{prose(rng, 30)}", f"{prose(rng, 30)} {passage.replace('. ', '.' + chr(10))}{prose(rng, 40)}", passage.strip(), prose(rng, 90)]
    found = {r.doc_id: r.text for r in dedup_lines(frame(spark, texts)).collect()}
    assert found[0] == texts[0] and found[3] == texts[3]
    assert [len(found[k].split()) for k in (1, 2)] == [len(texts[1].split()) - 63, 0]


# 5

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="site"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="promo-x7">Same on all pages</div>
<article><h1>Head &amp; line</h1><p>One&nbsp; two<br>three <b>bold</b><p>Next <!-- no --> par<script>var t="</p>";</script>agraph &#8364;
<div class=share>Share</div><form><input value=1>Mail</form><ul><li>Item<li>Other</ul></article><aside>Side</aside><section id="comments"><p>I agree</p></section><footer>End</footer></body></html>"""


def test_main_text(spark):
    pages = spark.createDataFrame([(0, "http://h/1", PAGE), (1, None, None), (2, "http://h/2", ""), (3, "x", "plain <b>words</b> only"), (4, "http://h/3", "<p>a<table><tr><td>b<td>c</table>d")], "page_id int, url string, html string")
    rows = {r.page_id: r for r in html_extract.main_texts(pages).collect()}
    assert rows[0].text == "Head & line\n\nOne two three bold\n\nNext par agraph \u20ac\n\nItem\n\nOther".replace("par agraph", "paragraph")
    assert (rows[1].text, rows[1].n_chars, rows[2].text, rows[3].text) == ("", 0, "", "plain words only")
    assert rows[4].text == "a\n\nb\n\nc\n\nd"
    assert rows[0].n_chars == len(rows[0].text)


def test_style_tree_drops_what_a_site_repeats(spark):
    page = "<html><body><div class=top>Every page says this</div><div class=body><p>{}</p></div></body></html>"
    rows = [(k, "http://site/", page.format(f"text {k}")) for k in range(12)] + [(k, "http://copies/", page.format("the same")) for k in range(20, 40)]
    texts = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert texts[3] == "text 3"
    assert texts[25] == "Every page says this\n\nthe same"  # one distinct page tells nothing of a site


def test_names_drop_no_part_of_an_article():
    def text(page):
        return html_extract.blocks(html_extract.parse(page))

    page = "<body><article><h2 id='related-work'>A</h2><p id='notice'>B</p><section id='search-and-share'>C</section><div class='hidden-print'>D</div><p><math><mi>x</mi></math></p><h2 class=comment>E</h2><div class=ad>no</div></article></body>"
    assert text(page) == ["A", "B", "C", "D", "x", "E"]
    assert text("<body><div class='content has-sidebar'><p>A</p></div><div class='nav-menu'>no</div></body>") == ["A"]
    assert text("<body><div class='widget'><p>All of it</p></div></body>") == ["All of it"]


def test_markup_is_read_as_browsers_do():
    def text(page):
        return html_extract.blocks(html_extract.parse(page))

    assert text("<nav/>Menu</nav><p>x</p>") == ["x"]  # only void and foreign elements end themselves
    assert text("a<svg><path/>no</svg>b<math><mi/>c</math>") == ["abc"]
    assert text("&am<b>p;</b>T &#x41;&copy") == ["&amp;T A\u00a9"]  # references don't run over tags
    assert text("<article><header><h1>A</h1></header><b>B</b><hr>C<footer>no</footer></article><header>no</header>") == ["A", "B", "C"]
    assert text("<div class='article-header'><h1>H</h1></div><div class='social-science'>S</div><p class='search'>P</p><div class='cookie-notice'>no</div>") == ["H", "S", "P"]
    assert text("<article><div class=related>A <a>b</a> text</div><div class=related><a>no</a> <a>no</a></div><section id=comments>no</section></article>") == ["A b text"]
    assert text("a < b, 1<2 <p title='x>y'>c</p><!-- > --> d</3 no> <?no?> e") == ["a < b, 1<2", "c", "d e"]
    assert text("<table><tr><td>a<td>b</table><ul><li>c<li>d</ul><p>e<p>f</div>g") == ["a", "b", "c", "d", "e", "fg"]
    assert text("<p title='a>b<p>c") == ["b", "c"]  # a quote that never ends
    assert text("a<p>b<a href=") == ["a", "b"]


def random_page(rng, depth=0):
    """(markup, text blocks) of a random tree that is closed properly."""
    markup, out, run = [], [], []

    def flush():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for _ in range(rng.randint(0, 5)):
        kind = rng.choice(["text", "text", "inline", "block", "gone", "comment"]) if depth < 6 else "text"
        word = rng.choice(["a b ", " c", "d &amp; e", "\n", "&nbsp;f&lt;", "g > h"])
        if kind == "text":
            markup.append(word)
            run.append(word.replace("&amp;", "&").replace("&nbsp;", "\xa0").replace("&lt;", "<"))
        elif kind == "inline":
            markup.append(f"<{(tag := rng.choice(['b', 'a', 'em', 'x-y']))} href='>'>{word}</{tag}>")
            run.append(word.replace("&amp;", "&").replace("&nbsp;", "\xa0").replace("&lt;", "<"))
        elif kind == "comment":
            markup.append("<!-- <p> -->")
        else:
            inner, blocks = random_page(rng, depth + 1)
            tag = rng.choice(["div", "section", "blockquote"] if kind == "block" else ["nav", "aside", "form"])
            markup.append(f"<{tag} class=\"k{rng.randint(0, 3)}\">{inner}</{tag}>")
            if kind == "block":
                flush()
                out += blocks
    flush()
    return "".join(markup), out


@pytest.mark.parametrize("seed", range(8))
def test_blocks_of_random_pages(seed):
    rng = random.Random(seed)
    for _ in range(60):
        markup, wanted = random_page(rng)
        found = html_extract.blocks(html_extract.parse(f"<body>{markup}</body>"))
        assert " ".join(found).split() == " ".join(wanted).split()


def test_furniture_is_what_entropies_say(spark):
    """Against entropies counted in Python over pages of which the tree is known."""
    rng = random.Random(55)
    hosts = {f"h{k}": [] for k in range(4)}
    for host, pages in hosts.items():
        few = [prose(rng, 3) for _ in range(rng.choice([1, 2, 12]))]
        for k in range(rng.choice([6, 12, 30])):
            pages.append({"top": rng.choice(few) if host != "h1" else few[0], "mid": prose(rng, 8) + str(k), "low": "same"})
    rows = [(10 * h + 1000 * k, f"http://{host}/{k}", "<body>" + "".join(f"<div class={c}>{t}</div>" for c, t in page.items()) + "</body>") for h, (host, pages) in enumerate(hosts.items()) for k, page in enumerate(pages)]
    texts = {r.url: r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}

    def entropy(values):
        n = len(values)
        return -sum(c / n * np.log(c / n) for c in Counter(values).values()) / np.log(n)

    for host, pages in hosts.items():
        gone = {c for c in ("top", "mid", "low") if len(pages) >= 8 and 0.9 * entropy([" ".join(p[c].split()) for p in pages]) < 0.15}
        for k, page in enumerate(pages):
            assert texts[f"http://{host}/{k}"].split("\n\n") == [" ".join(t.split()) for c, t in page.items() if c not in gone]


def test_what_articles_share_stays(spark):
    page = "<body><nav>{}</nav><article><div class=body><p>One text</p></div><div>and more</div></article></body>"
    rows = [(k, "http://h/", page.format(k)) for k in range(20)]
    assert {r.text for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()} == {"One text\n\nand more"}


HOSTILE = {
    "deep": ("<div>" * 200_000 + "x", ["x"]), "unclosed tags": ("<a " * 300_000, []), "quotes": ("<a \">\"" * 150_000 + "'x", None), "stray ends": ("<div>" * 90_000 + "</p>" * 90_000 + "x", ["x"]), "less": ("<" * 1_000_000, ["<" * 1_000_000]),
    "comments": ("<!--" * 250_000, []), "tables": ("<table><tr><td>" * 60_000 + "x", ["x"]), "names": ("<article>" + "<div class=related>" * 50_000 + "x", ["x"]), "bold": ("<b>" * 300_000 + "x", ["x"]), "scripts": ("<script>" * 120_000, []),
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    page, wanted = HOSTILE[name]
    began = time.process_time()
    root = html_extract.parse(page)
    found = html_extract.blocks(root)
    html_extract.style_nodes(html_extract.settle(root))
    assert wanted is None or found == wanted
    assert time.process_time() - began < 15


# 6


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    texts = ["Ab cd.\nReleased under the MIT License.\nEf.", "Licensed under the Apache License, Version 2.0.", "This license was lost at sea.", None, "", mit.replace(", to deal", ",\nto deal").replace("substantial", "big"), "Copyright 2019 Some One. All rights reserved.", "x\n\nAll rights reserved."]
    rows = [(r.doc_id, r.license, texts[r.doc_id][r.start : r.end], r.missing_words, r.added_words) for r in license_scan.license_notices(frame(spark, texts)).collect()]
    assert sorted(x[:2] for x in rows) == [(0, "MIT"), (1, "Apache-2.0"), (5, "MIT"), (6, "Proprietary"), (7, "Proprietary")]
    by = {x[0]: x for x in rows}
    assert by[0][2] == "Released under the MIT License." and by[0][3:] == ("", "")
    assert by[5][2] == texts[5] and by[5][3:] == ("substantial", "big")


def test_every_template_is_its_own_best_match():
    for name, versions in license_scan.TEMPLATES.items():
        for text in versions:
            assert license_scan.identify(text)[0][0] == name


@pytest.mark.parametrize("length", [60, 1000, 5000])
def test_licenses_in_long_lines(spark, length):
    rng, names = random.Random(length), ["MIT", "CC-BY-NC-4.0", "CC0-1.0", "ISC", "GPL-3.0", "Apache-2.0"]
    texts, places = [], []
    for name in names:
        before = " ".join(rng.choice(VOCABULARY) for _ in range(length // 2))
        texts.append(f"{before} {license_scan.TEMPLATES[name][0]} {before}")
        places.append((name, len(before) + 1, len(before) + 1 + len(license_scan.TEMPLATES[name][0])))
    rows = license_scan.license_notices(frame(spark, texts)).collect()
    assert [(r.license, r.start, r.end) for r in sorted(rows, key=lambda r: r.doc_id)] == places


def test_each_license_of_a_line_is_reported(spark):
    one, two = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    text = f"{one} {two} Ab cd. {license_scan.TEMPLATES['ISC'][1]}"
    rows = sorted(license_scan.license_notices(frame(spark, [text])).collect(), key=lambda r: r.start)
    assert [r.license for r in rows] == ["MIT", "Apache-2.0", "ISC"]
    assert [text[r.start : r.end] for r in rows] == [one, two, license_scan.TEMPLATES["ISC"][1]]


def test_words_that_name_a_license_do_not_differ():
    header = license_scan.TEMPLATES["GPL-3.0"][1]
    said = {"GNU General": "GPL-3.0", "GNU Lesser General": "LGPL-3.0", "GNU Affero General": "AGPL-3.0"}
    for words, name in said.items():
        assert [x[0] for x in license_scan.identify(header.replace("GNU General", words))] == [name]
    assert license_scan.identify(header.replace("GNU General", "GNU Library General")) == ()
    old = header.replace("GNU General", "GNU Library General").replace("version 3", "version 2")
    assert [x[0] for x in license_scan.identify(old)] == ["LGPL-2.0"]
    assert [x[0] for x in license_scan.identify(header.replace("version 3", "version 2"))] == ["GPL-2.0"]
    assert license_scan.identify(header.replace("version 3", "version 4")) == ()
    bullets = re.sub(r" [123]\. ", " * ", license_scan.TEMPLATES["BSD-3-Clause"][1])
    assert [x[0] for x in license_scan.identify(bullets)] == ["BSD-3-Clause"]


FULL = {"MIT": ("MIT", 3), "BSD-2": ("BSD-2-Clause", 2), "BSD-3": ("BSD-3-Clause", 2), "ISC": ("ISC", 2), "Apache": ("Apache-2.0", 1), "GPL-3": ("GPL-3.0", 2), "LGPL-2.1": ("LGPL-2.1", 2), "Zlib": ("Zlib", 1)}
LAYOUTS = {
    "wrapped": lambda text: "\n".join(textwrap.wrap(text, 66)),
    "comment": lambda text: "/*\n" + "\n".join(f" * {x}" for x in textwrap.wrap(text, 60)) + "\n */",
    "hashes": lambda text: "\n#\n".join(f"# {x}" for x in textwrap.wrap(text, 70)),
    "paragraphs": lambda text: re.sub(r" (THE SOFTWARE|THIS SOFTWARE|The above|You may|Unless|[123]\. |This \w+ is distributed|You should|Permission is granted)", r"\n\n\1", text),
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_whole_licenses_are_found_once(spark, layout):
    """Over lines, paragraphs and comment marks, after a title and a copyright line, with their differences."""
    texts = [f"Some License\n\nCopyright (c) 2020 A. Person\nAll rights reserved.\n\n{LAYOUTS[layout](license_scan.TEMPLATES[name][k])}\n\nimport words" for name, k in FULL.values()]
    rows = sorted(license_scan.license_notices(frame(spark, texts)).collect(), key=lambda r: r.doc_id)
    assert [r.license for r in rows] == [name for name, _ in FULL.values()]
    for r, (name, k) in zip(rows, FULL.values(), strict=True):
        assert license_scan.words(texts[r.doc_id][r.start : r.end]) == license_scan.words(license_scan.TEMPLATES[name][k])
        assert (r.missing_words, r.added_words, r.template_rank) == ("", "", 0)
    one = license_scan.notices(LAYOUTS[layout](license_scan.TEMPLATES["MIT"][3]).replace("AUTHORS", "WRITERS"))
    assert [x[:1] + x[3:5] for x in one] == [("MIT", "authors", "writers")]


def test_no_stretch_within_the_budget_is_lost():
    """Candidate blocks against all stretches of all texts, for every template, with words changed, lost and added."""
    rng = random.Random(6)

    def least(template, have):  # fewest differing words of any stretch
        row = [0] * (len(have) + 1)
        for word in template:
            new = [row[0] + 1]
            for j, other in enumerate(have, 1):
                new.append(min(row[j - 1] + (word != other) * 2, row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    templates = license_scan.library(0.1).templates
    seen = Counter()
    for k, template in enumerate(templates):
        if len(template.segments) > 1:
            continue
        for changes in (0, template.budget, template.budget + 1):
            have = list(template.words)
            for _ in range(changes):
                at = rng.randrange(len(have))
                have[at : at + 1] = rng.choice([[], [have[at], "kegil"]])
            have = [rng.choice(VOCABULARY) for _ in range(9)] + have + [rng.choice(VOCABULARY) for _ in range(9)]
            blocks = license_scan.candidates(have).get(k, [])
            distances = [int(license_scan._distances(template.words, have[a:b])[-1].min()) for a, b, _ in blocks]
            wanted = least(template.words, have)
            if wanted <= template.budget:
                assert min(distances) == wanted
                seen["in"] += 1
            else:
                assert all(d > template.budget for d in distances)
                seen["out"] += 1
    assert min(seen.values()) > 20


def test_repeated_notices_take_linear_time():
    text = "All rights reserved. " * 20_000 + f"{license_scan.TEMPLATES['MIT'][3]} " * 100
    began = time.process_time()
    assert Counter(x[0] for x in license_scan.notices(text)) == {"Proprietary": 19_999, "MIT": 100}
    assert time.process_time() - began < 20


# 7


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "\u00e9" * 50, "<p>one</p>"]
    pages = spark.createDataFrame([(10 - k, f"http://h/{k} x\n", h) for k, h in enumerate(html)] + [(99, None, "last")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    payloads = {10 - k: (h or "").encode() for k, h in enumerate(html)} | {99: b"last"}
    for page, payload in payloads.items():
        first = min(p for p, x in payloads.items() if x == payload)
        assert (rows[page].payload_bytes, rows[page].payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (rows[page].record_type, rows[page].refers_to) == (("response", None) if page == first else ("revisit", first))
    folder = f"{shared_dir(spark)}/mine"
    index = warc.write_warc(pages, folder, roll_bytes=300)
    read = {r.page_id: r for r in warc.read_warc(index.filter("record_type = 'response'")).collect()}
    assert {k: bytes(r.payload) for k, r in read.items()} == {k: payloads[k] for k in read}
    assert warc.write_warc(pages, folder, min_revisit_bytes=11).filter("record_type = 'revisit'").count() == 0


def test_close_ranges_share_a_read():
    assert warc.spans([("a", 0, 10), ("a", 12, 5), ("a", 100, 5), ("b", 104, 5)], 5, 50) == [("a", 0, 17, [0, 1]), ("a", 100, 105, [2]), ("b", 104, 109, [3])]


# 8


@pytest.mark.parametrize(("prime", "huge"), [(exact.PRIME, 1 << 23), (7, 1 << 23), (exact.PRIME, 8)])
def test_exact_dedup(spark, prime, huge):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "c", "\u00e9x"]) for _ in range(rng.randint(0, 4))) + rng.choice(["", " ", "\n"]) for _ in range(80)] + [None, "", "\u2003", "abcab" * 40, "abcab " * 40]
    rows = {r.doc_id: r for r in exact.exact_dedup(frame(spark, texts), prime, huge, chunk=16).collect()}
    groups = defaultdict(list)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    for k, b in enumerate(bare):
        groups[b].append(k)
    for b, members in groups.items():
        keep = min(members, key=lambda k: (-len(texts[k] or ""), k))
        for k in members:
            assert (rows[k].keep_id, rows[k].group_size, rows[k].kept, rows[k].text_sha256) == (keep, len(members), k == keep, hashlib.sha256(b.encode()).hexdigest())


def test_rows_without_ids_are_compared_once(spark):
    """Copies without ids bring each of them to the comparison once, not once for each pair of rows."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") / 2).cast("long")).alias("text"))
    began = time.monotonic()
    found = exact.exact_dedup(rows).groupBy("group_size", "kept").count().collect()
    assert sorted((r.group_size, r.kept, r["count"]) for r in found) == [(2, False, 10_000), (2, True, 10_000)]
    assert time.monotonic() - began < 60


@given(st.binary(max_size=300), st.binary(max_size=300), st.integers(1, 50))
def test_fingerprints_compose(a, b, chunk):
    whole = exact.fingerprint(a + b, chunk=chunk)
    assert whole == exact.combine(exact.fingerprint(a), exact.fingerprint(b), len(b)) == int.from_bytes(a + b, "big") % exact.PRIME


# 9


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_benchmark_matches(spark):
    rng = random.Random(9)
    items = [prose(rng, rng.randint(12, 30)) for _ in range(12)] + ["", None, "kegil"]
    texts = []
    for k in range(40):
        text = prose(rng, 120)
        if k % 2 == 0:
            passage = list(rng.choice(items[:12]).upper() if k % 4 else rng.choice(items[:12]))
            for _ in range(rng.randint(0, int(0.13 * len(passage)))):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["x"], [passage[at], "y"]])
            text = text[:200] + " " + "".join(passage) + " " + text[200:]
        texts.append(text)
    texts += [None, "", "only kegil here"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    wanted = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = normal(item)
            if n and (f" {n} " in f" {normal(t)} " if len(n) < 8 else edits(n, normal(t)) <= int(len(n) * 0.1)):
                wanted.add((d, i))
    for block in (1 << 22, 700):
        rows = benchmark_matches(frame(spark, texts), benchmark, block_chars=block).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == wanted
        for r in rows:
            part = normal(texts[r.doc_id])[r.start : r.end]
            assert edits(normal(items[r.item_id]), part) == r.edits
    left = {r.doc_id for r in decontaminated(frame(spark, texts), benchmark).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in wanted}


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_short_items_have_the_edits_that_are_documented(spark, share):
    rng = random.Random(90)
    items = [prose(rng, 8)[:n].strip() for n in range(8, 41) for _ in range(2)]
    texts = []
    for item in items:
        n = normal(item)
        passage = list(n)
        for _ in range(rng.choice([0, 1, int(len(n) * share), int(len(n) * share) + 1])):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], ["x"], [passage[at], "y"]])
        texts.append(f"{prose(rng, 6)} {''.join(passage)} {prose(rng, 6)}")
    rows = benchmark_matches(frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), share=share).collect()
    wanted = {(d, i): edits(normal(item), normal(t)) for d, t in enumerate(texts) for i, item in enumerate(items)}
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == {k: e for k, e in wanted.items() if e <= int(len(normal(items[k[1]])) * share)}


@pytest.mark.parametrize("many", [1_000_000, 0, 300])
def test_repetitive_texts_lose_no_match(monkeypatch, many):
    """Counting by runs over all diagonals, and one by one, against every place."""
    monkeypatch.setattr(decontaminate, "_MANY", many or 1)
    monkeypatch.setattr(decontaminate, "_WIDE", 40 if many == 300 else 1 << 16)
    rng = random.Random(many)
    items = ["-" * 20 + prose(rng, 6), "-=" * 15 + "a", "ab ab ab " * 6 + "c", "-" * 45, prose(rng, 9)]
    texts = ["-" * 300, "-=" * 90 + "-" * 60, "ab " * 60 + "c", "-" * 30 + prose(rng, 6) + "-" * 60]
    for item in items:
        passage = list(item)
        for _ in range(rng.randint(0, len(item) // 8)):
            passage[rng.randrange(len(passage))] = rng.choice(["-", "x", ""])
        texts.append("-" * rng.randint(0, 50) + "".join(passage) + "-" * rng.randint(0, 50))
    texts = [normal(t) for t in texts]
    found = {(t, i): e for t, i, e, _, _ in decontaminate.scan(texts, decontaminate.build_index(list(enumerate(items)), 8, 0.1))}
    wanted = {(t, i): edits(normal(item), text) for t, text in enumerate(texts) for i, item in enumerate(items)}
    assert found == {k: e for k, e in wanted.items() if e <= len(normal(items[k[1]])) // 10}


def test_a_megabyte_of_dashes_takes_seconds():
    rng = random.Random(3)
    block = decontaminate.build_index(list(enumerate(["-" * 60 + prose(rng, 20), "-=" * 30 + prose(rng, 20), "-" * 300])), 8, 0.1)
    began = time.process_time()
    assert decontaminate.scan(["-" * 1_000_000], block) == [(0, 2, 0, 0, 300)]
    assert decontaminate.scan(["-=" * 300_000], block) == []
    assert time.process_time() - began < 30


@given(st.text("ab", min_size=1, max_size=9), st.text("ab", max_size=20))
def test_alignment_is_the_edit_distance(item, text):
    found = align(codes(item), codes(text), -len(item), len(text), len(item))
    assert found[0] == edits(item, text)


def test_gram_hashes_depend_on_the_gram_only():
    for q in range(1, 12):
        hashes = gram_hashes(codes("abcabcabcabcabc"), q)
        assert len(hashes) == 15 - q + 1 and all(hashes[k] == hashes[k + 3] for k in range(len(hashes) - 3))


# 10


def plain_simhash(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, ids, threshold=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {ids[k]: min(ids[j] for j in range(len(prints)) if label[j] == label[k]) for k in range(len(prints))}


def test_simhash_groups(spark):
    rng = random.Random(10)
    texts = [prose(rng, 300) for _ in range(25)]
    for _ in range(60):
        words = rng.choice(texts).split(" ")
        words[rng.randrange(len(words))] = "EDITED"
        texts.append(" ".join(words))
    texts += [None, "", " \n", "One two", "one TWO", "\u00c9cole", texts[0]]
    prints = [plain_simhash(t) for t in texts]
    rows = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}
    assert [rows[k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert {k: r.component_id for k, r in rows.items()} == classes(prints, list(range(len(texts))))


@pytest.mark.parametrize("most", [4096, 5])
def test_anchors_lose_no_link(spark, most):
    rng = random.Random(most)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(6):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    for anchors in (simhash.Anchors(), simhash.Anchors(hamming_r=3), simhash.Anchors(blocks=5), simhash.Anchors(threshold=6, blocks=3, hamming_r=3)):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(table, anchors, most).collect()]
        assert all((a ^ b).bit_count() <= anchors.threshold for a, b in links)
        label = {p: p for p in prints}
        for a, b in links:
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
        wanted = classes(prints, prints, anchors.threshold)
        assert {p: min(q for q in prints if label[q] == label[p]) for p in prints} == wanted


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 6)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def test_one_of_each_group_stays(spark):
    rng = random.Random(11)
    a, b = prose(rng, 200), prose(rng, 200)
    docs = spark.createDataFrame([(5, a, 1), (3, a, 2), (3, a, 3), (None, a, 4), (None, b, 5), (9, "", 6), (8, None, 7)], "doc_id long, text string, row_no int").repartition(3)
    rows = simhash.simhash_dedup(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted([(False, 3, a), (True, 0, b), (False, 8, "")])
    assert Counter(r.row_no in (2, 3, 5, 7) for r in rows) == {True: 3}


@pytest.mark.parametrize("bands", [Bands(), Bands(tile_rows=2), Bands(tile_hashes=700)])
def test_pipeline_keeps_one_of_similar_texts(spark, bands):
    """Against every pair's five-word Jaccard similarity, with groups in one tile and in many."""
    rng = random.Random(11)

    def grams(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    texts = ["", None, " ", "a b", "A  b", "a b c"]
    for edits_made in (1, 2, 3, 4, 5, 6, 8, 12, 20):
        base = [rng.choice(VOCABULARY) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for at in rng.sample(range(300), edits_made):
                near[at] = f"new{rng.random()}"
            texts.append(" ".join(near))
    sets = [grams(t or "") for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert {r.doc_id for r in near_dedup(frame(spark, texts), bands).collect()} == set(root)
    assert len(set(root)) < simhash.simhash_dedup(frame(spark, texts)).count()


def wide_anchors(fingerprint, bands):
    return np.concatenate([bands.anchors.of(fingerprint[w : w + 1])[1] for w in range(bands.prints)])


@pytest.mark.parametrize("a, b, both", [(4, 5, 4), (9, 9, 8), (8, 10, 8), (90, 90, 80), (450, 450, 400)])
def test_similar_sets_share_an_anchor(a, b, both):
    rng, bands, equal = np.random.default_rng(a + b), Bands(), []
    for _ in range(150):
        hashes = rng.integers(0, 1 << 64, a + b - both, np.uint64)
        left, right = wide_print(hashes[:a], bands.prints), wide_print(hashes[a - both :], bands.prints)
        equal.append(wide_anchors(left, bands) == wide_anchors(right, bands))
        assert equal[-1].any() and np.bitwise_count(left ^ right)[: bands.carried].sum() <= bands.near
    assert (1 - np.mean(equal)) ** equal[0].size < 3e-5  # 7e-6 but for the sample


@pytest.mark.parametrize("most", [0, 3, 256])
def test_clusters_are_components_of_each_anchor(most):
    rng = random.Random(5)
    anchor = sorted(rng.randrange(12) for _ in range(60))
    prints = [rng.choice((0, (1 << 128) - 1)) ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 9))) for _ in anchor]
    words = [np.array([p >> 64 * k & (1 << 64) - 1 for p in prints], np.uint64) for k in (0, 1)]
    wanted = set()
    for value in set(anchor):
        at = [k for k in range(len(anchor)) if anchor[k] == value]
        label = classes([prints[k] for k in at], at, 8)
        wanted |= {frozenset(k for k in at if label[k] == first) for first in label.values()}
    assert {frozenset(x.tolist()) for x in clusters(np.array(anchor), words, 8, most)} == {x for x in wanted if len(x) > 1}


def test_fingerprints_nominate_what_the_pipeline_confirms(spark):
    """Texts that no anchor brings together near enough stay apart, however similar."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words)]
    assert [r.doc_id for r in near_dedup(frame(spark, texts)).collect()] == [0]
    assert sorted(r.doc_id for r in near_dedup(frame(spark, texts), Bands(near=-1)).collect()) == [0, 1]


@pytest.mark.parametrize("most", [1, 256])
def test_clusters_link_no_sets_of_sizes_too_far_apart(most):
    """80, 100 and 125 are a chain of 0.8; 63, 157 and 10 are too far from each of them."""
    zero = [np.zeros(6, np.uint64)]
    found = clusters(np.zeros(6, np.int64), zero, 8, most, np.array([80, 100, 125, 63, 157, 10]), 0.8)
    assert [sorted(x.tolist()) for x in found] == [[0, 1, 2]]
    assert [sorted(x.tolist()) for x in clusters(np.zeros(6, np.int64), zero, 8, most)] == [[0, 1, 2, 3, 4, 5]]


@pytest.mark.parametrize("tile_rows", [1024, 20])
def test_texts_that_meet_at_many_anchors_take_a_row_in_the_first_round(spark, monkeypatch, tile_rows):
    """A group that shares much but seldom 0.8, against every pair: the right rows stay, whatever the number of meetings."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(2, 9)):
            words[at] = f"new{rng.random()}"
        texts.append(" ".join(words))
    grams = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    label = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    written, real = [], near_copies.cut
    monkeypatch.setattr(near_copies, "cut", lambda df, tag: (written.append((tag, real(df, tag))), written[-1][1])[1])
    assert {r.doc_id for r in near_dedup(frame(spark, texts), Bands(tile_rows=tile_rows)).collect()} == set(label)
    first = next(df for tag, df in written if tag == "nominated")
    assert 0 < first.count() <= len(texts)
    met = next(df for tag, df in written if tag == "met")
    assert met.count() > 10 * len(texts)  # each a row of a join before
