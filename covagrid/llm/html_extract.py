"""Main text of web pages with a site style tree.

Pages are parsed to elements. Over the distinct pages of a host, elements with the same style path (tags and classes
from the body down) are one node of the site's style tree. A node's presentation is the sequence of its children's
styles, its content the text below it; each has an entropy over the pages, to the base of their number, so that 0 means
the same on all pages and 1 different on all. A container whose weighted entropy is low is furniture of the site, and
its branch is removed from every page. Elements whose tag, role or class names what they are (menu, footer, advert,
comments ...) are removed on every host, also on those with a page or two. A class or id counts by its whole name only;
inside an article only names of adverts and comments decide alone, others must stand on a container that is mostly links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covagrid.llm.common import cut, map_batches
from covagrid.llm.url_filter import host_and_path

# Element names of HTML and the words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul xmp".split())
DROPPED = frozenset("head script style noscript template title nav footer aside form button select option optgroup input textarea iframe object embed applet canvas svg audio video map dialog menu noembed noframes".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup login sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead comment comments commentlist reply replies respond disqus related recommended share sharing "
    "social widget widgets pagination pager toolbar search skip hidden paywall".split()
)
#: Names that decide inside articles too.
PLAIN_NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsored comments commentlist disqus share sharing newsletter".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag ends these, unless one of the second kind stands between.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
P_SCOPE = ("article", "td", "th", "button", "object", "table")
TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption".split())
NEVER_NAMED = frozenset("h1 h2 h3 h4 h5 h6 p".split())  # classes and ids don't drop these
CONTAINERS = frozenset("div section ul ol dl table article main center fieldset details figure".split())

_OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPEN_UNQUOTED = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[a-z0-9]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def _digest(text: str) -> int:
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class Element:
    __slots__ = ("children", "doubted", "dropped", "inside", "main", "named", "parent", "path", "style", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.parent, self.children, self.style = tag, parent, [], tag
        self.main, self.inside = tag in ("article", "main"), parent is not None and (parent.inside or parent.main)
        self.dropped, self.named, self.doubted = tag in DROPPED or (tag == "header" and not self.inside), False, False
        if attributes and not attributes.isspace():
            self._look(attributes)
        # a digest, as the names themselves grow with the depth
        self.path = _digest(f"{parent.path:x}/{self.style}") if parent else 0

    def _look(self, attributes: str) -> None:
        named: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(attributes):
            named.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
        classes = named.get("class", "").split()
        if classes:
            self.style = f"{self.tag}.{' '.join(sorted(classes))}"
        names = [*(x.lower() for x in classes), *named.get("id", "").lower().split()]
        role = named.get("role", "").strip().lower()
        self.main |= role in ("main", "article") or named.get("itemprop", "") == "articleBody"
        self.dropped |= role in NOISE_ROLES or "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower()
        if self.dropped or self.tag in NEVER_NAMED or not names:
            return
        if self.tag in ("html", "body", "article", "main"):
            self.named = not {"comment", "comments", "reply", "related", "ad"}.isdisjoint(names)
        elif self.inside:
            self.named = not PLAIN_NOISE.isdisjoint(names)
            self.doubted = not self.named and any(map(_noise, names))
        else:
            self.named = any(map(_noise, names))
        self.dropped = self.named


def _noise(name: str) -> bool:
    """Whether every part of a class or id is a word for noise."""
    if name in NOISE_WORDS:
        return True
    parts = _NAMES.findall(name)
    return bool(parts) and all(x in NOISE_WORDS for x in parts)


class _Open:
    """The open elements, with the places of those of each tag, so that no search walks the stack."""

    def __init__(self, root: Element):
        self.stack, self.places = [root], {}

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        for element in reversed(self.stack[place:]):
            self.places[element.tag].pop()
        del self.stack[place:]

    def end(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        """Close the innermost of `tags` unless one of `until` is open inside it."""
        place = self.last(tags)
        if place and place > self.last(until):
            self.cut(place)

    def close(self, tag: str) -> None:
        place = self.last((tag,))
        if not place:
            return
        if tag in TABLE_PARTS:
            shut = self.last(("table",))
        elif tag in ("table", "article", "body", "html"):
            shut = 0
        else:
            shut = self.last(("td", "th", "article"))
        if shut <= place:
            self.cut(place)


def parse(page: str) -> Element:
    """The page as a tree; text stands among an element's children as strings, character references still in it.

    One pass forward. A tag, comment or raw element that never ends takes the rest of the page. If a quote in a tag never
    ends, this and all later tags end at their first ">".
    """
    root = Element("", "", None)
    open_, at, last_end, tag_at = _Open(root), 0, page.rfind(">"), _OPEN
    text_from = 0

    def text(until: int) -> None:
        if until > text_from:
            open_.stack[-1].children.append(page[text_from:until])

    while (at := page.find("<", at)) >= 0:
        following = page[at + 1 : at + 3]
        if following[:1] in ("!", "?") or (following[:1] == "/" and not following[1:].isalpha()):
            text(at)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(">", at) if at < last_end else -1
                at = end + 1 if end >= 0 else len(page)
            text_from = at
            continue
        if not (following[:1].isascii() and following[:1].isalpha()) and following[:1] != "/":
            at += 1  # a plain "<"
            continue
        text(at)
        if at > last_end:
            text_from = len(page)
            break
        match = tag_at.match(page, at + 1)
        if match is None and tag_at is _OPEN:
            tag_at = _OPEN_UNQUOTED
            match = tag_at.match(page, at + 1)
        if match is None:  # such as a letter that isn't of ASCII after "</"
            end = page.find(">", at)
            text_from = at = end + 1
            continue
        text_from = at = match.end()
        tag = match[2].lower()
        if match[1]:
            open_.close(tag)
            continue
        if tag in CLOSES_P:
            open_.end(("p",), P_SCOPE)
        if tag in IMPLIED:
            open_.end(*IMPLIED[tag])
        element = Element(tag, match[3], open_.stack[-1])
        element.parent.children.append(element)
        if tag in RAW:
            close = _RAW_ENDS[tag].search(page, at)
            text_from = at = close.end() if close else len(page)
        elif tag not in VOID and not (match[3].endswith("/") and open_.last(("svg", "math"))):
            open_.push(element)
    text(len(page))
    return root


def _elements(root: Element) -> list[Element]:
    """All elements, parents before their children."""
    order, work = [], [root]
    while work:
        here = work.pop()
        order.append(here)
        work += [c for c in reversed(here.children) if not isinstance(c, str)]
    return order


def settle(root: Element) -> list[Element]:
    """All elements in order, after dropping those with a name for noise in an article whose text is mostly in links."""
    order = _elements(root)
    if any(e.doubted for e in order):
        sizes: dict[int, tuple[int, int]] = {}
        for here in reversed(order):
            own = sum(len(c.strip()) for c in here.children if isinstance(c, str))
            below = [sizes[id(c)] for c in here.children if not isinstance(c, str)]
            total = own + sum(s for s, _ in below)
            linked = total if here.tag == "a" else sum(n for _, n in below)
            sizes[id(here)] = total, linked
            if here.doubted and linked and 2 * linked >= total:
                here.dropped = here.named = True
    return order


def blocks(root: Element, furniture: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """The text blocks that stay: those below main elements, or the whole body if none has text.

    If all of it is in elements dropped for their class or id, those are kept.
    """
    order = settle(root)
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(text)

    def walk(element: Element, named: bool = False) -> None:
        work: list = [(element, 0)]
        while work:
            here, k = work.pop()
            if k == 0 and here.tag in BLOCK:
                flush()
            while k < len(here.children):
                child = here.children[k]
                k += 1
                if isinstance(child, str):
                    run.append(html.unescape(child) if "&" in child else child)
                elif child.tag == "hr":
                    flush()
                elif child.tag in VOID:
                    run.append(" ")
                elif (not child.dropped or (named and child.named)) and child.path not in furniture:
                    work += [(here, k), (child, 0)]
                    break
            else:
                if here.tag in BLOCK:
                    flush()
        flush()

    for main in mains(order):
        if main.path not in furniture:
            walk(main)
    if not out:
        walk(root)
    if not out:
        walk(root, named=True)
    return out


def mains(order: list[Element]) -> list[Element]:
    """The outermost articles that aren't inside something dropped, else the outermost main elements."""
    found: dict[bool, list[Element]] = {True: [], False: []}
    shut: set[int] = set()  # elements below which nothing more is looked for
    covered: set[int] = set()  # elements that are or lie below a main one
    for here in order:
        above = id(here.parent)
        if above in shut or here.dropped:
            shut.add(id(here))
            continue
        if above in covered:
            covered.add(id(here))
        if here.main and here.tag == "article":
            found[True].append(here)
            shut.add(id(here))
        elif here.main and above not in covered:
            found[False].append(here)
            covered.add(id(here))
    return found[True] or found[False]


def style_nodes(order: list[Element]) -> dict[int, tuple[int, int]]:
    """path -> (digest of the content, digest of the presentation) of containers outside dropped branches and main elements.

    Inside main elements only containers with a name for noise count: what articles share may well be their text.
    """
    below: dict[int, str] = {}
    merged: dict[int, tuple[list[str], list[str]]] = {}
    dropped: set[int] = set()
    within = {id(m) for m in mains(order)}
    kept = []
    for here in order:
        if here.dropped or id(here.parent) in dropped:
            dropped.add(id(here))
            continue
        kept.append(here)
        if id(here.parent) in within:
            within.add(id(here))
    for here in reversed(kept):  # children come before their parents
        text = " ".join([" ".join(c.split()) if isinstance(c, str) else below.pop(id(c), "") for c in here.children])
        below[id(here)] = text if len(text) < 40 else f"{_digest(text):x}"
        if here.tag in CONTAINERS and (here.doubted or id(here) not in within):
            content, style = merged.setdefault(here.path, ([], []))
            content.append(text)
            style.append(" ".join([c.style for c in here.children if not isinstance(c, str)]))
    return {path: (_digest("\n".join(content)), _digest("\n".join(style))) for path, (content, style) in merged.items()}


def furniture(nodes: DataFrame, least_pages: int, threshold: float, weight: float) -> DataFrame:
    """(host, path) of the style tree's nodes of low importance; `nodes`: host, page, path, content, style, a row each."""

    def entropy(by: str) -> DataFrame:
        sizes = nodes.groupBy("host", "path", by).agg(F.count(F.lit(1)).alias("n"))
        sums = sizes.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
        # the entropy of shares n / pages to the base `pages`
        return sums.select("host", "path", "pages", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias(f"{by}_entropy"))

    both = entropy("content").join(entropy("style").drop("pages"), ["host", "path"])
    importance = weight * F.col("content_entropy") + (1 - weight) * F.col("style_entropy")
    return both.filter((F.col("pages") >= least_pages) & (importance < threshold)).select("host", "path")


def main_texts(pages: DataFrame, least_pages: int = 8, threshold: float = 0.15, weight: float = 0.9) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    Blocks are joined by two line feeds, white space inside a block is one space. Style trees are of hosts; entropies
    count distinct pages (by html), so copies don't pass for furniture, and only nodes on `least_pages` of them or
    more can. Headings, paragraphs and what stands in articles are never removed for low entropy. Null and empty html give an empty text; pages without a host share a tree. Repeated rows are pages of their own,
    null page_ids too, and other columns are ignored whatever their names. A page takes time and memory in proportion to
    its length, however deep or broken its markup is. An empty table gives an empty result.
    """
    host, _ = host_and_path(F.col("url").cast("string"))
    base = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumns({"k1": F.xxhash64("html"), "k2": F.xxhash64(F.lit("second"), "html")})

    def nodes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for site, a, b, page in zip(*(batch.column(n).to_pylist() for n in ("host", "k1", "k2", "html")), strict=True):
            rows += [(site, a, b, path, *sums) for path, sums in style_nodes(settle(parse(page))).items()]
        if rows:
            kinds = (pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "k1", "k2", "path", "content", "style"])

    tree = cut(map_batches(base.select("host", "k1", "k2", "html"), nodes, "host string, k1 long, k2 long, path long, content long, style long").distinct(), "nodes")
    low = cut(furniture(tree, least_pages, threshold, weight), "furniture")
    marked = tree.join(low, ["host", "path"]).groupBy("host", "k1", "k2").agg(F.collect_set("path").alias("furniture"))
    marked = cut(marked, "marked")

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = ["\n\n".join(blocks(parse(page), set(low or ()))) for page, low in zip(batch.column("html").to_pylist(), batch.column("furniture").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ready = base.join(marked, ["host", "k1", "k2"], "left").select("page_id", "url", "html", "furniture")
    kinds = dict(ready.dtypes)
    return map_batches(ready, extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
