"""Main text of web pages: templates deduced from equivalence classes of tokens, and the slots between them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored, table

#: A class is valid from so many different pages of a host and so many tokens on.
LEAST_PAGES, LEAST_TOKENS = 3, 2
#: The article's element holds such a share of its pages' text; a text on so large a share of a host's pages is template.
MOST = 0.5

# Fixed values of HTML: elements without content, with content that is no text, that end a paragraph, and that close one another.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea title iframe object select option button svg math canvas audio video map datalist head".split())
RAW = frozenset("script style textarea title iframe noscript noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br caption".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that can hold an article.
SECTIONS = frozenset("body div article main section center table tbody tr td".split())
#: Elements, roles and words of class names or ids that mark what is not the article, where the template leaves it open.
ASIDE_TAGS = frozenset("nav aside footer form dialog menu".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget ad ads advert adverts advertisement advertising "
    "banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "share sharing social related recommended comment comments disqus reply replies respond form search login signup pagination pager toolbar skip".split()
)
MAIN_WORDS = frozenset("article articlebody post entry content story main maincontent".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+))|([^\s=/>\"']+)")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    tag: str
    parent: Element | None
    path: int
    token: int = 0  # the path, with the first element inside
    aside: bool = False
    asides: int = 0  # marked by a tag, a role or as hidden, itself and around it
    named: int = 0  # marked by a name, up to the main part around it
    main: int = 0  # 2: article, 1: main part by another mark
    in_main: bool = False
    linked: bool = False  # in a link
    first: int = 0  # its blocks begin here
    last: int = 0  # and end before here
    begun: bool = False  # an element inside has begun

    @property
    def out(self) -> bool:
        return self.asides + self.named > 0


@dataclass
class Block:
    element: Element
    text: str
    link: int = 0
    token: int = 0

    @property
    def links(self) -> bool:
        return self.link * 2 > len(self.text)


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)

    def sums(self, skip: set[int] | frozenset[int] = frozenset()) -> list[int]:
        """The length of the text up to each block, without asides, lists of links and ``skip``."""
        out = [0]
        for b in self.blocks:
            out.append(out[-1] + (0 if b.element.out or b.links or b.token in skip else len(b.text)))
        return out

    def tokens(self) -> list[tuple[int, int, bool, int, int]]:
        """Every token with the token around it, whether it is a text, its occurrences, and the length of the text inside. The page itself is token 0."""
        sums, out = self.sums(), {0: (0, False, 1, 0)}
        for e in self.elements:
            inside = sums[e.last] - sums[e.first] if e.tag in SECTIONS and not e.out else 0
            old = out.get(e.token, (e.parent.token, False, 0, 0))
            out[e.token] = (min(old[0], e.parent.token), False, old[2] + 1, old[3] + inside)
        for b in self.blocks:
            old = out.get(b.token, (b.element.token, True, 0, 0))
            out[b.token] = (min(old[0], b.element.token), True, old[2] + 1, 0)
        return [(k, *v) for k, v in out.items()]

    def likeness(self) -> int:
        """Stands for the page's longest text: pages that share it are copies of one page."""
        best = max((b.text for b in self.blocks), key=lambda t: (len(t), t), default="")
        return _signed(xxhash.xxh64_intdigest(best.encode("utf-8", "replace")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _path(parent: int, step: str) -> int:
    return _signed(xxhash.xxh64_intdigest(step.encode("utf-8", "replace"), parent & ((1 << 63) - 1)))


def _named(attributes: dict[str, str]) -> set[str]:
    words = set()
    for name in ("class", "id", "itemprop"):
        words.update(w.lower() for w in _WORD.findall(attributes.get(name, "")))
        words.update(attributes.get(name, "").lower().split())
    return words


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _mark(e: Element, up: Element, attributes: dict[str, str]) -> None:
    """Sets what tags, roles and names say about an element."""
    words, role = _named(attributes), attributes.get("role", "").lower()
    own = words & {"comment", "comments", "reply", "related", "sidebar", "widget", "ad", "ads", "advert", "sponsored", "promo"}
    named = False
    if e.tag in ("article", "main") and not own:
        e.main = 2 if e.tag == "article" else 1
    elif e.tag not in ("html", "body"):
        e.aside = e.tag in ASIDE_TAGS or e.tag in HIDDEN or role in ASIDE_ROLES or e.tag == "header" and not up.in_main
        named = not e.aside and bool(words & ASIDE_WORDS) and not (up.in_main and e.tag == "header")
        if not e.aside and not named and (role in ("main", "article") or words & MAIN_WORDS and e.tag in ("div", "section", "td")):
            e.main = 1
    e.aside = e.aside or _hidden(attributes)
    e.asides = up.asides + e.aside
    e.named = 0 if e.main and not e.asides else up.named + named
    e.in_main = up.in_main or e.main > 0


def parse(text: str) -> Page:
    """The page's text blocks and elements in order.

    Any text is taken: open ends reach to the end of the page, stray end tags count for nothing.
    """
    page = Page()
    root = Element("", None, 0)
    stack = [root]
    parts: list[str] = []
    linked = 0
    at, end = 0, len(text)

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(parts).split())
        if joined:
            e = stack[-1]
            while e.tag not in BLOCK and e.parent is not None:
                e = e.parent
            page.blocks.append(Block(e, joined, linked, _path(e.path, "#" + joined)))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and stack[-1].tag not in HIDDEN:
            s = html.unescape(raw)
            parts.append(s)
            if stack[-1].linked:
                linked += len(s.strip())

    def close(to: int) -> None:
        for e in stack[to:]:
            e.last = len(page.blocks)
        del stack[to:]

    while at < end:
        m = _TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(e.tag in BLOCK for e in stack[i:]):
                        flush()
                    close(i)
                    break
            continue
        if tag in BLOCK:
            flush()
            if tag != "br":
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in ("button", "td", "th", "div", "article", "section", "li"):
                        break
        if tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag]:
                    close(i)
                    if stack[-1].tag not in SAME[tag]:
                        break
                elif stack[i].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        attributes = {}
        for a in _ATTRIBUTE.finditer(m[3] or ""):
            attributes.setdefault((a[1] or a[5]).lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        up = stack[-1]
        path = _path(up.path, f"{tag}.{_DIGITS.sub('', attributes.get('class', ''))}")
        e = Element(tag, up, path, path, linked=up.linked or tag == "a", first=len(page.blocks), last=len(page.blocks))
        if not up.begun:
            # elements that share a path differ by what comes first inside
            up.begun, up.token = True, _path(up.path, f">{tag}") if up is not root else 0
        _mark(e, up, attributes)
        page.elements.append(e)
        if tag in VOID or (m[3] or "").rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close_tag = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = close_tag.end() if close_tag else end
            continue
        stack.append(e)
    flush()
    close(0)
    return page


def _slots(page: Page, top: Element, links: bool, skip: set[int] | frozenset[int]) -> list[Block]:
    """The blocks in ``top`` but those in asides of it and those to skip."""
    inside = page.blocks[top.first : top.last]
    return [b for b in inside if b.element.asides == top.asides and b.element.named == top.named and (links or not b.links) and b.token not in skip]


def main_text(page: Page, fixed: set[int] | frozenset[int] = frozenset(), articles: set[int] | frozenset[int] = frozenset()) -> str:
    """The text of the slots that make the article.

    ``fixed``: texts of the host's template, which are no slots, unless they lie in a marked main part or nothing else is left. ``articles``: the
    template's elements that hold most of their pages' text; the innermost on the page is the article, unless a main
    part is marked that lies elsewhere, or within or around it. Without either it is what the page's text lies in
    for the most part, without lists of links.
    """
    whole = Element("", None, 0, last=len(page.blocks))
    best, top, links = (0, 0), None, True
    for m in page.elements:
        if m.main and not m.asides:
            size = sum(len(b.text) for b in _slots(page, m, True, fixed))
            if size and (m.main, size) > best:
                best, top = (m.main, size), m
    marked = top is not None
    if not marked:
        sums, top, links = page.sums(fixed), whole, False
        for e in page.elements:
            size = sums[e.last] - sums[e.first]
            if e.token in articles and size and e.tag in SECTIONS and not e.out:
                top = e
        if top is whole:
            for e in page.elements:
                size = sums[e.last] - sums[e.first]
                if e.tag in SECTIONS and top.first <= e.first and e.last <= top.last and size > MOST * (sums[top.last] - sums[top.first]):
                    top = e
        heads = {id(e.parent): e for e in reversed(page.elements) if e.tag in ("h1", "h2") and not e.out}
        if top.parent is not None and top.parent.tag in SECTIONS - {"body"} and id(top.parent) in heads and heads[id(top.parent)].last <= top.first:
            top = top.parent  # with its heading
    # what a marked article repeats of others is its text all the same
    for skip in (frozenset(),) if marked else (fixed, frozenset()):
        kept = _slots(page, top, links, skip)
        if kept:
            break
    return " ".join(b.text for b in kept)


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def template_tokens(pages: DataFrame) -> DataFrame:
    """Occurrences by host and token: ``host``, ``token``, ``parent``, ``text`` (whether a text block), ``pages``, ``times``, a signature of the occurrence vector, and ``inside``, ``all``: the text in it and on its pages.

    The signature sums a hash of page and count over the pages, so vectors are compared without being gathered.
    Null and empty pages count for nothing, and pages with one longest text (copies of a page) count as one.
    """
    plain = pages.where("html <> ''").select(_host().alias("host"), "html")

    def run(batches):
        for b in batches:
            out = []
            for host, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page = parse(text)
                like, size = page.likeness(), page.sums()[-1]
                out += [(host, like, *t, size) for t in page.tokens()]
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "page", "token", "parent", "text", "n", "inside", "all"])

    rows = plain.mapInArrow(run, "host string, page long, token long, parent long, text boolean, n long, inside long, all long")
    once = rows.groupBy("host", "token", "page").agg(F.min(F.struct("parent", "text", "n", "inside", "all")).alias("x"))
    entry = F.xxhash64("page", "x.n")
    half = F.lit(0xFFFFFFFF)
    return once.groupBy("host", "token").agg(
        F.min("x.parent").alias("parent"), F.max("x.text").alias("text"), F.count("*").alias("pages"), F.sum("x.n").alias("times"),
        F.sum(entry.bitwiseAND(half)).alias("low"), F.sum(F.shiftrightunsigned(entry, 32).bitwiseAND(half)).alias("high"),
        F.sum("x.inside").alias("inside"), F.sum("x.all").alias("all"),
    )


def _classes(tokens: DataFrame, least_tokens: int) -> DataFrame:
    """``tokens`` with ``class`` and ``outer``, the class that it is nested in (null at the top); only those of valid classes."""
    vector = ["host", "pages", "times", "low", "high"]
    classes = tokens.groupBy(*vector).agg(F.count("*").alias("tokens"), F.min("token").alias("class")).where(F.col("tokens") >= least_tokens)
    valid = stored(tokens.join(classes, vector).drop("tokens", "low", "high"), "html-classes")
    around = valid.select("host", F.col("token").alias("parent"), F.col("class").alias("outer"))
    placed = valid.join(around, ["host", "parent"], "left").withColumn("outer", F.when(F.col("outer") == F.col("class"), None).otherwise(F.col("outer")))
    nested = placed.groupBy("host", "class").agg(F.max("outer").alias("outer"), F.count_distinct("outer").alias("outers")).where("outers <= 1")
    return placed.drop("outer").join(nested.drop("outers"), ["host", "class"])


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """The template of each host: ``host``, ``token``, ``text``, ``pages``, ``times``, ``class``, ``outer`` (the class it is nested in) and ``article``: whether it is an element that stands once on its pages and holds most of their text.

    Tokens of a host with equal occurrence vectors form a class; it is valid if it has enough tokens on enough
    pages. A class lies in the class of the tag around it; one whose tags lie in different ones is not nested and
    drops out. A text on most pages of its host is of the template too, with no class, and so is the page itself (token 0).
    """
    tokens = stored(template_tokens(pages).where(F.col("pages") >= least_pages), "html-tokens")
    found = stored(_classes(tokens, least_tokens), "html-nested")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("of"))
    often = F.col("text") & (F.col("pages") >= MOST * F.col("of")) | (F.col("token") == 0)
    common = tokens.where("text or token = 0").join(hosts, "host").where(often).select("host", "token")
    common = common.join(found.select("host", "token"), ["host", "token"], "left_anti").join(tokens, ["host", "token"])
    article = ~F.col("text") & (F.col("times") == F.col("pages")) & (F.col("inside") > MOST * F.col("all"))
    out = found.select("host", "token", "text", "pages", "times", "class", "outer", article.alias("article"))
    none = F.lit(None).cast("long")
    return out.union(common.select("host", "token", "text", "pages", "times", none, none, F.lit(False)))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` per row of ``pages``.

    What the host's template says decides (see ``main_text``). Hosts of fewer than ``least_pages`` different pages
    have none; there each page decides for itself. Null and empty pages have an empty text; a null url is a host of
    its own; repeated rows each get the same text.
    """
    found = stored(templates(pages, least_pages, least_tokens), "html-templates")
    hosts = found.where("token = 0").select("host", F.col("pages").alias("of"))
    text = F.col("text") & (F.col("pages") >= MOST * F.col("of"))
    parts = found.join(hosts, "host").where(text | F.col("article")).groupBy("host").agg(
        F.collect_list(F.when(F.col("text"), F.col("token"))).alias("fixed"), F.collect_list(F.when(F.col("article"), F.col("token"))).alias("articles")
    )
    parts = stored(parts, "html-fixed")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host")).join(parts, "host", "left")
    rows = rows.select("page_id", "url", "html", "fixed", "articles")

    def run(batches):
        for b in batches:
            sets = [[frozenset(x or ()) for x in b.column(i).to_pylist()] for i in (3, 4)]
            texts = [main_text(parse(h), f, a) for h, f, a in zip(b.column(2).to_pylist(), *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
