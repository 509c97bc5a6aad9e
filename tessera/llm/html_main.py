"""Main text of web pages, with site templates removed.

A page is parsed into elements in page order.  Templates go first: two hashes
are made of an element's subtree, one of its content and one of its shape (the
path to it, and the names and classes inside it, without words).  Spark counts
on how many different pages of a host each hash occurs.  Deleted are

* contents that recur on a large share or a large number of a host's pages;
* shapes that recur likewise, hold little of their pages' text and lie beside
  the page's main column (from the body down to whatever child holds most of the
  text), such as menus, adverts and footers whose words change.

What is left of menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments on pages of small hosts is told by element and by
words in class, id and role.  An element that holds the article, the main
element or the headline is never dropped by such words.  Inside an article only
containers (div, section, lists) are candidates, so a copied article keeps its
paragraphs; copies of a page count once.

The text is that of the page's articles, else of its main element, else of
what is left of the body.  All work on a page is linear in its length.

Defined cases: null html is the empty page with the empty text; a null url
belongs to the host ''; unclosed and misnested elements are closed where the
next block begins or the enclosing element ends; nesting may be of any depth; an
unclosed quote is an ordinary character, an unclosed script, style, title or
textarea reaches to the end; repeated pages get equal texts; a column named like
the result is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .url_parts import host_of

# Element names and cue words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas noframes xmp select audio video".split())
BOILERPLATE = frozenset("nav footer aside form button dialog menu header head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CUES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination comment comments disqus respond share sharing social related recommended widget toolbar skip".split()
)
WHOLE_CUES = frozenset("header footer site-header site-footer page-header page-footer masthead topbar bottombar".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr body".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body blockquote form nav aside footer header".split())
IN_ARTICLE = frozenset("div section ul ol dl table figure".split())
NEGATIONS = frozenset("has is no not with without".split())
TO_THE_END = frozenset("script style textarea title".split())
TEXTUAL = frozenset("html body main article p h1 h2 h3 h4 h5 h6 pre blockquote li td th tr tbody dt dd figcaption".split())
#: A template's shape holds at most this share of its pages' text on average.
SMALL_PART = 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.I)
_CUE = re.compile(r"[a-z]+")


OPEN, CLOSE = 0, 1


class Page:
    """Elements in page order, so that parents come before their children, and
    ``items``: (element, text), (element, OPEN) and (element, CLOSE) in order."""

    def __init__(self) -> None:
        self.tag, self.kind, self.parent, self.cue, self.hard = ["html"], [""], [-1], [False], [False]
        self.items: list[tuple[int, str | int]] = []


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """The class, whether words in it or the id are cues, and whether role, style or hidden mark boilerplate."""
    kind, cue, hard = "", False, False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m.group(1).lower(), (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name in ("class", "id"):
            kind = value if name == "class" else kind
            for token in value.split():
                parts = _CUE.findall(token)
                # Words in the middle of a name say nothing: market-share-report.
                cue = cue or token in WHOLE_CUES or bool(parts) and parts[0] not in NEGATIONS and not CUES.isdisjoint((parts[0], parts[-1]))
        elif name == "role":
            hard = hard or value in ROLES
        elif name == "style":
            hard = hard or "display:none" in value.replace(" ", "")
        else:
            hard = hard or name == "hidden" or value == "true"
    return kind, cue, hard


def parse(html: str) -> Page:
    """The elements of a page; raw elements are left out."""
    page, stack = Page(), [0]
    near: list[dict[str, int]] = [{}]  # for each open element: places of p, li, td, ... open in its scope
    block = [0]  # and of the closest element that isn't inline
    opened: dict[str, list[int]] = {}
    endless: set[str] = set()

    def pop_to(i: int) -> None:
        while len(stack) > i:
            e = stack.pop()
            near.pop()
            block.pop()
            opened[page.tag[e]].pop()
            page.items.append((e, CLOSE))

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            page.items.append((stack[-1], html[at : m.start()]))
        at, tag = m.end(), m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            # A stray end of an inline element closes no block.
            if opened.get(tag) and not (tag in INLINE and block[-1] > opened[tag][-1]):
                pop_to(opened[tag][-1])
            continue
        raw = m.group(3)
        if tag in RAW:
            if not raw.endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else len(html) if tag in TO_THE_END else at
            continue
        if tag in VOID:
            page.items.append((stack[-1], " "))
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and "p" in near[-1]:
            pop_to(near[-1]["p"])
        if tag in SELF_CLOSING and (places := [near[-1][x] for x in SELF_CLOSING[tag] if x in near[-1]]):
            pop_to(min(places) if tag == "tr" else max(places))
        kind, cue, hard = _attributes(raw) if raw and not raw.isspace() else ("", False, False)
        e = len(page.tag)
        for column, value in ((page.tag, tag), (page.kind, kind), (page.parent, stack[-1]), (page.cue, cue), (page.hard, hard)):
            column.append(value)
        page.items.append((e, OPEN))
        if raw.rstrip().endswith("/"):
            page.items.append((e, CLOSE))
            continue
        place = len(stack)
        near.append({} if tag in SCOPE else {**near[-1], tag: place} if tag == "p" or tag in SELF_CLOSING else near[-1])
        block.append(block[-1] if tag in INLINE else place)
        opened.setdefault(tag, []).append(place)
        stack.append(e)
    if at < len(html):
        page.items.append((stack[-1], html[at:]))
    for e in reversed(stack[1:]):
        page.items.append((e, CLOSE))
    return page


def _holds(page: Page, own: list[bool]) -> list[bool]:
    """Whether an element or one inside it is marked."""
    out = list(own)
    for e in range(len(out) - 1, 0, -1):
        if out[e]:
            out[page.parent[e]] = True
    return out


def _most(page: Page) -> list[bool]:
    """Whether an element holds at least half of the page's text."""
    size = [0] * len(page.tag)
    for e, x in page.items:
        if isinstance(x, str):
            size[e] += len(x) - x.count(" ")
    for e in range(len(size) - 1, 0, -1):
        size[page.parent[e]] += size[e]
    return [2 * n >= size[0] > 0 for n in size]


def boilerplate(page: Page) -> list[bool]:
    """Elements to drop by name, class, id, role or style.  On a page without an
    article or main element neither a form nor a class or id is a reason to drop
    what holds at least half of the text."""
    tags = page.tag
    mains = [t in ("article", "main") and not page.cue[e] for e, t in enumerate(tags)]
    if not any(mains):
        mains = [t in ("article", "main") for t in tags]
    main, head = _holds(page, mains), _holds(page, [t == "h1" for t in tags])
    page_itself = [False] * len(tags) if any(mains) else _most(page)
    out = []
    for e, t in enumerate(tags):
        named = t in BOILERPLATE and not main[e] and not (t == "header" and head[e]) and not (t == "form" and page_itself[e])
        cue = page.cue[e] and not main[e] and not head[e] and not page_itself[e] and t not in ("html", "body")
        out.append(named or cue or page.hard[e] and t not in ("html", "body"))
    return out


def _main_roots(page: Page, gone: list[bool]) -> list[bool]:
    """Outermost articles that are not within what is gone, else main elements, else the page."""
    lost = list(gone)
    for e in range(1, len(lost)):
        lost[e] = lost[e] or lost[page.parent[e]]
    for tag in ("article", "main"):
        inside, roots = [False] * len(lost), [False] * len(lost)
        for e in range(1, len(lost)):
            above = inside[page.parent[e]]
            roots[e] = page.tag[e] == tag and not lost[e] and not above
            inside[e] = above or roots[e]
        if any(roots):
            return roots
    return [e == 0 for e in range(len(lost))]


def _signed(text: str) -> int:
    digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return digest - (1 << 64) if digest >> 63 else digest


def subtree_hashes(page: Page) -> list[tuple[int | None, int | None, bool, float]]:
    """For each element: its content's hash, its shape's, whether it lies beside
    the main column, and its share of the page's text; no hash of what is no
    candidate."""
    n, parent = len(page.tag), page.parent
    parts: list[list[str]] = [[] for _ in range(n)]
    size = [0] * n
    for e, x in page.items:
        if isinstance(x, str):
            t = " ".join(x.split())
            parts[e].append(t)
            size[e] += len(t)
        elif x == CLOSE:
            own = f"<{page.tag[e]} {page.kind[e]}>{''.join(parts[e])}</>"
            parts[e] = [own if len(own) <= 200 else f"#{xxhash.xxh64_hexdigest(own.encode('utf-8', 'surrogatepass'))}", own]
            parts[parent[e]].append(parts[e][0])
    for e in range(n - 1, 0, -1):
        size[parent[e]] += size[e]
    # The set of all names inside as the sum of their hashes, which doesn't depend on
    # their order.  The smaller of two sets goes into the larger one.
    name = [f"{t}.{k}" for t, k in zip(page.tag, page.kind, strict=True)]
    code = {x: _signed(x) for x in set(name)}
    inside: list[set[str]] = [set() for _ in range(n)]
    total = [0] * n
    for e in range(n - 1, 0, -1):
        up = parent[e]
        small, large, added = inside[e], inside[up], total[up]
        if len(small) > len(large):
            small, large, added = large, small, total[e]
        new = {name[e], *small} - large
        large |= new
        inside[e], inside[up], total[up] = set(), large, added + sum(map(code.__getitem__, new))
    path = [0] * n
    for e in range(1, n):
        path[e] = _signed(f"{path[parent[e]]}/{name[e]}")
    # The main column: from the body to the child that holds most of the text.
    children: list[list[int]] = [[] for _ in range(n)]
    for e in range(1, n):
        children[parent[e]].append(e)
    at = 0
    while children[at] and (best := max(children[at], key=size.__getitem__)) and size[best] * 2 > size[at]:
        at = best
        if page.tag[at] in TEXTUAL and page.tag[at] not in ("body", "main", "article"):
            break
    on = [False] * n
    for e in range(n):
        on[e] = e == at or e > 0 and on[parent[e]]
    while at >= 0:
        on[at] = True
        at = parent[at]
    main = _holds(page, [t in ("article", "main", "h1") for t in page.tag])
    articles = [t in ("article", "main") for t in page.tag]
    within = list(articles)
    for e in range(1, n):
        within[e] = within[e] or within[parent[e]]
    out: list[tuple[int | None, int | None, bool, float]] = []
    for e, t in enumerate(page.tag):
        open_ = e > 0 and size[e] > 0 and t not in INLINE and t != "body" and not articles[e]
        content = _signed(parts[e][1]) if open_ and (not within[e] or t in IN_ARTICLE) and len(parts[e]) == 2 else None
        shape = _signed(f"shape {path[e]} {total[e]}") if open_ and t not in TEXTUAL and not main[e] else None
        out.append((content, shape, not on[e], size[e] / max(size[0], 1)))
    return out


def main_text(page: Page, gone: frozenset[int] | set[int] = frozenset()) -> tuple[str, int, int]:
    """Blocks of the main parts in page order, joined by empty lines, and how
    many subtrees went as templates and by their names."""
    named = boilerplate(page)
    template = [c in gone or s in gone for c, s, _, _ in subtree_hashes(page)] if gone else [False] * len(named)
    both = [a or b for a, b in zip(named, template, strict=True)]
    roots = _main_roots(page, both)
    lost, kept, counts = [False] * len(both), [False] * len(both), [0, 0]
    for e in range(len(both)):
        above = e > 0 and lost[page.parent[e]]
        own = both[e] and not roots[e]
        lost[e], kept[e] = above or own, roots[e] or e > 0 and kept[page.parent[e]]
        if own and not above:
            counts[0 if template[e] else 1] += 1
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        s = "".join(line)
        line.clear()
        s = " ".join((entities.unescape(s) if "&" in s else s).split())
        if s:
            blocks.append(s)

    for e, x in page.items:
        if isinstance(x, str):
            if kept[e] and not lost[e]:
                line.append(x)
        elif page.tag[e] not in INLINE:
            flush()
    flush()
    return "\n\n".join(blocks), counts[0], counts[1]


def template_hashes(pages: DataFrame, host: Column, html: str = "html", min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """(host, hashes): subtrees that occur on ``min_pages`` of a host's different
    pages at least, and on the share ``min_share`` of them, however many they are.

    A host's array is bounded: it has at most as many hashes as its pages have
    candidates on average, divided by the share.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, text in zip(batch["host"].tolist(), batch["html"].tolist(), strict=True):
                page = parse(text)
                body = _signed(main_text(page)[0])
                rows.append((h, None, body, 1.0, 0.0))
                own: dict[int, tuple[float, float]] = {}
                for content, shape, off, share in subtree_hashes(page):
                    if content is not None:
                        own[content] = (1.0, 0.0)
                    if shape is not None:
                        a, b = own.get(shape, (1.0, 0.0))
                        own[shape] = (min(a, float(off)), b + share)
                rows += [(h, x, body, off, share) for x, (off, share) in own.items()]
            yield pd.DataFrame({"host": [r[0] for r in rows], "hash": pd.array([r[1] for r in rows], "Int64"), "body": [r[2] for r in rows], "off": [r[3] for r in rows], "share": [r[4] for r in rows]})

    seen = pages.select(host.alias("host"), text_of(pages, html).alias("html")).mapInPandas(run, "host string, hash bigint, body bigint, off double, share double")
    once = seen.groupBy("host", "hash", "body").agg(F.min("off").alias("off"), F.max("share").alias("share"))
    with Scratch(pages.sparkSession) as scratch:
        counts = scratch.write(once.groupBy("host", "hash").agg(F.count("*").alias("n"), F.avg("off").alias("off"), F.avg("share").alias("share")), "subtrees")
        total = counts.where("hash is null").select("host", F.col("n").alias("pages"))
        often = counts.where("hash is not null").join(total, "host").where((F.col("n") >= min_pages) & (F.col("n") >= F.col("pages") * min_share) & (F.col("off") >= 0.8) & (F.col("share") <= SMALL_PART))
        return scratch.keep(scratch.write(often.groupBy("host").agg(F.collect_set("hash").alias("hashes")), "templates"))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", to: str = "text", min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """``pages`` without ``html`` and with the main text as column ``to``, and
    ``n_template`` and ``n_named``: subtrees deleted as templates and by name."""
    more = ("n_template", "n_named")
    keep = [c for c in pages.columns if c not in (html, to, *more)]
    named = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], text_of(pages, html).alias("html"), host_of(pages[url]).alias("host"))
    templates = template_hashes(named, F.col("host"), "html", min_pages, min_share)

    @F.pandas_udf("text string, n_template long, n_named long")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hashes in batches:
            out, last, gone = [], None, frozenset()
            for text, own in zip(texts.tolist(), hashes.tolist(), strict=True):
                if own is not last:
                    last, gone = own, frozenset() if own is None else frozenset(map(int, own))
                out.append(main_text(parse(text), gone))
            yield pd.DataFrame(out, columns=["text", *more])

    both = named.join(templates, "host", "left").withColumn("out", extract("html", "hashes"))
    return both.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("out.text").alias(to), *[F.col(f"out.{c}").alias(c) for c in more])
