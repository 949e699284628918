"""Main text of web pages by tag-path ratios.

Every text node belongs to a root-to-leaf tag path. Per path the text length and the
punctuation are summed and divided by the number of its nodes; the two ratios are fused (root of
the length, times 1 + log of 1 + punctuation), smoothed over neighbouring nodes of the same kind
with weights that fall with distance and with the difference of the paths, and averaged per
path. The threshold follows from the page: the mean of its nodes' ratios and SPREAD_SHARE of their
deviation, at most MOST_OF of the largest ratio. Nodes on paths that reach it are content.

Names weigh, they do not decide: a path in links counts LINK (headlines in links are headlines), one
through a menu, aside, footer or page header counts LOW, and so does text in elements whose class or id says
so, unless hardly anything were left without it. A header in an article is no page header.

A node below the threshold stays by its neighbours: if it lies in the lowest element that holds blocks
and all content, on a plain path, and its own part of that element is a single block or a list (in an <article> or
<main>: any part), it is kept; beside that element, single blocks stay too while a common container
below the body holds both, and a first-level headline always. So short paragraphs, headlines and lists of
an article stay, and boxes of short texts and lists of links fall. A block of text is part
of the article if one of its nodes is kept. Scripts, forms and hidden elements hold no text.

Map-only over Arrow batches, one page at a time; the scan is linear in the page.

Defined results: a null or empty page, or one without text, gives the empty text; a page
cut off in a tag, comment or script ends there; where all content lies in menus, asides,
footers or page headers the result is empty; an empty table gives no rows, other columns (also of
clashing names) are ignored; character references without a closing semicolon are decoded
as browsers do; <br> is white space inside its block; repeated rows give equal texts, a
null page_id or url stays null, and very long or deeply nested pages are read whole.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import released

#: Elements by role in a page.
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Paths through these count LOW.
BOILERPLATE = frozenset("nav header footer aside menu".split())
SKIPPED = frozenset("head form button select option dialog svg math object audio video canvas label fieldset legend datalist progress meter".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STRUCTURE = tuple("html body main article section div center table tbody tr td".split())
#: Words of class and id names that tell what is no article, anywhere in a name ...
NAMED = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored navbar breadcrumb breadcrumbs sidebar cookie cookies gdpr newsletter masthead disqus pagination pager popup modal".split())
#: ... as its last word, or as its first before a word of PARTS ...
NAMED_LAST = frozenset("banner promo promotion nav navigation menu aside footer header consent notice notices alert overlay comment comments replies reply respond share sharing social related recommended recommendations subscribe signup login search widget toolbar copyright".split())
PARTS = frozenset("area articles banner bar block body box buttons container content form icons inner items links list main message nav panel posts section stories text thread widget wrap wrapper".split())
#: ... but not where one of these says that the name is about something else.
MODIFIERS = frozenset("has no with without is open closed off on enabled disabled left right full".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>")
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")

SPREAD = 2
SPREAD_SHARE, MOST_OF = 1.0, 0.5
LINK, LOW = 0.25, 0.02
#: Kinds of paths and what they weigh.
_LOW, _LINK, _PLAIN = 0, 1, 2
WEIGHT = {_LOW: LOW, _LINK: LINK, _PLAIN: 1.0}
#: Parts of an element that hold blocks and still are one block, and elements that hold whole pages.
LISTS = frozenset("ul ol dl blockquote figure".split())
PAGES = frozenset("html body".split())
#: The share of the text that must be left without the elements that names exclude.
LEFT = 0.1
#: What ends the search for an open element of the same kind, by element.
_LIKE = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}


def _named(name: str) -> bool:
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or (MODIFIERS.intersection(words) and words[-1] not in NAMED):
        return False
    if words[0] in ("has", "no", "with", "without", "is"):
        return False
    return bool(NAMED.intersection(words)) or words[-1] in NAMED_LAST or words[0] in NAMED_LAST and len(words) > 1 and words[1] in PARTS


def _evidence(attributes: str) -> tuple[bool, bool]:
    """Whether the element is hidden or has an excluded role, and whether its names exclude it."""
    named = False
    for name, a, b, c in _MARKS.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "role" and value.lower() in ROLES:
            return True, named
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True, named
        if name in ("class", "id") and any(map(_named, value.split())):
            named = True
    return False, named


class _Page:
    """The text nodes of a page in order: text, block, path, element. Paths and elements are numbers with parents."""

    def __init__(self, page: str):
        self.nodes: list[tuple[str, int, int, int]] = []
        #: Open elements: name, whether skipped (own or above), path, element.
        self.stack: list[tuple[str, bool, int, int]] = []
        self.open_at: dict[str, list[int]] = {}
        self.block = 0
        self.paths: dict[tuple[int, str], int] = {}
        self.path_parent, self.path_depth, self.path_kind, self.path_heading, self.path_article = [0], [0], [_PLAIN], [False], [False]
        #: Element 0 is the page.
        self.parent: list[int] = [0]
        self.name: list[str] = ["html"]
        #: Whether an element holds block elements.
        self.holds: list[bool] = [True]
        self.named: set[int] = set()
        self.articles: set[int] = set()
        self.heads: set[int] = set()
        self.read(page)

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else ("", False, 0, 0)
        if not top[1] and raw:
            self.nodes.append((html_module.unescape(raw), self.block, top[2], top[3]))

    def path(self, parent: int, name: str) -> int:
        found = self.paths.get((parent, name))
        if found is None:
            found = self.paths[parent, name] = len(self.path_parent)
            self.path_parent.append(parent)
            self.path_depth.append(self.path_depth[parent] + 1)
            heading = self.path_heading[parent] or name in HEADINGS
            self.path_heading.append(heading)
            article = self.path_article[parent]
            self.path_article.append(article or name in ("article", "main"))
            own = _LOW if name in BOILERPLATE and not (article and name == "header") else _LINK if name == "a" and not heading else _PLAIN
            self.path_kind.append(min(self.path_kind[parent], own))
        return found

    def cut(self, k: int) -> None:
        for name, *_ in self.stack[k:]:
            self.open_at[name].pop()
        del self.stack[k:]

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.block += 1
            self.close_implied(name)
        elif name == "br":
            self.text(" ")
        if name in VOID:
            return
        _, skipped, path, above = self.stack[-1] if self.stack else ("", False, 0, 0)
        hidden, named = _evidence(attributes) if attributes and name not in ("html", "body") else (False, False)
        element = len(self.parent)
        self.parent.append(above)
        self.name.append(name)
        self.holds.append(False)
        if name in BLOCKS:
            self.holds[above] = True
        if named:
            self.named.add(element)
        if name in ("article", "main"):
            self.articles.add(element)
        if name in ("h1", "main"):
            self.heads.add(element)
        self.open_at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, skipped or hidden or name in SKIPPED, self.path(path, name), element))

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.open_at[n][-1] for n in names if self.open_at.get(n)), default=-1)

    def close_implied(self, name: str) -> None:
        """A block ends an open paragraph; a list item, cell or row ends its like."""
        for names, stops in ((("p",), STRUCTURE), *((_LIKE[name],) if name in _LIKE else ())):
            k = self.last(names)
            if k > self.last(stops):
                self.cut(k)

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.block += 1
        k = self.last((name,))
        if k >= 0:
            self.cut(k)

    def read(self, page: str) -> None:
        at, end, find = 0, len(page), page.find
        lower = ""
        while at < end:
            k = find("<", at)
            if k < 0:
                self.text(page[at:])
                return
            if k > at:
                self.text(page[at:k])
            if page.startswith("<!--", k):
                at = find("-->", k + 4) + 3
                if at < 3:
                    return
                continue
            tag = _TAG.match(page, k)
            if not tag:
                if page[k + 1 : k + 2].isalpha() or page[k + 1 : k + 2] in ("!", "?", "/"):
                    at = find(">", k) + 1
                    if not at:
                        return
                else:
                    self.text("<")
                    at = k + 1
                continue
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                self.close(name)
                continue
            self.open(name, tag[3])
            if name in RAW or name == "title":
                lower = lower or page.lower() if page.isascii() else lower or "".join(c.lower() if c.isascii() else c for c in page)
                at = lower.find(f"</{name}", at)
                if at < 0:
                    return

    def difference(self, a: int, b: int) -> int:
        """Steps between two paths in the tree of paths."""
        steps = 0
        while a != b:
            if self.path_depth[a] < self.path_depth[b]:
                a, b = b, a
            a = self.path_parent[a]
            steps += 1
        return steps

    def sums(self, weights: list[tuple[int, float]]) -> list[float]:
        """Per element the weights of the nodes in it, from (element, weight)."""
        out = [0.0] * len(self.parent)
        for e, w in weights:
            out[e] += w
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def inside(self, chosen: set[int]) -> list[bool]:
        """Per element whether it or an element above it is chosen."""
        out = [0 in chosen]
        for e in range(1, len(self.parent)):
            out.append(e in chosen or out[self.parent[e]])
        return out


Node = tuple[str, int, int, int]


def ratios(read: _Page, nodes: list[Node], low: list[bool]) -> dict[tuple[int, bool], float]:
    """Per path, apart for elements that names make low: length and punctuation a node, fused, weighed, smoothed over neighbouring nodes and averaged."""
    keys = [(path, low[e]) for _, _, path, e in nodes]
    sums: dict[tuple[int, bool], list[float]] = {}
    for (text, *_), key in zip(nodes, keys, strict=True):
        s = sums.setdefault(key, [0, 0, 0])
        s[0] += len(text.strip())
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += 1
    kind = {(p, named): (read.path_kind[p], named) for p, named in sums}
    fused = {k: WEIGHT[kind[k][0]] * (LOW if k[1] else 1.0) * math.sqrt(length / n) * (1 + math.log1p(marks / n)) for k, (length, marks, n) in sums.items()}
    gap: dict[tuple[int, int], int] = {}
    total: dict[tuple[int, bool], float] = dict.fromkeys(sums, 0.0)
    for i, k in enumerate(keys):
        value = weight = 0.0
        for j in range(max(0, i - SPREAD), min(len(keys), i + SPREAD + 1)):
            other = keys[j]
            if kind[k] != kind[other]:
                continue
            pair = (k[0], other[0])
            d = gap.get(pair)
            if d is None:
                d = gap[pair] = read.difference(*pair)
            w = 1 / (1 + abs(i - j) + d)
            value += w * fused[other]
            weight += w
        total[k] += value / weight
    return {k: total[k] / sums[k][2] for k in sums}


def threshold(values: list[float]) -> float:
    """The mean of the nodes' ratios and a share of their deviation, at most a share of the largest."""
    mean = sum(values) / len(values)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return min(mean + SPREAD_SHARE * deviation, MOST_OF * max(values))


def excluded(read: _Page, nodes: list[tuple[str, int, int, int]]) -> list[bool]:
    """Per element whether its names or those of an element above exclude it."""
    mass = read.sums([(e, len(text.strip()) * WEIGHT[read.path_kind[p]]) for text, _, p, e in nodes])
    # an element with the headline or the main element is a container
    keep = read.sums([(e, 1.0) for e in read.heads])
    named = {e for e in read.named if not keep[e]}
    while named:
        out = read.inside(named)
        outermost = [e for e in named if not out[read.parent[e]]]
        if mass[0] - sum(mass[e] for e in outermost) >= LEFT * mass[0]:
            return out
        # hardly anything is left: the largest of them, and what in it holds nearly all of it, are containers
        largest = max(outermost, key=lambda e: (mass[e], -e))
        below = read.inside({largest})
        named -= {e for e in named if e == largest or below[e] and mass[e] >= (1 - LEFT) * mass[largest]}
    return [False] * len(read.parent)


def kept(read: _Page, full: list[Node]) -> set[int]:
    """The places in full of the nodes of the article."""
    low = excluded(read, full)
    score = ratios(read, full, low)
    limit = threshold([score[path, low[e]] for _, _, path, e in full])
    content = {k for k, (_, _, path, e) in enumerate(full) if score[path, low[e]] >= limit}
    if all(read.path_kind[full[k][2]] == _LOW for k in content):
        return set()
    held = read.sums([(full[k][3], 1.0) for k in content])
    # of the elements that hold all content the last to begin is the lowest
    core = max(e for e, n in enumerate(held) if n == len(content))
    # a single block is not yet what holds the article
    while not read.holds[core]:
        core = read.parent[core]
    within, above = read.inside({core}), set()
    e = core
    while e:
        e = read.parent[e]
        above.add(e)
    in_article = read.inside(read.articles)
    out = set(content)
    for k, (_, _, path, e) in enumerate(full):
        if k in content or read.path_kind[path] != _PLAIN or low[e]:
            continue
        part = None
        while not held[e]:
            part, e = e, read.parent[e]
        single = part is None or not read.holds[part] or read.name[part] in LISTS
        if within[e]:
            if single or in_article[e]:
                out.add(k)
        elif e in above:
            headline = read.path_heading[path] and part is not None and read.name[part] == "h1"
            if headline or single and read.name[e] not in PAGES:
                out.add(k)
    return out


def extract(page: str) -> str:
    """The main text of one page."""
    read = _Page(page)
    full = [n for n in read.nodes if n[0].strip()]
    if not full:
        return ""
    chosen = {full[k][1] for k in kept(read, full)}
    blocks: dict[int, list[str]] = {}
    for text, block, _, _ in read.nodes:
        if block in chosen:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
