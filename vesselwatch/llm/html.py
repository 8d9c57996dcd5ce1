"""Main text of web pages by consensus of a host's pages.

Each page scores its containers by the text that their blocks hold outside links and boilerplate. The
best container, widened to the wrapper that also holds its title, lead and further sections, has a path
(tags and classes, with what varies from page to page removed) that is the page's vote;
Spark counts votes for each host, and all of a host's pages are extracted again by the winning path.
A page that has no container on that path falls back to its own best. Containers
that stand beside it under the body are part of the text if they hold prose, unless a path holds some on a few of the host's pages only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches, lookup_join, materialize

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe noembed noframes xmp svg".split())
#: Elements that are never part of the main text.
DROPPED = RAW | frozenset("head nav header footer aside form button select option menu dialog object video audio canvas map label fieldset".split())
#: Words that, as a whole class or id or as its last word, mark such parts.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "header masthead footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies share sharing social related recommended widget copyright".split()
)
#: Last words of a class or id that only say where or how a part is shown, and first ones that turn a mark into a property.
QUALIFIERS = frozenset("left right top bottom inner outer container wrapper wrap box block area list links item items slot unit bar panel".split())
PROPERTIES = frozenset("has have no not non with without show hide is".split())
#: A marked element with more than this share of the page's text is the page itself.
MOST = 0.8
#: Characters of a text outside links from which on a container beside the main one is prose.
PROSE = 40
CONTAINERS = frozenset("article main section div td body center table tbody tr ul ol dl blockquote".split())
#: Elements that begin and end a block of text.
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figure figcaption hr th caption details summary thead tfoot html hgroup search".split()) | DROPPED
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("td tr th tbody thead tfoot caption html body head".split()) - RAW
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")


def path_number(step: str, above: int = 0) -> int:
    """The number of a path: a 64-bit hash of its last step (tag and classes) and the number of the path above, so of one size at any depth."""
    return xxhash.xxh3_64_intdigest(step, above & (2**64 - 1)) - 2**63


class _Element:
    __slots__ = ("tag", "path", "dropped", "container", "mark")

    def __init__(self, tag: str, path: int, dropped: bool, container: int, mark: int = 0):
        self.tag, self.path, self.dropped = tag, path, dropped
        self.mark = mark  # number of the innermost marked element around it, itself included; 0: none
        self.container = container  # the nearest one, itself included


class _Page:
    """Blocks (text, characters in links, container, mark) in page order; containers and marks by number, each after those around it."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, int]] = []
        self.mark_around = [0]  # of marked elements, from 1 on
        # of containers; the first one is the implied body: it holds what no other holds
        self.tags, self.paths, self.around, self.marks = ["body"], [0], [-1], [0]
        self.dropped = [False]

    def new_container(self, element: _Element, around: int) -> int:
        self.tags.append(element.tag)
        self.paths.append(element.path)
        self.around.append(around)
        self.marks.append(element.mark)
        self.dropped.append(element.dropped)
        return len(self.tags) - 1


def _is_mark(token: str) -> bool:
    """True for ``sidebar``, ``ad1``, ``cookie-notice``, ``navLeft``; not for ``has-sidebar``, ``ad-free``, ``notice-board``."""
    if re.sub(r"[\W\d_]+", "", token).lower() in MARKS:
        return True
    words = [w.lower() for w in _WORDS.findall(token)]
    if not words or words[0] in PROPERTIES:
        return False
    while len(words) > 1 and words[-1] in QUALIFIERS and words[-1] not in MARKS:
        words.pop()
    return words[-1] in MARKS


def _marked(attributes: str) -> tuple[str, bool]:
    """(classes without digits for the path, whether class or id mark boilerplate)."""
    classes, marked = [], False
    for name, a, b, c in _ATTR.findall(attributes):
        value = a or b or c
        marked |= any(_is_mark(w) for w in value.split())
        if name.lower() == "class":
            classes += [re.sub(r"\d+", "", w) for w in value.split()]
    return "".join(f".{w}" for w in sorted(set(classes)) if w), marked


def parse(html: str) -> _Page:
    """What the markup holds, in one pass: the work doesn't grow with the depth of elements."""
    page = _Page()
    stack = [_Element("body", 0, False, 0)]
    places: dict[str, list[int]] = {}  # by tag: where in the stack its open elements are
    parts: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not stack[-1].dropped:
                page.blocks.append((text, linked, stack[-1].container, stack[-1].mark))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link
        for element in stack[depth:]:
            in_link -= element.tag == "a"
            places[element.tag].pop()
        del stack[depth:]

    def innermost(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        depth = innermost(tags)
        if depth > innermost(within):
            flush()
            pop_to(depth)

    at = 0
    while m := _TAG.search(html, at):
        if m.start() > at and not stack[-1].dropped:
            parts.append(html[at : m.start()])
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag == "br" or tag in BLOCKS:
                flush()
            if places.get(tag):
                depth = places[tag][-1]
                if stack[depth].mark != stack[-1].mark or stack[depth].mark != stack[depth - 1].mark:
                    flush()
                pop_to(depth)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in ENDS_P:
            close(("p",), ("td", "th", "table", "button", "object"))
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in BLOCKS:
            flush()
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "math")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        above = stack[-1]
        classes, marked = _marked(attributes) if attributes else ("", False)
        mark = above.mark
        if tag == "noscript" or marked and tag not in ("html", "body", "main", "article"):
            page.mark_around.append(mark)
            mark = len(page.mark_around) - 1
            flush()  # its text is a block of its own
        path = path_number(f"{tag}{classes}", above.path) if tag in BLOCKS else above.path
        element = _Element(tag, path, above.dropped or tag in DROPPED, above.container, mark)
        if tag in CONTAINERS:
            element.container = page.new_container(element, above.container)
        in_link += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
    if at < len(html) and not stack[-1].dropped:
        parts.append(html[at:])
    flush()
    return page


def _without_marked(page: _Page) -> list[bool]:
    """Leaves the blocks outside marked elements in ``page``, all if nothing else is left; says which containers may be the main one.

    An element that holds most of the page's text isn't boilerplate, however it is marked.
    """
    held = [0] * len(page.mark_around)
    for text, _, _, mark in page.blocks:
        held[mark] += len(text)
    total = sum(held)
    for k in range(len(held) - 1, 0, -1):
        held[page.mark_around[k]] += held[k]
    whole = [n > MOST * total for n in held]  # what lies around such an element holds as much
    whole[0] = True
    kept = [b for b in page.blocks if whole[b[3]]]
    if page.blocks and not kept:
        return [not d for d in page.dropped]
    page.blocks = kept
    return [not d and whole[mark] for d, mark in zip(page.dropped, page.marks, strict=True)]


def _totals(page: _Page, value: Callable[[str, int, int], float], share: float = 1) -> list[float]:
    """A sum over the blocks in each container; what an inner container holds counts ``share`` in the one around it."""
    sums = [0.0] * len(page.tags)
    for text, linked, container, _ in page.blocks:
        sums[container] += value(text, linked, container)
    for k in range(len(sums) - 1, 0, -1):
        sums[page.around[k]] += share * sums[k]
    return sums


def _widened(page: _Page, best: int) -> int:
    """The smallest container around ``best`` that also holds the prose beside it.

    What a wrapper adds must have at most half as many characters in links as outside. The body holds
    other parts of the page too: it is taken only if what it adds stands in no container of its own.
    """
    blocks = _totals(page, lambda *_: 1)
    size, links = _totals(page, lambda text, *_: len(text)), _totals(page, lambda _, linked, __: linked)
    elsewhere = _totals(page, lambda _, __, container: page.tags[container] != "body")
    outer = page.around[best]
    while outer >= 0:
        added = blocks[outer] - blocks[best]
        if 3 * (links[outer] - links[best]) > size[outer] - size[best] or (page.tags[outer] == "body" and elsewhere[outer] > elsewhere[best]):
            break
        if added:
            best = outer
        outer = page.around[outer]
    return best


def main_container(page: _Page, allowed: list[bool]) -> int | None:
    """The number of the best container, None without any text outside links."""
    scores = _totals(page, lambda text, linked, _: max(0, len(text) - 2 * linked), 0.5)
    best = max((k for k in range(len(scores)) if allowed[k]), key=lambda k: (scores[k], -k), default=None)
    if best is None or not scores[best]:
        return None
    semantic: dict[str, int] = {}
    k = best
    while k >= 0:
        semantic[page.tags[k]] = k  # the outermost of its tag
        k = page.around[k]
    for tag in ("article", "main"):
        if tag in semantic:
            return semantic[tag]
    return _widened(page, best)


def _beside(page: _Page, allowed: list[bool], chosen: list[bool]) -> dict[int, bool]:
    """Containers of their own beside chosen parts of the body, and whether they hold prose, whatever their sizes.

    Prose has some text outside links, and at most a third of it in them. Beside an article only articles count, beside main nothing.
    """
    tops: dict[int, set[str]] = {}
    for k, c in enumerate(chosen):
        if c and page.around[k] >= 0 and page.tags[page.around[k]] == "body":
            tops.setdefault(page.around[k], set()).add(page.tags[k])
    if not tops:
        return {}
    size, links = _totals(page, lambda text, *_: len(text)), _totals(page, lambda _, linked, __: linked)
    plain = [0] * len(page.tags)
    for text, linked, container, _ in page.blocks:
        while container >= 0 and plain[container] < len(text) - linked:
            plain[container] = len(text) - linked
            container = page.around[container]
    out = {}
    for k, top in enumerate(page.around):
        tags = tops.get(top)
        if tags and not chosen[k] and allowed[k] and "main" not in tags and ("article" not in tags or page.tags[k] == "article"):
            out[k] = plain[k] >= PROSE and 3 * links[k] <= size[k]
    return out


def ballot(html: str) -> tuple[int | None, dict[int, bool]]:
    """The number of the best container's path, and of the paths beside it with whether they hold prose."""
    page = parse(html)
    allowed = _without_marked(page)
    best = main_container(page, allowed)
    if best is None:
        return None, {}
    beside: dict[int, bool] = {}
    for k, prose in _beside(page, allowed, [p == page.paths[best] for p in page.paths]).items():
        beside[page.paths[k]] = prose or beside.get(page.paths[k], False)
    return page.paths[best], beside


def best_path(html: str) -> int | None:
    return ballot(html)[0]


def extract(html: str, path: int | None, rejected: Collection[int] = ()) -> str:
    """The text of the blocks in containers on ``path``; without such, of the page's own best container. Prose beside them belongs to it but on ``rejected`` paths."""
    page = parse(html)
    allowed = _without_marked(page)
    for k in (path, None):
        if k is None:
            own = main_container(page, allowed)
            if own is None:
                return ""
            k = page.paths[own]
        chosen = [p == k for p in page.paths]
        for beside, prose in _beside(page, allowed, chosen).items():
            chosen[beside] = prose and page.paths[beside] not in rejected
        if found := _within(page, chosen):
            return " ".join(found)
    return ""


def _within(page: _Page, chosen: list[bool]) -> list[str]:
    """Texts of the blocks in chosen containers, in page order; of the body's own parts not those that hold links for more than a third."""
    lists: set[int] = set()
    if any(c and page.tags[k] == "body" for k, c in enumerate(chosen)):
        size, links = _totals(page, lambda text, *_: len(text)), _totals(page, lambda _, linked, __: linked)
        lists = {k for k, around in enumerate(page.around) if around >= 0 and page.tags[around] == "body" and page.tags[k] != "body" and 3 * links[k] > size[k]}
    for k in range(1, len(chosen)):
        chosen[k] = chosen[k] or (chosen[page.around[k]] and k not in lists)
    return [text for text, _, container, _ in page.blocks if chosen[container]]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            path, beside = ballot(html.as_py() or "")
            if path is not None:
                rows += [(host, path, True, True), *((host, p, False, prose) for p, prose in beside.items())]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["host", "path", "leads", "prose"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            texts = [extract(h.as_py() or "", p.as_py(), frozenset(r.as_py() or ())) for h, p, r in zip(*(part.column(k) for k in (2, 3, 4)), strict=True)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    Blocks of the main container are stripped of markup and of menus, headers, footers, sidebars, notices,
    adverts, forms, scripts, styles and comments; parts that only a class or id marks as such (and noscript)
    stay if they hold most of the page's text or nothing else is left; character references are decoded, white space inside
    a block becomes one space, blocks are joined in page order by one space.

    Defined cases: a null or empty html, or one without text, gives the empty text; a page without a host
    (null url, or none in it) votes with all others without one; broken or cut-off markup is read as far as
    it goes; repeated rows are extracted alike; ids may be null or repeated; an empty table gives an
    empty result; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_vote, "host string, path long, leads boolean, prose boolean")
    votes = votes.groupBy("host", "path").agg(F.count_if("leads").alias("n"), F.count_if(~F.col("leads")).alias("stands"), F.count_if(~F.col("leads") & F.col("prose")).alias("prose"))
    # most votes; ties: the path of the smallest number. Against prose beside it: what most of the host's pages don't hold prose in
    winners = votes.groupBy("host").agg(
        F.min_by(F.when(F.col("n") > 0, F.col("path")), F.when(F.col("n") > 0, F.struct(-F.col("n"), F.col("path")))).alias("path"),
        F.collect_list(F.when((F.col("stands") > 1) & (2 * F.col("prose") < F.col("stands")), F.col("path"))).alias("rejected"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    return (
        lookup_join(rows, materialize(winners, "paths"), "host", F.xxhash64("id", "url")).select("id", "url", "html", "path", "rejected")
        .mapInArrow(_extract, f"id {kind}, url string, text string")
        .select(F.col("id").alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
    )
