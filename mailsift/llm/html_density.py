"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import map_rows

# Fixed values of HTML: elements without an end tag, elements whose content is not markup,
# and elements that begin a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)

#: Elements that never hold the article's text.
ASIDE_TAGS = frozenset(
    "nav footer aside menu dialog button select datalist object svg canvas audio video annotation annotation-xml "
    "template head".split()
)
#: Words of class, id, role and aria-label attributes that name what surrounds an article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert announcement banner breadcrumb breadcrumbs consent "
    "contentinfo cookie cookies footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion "
    "recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription taboola toolbar topbar widget".split()
)
#: Those of them that may as well name a part of the article: such a part goes only where it
#: is short or mostly links.
UNSURE_WORDS = frozenset(
    "alert announcement banner login notice notices notification promotion recommended related search share sharing "
    "signup skip social subscription widget".split()
)
#: Fewer characters than this are short.
SHORT = 60
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: The same for what readers write below it; an article element may be one of these.
READER_WORDS = frozenset("comment comments disqus replies reply respond responses".split())
#: With these, a name tells what a whole page or article has beside it, not what an element
#: is: comments-open, no-comments, with-sidebar.
BESIDE_WORDS = frozenset("has no with without".split())
STATE_WORDS = BESIDE_WORDS | frozenset("allowed closed count disabled enabled off on open status".split())
#: Words of names that tell place or shape. A name with words of other kinds may be about
#: its subject: sidebar-left is a sidebar, modal-verbs need not be a window.
LAYOUT_WORDS = frozenset(
    "area bar block body bottom box col column container content desktop fixed form frame global group header holder "
    "inline inner item items large layout left link links list main mobile module outer page panel primary region right "
    "row secondary section site slot small sticky text title top unit user wide wrap wrapper zone".split()
)
ARTICLE_TAGS = ("article", "main")
#: Beginnings and ends of such words written as one: topnav, menubar, siteheader, commentlist.
ASIDE_STARTS = ("adverti", "breadcrumb", "cookie", "footer", "menu", "navbar", "newsletter", "sidebar", "sponsor")
ASIDE_ENDS = ("banner", "cookies", "footer", "menu", "navbar", "sidebar", "topnav", "subnav", "sitenav")
READER_STARTS, READER_ENDS = ("commentbox", "commentform", "commentlist", "commentsection"), ("comment", "comments")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?P<value>["']|[^\s>"'][^\s>]*+)?)?""")
_TAG_END = re.compile(r"[\s/]*+>")
_WORDS = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    """An element with what the density of its subtree is made of."""

    __slots__ = ("tag", "parent", "parts", "aside", "reader", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "head")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False, reader: bool = False, named: str = ""):
        self.tag, self.parent, self.aside, self.reader, self.named = tag, parent, aside, reader, named
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.head = False
        if parent is not None:
            parent.parts.append(self)


class Tree:
    """The elements of a page in order, built in one pass over its text.

    Lenient as browsers are: blocks end an open paragraph, items end the item before,
    end tags without a start tag are skipped, the end of the page ends everything. The
    work is linear whatever the markup: no search is repeated that has once failed.
    """

    def __init__(self, page: str, raw: frozenset[str] = RAW):
        self.page, self.raw = page, raw
        self.root = Node("body", None)
        self.nodes = [self.root]
        self.open = [self.root]
        self.count: dict[str, int] = {}
        self.items: list[int] = []  # places in `open` of lists, tables and their parts
        self.last = {q: page.rfind(q) for q in "\"'"}
        self._build()

    def _build(self) -> None:
        page, at = self.page, 0
        while True:
            start = page.find("<", at)
            self._text(page[at:] if start < 0 else page[at:start])
            if start < 0:
                return
            if name := _NAME.match(page, start + 1):
                at = self._start(name.group().lower(), name.end())
            elif page.startswith("</", start) and (name := _NAME.match(page, start + 2)):
                self._end(name.group().lower())
                at = self._after(">", name.end())
            elif page.startswith("<!--", start):
                at = self._after("-->", start + 2 if page.startswith("<!-->", start) else start + 4)
            elif page.startswith(("<!", "<?", "</"), start):
                at = self._after(">", start + 2)
            else:
                self._text("<")
                at = start + 1

    def _after(self, mark: str, start: int) -> int:
        end = self.page.find(mark, start)
        return len(self.page) if end < 0 else end + len(mark)

    def _text(self, text: str) -> None:
        if text:
            self.open[-1].parts.append(text)

    def _attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes that begin at a place, and the place after their tag."""
        page, found = self.page, {}
        while not (end := _TAG_END.match(page, at)):
            attribute = _ATTRIBUTE.match(page, at)
            if not attribute:
                at += 1
                if at >= len(page):
                    return found, at
                continue
            value, at = attribute["value"] or "", attribute.end()
            if value in self.last:
                # A quote that nothing closes is a plain character.
                close = page.find(value, at) if at <= self.last[value] else -1
                value, at = (page[at:close], close + 1) if close >= 0 else ("", at)
            found.setdefault(attribute[1].lower(), value)
        return found, end.end()

    def _start(self, tag: str, at: int) -> int:
        attributes, at = self._attributes(at)
        if tag in ("html", "body"):
            return at
        if tag in self.raw:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at)
            return self._after(">", close.end()) if close else len(self.page)
        if tag in BLOCKS:
            if self.count.get("p"):
                self._close("p")
            self._close_item(tag)
        if tag == "br":
            self._text(" ")
            return at
        node = Node(tag, self.open[-1], *_surrounds(tag, attributes))
        node.head = tag == "header" or _HEADER.search(attributes.get("class", "") + " " + attributes.get("id", "")) is not None
        self.nodes.append(node)
        if tag not in VOID:
            if tag in _ENDS or tag in _LISTS:
                self.items.append(len(self.open))
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1
        return at

    def _close_item(self, tag: str) -> None:
        """An item ends the one before it in the same list or table."""
        ends = _ENDS.get(tag, ())
        while ends and self.items and self.open[self.items[-1]].tag in ends:
            self._close(self.open[self.items[-1]].tag)

    def _end(self, tag: str) -> None:
        if self.count.get(tag):
            self._close(tag)
        elif tag == "p":
            self._text("\n")

    def _close(self, tag: str) -> None:
        while True:
            node = self.open.pop()
            self.count[node.tag] -= 1
            if self.items and self.items[-1] == len(self.open):
                self.items.pop()
            if node.tag == tag:
                return


_LISTS = frozenset("ul ol dl table select".split())
#: Which open items a new one ends.
_ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "option": ("option",),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tr": ("td", "th", "tr"),
    "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"),
    "thead": ("td", "th", "tr", "thead", "tbody", "tfoot"),
    "tfoot": ("td", "th", "tr", "thead", "tbody", "tfoot"),
}


def _surrounds(tag: str, attributes: dict[str, str]) -> tuple[bool, bool, str]:
    """Whether an element surrounds the article, whether readers wrote it, and if its name tells.

    A name is SURE, UNSURE, or LOOSE, which is UNSURE inside an article; `_weigh` has the last
    word on these. Names of a state (comments-open) do not make an element the readers'. The header of a page
    surrounds the article; that of an article is settled later.
    """
    if tag in ASIDE_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True, False, ""
    if _HIDDEN.search(attributes.get("style", "")):
        return True, False, ""
    if tag in HEADINGS:
        return False, False, ""
    names = [
        frozenset(w for w in _WORDS.split(n) if w) for a in _TELLING if a in attributes for n in attributes[a].lower().split()
    ]
    readers = [n for n in names if any(map(_of_readers, n))]
    if any(not n & STATE_WORDS for n in readers):
        return True, True, SURE
    if tag in ARTICLE_TAGS:
        return False, False, ""
    if tag == "form":
        return True, False, SURE
    kinds = {_kind(n) for n in names if n in readers or any(map(_of_asides, n))}
    return bool(kinds), False, next((k for k in (SURE, LOOSE, UNSURE) if k in kinds), "")


def _of_readers(word: str) -> bool:
    return word in READER_WORDS or word.startswith(READER_STARTS) or word.endswith(READER_ENDS)


def _of_asides(word: str) -> bool:
    return word in ASIDE_WORDS or word.startswith(ASIDE_STARTS) or word.endswith(ASIDE_ENDS)


def _kind(name: frozenset[str]) -> str:
    """How surely a name of words, some of which name surroundings, names just these."""
    telling = set(filter(_of_asides, name))
    if name & BESIDE_WORDS or not telling - UNSURE_WORDS:
        return UNSURE
    others = {w for w in name - telling - LAYOUT_WORDS if len(w) > 1 and not w.isdigit()}
    return LOOSE if others else SURE


SURE, LOOSE, UNSURE = "sure", "loose", "unsure"
_HEADER = re.compile(r"(?i)(?:^|[^a-z])(?:site|page|top|main)?header(?![a-z])")
_TELLING = ("class", "id", "role", "aria-label")


def _weigh(tree: Tree, lenient: bool) -> None:
    """Keep what only its name makes an aside, if what it holds says otherwise.

    A name that may be a section's counts for short parts and for links. Without an article
    element, no name hides most of the page's text. A lenient look goes by no name at all.
    """
    chars = {id(n): 0 for n in tree.nodes}
    links = dict(chars)
    for node in reversed(tree.nodes):
        if node.aside and not node.named:
            continue
        for part in node.parts:
            if isinstance(part, str):
                chars[id(node)] += sum(map(len, part.split()))
        if node.tag == "a":
            links[id(node)] = chars[id(node)]
        if node.parent is not None:
            chars[id(node.parent)] += chars[id(node)]
            links[id(node.parent)] += links[id(node)]
    article = any(n.tag in ARTICLE_TAGS and not n.reader for n in tree.nodes)
    inside: set[int] = set()
    for node in tree.nodes:  # parents come first
        if not node.reader and (node.tag in ARTICLE_TAGS or id(node.parent) in inside):
            inside.add(id(node))
        own, linked = chars[id(node)], links[id(node)]
        most = not article and 2 * own > chars[id(tree.root)]
        if node.named and (
            lenient
            or most and not node.reader
            or (node.named == UNSURE or node.named == LOOSE and id(node) in inside) and own >= SHORT and 2 * linked < own
        ):
            node.aside = node.reader = False
        if most or lenient:
            node.head = False


def _settle(tree: Tree) -> None:
    """Let go of the article what only seemed to surround it."""
    inside: set[int] = set()
    for node in tree.nodes:  # parents come first
        if node.tag in ARTICLE_TAGS and not node.reader or id(node.parent) in inside and not node.reader:
            inside.add(id(node))
        if node.head and id(node) not in inside and node.tag not in ARTICLE_TAGS:
            node.aside = True
        if node.tag == "button" and id(node) in inside and _in_sentence(node):
            node.aside = False
    for node in tree.nodes:
        if node.tag in ARTICLE_TAGS and not node.reader:
            above = []
            parent = node.parent
            while parent is not None and not parent.reader:
                if parent.aside:
                    above.append(parent)
                elif parent.tag in ARTICLE_TAGS:
                    break  # that one has cleared the way
                parent = parent.parent
            if parent is None or not parent.reader:
                for x in above:
                    x.aside = False
                    x.reader = False


def _in_sentence(node: Node) -> bool:
    """Whether a paragraph's own text goes on before and after an element."""
    if node.parent.tag not in ("p", "li", "dd", "td"):
        return False
    parts = node.parent.parts
    at = next(i for i, x in enumerate(parts) if x is node)
    return all(any(isinstance(x, str) and x.strip() for x in side) for side in (parts[:at], parts[at + 1 :]))


def _cover(tree: Tree) -> None:
    """What lies inside an aside is one too."""
    for node in tree.nodes:  # parents come first
        if node.parent is not None and node.parent.aside:
            node.aside = True


def _measure(tree: Tree) -> None:
    """Counts of every subtree, children before parents, then densities and their sums."""
    for node in reversed(tree.nodes):
        if node.aside:
            continue
        for part in node.parts:
            if isinstance(part, str):
                part = html.unescape(part) if "&" in part else part
                n = sum(map(len, part.split()))
                node.chars += n
            elif not part.aside:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = tree.root
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in tree.nodes:
        if not node.aside and node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
            if node.parent is not None:
                node.parent.total += node.density


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, lowered as more of the characters and tags are links.

    ``body_share`` is the share of link characters in the whole page. A subtree without
    text has density 0.
    """
    if not chars:
        return 0.0
    per_tag = chars / max(tags, 1)
    plain, linked = max(chars - link_chars, 1), max(link_chars, 1)
    base = math.log(chars / plain * link_chars + body_share * chars + math.e)
    return per_tag * math.log1p(chars / linked * max(tags, 1) / max(link_tags, 1)) / math.log1p(base)


def _chosen(tree: Tree) -> tuple[Node, float]:
    """The subtree that holds the article, and the least density on its path to the body."""
    best = max((n for n in tree.nodes if not n.aside), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    articles = [n for n in path if n.tag in ARTICLE_TAGS]
    if articles:
        # An article within another is a part of it; articles side by side are parts of their parent.
        top = ([articles[0]] + [n for n in articles if n.tag == "article"])[-1]
        beside = [x for x in top.parent.parts if isinstance(x, Node) and x is not top and x.tag == top.tag]
        prose = [x for x in beside if not x.aside and x.chars >= SHORT and 2 * x.link_chars < x.chars]
        return top.parent if prose else top, threshold
    chosen = best
    for node in path[1:]:
        if any(_dense(x, threshold) for x in node.parts if isinstance(x, Node) and x is not chosen):
            chosen = node
        else:
            break
    return chosen, threshold


def _dense(node: Node, threshold: float) -> bool:
    return not node.aside and node.density >= threshold > 0 and 2 * node.link_chars < node.chars


def _link_list(node: Node) -> bool:
    """Whether an element is a list of links with short labels, as menus are and sources are not."""
    links = node.tag in ("ul", "ol") and node.link_tags > 1 and 10 * node.link_chars >= 9 * node.chars
    return links and node.link_chars < SHORT // 2 * node.link_tags


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag != "article":
        node = node.parent
    return node is not None


def _blocks(top: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space made single."""
    blocks: list[list[str]] = [[]]
    lists = _in_article(top) or any(isinstance(x, Node) and x.tag == "article" for x in top.parts)
    work: list[str | Node | None] = [top]
    while work:
        part = work.pop()
        if part is None:
            blocks.append([])
        elif isinstance(part, str):
            blocks[-1].append(part)
        elif part is top or not (part.aside or not lists and _link_list(part)):
            if part.tag in BLOCKS:
                blocks.append([])
                work.append(None)
            work.extend(reversed(part.parts))
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by line feeds."""
    if not page:
        return ""
    # By names; by no name, if these hid everything; with what is shown without scripts.
    for lenient, raw in ((False, RAW), (True, RAW), (False, RAW - {"noscript"})):
        tree = Tree(page, raw)
        _weigh(tree, lenient)
        _settle(tree)
        _cover(tree)
        _measure(tree)
        top, _ = _chosen(tree)
        blocks = _blocks(top)
        if blocks:
            break
    return "\n".join(blocks)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``.

    Every element of the page has a density: its characters per tag, lowered by links.
    The subtree whose children's densities have the greatest sum holds the article; it is
    widened to the article or main element around it, or else to parents with other
    children as dense as the least dense element between it and the body. Menus, headers,
    footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
    left out by element, class, id and role before densities are taken. A name alone hides
    no heading, no long part in prose if it may name a section, and not most of a page
    without an article element; a name that also tells of other things hides no long prose
    inside an article, and one of a state (comments-open, with-sidebar) no long prose at
    all. Where nothing is left, names do not count; where nothing is left again, what a
    page shows without scripts does. A button stays inside a sentence of an article. Outside an
    article, lists of links with short labels are left out. Character references are decoded, white space in a block becomes one space,
    blocks are joined by one line feed; nothing else is dropped.

    Pages are read one at a time in one pass without a shuffle, in time and memory linear
    in the page. A null, empty or text-less page gives an empty text. Broken markup is
    read leniently. Repeated rows and null ids come out as they are; extra columns are not
    read; an empty table gives no rows.
    """

    def make():
        def row(i, address, value):
            text = main_text(value)
            yield i, address, text, len(text)

        return row

    columns = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("page"))
    return map_rows(columns, ["id", "url", "page"], make, "page_id bigint, url string, text string, n_chars bigint")
