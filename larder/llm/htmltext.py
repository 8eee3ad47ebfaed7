"""Main text of HTML pages by tree scoring: paragraphs pass points to their ancestors, discounted by link density."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names of the HTML standard by role, and words that class, id and role use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas textarea title xmp noembed noframes audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("nav header footer aside form menu dialog button select option input label fieldset head".split()) | RAW
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article".split())
CONTAINER = {"article": 30.0, "main": 20.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0}
ENDS_P = BLOCK - {"html", "body", "head"}
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}
LIMITS = {"li": ("ul", "ol", "menu", "dir"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "tfoot": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banners?|sponsor(?:ed|s)?|promo(?:s|tion)?|comments?|disqus|respond|replies|reader-comments|sidebars?|"
    r"side-bar|menus?|nav|navbar|navigation|breadcrumbs?|footers?|header|masthead|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscribe|"
    r"subscription|share|sharing|social|related|recommended|outbrain|taboola|pager|pagination|login|signup|search|widgets?|toolbar|skip|alert|disclaimer|copyright)(?:$|[\s_-])",
    re.I,
)
UNLIKELY_ROLE = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form note".split())
#: Names of layout ("has-sidebar") tell of other elements; names of readers' words are never the article's own for their length.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)[_-]\S+", re.I)
SENTENCE = 40
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADLINES = frozenset(("h1", "h2"))
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies|reader-comments)(?:$|[\s_-])", re.I)
#: Words that go along with those of UNLIKELY in names and change nothing about them.
HELPERS = frozenset(
    "area bar block bottom box button buttons card center column container content desktop entry form full global group head holder home icon icons inner item "
    "items large left link links list main mobile module outer page panel post right row section site slot small sticky story text title top unit wrap wrapper".split()
)
LIKELY = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.I)
# A quote opens a value only right after "="; anywhere else it is a character like others. A quote that
# nothing closes opens nothing. A tag that the page's end cuts off ends there.
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE})?+)?+)*+)(?:>|\Z)|<[!?/][^>]*+>?", re.S
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
#: Ends of raw elements, searched in the page as it is; only ASCII letters match without regard to case.
_RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in RAW}
#: Raw elements whose content browsers take as text to the page's end where nothing closes them.
TO_THE_END = frozenset("script style title textarea noscript iframe xmp".split())
_SPACES = re.compile(r"\s+")


class Node:
    """An element: children are elements, strings of text, or None for a break between blocks' words."""

    __slots__ = ("attrs", "children", "dead", "doubted", "inside_link", "parent", "score", "tag", "text_len", "link_len")

    def __init__(self, tag: str, parent: Node | None, dead: bool = False):
        self.tag, self.parent, self.children, self.dead, self.score = tag, parent, [], dead, None
        self.attrs, self.doubted, self.text_len, self.link_len = {}, 0, 0, 0
        self.inside_link = tag == "a" or bool(parent and parent.inside_link)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _dead(tag: str, attrs: dict[str, str]) -> bool:
    if tag in DROPPED:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in UNLIKELY_ROLE:
        return True
    return "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _names(attrs: dict[str, str]) -> str:
    """Class and id, without what they tell of other elements."""
    return LAYOUT.sub("", f"{attrs.get('class', '')} {attrs.get('id', '')}") if attrs else ""


def _doubted(tag: str, attrs: dict[str, str]) -> int:
    """0 for names that speak of no other part of a page, 2 where a whole name does ("cookie-banner"), 1 where only a part of one ("share-price")."""
    if tag in ("html", "body", "article", "main") or not attrs:
        return 0
    names = _names(attrs)
    if not UNLIKELY.search(names):
        return 0
    for name in names.split():
        if UNLIKELY.search(name) and all(UNLIKELY.search(x) or x.lower() in HELPERS for x in re.split(r"[_-]+", name) if x):
            return 2
    return 1


class _Open:
    """The elements that are open, and for each name at which depths, so that no tag searches through them one by one."""

    def __init__(self) -> None:
        self.root = Node("html", None)
        self.stack = [self.root]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close_from(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def close_tag(self, tag: str) -> None:
        if found := self.depths.get(tag):
            self.close_from(found[-1])

    def close_paragraph(self) -> None:
        if self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.close_from(self.blocks[-1])

    def close_above(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        """Closes the outermost of ``tags`` that is open inside the innermost of ``limits``."""
        limit = max((found[-1] for x in limits if (found := self.depths.get(x))), default=0)
        firsts = [found[k] for x in tags if (found := self.depths.get(x)) and (k := bisect_right(found, limit)) < len(found)]
        if firsts:
            self.close_from(min(firsts))


def parse(page: str) -> Node:
    """A tree of the page. Elements left open are closed as the HTML standard does for p, li, dt, dd and table parts;
    an end tag without its start is left out; what scripts, styles and the like hold is not text."""
    open_ = _Open()
    at = 0
    unclosed: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            open_.stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            open_.close_tag(tag)
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            open_.close_paragraph()
        if tag in CLOSES:
            open_.close_above(CLOSES[tag], LIMITS.get(tag, ()))
        node = open_.stack[-1]
        attrs = attributes(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in RAW:
            if (not m[3].endswith("/") or tag in TO_THE_END) and tag not in unclosed:
                if end := _RAW_ENDS[tag].search(page, at):
                    stop = page.find(">", end.end())
                    at = stop + 1 if stop >= 0 else len(page)
                elif tag in TO_THE_END:
                    at = len(page)
                else:
                    unclosed.add(tag)
            node.children.append(None)
            continue
        new = Node(tag, node, node.dead or _dead(tag, attrs))
        new.attrs, new.doubted = attrs, 0 if new.dead else _doubted(tag, attrs)
        node.children.append(new)
        if tag not in VOID:
            open_.push(new)
    if at < len(page):
        open_.stack[-1].children.append(page[at:])
    return open_.root


def _measure(root: Node) -> list[Node]:
    """All living elements, parents first; sets how much text each holds, and how much of it in links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.dead:
            continue
        order.append(node)
        node.text_len = node.link_len = 0
        stack.extend(c for c in node.children if isinstance(c, Node))
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.text_len += own
        node.link_len += own if node.inside_link else 0
        if node.parent is not None:
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
    return order


def link_density(node: Node) -> float:
    return node.link_len / node.text_len if node.text_len else 0.0


def drop_doubted(root: Node) -> list[Node]:
    """Marks elements dead whose name is not an article's, and returns them.

    Where only a part of a name is such a word ("share-price"), the name says nothing of an element of running
    text: SENTENCE characters or more, or a heading, mostly outside links and without blocks inside.

    The largest come first. One lives if it holds more text outside links than all that lives so far, unless it is
    named for readers' words, or a fourth as much where it also has an article's name or its largest article element
    holds as much, or if it holds the main element; never one that is mostly links.
    """
    order = _measure(root)
    for node in order:
        if node.doubted == 1 and link_density(node) < 0.5 and (node.text_len >= SENTENCE or node.tag in HEADINGS) and _is_leaf(node):
            node.doubted = 0
    doubted = [n for n in order if n.doubted]
    if not doubted:
        return []
    plain = lambda n: n.text_len - n.link_len
    owner: dict[Node, Node] = {}
    outside: dict[Node, int] = {}
    largest: dict[Node, float] = {}
    for node in order:
        owner[node] = node if node.doubted or node is root else owner[node.parent]
        own = 0 if node.inside_link else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        outside[owner[node]] = outside.get(owner[node], 0) + own
        if node.tag in ("article", "main") and plain(node) and not UNLIKELY.search(_names(node.attrs)):
            up = owner[node]
            value = float("inf") if node.tag == "main" else plain(node)
            while up is not root and largest.get(up, 0.0) < value:  # parents come first, so most stop at once
                largest[up] = value
                up = owner[up.parent]
    living, dropped = outside[root], []
    for node in sorted(doubted, key=lambda n: -plain(n)):
        above = owner[node.parent]
        if above.dead:
            node.dead = True
            continue
        names = _names(node.attrs)
        named = any(LIKELY.search(x) and not UNLIKELY.search(x) for x in names.split())
        enough = plain(node) > living and not READERS.search(names) or named and plain(node) * 4 > living or largest.get(node, 0) * 4 > living
        if plain(node) and link_density(node) < 0.5 and enough:
            living += outside[node]
        else:
            node.dead = True
            dropped.append(node)
    return dropped


def _is_leaf(node: Node) -> bool:
    """Whether no child of the element is a block."""
    return not any(isinstance(c, Node) and c.tag in BLOCK for c in node.children)


def _own_text(node: Node) -> str:
    """Text of the node that no block inside it holds."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                out.append(c)
            elif c is not None and c.tag not in BLOCK and not c.dead:
                stack.append(c)
    return "".join(out).strip()


def best_container(root: Node, order: list[Node]) -> Node | None:
    """The element of the most points. A paragraph gives one point, one for each comma and up to three for length
    to its parent, half to the grandparent, a third of that half to the next; containers start with points by name."""
    for node in order:
        if node.tag not in SCORED:
            continue
        text = _own_text(node)
        if len(text) < 2:
            continue
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - link_density(node))
        up, share = node.parent, 1.0
        for level in range(3):
            if up is None:
                break
            if up.score is None:
                names = f"{up.attrs.get('class', '')} {up.attrs.get('id', '')}"
                up.score = CONTAINER.get(up.tag, 0.0) + (10.0 if LIKELY.search(names) else 0.0)
            up.score += points * share
            up, share = up.parent, 0.5 if level == 0 else share / 3
    best, top = None, float("-inf")
    for node in order:
        if node.score is not None and (value := node.score * (1 - link_density(node))) > top:
            best, top = node, value
    if best is None and root.text_len:
        best = root
    return best


def _has_headline(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in HEADLINES:
            return True
        stack.extend(c for c in x.children if isinstance(c, Node) and not c.dead)
    return False


def kept_parts(best: Node) -> list[Node]:
    """The best container and those of its siblings that look like more of the article, in page order. Headlines before
    a container without one are its own; before one that has one they are the site's."""
    if best.parent is None:
        return [best]
    limit = max(10.0, (best.score or 0.0) * 0.2)
    kept: list[Node] = []
    headless, before = not _has_headline(best), True
    for node in best.parent.children:
        if node is best:
            kept.append(node)
            before = False
        elif isinstance(node, Node) and not node.dead:
            same = best.attrs.get("class") and node.attrs.get("class") == best.attrs["class"]
            scored = node.score is not None and node.score * (1 - link_density(node)) + (0.2 * (best.score or 0) if same else 0) >= limit
            headline = before and headless and node.tag in HEADLINES and node.text_len > 0 and link_density(node) < 0.5
            if scored or headline or node.tag == "p" and (node.text_len > 80 and link_density(node) < 0.25 or 0 < node.text_len and node.link_len == 0 and re.search(r"\.(?:\s|$)", _own_text(node))):
                kept.append(node)
    return kept


def blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks inside, in page order; a character reference is decoded once."""
    held: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None or x is False:
            if x is False and held:
                yield "".join(held)
                held = []
        elif not x.dead:
            if x.tag == "br":
                held.append("\n")
                continue
            block = x.tag in BLOCK
            if block:
                stack.append(False)
            stack.extend(reversed(x.children))
            if block:
                stack.append(False)
    if held:
        yield "".join(held)


def main_text(page: str | None) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one space; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    dropped = drop_doubted(root)
    best = best_container(root, _measure(root))
    if best is None and dropped:  # once more without the names
        for node in dropped:
            node.dead = False
        best = best_container(root, _measure(root))
        if best is not None and link_density(best) >= 0.5:
            best = None
    if best is None:
        return ""
    found = (_SPACES.sub(" ", html.unescape(b)).strip() for part in kept_parts(best) for b in blocks(part))
    return " ".join(b for b in found if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html.

    Null and empty html give an empty text. Pages without an article give what the best
    scored container holds, or an empty text where nothing but menus and the like is left. Names
    of class and id alone never drop what holds most of a page's text (``drop_doubted``). Formulas' text is kept, not their
    annotations. Words of label and button elements go as parts of forms, also inside a sentence, and so does a
    paragraph whose whole class is a notice's.
    Repeated rows give equal rows; other columns are not read. A row is worked on alone, so
    there is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return slim.mapInArrow(run, SCHEMA)
