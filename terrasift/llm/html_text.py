"""Main text of web pages by scoring a tree: paragraphs pass points to their ancestors, link density discounts them, and
the best container is kept with the siblings that belong to it."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, strings

# HTML's elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
#: Elements that are never part of an article.
DROPPED = frozenset("nav footer aside form button select option head object audio video canvas dialog menu fieldset label datalist template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes open elements of these on top of the stack.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end tags of others do not reach across, but for end tags of these.
BARRIERS = frozenset("td th table article".split())
STRUCTURE = frozenset("table tr tbody article body html main section div".split())
#: Names (class, id, role) of what is no article, as whole words of the name or as a part that is only used so.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adbox|advert\w*|aside|banner|breadcrumbs?|comments?|commentlist|contact|cookies?|consent|disqus|"
    r"footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|popup|"
    r"promo\w*|recommend\w*|related|reply|replies|respond|rss|search|share|sharing|side(?:bar|nav)?|signup|social|sponsor\w*|"
    r"subscribe|tags?|toolbar|topbar|bottombar|widgets?|alert|alerts|gdpr|skip|complementary|contentinfo|discussion|reviews?|"
    r"copyright|disclaimer|login)(?=$|[\s_-]|\d)",
    re.IGNORECASE,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_-])", re.IGNORECASE)
BESIDE = re.compile(r"(?:has|with|without|no)[_-]\w+|(?:article|entry|post|story|content)[_-]header(?![\w-])", re.IGNORECASE)
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
SPACE = re.compile(r"\s+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Quotes count only after "="; one that is never closed is part of an unquoted value. No part is tried in two ways.
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    rf"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s]++|/(?!>)|[^\s/>=]++(?:\s*+=\s*+{VALUE})?+|=)*+)(/?+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({VALUE}))?+")
NAMED = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)

#: Points an element starts with: marked articles, then what usually holds text; and what a likely name adds.
PRIOR = {"article": 40.0, "main": 30.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "pre": 2.0}
LIKELY_POINTS = 25.0
#: Shares of a paragraph's points that its nearest containers get; marked articles around it get all of them.
PASSED = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: A sibling belongs to the best container with this share of its points; a part of it goes with more than this share of
#: its characters in links, if it has several links.
SIBLING, LINKED = 0.2, 0.6
PARTS = frozenset("div section ul ol dl table".split())


def unlikely(names: str) -> bool:
    """Whether a class, id or role tells that an element is no article.

    Names that say what lies beside an article ("has-sidebar"), or that it begins ("entry-header"), tell nothing, and one
    of an article outweighs the others. Humps part words as hyphens do.
    """
    each = [BESIDE.sub("", HUMP.sub("-", x)) for x in names.split()]
    bad = [bool(UNLIKELY.search(x)) for x in each]
    return any(bad) and not any(LIKELY.search(x) and not b for x, b in zip(each, bad, strict=True))


def attributes(text: str) -> dict[str, str]:
    """A start tag's attributes, names in lower case; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        out.setdefault(name.lower(), unescape(value))
    return out


class Node:
    """An element; its children are nodes and texts (str), None stands for a line break.

    holder is the block element that its texts belong to; size, linked and links are the characters of its texts, those in
    links, and its links, of all that lies in it.
    """

    __slots__ = ("tag", "parent", "children", "holder", "prior", "points", "dropped", "kept", "size", "linked", "links")

    def __init__(self, tag: str, parent: Node | None, text: str = "", in_article: bool = False):
        self.tag, self.parent, self.children = tag, parent, []
        self.holder = parent.holder if parent and tag in INLINE else self
        self.prior, self.points = PRIOR.get(tag, 0.0), 0.0
        self.kept, self.size, self.linked, self.links = False, 0, 0, 0
        self.dropped = tag in DROPPED
        names = ""
        if text and NAMED.search(text):
            got = attributes(text)
            if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(got.get("style", "")):
                self.dropped = True
            names = " ".join(got[k] for k in ("class", "id", "role") if k in got)
            if unlikely(names) and tag not in ("body", "html", "article", "main"):
                self.dropped = True
            if LIKELY.search(names) and tag not in ("body", "html"):
                self.prior += LIKELY_POINTS
        # A page's header is dropped, that of an article is part of it.
        if tag == "header" and not in_article and not BESIDE.search(names):
            self.dropped = True

    @property
    def score(self) -> float:
        """Points less the share of links."""
        return self.points * (1 - self.linked / max(1, self.size))

    @property
    def total(self) -> float:
        return (self.prior + self.points) * (1 - self.linked / max(1, self.size))


class Stack:
    """The open elements; finds the nearest of a name without walking down."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.barriers = [root], {}, []

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BARRIERS:
            self.barriers.append(len(self.nodes))
        self.nodes.append(node)

    def has(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def close(self, tag: str, structure: frozenset = STRUCTURE) -> bool:
        """Closes the nearest open element named tag, and all in it; not across barriers unless tag is structure."""
        found = self.at.get(tag)
        if not found or tag not in structure and self.barriers and self.barriers[-1] > found[-1]:
            return False
        self.cut(found[-1])
        return True

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in BARRIERS:
                self.barriers.pop()


def parse(html: str) -> list[Node]:
    """The elements of a page in page order, the first is the root; tags may be unclosed, misnested or cut off."""
    root = Node("#root", None)
    stack, made = Stack(root), [root]
    ends: dict[str, list[int]] = {}  # where the end tags of raw elements begin
    at = 0

    def text(piece: str) -> None:
        stack.top.children.append(unescape(piece) if "&" in piece else piece)

    while at < len(html):
        found = html.find("<", at)
        m = None
        while found >= 0 and not (m := TOKEN.match(html, found)):
            found = html.find("<", found + 1)  # a "<" that opens nothing is text
        if not m:
            text(html[at:])
            break
        if found > at:
            text(html[at:found])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack.top.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            stack.close(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack.top.children.append(None)
            continue
        if tag in RAW:
            if m[4]:
                continue
            if tag not in ends:
                ends[tag] = [x.start() for x in re.finditer(rf"</{tag}(?=[\s/>])", html, re.IGNORECASE | re.ASCII)]
            k = bisect_right(ends[tag], at - 1)
            if k < len(ends[tag]):
                close = html.find(">", ends[tag][k])
                at = len(html) if close < 0 else close + 1
            elif tag in ("script", "style"):
                at = len(html)
            continue
        if tag in ENDS_P:
            for foreign in ("svg", "math"):
                if stack.has(foreign):  # it was never closed
                    stack.close(foreign, STRUCTURE | {foreign})
            stack.close("p")
        elif tag in CLOSES:
            while stack.top.tag in CLOSES[tag]:
                stack.cut(len(stack.nodes) - 1)
        node = Node(tag, stack.top, m[3], stack.has("article", "main"))
        stack.top.children.append(node)
        made.append(node)
        if not m[4]:
            stack.push(node)
    return made


class Block:
    """Texts without a block element's edge or a line break between them, with their characters, all and in links."""

    __slots__ = ("node", "texts", "size", "linked")

    def __init__(self, node: Node):
        self.node, self.texts, self.size, self.linked = node, [], 0, 0


def blocks_of(root: Node, forms: bool) -> list[Block]:
    """Blocks in page order; with forms those of form elements, which are dropped otherwise. No recursion: pages may be deep."""
    out: list[Block] = []
    block: Block | None = None
    stack: list = [(root, False)]
    while stack:
        item, link = stack.pop()
        if isinstance(item, Node):
            if item.tag not in INLINE:
                block = None
            if item.dropped and not (forms and item.tag == "form"):
                continue
            inner = link or item.tag == "a"
            if item.tag not in INLINE:
                stack.append((None, link))
            elif item.tag == "a":
                item.holder.links += 1
            stack.extend((child if child is None or isinstance(child, Node) else (child, item), inner) for child in reversed(item.children))
        elif item is None:
            block = None
        else:
            piece, parent = item
            if block is None:
                if not piece.strip():
                    continue
                block = Block(parent)
                out.append(block)
            block.texts.append(piece)
            size = len(piece.strip())
            block.size += size
            block.linked += size * link
    return out


def points_of(block: Block) -> float:
    """A paragraph's points: one, one more for each comma, up to three for its length, less the share of links."""
    if block.node.holder.tag in HEADINGS or block.size < 10:
        return 0.0
    commas = sum(t.count(",") + t.count("،") for t in block.texts)
    return (1 + commas + min(3.0, block.size / 100)) * (1 - block.linked / max(1, block.size))


def scored(made: list[Node], blocks: list[Block]) -> None:
    """Passes the blocks' points and sizes to the elements that hold them."""
    marked: dict[int, Node | None] = {}  # the nearest marked article around an element
    for node in made:
        up = node.parent
        marked[id(node)] = None if up is None else up if up.tag in ("article", "main") else marked[id(up)]
    whole: dict[int, float] = {}
    for block in blocks:
        own = block.node.holder
        own.size += block.size
        own.linked += block.linked
        points = points_of(block)
        up = own.parent if own.tag in ("p", "pre", "li", "dt", "dd", *HEADINGS) and own.parent else own
        article = up if up.tag in ("article", "main") else marked[id(up)]
        if article:
            whole[id(article)] = whole.get(id(article), 0.0) + points
        for share in PASSED:
            if up is None:
                break
            up.points += share * points
            up = up.parent
    for node in reversed(made):  # children come after their parents
        if node.tag in ("article", "main"):
            node.points = whole.get(id(node), 0.0)
        if node.parent:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links
            if node.tag in ("article", "main") and (up := marked[id(node)]):
                whole[id(up)] = whole.get(id(up), 0.0) + node.points


def chosen(made: list[Node], blocks: list[Block]) -> set[int]:
    """The best container (the first of equal ones) and the siblings that belong to it."""
    best = max((n for n in made if n.size and n.tag not in INLINE and n.tag not in ("p", "li", *HEADINGS)), key=lambda n: n.total, default=made[0])
    keep = {id(best)}
    marked = best.tag in ("article", "main")
    for other in best.parent.children if best.parent else []:
        if not isinstance(other, Node) or other is best or other.dropped or not other.size:
            continue
        link = other.linked / other.size
        paragraph = other.tag == "p" and (link < 0.25 if other.size > 80 else link == 0)
        alike = other.points > 0 and other.score >= SIBLING * best.score
        if alike and (other.tag == best.tag or not marked) or not marked and (paragraph or other.tag in HEADINGS):
            keep.add(id(other))
    return keep


def extract(html: str) -> str:
    """The main text: blocks in page order, white space inside each as one space, joined by one space; empty if none."""
    made = parse(html)
    blocks = blocks_of(made[0], False) or blocks_of(made[0], True)
    if not blocks:
        return ""
    scored(made, blocks)
    keep = chosen(made, blocks)
    for node in made:  # parents come first
        above = node.parent is not None and node.parent.kept
        menu = above and node.tag in PARTS and node.links > 1 and node.linked > LINKED * node.size
        node.kept = id(node) in keep or above and not menu
    texts = (SPACE.sub(" ", "".join(b.texts)).strip() for b in blocks if b.node.kept)
    return " ".join(t for t in texts if t)


def main_text(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Rows (id columns, text, n_chars): the main text of each page and its code points.

    Null and empty pages, and pages without text outside what is dropped, give the empty text. Forms are dropped; if all
    text of a page lies in forms (some systems wrap the whole page in one) they are read like any other element. Notices
    and disclaimers are dropped by their names, inside an article too; so are lists of links. Every row gives one row; other
    columns are ignored. A page is parsed whole, in memory of its own size, in time linear in its length at any depth.
    """
    k = len(id_cols)
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in id_cols), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def start():
        def f(batch: pa.RecordBatch) -> list:
            out = [extract(x) for x in strings(batch.column(k))]
            return [*batch.columns[:k], out, [len(x) for x in out]]

        return f

    return map_rows(df.select(*id_cols, html_col), schema, start)
