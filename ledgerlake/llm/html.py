"""Main text of web pages by tree scoring (operator 4).

The page becomes a tree. Parts that are never article text (scripts, styles, menus, headers, footers,
sidebars, forms, adverts, notices, reader comments) are left out, by tag, role or class. Forms and parts
left out by a name stay if they hold the page's article or most of its paragraphs. Each block of
text gives points for its length and its commas to its ancestors, less to farther ones; a container's
points are discounted by the share of its text that is in links. The best container, widened to the
article it lies in, and siblings with points near its own are kept; so are blocks beside it that read as
prose (long, or of whole sentences, and few links), and headings right before what is kept.

Defined results. Null, empty or tagless html: the text outside markup as blocks, or an empty text.
Unclosed and stray tags: closed where HTML closes them, or ignored. Ties: the container that starts
first. Repeated rows and page_ids: one result a row. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm import words as W

#: Points of a sibling, as a share of the best container's, that keep it.
SIBLING = 0.25
#: Characters from which on a block beside the best container is prose without a sentence's end or commas.
PROSE = 80

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

#: Content that is not markup up to the closing tag of the same name.
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = {
    "script", "style", "noscript", "template", "head", "title", "nav", "header", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "label", "fieldset",
    "iframe", "svg", "canvas", "object", "embed", "audio", "video", "map", "dialog", "menu", "xmp", "noembed", "noframes",
}
_BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre",
    "section", "summary", "table", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_CONTAINERS = {"article", "blockquote", "body", "center", "details", "div", "dl", "figure", "html", "main", "ol", "section", "table", "tbody", "td", "tr", "ul"}
#: What a start tag closes, if it is open inside the nearest of the tags on the right.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_HEAD = {"base", "link", "meta", "title", "noscript", "noframes", "script", "style", "template"}
#: Words of class, id or role that mark what is not the article, whatever it belongs to.
_FOREIGN = set(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus gdpr newsletter outbrain pager pagination popup promo promoted "
    "promotion related replies respond share sharing signup social sponsor sponsored subscribe subscription taboola".split()
)
#: Those that mark a part of the page's frame, or of an article if they stand with a word of content.
_FRAME = set("alert banner complementary contentinfo dialog footer header masthead menu modal nav navbar navigation notice notices search sidebar skip toolbar widget widgets".split())
_CONTENT = set("article body content entry main post story text".split())
#: Words that leave the meaning of those beside them as it is.
_NEUTRAL = set(
    "area bar block bottom box button buttons container desktop fixed float footer form global group header holder icon icons inner item items label left level link links list ln lower mobile outer page panel primary "
    "region right row secondary section site slot sticky sub tertiary thread title to top unit upper wrap wrapper zone".split()
)
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"')\]\u201d\u2019\u00bb]*$")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


ALWAYS, FOREIGN, FRAME = "always", "foreign", "frame"


class Node:
    __slots__ = ("kids", "links", "parent", "points", "size", "tag", "unwanted")

    def __init__(self, tag: str, parent: Node | None, unwanted: str = "") -> None:
        self.tag, self.parent, self.unwanted = tag, parent, unwanted
        self.kids: list[Node | str] = []
        self.points, self.size, self.links = 0.0, 0, 0


def _named(names: str) -> str:
    """FOREIGN or FRAME if a whole name among the class, id or role ``names`` marks an unwanted part, or an empty string."""
    kind, content = "", False
    for name in names.split():
        words = {w for part in re.split(r"[_-]+", _HUMP.sub("-", name).lower()) if (w := part.rstrip("0123456789"))}
        if words & _FOREIGN and words <= _FOREIGN | _FRAME | _NEUTRAL | _CONTENT:
            return FOREIGN
        if words & _FRAME and words <= _FRAME | _NEUTRAL:
            kind = FRAME
        elif words and words <= _CONTENT | _NEUTRAL and words & _CONTENT:
            content = True
    return "" if content else kind


def _unwanted(tag: str, attributes: str) -> str:
    """Why an element is left out: ALWAYS, FOREIGN, FRAME, or an empty string if it is not."""
    if tag in _DROPPED:
        return FRAME if tag == "form" else ALWAYS
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    held: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        held.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    if "hidden" in held or held.get("aria-hidden", "").strip().lower() == "true":
        return ALWAYS
    return _named(" ".join(held[k] for k in ("class", "id", "role") if k in held))


def _points(text: str) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) if len(text) >= 25 else 0.2


def _rescue(root: Node) -> None:
    """Unless an article or main lies outside unwanted parts: takes the mark from those that hold one, or over
    half of the paragraphs' points. What is FOREIGN has to hold all paragraphs of the page."""
    points: dict[int, float] = {}
    articles: dict[int, bool] = {}
    marked: dict[int, Node] = {}
    total = free = 0.0
    outside = False
    todo: list[tuple[Node, tuple[Node, ...], bool]] = [(root, (), False)]
    while todo:
        node, within, linked = todo.pop()
        if node.unwanted == ALWAYS:
            continue
        if node.unwanted:
            within = (*within, node)
            marked[id(node)] = node
        if node.tag in ("article", "main"):
            outside = outside or not within
            for n in within:
                articles[id(n)] = True
        linked = linked or node.tag == "a"
        for kid in node.kids:
            if not isinstance(kid, str):
                todo.append((kid, within, linked))
            elif not linked and len(kid := kid.strip()) >= 25:
                got = _points(kid)
                total += got
                free += 0 if within else got
                for n in within:
                    points[id(n)] = points.get(id(n), 0) + got
    for k, node in marked.items():
        own = points.get(k, 0)
        if not outside and ((own and not free and own == total) if node.unwanted == FOREIGN else (own > total / 2 or k in articles)):
            node.unwanted = ""


def _text(at: Node, text: str) -> Node:
    """Adds text, which ends an open head; the element that is open then."""
    if at.tag == "head" and not text.isspace():
        at = at.parent
    at.kids.append(text)
    return at


def parse(html: str) -> Node:
    """The tree of blocks; text, references still undecoded, lies in str children, and \\x00 parts blocks. Unwanted parts are in it, marked, and end as others do."""
    root = at = Node("html", None)
    pos, n = 0, len(html)
    lower, some = "", False
    while pos < n:
        m = _TOKEN.search(html, pos)
        if not m:
            at = _text(at, html[pos:])
            break
        if m.start() > pos:
            at = _text(at, html[pos : m.start()])
        pos = m.end()
        slash, tag, attributes = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "br":
                at.kids.append("\n")
            else:
                to = at
                while to is not None and to.tag != tag:
                    inline = tag not in _BLOCKS and tag not in _DROPPED
                    to = None if inline and (to.tag in ("td", "th", "table") or (to.unwanted and (to.tag in _BLOCKS or to.tag in _DROPPED))) else to.parent
                if to is not None and to.parent is not None:
                    at = to.parent
            continue
        closed = attributes.endswith("/") or tag in _VOID
        if tag in _RAW and not closed:
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", pos)
            if end < 0:
                break
            pos = html.find(">", end) + 1 or n
            continue
        if tag == "body":
            to = at
            while to is not None and to.tag != "head":
                to = to.parent
            at = to.parent if to is not None else at
        elif at.tag == "head" and tag not in _HEAD and tag != "html":
            at = at.parent
        if tag in ("body", "html"):
            continue
        if tag in ("br", "hr", "wbr"):
            at.kids.append("\n" if tag == "br" else "\x00" if tag == "hr" else "")
        if closed:
            continue
        if tag in _BLOCKS or tag in _DROPPED:
            to = at
            while to.parent is not None and to.tag not in _CONTAINERS and to.tag not in _DROPPED and to.tag != "p":
                to = to.parent
            if to.tag == "p" and to.parent is not None:
                at = to.parent
        if tag in _CLOSES:
            own, within = _CLOSES[tag]
            to, found = at, None
            while to.parent is not None and to.tag not in within:
                if to.tag in own:
                    found = to
                elif to.tag in _DROPPED:
                    break
                to = to.parent
            if found is not None:
                at = found.parent
        child = Node(tag, at, _unwanted(tag, attributes))
        some = some or child.unwanted in (FOREIGN, FRAME)
        if child.unwanted:
            at.kids.append("\x00" if tag in _BLOCKS or tag in ("header", "footer", "aside", "form", "nav") else "")
        at.kids.append(child)
        at = child
    if some:
        _rescue(root)
    return root


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def _walk(root: Node) -> list[tuple[Node, str, bool]]:
    """(element, "", True) where an element starts, (element, "", False) where it ends, (owner, text, True) for text; in page order, without unwanted parts."""
    out, todo = [], [(root, iter(root.kids))]
    out.append((root, "", True))
    while todo:
        node, kids = todo[-1]
        for kid in kids:
            if isinstance(kid, str):
                out.append((node, kid, True))
            elif not kid.unwanted:
                out.append((kid, "", True))
                todo.append((kid, iter(kid.kids)))
                break
        else:
            todo.pop()
            out.append((node, "", False))
    return out


def blocks(root: Node) -> list[tuple[Node, str, int, bool]]:
    """(nearest container, text, characters in links, whether it is a heading) of each block, in page order."""
    found: list[tuple[Node, str, int, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    depth = 0
    owners = [root]

    def flush(heading: bool = False) -> None:
        if text:
            if whole := _clean("".join(text)):
                found.append((owners[-1], whole, len(_clean("".join(linked))), heading))
            text.clear()
            linked.clear()

    for node, piece, opens in _walk(root):
        if piece:
            parts = piece.split("\x00")
            for i, part in enumerate(parts):
                if i:
                    flush()
                text.append(part)
                if depth:
                    linked.append(part)
        elif node.tag == "a":
            depth += 1 if opens else -1
        elif node.tag in _BLOCKS:
            flush(not opens and node.tag in _HEADINGS)
            if node.tag in _CONTAINERS and node is not root:
                owners.append(node) if opens else owners.pop()
    flush()
    return found


def _prose(text: str, links: int) -> bool:
    """Whether a block beside the best container belongs to the article."""
    return links < 0.3 * len(text) and (len(text) >= PROSE or (len(text) >= 25 and "," in text) or (not links and _SENTENCE.search(text) is not None))


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    root = parse(html)
    found = blocks(root)
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for owner, text, links, _ in found:
        points = _points(text)
        node, level = owner, 0
        while node is not None:
            if node.tag in _CONTAINERS:
                node.size += len(text)
                node.links += links
                node.points += points * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
                scored[id(node)] = node
                level += 1
            node = node.parent
    worth = lambda node: node.points * (1 - node.links / max(1, node.size))
    best = max(scored.values(), key=worth)
    wide = best
    while wide is not None and wide.tag not in ("article", "main"):
        wide = wide.parent
    keep = {id(wide or best)}
    centre = wide or best
    if centre.parent is not None:
        for kid in centre.parent.kids:
            if isinstance(kid, Node) and kid is not centre and id(kid) in scored and worth(kid) >= SIBLING * worth(best) and kid.links < 0.3 * kid.size:
                keep.add(id(kid))
    out: list[str] = []
    after = False
    for owner, text, links, heading in reversed(found):
        node = owner
        while node is not None and id(node) not in keep:
            node = node.parent
        beside = centre.parent is not None and owner is centre.parent
        after = node is not None or (beside and (after if heading else _prose(text, links)))
        if after:
            out.append(text)
    return "\n\n".join(reversed(out))


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    return W.map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), "page_id long, url string, text string, n_chars long", make)
