"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
#: An opening tag ends these open elements, up to the elements that bound them.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select datalist optgroup"), "body": ("head", "html"),
}
_LIMITS = frozenset("table td th caption button article section div main".split())
#: For each opening tag: what it ends, and what bounds the search for it.
BOUNDS = {"": (frozenset(["p"]), _LIMITS)}
for _name, (_ends, _bounds) in ENDS.items():
    _ended = frozenset(_ends.split()) | (frozenset(["p"]) if _name in CLOSES_P else frozenset())
    BOUNDS[_name] = _ended, (_LIMITS | frozenset(_bounds.split())) - _ended
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
#: Elements that are never shown as text.
NOT_SHOWN = frozenset("script style textarea title xmp iframe noembed noframes noscript template head select button input datalist svg math canvas audio video object".split())
#: Elements that are not the article, whatever they hold.
NOT_ARTICLE = frozenset("nav footer aside form dialog menu".split())
#: Names that say that an element is beside the article, and words that may stand with them in a name.
BESIDE = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead topbar "
    "cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login search comment comments commentlist disqus respond replies "
    "share sharing social related recommended pagination pager toolbar widget complementary contentinfo".split())
PLAIN = frozenset("box wrapper container list section block bar area slot inner outer left right top bottom links buttons form items panel unit thread".split())
#: Elements inside a line of text; they neither count as tags nor are content of their own.
INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SECTIONS = frozenset(["article", "main", "section"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of the page's text that must be left for the names to be believed, and share of its density that a node may lose to its parent's.
LEFT, CLIMB = 0.1, 0.7
#: Elements nest as deep as browsers let them; deeper ones are taken side by side.
DEEPEST = 512

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(=?[^\s/>=]*)(?:\s*=\s*(?![\s=])([\"']|[^\s>\"'][^\s>]*)?)?")


class Node:
    """An element; parts are its texts and elements in page order."""

    __slots__ = ("tag", "marks", "parts", "parent", "depth", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, marks: frozenset = frozenset(), parent: Node | None = None) -> None:
        self.tag, self.marks, self.parts, self.parent = tag, marks, [], parent
        self.depth = parent.depth + 1 if parent else 0

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str)]


class Finder:
    """Places of strings in a page; what isn't found once is not looked for again further on."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        if (found := self.page.find(what, at)) < 0:
            self.missing.add(what)
        return found


def _tag(page: str, find: Finder, at: int) -> tuple[int, list[tuple[str, str]]]:
    """End of the tag whose name ends at ``at``, and its attributes; -1 where it does not end."""
    found = []
    if find(">", at) < 0:
        return -1, found
    while True:
        hit = ATTRIBUTE.match(page, at)
        name, value, at = hit[1].lower(), hit[2] or "", hit.end()
        if value in ("'", '"'):
            if (end := find(value, at)) < 0:  # an open quote: the tag ends at the next bracket
                end = find(">", at)
                return (end + 1 if end >= 0 else -1), found
            value, at = page[at:end], end + 1
        if name:
            found.append((name, value))
        if at >= len(page):
            return -1, found
        if page[at] == ">":
            return at + 1, found
        if hit.end() == hit.start():  # a character that starts no attribute
            at += 1


def _marks(attributes: list[tuple[str, str]]) -> frozenset:
    found = set()
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            found.add("hidden")
        elif name in ("class", "id", "role"):
            for one in value.lower().split():
                words = set(re.split(r"[-_]+", one)) - {""}
                if not words.isdisjoint(BESIDE) and words <= BESIDE | PLAIN:
                    found.add("beside")
    return frozenset(found)


def parse(page: str) -> Node:
    """Tree of a page; end tags that HTML lets a page omit are implied, stray ones are skipped. The time is in proportion to the page."""
    root = node = Node("#root")
    find, at, text_from = Finder(page), 0, 0
    open_count: Counter[str] = Counter()

    def leave(to: Node) -> Node:
        """``to`` is open again, what is open below it ends."""
        here = node
        while here is not to:
            open_count[here.tag] -= 1
            here = here.parent
        return to

    while (start := find("<", at)) >= 0:
        closing = page.startswith("/", start + 1)
        hit = NAME.match(page, start + 1 + closing)
        if not hit:
            if not closing and not page.startswith(("!", "?"), start + 1):
                at = start + 1  # a lone bracket is text
                continue
            comment = page.startswith("<!--", start)
            end = find("-->" if comment else ">", start + 2)
            end, attributes = (len(page) if comment else -1) if end < 0 else end + (3 if comment else 1), []
        else:
            end, attributes = _tag(page, find, hit.end())
        if end < 0:
            at = start + 1
            continue
        if start > text_from:
            node.parts.append(page[text_from:start])
        at = text_from = end
        if not hit:
            continue
        name = hit[0].lower()
        if closing:
            if open_count[name]:
                up = node
                while up.tag != name:
                    up = up.parent
                node = leave(up.parent)
            continue
        if name in CLOSES_P or name in ENDS:
            ends, bounds = BOUNDS.get(name, BOUNDS[""])
            if any(open_count[x] for x in ends):
                up, to = node, node
                while up is not root and up.tag not in bounds:
                    if up.tag in ends:
                        to = up.parent
                    up = up.parent
                node = leave(to)
        if node.depth >= DEEPEST:
            node = leave(node.parent)
        child = Node(name, _marks(attributes) if attributes else frozenset(), node)
        node.parts.append(child)
        if name in VOID:
            continue
        if name in RAW:
            close = RAW_END[name].search(page, at)
            at = text_from = close.end() if close else len(page)
            continue
        if name in ("svg", "math", "path") and page.endswith("/>", start, end):
            continue
        node = child
        open_count[name] += 1
    if text_from < len(page):
        node.parts.append(page[text_from:])
    return root


def _keep(root: Node, keep) -> None:
    """Take the subtrees whose node ``keep`` refuses out of the tree; it is told whether the node is inside an article."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in SECTIONS
        node.parts = [x for x in node.parts if isinstance(x, str) or keep(x, inside)]
        todo += [(x, inside) for x in node.children]


def _measure(root: Node) -> list[Node]:
    """Characters, tags and composite density of every node; the nodes, children before parents."""
    order = [root]
    for node in order:
        order += node.children
    order.reverse()
    for node in order:
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.chars += x.chars
                node.tags += x.tags + (x.tag not in INLINE)
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body_links, body_chars = root.link_chars, max(1, root.chars)
    for node in order:
        node.total = sum(x.total if x.tag in INLINE else x.density for x in node.children)
        if not node.chars:
            node.density = 0.0
            continue
        c, lc, t, lt = node.chars, max(1, node.link_chars), max(1, node.tags), max(1, node.link_tags)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(c / plain * node.link_chars + body_links / body_chars * c + math.e)
        node.density = max(0.0, c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)))
        if t == 1 and not node.link_chars:
            node.density = max(node.density, c / t)
    return order


def _largest(node: Node) -> Node:
    best, todo = node, [node]
    while todo:
        x = todo.pop()
        if x.total > best.total and x.tag not in INLINE:
            best = x
        todo += reversed(x.children)
    return best


def select(root: Node) -> list[Node]:
    """Content nodes in page order.

    The node with the greatest sum of child densities is content, or the highest node above it,
    below the body, as long as each step keeps the share ``CLIMB`` of the density: sections of one
    article are as dense as the article. The least density on the path from there to the body is
    the threshold, and beside that path a subtree that reaches it gives its own maximum, and
    headings right before a content node go with it.
    """
    nodes = _measure(root)
    body = next((x for x in reversed(nodes) if x.tag == "body"), root)
    top = _largest(body)
    if not top.total or top is body:
        return [body]
    while top.parent is not body and top.parent.density >= CLIMB * top.density:
        top = top.parent
    path = [top]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold, kept = min(x.density for x in path[:-1]), {id(top)}
    for above, below in zip(path[1:], path, strict=False):
        for x in above.children:
            if x is not below and x.chars and x.density >= threshold:
                kept.add(id(x if x.tag in BLOCK and not x.total else _largest(x)))
    found, todo = [], [body]
    while todo:
        x = todo.pop()
        if id(x) not in kept:
            todo += reversed(x.children)
            continue
        before, siblings = [], x.parent.children
        for y in reversed(siblings[:next(i for i, y in enumerate(siblings) if y is x)]):
            if y.tag not in HEADINGS or id(y) in kept:
                break
            before.append(y)
        found += [*reversed(before), x]
    return found


def blocks(node: Node) -> list[str]:
    """Texts of a node's blocks in page order, white space collapsed."""
    out, run = [], []

    def close() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            out.append(text)
        run.clear()

    todo: list = [(node, False)]
    while todo:
        x, ended = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x.tag in BLOCK:
            close()
            if not ended:
                todo.append((x, True))
                todo += [(y, False) for y in reversed(x.parts)]
        elif x.tag == "br":
            run.append(" ")
        else:
            todo += [(y, False) for y in reversed(x.parts)]
    close()
    return out


def walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += node.children


def any_beside(root: Node) -> bool:
    return any("beside" in x.marks for x in walk(root))


def _chars(root: Node) -> int:
    """Characters of text outside links."""
    total, todo = 0, [root]
    while todo:
        for x in todo.pop().parts:
            if isinstance(x, str):
                total += len("".join(x.split()))
            elif x.tag != "a":
                todo.append(x)
    return total


def main_text(page: str | None) -> str:
    """Main text of one page; empty where there is none."""
    if not page:
        return ""
    root = parse(page)
    _keep(root, lambda x, inside: x.tag not in NOT_SHOWN and "hidden" not in x.marks)
    _keep(root, lambda x, inside: x.tag not in NOT_ARTICLE and (inside or x.tag != "header"))
    if any_beside(root):
        # what names itself an advert, a menu, comments and so on goes, unless it is most of what the page says
        whole, parts = _chars(root), [(x, x.parts) for x in walk(root)]
        _keep(root, lambda x, inside: "beside" not in x.marks)
        if _chars(root) < LEFT * whole:
            for x, own in parts:
                x.parts = own
    return "\n\n".join(text for node in select(root) for text in blocks(node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Each page's DOM gets link-adjusted characters per tag for every node; the subtree whose
    children's densities sum highest is the article, with what reaches the least density on its
    body path. Elements that are never article text (nav, footer, aside, form, ...) go before. So do
    elements whose whole class, id or role names a menu, an advert, a notice, comments of readers or
    the like, as long as a tenth of the text outside links is left without them: where it isn't,
    the names are not believed and density alone decides. A page that is null, empty or without text gives the empty text; ids and
    urls may be null or repeat; other columns are not used. Pages are independent: no shuffle.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string").select("*", F.length("text").cast("long").alias("n_chars"))
