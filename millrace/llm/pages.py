"""Main text of web pages by composite text density of the DOM's nodes."""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without content, elements whose content is not markup, elements that break a line,
# and start tags that close an open element.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - set("td th tr tbody thead tfoot caption legend option html body summary".split()) | {"p"}
SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table"}),
}

# Elements, roles and words of class and id that mark what is not the article.
NOT_TEXT = set("script style noscript iframe template textarea title head nav footer aside form button select input svg canvas object audio video dialog menu search".split())
NOT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NOT_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars footer header masthead topbar ad ads adv advert adverts advertisement "
    "advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login comment comments commentlist respond replies disqus share sharing social related recommended widget pagination "
    "pager toolbar skip copyright".split()
)
CONTENT = {"article", "main"}
#: Blocks that may be menus: nearly all links. Lists and tables of links within the article are its own.
MENUS = {"div", "section", "menu"}
LISTS = MENUS | {"ul", "ol", "dl", "table"}
#: A block with more than this share of a page's text is not set aside for its name.
MOST = 0.75

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_QUOTED = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Node:
    __slots__ = ("tag", "marks", "role", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "hidden", "depth")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.marks: set[str] = set()
        self.role, self.hidden = "", False


class _Open:
    """The elements that are open, from the root to the innermost, and how deep each tag's innermost ones lie."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.blocks, self.not_p = [root], {}, [], []

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCK:
            self.blocks.append(depth)
            if node.tag != "p":
                self.not_p.append(depth)

    def close(self, tags: set[str], limit: int) -> bool:
        """Close the innermost element of ``tags`` that lies deeper than ``limit``, with all it holds."""
        depth = max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)
        if depth <= limit:
            return False
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
                if node.tag != "p":
                    self.not_p.pop()
        return True

    def deepest(self, tags: set[str]) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)


def parse(source: str) -> Node:
    """The tree of a page, in one pass whose time grows with the page's length.

    Wrong nesting is mended: end tags without a start are passed over, missing ones are added. A quote that no other
    closes is not one, and from there on no quotes are looked for.
    """
    root = Node("html", None)
    opened, at, end = _Open(root), 0, len(source)
    last_end, last_cdata = source.rfind(">"), source.rfind("]]>")
    quotes, body = True, False

    def text(piece: str) -> None:
        if piece:
            opened.nodes[-1].children.append(entities.unescape(piece))

    while at < end:
        begin = source.find("<", at)
        if begin < 0 or begin > last_end and not source.startswith("<!--", begin):
            text(source[at:])
            break
        text(source[at:begin])
        if source.startswith("<!--", begin):
            close = source.find("-->", begin + 4)
            at = close + 3 if close >= 0 else end
            continue
        if source.startswith("<![CDATA[", begin) and last_cdata > begin:
            at = source.find("]]>", begin)
            opened.nodes[-1].children.append(source[begin + 9 : at])
            at += 3
            continue
        if source[begin + 1 : begin + 2] in ("!", "?"):
            at = source.find(">", begin) + 1
            continue
        leaves = source.startswith("/", begin + 1)
        name = _NAME.match(source, begin + 1 + leaves)
        if name is None:
            text("<")
            at = begin + 1
            continue
        whole = _QUOTED.match(source, name.end()) if quotes else None
        if whole is None:
            quotes = False
            at = source.find(">", name.end()) + 1
            attributes = source[name.end() : at - 1]
        else:
            at, attributes = whole.end(), whole[1]
        tag = name[0].lower()
        if leaves:
            opened.close({tag}, 0 if tag in BLOCK or not opened.blocks else opened.blocks[-1])
            continue
        if tag in CLOSES_P:
            opened.close({"p"}, opened.not_p[-1] if opened.not_p else 0)
        if tag in SELF_CLOSING:
            ends, limits = SELF_CLOSING[tag]
            while opened.close(ends, opened.deepest(limits)):
                pass
        if tag in ("html", "body"):
            if tag == "body" and not body:
                body = True
                opened.close(set(opened.depths), 0)
                opened.push(Node("body", root))
                root.children.append(opened.nodes[-1])
            continue
        top = opened.nodes[-1]
        new = Node(tag, top)
        _attributes(new, attributes)
        top.children.append(new)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = close.end() if close else end
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            opened.push(new)
    return root


def _attributes(node: Node, source: str) -> None:
    if "=" not in source and "hidden" not in source:
        return
    for name, *values in _ATTRIBUTE.findall(source):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            node.marks |= set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", entities.unescape(value)).lower()))
        elif name == "role":
            node.role = value.lower()
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) or name == "aria-hidden" and value.lower() == "true":
            node.hidden = True
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", source):
        node.hidden = True


def _dropped(node: Node, in_content: bool, titled: set[Node]) -> bool:
    """Elements that are never text of the article, by tag, role or being hidden."""
    if node.tag in NOT_TEXT or node.hidden or node.role in NOT_ROLES:
        return True
    return node.tag == "header" and not in_content and (node.parent.tag in ("html", "body") or node not in titled)


def _prune(root: Node) -> None:
    titled: set[Node] = set()  # nodes with a title below them
    for node in reversed(_in_order(root)):
        if node.tag == "h1" or node in titled:
            titled.add(node.parent)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in CONTENT
        node.children = [c for c in node.children if isinstance(c, str) or not _dropped(c, inside, titled)]
        todo += [(c, inside) for c in node.children if isinstance(c, Node)]


def _set_aside(root: Node) -> None:
    """Take out blocks whose class or id names a notice, advert, menu or comments, unless the page says otherwise.

    A word proves little: a block stays if it holds an ``article``, ``main`` or ``h1`` that is not itself so named, or
    more than ``MOST`` of the text that isn't links, and an inline element always stays. Expects measured nodes.
    """
    nodes = _in_order(root)
    holds = set()
    for node in reversed(nodes):
        if node.tag in CONTENT | {"h1"} and not node.marks & NOT_WORDS or any(isinstance(c, Node) and c in holds for c in node.children):
            holds.add(node)
    text = root.chars - root.link_chars
    for node in nodes:
        node.children = [
            c for c in node.children
            if isinstance(c, str) or c.tag not in BLOCK or not c.marks & NOT_WORDS or c in holds or c.chars - c.link_chars > MOST * text
        ]


def _in_order(root: Node) -> list[Node]:
    """Every node, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Give every node its characters per tag, adjusted for links, and the sum of its children's densities."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        inner = [c for c in node.children if isinstance(c, Node)]
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.chars for c in inner)
        node.tags = sum(c.tags + 1 for c in inner)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in inner)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in inner)
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(nodes):
        tags, plain = max(node.tags, 1), max(node.chars - node.link_chars, 1)
        if node.chars == 0:
            node.density = 0.0
        else:
            base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
            value = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
            node.density = max(node.chars / tags * math.log(max(value, 1.0)) / max(math.log(base), 1e-9) if base > 1 else node.chars / tags, 0.0)
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and c.tag in BLOCK)
    return nodes


def _is_menu(node: Node, tags: set[str] = LISTS) -> bool:
    return node.tag in tags and node.link_tags >= 2 and node.link_chars > 0.6 * node.chars


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Texts of the blocks below ``node``; ``out`` ends with the block that is open."""
    todo: list[tuple[Node | str | None, bool]] = [(node, False)]
    while todo:
        item, leaving = todo.pop()
        if isinstance(item, str):
            out[-1].append(item)
        elif leaving:
            out.append([])
        elif item.tag == "br":
            out[-1].append(" ")
        elif not _is_menu(item, MENUS) or item is node:
            if item.tag in BLOCK:
                out.append([])
                todo.append((item, True))
            todo += [(c, False) for c in reversed(item.children)]


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in order, one to a line, white space within a block as one space.

    The subtree whose children's densities add up to most is taken, or the ``article`` or ``main`` element around it;
    siblings of text as dense as the least dense node on the way to the body belong to it too.
    """
    if not source:
        return ""
    root = parse(source)
    _prune(root)
    measure(root)
    _set_aside(root)
    nodes = measure(root)
    blocks = [n for n in nodes if n.tag in BLOCK]
    best = max(blocks, key=lambda n: n.total, default=root)
    if best.total == 0:
        best = next((n for n in nodes if n.tag == "body" and n.chars), root)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min((n.density for n in path if n.tag not in ("html",)), default=0.0)
    around = [n for n in path if n.tag in CONTENT]
    chosen = [around[-1] if around else best]
    if not around and best.parent is not None and best.tag != "body":
        chosen = [
            c for c in best.parent.children
            if isinstance(c, Node) and (c is best or c.tag in BLOCK and not _is_menu(c) and (c.density >= threshold or c.tag in ("h1", "h2", "h3")) and c.chars)
        ]
    out: list[list[str]] = [[]]
    for node in chosen:
        _blocks(node, out)
        out.append([])
    lines = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(line for line in lines if line)


def _extracted(html_col: str):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                texts = [main_text(source) for source in rows.column(html_col).to_pylist()]
                others = [rows.column(n) for n in rows.schema.names if n != html_col]
                names = [n for n in rows.schema.names if n != html_col]
                yield pa.RecordBatch.from_arrays([*others, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extracted(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` of each page, ``text`` (its main text, empty if there is none) and ``n_chars`` (code points).

    Null and empty pages give an empty text; time grows with the length of a page; markup may be broken in any way; equal pages give equal texts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string", "n_chars long"])
    return pages.select(*keep, html_col).mapInArrow(_extracted(html_col), schema)
