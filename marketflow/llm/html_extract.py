"""Main text of web pages by composite text density.

A tolerant parser builds a DOM. Elements that are furniture by their tag, role or class name (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments) are left out. For every other node the
composite text density is taken (characters per tag, adjusted for the share of link text, against the body's
own share); the node with the largest sum of its children's densities is the core. From the body down, the
core's ancestors are opened and every other node whose density reaches the least density on the body-core
path is kept whole. Where the core lies in an ``article`` or ``main`` element, the outermost such element is kept
whole, so that short blocks of an article (headings, one-line paragraphs) are not lost; with an ``article``, every
other outermost ``article`` whose density reaches that least density is kept too, in page order. A ``header`` inside
an ``article`` belongs to it (its title); an ``article`` named as a comment is furniture.

Defined cases: null or empty html gives an empty text; cut-off pages are read as far as they go (an open tag
at the end is dropped, a reference cut short stays as written); pages are judged one by one, so repeated rows
give repeated results. Input columns stay, except that columns with the names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from marketflow.llm import common

COLUMNS = ("text", "n_chars")
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul caption option""".split())
FURNITURE = frozenset("""nav header footer aside form script style noscript template button select textarea iframe svg canvas
    object embed audio video dialog menu head title option fieldset label datalist""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_WORDS = (r"ad|ads|adbox|adslot|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr\w*|notice\w*|comment\w*|"
          r"disqus\w*|respond|replies|sidebar\w*|side-bar|nav|navbar|navigation|menu\w*|breadcrumb\w*|header|masthead|footer|foot|"
          r"related\w*|share|sharing|social\w*|newsletter\w*|subscribe\w*|signup|popup\w*|modal\w*|overlay\w*|toolbar|widget\w*|"
          r"pagination|pager|login|search\w*|skip-link|legal|copyright")
#: Class names and ids of an ``article`` that is a reader comment.
REPLY = re.compile(r"(?:.*[-_])?(?:comments?|reply|replies)(?:[-_].*)?", re.I)
NAMED = re.compile(rf"(?:{_WORDS})(?:[-_].*)?|(?!no[-_]|has[-_]|with[-_]|without[-_]).*[-_](?:{_WORDS})", re.I)
#: Elements that are never furniture by class name.
FRAMES = frozenset("html body article main".split())
#: An open element of the key's group is closed by a start tag of the same group, up to the scope.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select",))}
P_SCOPE = ("body", "html", "table", "td", "th", "caption", "button", "object")
TAG = re.compile(r"<(?:!--(?:(?!-->)[\s\S])*+(?:-->|$)|(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>|[^>]*+(?:>|$))|[!?/][^>]*+(?:>|$))")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag, parent, out=False):
        self.tag, self.parent, self.out = tag, parent, out
        self.parts: list = []


def _furniture(tag: str, rest: str, parent: Node) -> bool:
    if tag in FURNITURE and not (tag == "header" and any(x.tag == "article" for x in _path(parent))):
        return True
    if "=" not in rest and "hidden" not in rest:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest.rstrip(">"))}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    if tag == "article":
        return any(REPLY.fullmatch(x) for x in names)
    return tag not in FRAMES and any(NAMED.fullmatch(x) for x in names)


def parse(page: str) -> Node:
    root = node = Node("#root", None)
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            node.parts.append(page[at:])
            break
        if m.start() > at:
            node.parts.append(page[at:m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not page[m.end() - 1] == ">":
            continue
        if m[1]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None and tag not in ("body", "html"):
                node = up.parent
            continue
        if tag in ("html", "body") and any(x.tag == tag for x in _path(node)):
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            node = _close(node, ("p",), P_SCOPE)
        if tag in CLOSES:
            node = _close(node, *CLOSES[tag])
        if tag == "body":
            node = _close(node, ("head",), ("body",))
        new = Node(tag, node, _furniture(tag, m[3], node))
        node.parts.append(new)
        if tag in RAW and not m[3].endswith("/>"):
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            new.parts.append(page[at:stop])
            close = page.find(">", stop)
            at = n if end is None or close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/>") and tag not in BLOCK):
            node = new
    return root


def _path(node):
    while node is not None:
        yield node
        node = node.parent


def _close(node: Node, tags: tuple, scope: tuple) -> Node:
    """The parent of the nearest open element of ``tags``, if no element of ``scope`` is nearer."""
    for up in _path(node):
        if up.tag in tags:
            return up.parent
        if up.tag in scope:
            return node
    return node


def _walk(root: Node) -> list[Node]:
    """All nodes that are not furniture, parents first (no recursion: pages may nest deeply)."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.out]
    return out


def _measure(nodes: list[Node], body: Node) -> None:
    for node in reversed(nodes):
        own = sum(len("".join(html.unescape(x).split())) for x in node.parts if isinstance(x, str))
        inner = [x for x in node.parts if isinstance(x, Node) and not x.out]
        node.chars = own + sum(x.chars for x in inner)
        node.tags = len(inner) + sum(x.tags for x in inner)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in inner)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in inner)
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        value = max(c / max(lc, 1) * t / lt, 1.0)
        scale = math.log(base) if base > 1.0001 else 1.0
        node.density = c / t * math.log(value) / scale
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.out)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _walk(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    nodes = _walk(body)
    _measure(nodes, body)
    core = max(nodes, key=lambda x: x.total)
    path = list(_path(core))
    path = path[:path.index(body) + 1]
    least = min(x.density for x in path)
    whole = [x for x in path if x.tag in ("article", "main")]
    if whole:
        keep = [whole[-1]]
        if keep[0].tag == "article":
            keep = [x for x in nodes if x.tag == "article" and all(up.tag not in ("article", "main") for up in _path(x.parent))
                    and (x is keep[0] or x.chars and x.density >= least)]
    else:
        opened, keep, todo = set(map(id, path[1:])), [], [body]
        while todo:
            node = todo.pop()
            if id(node) in opened:
                todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.out]
            elif node is core or (node.chars and node.density >= least):
                keep.append(node)
        if core is body or not keep:
            keep = [body]
    return "\n".join(b for node in keep for b in _blocks(node))


def _blocks(top: Node) -> list[str]:
    """Texts of the blocks below ``top`` in page order, white space made one space."""
    out: list[str] = []
    now: list[str] = []

    def close():
        text = " ".join("".join(now).split())
        if text:
            out.append(text)
        now.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(html.unescape(x))
        elif not x.out or x is top:
            if x.tag == "br":
                now.append(" ")
            elif x.tag in BLOCK:
                close()
                todo.append(None)
            todo += reversed(x.parts)
    close()
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` plus text (main text, blocks joined by a line feed) and n_chars (its code points)."""
    common.prepare(pages.sparkSession)
    base = pages.drop(*(c for c in COLUMNS if c != html_col))
    names = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", text string, n_chars bigint"

    def run(batches):
        for piece in common.slices(batches, html_col):
            texts = [main_text(p) for p in piece.column(names.index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=[*names, *COLUMNS])

    return base.mapInArrow(run, schema)
