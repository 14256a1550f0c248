"""Main text of web pages by tree scoring (operator 5)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import readable, sliced, table

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: What an opening tag closes first, and where the search for it ends.
CLOSES = {t: (frozenset(c.split()), frozenset(s.split())) for t, c, s in (
    ("li", "li", "ul ol menu dir"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"),
    ("tbody", "thead tbody tfoot tr td th", "table"), ("tfoot", "thead tbody tfoot tr td th", "table"), ("option", "option", "select"),
)}
#: Never part of an article.
DROPPED = frozenset("head script style template noscript svg math iframe object embed canvas audio video textarea title xmp noembed noframes nav aside footer form button select input dialog menu label legend".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words in a class or id that mark what isn't part of an article.
DROPPED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " sidebar sidenav aside widget widgets related recommended share sharing social menu nav navbar navigation topnav breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus replies respond"
    " login signin signup register search searchbox pagination pager toolbar legal copyright disclaimer skip".split()
)
#: Of these, what also names parts of articles: alone they don't take a block out of an article, if it reads as text.
AMBIGUOUS_WORDS = frozenset("widget widgets legal notice notices share sharing related recommended copyright disclaimer register skip search header banner overlay social promotion modal toolbar".split())
#: Blocks of text: a word that is ambiguous doesn't take one, wherever it is, if it reads as text.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
LEAST_BESIDE_COMMENTS = 200
KEPT_TAGS = frozenset("html body main".split())
GOOD_WORDS = frozenset("article content entry post story text body main page".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Names that say a thing is not there.
WITHOUT = re.compile(r"\b(?:[a-z]+[-_ ]?free|no[-_][a-z]+)\b")
LEAST_PARAGRAPH, SIBLING_SHARE, BONUS, MOST_LINKS = 25, 0.2, 25.0, 0.5


class Node:
    """An element: children are nodes and texts in order."""

    __slots__ = ("tag", "attributes", "parent", "children", "points", "length", "links", "commas")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points, self.length, self.links, self.commas = 0.0, 0, 0, 0


def parse(page: str) -> Node:
    """The tree of a page, however its tags are closed."""
    root = here = Node("#root", "", None)
    at, end = 0, len(page)
    while at < end:
        found = TAG.search(page, at)
        if not found:
            here.children.append(page[at:])
            break
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if closing:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent if not (tag == "p" and node.tag in ("article", "section", "div", "body")) else root
            if node is not root:
                here = node.parent
            continue
        here = _room(here, tag)
        child = Node(tag, attributes, here)
        here.children.append(child)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            child.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID:
            here = child
    return root


def _room(here: Node, tag: str) -> Node:
    """The node that an opening tag goes in, when what it closes is closed."""
    if tag == "a":
        node = here
        while node.parent and node.tag not in BLOCK and node.tag != "a":
            node = node.parent
        if node.tag == "a":
            here = node.parent
    if tag in BLOCK:
        node = here
        while node.parent and node.tag not in BLOCK and node.tag not in ("td", "th"):
            node = node.parent
        if node.tag == "p" or node.tag[0] == "h" == tag[0] and node.tag[1:].isdigit() and tag[1:].isdigit():
            here = node.parent
    if tag in CLOSES:
        closes, stops = CLOSES[tag]
        node, last = here, None
        while node.parent and node.tag not in stops:
            if node.tag in closes:
                last = node
            node = node.parent
        if last:
            here = last.parent
    return here


def _is_link(node: Node) -> bool:
    return node.tag == "a" and "href" in node.attributes.lower()


def _marks(node: Node) -> tuple[set[str], dict[str, str]]:
    attributes = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(node.attributes)} if node.attributes.strip() else {}
    named = WITHOUT.sub(" ", CAMEL.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}").lower())
    return set(WORDS.findall(named)), attributes


def prune(root: Node) -> None:
    """Take out what is never article: by tag, role, hiding, and words in class or id.

    Words don't count on an outermost article or main, on what holds one, or
    where all nodes of a word together hold over half of the page's text outside
    links; comments go however long they are, if an article is left without them.
    A form with over half of the text stays.
    """
    total, weight, marks, spared = _weights(root)
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
                continue
            article = child.tag in ("article", "main")
            if id(child) not in weight:  # below a tag that is dropped
                continue
            own, linked, holds, comments = weight[id(child)]
            words, attributes = marks[id(child)]
            form = child.tag == "form" or attributes.get("role", "").lower() == "form"
            bad = child.tag in DROPPED or (child.tag == "header" and not inside) or attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            if form and own * 2 > total and "hidden" not in attributes:
                bad = False
            hits = words & DROPPED_WORDS - spared if child.tag not in KEPT_TAGS else frozenset()
            if not bad and comments:
                bad = True
            elif not bad and hits and not ("header" in hits and inside and len(hits) == 1) and not (article and not inside):
                reads = (inside or child.tag in PARAGRAPHS) and hits <= AMBIGUOUS_WORDS and own >= LEAST_PARAGRAPH and own > linked
                bad = not holds and own * 2 <= total and not reads
            if not bad:
                kept.append(child)
                todo.append((child, inside or article))
        node.children = kept


def _weights(root: Node) -> tuple[int, dict[int, tuple[int, int, bool, bool]], dict[int, tuple[set[str], dict[str, str]]], set[str]]:
    """The page's length of text outside links, and for each node: that length, its text in links, whether it holds an article or main, and whether it is comments that go.

    Then each node's words and attributes, and the words that mark over half of
    the text. Comments count for none of these lengths, if they go.
    """
    order, todo = [], [(root, False)]
    marks: dict[int, tuple[set[str], dict[str, str]]] = {}
    own: dict[int, list] = {}
    while todo:
        node, linked = todo.pop()
        linked = linked or _is_link(node)
        order.append(node)
        marks[id(node)] = _marks(node)
        length = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) if node.tag not in DROPPED or node.tag == "form" else 0
        own[id(node)] = [0, length, False, False] if linked else [length, 0, False, False]
        if node.tag not in DROPPED or node.tag == "form":
            todo.extend((c, linked) for c in node.children if not isinstance(c, str))
    titled: set[int] = set()
    for node in reversed(order):
        mine = own[id(node)]
        if node.parent:
            up = own[id(node.parent)]
            up[0], up[1] = up[0] + mine[0], up[1] + mine[1]
            up[2] = up[2] or mine[2] or (node.tag in ("article", "main") and mine[0] > 0 and not marks[id(node)][0] & COMMENT_WORDS)
            if node.tag == "h1" or id(node) in titled:
                titled.add(id(node.parent))
    said, todo = [], [root]
    while todo:
        for child in todo.pop().children:
            if not isinstance(child, str) and id(child) in own:
                if child.tag not in KEPT_TAGS and marks[id(child)][0] & COMMENT_WORDS and not own[id(child)][2] and id(child) not in titled:
                    said.append(child)
                else:
                    todo.append(child)
    if said and (own[id(root)][2] or own[id(root)][0] - sum(own[id(c)][0] for c in said) >= LEAST_BESIDE_COMMENTS):
        for child in said:
            own[id(child)][3], node = True, child.parent
            while node:
                own[id(node)][0] -= own[id(child)][0]
                node = node.parent
    held: dict[str, int] = {}
    todo = [(root, frozenset())]
    while todo:
        node, above = todo.pop()
        here = (marks[id(node)][0] & DROPPED_WORDS) - above if node.tag not in KEPT_TAGS else set()
        for word in here:
            held[word] = held.get(word, 0) + own[id(node)][0]
        if not own[id(node)][3]:
            todo.extend((c, above | here) for c in node.children if not isinstance(c, str) and id(c) in own)
    total = own[id(root)][0]
    return total, {k: tuple(v) for k, v in own.items()}, marks, {w for w, n in held.items() if n * 2 > total}


def score(root: Node) -> list[Node]:
    """Points of all nodes; those that have any, in page order.

    A block with text of its own is a paragraph: it passes a point, one for each
    comma and one for each 100 characters up to three to its parent, half of that
    to the next ancestor, then a sixth, a ninth and so on. A node's points are
    discounted by the share of its text that lies in links.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    own = {id(n): [0, 0] for n in order}
    for node in reversed(order):
        length = commas = 0
        for c in node.children:
            if isinstance(c, str):
                length += len(" ".join(c.split()))
                commas += c.count(",") + c.count("，") + c.count("、")
            else:
                node.length, node.links = node.length + c.length, node.links + c.links
                if c.tag not in BLOCK:
                    length, commas = length + own[id(c)][0], commas + own[id(c)][1]
        own[id(node)] = [length, commas]
        node.length += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if _is_link(node):
            node.links = node.length
    for node in order:
        length, commas = own[id(node)]
        if node.tag in BLOCK and length >= LEAST_PARAGRAPH:
            points, level, up = 1 + commas + min(3, length / 100), 0, node.parent if node.tag not in ("body", "html") else node
            while up and up.parent:
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level, up = level + 1, up.parent
    for node in order:
        if node.length and node.tag in BLOCK and (node.tag in ("article", "main") or node.points and _marks(node)[0] & GOOD_WORDS):
            node.points += BONUS
        node.points *= 1 - node.links / node.length if node.length else 0
    return [n for n in order if n.points > 0]


def main_blocks(page: str) -> list[str]:
    """Texts of the blocks of the best container and of its siblings that are alike."""
    root = parse(page)
    prune(root)
    scored = score(root)
    if not scored:  # short text, or a list of links
        return blocks(root) if root.links <= MOST_LINKS * root.length else []
    best = max(scored, key=lambda n: n.points)
    node = best
    while node.parent:  # an article is one, whichever of its parts has most points
        if node.tag in ("article", "main"):
            best = node
            break
        node = node.parent
    if not best.parent:
        return blocks(best)
    out: list[str] = []
    limit = max(10.0, SIBLING_SHARE * best.points)
    for child in _with_loose_text(best.parent):
        if child is best:
            out += blocks(child)
        elif (child.tag in BLOCK or child.tag == "#text") and child.length:
            density = child.links / child.length
            paragraph = child.tag in ("#text", "p", "pre", "blockquote", "h1", "h2", "h3") and density < 0.25 and best.tag not in ("article", "main", "body", "html")
            if paragraph or child.points >= limit and density < 0.5 and (best.tag not in ("article", "main") or child.tag in ("article", "section")):
                out += blocks(child)
    return out


def _with_loose_text(parent: Node) -> Iterator[Node]:
    """The blocks of a node, and what stands between them: texts and inline elements that follow each other are one."""
    loose = Node("#text", "", parent)
    for child in [*parent.children, None]:
        if child is None or not isinstance(child, str) and child.tag in BLOCK:
            if len(" ".join("".join(blocks(loose)).split())) >= LEAST_PARAGRAPH:
                yield loose
            loose = Node("#text", "", parent)
            if child is not None:
                yield child
        else:
            loose.children.append(child)
            loose.length += len(" ".join(child.split())) if isinstance(child, str) else child.length
            loose.links += 0 if isinstance(child, str) else child.links


def blocks(top: Node) -> list[str]:
    """Texts of all blocks below, in page order; white space is one space, references are decoded."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := " ".join(html.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        node = todo.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            line.append(node)
        elif node.tag in BLOCK:
            end()
            todo.append(None)
            todo.extend(reversed(node.children))
        else:
            if node.tag in ("br", "td", "th"):
                line.append(" ")
            if node.tag in ("td", "th"):
                todo.append(" ")
            todo.extend(reversed(node.children))
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks of every row of pages (page_id, url, html).

    A null or empty page, and one without an article, has the empty text. The
    whole page is read, whatever its length, and nothing within the article is
    cut. Repeated rows each get a row; null ids and urls stay null; other columns
    are ignored; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [main_blocks(p) if p else [] for p in b.column(2).to_pylist()]
            texts = ["\n\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), readable("url").alias("url"), readable("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
