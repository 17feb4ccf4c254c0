"""Pages as a table of markup nodes.

The parser is a small tolerant tokenizer in a Python function over batches of pages; all extraction is relational
work on the table it returns. A node has its place in document order, its parent, and the last number in its
subtree: b lies in a where b.node_id is between a.node_id and a.last_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.state import spread, written

SCHEMA = (
    "site string, page_id bigint, node_id int, parent_id int, last_id int, depth int, sib int, tag string, "
    "attrs map<string,string>, classes array<string>, text string"
)
#: How browsers of old pages treat tags.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("script style noscript template svg iframe".split())
BLOCK = frozenset(
    "address article aside blockquote br details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section table td th tr ul".split()
)
CLOSED_BY = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "optgroup": "option optgroup", "tr": "td th tr", "td": "td th", "th": "td th",
    "thead": "td th tr", "tbody": "td th tr thead", "tfoot": "td th tr tbody",
}
CLOSES = {tag: frozenset(tags.split()) for tag, tags in CLOSED_BY.items()}
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…", "trade": "™", "reg": "®", "copy": "©", "deg": "°", "eacute": "é", "middot": "·", "bull": "•", "euro": "€", "pound": "£", "cent": "¢",
}
LONG_TEXT = frozenset("body main article footer aside address title style script".split())
MAIN_IDS, MAIN_CLASSES = frozenset(("main", "content")), frozenset(("main-content", "entry-content"))
#: Characters of the texts that all nodes keep. Longer ones are kept where the tag is in LONG_TEXT and by nodes that may be a page's main content; they are null elsewhere.
TEXT_LIMIT = 4096
_SPACE = re.compile("[\t-\r \xa0  -     　﻿]+")
_TOKEN = re.compile(r"<!--|<[!?]|</|<(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""\s*(?:(?P<end>>)|(?P<self>/>)|(?P<name>[^\s=>/]+)(?:\s*=\s*(?:"(?P<d>[^"]*)(?:"|\Z)|'(?P<s>[^']*)(?:'|\Z)|(?P<bare>[^\s>]*)))?|[/=])""")
_BLANK = re.compile("[ \n\t]")
_NAME_END = re.compile(r"[\s/]")
_CLOSE = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in RAW}
#: Nodes that a batch of Arrow holds, about; it ends with the page that reaches them.
BATCH_NODES = 4096
_ENTITY = re.compile(r"&(?:#x([0-9a-fA-F]+)|#(\d+)|([a-zA-Z]+[0-9]*));")


def _character(m: re.Match) -> str:
    if m[3]:
        return ENTITIES.get(m[3].lower(), m[0])
    code = int(m[1], 16) if m[1] else int(m[2][:9])
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""


def decoded(text: str) -> str:
    return _ENTITY.sub(_character, text) if "&" in text else text


class _Page:
    """Collects the nodes of one page. Visible text goes to one list; nodes remember where theirs starts and ends."""

    def __init__(self) -> None:
        self.nodes: list[list] = []  # parent, last, depth, sib, tag, attrs, text from, text to, raw text, pieces said before
        self.open: list[int] = []
        self.tags: list[str] = []  # of the open nodes
        self.children: dict[int, int] = {}
        self.pieces: list[str] = []
        self.unseen = 0
        self.said = 0  # pieces so far that aren't empty

    def start(self, tag: str, attrs: dict[str, str]) -> int:
        parent = self.open[-1] if self.open else -1
        sib = self.children.get(parent, 0)
        self.children[parent] = sib + 1
        if tag in BLOCK:
            self.pieces.append("")  # becomes a blank if the block has text
        self.nodes.append([parent, 0, len(self.open), sib, tag, attrs, len(self.pieces), 0, None, self.said])
        self.unseen += tag in UNSEEN
        self.open.append(len(self.nodes) - 1)
        self.tags.append(tag)
        return len(self.nodes) - 1

    def finish(self) -> None:
        node = self.nodes[self.open.pop()]
        self.tags.pop()
        node[1], node[7] = len(self.nodes) - 1, len(self.pieces)
        self.unseen -= node[4] in UNSEEN
        if node[4] in BLOCK and self.said > node[9]:
            self.pieces[node[6] - 1] = " "
            self.pieces.append(" ")
            self.said += 1

    def say(self, raw: str) -> None:
        if not raw or not self.open or self.unseen:
            return
        text = decoded(raw)
        if text.strip() or _BLANK.search(raw):
            self.pieces.append(text)
            self.said += bool(text)

    def current(self) -> str:
        return self.tags[-1] if self.tags else ""


def parse(html: str) -> list[tuple]:
    """(node_id, parent_id, last_id, depth, sib, tag, attrs, classes, text) of every element."""
    page, at, size = _Page(), 0, len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        if token is None:
            page.say(html[at:])
            break
        begin = token.start()
        page.say(html[at:begin])
        kind = token[0]
        if kind == "<!--":
            at = begin
            while html.startswith("<!--", at):  # comments come in runs
                end = html.find("-->", at + 4)
                at = size if end < 0 else end + 3
        elif kind in ("<!", "<?"):
            end = html.find(">", begin)
            at = size if end < 0 else end + 1
        elif kind == "</":
            end = html.find(">", begin)
            if end < 0:
                break
            name = _NAME_END.split(html[begin + 2 : end].strip().lower(), maxsplit=1)[0]
            if name in page.tags:
                while page.current() != name:
                    page.finish()
                page.finish()
            at = end + 1
        else:
            at = _element(page, html, token)
    while page.open:
        page.finish()
    return _rows(page)


def _element(page: _Page, html: str, token: re.Match) -> int:
    tag, at, attrs, closed = token["tag"].lower(), token.end(), {}, False
    while m := _ATTRIBUTE.match(html, at):
        at = m.end()
        if m["end"] or m["self"]:
            closed = bool(m["self"])
            break
        if m["name"]:
            given = next((m[k] for k in ("d", "s", "bare") if m[k] is not None), m["name"])
            attrs[m["name"].lower()] = decoded(given)
    current = page.current()
    if current in CLOSES.get(tag, ()) or (current == "p" and tag in BLOCK):
        page.finish()
    node = page.start(tag, attrs)
    if tag in VOID or closed:
        page.finish()
    elif tag in RAW:
        close = _CLOSE[tag].search(html, at)
        raw = html[at : close.start() if close else len(html)]
        if tag == "title":
            raw = decoded(raw)
        page.nodes[node][8] = raw
        if tag not in UNSEEN and not page.unseen:
            page.pieces.append(raw)
            page.said += bool(raw)
        page.finish()
        at = close.end() if close else len(html)
    return at


def _single_blanks(pieces: list[str]) -> list[str]:
    """The pieces with one blank for each run of them, within pieces and across, and none at the start: what lies between two of them is squashed but for its ends."""
    out, blank = [], True
    for piece in pieces:
        text = _SPACE.sub(" ", piece)
        if blank and text.startswith(" "):
            text = text[1:]
        if text:
            blank = text.endswith(" ")
        out.append(text)
    return out


def _rows(page: _Page) -> list[tuple]:
    pieces, before = _single_blanks(page.pieces), [0]
    for piece in pieces:
        before.append(before[-1] + len(piece))
    bodiless = all(node[4] != "body" for node in page.nodes)  # then the first node is the last resort for the main content
    out = []
    for i, (parent, last, depth, sib, tag, attrs, start, end, raw, _) in enumerate(page.nodes):
        classes = attrs.get("class", "").split()
        main = attrs.get("role") == "main" or attrs.get("id") in MAIN_IDS or not MAIN_CLASSES.isdisjoint(classes) or (i == 0 and bodiless)
        if tag in ("style", "script"):
            text = raw or ""
        elif before[end] - before[start] <= TEXT_LIMIT or tag in LONG_TEXT or main:
            text = "".join(pieces[start:end]).strip(" ")
        else:
            text = None
        out.append((i, parent, last, depth, sib, tag, attrs, classes, text))
    return out


_ARROW = pa.schema([
    ("site", pa.string()), ("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "parent_id", "last_id", "depth", "sib")], ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("classes", pa.list_(pa.string())), ("text", pa.string()),
])


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)]
    columns[8] = [list(attrs.items()) for attrs in columns[8]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def html_nodes(pages: DataFrame) -> DataFrame:
    """The node table of pages(site, page_id, html). A null page has no nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for site, page, html in zip(*batch.columns):  # a text becomes one of Python's when its page is parsed
                s, p = site.as_py(), page.as_py()
                rows += [(s, p, *node) for node in parse(html.as_py() or "")]
                if len(rows) >= BATCH_NODES:
                    yield _arrow(rows)
                    rows = []
        if rows:
            yield _arrow(rows)

    return pages.select("site", F.col("page_id").cast("bigint"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def node_table(pages: DataFrame) -> DataFrame:
    """html_nodes(pages), parsed once and written to the shared folder; readers take the columns they need. Pages are dealt first, since a file's
    many pages may lie in one part of it."""
    return written(html_nodes(spread(pages.select("site", "page_id", "html"), "page_id")), "nodes")
