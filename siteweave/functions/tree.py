"""HTML to node and text arrays, one page at a time (standard library only).

The small per-row helper behind :func:`siteweave.operators.dom.parse`; the
functions travel to the workers by value, so nothing has to be installed there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import name2codepoint
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa

# fixed values: elements that never have content
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# text inside these is not visible text
HIDDEN_TEXT_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
# nodes that carry their chain of ancestors
ANCESTRY_TAGS = frozenset(["a", "img"])
# nodes that keep their own text
RAW_TAGS = frozenset(["script", "title"])

_NAME = r"[a-zA-Z_:@][-a-zA-Z0-9_:.@]*+"
_BARE = r"""[^\s"'=<>`]++"""
_ATTRS = rf"""((?:[ \t\r\n]++{_NAME}(?:="[^"]*+"|='[^']*+'|={_BARE})?+(?=[ \t\r\n/>]))*+)[ \t\r\n]*+"""
_ATTR = re.compile(rf"""({_NAME})(?:="([^"]*+)"|='([^']*+)'|=({_BARE}))?+""")
# what pages are made of, as far as it can be read in one way only; groups: text, end, start (tag, attributes, slash),
# script or style (tag, attributes, body), comment or doctype, named and numbered references, single "&" or "<"
_TOKEN = re.compile(
    r"([^<&]++)"
    r"|</\s*([a-zA-Z][-.a-zA-Z0-9:_]*)\s*>"
    rf"|<(?!(?i:script|style)[^a-zA-Z0-9])([a-zA-Z][a-zA-Z0-9]*+){_ATTRS}(/?+)>"
    rf"|<((?i:script|style)){_ATTRS}>(.*?)(?=</\s*(?i:\6)\s*>)"
    r"|(<!--.*?--\s*>|<!(?i:doctype)[^>]*+>)"
    r"|&([a-zA-Z][a-zA-Z0-9]*+)(?:;|(?=[^-.;a-zA-Z0-9]))"
    r"|&#([0-9]++|[xX][0-9a-fA-F]++);"
    r"|(&(?=[^a-zA-Z#])|<(?=[^a-zA-Z/!?]))", re.DOTALL)

_NODE = pa.struct([
    ("seq", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("parent", pa.int32()), ("anc", pa.list_(pa.int32())), ("stop", pa.int32()),
    ("t0", pa.int32()), ("t1", pa.int32()), ("raw", pa.string()),
])


def _named(name: str) -> str:
    return chr(name2codepoint[name]) if name in name2codepoint else "&" + name


def _numbered(name: str) -> str:
    try:
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        return bytes([code]).decode("cp1252") if 128 <= code < 160 else chr(code)
    except (ValueError, OverflowError):
        return "\N{REPLACEMENT CHARACTER}"


class _Tree(HTMLParser):
    """Collects nodes and texts of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.counts: dict[str, int] = {}
        self.run: list[str] = []

    def flush(self) -> None:
        if not self.run:
            return
        data = "".join(self.run)
        self.run = []
        top = self.nodes[self.open[-1]] if self.open else None
        if top is not None and top["tag"] in RAW_TAGS:
            top["raw"] = (top["raw"] or "") + data
        if top is None or top["tag"] not in HIDDEN_TEXT_TAGS:
            data = data.strip()
            if data:
                self.texts.append(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.flush()
        node = {
            "seq": len(self.nodes), "tag": tag, "attrs": {k: v or "" for k, v in attrs},
            "parent": self.open[-1] if self.open else None,
            "anc": self.open[::-1] if tag in ANCESTRY_TAGS else None,
            "stop": len(self.nodes) + 1, "t0": len(self.texts), "t1": len(self.texts), "raw": None,
        }
        self.nodes.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node["seq"])
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.flush()
        while self.counts.get(tag):
            if self.pop() == tag:
                break

    def pop(self) -> str:
        node = self.nodes[self.open.pop()]
        node["stop"], node["t1"] = len(self.nodes), len(self.texts)
        self.counts[node["tag"]] -= 1
        return node["tag"]

    def handle_data(self, data: str) -> None:
        self.run.append(data)

    def handle_entityref(self, name: str) -> None:
        self.run.append(_named(name))

    def handle_charref(self, name: str) -> None:
        self.run.append(_numbered(name))

    def handle_comment(self, data: str) -> None:
        self.flush()

    def handle_decl(self, decl: str) -> None:
        self.flush()

    def handle_pi(self, data: str) -> None:
        self.flush()


def _tree_of(html: str | None) -> tuple[list[dict], list[str]]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree.flush()
    while tree.open:
        tree.pop()
    return tree.nodes, tree.texts


def _plain_columns(html: str) -> tuple[list, ...] | None:
    """Columns of the nodes and the texts of a page that consists of plain tokens only; None for any other page."""
    tags, attrs, parents, ancs, stops, t0s, t1s, raws, texts = [], [], [], [], [], [], [], [], []
    above: list[int] = []
    counts: dict[str, int] = {}
    run: list[str] = []
    at = 0

    def flush() -> None:
        data = "".join(run)
        run.clear()
        if above:
            top = above[-1]
            if tags[top] in RAW_TAGS:
                raws[top] = (raws[top] or "") + data
            if tags[top] in HIDDEN_TEXT_TAGS:
                return
        data = data.strip()
        if data:
            texts.append(data)

    def close(tag: str) -> None:
        while counts.get(tag):
            node = above.pop()
            stops[node], t1s[node] = len(tags), len(texts)
            counts[tags[node]] -= 1
            if tags[node] == tag:
                break

    for m in _TOKEN.finditer(html):
        if m.start() != at:
            return None
        at, kind = m.end(), m.lastindex
        if kind == 1:
            run.append(m[1])
            continue
        if kind >= 10:
            run.append(_named(m[10]) if kind == 10 else _numbered(m[11]) if kind == 11 else m[12])
            continue
        if run:
            flush()
        if kind == 2:
            close(m[2].lower())
        elif kind != 9:
            tag, given = (m[3], m[4]) if kind == 5 else (m[6], m[7])
            tag = tag.lower()
            node = len(tags)
            tags.append(tag)
            own = {}
            if given:
                for name, double, single, bare in _ATTR.findall(given):
                    value = double or single or bare
                    own[name.lower()] = unescape(value) if "&" in value else value
            attrs.append(own)
            parents.append(above[-1] if above else None)
            ancs.append(above[::-1] if tag in ANCESTRY_TAGS else None)
            stops.append(node + 1)
            t0s.append(len(texts))
            t1s.append(len(texts))
            raws.append(None)
            if tag not in VOID_TAGS:
                above.append(node)
                counts[tag] = counts.get(tag, 0) + 1
            if kind == 8:
                if m[8]:
                    run.append(m[8])
            elif m[5]:
                close(tag)
    if at != len(html):
        return None
    if run:
        flush()
    for node in above:
        stops[node], t1s[node] = len(tags), len(texts)
    return tags, attrs, parents, ancs, stops, t0s, t1s, raws, texts


def _columns_of(html: str | None) -> tuple[list, ...]:
    """The page's nodes as columns, and its texts.

    Most pages consist of plain tokens, read by one pattern in a third of the time; where anything is left over, the library reads the page.
    """
    found = _plain_columns(html or "")
    if found is not None:
        return found
    nodes, texts = _tree_of(html)
    return (*[[n[name] for n in nodes] for name in ("tag", "attrs", "parent", "anc", "stop", "t0", "t1", "raw")], texts)


def _offsets(sizes: Iterator[int]) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _joined(lists: Iterator[list]) -> list:
    return list(chain.from_iterable(lists))


def parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # small slices keep the nested output of one batch within memory
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            pages = [_columns_of(h) for h in part.column("html").to_pylist()]
            # one flat column per field: cheaper than a nested value per node
            tags, attrs, parents, ancs, stops, t0s, t1s, raws, texts = (_joined(p[i] for p in pages) for i in range(9))
            maps = pa.MapArray.from_arrays(_offsets(map(len, attrs)), pa.array(_joined(attrs), pa.string()),
                                           pa.array(_joined(a.values() for a in attrs), pa.string()))
            chains = pa.ListArray.from_arrays(_offsets(len(a or ()) for a in ancs), pa.array(_joined(a or () for a in ancs), pa.int32()),
                                              mask=pa.array([a is None for a in ancs], pa.bool_()))
            numbers = [pa.array(c, pa.int32()) for c in (_joined(range(len(p[0])) for p in pages), parents, stops, t0s, t1s)]
            nodes = pa.StructArray.from_arrays([numbers[0], pa.array(tags, pa.string()), maps, numbers[1], chains, *numbers[2:], pa.array(raws, pa.string())],
                                               fields=list(_NODE))
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()),
                 pa.ListArray.from_arrays(_offsets(len(p[0]) for p in pages), nodes),
                 pa.ListArray.from_arrays(_offsets(len(p[8]) for p in pages), pa.array(texts, pa.string()))],
                names=["page_id", "url", "nodes", "texts"],
            )
