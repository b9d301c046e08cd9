"""Main text of pages by wrappers: union-free regular expressions inferred per host.

A page is a stream of tokens: block tags, with their class, and text.  Nested
tokens form a tree, and a tree is the start of an expression.  Expressions are
aligned two by two: children are matched in order by tag and class, what only
one side has becomes optional, neighbours of the same kind fold into a repeated
group, and text becomes a slot.  The result is a union-free expression in
concatenation, ``(...)?``, ``(...)+`` and ``#`` that all aligned pages match.

Equal expressions of a host are one row before the first alignment, so a host
with a third of all pages costs what its forms of pages cost.  The forms are
aligned in a fixed order, in groups first, then the groups' results.

Slots tell content from frame by their place and by their texts: a slot below a
frame element (navigation, footer, form, advert, comments, ...) is frame, and so
is one whose text is the same on nearly all pages of a host whose other texts
differ.  A page's content is its ``article`` elements, or else ``main``.  For
pages with neither, the wrapper gives elements in order: the smallest with most
of such pages' text, then the smallest with most of what is left, and so on to
the whole page; a page's content is the first of them that it has.

Defined cases: a null or empty page, or one without content, gives an empty
text; pages without host are one host; repeated rows are extracted alike; a
page cut off in the middle is aligned like any other; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.functions import urls
from siteweave.llm.store import store

# fixed values: elements without an end tag, of lines, of blocks that end when a like one begins, and of the frame
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var wbr".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
          "th": ("td", "th", "p"), "option": ("option",)}
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
FRAME = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu title".split())
#: elements that may stand in a head; any other ends it
HEAD = frozenset("html head title base basefont bgsound link meta style script noscript template".split())
FRAME_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
                        "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related "
                        "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
MAIN = ("article", "main")
#: a form with an article or most of the page's text holds the page
PAGE_FORM = "page-form"
WHOLE = frozenset(("html", "body", "main", PAGE_FORM))
QUALIFIERS = frozenset("with without has no".split())
#: words that leave a frame word's meaning as it is: ``site-footer`` is a footer, ``related-work`` is not related links
AFFIXES = frozenset("anchor area article articles bar block bottom box button buttons col column container content entry field fixed form global group icon icons "
                    "inline inner item items left link links list main mobile outer page panel post posts primary region right row secondary section site slot "
                    "sticky to top unit wp wrap wrapper".split())
#: ids that show a frame inside an article, where others are slugs of headings
ID_INSIDE = frozenset("comments disqus replies respond sidebar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<svg\b[^>]*>(?:.*?</svg\s*>)?|<(script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                   r"|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S | re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: levels of a tree that are aligned; text further down belongs to the last
DEPTH = 100
#: a text counts as part of the frame if so many pages and this share of a host's pages have the same
SAME_PAGES, SAME_SHARE = 10, 0.9
#: groups in which the forms of a host are aligned first
GROUPS = 16


def _name(sign: str) -> str:
    return sign.partition(".")[0]


def blocks(page: str) -> list[tuple[tuple[str, ...], str]]:
    """Path of open block elements and decoded text of each run of text between block tags, in page order."""
    found = list(_blocks(page))
    forms = {path[: k + 1] for path, _ in found for k, sign in enumerate(path) if _name(sign) == "form"}
    if not forms:
        return found
    # a form is a frame unless it holds an article or most of the text
    total, held, marked = 0, Counter(), set()
    for path, text in found:
        if not in_frame(tuple(PAGE_FORM if _name(sign) == "form" else sign for sign in path)):
            total += len(text)
            for k in range(len(path)):
                if _name(path[k]) == "form":
                    held[path[: k + 1]] += len(text)
                    if any(_name(sign) in MAIN for sign in path[k:]):
                        marked.add(path[: k + 1])
    wide = {f for f in forms if f in marked or 2 * held[f] > total}
    return [(tuple(PAGE_FORM if path[: k + 1] in wide else sign for k, sign in enumerate(path)), text) for path, text in found] if wide else found


def _blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    stack: list[str] = []
    held: list[str] = []
    at, mute, depth = 0, "", 0

    def flush() -> Iterator[tuple[tuple[str, ...], str]]:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            end_head("")
            yield tuple(stack), text

    def end_head(name: str) -> None:
        """What cannot stand in a head ends it, open or not; only a body ends an open title."""
        k = next((k for k, sign in enumerate(stack) if _name(sign) == "head"), -1)
        if k >= 0 and name not in HEAD and (name == "body" or _name(stack[-1]) != "title"):
            del stack[k:]

    for m in TOKEN.finditer(page):
        if not mute:
            held.append(page[at:m.start()])
        at = m.end()
        name, end = (m[3] or "").lower(), m[2]
        if name in INLINE:
            # an inline element matters only where it is part of the frame: its text is left out, up to its end or the block's
            if mute:
                depth += (name == mute) * (-1 if end else 1)
                mute = mute if depth else ""
            elif name == "br":
                held.append(" ")
            elif m[4] and not end and name not in VOID and is_frame(_sign(name, m[4]), whole=True):
                mute, depth = name, 1
            continue
        if not name:
            continue
        yield from flush()
        mute = ""
        if end:
            # an end tag closes what is open inside its element; without that element it means nothing
            for k in range(len(stack) - 1, -1, -1):
                if _name(stack[k]) == name:
                    del stack[k:]
                    break
        elif name not in VOID:
            end_head(name)
            ends = CLOSES.get(name, ("p",) if name in BREAKS_P else ())
            while stack and _name(stack[-1]) in ends:
                stack.pop()
            stack.append(_sign(name, m[4]))
    if not mute:
        held.append(page[at:])
    yield from flush()


def _sign(name: str, attributes: str) -> str:
    """Tag and class, an element's sign; of ids, which differ from page to page, only those that show a frame (``#menu``)."""
    marks = set()
    for kind, *values in NAMED.findall(attributes):
        for value in "".join(values).lower().split():
            words = [x for x in re.split(r"\W+", value) if x and not x.isdigit()]
            if kind.lower() != "id":
                marks.add("-".join(words))
            elif name not in HEADINGS and _framed(set(WORD.findall(value)), True):
                marks.add("#" + "-".join(words))
    return ".".join((name, *sorted(marks - {""})))


def _framed(words: set[str], whole: bool) -> bool:
    """A frame word, and where ``whole`` counts nothing that changes its meaning."""
    return bool(words & FRAME_WORDS) and (words <= FRAME_WORDS | AFFIXES if whole else not words & QUALIFIERS)


def is_frame(sign: str, inside: bool = False, whole: bool = False) -> bool:
    """Frame by tag, or by a word of its class; ``with-sidebar`` and the like describe a page, not a frame.

    ``inside`` an article a header is its own and belongs to it, a class counts as a ``whole``, and ids are slugs.
    """
    name, *marks = sign.split(".")
    if name in FRAME or name == "header" and not inside:
        return True
    if name in WHOLE:
        return False
    for mark in marks:
        words = set(WORD.findall(mark))
        if mark.startswith("#"):
            if not inside or words & ID_INSIDE:
                return True
        elif _framed(words - {"header"} if inside else words, inside or whole):
            return True
    return False


@functools.lru_cache(1 << 16)
def in_frame(path: tuple[str, ...]) -> bool:
    """Below a frame element."""
    inside = False
    for sign in path:
        if is_frame(sign, inside):
            return True
        inside = inside or _name(sign) in MAIN
    return False


# An expression is [sign, how, children]: how is "", "?", "+" or "*"; a slot's sign is "#".


def form(paths: list[tuple[str, ...]]) -> list:
    """The expression of one page: its tree with repeated neighbours folded."""
    root: list = ["", "", []]
    for path in paths:
        node = root
        for sign in path[:DEPTH]:
            if not node[2] or node[2][-1][0] != sign:
                node[2].append([sign, "", []])
            node = node[2][-1]
        if not node[2] or node[2][-1][0] != "#":
            node[2].append(["#", "", []])
    return fold(root)


def fold(node: list) -> list:
    """Fold neighbours of one sign into a repeated group, children first."""
    out: list = []
    for child in (fold(c) for c in node[2]):
        if out and out[-1][0] == child[0]:
            out[-1] = [child[0], "*" if "?" in (out[-1][1], child[1]) or "*" in (out[-1][1], child[1]) else "+", align(out[-1], child)[2]]
        else:
            out.append(child)
    return [node[0], node[1], out]


def _both(a: str, b: str) -> str:
    maybe, many = any(x in "?*" and x for x in (a, b)), any(x in "+*" and x for x in (a, b))
    return "*" if maybe and many else "+" if many else "?" if maybe else ""


def _optional(node: list) -> list:
    return [node[0], _both(node[1], "?"), node[2]]


def align(a: list, b: list) -> list:
    """The least general expression that both match: a longest common run of children, the rest optional."""
    x, y = a[2], b[2]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0] == y[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i][0] == y[j][0]:
            both = align(x[i], y[j])
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            both, i = _optional(x[i]), i + 1
        else:
            both, j = _optional(y[j]), j + 1
        if out and out[-1][0] == both[0]:  # what an optional part between them kept apart
            out[-1] = [both[0], _both(_both(out[-1][1], both[1]), "+"), align(out[-1], both)[2]]
        else:
            out.append(both)
    return [a[0], _both(a[1], b[1]), out]


def expression(node: list) -> str:
    """The wrapper as a regular expression over tokens."""
    inner = " ".join(expression(c) for c in node[2])
    if not node[0]:
        return inner
    text = "#" if node[0] == "#" else f"<{node[0]}> {inner} </{_name(node[0])}>" if inner else f"<{node[0]}/>"
    return f"({text}){node[1]}" if node[1] else text


def survey(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """Forms of pages and slots per host, each reduced in its task: ``tree`` and ``n``, or ``path`` and its figures.

    ``same`` says that all pages of a task have the same text in a slot, ``text`` is its hash; ``chars`` are those of
    pages without an article or main element.
    """
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    names = ["host", "tree", "path", "n", "chars", "same", "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees: Counter = Counter()
            found: dict[tuple[str, str], list] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: dict[tuple[str, ...], list[str]] = {}
                paths = []
                for path, text in blocks(page or ""):
                    paths.append(path)
                    own.setdefault(path, []).append(text)
                trees[host, json.dumps(form(paths), separators=(",", ":"))] += 1
                marked = any(_name(s) in MAIN for path in own if not in_frame(path) for s in path)
                for path, texts in own.items():
                    if not in_frame(path):
                        said = xxhash.xxh3_64_intdigest("\n".join(texts)) >> 1
                        x = found.setdefault((host, "/".join(path)), [0, 0, said, said])
                        x[0], x[1], x[2], x[3] = x[0] + 1, x[1] + (0 if marked else sum(map(len, texts))), min(x[2], said), max(x[3], said)
            rows = [(h, t, None, n, None, None, None) for (h, t), n in trees.items()]
            rows += [(h, None, p, n, c, lo == hi, lo) for (h, p), (n, c, lo, hi) in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    rows = pages.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    return store(rows.mapInArrow(task, "host string, tree string, path string, n bigint, chars bigint, same boolean, text bigint"), "survey")


def infer(surveyed: DataFrame) -> DataFrame:
    """``(host, tree, n_pages)``: one wrapper per host, from the forms of all its pages."""
    counted = surveyed.where("tree is not null").groupBy("host", "tree").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(GROUPS)))
    groups = counted.groupBy("host", "part").applyInArrow(_aligned, "host string, tree string, n bigint")
    whole = groups.groupBy("host").applyInArrow(_aligned, "host string, tree string, n bigint")
    return store(whole.withColumnRenamed("n", "n_pages"), "wrappers")


def wrappers(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """``(host, n_pages, wrapper)`` with the wrapper as an expression."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [expression(json.loads(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], ["host", "n_pages", "wrapper"])

    known = infer(survey(pages, host_col, html_col)).select("host", "n_pages", "tree")
    return known.mapInArrow(task, "host string, n_pages bigint, wrapper string")


def _aligned(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table.column("tree").to_pylist(), table.column("n").to_pylist()))
    tree = json.loads(rows[0][0])
    for other, _ in rows[1:]:
        tree = align(tree, json.loads(other))
    return pa.table({"host": [table.column("host")[0].as_py()], "tree": [json.dumps(tree, separators=(",", ":"))], "n": pa.array([sum(n for _, n in rows)], pa.int64())})


def slots(surveyed: DataFrame) -> DataFrame:
    """``(host, path, pages, chars, constant)`` of every slot outside the frame: is its text the same on all pages that have it?"""
    return surveyed.where("path is not null").groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.sum("chars").alias("chars"), (F.bool_and("same") & (F.min("text") == F.max("text"))).alias("constant"))


def content(tree: list, n_pages: int, found: list[tuple[str, int, int, bool]]) -> tuple[list[str], list[str]]:
    """Paths of the elements that may be content of pages without article or main, in order, and of the slots that are frame.

    ``found`` has path, pages, characters on such pages and constancy of the slots outside the frame.  Each path
    takes four fifths of what those before it left, so there are few.
    """
    varying = any(not same for _, n, _, same in found if n > 1)
    constant = [p for p, n, _, same in found if same and varying and n >= max(SAME_PAGES, SAME_SHARE * n_pages)]
    paths: list[tuple[str, ...]] = []

    def walk(node: list, path: tuple[str, ...]) -> None:
        for child in node[2]:
            if child[0] == "#":
                continue
            own = (*path, child[0])
            if not in_frame(own):
                paths.append(own)
                walk(child, own)

    walk(tree, ())
    live = [(tuple(p.split("/")) if p else (), c) for p, _, c, _ in found if p not in constant]
    by_depth, roots = sorted(set(paths), key=lambda p: (-len(p), p)), []
    while total := sum(c for _, c in live):
        weight: Counter = Counter()
        for path, c in live:
            for k in range(len(path) + 1):
                weight[path[:k]] += c
        best = next((p for p in by_depth if weight[p] * 5 >= total * 4), ())
        while best and _name(best[-1]) in ("p", "li", "td", "h1", "h2", "h3", "blockquote"):
            best = best[:-1]
        roots.append("/".join(best))
        live = [(p, c) for p, c in live if p[: len(best)] != best]
    return [*roots, ""], constant


def rules(wrappers: DataFrame, found: DataFrame) -> DataFrame:
    """``(host, content, constant)``: what :func:`content` says of each host; slots of a host are few."""
    lists = found.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "pages", "chars", "constant"))).alias("slots"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [content(json.loads(tree), n, [(s["path"], s["pages"], s["chars"], s["constant"]) for s in known or ()])
                    for tree, n, known in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in said], pa.list_(pa.string())) for i in (0, 1))], ["host", "content", "constant"])

    return store(wrappers.join(lists, "host", "left").select("host", "tree", "n_pages", "slots").mapInArrow(task, "host string, content array<string>, constant array<string>"), "rules")


def main_text(page: str, inside: list[str], constant: list[str]) -> str:
    """Blocks of a page below its content elements, without the frame, one per line; ``inside`` is for a page without article and main."""
    own = [(path, text) for path, text in blocks(page) if not in_frame(path)]
    fixed = {tuple(p.split("/")) if p else () for p in constant}
    for name in MAIN:
        if any(_name(s) == name for path, _ in own for s in path):
            return "\n".join(text for path, text in own if path not in fixed and any(_name(s) == name for s in path))
    for root in (tuple(p.split("/")) if p else () for p in inside):
        if any(path[: len(root)] == root for path, _ in own):
            return "\n".join(text for path, text in own if path not in fixed and path[: len(root)] == root)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id``, ``url``, ``text`` and ``n_chars``.

    Bodies are joined only with the rules of their host: a stored table, which
    Spark broadcasts where it is small and otherwise joins by host, splitting
    the partitions of a large one.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(urls.site_of(F.col(url_col)), F.lit("")).alias("host"), F.col(html_col).alias("html"))
    surveyed = survey(rows)
    known = rules(infer(surveyed), slots(surveyed))
    joined = rows.join(known, "host", "left").select("id", "url", "html", "content", "constant")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page or "", inside or [""], fixed or []) for page, inside, fixed in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return joined.mapInArrow(task, f"`{id_col}` {kinds[id_col]}, `{url_col}` string, text string, n_chars bigint")
