"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

Pages of a host come from one template. Their token streams are aligned one after
the other; where they differ, the wrapper gets an optional group, a repeated
group or a text slot. The article is the element whose slots vary from page to
page; what the alignment finds constant is template. Names only choose between
elements that hold this text, and mark what varies beside it (comments, adverts).
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineseek.llm.common import Scratch
from lineseek.plans.sizing import broadcast_if_small

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|$)"
    r"|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*>", re.S | re.I)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead select article main section div body".split())
#: Elements and words in class, id or role that never belong to the article.
ASIDE = frozenset("nav header footer aside form button select head menu dialog input".split())
WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|advertising|banners?|breadcrumbs?|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|"
    r"gdpr|header|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|promos|promotion|related|replies|reply|"
    r"search|share|sharing|sidebar|signup|skip|social|sponsor|sponsored|sponsors|subscribe|toolbar|topbar|widget|complementary|contentinfo)(?:$|[^a-z])")
MAIN = re.compile(r"(?:^|[^a-z])(?:main|article|articlebody|post|postbody|entry|story|content)(?:$|[^a-z])")


def opened(name: str, rest: str) -> tuple[str, bool, bool]:
    """Label of an element (name and class), whether it is beside the article, and whether it may be the article."""
    label, marks = name, ""
    for key, *values in NAMED.findall(rest):
        value = next((v for v in values if v), "")
        if key.lower() == "hidden":
            marks += " nav"
        marks += " " + re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
        if key.lower() == "class":
            label += "." + ".".join(sorted(value.split()))
    main = name in ("article", "main") or bool(MAIN.search(marks))
    return label, name in ASIDE or (bool(WORDS.search(marks)) and name not in ("html", "body", "article", "main")), main


def events(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, beside, main): '<' with a label, '>' (end), 'T' with a text, ' ' where words end; in page order, balanced."""
    stack: list[str] = []
    at = 0

    def close(name: str) -> Iterator[tuple[str, str, bool, bool]]:
        while stack:
            top = stack.pop()
            yield ">", top, False, False
            if top == name:
                return

    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "T", html.unescape(page[at : m.start()]), False, False
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name in VOID:
            if name in ("br", "hr"):
                yield " ", "", False, False
            continue
        if name not in INLINE:
            yield " ", "", False, False
        if m["end"] or m["end2"]:
            if name in stack:
                yield from close(name)
            continue
        if name not in INLINE and "p" in stack and not HOLDERS & set(stack[len(stack) - stack[::-1].index("p"):]):
            yield from close("p")
        for other in CLOSES.get(name, ()):
            if other in stack and not HOLDERS & set(stack[len(stack) - stack[::-1].index(other):]):
                yield from close(other)
        label, beside, main = opened(name, m["rest"] or "")
        stack.append(name)
        yield "<", label, beside, main
    if at < len(page):
        yield "T", html.unescape(page[at:]), False, False
    yield from close("")


class Node:
    """An element or text slot ("#") of a wrapper."""

    __slots__ = ("label", "children", "optional", "repeated", "beside", "main", "text", "varies", "size", "pages")

    def __init__(self, label: str, beside: bool = False, main: bool = False) -> None:
        self.label, self.beside, self.main = label, beside, main
        self.children: list[Node] = []
        self.optional = self.repeated = self.varies = False
        self.text: str | None = None
        self.size, self.pages = 0, 1


def shape(label: str) -> str:
    """Labels that differ in digits only have one shape; only those with digits differ from it."""
    return label if label.startswith("~") or not re.search("[0-9]", label.partition(".")[2]) else "~" + re.sub("[0-9]+", "0", label)


def _short(text: str) -> str:
    """A long text is known by its beginning and a checksum."""
    return text if len(text) <= 200 else f"{text[:200]}... {zlib.crc32(text.encode('utf-8', 'surrogatepass')):08x}"


def tree(page: str) -> Node:
    """The page as a wrapper of one page: repeated siblings are folded as they close."""
    root = Node("")
    stack = [root]
    for kind, value, beside, main in events(page):
        if kind == "<":
            new = Node(value, beside, main)
            stack[-1].children.append(new)
            stack.append(new)
        elif kind == ">":
            fold(stack.pop())
        elif kind == "T" and value.strip():
            slot = Node("#")
            text = " ".join(value.split())
            slot.text, slot.size = _short(text), len(text)
            stack[-1].children.append(slot)
    fold(root)
    return root


def fold(parent: Node) -> None:
    """Neighbours with the same label become one repeated group. Their texts follow each other: no page is compared here."""
    groups: list[list[Node]] = []
    for child in parent.children:
        if groups and groups[-1][0].label == child.label:
            groups[-1].append(child)
        else:
            groups.append([child])
    parent.children = [g[0] if len(g) == 1 else _merged(g, False) for g in groups]
    for child, g in zip(parent.children, groups, strict=True):
        child.repeated |= len(g) > 1


def merge(a: Node, b: Node) -> Node:
    """Align the wrappers of an element on different pages. Both are used up."""
    return _merged([a, b], True)


def _merged(nodes: list[Node], across: bool) -> Node:
    """Several wrappers as one, level by level. ``across`` pages a text that differs varies; within a page texts are chained."""
    top = Node(nodes[0].label)
    work = [(top, nodes)]
    while work:
        out, parts = work.pop()
        for flag in ("optional", "repeated", "beside", "main", "varies"):
            setattr(out, flag, getattr(out, flag) or any(getattr(p, flag) for p in parts))
        out.size = sum(p.size for p in parts)
        out.pages = sum(p.pages for p in parts) if across else 1
        out.text = parts[0].text
        if out.label == "#":
            if across:
                out.varies |= any(p.text != out.text for p in parts)
            else:
                for p in parts[1:]:
                    out.text = _short(f"{out.text} {p.text}")
        groups = [[c.label, [c], False, False] for c in parts[0].children]
        for other in parts[1:]:
            groups = _aligned(groups, other.children)
        for label, members, optional, repeated in groups:
            child = members[0]
            if len(members) > 1:
                child = Node(label)
                work.append((child, members))
            child.optional |= optional
            child.repeated |= repeated
            out.children.append(child)
    return top


def _aligned(groups: list[list], children: list[Node]) -> list[list]:
    """Groups [label, members, optional, repeated] with the children of one more element put where they belong."""
    out: list[list] = []
    for i, j in match([g[0] for g in groups], [c.label for c in children]):
        if j is None:
            group = groups[i]
            group[2] = True
        elif i is None:
            group = [children[j].label, [children[j]], True, False]
        else:
            group = groups[i]
            group[1].append(children[j])
            group[0] = group[0] if group[0] == children[j].label else shape(group[0])
        if out and out[-1][0] == group[0]:  # neighbours with one label are one repeated group
            out[-1] = [group[0], out[-1][1] + group[1], out[-1][2] and group[2], True]
        else:
            out.append(group)
    return out


#: Gaps up to this many label pairs are aligned by a longest common subsequence, larger ones between labels that both sides hold once.
GAP = 2500


def match(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Places of both sequences in order, equal labels together; labels of one shape where nothing better fits."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    shape_a, shape_b = list(map(shape, a)), list(map(shape, b))
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, n, j, m = gaps.pop()
        while i < n and j < m and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            pairs.append((n, m))
        if i == n or j == m:
            continue
        if (n - i) * (m - j) <= GAP:
            pairs += _common(a, b, shape_a, shape_b, i, n, j, m)
            continue
        once_a, once_b = Counter(a[i:n]), Counter(b[j:m])
        at = {y: k for k, y in enumerate(b[j:m], j) if once_b[y] == 1}
        anchors = _rising([(k, at[x]) for k, x in enumerate(a[i:n], i) if once_a[x] == 1 and x in at])
        if anchors:
            ends = [(i - 1, j - 1), *anchors, (n, m)]
            gaps += [(k + 1, k2, l + 1, l2) for (k, l), (k2, l2) in zip(ends, ends[1:], strict=False)]
            pairs += anchors
        else:
            pairs += _greedy(shape_a, shape_b, i, n, j, m)
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for k, l in [*sorted(pairs), (len(a), len(b))]:
        out += [(x, None) for x in range(i, k)] + [(None, y) for y in range(j, l)]
        if k < len(a):
            out.append((k, l))
        i, j = k + 1, l + 1
    return out


def _common(a: list[str], b: list[str], shape_a: list[str], shape_b: list[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """Longest common subsequence of a gap; an equal label counts for two of equal shape."""
    def worth(x: int, y: int) -> int:
        return 2 if a[x] == b[y] else int(shape_a[x] == shape_b[y])

    best = [[0] * (m - j + 1) for _ in range(n - i + 1)]
    for x in range(n - 1, i - 1, -1):
        for y in range(m - 1, j - 1, -1):
            w = worth(x, y)
            best[x - i][y - j] = max(best[x - i + 1][y - j], best[x - i][y - j + 1], best[x - i + 1][y - j + 1] + w if w else 0)
    out, x, y = [], i, j
    while x < n and y < m:
        w = worth(x, y)
        if w and best[x - i][y - j] == best[x - i + 1][y - j + 1] + w:
            out.append((x, y))
            x, y = x + 1, y + 1
        elif best[x - i + 1][y - j] >= best[x - i][y - j + 1]:
            x += 1
        else:
            y += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that rises on both sides."""
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tails, y)
        before.append(last[at - 1] if at else -1)
        tails[at : at + 1] = [y]
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _greedy(a: list[str], b: list[str], i: int, n: int, j: int, m: int) -> list[tuple[int, int]]:
    """Each label with the next one of its shape: linear, for long gaps in which no label stands once."""
    places: dict[str, list[int]] = {}
    for y in range(j, m):
        places.setdefault(b[y], []).append(y)
    out = []
    for x in range(i, n):
        found = places.get(a[x], [])
        at = bisect_left(found, j)
        if at < len(found):
            out.append((x, found[at]))
            j = found[at] + 1
    return out


def _walk(w: Node) -> list[tuple[int, int, Node]]:
    """(parent's place, depth, node) in page order."""
    out: list[tuple[int, int, Node]] = []
    stack = [(-1, 0, w)]
    while stack:
        up, depth, x = stack.pop()
        stack += [(len(out), depth + 1, c) for c in reversed(x.children)]
        out.append((up, depth, x))
    return out


def dump(w: Node) -> str:
    return json.dumps([[up, *(getattr(x, f) for f in Node.__slots__ if f != "children")] for up, _, x in _walk(w)])


def load(text: str) -> Node:
    nodes: list[Node] = []
    for up, *values in json.loads(text):
        x = Node("")
        for field, value in zip((f for f in Node.__slots__ if f != "children"), values, strict=True):
            setattr(x, field, value)
        if nodes:
            nodes[up].children.append(x)
        nodes.append(x)
    return nodes[0]


def expression(w: Node) -> str:
    """The wrapper as a union-free regular expression over tags and text slots."""
    out: list[str] = []
    stack: list[Node | str] = [w]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[x.optional, x.repeated]
        out.append("(" if mark else "")
        stack.append(f"){mark}" if mark else "")
        if x.label == "#":
            out.append("#TEXT" if x.varies else json.dumps(x.text, ensure_ascii=False))
        elif x.label:
            out.append(f"<{x.label}>")
            stack.append("</>")
        stack += reversed(x.children)
    return "".join(out)


#: Elements that hold blocks: those whose text is the same on every page are template.
BLOCKS = frozenset("div ul ol dl table section center".split())


def rules(w: Node) -> dict[str, list[list[str]]]:
    """``main``: paths of the elements that hold a host's articles, best first; ``drop``: paths of template inside them.

    An element counts for the text in its slots that varies between pages, or that
    only one page has; where nothing varies (one page, or copies of one), for all its
    text. Elements named as articles decide where they hold most of it: those with
    most of it first, then article and main, then the inner ones of equals. Else the
    way leads down from the root as long as one child holds most of it, and blocks
    with the same text on three pages or more are dropped.
    """
    places = _walk(w)
    nodes = [x for *_, x in places]
    hidden: list[bool] = []
    for up, _, x in places:
        hidden.append(x.beside or up >= 0 and hidden[up])

    def measured(constant: bool) -> list[int]:
        out = [x.size if x.label == "#" and (constant or x.varies or x.pages == 1) and not off else 0 for x, off in zip(nodes, hidden, strict=True)]
        for k in range(len(nodes) - 1, 0, -1):
            out[places[k][0]] += out[k]
        return out

    def path(k: int) -> list[str]:
        out = []
        while k > 0:
            out.append(nodes[k].label)
            k = places[k][0]
        return out[::-1]

    whole = measured(True)
    held = measured(False)
    varying = held[0] > 0
    held = held if varying else whole
    within: list[bool] = []  # inside an element named as an article
    named, total = [], 0
    for k, (up, depth, x) in enumerate(places):
        inner = up >= 0 and within[up]
        mine = x.main and not hidden[k] and x.label != "#"
        within.append(inner or mine)
        if mine and held[k]:
            named.append((k, depth))
            total += 0 if inner else held[k]
    if named and total * 10 >= held[0] * 6:
        rank = sorted(((held[k] * 10 >= total * 6, re.split("[.]", nodes[k].label.lstrip("~"))[0] in ("article", "main"), held[k], depth, k) for k, depth in named), reverse=True)
        return {"main": [path(k) for *_, k in rank], "drop": []}

    below: dict[int, list[int]] = {}
    for k, (up, _, x) in enumerate(places):
        if x.label != "#" and not hidden[k]:
            below.setdefault(up, []).append(k)

    def tag(k: int) -> str:
        return nodes[k].label.lstrip("~").split(".")[0]

    at = 0
    while True:
        most = max(below.get(at, ()), key=lambda k: held[k], default=None)
        if most is None or held[most] * 10 < held[at] * 6 or tag(most) in INLINE | {"p", "h1", "h2", "h3"}:
            break
        at = most
    drop, todo = [], list(below.get(at, ())) if varying else []
    while todo:
        k = todo.pop()
        if held[k]:
            todo += below.get(k, ())
        elif whole[k] and nodes[k].pages >= 3 and tag(k) in BLOCKS:
            drop.append(path(k))
    return {"main": [path(at)], "drop": sorted(drop)}


def extract(page: str, rule: dict[str, list[list[str]]]) -> str:
    """The article's text of one page: white space is one space, blocks are joined by one space."""
    paths = [*rule["main"], *rule["drop"]]
    parts: dict[int, list[str]] = {}
    alive: tuple[int, ...] = tuple(range(len(paths)))  # paths that lead through the open element
    open_: list[tuple[tuple[int, ...], int]] = []
    inside: list[tuple[int, int]] = []
    beside = 0
    rest: list[str] = []
    for kind, value, off, _ in events(page):
        if kind == "<":
            depth = len(open_)
            open_.append((alive, beside))
            beside += off
            if alive:
                same = shape(value)
                alive = tuple(k for k in alive if depth < len(paths[k]) and paths[k][depth] in (value, same))
                for k in alive:
                    if len(paths[k]) == depth + 1 and k >= len(rule["main"]):
                        beside += 1
                    elif len(paths[k]) == depth + 1 and not beside:
                        inside.append((k, depth + 1))
                        parts.setdefault(k, []).append(" ")
        elif kind == ">":
            while inside and inside[-1][1] == len(open_):
                parts[inside.pop()[0]].append(" ")
            alive, beside = open_.pop()
        elif kind == " ":
            for k, _ in inside:
                parts[k].append(" ")
            rest.append(" ")
        elif not beside:
            for k, _ in inside:
                parts[k].append(value)
            rest.append(value)
    chosen = next((parts[k] for k in range(len(rule["main"])) if k in parts), rest)
    return " ".join("".join(chosen).split())


#: Nodes of wrappers that a task holds before it sends them on.
HELD_NODES = 500_000


def _wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper a host and task, or more where a task's hosts have many nodes."""
    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([dump(w) for w in found.values()], pa.string())], ["host", "wrapper"])

    found: dict[str, Node] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            new = tree(page.as_py())
            found[host] = merge(found[host], new) if host in found else new
        if sum(len(_walk(w)) for w in found.values()) > HELD_NODES:
            yield sent()
            found = {}
    if found:
        yield sent()


def _whole(table: pa.Table) -> Node:
    whole = None
    for text in sorted(table["wrapper"].to_pylist()):
        whole = load(text) if whole is None else merge(whole, load(text))
    return whole


def _some(key: tuple, table: pa.Table) -> pa.Table:
    """A share of a host's wrappers aligned to one."""
    return pa.table({"host": pa.array([key[0].as_py()]), "wrapper": pa.array([dump(_whole(table))])})


def _join(key: tuple, table: pa.Table) -> pa.Table:
    """The wrappers of a host's shares aligned to one."""
    whole = _whole(table)
    return pa.table({"host": pa.array([key[0].as_py()]), "expression": pa.array([expression(whole)]), "rules": pa.array([json.dumps(rules(whole))])})


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing: dict[str, list[list[str]]] = {"main": [], "drop": []}
    for batch in batches:
        known = {None: nothing}
        out = []
        for page, rule in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            if rule not in known:
                known[rule] = json.loads(rule)
            out.append(extract(page.as_py(), known[rule]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]*)", 1))


SHARES = 64


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, expression (the wrapper), rules (JSON) of every host, from all its pages.

    Pages are aligned in each task, then the wrappers of the tasks in ``SHARES``
    shares of a host, then these: a host that holds a third of all pages is aligned by
    many tasks. Null pages are empty. Pages without a host share the host "".
    """
    rows = pages.select(_host(url).alias("host"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    found = rows.mapInArrow(_wrap, "host string, wrapper string").withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(SHARES)))
    found = found.groupBy("host", "share").applyInArrow(_some, "host string, wrapper string")
    return found.groupBy("host").applyInArrow(_join, "host string, expression string, rules string")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page; one row each.

    Null and empty pages give an empty text. Very long and deeply nested pages are
    read whole, without recursion. Repeated rows are answered alike; an empty table
    gives no rows; other columns are ignored, whatever their names. Rules meet pages by a
    broadcast when the written table of hosts is small (checked), else by a join.
    """
    scratch = Scratch(pages.sparkSession, "html")
    found = scratch.keep("wrappers", wrappers(pages, url, page))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"), _host(url).alias("host"))
    both = rows.join(broadcast_if_small(found.select("host", "rules")), "host", "left").select("page_id", "url", "html", "rules")
    return both.mapInArrow(_apply, "page_id long, url string, text string, n_chars long")
