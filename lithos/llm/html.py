"""Main-text extraction through wrappers inferred per host.

Every page becomes a stream of tag symbols and text slots. Adjacent repeats are folded into repeated groups,
so that a page's structure is short whatever its length. The structures of a host are aligned one after the
other into a union-free regular expression, its wrapper: equal symbols stay, groups with equal heads are
aligned inside, a group met once on one side and repeatedly on the other becomes repeated, and what only one
side has becomes optional. A page is then read by aligning its structure with its host's wrapper. The place of
a text slot is named by the elements that the page has open there; of those that the page never closes, the ones
that the wrapper has closed by then are left out. What the wrapper holds of other pages' alternatives opens
nothing.

The texts of all of a host's different pages then meet in the wrapper's slots. A slot that holds one text on more
than half of its pages, three at least, is template; the others are fields. The article is the innermost element
with three quarters of the text of the fields, widened to the headings that stand before it and to an element
around it whose name calls it an article. What a page marks as ``article`` or ``main`` comes first. Names of classes
are hints: an element that holds three quarters of the host's field text is not dropped for them, and one that
they call an article is none where the wrapper has another. Outside the article nothing is kept; inside it all
is but boilerplate elements and elements whose every slot is template. A host of fewer than three different pages has
no fields and templates, and is read by names alone.

Structures are counted distinct per host before they meet, and a host's are aligned in ``SALTS`` parts first,
so a host with a third of all pages sends no more than its different structures; texts meet as one hash for a slot
and page. Wrappers are handed to the tasks as a broadcast while they are within ``BROADCAST_BYTES``; beyond it
pages are joined to them by host.

Defined results: null or empty html gives empty text; a null url is a host of its own; repeated pages each
give their row; other columns are ignored; an empty table gives an empty result. Structures of every size are
aligned in the same way; nothing is cut.
"""

from __future__ import annotations

import html as _html
import json
import re
from difflib import SequenceMatcher
from operator import eq

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lithos.llm.store import written
from lithos.llm.text import blocks, tidy

SALTS = 16
BROADCAST_BYTES = 16 << 20
#: Pairs of nodes up to which difflib finds the longest common run; beyond, an automaton finds the same run in linear time.
DIRECT = 100_000
#: Nodes that a task keeps of wrappers and of structures it has aligned.
KEPT_NODES = 1_000_000
#: Longest repeated group that folding looks for, in nodes.
LONGEST_GROUP = 16
TEXT = "#"
#: Different pages that a slot is seen on before it can be template.
LEAST_PAGES = 3
#: Share of a host's field text that the article holds.
MOST = 0.75
#: Open elements that name a slot of a node.
CHAIN = 6

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
                    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_NO_TAG = re.compile(r"<(?!!--|(?:script|style|noscript|template|textarea|svg|iframe)\b)", re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Fixed values of HTML: elements without content, and elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub "
                   "sup time tt u var wbr img".split())
#: Elements whose text is no main text, and words of class, id or role that say the same.
OUTSIDE = frozenset("head nav footer aside form button select option menu dialog object audio video canvas".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent notice notices gdpr popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "discussion respond disqus toolbar pagination pager contentinfo complementary search alert".split())
#: The same, but only outside an article.
HEADING_WORDS = frozenset("header masthead topbar".split())
INSIDE = frozenset(("article", "main"))
INSIDE_WORDS = frozenset("article content main post story entry".split())
#: Elements that can be the article, and those of its headings.
CONTAINERS = frozenset("div section article main td center blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p".split())
#: Elements that are dropped from an article when all they hold is template.
BOXES = CONTAINERS | frozenset("ul ol dl table figure details".split())
_CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()),
           "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
           "th": frozenset("td th".split()), "option": frozenset("option".split())}


def tokens(page: str) -> tuple[list[str], list[str]]:
    """(symbols, texts): tags as name or name.words or /name, text slots as ``#``, in page order. White
    space alone makes no slot; scripts, styles and comments make nothing."""
    symbols, texts, end = [], [], 0
    # behind the last > there are no tags: what looks like the start of one is text, and is not tried as a tag
    cut = page.rfind(">") + 1
    if "<" in page[cut:]:
        page = page[:cut] + _NO_TAG.sub("&lt;", page[cut:])
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            text = page[end:m.start()]
            if text.isspace():
                if symbols and symbols[-1] == TEXT:
                    texts[-1] += " "
            elif symbols and symbols[-1] == TEXT:
                texts[-1] += text
            else:
                symbols.append(TEXT)
                texts.append(text)
        end = m.end()
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            symbols.append("/" + name)
        else:
            words = sorted({w for a in _NAMED.findall(m[4]) for w in re.findall("[a-z]+", "".join(a).lower())}) if "=" in m[4] else []
            symbols.append(".".join([name, *words]))
        texts.append("")
    if end < len(page) and not page[end:].isspace():
        symbols.append(TEXT)
        texts.append(page[end:])
    return symbols, texts


# A node is a symbol or a repeated group, a tuple of nodes. A wrapper pairs every node with its being optional.
def fold(nodes: list, sizes: list[int]) -> tuple[list, list[int]]:
    """Adjacent repeats as groups, shortest first, until none is left; sizes: tokens under each node."""
    changed = True
    while changed:
        changed = False
        for n in range(1, LONGEST_GROUP + 1):
            # nothing to do without n nodes that equal the n before them, or a group that n nodes can join
            if b"\1" * n not in bytes(map(eq, nodes, nodes[n:])) and not any(isinstance(x, tuple) and len(x) == n for x in nodes):
                continue
            out, span, i = [], [], 0
            while i < len(nodes):
                j = i + n
                if n == 1 and isinstance(nodes[i], tuple):
                    while j < len(nodes) and nodes[j] == nodes[i]:
                        j += 1
                    out.append(nodes[i])
                    span.append(sum(sizes[i:j]))
                    changed |= j > i + 1
                    i = j
                    continue
                # a run of close tags is none: it closes different elements
                if nodes[i] != TEXT and (isinstance(nodes[i], tuple) or nodes[i][0] != "/"):
                    while j + n <= len(nodes) and nodes[j:j + n] == nodes[i:i + n]:
                        j += n
                if j > i + n and n > 1 or j > i + 1 and n == 1:
                    group = tuple(nodes[i:i + n])
                    out.append(group)
                    span.append(sum(sizes[i:j]))
                    changed, i = True, j
                elif out and isinstance(out[-1], tuple) and out[-1] == tuple(nodes[i:i + n]):
                    span[-1] += sum(sizes[i:i + n])
                    changed, i = True, i + n
                else:
                    out.append(nodes[i])
                    span.append(sizes[i])
                    i += 1
            nodes, sizes = out, span
    return nodes, sizes


def _head(node):
    while isinstance(node, tuple):
        node = node[0]
    return node


def _as_group(nodes: list, sizes: list | None, groups: set) -> tuple[list, list | None]:
    """Write each plain run that equals a known group as that group."""
    by_head: dict = {}
    for g in groups:
        by_head.setdefault(g[0], []).append(g)
    out, span, i = [], [], 0
    while i < len(nodes):
        for g in sorted(by_head.get(nodes[i], ()), key=lambda g: (-len(g), repr(g))):
            if tuple(nodes[i:i + len(g)]) == g:
                out.append(g)
                span.append(sum(sizes[i:i + len(g)]) if sizes else 0)
                i += len(g)
                break
        else:
            out.append(nodes[i])
            span.append(sizes[i] if sizes else 0)
            i += 1
    return out, span if sizes is not None else None


def _key(node):
    return ("+", _head(node)) if isinstance(node, tuple) else node


def _longest(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common run (start in a, start in b, length) of two stretches, of several the first in a, then in b, as
    difflib's ``find_longest_match``: by a suffix automaton of b's stretch, in linear time whatever repeats."""
    step: list[dict[int, int]] = [{}]
    link, size, end, last = [-1], [0], [-1], 0
    for j in range(blo, bhi):
        c, now = b[j], len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(j)  # where a state's runs end first
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    best, state, length = (alo, blo, 0), 0, 0
    for i in range(alo, ahi):
        c = a[i]
        while state and c not in step[state]:
            state = link[state]
            length = size[state]
        if c in step[state]:
            state, length = step[state][c], length + 1
            if length > best[2]:
                best = i - length + 1, end[state] - length + 1, length
    return best


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of aligned nodes of two sequences: the longest common run, then those on either side of it."""
    known: dict = {}
    a, b = ([known.setdefault(_key(x), len(known)) for x in nodes] for nodes in (a, b))
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        if (ahi - alo) * (bhi - blo) <= DIRECT:
            found = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks()
            out += [(alo + m.a + k, blo + m.b + k) for m in found for k in range(m.size)]
            continue
        i, j, n = _longest(a, b, alo, ahi, blo, bhi)
        if n:
            out += [(i + k, j + k) for k in range(n)]
            todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return sorted(out)


def _inside(a: tuple, b: tuple) -> tuple:
    """Two repeated groups with equal heads as one: all nodes of both, in aligned order."""
    if a == b:
        return a
    return tuple(n for n, _ in align([(n, False) for n in a], list(b)))


def align(wrapper: list[tuple], page: list) -> list[tuple]:
    """The wrapper generalised so that it covers ``page`` too."""
    groups = {n for n, _ in wrapper if isinstance(n, tuple)} | {n for n in page if isinstance(n, tuple)}
    if groups:
        page, _ = _as_group(page, None, groups)
        plain, _ = _as_group([n for n, _ in wrapper], None, groups)
        if len(plain) != len(wrapper):
            flags, i = [], 0
            for n in plain:
                k = len(n) if isinstance(n, tuple) and wrapper[i][0] != n else 1
                flags.append(any(o for _, o in wrapper[i:i + k]))
                i += k
            wrapper = list(zip(plain, flags, strict=True))
    out, i, j = [], 0, 0
    for a, b in [*_matches([n for n, _ in wrapper], page), (len(wrapper), len(page))]:
        out += [(n, True) for n, _ in wrapper[i:a]] + [(n, True) for n in page[j:b]]
        if a < len(wrapper):
            node, optional = wrapper[a]
            out.append((_inside(node, page[b]) if isinstance(node, tuple) else node, optional))
        i, j = a + 1, b + 1
    return out


class Open:
    """Open elements of a walk over symbols, each with the mark it was opened with."""

    def __init__(self):
        self.names: list[str] = []
        self.marks: list[int] = []
        self.gone: list[tuple[int, str]] = []

    def _cut(self, k: int) -> None:
        self.gone = list(zip(self.marks[k:], self.names[k:], strict=True))
        del self.names[k:], self.marks[k:]

    def step(self, symbol: str, mark: int) -> int | None:
        """The mark of the element that ``symbol`` closes, if it is a close tag of one."""
        name = symbol.split(".", 1)[0]
        if name[0] == "/":
            for k in range(len(self.names) - 1, -1, -1):
                if self.names[k].split(".", 1)[0] == name[1:]:
                    shut = self.marks[k]
                    self._cut(k)
                    return shut
            return None
        if name in VOID:
            return None
        shuts = _CLOSES.get(name)
        if shuts:
            for k in range(len(self.names) - 1, -1, -1):
                above = self.names[k].split(".", 1)[0]
                if above in shuts:
                    self._cut(k)
                    break
                if above not in INLINE:
                    break
        self.names.append(symbol)
        self.marks.append(mark)
        return None


def place(names) -> int:
    """0: boilerplate; 1: text outside an article; 2: inside one."""
    kind = 1
    for symbol in names:
        name, *words = symbol.split(".")
        inside = kind == 2
        if name in OUTSIDE or name not in ("html", "body", "main", "article") and not OUTSIDE_WORDS.isdisjoint(words):
            return 0
        if not inside and (name == "header" or not HEADING_WORDS.isdisjoint(words) and name not in ("html", "body")):
            return 0
        if name in INSIDE or name in ("div", "section", "td") and not INSIDE_WORDS.isdisjoint(words):
            kind = 2
    return kind


def chain(names) -> str:
    """The last open elements of a walk, each named once."""
    return ">".join(dict.fromkeys(names[-CHAIN:]))


def fields(symbols: list, texts: list, sizes: list[int]) -> dict[tuple[int, str], list[str]]:
    """(node, chain) -> the texts of that slot, in page order."""
    at = [i for i, size in enumerate(sizes) for _ in range(size)]
    walk, out = Open(), {}
    for k, symbol in enumerate(symbols):
        if symbol == TEXT:
            out.setdefault((at[k], chain(walk.names)), []).append(texts[k].strip())
        else:
            walk.step(symbol, k)
    return out


def opened(nodes: list):
    """(i, the plain nodes whose elements are open before node i) for each node of a structure that holds text."""
    walk = Open()
    for i, n in enumerate(nodes):
        if TEXT in _flat(n):
            yield i, [mark for mark in walk.marks if not isinstance(nodes[mark], tuple)]
        for s in _flat(n):
            if s != TEXT:
                walk.step(s, i)


def _spoken_against(symbol: str) -> bool:
    name, *words = symbol.split(".")
    return name in OUTSIDE or name not in ("html", "body", "main", "article") and not OUTSIDE_WORDS.isdisjoint(words)


def _name(symbol: str) -> str:
    return symbol.split(".", 1)[0]


class Wrapper:
    """A host's wrapper, ready to read pages. ``slots`` are (node, chain, open nodes, pages, pages with the most
    frequent text, characters)."""

    def __init__(self, nodes: list[tuple], slots: list | None = None):
        self.nodes = [n for n, _ in nodes]
        self.groups = {n for n in self.nodes if isinstance(n, tuple)}
        self.known: dict[tuple, list] = {}
        self.held = 0
        #: (node that opens an element, symbol) -> the last node before which it is open
        self.until: dict[tuple[int, str], int] = {}
        walk = Open()
        for i, n in enumerate(self.nodes):
            for s in _flat(n):
                if s != TEXT:
                    walk.step(s, i)
                    self.until.update(dict.fromkeys(walk.gone, i))
                    walk.gone = []
        self.until.update(dict.fromkeys(zip(walk.marks, walk.names, strict=True), len(self.nodes)))
        #: template slots; elements that hold nothing else; elements whose names do not speak against them; the article
        self.template: set[tuple[int, str]] = set()
        self.fixed: set[int] = set()
        self.trusted: set[int] = set()
        self.article: int | None = None
        if slots:
            self._judge(slots)

    @property
    def paths(self) -> list[frozenset]:
        """For each node the elements open before it, as (node that opens it, symbol); pages are read by ``until``."""
        return [frozenset(k for k, last in self.until.items() if k[0] < i <= last) for i in range(len(self.nodes))]

    def _judge(self, slots: list) -> None:
        self.template = {(n, c) for n, c, _, pages, top, _ in slots if pages >= LEAST_PAGES and 2 * top > pages}
        filled = {u for n, c, under, *_ in slots if (n, c) not in self.template for u in under}
        self.fixed = {u for n, c, under, *_ in slots for u in under
                      if u not in filled and _name(self.nodes[u]) in BOXES}
        if max(pages for _, _, _, pages, _, _ in slots) < LEAST_PAGES:
            return
        varying = []
        for n, c, under, _, _, size in slots:
            names = [self.nodes[u] for u in under]
            inner = [x for x in c.split(">") if x and x not in names]
            if (n, c) not in self.template and OUTSIDE.isdisjoint(map(_name, names + inner)):
                varying.append((under, inner, size))

        def held(rows: list) -> dict[int, int]:
            out: dict[int, int] = {}
            for under, _, size in rows:
                for u in under:
                    out[u] = out.get(u, 0) + size
            return out

        # a name of boilerplate words alone is believed whatever the element holds
        total = sum(size for _, _, size in varying)
        self.trusted = {u for u, size in held(varying).items() if size >= MOST * total
                        and not OUTSIDE_WORDS.issuperset(self.nodes[u].split(".")[1:])}
        varying = [r for r in varying if not any(_spoken_against(self.nodes[u]) for u in r[0] if u not in self.trusted)
                   and not any(map(_spoken_against, r[1]))]
        total = sum(size for _, _, size in varying)
        most = [u for u, size in held(varying).items() if size >= MOST * total and _name(self.nodes[u]) in CONTAINERS]
        if not total or not most:
            return
        found = max(most)
        around = next(under[:under.index(found)] for under, _, _ in varying if found in under)
        for u in reversed([*around, found]):
            if _name(self.nodes[u]) in CONTAINERS and not INSIDE_WORDS.isdisjoint(self.nodes[u].split(".")[1:]):
                self.article = u
                return
        for u in reversed(around):
            if _name(self.nodes[u]) not in CONTAINERS or not all(
                    HEADINGS.union(INLINE).issuperset(map(_name, [*(self.nodes[v] for v in under[under.index(u) + 1:]), *inner]))
                    for under, inner, _ in varying if u in under and found not in under):
                break
            found = u
        self.article = found

    def aligned(self, nodes: list) -> list:
        """For each node of a folded page the wrapper's node (None: not aligned)."""
        key = tuple(nodes)
        if key not in self.known:
            self.held += len(key)
            if len(self.known) > 5_000 or self.held > KEPT_NODES:
                self.known.clear()
                self.held = len(key)
            out = [None] * len(nodes)
            for a, b in _matches(self.nodes, nodes):
                out[b] = a
            self.known[key] = out
        return self.known[key]


def _flat(node):
    if isinstance(node, tuple):
        for n in node:
            yield from _flat(n)
    else:
        yield node


def _bare(symbol: str) -> str:
    """A symbol without the words that speak against it."""
    name, *words = symbol.split(".")
    return ".".join([name, *(w for w in words if w in INSIDE_WORDS)])


def main_text(page: str, wrapper: Wrapper | None) -> str:
    """The main text of a page, one space between blocks and for each run of white space."""
    symbols, texts = tokens(page)
    walk, shut, slots = Open(), set(), {}
    held, total, holds = {}, 0, set()
    for k, symbol in enumerate(symbols):
        if symbol == TEXT:
            slots[k] = tuple(walk.names), tuple(walk.marks)
            size = len(texts[k])
            total += size
            for mark in walk.marks:
                held[mark] = held.get(mark, 0) + size
        else:
            name, *words = symbol.split(".")
            if name in INSIDE or not INSIDE_WORDS.isdisjoint(words):
                holds.update(walk.marks)
                holds.add(k)
            shut.add(walk.step(symbol, k))
    # an element that holds the article and most of the page's text is no boilerplate, whatever it is called; of one
    # that the page never closes, only the wrapper knows what it holds
    whole = {mark for mark, size in held.items() if mark in holds and mark in shut and 2 * size > total}
    nodes, sizes = fold(list(symbols), [1] * len(symbols))
    at = None
    if wrapper is not None and wrapper.nodes:
        nodes, sizes = _as_group(nodes, sizes, wrapper.groups)
        at = [a for a, size in zip(wrapper.aligned(nodes), sizes, strict=True) for _ in range(size)]
        whole |= {mark for mark in held if at[mark] in wrapper.trusted}
    marked = any(place(names) and any(_name(n) in INSIDE for n in names) for names, _ in slots.values())

    def closed(k: int, mark: int) -> bool:
        """Whether the wrapper closes before slot ``k`` an element that the page leaves open."""
        return (mark not in shut and at[mark] is not None and at[k] is not None and at[mark] < at[k]
                and at[k] > wrapper.until.get((at[mark], symbols[mark]), -1))

    # inside an article, outside one, boilerplate; template text outside an article counts if there is nothing else
    parts: list[list[str]] = [[], [], [], []]
    for k, symbol in enumerate(symbols):
        if symbol == TEXT:
            names, marks = slots[k]
            if at is not None and not shut.issuperset(marks):
                marks = [mark for mark in marks if not closed(k, mark)]
            kind = place([_bare(symbols[mark]) if mark in whole else symbols[mark] for mark in marks])
            if at is not None and kind:
                opens = {at[mark] for mark in marks}
                if wrapper.article is not None and not marked:
                    kind = 2 if wrapper.article in opens else 1
                if kind == 2 and not wrapper.fixed.isdisjoint(opens):
                    kind = 0
                elif kind == 1 and (at[k], chain(names)) in wrapper.template:
                    kind = 3
            parts[kind].append(_html.unescape(texts[k]))
        elif symbol.lstrip("/").split(".", 1)[0] not in INLINE:
            for p in parts:
                p.append(" ")
    chosen = "".join(parts[2]).split() or "".join(parts[1]).split() or "".join(parts[3]).split()
    return " ".join(chosen)


def _dump(nodes) -> str:
    return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))


def _tuples(x):
    return tuple(_tuples(n) for n in x) if isinstance(x, list) else x


def load(text: str) -> list[tuple]:
    return [(_tuples(n), bool(o)) for n, o in json.loads(text)]


def _merged(parts: list[list[tuple]]) -> list[tuple]:
    """One wrapper from several; the largest first, so that the rest aligns with it."""
    out: list[tuple] = []
    for part in parts:
        if not out:
            out = part
            continue
        flags = {n for n, o in part if o}
        out = [(n, o or n in flags) for n, o in align(out, [n for n, _ in part])]
    return out


def host_of(url):
    """Host of a url column, lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def structures(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, page, structure, node, chain, text, size), one row for each different page of a host: its structure as
    JSON, and for each slot its node and chain, a hash of the texts and their characters."""
    def run(batches):
        for batch in batches:
            column = batch.column(1).fill_null("")
            for b in blocks(column):
                rows: list[list] = [[] for _ in range(6)]
                for page in column.slice(b.lo, b.rows).to_pylist():
                    symbols, texts = tokens(page)
                    nodes, sizes = fold(list(symbols), [1] * len(symbols))
                    found = fields(symbols, texts, sizes)
                    whole = ["\0".join(t) for t in found.values()]
                    for values, value in zip(rows, (
                            xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) - 2**63,
                            _dump([(n, False) for n in nodes]),
                            [n for n, _ in found], [c for _, c in found],
                            [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t in whole],
                            [len(t) for t in whole]), strict=True):
                        values.append(value)
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()),
                         pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.rows), *(pa.array(v, t) for v, t in zip(rows, kinds, strict=True))],
                    names=["host", "page", "structure", "node", "chain", "text", "size"])

    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(
        tidy(run), "host string, page long, structure string, node array<int>, chain array<string>, text array<long>, size array<long>")
    return read.dropDuplicates(["host", "page"])


def wrappers(seen: DataFrame) -> DataFrame:
    """(host, wrapper) with the wrapper as JSON, from (host, structure, n)."""
    def infer(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["n", "structure"], ascending=[False, True])
        wrapper = _merged([load(s) for s in ordered["structure"]])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "structure": [_dump(wrapper)], "n": [int(group["n"].sum())]})

    schema = "host string, structure string, n long"
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("structure"), F.lit(SALTS)))
    parts = salted.groupBy("host", "salt").applyInPandas(infer, schema)
    return parts.groupBy("host").applyInPandas(infer, schema).select("host", F.col("structure").alias("wrapper"))


def _within_broadcast(found: DataFrame, columns: list[str]):
    """host -> columns as a broadcast, or None if they are above ``BROADCAST_BYTES``."""
    size = found.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.length("host")))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return None
    return found.sparkSession.sparkContext.broadcast({r["host"]: tuple(r[c] for c in columns) for r in found.collect()})


def slots(read: DataFrame, seen: DataFrame, found: DataFrame) -> DataFrame:
    """(host, slots): for each slot of a host's wrapper, as JSON, what ``Wrapper`` asks for. The texts of all pages meet
    by wrapper slot: a structure is aligned with its wrapper once, and its slots' texts are counted under that."""
    sent = _within_broadcast(found, ["wrapper"])
    source = seen.select("host", "structure")
    if sent is None:
        source = source.join(found, "host")

    def run(batches):
        made: dict[str, Wrapper] = {}
        kept = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            hosts, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = [sent.value[h][0] for h in hosts] if sent is not None else batch.column(2).to_pylist()
            for host, text, wrapper in zip(hosts, texts, given, strict=True):
                if wrapper not in made:
                    if kept > KEPT_NODES:
                        made.clear()
                        kept = 0
                    made[wrapper] = Wrapper(load(wrapper))
                    kept += len(made[wrapper].nodes) + 500
                plain = [n for n, _ in load(text)]
                grouped, sizes = _as_group(plain, [1] * len(plain), made[wrapper].groups)
                to = [a for a, size in zip(made[wrapper].aligned(grouped), sizes, strict=True) for _ in range(size)]
                for i, under in opened(plain):
                    if to[i] is not None:
                        under = [to[u] for u in under if to[u] is not None and not isinstance(made[wrapper].nodes[to[u]], tuple)]
                        for values, value in zip(out, (host, text, i, to[i], under), strict=True):
                            values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())),
                                                strict=True)], names=["host", "structure", "node", "slot", "under"])

    places = source.mapInArrow(run, "host string, structure string, node int, slot int, under array<int>").withColumn(
        "structure", F.xxhash64("structure"))
    texts = read.select("host", F.xxhash64("structure").alias("structure"),
                        F.explode(F.arrays_zip("node", "chain", "text", "size")).alias("s")).select("host", "structure", "s.*")
    texts = texts.groupBy("host", "structure", "node", "chain", "text").agg(F.count(F.lit(1)).alias("c"), F.max("size").alias("size"))
    met = texts.join(places, ["host", "structure", "node"]).groupBy("host", "slot", "chain", "text").agg(
        F.sum("c").alias("c"), F.max("size").alias("size"), F.max(F.struct("c", "under")).alias("under"))
    met = met.groupBy("host", "slot", "chain").agg(
        F.sum("c").alias("pages"), F.max("c").alias("top"), F.sum(F.col("c") * F.col("size")).alias("size"),
        F.max("under")["under"].alias("under"))
    return met.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.struct(
        "slot", "chain", "under", "pages", "top", "size")))).alias("slots"))


def load_slots(text: str | None) -> list[tuple]:
    return [(s["slot"], s["chain"], s["under"], s["pages"], s["top"], s["size"]) for s in json.loads(text or "[]")]


def inferred(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, wrapper, slots) from all pages, as JSON."""
    read = written(structures(pages, url_col, html_col), "structures")
    seen = read.groupBy("host", "structure").agg(F.count(F.lit(1)).alias("n"))
    found = written(wrappers(seen), "wrappers")
    return written(found.join(slots(read, seen, found), "host", "left"), "slots")


def extract(pages: DataFrame, keys: list[str], url_col: str, html_col: str) -> DataFrame:
    """The key columns and ``text`` (the main text) of every page."""
    found = inferred(pages, url_col, html_col)
    source = pages.select(*keys, F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    sent = _within_broadcast(found, ["wrapper", "slots"])
    if sent is None:
        found = found.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"), F.col("slots").alias("_slots"))
        source = source.join(found, "_host", "left").select(*keys, "_html", "_host", "_wrapper", "_slots")
    n = len(keys)

    def run(batches):
        made: dict[tuple, Wrapper] = {}
        kept = 0
        for batch in batches:
            column = batch.column(n).fill_null("")
            for b in blocks(column):
                hosts = batch.column(n + 1).slice(b.lo, b.rows).to_pylist()
                given = None if sent is not None else list(zip(*(
                    batch.column(n + i).slice(b.lo, b.rows).to_pylist() for i in (2, 3)), strict=True))
                out = []
                for k, page in enumerate(column.slice(b.lo, b.rows).to_pylist()):
                    learned = sent.value.get(hosts[k], (None, None)) if sent is not None else given[k]
                    if learned[0] is not None and learned not in made:
                        if kept > KEPT_NODES:
                            made.clear()
                            kept = 0
                        made[learned] = Wrapper(load(learned[0]), load_slots(learned[1]))
                        kept += len(made[learned].nodes) + 500
                    out.append(main_text(page, made.get(learned)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(b.lo, b.rows) for i in range(n)), pa.array(out, pa.string())],
                    names=[*keys, "text"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)
    return source.mapInArrow(tidy(run), f"{types}, text string")
