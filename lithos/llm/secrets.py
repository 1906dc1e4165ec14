"""Secret scan through a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: a conjunction or
disjunction of trigrams that every match must hold. Each block of documents gets an inverted index
(trigram -> ascending row numbers) over the trigrams the rules ask for; postings are intersected and
united as the query says, and only the rows that remain are verified with the regular expression. A
rule without mandatory trigrams scans every row. The index folds A-Z to a-z, so it serves rules in
either case; folding only ever adds candidates, which the verification removes.

Defined results: null text counts as empty (no spans); offsets are code points, end exclusive; rows
that repeat each get their own result; ties of start are ordered by the rules' order; other columns
are ignored; an empty table gives an empty result. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as op, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithos.llm.text import blocks, lowered, tidy

#: Strings that one part of a rule may stand for, while they are enumerated exactly.
MAX_EXACT = 64
_LOW = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlap; a match counts if group ``group`` has ``least``
    characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: What may stand between the lines of a key: white space, also escaped, and marks of quoting, comments or diffs.
_BREAK = r"""(?:\\[nrt]|[\s>#*|"',;\\]|\+(?=\s)|-(?!-))"""
#: A private key from its header up to its END line; where there is none (a cut text), over the header fields and
#: the base64 lines that follow, the last of which may be short. Possessive, so that no text takes quadratic time.
PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-{5,}END [A-Z ]*PRIVATE KEY-----"
       rf"|(?:{_BREAK}++[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+(?:{_BREAK}++[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
       rf"(?:{_BREAK}++[A-Za-z0-9+/]++={{0,2}}(?=[ \t\"',;]*+(?:[\r\n\\]|\Z)))?|)")

#: The three base rules of the contract, then the rules that this method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Rule("pem", PEM, 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 20),
)


# Boolean queries: True (no condition), an int (a trigram), ("and", ...) or ("or", ...).
def _join(kind: str, parts) -> object:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif True in parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, *parts)


def _of_strings(strings) -> object:
    """Condition that a text holds one of ``strings``."""
    def one(s):
        b = s.translate(_LOW).encode()
        return _join("and", [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)])
    return _join("or", [one(s) for s in sorted(strings)])


def _walk(items):
    """(exact, query) of a parsed sequence: ``exact`` holds all strings it matches, or None."""
    exact, queries = {""}, []

    def flush():
        nonlocal exact
        queries.append(_of_strings(exact))
        exact = {""}

    whole = True
    for kind, arg in items:
        part, condition = None, True
        if kind is op.LITERAL:
            part = {chr(arg)}
        elif kind is op.IN:
            part = _class(arg)
        elif kind is op.SUBPATTERN:
            part, condition = _walk(arg[-1])
        elif kind is op.BRANCH:
            branches = [_walk(x) for x in arg[1]]
            if all(e is not None for e, _ in branches):
                part = set().union(*(e for e, _ in branches))
            else:
                condition = _join("or", [_of_strings(e) if e is not None else q for e, q in branches])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = arg
            e, q = _walk(inner)
            if e is not None and most == 1:
                part = e | {""} if least == 0 else e
            elif least:
                condition = _of_strings(e) if e is not None else q
                if e is not None and len(e) ** min(least, 3) <= MAX_EXACT:
                    strings = {""}
                    for _ in range(min(least, 8)):
                        strings = {a + b for a in strings for b in e}
                        if len(strings) > MAX_EXACT:
                            break
                    else:
                        condition = _of_strings(strings)
        elif kind is op.AT:
            part = {""}
        if part is not None and len(part) * len(exact) <= MAX_EXACT:
            exact = {a + b for a in exact for b in part}
            continue
        whole = False
        flush()
        if part is not None and len(part) <= MAX_EXACT:
            exact = part
        else:
            queries.append(condition)
    if whole:
        return exact, True
    flush()
    return None, _join("and", queries)


def _class(items):
    """Characters of a small class; None for a large or negated one."""
    out = set()
    for kind, arg in items:
        if kind is op.LITERAL:
            out.add(chr(arg))
        elif kind is op.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every match of ``pattern`` fulfils; True if there is none."""
    exact, query = _walk(_parser.parse(pattern, re.ASCII))
    return _of_strings(exact) if exact is not None else query


def _leaves(query) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(_leaves, query[1:]))


class Index:
    """Postings of one block of documents for the trigrams in ``wanted``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        low = lowered(raw).astype(np.int32)
        self.rows = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(low) < 3:
            return
        code = (low[:-2] << 16) + (low[1:-1] << 8) + low[2:]
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        if not inside.any():
            return
        pair = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        terms, begin = np.unique(pair >> 32, return_index=True)
        for term, rows in zip(terms.tolist(), np.split(pair & 0xFFFFFFFF, begin[1:]), strict=True):
            self.postings[term] = rows

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, int):
            return self.postings.get(query, np.zeros(0, np.int64))
        parts = [self.candidates(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def spans_of(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Spans of the rule's matches that are long enough."""
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def _find(b, texts: list[str], rules, queries, compiled, wanted) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) of all spans of each row of a block, ascending."""
    index = Index(b.raw, b.offsets, wanted)
    found: list[list] = [[] for _ in texts]
    for k, query in enumerate(queries):
        for row in index.candidates(query).tolist():
            found[row] += [(s, k, e) for s, e in spans_of(texts[row], rules[k], compiled[k])]
    for hits in found:
        hits.sort()
    return found


def _prepared(rules, queries) -> tuple[list[re.Pattern], np.ndarray]:
    wanted = np.zeros(1 << 24, bool)
    wanted[list(set().union(*map(_leaves, queries)))] = True
    return [re.compile(r.pattern, re.ASCII) for r in rules], wanted


def redact(docs: DataFrame, text_col: str, count_col: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, all columns, with every secret in ``text_col`` replaced by ``[kind]`` (spans that overlap
    count as one, of the first one's kind). ``count_col``, if given, gets the new number of code points
    where a text has changed."""
    queries = [trigram_query(r.pattern) for r in rules]
    at = docs.columns.index(text_col)
    count_at = docs.columns.index(count_col) if count_col else None

    def clean(text: str, hits) -> str:
        out, end = [], 0
        for s, k, e in hits:
            if s >= end:
                out += [text[end:s], "[", rules[k].kind, "]"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(batches):
        compiled, wanted = _prepared(rules, queries)
        for batch in batches:
            column = batch.column(at)
            for b in blocks(column):
                part = batch.slice(b.lo, b.rows)
                texts = part.column(at).to_pylist()
                found = _find(b, [t or "" for t in texts], rules, queries, compiled, wanted)
                changed = [i for i, hits in enumerate(found) if hits]
                if changed:
                    counts = part.column(count_at).to_pylist() if count_col else []
                    for i in changed:
                        texts[i] = clean(texts[i], found[i])
                        if count_col:
                            counts[i] = len(texts[i])
                    part = part.set_column(at, batch.schema.field(at), pa.array(texts, column.type))
                    if count_col:
                        part = part.set_column(count_at, batch.schema.field(count_at),
                                               pa.array(counts, batch.column(count_at).type))
                yield part

    return docs.mapInArrow(tidy(run), docs.schema)


def scan(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id_col, n_<kind> for each base rule, base_sha256, spans, n_spans): see the module's text.

    ``spans`` lists all spans as kind:start:end by start, then rule order, comma-joined; base_sha256 is
    the lowercase hex SHA-256 of the same list of the base rules' spans alone."""
    queries = [trigram_query(r.pattern) for r in rules]
    base = [k for k, r in enumerate(rules) if r.base]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        compiled, wanted = _prepared(rules, queries)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for b in blocks(column):
                texts = column.slice(b.lo, b.rows).to_pylist()
                found = _find(b, texts, rules, queries, compiled, wanted)
                counts = np.zeros((len(base), len(texts)), np.int64)
                digest, listed, total = [], [], []
                for row, hits in enumerate(found):
                    told = [f"{rules[k].kind}:{s}:{e}" for s, k, e in hits]
                    for j, k in enumerate(base):
                        counts[j, row] = sum(x[1] == k for x in hits)
                    basic = ",".join(t for t, x in zip(told, hits, strict=True) if rules[x[1]].base)
                    digest.append(hashlib.sha256(basic.encode()).hexdigest())
                    listed.append(",".join(told))
                    total.append(len(told))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.rows), *map(pa.array, counts), pa.array(digest, pa.string()),
                     pa.array(listed, pa.string()), pa.array(total, pa.int64())],
                    names=[id_col, *(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans", "n_spans"])

    told = "".join(f"n_{rules[k].kind} long, " for k in base)
    return docs.select(id_col, text_col).mapInArrow(
        tidy(run), f"`{id_col}` {kind}, {told}base_sha256 string, spans string, n_spans long")
