"""Plain Python versions that the operators are held against."""

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that every text operator has to take: nulls, empty and blank texts, ties, repeated rows.
ODD_ROWS = [
    (None, "alpha beta gamma delta"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"),
    (5, "Uno dos tres CUATRO"), (6, "naïve façade \U0001f600 ends"), (None, None), (7, "x " * 3000),
]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


def odd_docs(spark):
    """``ODD_ROWS`` with further columns whose names operators use inside."""
    rows = [(i, t, "en", "src", len(t or ""), 1, "z", 0) for i, t in ODD_ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, id string, row_0 long")


def groups(pairs, members):
    """member -> smallest member reachable over ``pairs``."""
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for m in sorted(members):
        if m in out:
            continue
        todo = [m]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = m
                todo += near[x]
    return out
