"""Edited, short and unspaced benchmark items: what share of the leaks that the verifier accepts is found."""

import numpy as np
import pyarrow as pa
import pytest

from lithos.llm import decontam, embeddings
from lithos.llm.text import blocks


def found(items, docs, least=8):
    b = decontam.Benchmark(list(range(len(items))), items, least)
    out = set()
    for part in blocks(pa.array(docs, pa.string())):
        h, first = decontam.symbols(part.raw, part.offsets)
        out |= {(row + part.lo, item) for row, item, *_ in decontam.matches(b, h, first, 0.8)}
    return out


def edited(words, n_edits, rng, kinds):
    """``n_edits`` words of the item replaced, inserted or left out, at places of their own."""
    words = list(words)
    for at in sorted(rng.choice(len(words), n_edits, replace=False).tolist(), reverse=True):
        kind = rng.choice(kinds)
        fresh = f"new{rng.integers(1 << 40)}"
        if kind == "replace":
            words[at] = fresh
        elif kind == "insert":
            words.insert(at, fresh)
        else:
            del words[at]
    return words


@pytest.mark.parametrize("kinds", [("replace",), ("replace", "insert", "delete")])
@pytest.mark.parametrize("n", [8, 9, 10, 11, 12, 15, 16, 20, 23, 24, 32, 48, 60])
def test_recall_by_size(n, kinds):
    rng = np.random.default_rng([n, len(kinds)])
    word = lambda: f"w{int(rng.zipf(1.3)) % 20_000}"
    items = [[word() for _ in range(n)] for _ in range(300)]
    docs = [" ".join([*(word() for _ in range(40)), *edited(x, n // 5, rng, kinds), *(word() for _ in range(40))]) for x in items]
    got = found([" ".join(x) for x in items], docs)
    share = np.mean([(i, i) in got for i in range(len(items))])
    assert share >= (1.0 if n < decontam.FEW else 0.9)


def test_items_that_share_words_are_no_leaks():
    rng = np.random.default_rng(5)
    items = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(8, 24))) for _ in range(200)]
    docs = [" ".join(f"w{x}" for x in rng.integers(0, 60, 300)) for _ in range(60)]
    plain = set()
    for j, item in enumerate(items):
        ih, _ = decontam.symbols(*_raw(item))
        for i, doc in enumerate(docs):
            dh, _ = decontam.symbols(*_raw(doc))
            if decontam.best_stretch(ih, dh)[0] <= len(ih) // 5:
                plain.add((i, j))
    assert found(items, docs) == plain


def _raw(text):
    part = next(blocks(pa.array([text])))
    return part.raw, part.offsets


def test_short_items_match_verbatim():
    items = ["Who wrote it?", "one", "", "?!", "a b c d e f g", "who wrote"]
    docs = ["and then: WHO wrote, it was asked", "who wrote it", "None one none", "a b c d X f g", "x a, b. c d e f g y", "one"]
    assert found(items, docs) == {(0, 0), (0, 5), (1, 0), (1, 5), (2, 1), (4, 4), (5, 1)}


def test_texts_without_spaces():
    chinese = "机器学习是人工智能的一个分支它研究计算机怎样模拟人类的学习行为"
    thai = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์"
    docs = [f"前言。{chinese}。后记", chinese.replace("分支", "部分"), f"abc{thai}xyz", "机器学习很有意思,计算机也是", "ภาษาไทย"]
    assert found([chinese, thai], docs) == {(0, 0), (1, 0), (2, 1)}


def test_symbols_of_mixed_scripts():
    raw, offsets = _raw("abc中文def ghi,𠀀x ไทย Ж é")
    h, first = decontam.symbols(raw, offsets)
    plain = ["abc", "中", "文", "def", "ghi", "𠀀", "x", "ไ", "ท", "ย", "ж", "é"]
    alone = [decontam.symbols(*_raw(w))[0][0] for w in plain]
    assert len(h) == len(plain) and [int(x) for x in h[:10]] == [int(x) for x in alone[:10]] and first.tolist() == [0, len(plain)]


@pytest.mark.parametrize("size", [1e160, 1e-170, 1.0, 5e-324 * 2**40])
def test_cosine_of_extreme_vectors(size):
    v = np.array([[3.0, 4.0, 0.0], [0.0, 0.0, 1.0]]) * size
    rotation = np.eye(3)
    a = embeddings._unit(v) @ rotation
    i, j = embeddings.compare(a, a, v, v * 1.0, 0.95)
    assert {(int(x), int(y)) for x, y in zip(i, j)} == {(0, 0), (1, 1)}
