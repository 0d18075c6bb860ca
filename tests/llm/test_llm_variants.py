import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGE, docs

from softlab.llm import variants as V

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def plain_words(rows, least=7):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(V.UPPER, V.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= least}


def edits(w):
    for i in range(len(w) + 1):
        for c in LETTERS:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1:]
        if i < len(w):
            yield w[:i] + w[i + 1:]


def plain(rows):
    n = plain_words(rows)
    form, out = {}, {}
    for w in n:
        near = {x for x in edits(w) if x != w and x in n}
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(near)
    result = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        result[w] = (n[w], out[w], form[w], root, n[form[w]] if form[w] else None)
    return result


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["root"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def spelled(seed=3, n=60):
    """Texts of a few frequent stems and many slips of them, of all kinds, at all places."""
    rng = np.random.default_rng(seed)
    stems = ["abcdefg", "abcdefgh", "abxdefg", "zzzzzzz", "zzzzzzzz", "überallße", "anderung", "änderung", "conversation"]
    weight = np.array([400, 30, 3, 50, 4, 200, 200, 200, 3000])
    words = [w for w, k in zip(stems, weight, strict=True) for _ in range(k)]
    for w in stems:
        for _ in range(40):
            x, i, c = w, rng.integers(len(w)), LETTERS[rng.integers(8)]
            kind = rng.integers(4)
            x = x[:i] + x[i + 1:] if kind == 0 else x[:i] + c + x[i:] if kind == 1 else x[:i] + c + x[i + 1:] if kind == 2 else x[:i] + c + x[i:] + c
            words += [x] * int(rng.integers(1, 4))
    rng.shuffle(words)
    texts = np.array_split(np.array(words), n)
    return [(i, " ".join(t).title() if i % 3 == 0 else "-".join(t)) for i, t in enumerate(texts)]


def test_as_by_brute_force(spark):
    rows = spelled() + EDGE
    assert got(V.variants(docs(spark, rows))) == plain(rows)


@pytest.mark.parametrize("within", [True, False])
def test_tiles_of_a_large_block(monkeypatch, within):
    monkeypatch.setattr(V, "SMALL", 16)
    monkeypatch.setattr(V, "TILE", 16)
    n = plain_words(spelled(7))
    words = sorted(w for w in n if len(w) in (7, 8) and not w.startswith("z"))
    part = [0 if within else i % 2 for i in range(len(words))]
    table = pa.table({"m": [7] * len(words), "block": ["7<"] * len(words), "word": words, "n": [n[w] for w in words],
                      "part": part, "a": [0] * len(words), "b": [0 if within else 1] * len(words)})
    found = {r["word"]: (r["n_near"], r["near"]) for r in V._compare(table).to_pylist()}
    for k, w in enumerate(words):
        near = {x for x in edits(w) if x != w and x in words and min(len(x), len(w)) == 7}
        near = {x for x in near if within or part[words.index(x)] != part[k]}
        assert found.get(w, (0, None)) == (len(near), min(near, key=lambda x: (-n[x], x), default=None))


@pytest.mark.parametrize("part", [2, 50])
def test_blocks_in_parts_lose_nothing(spark, part):
    rows = spelled(5)
    words = V.count_words(docs(spark, rows))
    assert got(V.variant_forms(words, part=part)) == plain(rows)


def test_one_block_holds_most_words(spark):
    # one beginning for all, so that the blocks of beginnings are large
    rng = np.random.default_rng(1)
    words = {"commonbegin" + "".join(LETTERS[k] for k in rng.integers(0, 3, 5)) for _ in range(200)}
    rows = [(i, f"{w} {w} " * (20 if i % 9 == 0 else 1)) for i, w in enumerate(sorted(words))]
    assert got(V.variant_forms(V.count_words(docs(spark, rows)), part=40)) == plain(rows)


def test_very_long_words(spark):
    w = "ab" * 3000
    rows = [(1, " ".join([w] * 20)), (2, " ".join([w[:4000] + "x" + w[4000:]] * 2)), (3, " ".join([w[:9] + "y" + w[10:]] * 2)),
            (4, " ".join([w[::-1]] * 2))]
    assert got(V.variants(docs(spark, rows))) == plain(rows)


def test_chains_of_forms(spark):
    rows = [(None, " ".join(["abcdefgh"] * 2000)), (None, " ".join(["abcdefgx"] * 150)), (None, " ".join(["abcdefyx"] * 12)),
            (None, "abcdezyx " * 2), (1, None), (1, None)]
    assert got(V.variants(docs(spark, rows))) == plain(rows)


def test_empty_table(spark):
    assert V.variants(docs(spark, [])).count() == 0
    assert V.variants(docs(spark, [(1, None), (2, ""), (3, "a b c short")])).count() == 0
