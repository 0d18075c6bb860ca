"""Blocks of a family return links that connect, not all pairs."""

import pyarrow as pa

from softlab.llm.minhash import _compare


def test_links_of_many_copies_are_a_star():
    text = " ".join(f"w{i}" for i in range(400))
    n = 60
    table = pa.table({"rep": list(range(n)), "c": list(range(n)), "g": [0] * n, "text": [f"{text} z{i}" for i in range(n)]})
    out = _compare(4, 80)(table).to_pydict()
    assert len(out["u"]) == n - 1 and set(out["v"]) == {0} and sorted(out["u"]) == list(range(1, n))
    alone = pa.table({"rep": [0, 1], "c": [0, 1], "g": [0, 0], "text": ["a b c d e", "f g h i j"]})
    assert _compare(4, 80)(alone).num_rows == 0
