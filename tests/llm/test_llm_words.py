import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from softlab.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAb1 \n\té日.-\x1c ", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_words_and_windows_match_a_regular_expression(texts):
    buf, offsets = W.text_buffer(pa.array(texts, pa.string()))
    for table, pattern, lower in ((W.NOT_BLANK, r"[^\x20\x09-\x0D]+", False),
                                  (W.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        words = W.Words(buf, offsets, table, lower=lower)
        got = [[words.buf[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
               for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        cut = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else (t or "") for t in texts]
        want = [re.findall(pattern, t) for t in cut]
        assert got == want
        flat = [w for row in want for w in row]
        assert len(set(words.hash.tolist())) == len(set(flat))
        at, h = words.windows(3)
        seen = [tuple(row[i:i + 3]) for row in want for i in range(len(row) - 2)]
        assert len(at) == len(seen) and len(set(h.tolist())) == len(set(seen))


def test_hash_does_not_depend_on_place_or_block():
    text = "word " * 50_000 + "end"
    words = W.Words(*W.text_buffer(pa.array([text, "word end"])), W.NOT_BLANK)
    assert len(set(words.hash.tolist())) == 2


def test_packed_numbers_come_back():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 999, dtype=np.uint64))
    assert (W.unpack(W.pack(x), np.uint64) == x).all()
    assert len(W.unpack(W.pack(x[:0]), np.uint64)) == 0
    assert W.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_slices_cover_every_row_once():
    table = pa.RecordBatch.from_pydict({"text": pa.array(["x" * 10, None, "", "y" * 100, "z"]), "i": pa.array(range(5))})
    got = [p.column("i").to_pylist() for p in W.slices(table, "text", 20)]
    assert sum(got, []) == [0, 1, 2, 3, 4] and len(got) > 1
