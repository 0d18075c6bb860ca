import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from llm_cases import EDGE, docs

from softlab.llm import bpe
from softlab.llm import words as W

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return bpe.ByteBpe(f.read())


@pytest.fixture(scope="module")
def exact():
    with open(PATH, "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def check(coder, exact, texts):
    buf, offsets = W.text_buffer(pa.array(texts, pa.string()))
    ids, rows = coder.encode(buf, offsets)
    assert coder.decode(ids).tobytes() == buf.tobytes()
    for i, t in enumerate(texts):
        assert ids[rows[i]:rows[i + 1]].tolist() == exact.encode_ordinary(t or ""), repr(t)[:80]


def test_equal_to_the_rank_file_library(coder, exact):
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "é", "ß", " ", "'s", "'", "!", "aaa", "----", "日本", "1", "\t", "\u0085", "🙂", "the",
             " ", "　", "\x1c", " ", "Ä", " x"]
    check(coder, exact, ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(4000)])
    check(coder, exact, [t for _, t in EDGE])


def test_every_code_point_between_words(coder, exact):
    points = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    check(coder, exact, [f"a{c}b 1{c} 2 {c} x{c}{c} y" for c in points])


def test_rows_offsets_and_split_characters(spark, coder):
    got = bpe.encode(docs(spark, EDGE), PATH, decode=True, offsets=True).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["ids"] == b"" and by[1]["ids"] == b""
    text = dict(EDGE)[7]
    assert by[7]["decoded"].decode() == text
    ids = np.frombuffer(by[7]["ids"], "<u4")
    for t, s, e in zip(ids, by[7]["starts"], by[7]["ends"], strict=True):
        piece = coder.decode(np.array([t])).tobytes()
        assert piece in text[s:e].encode()
    assert "�" in coder.decode_text(ids[[k for k in range(len(ids)) if len(coder.decode_text(ids[k:k + 1])) and
                                              "�" in coder.decode_text(ids[k:k + 1])][:1]])
    back = bpe.decode(bpe.encode(docs(spark, EDGE), PATH), PATH).collect()
    assert {r["doc_id"]: r["decoded_text"] for r in back}[4] == dict(EDGE)[4]
    assert bpe.encode(docs(spark, []), PATH).count() == 0
