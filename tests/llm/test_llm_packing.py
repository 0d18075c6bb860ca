import base64
import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from llm_cases import EDGE, docs

from softlab.llm import packing

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def plain_best_fit(sizes, length):
    """Remaining capacities by a linear search for the best fit."""
    room = []
    rest = []
    for s in sizes:
        room += [0] * (s // length)
        if s % length:
            rest.append(s % length)
    for n in sorted(rest, reverse=True):
        fits = [(c, k) for k, c in enumerate(room) if c >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(length - n)
    return sorted(room)


def test_segment_tree_packs_like_a_linear_search():
    rng = random.Random(7)
    for length in (2, 7, 64, 100):
        for _ in range(40):
            sizes = [rng.randrange(0, 3 * length) for _ in range(rng.randrange(60))]
            rows, segments = packing.pack(np.array(sizes, np.int64), length)
            assert sorted(length - sum(s[2] for s in r) for r in rows) == plain_best_fit(sizes, length)
            covered = defaultdict(list)
            for r in rows:
                for d, start, n in r:
                    covered[d].append((start, n))
            assert segments == sum(map(len, rows))
            for d, s in enumerate(sizes):
                at = 0
                for start, n in sorted(covered[d]):
                    assert start == at and n > 0
                    at += n
                assert at == s


def test_rows_give_the_documents_back(spark):
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for length in (64, 2048):
        got = defaultdict(list)
        for r in packing.packed_rows(docs(spark, EDGE), PATH, length=length).collect():
            ids, positions = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2")
            assert len(ids) == len(positions) == length and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_ids"]
            assert (ids[r["n_ids"]:] == 50256).all()
            for k, s in enumerate(r["segments"]):
                a, b = r["cu_seqlens"][k], r["cu_seqlens"][k + 1]
                assert positions[a:b].tolist() == list(range(s["n"])) and s["part"] == s["start"] // length
                got[s["doc_id"]].append((s["start"], ids[a:b].tolist()))
        want = defaultdict(list)
        for i, t in EDGE:
            want[i].append(exact.encode_ordinary(t or "") + [50256])
        for i, texts in want.items():
            joined = [x for _, part in sorted(got[i]) for x in part]
            assert sorted(joined) == sorted(x for t in texts for x in t)
            if len(texts) == 1:
                assert joined == texts[0]
    assert packing.packed_rows(docs(spark, []), PATH).count() == 0
