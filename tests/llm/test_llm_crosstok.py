import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
from llm_cases import EDGE, docs

from softlab.llm import crosstok as C
from softlab.llm.bpe import byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["<|endoftext|> is <s> text </s> here", " two  spaces   three ", "tab\tand\nline", "U+2581 ▁ in it", "Ünïcödé 日本語 🙂🙂",
         "\x00 nul", "a", " ", "  ", " nbsp  ", "ﬁ ligature", "x" * 3000, "it's we'll don't", "1234567890 12 3", "é é", "<0x41> <unk>",
         "The quick brown fox jumps over the lazy dog. The quick brown fox."]


@pytest.fixture(scope="module")
def sides():
    with open(A, "rb") as f, open(B, "rb") as g:
        return C.ByteLevel(f.read()), C.Pieces(g.read())


@pytest.fixture(scope="module")
def plain_sides():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=B)


def tokens(plain_sides, text):
    """[(id, bytes)] of both sides, or two empty lists."""
    t, s = plain_sides
    if not text:
        return [], []
    back = {c: b for b, c in enumerate(byte_alphabet())}
    a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in s.encode(text):
        p = s.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def ends(side):
    out, n = [], 0
    for _, x in side:
        out.append(n := n + len(x))
    return out


def plain(plain_sides, rows):
    of, pair_n = [], Counter()
    for i, text in rows:
        a, b = tokens(plain_sides, text)
        ea, eb = ends(a), {e: y for y, e in enumerate(ends(b))}
        cuts = [(x, eb[e]) for x, e in enumerate(ea) if e in eb]
        links = [(a[x][0], b[y][0]) for x, y in cuts]
        groups = []
        for (ax, by), (x, y) in zip([(-1, -1), *cuts], cuts, strict=False):
            groups.append(",".join(str(t) for t, _ in a[ax + 1:x + 1]) + "|" + ",".join(str(t) for t, _ in b[by + 1:y + 1]))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        pair_n.update(links)
        of.append((i, len(a), len(b), len(cuts), links, digest))
    best = {}
    for (x, y), n in pair_n.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, na, nb, ng, len(links), sum(pair_n[p] == best[p[1]] for p in links), sum(pair_n[p] for p in links), d)
                   for i, na, nb, ng, links, d in of), key=str)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    parts = ["the", " ", " ", " ", "  ", "\n", "é", "ß", "tokens", "ization", "日本", "🙂", "'s", "12", "!", "-", " ", "ing", "\u0085", "Ä"]
    return [(i, "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(n)]


def test_tokens_of_segments_are_those_of_whole_texts(sides, plain_sides):
    texts = TEXTS + [t for _, t in corpus(1500)]
    got = C.Aligned(*sides, pa.array(texts))
    kept = dict(zip(got.rows.tolist(), range(len(got.rows)), strict=True))
    for i, text in enumerate(texts):
        a, b = tokens(plain_sides, text)
        assert bool(a) == (i in kept), text
        if a:
            k = kept[i]
            assert got.a[got.a_row[k]:got.a_row[k + 1]].tolist() == [t for t, _ in a], text
            assert got.b[got.b_row[k]:got.b_row[k + 1]].tolist() == [t for t, _ in b], text
    assert "U+2581 ▁ in it" not in {texts[i] for i in kept}


def test_counts_by_brute_force(spark, plain_sides):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(TEXTS)] + EDGE[:4] + EDGE[6:]
    got = C.link_counts(docs(spark, rows).repartition(5), A, B).collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == plain(plain_sides, rows)


def test_overlaps_and_groups(spark, plain_sides):
    rows = [(100 + i, t) for i, t in corpus(40)] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + EDGE[:4] + EDGE[6:]
    for r in C.align(docs(spark, rows), A, B).collect():
        text = next(t for i, t in rows if i == r["doc_id"])
        a, b = tokens(plain_sides, text)
        assert r["a_ids"] == [t for t, _ in a] and r["b_ids"] == [t for t, _ in b]
        assert r["a_ends"] == ends(a) and r["b_ends"] == ends(b)
        if len(a) > 400:
            continue
        ea, eb = [0, *ends(a)], [0, *ends(b)]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(ea[x], eb[y]) < min(ea[x + 1], eb[y + 1])]
        assert [(p["a"], p["b"]) for p in r["overlaps"]] == want
        cuts = sorted(set(ends(a)) & set(ends(b)))
        assert r["a_groups"] == [sum(c < e for c in cuts) for e in ends(a)]
        assert r["b_groups"] == [sum(c < e for c in cuts) for e in ends(b)]


def test_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "some text"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_a"] for r in C.link_counts(df, A, B).collect()} == {"x": 2, None: 0}
    assert C.link_counts(docs(spark, []), A, B).count() == 0
    assert C.align(docs(spark, []), A, B).count() == 0


class Sent:
    def __init__(self, path):
        with open(path, "rb") as f:
            self.value = f.read()


def made(texts, rows_of_a_batch):
    """Rows of the chunks of ``texts``, which come in batches."""
    batches = (pa.RecordBatch.from_pydict({"_id": pa.array(range(i, min(i + rows_of_a_batch, len(texts))), pa.int64()),
                                           "_text": pa.array(texts[i:i + rows_of_a_batch], pa.string())}) for i in range(0, len(texts), rows_of_a_batch))
    return [r for b in C._chunks(Sent(A), Sent(B), pa.int64())(batches) for r in b.to_pylist()]


def test_texts_of_a_chunk_are_aligned_in_pieces(monkeypatch):
    seen, real = [], C.Aligned

    def aligned(one, two, text):
        seen.append(sum(len(x) for x in text.to_pylist()))
        return real(one, two, text)

    monkeypatch.setattr(C, "Aligned", aligned)
    text = "the quick brown fox jumps over the lazy dog " * 50
    chunks = made([f"{i} {text}" for i in range(1200)], 10_000)
    assert len(chunks) <= 4                                     # of 1 MB each, as pairs are counted by chunk
    assert sum(seen) > 2_600_000 and max(seen) <= 1 << 18       # while a worker's arrays are those of less text
    for c in chunks:                                            # and a row isn't as long as its links
        assert len(c["places"]) < sum(c["links"])


def test_chunks_cross_pieces_and_batches(monkeypatch, plain_sides):
    monkeypatch.setattr(C, "PIECE", 100)
    monkeypatch.setattr(C, "TEXT_SLICE", 700)
    texts = [t for _, t in corpus(120)] + [None, ""] + TEXTS
    chunks = made(texts, 7)
    assert [i for c in chunks for i in c["ids"]] == list(range(len(texts)))
    assert 5 < len(chunks) < len(texts) / 7
    for c in chunks:
        place = C.W.unplanes(C.zlib.decompress(c["places"]), "int32").cumsum()
        at, total = 0, Counter()
        for i, n in zip(c["ids"], c["links"], strict=True):
            a, b = tokens(plain_sides, texts[i])
            eb = {e: y for y, e in enumerate(ends(b))}
            want = sorted((b[eb[e]][0] << 32) | a[x][0] for x, e in enumerate(ends(a)) if e in eb)
            assert [c["pairs"][p] for p in place[at:at + n]] == want
            at += n
            total.update(want)
        assert dict(zip(c["pairs"], c["counts"], strict=True)) == total


def test_chunks_of_short_rows_are_bounded_by_rows():
    assert max(len(c["ids"]) for c in made([None] * 12_000 + ["a"] * 13_000, 500)) <= 10_500


def test_known_tokens_are_bounded(monkeypatch):
    """Texts without spaces are segments as they are: 2^18 of them have any number of tokens."""
    monkeypatch.setattr(C, "KNOWN_TOKENS", 5_000)
    rng = random.Random(9)
    with open(A, "rb") as f, open(B, "rb") as g:
        sides = C.ByteLevel(f.read()), C.Pieces(g.read())
    for _ in range(8):
        texts = ["".join(rng.choices("日本語中文字あいうえお", k=400)) for _ in range(5)]
        got = C.Aligned(*sides, pa.array(texts))
        for side, ids in zip(sides, (got.a, got.b), strict=True):
            assert len(side.tokens) <= 5_000 + len(ids)
    assert all(len(side.known) < 40 for side in sides)


def test_batches_of_texts_are_cut_by_bytes_meanwhile(spark, monkeypatch):
    key, during, real = "spark.sql.execution.arrow.maxBytesPerBatch", {}, C.shared_table

    def shared(df, name):
        during[name] = spark.conf.get(key, None)
        return real(df, name)

    monkeypatch.setattr(C, "shared_table", shared)
    before = spark.conf.get(key, None)
    C.link_counts(docs(spark, [(1, "some text")]), A, B)
    assert int(during["crosstok-chunks"]) <= 8 << 20
    assert spark.conf.get(key, None) == during["crosstok-pairs"] == before
