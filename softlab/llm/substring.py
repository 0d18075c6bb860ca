"""Substring dedup with fixed-block anchors.

A window is ``n`` consecutive words of one document.  A word is removed when a
window that covers it also starts earlier in the corpus (smaller id, or the
same document and an earlier start), judged on the input.

1. *Index and probe.*  Every document is cut into non-overlapping reference
   blocks of ``n // 2`` words.  Any window holds a whole block, so of two equal
   windows each meets a block of the other at some rolling position.  Every
   rolling position probes the index; a hit is a block equal to it elsewhere.
2. *Extend.*  Only windows round a hit can repeat.  Their hashes are compared
   over the corpus, and the first start of each is found.  Runs of windows
   that start earlier elsewhere are the maximal exact repeats; their words go.

The work is dealt over chunks (documents by hash of id) and buckets (by hash
of the words).  A chunk sends each bucket one packet: the sorted distinct
hashes it has there.  The bucket answers with a few bits per entry, in the
packet's order.  So a passage that a million documents share is one entry per
chunk, in no list of documents; no pairs are made; and what is shuffled is
about 2 bytes per word for probes, and 12 per window round a hit.  Probes
carry 32 bits beside the bucket, as a false hit costs a comparison only; windows
are compared by 64-bit hashes.  The chunks' texts are
shuffled once and read by all three steps.

Chunks and buckets grow with the text (``CHUNK_BYTES``), so tasks don't.

Null and empty texts have no words and keep none; texts under ``n`` words lose
nothing.  A null id comes after all others.  Rows of one id and different texts
are ordered by text; of repeated rows one stays.  Other columns are carried along and may
have any names; one that has a result's name is replaced by the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

CHUNK_BYTES = 8 << 20     # text of a chunk, about
_LAST = np.int64(2**63 - 1)
_LOW = np.uint64(0xFFFFFFFF)
_PACKET = "bucket int, chunk int, keys binary, more binary"
_ANSWER = "chunk int, bucket int, step int, bits binary"


def _others(df: DataFrame, id_col: str, text_col: str) -> list[str]:
    return [c for c in df.columns if c not in (id_col, text_col, "n_words", "n_removed", "removed", "kept")]


def deal(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Rows dealt into chunks: ``_chunk``, ``_id``, ``_text`` and the other columns as
    ``_rest0``, ``_rest1``, ..., and the number of chunks."""
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(df[text_col]))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / CHUNK_BYTES))
    rest = [df[c].alias(f"_rest{i}") for i, c in enumerate(_others(df, id_col, text_col))]
    rows = df.select(F.pmod(F.xxhash64(df[id_col]), F.lit(chunks)).cast("int").alias("_chunk"),
                     df[id_col].cast("long").alias("_id"), df[text_col].alias("_text"), *rest)
    return rows.repartition(chunks, "_chunk"), chunks


class Chunk:
    """The words of a chunk's documents, in the order that decides what is first."""

    def __init__(self, table: pa.Table, n: int):
        ids = pc.fill_null(table.column("_id"), _LAST)
        order = pc.sort_indices(pa.table({"i": ids, "t": table.column("_text")}), [("i", "ascending"), ("t", "ascending")])
        self.table = table.take(order).combine_chunks()
        self.ids = np.asarray(pc.take(ids, order))
        hashes, counts = [], []
        for part in W.slices(self.table, "_text"):
            words = W.Words(*W.text_buffer(part.column("_text")), W.NOT_BLANK)
            hashes.append(words.hash)
            counts.append(np.diff(words.first))
        self.n = n
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def starts(self, n: int) -> np.ndarray:
        """Whether ``n`` words of one document begin at each word."""
        ok = np.zeros(len(self.hash), bool)
        if len(ok) >= n:
            ok[:len(ok) - n + 1] = self.row[:len(ok) - n + 1] == self.row[n - 1:]
        return ok

    def probes(self, buckets: int):
        """Sorted distinct probe keys (bucket and 32 bits), the keys by position,
        the positions, and which of them begin a reference block."""
        block = self.n // 2
        at = np.flatnonzero(self.starts(block))
        h = W.window_hash(self.hash, block)[at]
        key = ((h >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (h & _LOW)
        aligned = (at - self.first[self.row[at]]) % block == 0
        return _distinct(key), key, at, aligned

    def candidates(self, buckets: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows round a hit."""
        keys, key, at, aligned = self.probes(buckets)
        seen = np.concatenate([_codes(answers[b], n) for b, n in _sizes(keys)]) if len(keys) else np.empty(0, np.uint8)
        hit = np.zeros(len(self.hash) + 1, np.int32)
        hit[at] = seen[np.searchsorted(keys, key)] > aligned     # its own block doesn't count
        del keys, key, at, aligned, seen
        before = np.concatenate([[0], np.cumsum(hit)])
        span = self.n - self.n // 2 + 1
        ok = np.flatnonzero(self.starts(self.n))
        ok = ok[before[ok + span] > before[ok]]
        return ok, W.window_hash(self.hash, self.n)[ok]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _sizes(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bucket and number of keys, in order; the bucket is in the upper 32 bits."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[at].tolist(), np.diff(at, append=len(keys)).tolist(), strict=True))


def _codes(data: bytes, n: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n)
    return bits[::2] * 2 + bits[1::2]


def _first_starts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, position), and which entries of it are the first of their hash."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)


def _window_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (W.mix(h, 7) >> np.uint64(32)) % np.uint64(buckets)


def _windows(chunk: Chunk, buckets: int, answers: dict[int, bytes]):
    """Candidate positions, their order by (hash, position), the firsts in it, and
    the firsts ordered by bucket, then hash: the packets' order."""
    at, h = chunk.candidates(buckets, answers)
    order, first = _first_starts(h)
    own = order[first]
    bucket = _window_bucket(h[own], buckets)
    sent = np.argsort(bucket, kind="stable")
    return at, h, order, first, own[sent], bucket[sent]


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 20,
            keep: str = "words") -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``removed`` (word ranges
    [start, end) of the maximal repeats) and ``kept``: the words that stay,
    joined by one space (``keep="words"``), or the text without the
    removed words and the blanks after them (``keep="text"``)."""
    if n < 2:
        raise ValueError("a window has two words at least")
    rows, chunks = deal(df, id_col, text_col)

    def probe(table: pa.Table) -> pa.Table:
        keys, key, _, aligned = Chunk(table, n).probes(chunks)
        blocks = np.sort(key[aligned])
        again = np.concatenate([[False, False], blocks[2:] == blocks[:-2]])[:len(blocks)]
        blocks = blocks[~again]      # a third equal block adds nothing
        ends = dict(_sizes(blocks))
        out, i, j = [], 0, 0
        for b, size in _sizes(keys):
            k = ends.get(b, 0)
            out.append((b, W.pack((keys[i:i + size] & _LOW).astype(np.uint32)), W.pack((blocks[j:j + k] & _LOW).astype(np.uint32))))
            i, j = i + size, j + k
        return _packets(out, table)

    def answer(table: pa.Table) -> pa.Table:
        index = np.sort(np.concatenate([W.unpack(x.as_py(), np.uint32) for x in table.column("more")]))
        out = []
        for keys in table.column("keys"):
            keys = W.unpack(keys.as_py(), np.uint32)
            n_seen = np.minimum(np.searchsorted(index, keys, "right") - np.searchsorted(index, keys, "left"), 2).astype(np.uint8)
            out.append(np.packbits(np.stack([n_seen >> 1, n_seen & 1], axis=1).reshape(-1)).tobytes())
        return _answers(table, 1, out)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _packets([], left)
        chunk = Chunk(left, n)
        at, h, _, _, sent, bucket = _windows(chunk, chunks, _by_bucket(right, 1))
        ids = chunk.ids[chunk.row[at[sent]]]
        ends = np.flatnonzero(np.diff(bucket, append=np.uint64(2**63)))
        out, i = [], 0
        for j in ends + 1:
            out.append((int(bucket[i]), W.pack(h[sent[i:j]]), W.planes(ids[i:j])))
            i = j
        return _packets(out, left)

    def earliest(table: pa.Table) -> pa.Table:
        keys = [W.unpack(x.as_py(), np.uint64) for x in table.column("keys")]
        ids = [W.unplanes(x.as_py(), np.int64) for x in table.column("more")]
        sizes = [len(k) for k in keys]
        chunk = np.repeat(np.asarray(table.column("chunk")), sizes)
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((chunk, ids, keys))
        s = keys[order]
        won = np.zeros(len(keys), bool)
        won[order[np.concatenate([[True], s[1:] != s[:-1]])]] = True
        edges = np.cumsum([0, *sizes])
        return _answers(table, 2, [np.packbits(won[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _result(None, left, None, keep)
        chunk = Chunk(left, n)
        at, _, order, first, sent, bucket = _windows(chunk, chunks, _by_bucket(right, 1))
        won = _by_bucket(right, 2)
        stays = np.zeros(len(at), bool)
        if len(sent):
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(edge, append=len(sent))
            stays[sent] = np.concatenate([np.unpackbits(np.frombuffer(won[int(bucket[e])], np.uint8), count=k).astype(bool)
                                          for e, k in zip(edge, sizes, strict=True)])
        gone = W.cover(at[~stays], n, len(chunk.hash))
        return _result(chunk, chunk.table, gone, keep)

    packets = rows.groupBy("_chunk").applyInArrow(probe, _PACKET)
    hits = packets.groupBy("bucket").applyInArrow(answer, _ANSWER)
    found = rows.groupBy("_chunk").cogroup(hits.groupBy("chunk")).applyInArrow(windows, _PACKET)
    firsts = found.groupBy("bucket").applyInArrow(earliest, _ANSWER)
    others = _others(df, id_col, text_col)
    rest = "".join(f"_rest{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(others))
    schema = f"_id long, {rest}n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
    done = rows.groupBy("_chunk").cogroup(hits.unionByName(firsts).groupBy("chunk")).applyInArrow(finish, schema)
    back = [F.col("_id").cast(df.schema[c].dataType).alias(c) if c == id_col else F.col(f"_rest{others.index(c)}").alias(c)
            for c in df.columns if c == id_col or c in others]
    return done.select(*back, "n_words", "n_removed", "removed", "kept")


def _packets(rows: list, table: pa.Table) -> pa.Table:
    own = table.column("_chunk")[0].as_py() if table.num_rows else 0
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([own] * len(rows), pa.int32()),
                     "keys": pa.array([r[1] for r in rows], pa.binary()), "more": pa.array([r[2] for r in rows], pa.binary())})


def _answers(table: pa.Table, step: int, bits: list[bytes]) -> pa.Table:
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "step": pa.array([step] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})


def _by_bucket(table: pa.Table, step: int) -> dict[int, bytes]:
    return {b: x for b, s, x in zip(table.column("bucket").to_pylist(), table.column("step").to_pylist(),
                                    table.column("bits").to_pylist(), strict=True) if s == step}


def _result(chunk: Chunk | None, table: pa.Table, gone: np.ndarray | None, keep: str) -> pa.Table:
    n = table.num_rows
    columns = {c: table.column(c) for c in table.column_names if c == "_id" or c.startswith("_rest")}
    counts, lost, spans, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
    if n:
        counts = np.diff(chunk.first)
        sums = np.concatenate([[0], np.cumsum(gone)])
        lost = sums[chunk.first[1:]] - sums[chunk.first[:-1]]
        row = 0
        for part in W.slices(table, "_text"):
            a, b = chunk.first[row], chunk.first[row + part.num_rows]
            buf, offsets = W.text_buffer(part.column("_text"))
            words = W.Words(buf, offsets, W.NOT_BLANK, hashed=False)
            spans += _spans(gone[a:b], words.first)
            kept.append(_joined(buf, words, ~gone[a:b]) if keep == "words" else _cut(buf, offsets, words, gone[a:b]))
            row += part.num_rows
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.table(columns | {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()),
                               "removed": pa.array(spans, kind), "kept": pa.chunked_array(kept, pa.string())})


def _spans(gone: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """Runs of removed words of each row, counted from the row's first word."""
    out: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    if not gone.any():
        return out
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.concatenate([[True], (gone[1:] != gone[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(gone))
    for b, e in zip(begin[gone[begin]].tolist(), end[gone[begin]].tolist(), strict=True):
        r = int(row[b])
        out[r].append({"start": b - int(first[r]), "end": e - int(first[r])})
    return out


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(buf: np.ndarray, words: W.Words, stays: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space in each row."""
    row = words.rows[stays]
    start = words.start[stays]
    last = np.concatenate([row[1:] != row[:-1], [True]])[:len(row)]
    size = words.end[stays] - start + ~last
    data = np.append(buf, np.uint8(0x20))[W.ranges(start, size)]
    data[(np.cumsum(size) - 1)[~last]] = 0x20
    return _strings(data, np.bincount(row, size, len(words.first) - 1).astype(np.int64))


def _cut(buf: np.ndarray, offsets: np.ndarray, words: W.Words, gone: np.ndarray) -> pa.Array:
    """The texts without the removed words and the blanks that follow them."""
    row = words.rows
    end = np.append(words.start[1:], len(buf))[:len(row)]
    end = np.minimum(end, offsets[row + 1])
    stays = ~W.cover(words.start[gone], (end - words.start)[gone], len(buf)) if len(buf) else np.empty(0, bool)
    sums = np.concatenate([[0], np.cumsum(stays)])
    return _strings(buf[stays], sums[offsets[1:]] - sums[offsets[:-1]])
