"""Token-ID output: best-fit-decreasing packing into fixed rows.

Documents are tokenised to ids, with an end-of-text id after each.  Texts
longer than a row are cut into full rows and a rest, losslessly.  The rests
are packed longest first, each into the fullest open row that still takes it;
a segment tree over capacities finds that row in log(length) steps.  A row
holds its ids (padded), the cumulative lengths of its segments, positions
that begin again with each segment, and which part of which document each
segment is.

Packing runs within a task's documents, ``DOCS_TEXT`` of text at a time: such
a pack wastes one partly filled row or so out of thousands, and needs no
shuffle; a document never waits for others elsewhere.  Rows are written as
fixed-width binaries, so files are id matrices.

Null and empty texts are one segment of the end id.  Repeated rows are packed
as often as they occur; equal lengths in the order of their ids.
"""

from __future__ import annotations

import base64
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from . import words as W

LENGTH = 2048             # ids of a row
DOCS_TEXT = 8 << 20       # bytes of text packed together
_SEGMENT = "struct<doc_id:bigint,part:int,start:int,n:int>"


class Capacities:
    """A segment tree over the capacities 0 .. length: which have open rows, and the
    smallest of them that is enough."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.some = [0] * (2 * self.size)           # open rows below each node
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = self.size + capacity
        while node:
            self.some[node] += 1
            node >>= 1

    def take(self, needed: int) -> tuple[int, int] | None:
        """Remove and return (capacity, row) of the best fit, if any row fits."""
        node = self.size + needed
        if not self.some[node]:
            # up to the first subtree on the right that has rows, then down its left edge
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.size
        row = self.rows[capacity].pop()
        while node:
            self.some[node] -= 1
            node >>= 1
        return capacity, row


def pack(sizes: np.ndarray, length: int) -> tuple[list[list[tuple[int, int, int]]], int]:
    """Rows of (document, start, n) segments; the best-fit-decreasing packing of
    documents of ``sizes`` ids.  Also the number of segments."""
    rows: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int]] = []
    for d, size in enumerate(sizes.tolist()):
        full = size // length
        rows.extend([(d, k * length, length)] for k in range(full))
        if size % length:
            rest.append((size % length, d))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_ = Capacities(length)
    for n, d in rest:
        start = int(sizes[d]) - n
        found = open_.take(n)
        if found:
            capacity, row = found
            rows[row].append((d, start, n))
        else:
            capacity, row = length, len(rows)
            rows.append([(d, start, n)])
        if capacity > n:
            open_.add(capacity - n, row)
    return rows, sum(map(len, rows))


def matrix(ids: np.ndarray, at: np.ndarray, rows: list, length: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids and positions, rows x length."""
    source, target, n = [], [], []
    for r, segments in enumerate(rows):
        filled = 0
        for d, start, k in segments:
            source.append(at[d] + start)
            target.append(r * length + filled)
            n.append(k)
            filled += k
    out = np.full(len(rows) * length, pad, ids.dtype)
    position = np.zeros(len(rows) * length, np.uint16 if length <= 1 << 16 else np.uint32)
    if n:
        n = np.array(n)
        place = W.ranges(np.array(target), n)
        out[place] = ids[W.ranges(np.array(source), n)]
        position[place] = W.ranges(np.zeros(len(n), np.int64), n)
    return out.reshape(-1, length), position.reshape(-1, length)


def packed_rows(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                end_id: int = 50256) -> DataFrame:
    """Packed rows: ``ids`` (binary, ``length`` little-endian unsigned 16-bit ids,
    padded with ``end_id``), ``cu_seqlens`` (array of cumulative segment lengths
    from 0 on), ``positions`` (binary, unsigned 16-bit, 0 at each segment's
    begin), ``segments`` (array of doc_id, part, start in the document's ids,
    n) and ``n_ids`` without padding.  Parts count a document's segments."""
    if not 2 <= length <= 1 << 16:
        raise ValueError("a row has 2 to 65536 ids")
    ranks = bpe.shipped_ranks(df.sparkSession, ranks_path)

    def run(batches):
        coder = _coder(ranks.value)
        for batch in batches:
            for part in W.slices(batch, "text", DOCS_TEXT):
                yield _packed(part, coder, length, end_id)

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"ids binary, cu_seqlens array<int>, positions binary, segments array<{_SEGMENT}>, n_ids int")


def _packed(part: pa.RecordBatch, coder, length: int, end_id: int) -> pa.RecordBatch:
    texts = part.column("text").to_pylist()
    parts = [coder.encode_to_numpy(t or "", disallowed_special=()) for t in texts]
    if any(len(p) and int(p.max()) >= 1 << 16 for p in parts):
        raise ValueError("ids of this vocabulary don't fit 16 bits")
    ids = np.concatenate([x for p in parts for x in (p.astype("<u2"), np.array([end_id], "<u2"))])
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    order = np.argsort([-1 if i is None else i for i in part.column("id").to_pylist()], kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    rows, _ = pack(sizes[order], length)
    out, position = matrix(ids, begin, rows, length, end_id)
    names = [part.column("id")[int(i)].as_py() for i in order]
    return pa.RecordBatch.from_pydict({
        "ids": bpe.binary_rows(out.reshape(-1).view(np.uint8), np.arange(len(rows) + 1) * 2 * length),
        "cu_seqlens": pa.array([np.cumsum([0, *(s[2] for s in r)]) for r in rows], pa.list_(pa.int32())),
        "positions": bpe.binary_rows(position.reshape(-1).view(np.uint8), np.arange(len(rows) + 1) * position.itemsize * length),
        "segments": pa.array([[{"doc_id": names[d], "part": start // length, "start": start, "n": n} for d, start, n in r]
                              for r in rows], pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int32()),
                                                                  ("start", pa.int32()), ("n", pa.int32())]))),
        "n_ids": pa.array([sum(s[2] for s in r) for r in rows], pa.int32())})


_coders: dict = {}


def _coder(data: bytes):
    """The vocabulary's encoder, one per worker process."""
    key = hash(data)
    if key not in _coders:
        import public_tokenizers
        import tiktoken
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, data.splitlines())}
        _coders[key] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _coders[key]
