"""Byte-level BPE encoding and decoding (the ``tokenizers`` library on Arrow batches).

The vocabulary is a file of ranks (base64 bytes and a number per line).  Byte
level BPE works on a printable alphabet of 256 characters, one per byte; the
vocabulary and the merges are written in it.  The library wants the merges as
pairs, the file only has the results, so each token's last pair is found by
merging its own bytes: merges inside a token don't depend on what surrounds
it, so this pair is the only one that ever makes the token.  A word of the
pattern that is itself a token is taken whole (``ignore_merges``).

Encoding repeats itself, as words do.  A text may be cut before a single space
between two non-blank characters: the pattern never joins what such a cut
parts, and nothing in it looks back.  Each distinct segment of a sub-batch is
encoded once, in long strings of many segments; token lengths in bytes say
where each segment's tokens begin, and the ids of the texts are gathered.  The
same lengths give every token's byte and character offsets.  Decoding reads
the byte table in reverse.  The decoded bytes of a sub-batch are compared with
its text, and a row that differs is encoded by itself.

Null and empty texts have no tokens.  Texts are whole, whatever their length.
Rows are independent: repeated rows and ids give repeated results, and nothing
is shuffled.  Columns other than id and text are dropped.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

JOINED = 1 << 14     # bytes of distinct segments in one string for the library
DECODED = 1 << 18    # ids decoded at a time
TEXT_SLICE = 12 << 20  # text in which a segment is encoded once

#: The bytes that stand for themselves in the byte-level alphabet;
#: the others take the characters from 256 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> list[str]:
    """Character of each byte."""
    own = set(PRINTABLE)
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    lines = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in lines}


def final_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``; None if merging never does."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not found:
            return None
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1])


class ByteBpe:
    """Encoder and decoder over byte buffers of many rows."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer, models, pre_tokenizers
        ranks = read_ranks(data)
        alphabet = byte_alphabet()
        name = {t: "".join(alphabet[b] for b in t) for t in ranks}
        pairs = [final_pair(t, ranks) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        merges = [(name[p[0]], name[p[1]]) for p in pairs if p]
        self.library = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        # its regular expression is public_tokenizers.PATTERN
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = {c: b for b, c in enumerate(alphabet)}
        table = {r: bytes(back[c] for c in s) for s, r in self.library.get_vocab(with_added_tokens=False).items()}
        size = max(table) + 1
        self.length = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)

    def _library(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.empty(0, np.uint32)
        found = self.library.encode_batch_fast(strings, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, np.uint32) for e in found])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the n + 1 offsets of the rows in them."""
        start, end, first = segments(buf, offsets)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        _, at, which = np.unique(W.hash_ranges(buf, start, end), return_index=True, return_inverse=True)
        s, e = start[at], end[at]
        free = _joinable(buf, s, e)
        order = np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)])
        s, e = s[order], e[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n_free, size = int(free.sum()), e - s
        text = buf[W.ranges(s, size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])
        strings, i = [], 0
        while i < len(s):
            j = i + 1
            if i < n_free:
                j = min(max(int(np.searchsorted(edge, edge[i] + JOINED, side="right")) - 1, i + 1), n_free)
            strings.append(text[edge[i]:edge[j]].decode())
            i = j
        ids = self._library(strings)
        token_at = np.searchsorted(np.cumsum(self.length[ids]), edge, side="right")
        token_at[0], token_at[-1] = 0, len(ids)
        which = place[which]
        n_tokens = np.diff(token_at)[which]
        out = ids[W.ranges(token_at[:-1][which], n_tokens)]
        rows = np.concatenate([[0], np.cumsum(n_tokens)])[first]
        return self._checked(buf, offsets, out, rows)

    def _checked(self, buf, offsets, ids, rows):
        """Rows whose bytes don't come back are encoded by themselves."""
        decoded = self.decode(ids)
        if len(decoded) == len(buf) and np.array_equal(decoded, buf):
            return ids, rows
        parts, whole = [], decoded.tobytes()
        at = np.concatenate([[0], np.cumsum(self.length[ids])])[rows]
        for i in range(len(offsets) - 1):
            own = buf[offsets[i]:offsets[i + 1]].tobytes()
            parts.append(ids[rows[i]:rows[i + 1]] if whole[at[i]:at[i + 1]] == own else self._library([own.decode()]))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, one after another."""
        blocks = [ids[i:i + DECODED] for i in range(0, len(ids), DECODED)] or [ids]
        return np.concatenate([self.pool[W.ranges(self.begin[b], self.length[b])] for b in blocks])

    def decode_text(self, ids: np.ndarray) -> str:
        """Text of ``ids``; a character of which only some bytes are there
        becomes U+FFFD, as its token's neighbours may be missing."""
        return self.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", errors="replace")

    def offsets(self, buf: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets [start, end) of the tokens of one row's bytes; a
        token that holds some bytes of a character covers that character."""
        stop = np.cumsum(self.length[ids])
        char = np.cumsum((buf & 0xC0) != 0x80) - 1
        return char[stop - self.length[ids]], char[stop - 1] + 1


def _ends_sharply(buf: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character that ends at byte ``last`` is surely no white space:
    printable ASCII, or two bytes of which the first is C3 to DF."""
    b = buf[last]
    before = buf[np.maximum(last - 1, 0)]
    return ((b > 0x20) & (b < 0x7F)) | ((b >= 0x80) & (b < 0xC0) & (before >= 0xC3) & (before <= 0xDF) & (last > 0))


def _begins_sharply(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    b = buf[np.minimum(at, len(buf) - 1)]
    return (at < len(buf)) & (((b > 0x20) & (b < 0x7F)) | ((b >= 0xC3) & (b <= 0xDF)))


def _joinable(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Segments that may stand after one another in any order: a single space
    first, then and at the end no white space."""
    return (buf[start] == 0x20) & (end - start > 1) & _begins_sharply(buf, start + 1) & _ends_sharply(buf, end - 1)


def segments(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the segments, and the n + 1 offsets of the rows in them."""
    cut = np.flatnonzero(buf == 0x20)
    cut = cut[(cut > 0)]
    cut = cut[_ends_sharply(buf, cut - 1) & _begins_sharply(buf, cut + 1)]
    filled = offsets[:-1][np.diff(offsets) > 0]
    start = np.sort(np.concatenate([cut, filled]), kind="stable")
    start = start[np.diff(start, prepend=-1) > 0]
    end = np.append(start[1:], len(buf))[:len(start)]
    return start, end, np.searchsorted(start, offsets)


_loaded: dict[int, ByteBpe] = {}


def loaded(data: bytes) -> ByteBpe:
    """One coder per worker process and vocabulary."""
    key = hash(data)
    if key not in _loaded:
        _loaded[key] = ByteBpe(data)
    return _loaded[key]


def shipped_ranks(spark, path: str):
    """The vocabulary as a broadcast; refuses files beyond 64 MB."""
    size = os.path.getsize(path)
    if size > 64 << 20:
        raise ValueError(f"{path} has {size} bytes; vocabularies of up to 64 MB are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
           decode: bool = False, offsets: bool = False) -> DataFrame:
    """id, ``ids`` (binary, little-endian unsigned 32-bit), and on request
    ``decoded`` (binary: the bytes that the ids give back) and ``starts`` and
    ``ends`` (arrays of character offsets)."""
    ranks = shipped_ranks(df.sparkSession, ranks_path)

    def run(batches):
        coder = loaded(ranks.value)
        for batch in batches:
            for part in W.slices(batch, "_text", TEXT_SLICE):
                buf, at = W.text_buffer(part.column("_text"))
                ids, rows = coder.encode(buf, at)
                out = {"_id": part.column("_id"), "ids": binary_rows(ids.astype("<u4").view(np.uint8), rows * 4)}
                if decode:
                    sizes = np.concatenate([[0], np.cumsum(coder.length[ids])])[rows]
                    out["decoded"] = binary_rows(coder.decode(ids), sizes)
                if offsets:
                    pairs = [coder.offsets(buf[at[i]:at[i + 1]], ids[rows[i]:rows[i + 1]]) for i in range(len(at) - 1)]
                    out["starts"] = pa.array([p[0] for p in pairs], pa.list_(pa.int32()))
                    out["ends"] = pa.array([p[1] for p in pairs], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, ids binary" + ", decoded binary" * decode + ", starts array<int>, ends array<int>" * offsets
    return (df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
            .mapInArrow(run, schema).withColumnRenamed("_id", id_col))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded_text") -> DataFrame:
    """``df`` with the text of its ids (null for null; U+FFFD for split characters)."""
    from pyspark.sql import functions as F
    ranks = shipped_ranks(df.sparkSession, ranks_path)

    @F.pandas_udf("string")
    def back(ids):
        coder = loaded(ranks.value)
        return ids.map(lambda b: None if b is None else coder.decode_text(np.frombuffer(b, "<u4")))

    return df.withColumn(out_col, back(df[ids_col]))


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1,
                                 [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
