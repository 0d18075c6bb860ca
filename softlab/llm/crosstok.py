"""Cross-tokenizer alignment: two tokenizers' tokens of one text, by their bytes.

Side A is a byte-level BPE (``tokenizers`` file) on a space and the text, side B a
BPE of pieces (``sentencepiece`` file), which adds that space itself.  Both cut
the same bytes.  Texts of a sub-batch stand on one line of bytes; a
``merge_asof`` by document finds, for each token's start, the other side's token
that covers it.  The union of both directions holds every pair of tokens that
share a byte, each once (equal starts are found twice).  Pairs that end together
are links, and their ends cut the tokens into groups.

Counts over the corpus: sub-batches that follow each other make a chunk, one row
of a written table, with its links' distinct id pairs in order and, for each
document, the places of its links among them.  Pairs are summed over chunks (each is one row a chunk, however
often it occurs), the highest count of each B id is taken from the sums, and
every chunk gets the counts of its own pairs back.  The table of the B ids has no
more rows than the vocabulary and is the only one broadcast.

Tokens repeat as words do: a text is cut before single spaces between
characters that surely aren't blank; neither tokenizer joins what such a cut
parts (for B this is checked in the vocabulary, and texts are whole otherwise),
and a segment that a worker has met is not encoded again until the known ones,
which are bounded by number and by tokens, are forgotten.

A worker's memory follows the sub-batch, not the chunk, the Arrow batch (these are
cut by bytes while chunks are made) or the table; places are packed where they are
made, so that a chunk's row stays small in the JVM.

Texts that are null, empty or whose bytes one side doesn't give back have no
tokens.  The strings of special tokens are ordinary text.  Texts are whole,
whatever their length.  Repeated rows and ids are rows of their own, and count as
often as they occur.  Other columns are dropped; an empty table has an empty
result.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from . import words as W
from .bpe import ByteBpe, binary_rows, byte_alphabet, segments

SPACE = "▁"           # how pieces write a space
TEXT_SLICE = 1 << 20       # text of a chunk, about
CHUNK_ROWS = 10_000        # rows of a chunk, about, if they are short
PIECE = 1 << 18            # text that is aligned at a time, about
BATCH_BYTES = 4 << 20      # of an Arrow batch of texts, about
KNOWN = 1 << 18            # segments whose tokens a worker keeps, about
KNOWN_TOKENS = 1 << 21     # of these segments, about


class Side:
    """One tokenizer: its entries' bytes, and the tokens of the segments it has met."""

    by_segment = True

    def _hold(self, table: dict[int, bytes]) -> None:
        size = max(table) + 1
        self.length = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.tokens = np.empty(0, np.uint32)

    def _learn(self, place: np.ndarray, h: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Segments of the hashes ``h`` go before the known ones at ``place``."""
        old = np.ones(len(self.known) + len(h), bool)
        old[place + np.arange(len(h))] = False
        new = ~old
        for name, more in (("known", h), ("at", len(self.tokens) + rows[:-1]), ("size", np.diff(rows))):
            both = np.empty(len(old), more.dtype)
            both[old], both[new] = getattr(self, name), more
            setattr(self, name, both)
        self.tokens = np.concatenate([self.tokens, ids])

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows (which begin with the space) and the n + 1 offsets of the rows in them."""
        if not self.by_segment:
            return self.fresh(buf, offsets)
        start, end, first = segments(buf, offsets)
        h, one, which = np.unique(W.hash_ranges(buf, start, end), return_index=True, return_inverse=True)
        if len(self.known) > KNOWN or len(self.tokens) > KNOWN_TOKENS:
            self._forget()
        place = np.searchsorted(self.known, h)
        new = np.append(self.known, 0)[place] != h
        new |= place == len(self.known)
        s, size = start[one[new]], (end - start)[one[new]]
        ids, rows = self.fresh(buf[W.ranges(s, size)], np.concatenate([[0], np.cumsum(size)]))
        self._learn(place[new], h[new], ids, rows)
        which = np.searchsorted(self.known, h)[which]
        size = self.size[which]
        return self.tokens[W.ranges(self.at[which], size)], np.concatenate([[0], np.cumsum(size)])[first]

    def same_bytes(self, ids: np.ndarray, rows: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which rows' tokens give back the rows' bytes."""
        back = ByteBpe.decode(self, ids) if len(ids) else np.empty(0, np.uint8)
        at = np.concatenate([[0], np.cumsum(self.length[ids])])[rows]
        if np.array_equal(at, offsets) and np.array_equal(back, buf):
            return np.ones(len(rows) - 1, bool)
        return np.array([np.array_equal(back[at[i]:at[i + 1]], buf[offsets[i]:offsets[i + 1]]) for i in range(len(rows) - 1)], bool)


class ByteLevel(Side):
    """Side A, from the library's own file."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self._hold({i: bytes(back[c] for c in s) for s, i in self.library.get_vocab(with_added_tokens=False).items()})
        self.joined = _Joined(self)

    def fresh(self, buf, offsets):
        return self.joined.encode(buf, offsets)


class _Joined(ByteBpe):
    """Segments in long strings for the library."""

    def __init__(self, side: ByteLevel):
        self.library, self.length, self.begin, self.pool = side.library, side.length, side.begin, side.pool


class Pieces(Side):
    """Side B."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor
        self.library = s = SentencePieceProcessor(model_proto=data)
        name = [s.id_to_piece(i) for i in range(s.get_piece_size())]
        self._hold({i: bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(name)})
        self.by_segment = not any(SPACE in p.lstrip(SPACE) for p in name)

    def fresh(self, buf, offsets):
        whole, at = buf.tobytes(), offsets.tolist()
        found = self.library.encode([whole[a + 1:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], num_threads=1)
        rows = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(rows[-1])), rows


class Aligned:
    """The tokens of a list of texts that both sides give back, and what they share.

    ``rows``: the texts that have tokens; ``a``, ``b``: ids; ``a_row``, ``b_row``:
    the texts' offsets in them; ``a_end``, ``b_end``: ends of the tokens on the
    common line of bytes; ``x``, ``y``: tokens that share a byte, in order;
    ``together``: which of these end together.
    """

    def __init__(self, one: ByteLevel, two: Pieces, text: pa.Array):
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        some = np.flatnonzero(np.asarray(pc.fill_null(pc.binary_length(text), 0)) > 0)
        buf, offsets = W.text_buffer(pc.binary_join_element_wise(" ", text.take(pa.array(some)), ""))
        sides = []
        good = np.ones(len(some), bool)
        for side in (one, two):
            ids, rows = side.encode(buf, offsets) if len(some) else (np.empty(0, np.uint32), np.zeros(1, np.int64))
            same = side.same_bytes(ids, rows, buf, offsets)
            if not same.all():      # as the library has them from the whole text
                ids, rows = _replaced(side, ids, rows, buf, offsets, same)
                same = side.same_bytes(ids, rows, buf, offsets)
            sides.append((ids, rows))
            good &= same
        self.rows = some[good]
        (self.a, self.a_row), (self.b, self.b_row) = (_of_rows(ids, rows, good) for ids, rows in sides)
        self.a_end, self.b_end = np.cumsum(one.length[self.a]), np.cumsum(two.length[self.b])
        self.x, self.y = self._overlaps()
        self.together = self.a_end[self.x] == self.b_end[self.y]

    def _overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(len(self.rows))
        a, b = (pd.DataFrame({"at": end - size, "row": np.repeat(n, np.diff(rows)), side: np.arange(len(end))})
                for side, end, size, rows in (("a", self.a_end, np.diff(self.a_end, prepend=0), self.a_row),
                                              ("b", self.b_end, np.diff(self.b_end, prepend=0), self.b_row)))
        if not len(n):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        starts_a = pd.merge_asof(a, b, on="at", by="row")
        starts_b = pd.merge_asof(b, a, on="at", by="row")
        x, y = starts_b["a"].to_numpy(np.int64), starts_b["b"].to_numpy(np.int64)
        new = a["at"].to_numpy()[x] != b["at"].to_numpy()[y]
        x = np.concatenate([starts_a["a"].to_numpy(np.int64), x[new]])
        y = np.concatenate([starts_a["b"].to_numpy(np.int64), y[new]])
        # of two successive pairs the second is further on one side or both: x + y orders them
        place = np.full(int((x + y).max()) + 1, -1)
        place[x + y] = np.arange(len(x))
        order = place[place >= 0]
        return x[order], y[order]

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums over the pairs (x, y) of each text with tokens."""
        sums = np.concatenate([[0], np.cumsum(values)])
        at = np.searchsorted(self.x, self.a_row)
        return sums[at[1:]] - sums[at[:-1]]

    def written_groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``a1,a2|b1;a3|b2,b3`` for each text, and their offsets."""
        link = np.flatnonzero(self.together)
        a_last, b_last = self.x[link], self.y[link]
        ended = [np.bincount(last + 1, minlength=len(side) + 1)[:len(side)].cumsum() for last, side in ((a_last, self.a), (b_last, self.b))]
        place_a = np.arange(len(self.a)) + np.concatenate([[0], b_last + 1])[ended[0]]
        place_b = np.arange(len(self.b)) + np.concatenate([a_last + 1, [0]])[ended[1]]
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[place_a], ids[place_b] = self.a, self.b
        text, digits = _decimals(int(ids.max(initial=0)) + 1)
        text, size = text[ids], digits[ids]
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[place_a[a_last]] = ord("|")
        mark[place_b[b_last]] = ord(";")
        text[np.arange(len(ids)), size] = mark
        row = self.a_row + self.b_row
        size += 1
        size[row[1:] - 1] -= 1       # nothing after a text's last
        out = text[np.arange(text.shape[1]) < size[:, None]]
        return out, np.concatenate([[0], np.cumsum(size)])[row]


_numbers: list = [np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)]


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``n`` (with room for one more byte), and how many."""
    if len(_numbers[1]) < n:
        names = [str(i).encode() for i in range(n)]
        _numbers[1] = np.array([len(x) for x in names], np.int64)
        width = len(names[-1]) + 1
        _numbers[0] = np.frombuffer(b"".join(x.ljust(width) for x in names), np.uint8).reshape(n, width)
    return _numbers[0], _numbers[1]


def _replaced(side: Side, ids, rows, buf, offsets, same) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` and ``rows`` with the rows that aren't the ``same`` encoded by themselves."""
    parts = [ids[rows[i]:rows[i + 1]] if same[i] else side.fresh(buf[offsets[i]:offsets[i + 1]], offsets[i:i + 2] - offsets[i])[0]
             for i in range(len(same))]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _of_rows(ids: np.ndarray, rows: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(rows)[good]
    return ids[W.ranges(rows[:-1][good], size)].astype(np.int64), np.concatenate([[0], np.cumsum(size)])


_loaded: dict[int, object] = {}


def _side(kind, data: bytes):
    """One coder per worker process and vocabulary."""
    key = hash((kind.__name__, data))
    if key not in _loaded:
        _loaded[key] = kind(data)
    return _loaded[key]


def _shipped(spark, *paths: str):
    """The vocabularies as broadcasts; refuses files beyond 64 MB."""
    for path in paths:
        if os.path.getsize(path) > 64 << 20:
            raise ValueError(f"{path} has {os.path.getsize(path)} bytes; vocabularies of up to 64 MB are broadcast")
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(spark.sparkContext.broadcast(f.read()))
    return out


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids of both sides (``a_ids``, ``b_ids``), their ends in bytes of a space and
    the text (``a_ends``, ``b_ends``), every overlapping pair of tokens by position
    (``overlaps``: ``a``, ``b``) and the ``group`` of each token of each side
    (``a_groups``, ``b_groups``).  Empty arrays where a text has no tokens."""
    one, two = _shipped(df.sparkSession, a_path, b_path)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "_text", TEXT_SLICE):
                t = Aligned(_side(ByteLevel, one.value), _side(Pieces, two.value), part.column("_text"))
                cuts = t.a_end[t.x[t.together]]
                out = [{k: [] for k in ("a_ids", "b_ids", "a_ends", "b_ends", "overlaps", "a_groups", "b_groups")} for _ in range(part.num_rows)]
                at = np.searchsorted(t.x, t.a_row)
                base = np.concatenate([[0], t.a_end])[t.a_row]
                for k, i in enumerate(t.rows):
                    a, b, p = slice(*t.a_row[k:k + 2]), slice(*t.b_row[k:k + 2]), slice(*at[k:k + 2])
                    first = np.searchsorted(cuts, base[k], side="right")
                    out[i] = {"a_ids": t.a[a], "b_ids": t.b[b], "a_ends": t.a_end[a] - base[k], "b_ends": t.b_end[b] - base[k],
                              "overlaps": [{"a": x, "b": y} for x, y in zip((t.x[p] - a.start).tolist(), (t.y[p] - b.start).tolist(), strict=True)],
                              "a_groups": np.searchsorted(cuts, t.a_end[a]) - first, "b_groups": np.searchsorted(cuts, t.b_end[b]) - first}
                ints, pair = pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                yield pa.RecordBatch.from_pydict({"_id": part.column("_id")} | {
                    k: pa.array([o[k] for o in out], pair if k == "overlaps" else ints) for k in
                    ("a_ids", "b_ids", "a_ends", "b_ends", "overlaps", "a_groups", "b_groups")})

    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"_id {kind}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, "
              "overlaps array<struct<a: int, b: int>>, a_groups array<int>, b_groups array<int>")
    return (df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
            .mapInArrow(run, schema).withColumnRenamed("_id", id_col))


#: Columns of a chunk but for the ids' type.
CHUNK = {"ids": "", "n_a": "array<long>", "n_b": "array<long>", "n_groups": "array<long>", "n_overlaps": "array<long>",
         "groups": "array<string>", "links": "array<long>", "places": "binary", "pairs": "array<long>", "counts": "array<long>"}


def _chunk_schema(kind: str) -> str:
    return ", ".join(f"{name} {own or f'array<{kind}>'}" for name, own in CHUNK.items())


class _Chunk:
    """Sub-batches that become one row."""

    def __init__(self):
        self.bytes, self.ids, self.digests, self.keys = 0, [], [], []
        self.numbers = {name: [] for name in ("n_a", "n_b", "n_groups", "n_overlaps", "links")}

    def add(self, ids: pa.Array, t: Aligned, size: int) -> None:
        n = len(ids)
        self.bytes += size
        self.ids += ids.to_pylist()
        text, at = t.written_groups()
        whole, digests = text.tobytes(), [""] * n
        for k, i in enumerate(t.rows.tolist()):
            digests[i] = hashlib.sha256(whole[at[k]:at[k + 1]]).hexdigest()
        self.digests += digests
        self.keys.append((t.b[t.y[t.together]] << 32) | t.a[t.x[t.together]])
        links = t.per_row(t.together.astype(np.int64))
        for name, v in (("n_a", np.diff(t.a_row)), ("n_b", np.diff(t.b_row)), ("n_groups", links), ("links", links),
                        ("n_overlaps", t.per_row(np.ones(len(t.x), np.int64)))):
            full = np.zeros(n, np.int64)
            full[t.rows] = v
            self.numbers[name].append(full)

    def full(self) -> bool:
        return self.bytes >= TEXT_SLICE or len(self.ids) >= CHUNK_ROWS

    def row(self, id_type: pa.DataType) -> pa.RecordBatch:
        numbers = {name: np.concatenate(v) for name, v in self.numbers.items()}
        pairs, place, counts = np.unique(np.concatenate(self.keys), return_inverse=True, return_counts=True)
        # the order of a document's links doesn't matter: places ascend
        both = np.repeat(np.arange(len(self.ids)), numbers["links"]) * max(len(pairs), 1) + place.astype(np.int64)
        both.sort()
        place = both % max(len(pairs), 1)
        out = {"ids": pa.array([self.ids], pa.list_(id_type)), "groups": pa.array([self.digests], pa.list_(pa.string())),
               "places": pa.array([zlib.compress(W.planes(np.diff(place, prepend=0).astype(np.int32)), 1)], pa.binary())}
        for name, v in (numbers | {"pairs": pairs, "counts": counts}).items():
            out[name] = pa.array([v], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({name: out[name] for name in CHUNK})


def _chunks(one, two, id_type: pa.DataType):
    def run(batches):
        chunk = _Chunk()
        for batch in batches:
            for part in W.slices(batch, "_text", PIECE):
                text = part.column("_text")
                chunk.add(part.column("_id"), Aligned(_side(ByteLevel, one.value), _side(Pieces, two.value), text), pc.sum(pc.binary_length(text)).as_py() or 0)
                if chunk.full():
                    yield chunk.row(id_type)
                    chunk = _Chunk()
        if chunk.ids:
            yield chunk.row(id_type)
    return run


def _counted(id_type: pa.DataType):
    def run(chunk: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        for c in chunk.to_batches():
            for k in range(c.num_rows):
                own = {name: np.asarray(c.column(name)[k].values) for name in ("n_a", "n_b", "n_groups", "n_overlaps", "links")}
                place = np.cumsum(W.unplanes(zlib.decompress(c.column("places")[k].as_py()), np.int32), dtype=np.int64)
                order = np.argsort(np.asarray(pairs.column("pair")))
                total, best = (np.asarray(pairs.column(x)).astype(np.int64)[order] for x in ("total", "best"))
                at = np.concatenate([[0], np.cumsum(own["links"])])
                sums = [np.concatenate([[0], np.cumsum(v[place])]) for v in (total, best)]
                count_sum, n_best = (s[at[1:]] - s[at[:-1]] for s in sums)
                out.append(pa.table({"_id": c.column("ids")[k].values.cast(id_type), "n_a": own["n_a"], "n_b": own["n_b"], "n_groups": own["n_groups"],
                                     "n_links": own["links"], "n_best": n_best, "count_sum": count_sum,
                                     "groups_sha256": c.column("groups")[k].values, "n_overlaps": own["n_overlaps"]}))
        return pa.concat_tables(out)
    return run


@contextmanager
def _batches_by_bytes(spark):
    """Meanwhile Arrow batches hold about ``BATCH_BYTES`` at most: 10,000 texts of any
    length would stand in each worker and, while they are written, in its executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def link_counts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose id pair is the most frequent of its B id over all documents, ties
    included), ``count_sum`` (corpus-wide counts of its links' pairs),
    ``groups_sha256`` and ``n_overlaps``."""
    one, two = _shipped(df.sparkSession, a_path, b_path)
    own = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    id_type = pa.array([], _arrow(df.schema[id_col].dataType)).type
    chunks = own.mapInArrow(_chunks(one, two, id_type), _chunk_schema(kind)).withColumn("chunk", F.monotonically_increasing_id())
    with _batches_by_bytes(df.sparkSession):
        chunks = shared_table(chunks, "crosstok-chunks")
    pairs = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(
        F.col("chunk").alias("of"), F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = shared_table(pairs.groupBy("pair").agg(F.sum("n").alias("total")), "crosstok-pairs")
    b = F.shiftright("pair", 32)
    top = totals.groupBy(b.alias("b")).agg(F.max("total").alias("top"))     # a row for each entry of B's vocabulary at most
    counted = totals.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    back = pairs.select("of", "pair").hint("merge").join(counted.hint("merge"), "pair")
    schema = (f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string, n_overlaps long")
    rows = chunks.drop("pairs", "counts").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_counted(id_type), schema)
    return rows.withColumnRenamed("_id", id_col)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)
