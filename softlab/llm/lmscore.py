"""LM scoring by cross-entropy difference.

Two bigram models count words (of ``[^\\x20\\x09-\\x0D]+``, lower-cased) and
pairs of neighbours.  The target model counts chosen documents, the background
model all documents; the background's counts are scaled to the target's number
of words, so both are smoothed alike:

    P(w)   = (c(w) + 1) / (N + UNIGRAMS)
    P(w|v) = (c(v, w) + K * P(w)) / (c(v) + K)

The corpus is counted in two halves (by hash of id), and a document is scored by
the counts of the other half, so its own words don't speak for it.  A
document's score is the mean over its words of target loss less background
loss (nats): the lower, the more it is like the target.

Every word and pair of every document has its own count (keys of 64 bits).
Documents are dealt with the target ids to chunks of one half, by hash of id.
A chunk sends its distinct keys in order, with its own counts, by range of
keys; each range is summed over all chunks, and every chunk gets the other
half's sums of the keys it sent, in the same order, with which it scores its
documents.  Counting and scoring read one shuffle of the documents.  A word that
is in all documents is one entry per chunk.  Chunks and ranges become more with
the corpus, not larger; nothing of the models passes the driver or is broadcast.
What a chunk sends depends on the set of its rows only, not on their order, so a
task that runs again sends the same.

Null and empty texts have no words and scores of 0.  Repeated rows count as often
as they occur.  Target ids that are null or without a document change
nothing; ids listed twice count once.  With no target words both models are
flat and uniform against the background.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

UNIGRAMS = 1 << 19          # words that smoothing reckons with
K = 5.0
CHUNK_BYTES = 8 << 20       # text of a chunk, about
RANGE_BYTES = 16 << 20      # text whose keys are in one range, about
LEAST_CHUNKS = 64
LEAST_RANGES = 256
_START = np.uint64(0x5851F42D4C957F2D)      # stands before a row's first word
_PAIR_BASE = np.uint64(0xD6E8FEB86659FD93)
_TOTALS = -1                # the range of the numbers of words
_PACKET = "chunk int, range int, wanted boolean, at binary, target binary, background binary"
_REPLY = "chunk int, range int, target binary, background binary"


def keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key of each word, of what is before it (``_START`` at a row's beginning)
    and of the pair, and the rows' offsets."""
    words = W.Words(buf, offsets, W.NOT_BLANK, lower=True)
    before = np.concatenate([[_START], words.hash[:-1]])[:len(words)]
    before[words.first[:-1][np.diff(words.first) > 0]] = _START
    return words.hash, before, W.mix(before * _PAIR_BASE + words.hash, 2), words.first


def _groups(batches, name: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of each value of a column by which they are sorted."""
    held, own = [], None
    for batch in batches:
        value = np.asarray(batch.column(name))
        cuts = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and value[a] != own:
                yield own, held
                held = []
            own = int(value[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield own, held


@dataclass
class Chunk:
    """Words of the documents of a chunk: positions of each word, of what is before it and of
    the pair among the distinct keys (``at``), and each row's number of words."""

    at: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, batches: list[pa.RecordBatch]) -> Chunk:
        found = [keys(*W.text_buffer(part.column("text"))) for b in batches for part in W.slices(b, "text", W.SLICE_BYTES // 4)]
        word, before, pair = (np.concatenate([x[i] for x in found] or [np.empty(0, np.uint64)]) for i in range(3))
        sizes = np.concatenate([np.diff(x[3]) for x in found] or [np.empty(0, np.int64)])
        del found
        opens = before == _START
        del before
        ones, word = cls._distinct(word)
        twos, pair = cls._distinct(pair)
        at = np.unique(np.concatenate([ones, twos, [_START][:len(word)]]).astype(np.uint64))
        word = np.searchsorted(at, ones).astype(np.int32)[word]
        before = np.concatenate([word[:1], word[:-1]])
        before[opens] = np.searchsorted(at, _START)
        return cls(at, word, before, np.searchsorted(at, twos).astype(np.int32)[pair], sizes)

    @staticmethod
    def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values in order, and the place of each value among them."""
        order = np.argsort(values).astype(np.int32)
        values = values[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        place = np.empty(len(values), np.int32)
        place[order] = np.cumsum(new, dtype=np.int32) - 1
        return values[new], place

    def counts(self, mine: np.ndarray) -> np.ndarray:
        """Count of each key in the words chosen; what is before a row's first word counts too."""
        start = self.before[:1] if len(self.before) else np.empty(0, np.int64)
        out = np.bincount(self.word[mine], minlength=len(self.at)) + np.bincount(self.pair[mine], minlength=len(self.at))
        out[start] += (self.before[mine] == start).sum()
        return out


_CODEC = pa.Codec("zstd", compression_level=1)      # most bytes of counts are 0 or 1, which Spark's lz4 hardly shrinks


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _large(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _numbers(x) -> bytes:
    return _small(W.planes(np.ascontiguousarray(x, np.int64)))


def _read(data: bytes) -> np.ndarray:
    return W.unplanes(_large(data), np.int64)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def _count(ranges: int):
    shift = np.uint64(64 - ranges.bit_length() + 1)

    def run(batches):
        """Distinct keys and counts of each chunk by range, and its numbers of words."""
        for chunk, parts in _groups(batches, "chunk"):
            ids = pa.chunked_array([p.filter(pc.equal(p.column("kind"), 0)).column("id") for p in parts])
            rows = [p.filter(pc.equal(p.column("kind"), 1)) for p in parts]
            rows = [p for p in rows if p.num_rows]
            if not rows:
                continue
            own = Chunk.of(rows)
            chosen = np.concatenate([pc.is_in(p.column("id"), value_set=ids.combine_chunks(), skip_nulls=True).to_numpy(zero_copy_only=False)
                                     for p in rows])
            counted = np.repeat(np.concatenate([np.asarray(p.column("counted")) for p in rows]), own.sizes)
            chosen = counted & np.repeat(chosen, own.sizes)
            wanted = any(pc.any(p.column("scored")).as_py() for p in rows)
            target, background = own.counts(chosen), own.counts(counted)
            yield _rows(_PACKET, [(chunk, _TOTALS, wanted, b"", _numbers([chosen.sum()]), _numbers([counted.sum()]))])
            cuts = np.searchsorted(own.at >> shift, np.arange(ranges + 1, dtype=np.uint64))
            packets = [(chunk, r, wanted, _small(W.pack(own.at[a:b])), _numbers(target[a:b]), _numbers(background[a:b]))
                       for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
            if packets:
                yield _rows(_PACKET, packets)

    return run


def _reply(batches):
    """To each chunk, the other half's sums of the keys it sent."""
    for r, parts in _groups(batches, "range"):
        packets = [x for p in parts for x in zip(*(p.column(c).to_pylist() for c in ("chunk", "wanted", "at", "target", "background")), strict=True)]
        # the numbers of words are summed under one key
        at = [np.zeros(1, np.uint64) if r == _TOTALS else W.unpack(_large(x[2]), np.uint64) for x in packets]
        ends = np.cumsum([len(x) for x in at])
        distinct, place = np.unique(np.concatenate(at), return_inverse=True)
        sums = np.zeros((2, 2, len(distinct)), np.int64)
        for (chunk, _, _, target, background), end, x in zip(packets, ends, at, strict=True):
            mine = place[end - len(x):end]      # distinct in a packet
            sums[chunk % 2, 0, mine] += _read(target)
            sums[chunk % 2, 1, mine] += _read(background)
        for (chunk, wanted, *_), end, x in zip(packets, ends, at, strict=True):
            if wanted:
                target, background = sums[1 - chunk % 2][:, place[end - len(x):end]]
                yield _rows(_REPLY, [(chunk, r, _numbers(target), _numbers(background))])


def _score(rows: pa.Table, sent: pa.Table) -> pa.Table:
    """Documents of a chunk, scored by the sums that were sent to it."""
    kind = rows.schema.field("id").type
    rows = [p for p in (x.filter(x.column("scored")) for x in rows.to_batches()) if p.num_rows]
    if not rows:
        return pa.schema([("id", kind), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss", "score"))]).empty_table()
    own, loss = Chunk.of(rows), []
    sent = sent.sort_by("range")
    counts = [np.concatenate([_read(x) for x in sent.column(c).to_pylist()]) for c in ("target", "background")]
    if len(counts[0]) != len(own.at) + 1:
        raise RuntimeError(f"a chunk has {len(own.at)} keys and sums of {len(counts[0]) - 1}")
    words = counts[0][0]
    for n, c in ((x[0], x[1:]) for x in counts):
        c = c * (words / n if n else 1.0)
        p = (c[own.word] + 1.0) / (words + UNIGRAMS)
        p *= K
        p += c[own.pair]
        p /= c[own.before] + K
        loss.append(-np.log(p))
    first = np.concatenate([[0], np.cumsum(own.sizes)])
    sums = np.hstack([np.zeros((2, 1)), np.cumsum(loss, axis=1)])
    means = (sums[:, first[1:]] - sums[:, first[:-1]]) / np.maximum(own.sizes, 1)
    return pa.table({"id": pa.chunked_array([p.column("id") for p in rows]), "n_tokens": pa.array(own.sizes, pa.int64()),
                     "target_loss": means[0], "background_loss": means[1], "score": means[0] - means[1]})


def _half(id_: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(id_, F.lit("lm")), F.lit(2)), F.lit(0)).cast("int")


@dataclass
class Models:
    """What is counted: documents (``id``, ``text``) and ids of the target among them (``id``)."""

    docs: DataFrame
    target: DataFrame


def fit(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Models of the documents whose ids are in ``target_ids`` (its first column)
    and of all documents; the counts are taken where they are needed."""
    kind = docs.schema[id_col].dataType
    ids = target_ids.select(F.col(target_ids.columns[0]).try_cast(kind).alias("id")).dropna().distinct()
    return Models(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), ids)


def score(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``target_loss``, ``background_loss`` (means) and ``score``."""
    kind = docs.schema[id_col].dataType
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    same = docs.sameSemantics(models.docs)
    if same:
        rows = docs.withColumns({"counted": F.lit(True), "scored": F.lit(True)})
    else:
        rows = models.docs.withColumns({"counted": F.lit(True), "scored": F.lit(False)}).unionByName(
            docs.withColumns({"counted": F.lit(False), "scored": F.lit(True)}))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(LEAST_CHUNKS // 2, -(-size // (2 * CHUNK_BYTES)))
    ranges = max(LEAST_RANGES, 1 << (size // RANGE_BYTES).bit_length())

    def dealt(x: DataFrame, counted: Column) -> DataFrame:
        # rows without id are no targets and needn't be together; others than the counted have chunks of their own
        place = F.pmod(F.xxhash64(F.lit("chunk"), "id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(chunks))
        place = place + F.when(counted, 0).otherwise(chunks)
        return x.withColumn("chunk", (2 * place + _half(F.col("id"))).cast("int"))

    ids = models.target.select("id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("counted"), F.lit(False).alias("scored"),
                               F.lit(0).alias("kind"))
    # chunks are counted and scored from one shuffle of the documents, as both sides below read all its columns
    placed = dealt(rows.withColumn("kind", F.lit(1)).unionByName(ids), F.col("counted")).repartition(2 * chunks, "chunk")
    sent = placed.sortWithinPartitions("chunk").mapInArrow(_count(ranges), _PACKET)
    got = sent.repartition(ranges // 2, "range").sortWithinPartitions("range").mapInArrow(_reply, _REPLY).repartition(2 * chunks, "chunk")
    return (placed.groupBy("chunk").cogroup(got.groupBy("chunk"))
            .applyInArrow(_score, f"id {kind.simpleString()}, n_tokens long, target_loss double, background_loss double, score double")
            .withColumnRenamed("id", id_col))
