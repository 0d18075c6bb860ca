"""Benchmark decontamination with training suffix arrays.

Each shard of training text (a few MB of one partition) gets a suffix array
over its words: the word positions sorted by the words that follow, to the
depth of a window.  Positions whose first words begin no benchmark window are
left out; no match can start there.  Every benchmark suffix that holds a
window is then binary-searched in the array, word by word: the interval of
training suffixes that agree with it narrows until it is empty or the window
is matched; the interval's entries are the window's locations.  From there
each match is followed, word by word, to its longest verbatim length.

A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.  Words are compared by 64-bit hashes after
lower-casing A-Z.  Training text is not shuffled: shards are searched where
they are read, so a passage that a third of all documents hold is met in every
shard alike.  The benchmark is sent to every task, in blocks of
``BLOCK_BYTES`` of text, one pass over the documents for each block.

Null and empty texts have no words and no hits; items of null text have no
window.  Items without id are searched like others but not named.
Items of one text are searched once; of one id, count once.  Repeated document
rows give repeated results.  Other columns are carried along (``carry``) under
any names but the results'.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BLOCK_BYTES = 8 << 20     # benchmark text searched in one pass
_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())])
_STATE = "n_words long, n_hit long, hit binary, items array<string>, matches array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"


class Benchmark:
    """The words of a block of items and their windows' suffixes."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        owners: dict[str, set[str | None]] = {}
        for i, t in zip(ids, texts, strict=True):
            owners.setdefault(t, set()).add(i)
        words = W.Words(*W.text_buffer(pa.array(list(owners), pa.string())), W.ALNUM, lower=True)
        size = np.diff(words.first)
        self.owners = [sorted(o - {None}) for o in owners.values()]
        self.hash = words.hash
        self.stop = np.repeat(words.first[1:], size)           # end of each word's item
        self.item = words.rows
        self.start = words.first                               # first word of each item
        left = self.stop - np.arange(len(words))
        whole = np.repeat(size, size)
        self.suffix = np.flatnonzero((left >= window) | (left == whole))
        self.length = np.minimum(left, window)[self.suffix]    # words of the suffix's window
        self.depth = int(self.length.max(initial=0))
        self.lead = min(2, int(self.length.min(initial=2)))    # words by which training positions are chosen
        self.leads = np.unique(W.window_hash(self.hash, self.lead)[self.suffix])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.leads & np.uint64(0xFFFF)).astype(np.int64)] = True


class SuffixArray:
    """Training positions sorted by their next ``depth`` words."""

    def __init__(self, words: W.Words, bench: Benchmark):
        at, h = words.windows(bench.lead)
        near = bench.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
        at, h = at[near], h[near]
        place = np.minimum(np.searchsorted(bench.leads, h), len(bench.leads) - 1)
        at = at[bench.leads[place] == h]
        self.hash = words.hash
        self.stop = words.first[1:][np.searchsorted(words.first, at, side="right") - 1] if len(at) else at
        levels = [np.where(at + d < self.stop, words.hash[np.minimum(at + d, len(words) - 1)], np.uint64(0))
                  for d in range(bench.depth)]
        order = np.lexsort(levels[::-1]) if len(at) else np.empty(0, np.int64)
        self.at, self.stop = at[order], self.stop[order]
        self.levels = [x[order] for x in levels]

    def search(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """(place in the array, benchmark word) of every occurrence of a window."""
        low = np.zeros(len(bench.suffix), np.int64)
        high = np.full(len(bench.suffix), len(self.at), np.int64)
        for d in range(bench.depth):
            on = np.flatnonzero((high > low) & (bench.length > d))
            target = bench.hash[bench.suffix[on] + d]
            low_, high_ = low[on], high[on]
            low[on] = _bisect(self.levels[d], low_, high_, target, right=False)
            high[on] = _bisect(self.levels[d], low_, high_, target, right=True)
        n = np.maximum(high - low, 0)
        return W.ranges(low, n), np.repeat(np.arange(len(n)), n)


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, right: bool) -> np.ndarray:
    """``searchsorted`` of each target within its own [low, high)."""
    low, high = low.copy(), high.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        open_ = low < high
        mid = (low + high) // 2
        value = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((value <= target) if right else (value < target))
        low = np.where(up, mid + 1, low)
        high = np.where(open_ & ~up, mid, high)
    return low


def _longest(sa: SuffixArray, place: np.ndarray, bench: Benchmark, suffix: np.ndarray) -> np.ndarray:
    """Words that each match goes on for."""
    at, stop, own = sa.at[place], sa.stop[place], bench.suffix[suffix]
    length = bench.length[suffix].copy()
    on = np.arange(len(place))
    while len(on):
        p, q = at[on] + length[on], own[on] + length[on]
        on = on[(p < stop[on]) & (q < bench.stop[own[on]])]
        on = on[sa.hash[at[on] + length[on]] == bench.hash[own[on] + length[on]]]
        length[on] += 1
    return length


def search_shard(text: pa.Array, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """Words of each row; hit words (all rows); items with an occurring window, and
    each such item's longest match, by row."""
    words = W.Words(*W.text_buffer(text), W.ALNUM, lower=True)
    rows = len(words.first) - 1
    items: list[list[str]] = [[] for _ in range(rows)]
    matches: list[list[dict]] = [[] for _ in range(rows)]
    hit = np.zeros(len(words), bool)
    if bench.depth and len(words):
        sa = SuffixArray(words, bench)
        place, suffix = sa.search(bench)
        at = sa.at[place]
        hit = W.cover(at, bench.length[suffix], len(words))
        length = _longest(sa, place, bench, suffix)
        row = np.searchsorted(words.first, at, side="right") - 1
        item = bench.item[bench.suffix[suffix]]
        order = np.lexsort((at, -length, item, row))
        head = order[np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (item[order][1:] != item[order][:-1])])] \
            if len(order) else order
        for k in head.tolist():
            r, i = int(row[k]), int(item[k])
            for owner in bench.owners[i]:
                items[r].append(owner)
                matches[r].append({"item_id": owner, "doc_word": int(at[k] - words.first[r]), "n_words": int(length[k]),
                                   "item_word": int(bench.suffix[suffix[k]] - bench.start[i])})
    return np.diff(words.first), hit, items, matches


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int):
    """The benchmark on the driver, one block of about ``BLOCK_BYTES`` after another."""
    rows = benchmark.select(benchmark[item_col].cast("string").alias("i"), benchmark[text_col].alias("t")).dropna(subset=["t"])
    size = rows.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield Benchmark([r[0] for r in own], [r[1] for r in own], window), b == n - 1


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, ``n_words``, ``n_hit`` (words inside an occurrence of a
    window), ``items`` (ids with an occurring window, sorted as strings),
    ``matches`` (each item's longest verbatim match: where it is in the document
    and in the item, and its words; the first of equals) and ``contaminated``."""
    spark = docs.sparkSession
    carry = tuple(c for c in carry if c not in ("n_words", "n_hit", "items", "matches", "contaminated"))
    own = [docs[id_col].alias("_id"), *[docs[c].alias(f"_c{i}") for i, c in enumerate(carry)]]
    names = ["_id", *[f"_c{i}" for i in range(len(carry))]]
    rows = docs.select(*own, docs[text_col].alias("_text"))
    for block, last in blocks(benchmark, item_col, item_text_col, window):
        kept = names if last else [*names, "_text"]
        fixed = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in kept)
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(block), kept), f"{fixed}, {_STATE}")
    back = [F.col(n).alias(c) for n, c in zip(names, [id_col, *carry], strict=True)]
    return rows.select(*back, "n_words", "n_hit", "items", "matches", (F.col("n_hit") > 0).alias("contaminated"))


def _pass(block, names: list[str]):
    """One block's search over batches; joins what earlier blocks have found."""
    def run(batches):
        bench = block.value
        for batch in batches:
            for part in W.slices(batch, "_text"):
                counts, hit, items, matches = search_shard(part.column("_text"), bench)
                ends = np.cumsum(counts)
                hits = [np.packbits(hit[e - n:e]).tobytes() for e, n in zip(ends, counts, strict=True)]
                if "hit" in part.schema.names:
                    hits = [(np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()
                            for a, b in zip(hits, part.column("hit").to_pylist(), strict=True)]
                    items = [sorted({*a, *b}) for a, b in zip(items, part.column("items").to_pylist(), strict=True)]
                    matches = [a + b for a, b in zip(matches, part.column("matches").to_pylist(), strict=True)]
                else:
                    items = [sorted(set(x)) for x in items]
                n_hit = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in hits]
                yield pa.RecordBatch.from_pydict({n: part.column(n) for n in names} | {
                    "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit": pa.array(hits, pa.binary()),
                    "items": pa.array(items, pa.list_(pa.string())), "matches": pa.array(matches, pa.list_(_MATCH))})
    return run
