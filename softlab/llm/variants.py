"""Spelling variant grouping by blocked Gram matrices of letter counts.

Words are runs of Latin letters (lower-cased A-Z only), counted over all texts.
Two words are near if they differ by exactly one inserted, deleted or replaced
code point; then their lengths differ by one at most, and the squared distance
of their letter counts is two at most.

1. A word of length L stands in the length blocks L (with its equals and those
   one longer) and L - 1 (with those one shorter).  A block of length m is cut by
   the first ceil(m / 2) code points and, once more, by the last floor(m / 2):
   one edit leaves one of the two as it is, so near words meet, and a pair that
   meets in both counts where the beginnings are equal.
2. Blocks are dealt to tasks of about ``TASK_ROWS`` rows.  A block of more than
   ``PART`` words is dealt in parts, and each two parts meet in a task of their
   own.  In a task, the products of letter-count matrices give all squared
   distances of a tile; what is at two or less is verified on the letters.
3. A task returns, for each word, how many near words it met and the best of
   them; pairs are not returned.  These are summed by word.
4. A word's form has ten times its occurrences at least, so a path of forms has
   no more steps than the largest count has digits, and that many are followed
   by joining the table of forms with itself (each time twice as far).

No word, block or pair is left out.  A null or empty text has no words; a null
id counts as an empty one in the hash that edits runs; repeated rows count as
often as they occur; very long words are compared like others (in double
precision, where single would round).  Ties go to the first word in code point
order.  Other columns are ignored; an empty table has an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_table

LEAST_LENGTH = 7
RATIO = 10            # how many times a word's occurrences its form has at least
PART = 1 << 14        # words of a block that one task compares with each other
TASK_ROWS = 1 << 16   # rows of a task, about
TILE = 1 << 10        # rows of a matrix, in blocks of more than
SMALL = 1 << 8        # rows; blocks of fewer share a matrix
VERIFY = 1 << 22      # letters gathered at a time
EXACT32 = 1 << 11     # lengths whose squared sums single precision holds
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_slips(run: Column, id_col: Column, every: int = 31) -> Column:
    """``run`` without one code point, if the hash of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    less = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return F.when(h % every == 0, less).otherwise(run)


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited=with_slips,
                least: int = LEAST_LENGTH, occurrences: int = 2) -> DataFrame:
    """``word``, ``n``: words of ``least`` code points and more that occur often enough."""
    # a shorter run stays too short: an edit only takes code points away
    runs = F.regexp_extract_all(df[text_col], F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), 0)
    found = df.select(df[id_col].alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = found.select((edited(F.col("run"), F.col("id")) if edited else F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def _blocks(words: DataFrame, least: int) -> DataFrame:
    """(m, block, word, n): each word in its four blocks."""
    def two(m: Column) -> list[Column]:
        half = F.ceil(m / 2).cast("int")
        rest = m - half
        first = F.concat(m.cast("string"), F.lit("<"), F.col("word").substr(F.lit(1), half))
        last = F.concat(m.cast("string"), F.lit(">"), F.col("word").substr(F.length("word") - rest + 1, rest))
        return [F.struct(m.alias("m"), x.alias("block")) for x in (first, last)]

    own = F.length("word")
    places = F.array(*two(own), *two(own - 1))
    rows = words.select("word", "n", F.explode(places).alias("p"))
    return rows.filter(F.col("p.m") >= least).select("p.m", "p.block", "word", "n")


def near_words(words: DataFrame, least: int = LEAST_LENGTH, part: int = PART) -> DataFrame:
    """``word``, ``n_near``, ``near`` (the near word that occurs most) and its count ``near_n``."""
    rows = shared_table(_blocks(words, least), "variants-blocks")
    sizes = rows.groupBy("block").agg(F.count("*").alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / part).cast("int")
    met = rows.hint("merge").join(sizes, "block").withColumn("parts", parts)
    met = met.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda b: F.struct(F.least("part", b).alias("a"), F.greatest("part", b).alias("b")))
    met = met.select("m", "block", "word", "n", "part", F.explode(tasks).alias("t"))
    total = sizes.agg(F.sum(F.col("size") * parts)).first()[0] or 0
    lots = max(1, math.ceil(total / TASK_ROWS))
    met = met.select("m", "block", "word", "n", "part", "t.a", "t.b",
                     F.pmod(F.xxhash64("block", "t.a", "t.b"), F.lit(lots)).cast("int").alias("lot"))
    got = met.repartition(lots, "lot").groupBy("lot").applyInArrow(_compare, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    return got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def _compare(table: pa.Table) -> pa.Table:
    """Near words among the rows of each block of a task (of each two parts of it)."""
    table = table.combine_chunks()
    word = table.column("word").combine_chunks()
    size = np.asarray(pc.utf8_length(word), np.int64)
    # all letters are in Latin-1: one byte for each code point
    letters = np.frombuffer("".join(word.to_pylist()).encode("latin-1"), np.uint8)
    start = np.cumsum(size) - size
    m, n, part, a, b = (np.asarray(table.column(c), np.int64) for c in ("m", "n", "part", "a", "b"))
    place = np.empty(len(word), np.int64)
    place[np.asarray(pc.array_sort_indices(word))] = np.arange(len(word))
    block = np.asarray(table.column("block").combine_chunks().dictionary_encode().indices, np.int64)
    suffix = np.asarray(pc.match_substring(table.column("block").combine_chunks(), ">"), bool)
    order = np.lexsort((part, b, a, block, m))
    key = np.stack([block, a, b], axis=1)[order]
    edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(order)]])
    found = []
    i = 0
    while i < len(edge) - 1:
        j = i + 1
        if edge[j] - edge[i] <= SMALL:     # small blocks of one matrix
            j = max(int(np.searchsorted(edge, edge[i] + SMALL, side="right")) - 1, i + 1)
            tiles = [(order[edge[i]:edge[j]], None)]
        else:
            own = order[edge[i]:edge[j]]
            tiles = _tiles(own, part, a[own[0]] == b[own[0]])
        for x, y in tiles:
            for u, v in _candidates(letters, start, size, x, y):
                same = (block[u] == block[v]) & (a[u] == a[v]) & (b[u] == b[v]) & ((part[u] != part[v]) | (a[u] == b[u]))
                # the longer ones of a block meet each other in the next
                same &= np.minimum(size[u], size[v]) == m[u]
                found.append(_verified(letters, start, size, m, suffix, u[same], v[same]))
        i = j
    u, v = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    best = np.lexsort((place[v], -n[v], u))
    u, v = u[best], v[best]
    head = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])[:len(u)])
    counts = np.diff(np.concatenate([head, [len(u)]]))
    return pa.table({"word": word.take(pa.array(u[head])), "n_near": pa.array(counts, pa.int64()),
                     "near": word.take(pa.array(v[head])), "near_n": pa.array(n[v[head]], pa.int64())})


def _tiles(rows: np.ndarray, part: np.ndarray, within: bool):
    """Pairs of row ranges that cover a large block, or its two parts against each other."""
    if within:
        cuts = [rows[k:k + TILE] for k in range(0, len(rows), TILE)]
        return [(cuts[x], None if x == y else cuts[y]) for x in range(len(cuts)) for y in range(x, len(cuts))]
    low = part[rows] == part[rows].min()
    sides = [[s[k:k + TILE] for k in range(0, len(s), TILE)] for s in (rows[low], rows[~low])]
    return [(x, y) for x in sides[0] for y in sides[1]]


def _letter_counts(letters, start, size, rows, kind) -> np.ndarray:
    at = np.repeat(start[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(int(size[rows].sum()))
    row = np.repeat(np.arange(len(rows)), size[rows])
    return np.bincount(row * 256 + letters[at], minlength=len(rows) * 256).reshape(-1, 256).astype(kind)


def _candidates(letters, start, size, x, y):
    """Rows (u, v) whose letter counts are at a squared distance of two at most."""
    every = x if y is None else np.concatenate([x, y])
    kind = np.float32 if int(size[every].max()) < EXACT32 else np.float64
    counts = _letter_counts(letters, start, size, every, kind)
    counts = counts[:, counts.any(axis=0)]
    one = counts[:len(x)]
    two = one if y is None else counts[len(x):]
    gram = one @ two.T
    gram *= -2
    gram += (one * one).sum(axis=1)[:, None]
    gram += (two * two).sum(axis=1)[None, :]
    u, v = np.nonzero(gram <= 2)
    if y is None:
        u, v = u[u < v], v[u < v]
        yield x[u], x[v]
    else:
        yield x[u], y[v]


def _verified(letters, start, size, m, suffix, u, v) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those one edit apart that this block is to count."""
    swap = size[u] > size[v]
    u, v = np.where(swap, v, u), np.where(swap, u, v)
    good = np.zeros(len(u), bool)
    order = np.argsort(m[u], kind="stable")
    k = 0
    while k < len(order):
        # pairs of one length, as many as the letters allow
        length = int(m[u[order[k]]])
        stop = min(int(np.searchsorted(m[u[order]], length, side="right")), k + max(1, VERIFY // length))
        own = order[k:stop]
        p, q = u[own], v[own]
        step = np.arange(length)
        ahead = (letters[start[p][:, None] + step] == letters[start[q][:, None] + step])
        longer = (size[q] - size[p])[:, None]
        behind = (letters[start[p][:, None] + step] == letters[start[q][:, None] + longer + step])
        front = np.where(ahead.all(axis=1), length, (~ahead).argmax(axis=1))
        back = np.where(behind.all(axis=1), length, (~behind[:, ::-1]).argmax(axis=1))
        least = np.where(size[q] > size[p], length, length - 1)
        half = -(-length // 2)
        good[own] = (front + back >= least) & (~suffix[p] | (front < half)) & ((front < length) | (size[q] > size[p]))
        k = stop
    return u[good], v[good]


def variant_forms(words: DataFrame, ratio: int = RATIO, least: int = LEAST_LENGTH, part: int = PART) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form`` (null if no near word occurs ``ratio``
    times as often), ``form_n`` and ``root`` for each word of ``words`` (word, n)."""
    near = shared_table(near_words(words, least, part), "variants-near")
    linked = near.join(words, "word").filter(F.col("near_n") >= ratio * F.col("n"))
    forms = shared_table(linked.select("word", F.col("near").alias("form"), F.col("near_n").alias("form_n")), "variants-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps, roots = math.floor(math.log(most, ratio)), forms.select("word", F.col("form").alias("root"))
    while steps > 1:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = shared_table(roots.hint("merge").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
                             "variants-roots")
        steps = (steps + 1) // 2
    out = words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form",
                      F.coalesce("root", "word").alias("root"), "form_n")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited=with_slips) -> DataFrame:
    """Words of all texts with their forms and roots."""
    return variant_forms(shared_table(count_words(df, id_col, text_col, edited), "variants-words"))
