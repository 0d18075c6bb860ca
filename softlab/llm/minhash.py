"""MinHash near-dedup: an inverted join of signature coordinates.

A document's set is its distinct ``shingle``-word shingles (lower-cased A-Z);
with fewer words, the whole sequence as one; without words, none.  Documents
are linked where 100 * intersection >= ``percent`` * union, and a component's
smallest id stays.

1. Documents of one set are one class, with a number and the text of its
   smallest id.
2. A class has a signature of ``COORDINATES`` minima, and is posted under each
   coordinate-value pair.  Sets of similarity 0.8 agree in ``MATCHES`` of 48
   coordinates or more but for one pair in two million.  Such a pair also
   meets in one of both classes' ``PREFIX`` rarest postings, whatever the
   others are; so the longest lists are skipped, and matches in them are
   counted only for pairs found in the short ones, from the signatures.
3. A posting list is not joined with itself.  First each class meets the
   list's smallest class only; the one with which it collides most is
   confirmed, and what is linked so is one component.  Pairs that agree in half
   of ``MATCHES`` make *families*, wider than components.
4. What may still be linked are different components.  In a family that holds
   several, every class outside its largest component is compared with all
   others, in blocks of ``BLOCK`` classes: a task counts the common shingles
   of two blocks as one product of matrices and returns links that connect the
   same components, fewer than it has classes, so no pair is made, and members of the largest component (of a
   large group of copies, nearly all) aren't compared with each other.
   Classes of different families that meet in a list are compared by pairs,
   in lists that hold several families, where they agree in ``MATCHES``.
   Nothing is left out: no list is cut and no pair sampled.
5. Every link is confirmed on the full sets of both texts.

Null and empty texts have no shingles and stay alone.  Rows of one id and
different texts are different classes that are linked as one document.  A row
without id stays alone.  Ids of any type that has an order.  Very long texts
are compared whole.  Other columns are ignored; an empty table has an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from . import words as W
from .graph import components, stars

COORDINATES, MATCHES = 48, 24
PREFIX = COORDINATES - MATCHES + 1
BLOCK = 512       # classes of a block, or fewer:
SHINGLES = 1 << 20    # of about so many shingles
COLUMNS = 4096    # shingles in a matrix at a time

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted in each, and the n + 1 offsets."""
    words = W.Words(*W.text_buffer(text), W.NOT_BLANK, lower=True)
    n = len(words.first) - 1
    at, h = words.windows(k)
    row = words.rows[at]
    size = np.diff(words.first)
    for m in range(1, k):
        short = np.flatnonzero(size == m)
        if len(short):
            h = np.concatenate([h, W.window_hash(words.hash, m)[words.first[short]]])
            row = np.concatenate([row, short])
    order = np.argsort(h)
    kind = np.uint16 if n < 1 << 16 else np.int64     # 16 bits are sorted by radix
    order = order[np.argsort(row[order].astype(kind), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posting keys (rows x coordinates) and two 64-bit sums of each set that isn't empty."""
    start = first[:-1][np.diff(first) > 0]
    keys = np.empty((len(start), COORDINATES), np.uint64)
    for j in range(COORDINATES):
        x = (h ^ _XOR[j]) * _MULTIPLY[j]
        x ^= x >> np.uint64(32)
        low = np.minimum.reduceat(x * _MULTIPLY[j - 1], start) >> np.uint64(32)
        keys[:, j] = W.mix(low | (np.uint64(j + 1) << np.uint64(40)))
    sums = np.stack([np.add.reduceat(W.mix(h, s), start) for s in (11, 12)], axis=1)
    return keys.view(np.int64), sums.view(np.int64)


def _sign(k: int):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                h, first = shingle_sets(part.column("text"), k)
                size = np.diff(first)
                some = size > 0
                keys = np.zeros((len(size), COORDINATES), np.int64)
                sums = np.zeros((len(size), 2), np.int64)
                if some.any():
                    keys[some], sums[some] = signatures(h, first)
                at = pa.array(np.arange(len(size) + 1, dtype=np.int32) * COORDINATES)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "h": part.column("h"), "n_shingles": pa.array(size, pa.int64()), "a": pa.array(sums[:, 0].copy()),
                    "b": pa.array(sums[:, 1].copy()), "keys": pa.ListArray.from_arrays(at, pa.array(keys.reshape(-1)))})
    return run


def _confirm(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "x_text", W.SLICE_BYTES // 2):
                one, one_at = shingle_sets(part.column("x_text"), k)
                two, two_at = shingle_sets(part.column("y_text"), k)
                good = []
                for i in range(part.num_rows):
                    p, q = one[one_at[i]:one_at[i + 1]], two[two_at[i]:two_at[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_pydict({"u": part.column("x"), "v": part.column("y"), "linked": pa.array(good)})
    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    percent: int = 80) -> DataFrame:
    """id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and
    ``kept`` (whether that is the row's own)."""
    if percent < 80:
        raise ValueError("COORDINATES and MATCHES are chosen for similarities of 0.8 and more")
    docs = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("h"), df[text_col].alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    signed = shared_table(docs.mapInArrow(_sign(shingle), f"id {kind}, h long, n_shingles long, a long, b long, keys array<long>"),
                          "minhash-signatures")
    # classes and their numbers: a table of its own, so that joins with it can be split where a class has many copies
    full = signed.filter("n_shingles > 0 and id is not null")
    made = full.groupBy("a", "b", "n_shingles").agg(F.min(F.struct("id", "h")).alias("m"), F.first("keys").alias("keys"))
    reps = shared_table(made.select(F.monotonically_increasing_id().alias("rep"), "a", "b", F.col("n_shingles").alias("size"),
                                    F.col("m.id").alias("least"), F.col("m.h").alias("h"), "keys"), "minhash-classes")
    posted = shared_table(_prefixes(reps), "minhash-postings")
    # texts of the classes that may be linked: read from here on instead of all
    # (merge joins at every size: plans that broadcast small tables would grow unevenly)
    some = reps.select("rep", F.col("least").alias("id"), "h").join(posted.select("rep").distinct().hint("merge"), "rep", "left_semi")
    texts = docs.join(some.hint("merge"), ["id", "h"]).select(F.col("rep").alias("id"), "text")
    texts = shared_table(texts.dropDuplicates(["id"]), "minhash-texts")
    tried = shared_table(_agreeing(_stars(posted), reps, MATCHES // 2), "minhash-stars")
    links = _confirmed(tried.filter(F.col("n") >= MATCHES), texts, shingle, percent).unionByName(_one_document(full, reps))
    # components (even nodes) and families (odd nodes) are found in one pass
    wide = tried.select((F.col("x") * 2 + 1).alias("u"), (F.col("y") * 2 + 1).alias("v"))
    both = components(shared_table(links.select((F.col("u") * 2).alias("u"), (F.col("v") * 2).alias("v")).unionByName(wide), "minhash-links"))
    both = both.select(F.shiftright("node", 1).alias("node"), F.shiftright("root", 1).alias("root"), (F.col("node") % 2).alias("wide"))
    found, families = both.filter("wide = 0").drop("wide"), both.filter("wide = 1").drop("wide")
    places = _places(posted, found, families, reps)
    across = _confirmed(_across(posted, places, reps), texts, shingle, percent)
    more = shared_table(_within(places, texts, shingle, percent).unionByName(across), "minhash-links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    names = shared_table(_components(found, reps), "minhash-components")
    own = signed.select("id", "n_shingles", "a", "b")
    out = own.hint("merge").join(names.hint("merge"), ["a", "b", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _one_document(full: DataFrame, reps: DataFrame) -> DataFrame:
    """(u, v): classes of one id, to the first of them."""
    kind = F.struct("a", "b", "n_shingles")
    several = full.groupBy("id").agg(F.min(kind).alias("x"), F.max(kind).alias("y")).filter("x <> y").select("id")
    classes = reps.select("rep", "a", "b", F.col("size").alias("n_shingles"))
    own = full.select("id", "a", "b", "n_shingles").join(several, "id").distinct().join(classes, ["a", "b", "n_shingles"])
    first = own.groupBy("id").agg(F.min("rep").alias("v"))
    return own.select("id", F.col("rep").alias("u")).join(first, "id").filter("u <> v").select("u", "v")


def _components(found: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, n_shingles, component): every class with the smallest id of its component."""
    least = reps.select(F.col("rep").alias("node"), "least")
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    of = members.join(least, "node").groupBy("root").agg(F.min("least").alias("component"))
    named = members.join(of, "root").select(F.col("node").alias("rep"), "component")
    return reps.select("rep", "a", "b", F.col("size").alias("n_shingles"), "least").join(named, "rep", "left") \
        .select("a", "b", "n_shingles", F.coalesce("component", "least").alias("component"))


def _prefixes(reps: DataFrame) -> DataFrame:
    """(rep, key): the postings in each class's ``PREFIX`` rarest that others share."""
    postings = reps.select("rep", F.explode("keys").alias("key"))
    often = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = postings.join(often, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("p"))
    # those that no other class shares are the rarest and come first
    room = F.size("p") - (COORDINATES - PREFIX)
    return shared.filter(room > 0).select("rep", F.explode(F.slice("p", 1, room)).alias("p")).select("rep", "p.key")


def _stars(posted: DataFrame) -> DataFrame:
    """(x, y): each class and, of its lists' smallest classes, the one it meets in
    most lists (the smallest of equals)."""
    lists = posted.groupBy("key").agg(F.min("rep").alias("y"))
    met = posted.join(lists, "key").filter("rep <> y").groupBy("rep", "y").agg(F.count("*").alias("n"))
    best = met.groupBy("rep").agg(F.max(F.struct("n", (-F.col("y")).alias("m"))).alias("b"))
    return best.select(F.col("rep").alias("x"), (-F.col("b.m")).alias("y"))


def _agreeing(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(x, y, n): pairs whose signatures agree in n >= ``least`` coordinates."""
    one = reps.select(F.col("rep").alias("x"), F.col("keys").alias("x_keys"))
    two = reps.select(F.col("rep").alias("y"), F.col("keys").alias("y_keys"))
    n = F.size(F.array_intersect("x_keys", "y_keys"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", n.alias("n")).filter(F.col("n") >= least)


def _places(posted: DataFrame, found: DataFrame, families: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, size, c, g): shingles, component and family of each class that shares a posting."""
    own = reps.select("rep", "size").join(posted.select("rep").distinct(), "rep")
    out = (own.join(found.select(F.col("node").alias("rep"), F.col("root").alias("c")), "rep", "left")
           .join(families.select(F.col("node").alias("rep"), F.col("root").alias("g")), "rep", "left"))
    return shared_table(out.select("rep", "size", F.coalesce("c", "rep").alias("c"), F.coalesce("g", "rep").alias("g")), "minhash-places")


def _within(places: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): components of one family that are linked."""
    # a class weighs by its number or its shingles, in blocks
    weight = F.greatest(F.lit(1 / BLOCK), F.col("size") / F.lit(SHINGLES))
    sizes = places.groupBy("g", "c").agg(F.sum(weight).alias("k"))
    open_ = sizes.groupBy("g").agg(F.count("*").alias("cs"), F.sum("k").alias("n"), F.max(F.struct("k", "c")).alias("m")).filter("cs > 1")
    # a table of its own, so that the join can be split where a family has many classes
    open_ = shared_table(open_.select("g", "n", F.col("m.k").alias("top"), F.col("m.c").alias("big")), "minhash-families")
    rows = places.hint("merge").join(open_.hint("merge"), "g")
    rows = rows.withColumn("out", F.col("c") != F.col("big"))
    # families of less than a block share one: they are told apart in the task
    few = F.col("n") <= 1
    some = F.lit(max(1, math.ceil(rows.filter(few).agg(F.sum(weight)).first()[0] or 0)))
    outs, tops = (F.ceil(n).cast("long") for n in (F.greatest(F.lit(0.001), F.col("n") - F.col("top")), F.col("top")))
    at = F.pmod(F.xxhash64("rep"), F.when(F.col("out"), outs).otherwise(tops))
    rows = rows.withColumns({"at": at, "outs": outs, "tops": tops})

    def key(kind: str, a, b):
        return F.struct(F.when(few, F.lit("few")).otherwise(F.lit(kind)).alias("kind"),
                        F.when(few, F.pmod(F.xxhash64("g"), some)).otherwise(F.col("g")).alias("g"), a.alias("a"), b.alias("b"))
    zero = F.lit(0).cast("long")
    with_outs = F.transform(F.sequence(zero, F.col("outs") - 1), lambda b: key("outs", F.least(F.col("at"), b), F.greatest(F.col("at"), b)))
    with_tops = F.transform(F.sequence(zero, F.col("tops") - 1), lambda b: key("tops", F.col("at"), b))
    of_tops = F.transform(F.sequence(zero, F.col("outs") - 1), lambda a: key("tops", a, F.col("at")))
    tasks = F.when(few, F.array(key("few", zero, zero))).when(F.col("out"), F.concat(with_outs, with_tops)).otherwise(of_tops)
    rows = rows.select("rep", "c", "g", F.explode(tasks).alias("task"))
    rows = rows.hint("merge").join(texts.withColumnRenamed("id", "rep"), "rep").select("task.kind", F.col("task.g").alias("family"), "task.a", "task.b", "rep", "c", "g", "text")
    found = rows.groupBy("kind", "family", "a", "b").applyInArrow(_compare(shingle, percent), "u long, v long")
    return found.distinct()


def _compare(k: int, percent: int):
    """Links between different components of a family among the classes of one or two blocks."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep").combine_chunks()
        sets = [shingle_sets(part.column("text"), k) for part in W.slices(table, "text")]
        h = np.concatenate([x[0] for x in sets])
        size = np.concatenate([np.diff(x[1]) for x in sets])
        rep, c, g = (np.asarray(table.column(n)) for n in ("rep", "c", "g"))
        row = np.repeat(np.arange(len(size)), size)
        # rows of one id and different texts are one document: their sets are compared one by one
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])[:len(h)]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1 if len(h) else np.empty(0, bool)
        row, column = row[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1]
        both = np.zeros((len(size), len(size)), np.float32)
        for low in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            own = (column >= low) & (column < low + COLUMNS)
            m = np.zeros((len(size), COLUMNS), np.float32)
            m[row[own], column[own] - low] = 1
            both += m @ m.T
        total = size[:, None] + size[None, :]
        a, b = np.nonzero((100 * both >= percent * (total - both)) & (c[:, None] > c[None, :]) & (g[:, None] == g[None, :]) & (both > 0))
        return pa.Table.from_batches([stars([(c[a], c[b])])])     # as many links as connect the same, not one per pair
    return run


def _across(posted: DataFrame, places: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, y): pairs of different families that meet in a list and agree in
    ``MATCHES``.  In each list the classes outside its largest family meet all others."""
    rows = posted.join(places.select("rep", "g"), "rep")
    sizes = rows.groupBy("key", "g").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "g")).alias("m")).filter("k > 1")
    rows = rows.join(mixed.select("key", F.col("m.g").alias("big")), "key").join(reps, "rep")
    small = rows.filter("g <> big").select("key", F.col("rep").alias("x"), F.col("g").alias("xg"), F.col("keys").alias("x_keys"))
    near = ((F.col("g") != F.col("xg")) & ((F.col("g") == F.col("big")) | (F.col("x") < F.col("rep")))
            & (F.size(F.array_intersect("x_keys", "keys")) >= MATCHES))
    pairs = small.join(rows, (small["key"] == rows["key"]) & near)
    return pairs.select(F.greatest("x", "rep").alias("x"), F.least("x", "rep").alias("y")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v): the pairs that are linked, by their full sets."""
    one = texts.select(F.col("id").alias("x"), F.col("text").alias("x_text"))
    two = texts.select(F.col("id").alias("y"), F.col("text").alias("y_text"))
    got = pairs.select("x", "y").hint("merge").join(one, "x").hint("merge").join(two, "y")
    return got.select("x", "y", "x_text", "y_text").mapInArrow(_confirm(shingle, percent), "u long, v long, linked boolean") \
        .filter("linked").select("u", "v")
