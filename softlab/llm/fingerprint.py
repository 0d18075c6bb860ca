"""Document fingerprints: a homomorphic multiset hash [native].

A text's units are its paragraphs (lines), cut into pieces of at most
``PIECE`` code points from the paragraph's start, so that documents of one
long paragraph share units too; blank lines have none.  Every unit is hashed
to a wide vector of ``LANES`` entries +1 or -1, and the fingerprint is the sum
of the vectors of all units modulo 2**16.  It follows that

* the order of paragraphs does not matter, equal multisets have equal sums;
* units can be inserted and deleted without the rest: ``insert`` and
  ``delete`` add and subtract fingerprints;
* the inner product of two fingerprints over ``LANES`` estimates how many
  units they share (standard error about sqrt(n1 * n2 / LANES)), and so
  ``likeness``, the cosine of both, tells edited copies from other texts.

Only DataFrame functions are used.  A lane counts one bit of the units' hash
words: four bits, 16 apart, of four 16-bit fields of a long are summed at a
time, ``FIELD`` units at a time, so no field runs over.

The fingerprint of a null or empty text (or of blank lines) is all zeros; two
such are alike to 1.0, one such and another to 0.0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 64           # code points of a unit at most
WORDS = 4            # 64-bit hash words of a unit
LANES = 64 * WORDS
FIELD = (1 << 15) - 1  # units summed before a 16-bit field could run over
_FIELDS = 0x0001000100010001


def units(text: Column) -> Column:
    """Paragraph pieces of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^\\n]{1,%d}" % PIECE), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """The lanes as an array of ``LANES / 4`` longs: long ``16 * w + b`` holds the
    sums modulo 2**16 of bits b, b + 16, b + 32, b + 48 of hash word w."""
    return _let(F.transform(units(text), lambda u: F.xxhash64(u)), _sums)


def _sums(h: Column) -> Column:
    """Lane sums of an array of unit hashes."""
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.transform(h, lambda x: F.xxhash64(x, w)))
    return F.flatten(F.transform(words, lambda v: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: _lane(v, b))))


def _lane(v: Column, bit: Column) -> Column:
    """2 * (units with the bit) - units, in four fields of a long."""
    n = F.size(v)

    def ones(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + F.call_function(
            "shiftrightunsigned", x, bit).bitwiseAND(F.lit(_FIELDS)))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / FIELD).cast("int"))
    many = F.aggregate(F.transform(blocks, lambda k: ones(F.slice(v, k * FIELD + 1, FIELD))),
                       F.lit(0).cast("long"), lambda a, b: _fields_add(a, b))
    return _let(F.when(n <= FIELD, ones(v)).otherwise(many),
                lambda c: _pack(*[2 * _field(c, k) - n for k in range(4)]))


def _field(x: Column, k: int) -> Column:
    return F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _pack(*fields: Column) -> Column:
    """Four numbers modulo 2**16 in one long."""
    low = [f.cast("long").bitwiseAND(F.lit(0xFFFF).cast("long")) for f in fields]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, 16 * k) for k, x in enumerate(low)])


def _fields_add(a: Column, b: Column, sign: int = 1) -> Column:
    return _pack(*[_field(a, k) + sign * _field(b, k) for k in range(4)])


def insert(fp: Column, other: Column) -> Column:
    """The fingerprint of the units of both."""
    return F.zip_with(fp, other, lambda a, b: _fields_add(a, b))


def delete(fp: Column, other: Column) -> Column:
    """The fingerprint without the units of ``other``."""
    return F.zip_with(fp, other, lambda a, b: _fields_add(a, b, -1))


def as_hex(fp: Column) -> Column:
    """The fingerprint as a string."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _signed(x: Column, k: int) -> Column:
    """Field k as a number from -2**15 to 2**15 - 1."""
    return F.shiftright(F.shiftleft(x, 48 - 16 * k), 48)


def _inner(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: reduce(lambda p, q: p + q,
                                                 [_signed(x, k) * _signed(y, k) for k in range(4)]))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda s, t: s + t)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two fingerprints, 1 for equal ones."""
    size = F.sqrt(_inner(a, a).cast("double") * _inner(b, b).cast("double"))
    return (F.when(a == b, F.lit(1.0)).when(size == 0, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _inner(a, b) / size))))


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``df`` with its fingerprints; one narrow pass, nothing is shuffled."""
    return df.withColumn(out_col, fingerprint(df[text_col]))


def with_next(df: DataFrame, id_col: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``next``: the row after it in ascending ``id_col`` (after the
    last: the first) as a struct of its columns.  Null ids come first; rows of
    one id in the order of their other columns.

    A window runs in each of ``buckets`` ranges of ids.  The first row of each
    range also goes to the range before it, as what comes next there.  Bounds
    and first ids, one of each per range, pass the driver; rows don't.  (Rows
    of one id have no bound between them: an id held by very many rows makes
    its range long.)
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(df[id_col].cast("long"), F.lit(-2**63))
    keyed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), key.alias("key"))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = sorted(set(keyed.agg(F.percentile_approx("key", shares, 5 * buckets)).first()[0] or []))
    dealt = keyed.withColumn("bucket", _rank(F.col("key"), bounds))
    first = {r[0]: r[1] for r in dealt.groupBy("bucket").agg(F.min("key")).collect()}
    order = sorted(first)
    ahead = {b: order[i - 1] for i, b in enumerate(order)}
    here = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    there = F.struct(_lookup(F.col("bucket"), ahead, "int").alias("bucket"), F.lit(True).alias("guest"))
    is_first = F.col("key") == _lookup(F.col("bucket"), first, "long")
    dealt = dealt.select("row", "key", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    window = Window.partitionBy("to.bucket").orderBy("to.guest", "key", F.to_json("row"))
    return (dealt.withColumn("next", F.lead("row").over(window)).filter(~F.col("to.guest"))
            .select("row.*", "next"))


def _rank(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= key, by halving."""
    if not bounds:
        return F.lit(0)
    known = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0),
                       lambda at, s: F.when((at + s <= len(bounds)) & (F.get(known, at + s - 1) <= key), at + s).otherwise(at))


def _lookup(x: Column, table: dict, kind: str) -> Column:
    if not table:
        return F.lit(None).cast(kind)
    pairs = [c for k, v in table.items() for c in (F.lit(k), F.lit(v).cast(kind))]
    return F.element_at(F.create_map(*pairs), x)


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """id, ``n_chars``, ``edited`` (the last floor(n_chars / 4) code points replaced
    by the first as many, or all, of the next document), the fingerprints of
    text, edited text and next text, and the likeness of the first to each."""
    own = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    pairs = with_next(fingerprints(own, "text", "fp"), "id", buckets)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    texts = pairs.select(F.col("id"), n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"),
                         F.concat(F.left(F.col("text"), n - cut), F.left(F.col("next.text"), cut)).alias("edited"))
    return fingerprints(texts, "edited", "edited_fp").select(
        F.col("id").alias(id_col), "n_chars", "edited", "fp", "edited_fp", "next_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
