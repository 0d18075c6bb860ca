"""Exact dedup with a static binary-fuse filter for every part of an immutable snapshot.

Texts are equal if they are identical after normalisation.  A store is a folder
of snapshots, one for each batch added, written once and never changed:

* ``classes``: the batch's distinct texts in buckets by digest (files that join
  on the digest without a shuffle), numbered within their digest;
* ``found``: those of them that an earlier snapshot holds, and where;
* ``filters``: binary-fuse filters of the digests that are new here, each of
  about ``KEYS`` digests, by hash of the digest;
* ``rows``: id, digest and class of every row of the batch;
* ``made``: written last; a snapshot without it doesn't exist.

Adding a batch: its rows are digested; texts that a task has seen already are
combined before the shuffle, and the rest meets by digest, where new duplicates
of the batch are grouped by digest and text.  The distinct digests are screened by
the filters of every earlier snapshot; filters are repeated where a batch has
many more digests than a snapshot, so each task holds about ``KEYS`` of both.
Positives (all that are there, and one in 256 others) join the exact buckets,
where the texts themselves are compared.  A class belongs to the first snapshot
that has it.

Of equal texts, the row of the smallest id stays: one row, also among repeated
rows; rows without id come after all others.  Null texts count as empty ones,
and these are equal to each other.  Different texts of one digest stay apart (rows of such
digests are assigned by text).  Very long texts are compared whole.  Other
columns are ignored; an empty table has an empty result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import shared_table
from . import words as W

KEYS = 1 << 15           # digests of a filter, about
BUCKET_BYTES = 32 << 20  # text of an exact bucket, about
MOST_BUCKETS = 50_000    # Spark takes 100,000 at most; beyond, buckets grow and are sorted on disk
HELD_BYTES = 32 << 20    # text that a task holds to combine repeated ones
FILTERS = "bucket long, seed int, segment int, segments int, table binary"


def one_space(text: Column) -> Column:
    """Each ``[\\x20\\x09-\\x0D]+`` as one space (single spaces are such already)."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


# ---------------------------------------------------------------- the filter

def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (in consecutive segments) and its fingerprint."""
    h = W.mix(keys, seed)
    g = W.mix(h, 99)
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ (g & mask)
    third = (first + np.uint64(2 * segment)) ^ ((g >> np.uint64(24)) & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64), (g >> np.uint64(56)).astype(np.uint8)


def fuse_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Seed, segment length, number of segments and table of a 3-wise binary-fuse filter.

    A slot with a single key gives that key a place of its own; with all such
    keys taken away other slots have a single key.  Keys are placed a round at a
    time, and assigned from the last round to the first.
    """
    keys = np.unique(keys)
    n = max(len(keys), 2)
    segment = 1 << max(2, min(18, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    slots = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(slots / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1000):
        at, fingerprint = _places(keys, seed, segment, segments)
        count = np.bincount(at.ravel(), minlength=size)
        total = np.bincount(at.ravel(), np.repeat(np.arange(len(keys), dtype=np.float64), 3), size).astype(np.int64)
        rounds, single = [], np.flatnonzero(count == 1)
        while len(single):
            key, where = np.unique(total[single], return_index=True)
            rounds.append((key, single[where]))
            touched = at[key].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(total, touched, np.repeat(key, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if sum(len(key) for key, _ in rounds) == len(keys):
            break
    else:
        raise RuntimeError("no seed gives a filter")
    table = np.zeros(size, np.uint8)
    for key, slot in reversed(rounds):
        table[slot] = fingerprint[key] ^ np.bitwise_xor.reduce(table[at[key]], axis=1)
    return seed, segment, segments, table


def may_hold(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    at, fingerprint = _places(keys, seed, segment, segments)
    return np.bitwise_xor.reduce(table[at], axis=1) == fingerprint


def _build(table: pa.Table) -> pa.Table:
    seed, segment, segments, slots = fuse_filter(np.asarray(table.column("key"), np.int64).view(np.uint64))
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "seed": pa.array([seed], pa.int32()),
                     "segment": pa.array([segment], pa.int32()), "segments": pa.array([segments], pa.int32()),
                     "table": pa.array([slots.tobytes()], pa.binary())})


def _screen(digests: pa.Table, filters: pa.Table) -> pa.Table:
    found = np.zeros(digests.num_rows, bool)
    if digests.num_rows and filters.num_rows:
        f = filters.slice(0, 1).to_pylist()[0]
        keys = np.asarray(digests.column("key"), np.int64).view(np.uint64)
        found = may_hold(keys, f["seed"], f["segment"], f["segments"], np.frombuffer(f["table"], np.uint8))
    return digests.select(["digest"]).filter(pa.array(found))


def _once(batches):
    """Rows without those whose digest and text this task has just seen."""
    held: dict[bytes, str] = {}
    size = 0
    for batch in batches:
        keep = []
        for i, (digest, text) in enumerate(zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            if held.get(digest) != text:
                keep.append(i)
                if digest not in held:
                    held[digest] = text
                    size += len(text) + 100
        if size > HELD_BYTES:
            held, size = {}, 0
        yield batch.take(pa.array(keep, pa.int64()))


# ---------------------------------------------------------------- the store

class ExactStore:
    """Snapshots of texts in ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str, normalise=one_space, digest=sha256):
        self.spark, self.path, self.normalise, self.digest = spark, path.rstrip("/"), normalise, digest
        self.tables: dict[int, str] = {}
        self.made: list[dict] = []
        made = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/made/_SUCCESS")
        if len(made.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(made) or ()):
            found = spark.read.schema("number int, buckets int, filters long").parquet(f"{self.path}/*/made")
            self.made = [r.asDict() for r in found.orderBy("number").collect()]    # a row for each batch

    def _at(self, number: int, name: str) -> str:
        return f"{self.path}/{number:05d}/{name}"

    def _read(self, number: int, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._at(number, name))

    def _classes(self, number: int) -> DataFrame:
        """(digest, ord, text) in buckets: a table of this session over a snapshot's files."""
        if number not in self.tables:
            name = f"exact_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (digest BINARY, ord INT, text STRING) USING parquet CLUSTERED BY (digest) "
                           f"INTO {self.made[number]['buckets']} BUCKETS LOCATION '{self._at(number, 'classes')}'")
            self.tables[number] = name
        return self.spark.table(self.tables[number])

    def _found(self, number: int) -> DataFrame:
        return self._read(number, "found", "digest binary, ord int, home int, home_ord int")

    def add(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Write the next snapshot."""
        k = len(self.made)
        docs = batch.select(batch[id_col].alias("id"), self.normalise(F.coalesce(batch[text_col], F.lit(""))).alias("text"))
        docs = docs.select("id", self.digest(F.col("text")).alias("digest"), "text")
        digested = docs.select("id", "digest", F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("row"))
        kind = f"id {docs.schema['id'].dataType.simpleString()}, digest binary, row long"
        digested.write.parquet(self._at(k, "digests"))
        digested = self._read(k, "digests", kind + ", bytes int")
        size = digested.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
        # with fewer than this setting, Spark would deal the buckets anew in joins
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST_BUCKETS, max(least, math.ceil(size / BUCKET_BYTES)))
        self._write_classes(docs.select("digest", "text"), k, buckets)
        self.made.append({"number": k, "buckets": buckets, "filters": 0})
        self._write_found(k)
        found = self._found(k)
        own = self._classes(k).select("digest", "ord").join(found, ["digest", "ord"], "left_anti")
        filters = self._write_filters(own.select("digest").distinct(), k)
        self._assign(docs, digested.drop("bytes"), found, k)
        self.made[k]["filters"] = filters
        done = self.spark.createDataFrame([(k, buckets, filters)], "number int, buckets int, filters long").coalesce(1)
        done.write.parquet(self._at(k, "made"))

    def _write_classes(self, texts: DataFrame, k: int, buckets: int) -> None:
        some = texts.mapInArrow(_once, "digest binary, text string").repartition(buckets, "digest").dropDuplicates(["digest", "text"])
        order = Window.partitionBy("digest").orderBy("text")
        name = f"exact_{uuid.uuid4().hex}"
        some.select("digest", (F.row_number().over(order) - 1).alias("ord"), "text").write.format("parquet") \
            .bucketBy(buckets, "digest").option("path", self._at(k, "classes")).saveAsTable(name)
        self.tables[k] = name

    def _write_found(self, k: int) -> None:
        """Classes of snapshot ``k`` that are in earlier ones, by their texts."""
        mine = self._classes(k)
        digests = mine.select("digest").distinct()
        number = digests.count() if k else 0
        hits = self.spark.createDataFrame([], "digest binary, ord int, home int, home_ord int")
        for j in range(k):
            if self.made[j]["filters"]:
                positive = self._screened(digests, number, j).hint("merge")
                there = self._classes(j).join(self._found(j).hint("merge"), ["digest", "ord"], "left_anti")
                there = there.select("digest", F.col("ord").alias("home_ord"), F.col("text").alias("their_text"))
                same = mine.join(positive, "digest", "left_semi").join(there.hint("merge"), "digest").filter("text = their_text")
                hits = hits.unionByName(same.select("digest", "ord", F.lit(j).alias("home"), "home_ord"))
        hits.write.parquet(self._at(k, "found"))

    def _screened(self, digests: DataFrame, number: int, j: int) -> DataFrame:
        n = self.made[j]["filters"]
        copies = max(1, math.ceil(number / (n * KEYS)))
        filters = self._read(j, "filters", FILTERS).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        key = F.xxhash64("digest")
        keys = digests.select("digest", key.alias("key"), F.pmod(key, F.lit(n)).alias("bucket"),
                              F.pmod(F.hash("digest"), F.lit(copies)).alias("copy"))
        return keys.groupBy("bucket", "copy").cogroup(filters.groupBy("bucket", "copy")).applyInArrow(_screen, "digest binary")

    def _write_filters(self, digests: DataFrame, k: int) -> int:
        number = digests.count()
        n = math.ceil(number / KEYS)
        key = F.xxhash64("digest")
        keys = digests.select(key.alias("key"), F.pmod(key, F.lit(max(1, n))).alias("bucket"))
        keys.groupBy("bucket").applyInArrow(_build, FILTERS).write.parquet(self._at(k, "filters"))
        return n

    def _assign(self, docs: DataFrame, digested: DataFrame, found: DataFrame, k: int) -> None:
        """(id, digest, row, home, ord): the class of each row of the batch."""
        several = self._classes(k).filter("ord = 1").select("digest")
        if several.isEmpty():
            rows = digested.withColumn("ord", F.lit(0))
        else:    # different texts of one digest: rows are assigned by text
            own = digested.hint("merge").join(several.hint("merge"), "digest", "left_anti").withColumn("ord", F.lit(0))
            odd = docs.join(several, "digest", "left_semi").join(self._classes(k), ["digest", "text"])
            odd = odd.select("id", "digest", (-1 - F.monotonically_increasing_id()).alias("row"), "ord")
            rows = own.select("id", "digest", "row", "ord").unionByName(odd)
        if k:
            rows = rows.hint("merge").join(found.hint("merge"), ["digest", "ord"], "left")
            rows = rows.select("id", "digest", "row", F.coalesce("home", F.lit(k)).alias("home"), F.coalesce("home_ord", "ord").alias("ord"))
        else:
            rows = rows.select("id", "digest", "row", F.lit(0).alias("home"), "ord")
        rows.write.parquet(self._at(k, "rows"))

    def rows(self) -> DataFrame:
        """Every row of every batch: id, digest, ``keep_id``, ``group_size`` and ``kept``."""
        if not self.made:
            raise ValueError("the store has no snapshot")
        parts = [self.spark.read.parquet(self._at(k, "rows")).withColumn("snapshot", F.lit(k)) for k in range(len(self.made))]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        own = F.struct(F.col("id").isNull().alias("last"), "id", "snapshot", "row")
        # a table of its own, so that the join can be split where a text has many copies
        groups = shared_table(every.groupBy("home", "digest", "ord").agg(F.count("*").alias("group_size"), F.min(own).alias("keeper")),
                              "exact-groups")
        out = every.hint("merge").join(groups.hint("merge"), ["home", "digest", "ord"])
        kept = (F.col("keeper.snapshot") == F.col("snapshot")) & (F.col("keeper.row") == F.col("row"))
        return out.select("id", "digest", F.col("keeper.id").alias("keep_id"), "group_size", kept.alias("kept"))


def exact_duplicates(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` as two batches in a new store at ``path``: the rows up to the median
    id (ids that aren't numbers: half of them, by hash) are a snapshot, against which
    the others are screened, and those without id."""
    store = ExactStore(df.sparkSession, path, **how)
    if isinstance(df.schema[id_col].dataType, NumericType):
        middle = df.agg(F.percentile_approx(id_col, 0.5)).first()[0]
        first = F.coalesce(df[id_col] <= F.lit(middle), F.lit(False))
    else:
        first = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0
    store.add(df.filter(first), id_col, text_col)
    store.add(df.filter(~first), id_col, text_col)
    return store.rows().withColumnRenamed("id", id_col)
