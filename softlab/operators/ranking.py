"""Ranks without a global window (W1–W7, N1/N4/N13 building blocks).

A global ``Window.orderBy`` sends every row to one task.  Everything here is
two-level instead:

1. pre-aggregate (``groupBy(score)``: heavy ties collapse map-side), or work
   on a hash whose prefix spreads rows uniformly;
2. cut the ordered domain into contiguous chunks and total each chunk.  Scores:
   the distinct scores are dealt by range (Spark samples the cuts), so chunks
   follow the data wherever scores lie; they are written once with their
   chunk's number, and the input is read once.  Hashes: 65,536 prefixes;
3. chunk offsets from that bounded table, broadcast back (size proven by
   construction), plus a window *inside* one chunk.

``prefix_table``   cumulative sums over distinct scores (AUC, AP, ranks).
``exact_quantiles``  order statistics from the running counts.
``hash_rank``      exact 0-based row rank by a hex hash, per group.
``take_smallest``  the n smallest hashes per group; only the boundary chunk
                   of each group is ranked, every other row is kept or
                   dropped by a chunk-level decision.

A null group is a group like others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_table
from .common import scalar_of

ColumnOrName = Column | str
HASH_PREFIX = 4          # hex chars -> 65,536 chunks (~1.5 GB per chunk at 100 TB)


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bounded(df: DataFrame, grouped: bool) -> DataFrame:
    """Broadcast a chunk table only when its size is proven: without group
    columns it has at most ``chunks`` rows.  Per-group chunk tables grow
    with the group count, so they are left to the planner (AQE broadcasts
    them at runtime only if they turn out small)."""
    return df if grouped else F.broadcast(df)


def by_range(distinct: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``distinct`` dealt to ranges of ``order``, written to the shared folder with the
    number of the range in ``out``: a chunk each for the prefix scan.

    As many ranges as shuffle partitions; numbers rise with the order, and as
    they are in the table, no later plan or retry can see other ranges."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared_table(distinct.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()), "scores")


def prefix_table(df: DataFrame, score: str, sums: dict[str, Column], descending: bool = True,
                 group_cols: Sequence[str] = (), carried: dict[str, Column] | None = None) -> DataFrame:
    """Distinct-score table with cumulative sums in score order.

    Output: group cols, ``score``, each sum ``k``, ``k_through`` (inclusive
    cumulative) and ``k_before`` (exclusive), and ``carried`` aggregates of the
    score that aren't accumulated.  The input is read once."""
    gcols = list(group_cols)
    names, others = list(sums), list(carried or {})
    g = df.groupBy(*gcols, _c(score).alias("score")).agg(*[v.alias(k) for k, v in {**sums, **(carried or {})}.items()])
    g = by_range(g, [*gcols, "score"], "_chunk")
    totals = g.groupBy(*gcols, "_chunk").agg(*[F.sum(k).alias(f"_t_{k}") for k in names])
    order = F.col("_chunk").desc() if descending else F.col("_chunk").asc()
    # bounded: a row per chunk, and one more for every group
    w_off = Window.partitionBy(*gcols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in gcols], F.col("_chunk").alias("_g__chunk"), *[
        F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}") for k in names])
    s_order = F.col("score").desc() if descending else F.col("score").asc()
    w_in = Window.partitionBy(*gcols, "_chunk").orderBy(s_order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _on_group(g, _bounded(offsets, bool(gcols)), [*gcols, "_chunk"])
    out = joined.select(*gcols, "score", *names, *others, *[
        (F.col(f"_o_{k}") + F.sum(k).over(w_in)).alias(f"{k}_through") for k in names])
    return out.select(*gcols, "score", *names, *others, *[F.col(f"{k}_through") for k in names],
                      *[(F.col(f"{k}_through") - F.col(k)).alias(f"{k}_before") for k in names])


def _on_group(rows: DataFrame, table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, whose columns ``_g_<col>`` name the
    group (null is a group too) and go."""
    same = reduce(and_, [rows[c].eqNullSafe(table[f"_g_{c}"]) for c in cols])
    return rows.join(table, same).drop(*[f"_g_{c}" for c in cols])


def exact_quantiles(df: DataFrame, value: ColumnOrName, qs: Sequence[float], out: str = "q",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """A row (a group) with ``out``: the exact linearly interpolated quantiles ``qs``
    of a number, several at once (all null for a group without numbers).

    A quantile lies between the order statistics floor and ceil of q (n - 1);
    these are the distinct values whose running counts hold them, so all that
    any task holds is a range of the distinct values."""
    gcols = list(group_cols)
    v = _c(value).cast("double")
    pt = prefix_table(df.filter(v.isNotNull()), v, {"_n": F.count(F.lit(1))}, descending=False, group_cols=gcols)
    total = df.groupBy(*gcols).agg(F.count(v).alias("_total"))
    if gcols:
        total = total.select(*[F.col(c).alias(f"_g_{c}") for c in gcols], "_total")
        rows = _on_group(pt, total, gcols)
    else:
        rows = pt.withColumn("_total", scalar_of(total).getField("_total"))

    def place(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_total") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_n_before") <= rank) & (rank < F.col("_n_through")), F.col("score")))

    ends = [at(to(place(q))).alias(f"_{k}{i}") for i, q in enumerate(qs) for k, to in (("l", F.floor), ("h", F.ceil))]
    got = rows.groupBy(*gcols).agg(F.max("_total").alias("_total"), *ends)
    values = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (place(q) - F.floor(place(q))) for i, q in enumerate(qs)]
    return got.select(*gcols, F.array(*values).alias(out))


def value_ranks(df: DataFrame, col: str, out: str, weight: Column | None = None) -> DataFrame:
    """(``col``, ``out``): the 1-based tie-averaged rank of every distinct value,
    rank(v) = n_before + (n_v + 1) / 2.  ``weight``: rows that a row stands for."""
    pt = prefix_table(df, col, {"_n": F.count(F.lit(1)) if weight is None else F.sum(weight)}, descending=False)
    return pt.select(F.col("score").alias(col), (F.col("_n_before") + (F.col("_n") + 1) / 2.0).alias(out))


def tie_average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """W2 attached to every row: ranks joined back on the value (a hot value is one
    row on the small side; AQE splits the big side's skewed partition)."""
    return df.join(value_ranks(df, col, out), col)


def hash_chunk(h: ColumnOrName, prefix: int = HASH_PREFIX) -> Column:
    return F.conv(F.substring(_c(h), 1, prefix), 16, 10).cast("int")


def hash_rank(df: DataFrame, h: ColumnOrName, out: str = "rank",
              group_cols: Sequence[str] = (), tie: ColumnOrName | None = None) -> DataFrame:
    """Exact 0-based rank of every row by hex hash ``h`` within each group.

    Chunk counts (<= groups x 65,536 rows) give offsets; the window runs
    inside (group, hash-prefix) partitions, each ~1/65,536 of its group."""
    gcols = list(group_cols)
    d = df.withColumn("_h", _c(h)).withColumn("_hc", hash_chunk("_h"))
    counts = d.groupBy(*gcols, "_hc").agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*gcols).orderBy("_hc").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*[F.col(c).alias(f"_g_{c}") for c in (*gcols, "_hc")], F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    order = [F.col("_h")] + ([_c(tie)] if tie is not None else [])
    w_in = Window.partitionBy(*gcols, "_hc").orderBy(*order)
    return (_on_group(d, _bounded(offs, bool(gcols)), [*gcols, "_hc"])
            .withColumn(out, (F.col("_off") + F.row_number().over(w_in) - 1).cast("long"))
            .drop("_h", "_hc", "_off"))


def take_smallest(df: DataFrame, h: ColumnOrName, n: int | Column | None = None,
                  group_cols: Sequence[str] = (), n_from_min_group: bool = False,
                  tie: ColumnOrName | None = None, few_groups: bool = False) -> DataFrame:
    """Rows with the ``n`` smallest hashes per group (n may be a literal, or
    the smallest group size when ``n_from_min_group``: undersampling).

    Whole chunks below the boundary are kept without ranking; only the one
    boundary chunk per group is ranked.  Rows of chunks past the boundary
    are dropped by the chunk-level decision.  ``few_groups``: the groups are so
    few that their boundaries, a row each, are broadcast: rows past them go
    before any shuffle."""
    gcols = list(group_cols)
    d = df.withColumn("_h", _c(h)).withColumn("_hc", hash_chunk("_h"))
    counts = d.groupBy(*gcols, "_hc").agg(F.count(F.lit(1)).alias("_cnt"))
    w_cum = Window.partitionBy(*gcols).orderBy("_hc").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w_cum), F.lit(0)))
    if n_from_min_group:
        # the smallest group size, as a scalar subquery over the group totals
        smallest = scalar_of(counts.groupBy(*gcols).agg(F.sum("_cnt").alias("_gs"))
                             .agg(F.min("_gs").alias("m"))).getField("m")
        plan = plan.withColumn("_n", smallest)
    else:
        plan = plan.withColumn("_n", n if isinstance(n, Column) else F.lit(int(n)))
    plan = plan.filter(F.col("_before") < F.col("_n")).select(
        *[F.col(c).alias(f"_g_{c}") for c in (*gcols, "_hc")], (F.col("_before") + F.col("_cnt") <= F.col("_n")).alias("_full"),
        (F.col("_n") - F.col("_before")).alias("_need"))
    if few_groups:
        last = plan.groupBy(*[f"_g_{c}" for c in gcols]).agg(F.max(F.struct("_g__hc", "_full", "_need")).alias("_last"))
        j = _on_group(d, F.broadcast(last), gcols).filter(F.col("_hc") <= F.col("_last._g__hc"))
        j = j.withColumns({"_full": (F.col("_hc") < F.col("_last._g__hc")) | F.col("_last._full"), "_need": F.col("_last._need")}).drop("_last")
    else:
        j = _on_group(d, _bounded(plan, bool(gcols)), [*gcols, "_hc"])
    full = j.filter(F.col("_full"))
    order = [F.col("_h")] + ([_c(tie)] if tie is not None else [])
    edge = j.filter(~F.col("_full")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*gcols, "_hc").orderBy(*order))) \
        .filter(F.col("_rn") <= F.col("_need")).drop("_rn")
    return full.unionByName(edge).drop("_h", "_hc", "_full", "_need")


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``orderBy(...).limit(k)``; Spark plans TakeOrderedAndProject
    (per-partition top-k, then a k-row merge), never a full sort."""
    return df.orderBy(*order).limit(k)
