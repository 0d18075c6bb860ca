"""Binning conventions (J7, A5, A28, A29 and the ECE bins).

Three conventions exist in the reference and they disagree on the edges.
They are named separately and never share a default:

* ``bin_right_closed``      (lo, hi]; a value equal to the first edge falls
                            in *no* bin (index -1).  ECE / calibration.
* ``bin_left_closed``       [lo, hi), the last bin also closed on the right;
                            values outside [e0, en] get null.  Histograms and
                            the bin-wise MAE.
* ``bin_cut``               (lo, hi], the first bin also includes e0
                            (``include_lowest``).  Reliability curves.

A bin index is a sum of comparisons against literal edges, so it is a plain
codegen'd expression; no UDF and no join.  ``bin_table`` turns per-bin
partial sums into a dense table with empty bins present (the J7 spine)
without any join: the grouped result has at most n+2 rows, is folded into a
single map row and re-expanded over ``sequence(0, n-1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def linspace_edges(n_bins: int) -> list[float]:
    """Edges of ``np.linspace(0, 1, n+1)``: ``i * (1/n)`` and exactly 1.0 last
    (so edge 3 of 10 is 0.30000000000000004, as in the reference)."""
    if n_bins < 1:
        raise ValueError("n_bins must be >= 1")
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def _count(pred_terms: list[Column]) -> Column:
    out = pred_terms[0].cast("int")
    for t in pred_terms[1:]:
        out = out + t.cast("int")
    return out


def bin_right_closed(x: ColumnOrName, edges: Sequence[float]) -> Column:
    """(lo, hi] bins: ``#(edges < x) - 1``.  x = e0 gives -1, x > en gives n."""
    x = _c(x)
    return (_count([F.lit(float(e)) < x for e in edges]) - 1).cast("int")


def bin_left_closed(x: ColumnOrName, edges: Sequence[float]) -> Column:
    """[lo, hi) bins, last bin closed: ``np.histogram`` placement; null outside."""
    x = _c(x)
    n = len(edges) - 1
    raw = _count([F.lit(float(e)) <= x for e in edges]) - 1
    return (F.when((x < F.lit(float(edges[0]))) | (x > F.lit(float(edges[-1]))), F.lit(None))
            .when(x == F.lit(float(edges[-1])), F.lit(n - 1))
            .otherwise(raw)).cast("int")


def bin_cut(x: ColumnOrName, edges: Sequence[float]) -> Column:
    """(lo, hi] bins with the lowest edge included (``pd.cut(include_lowest)``)."""
    x = _c(x)
    raw = _count([F.lit(float(e)) < x for e in edges]) - 1
    return (F.when((x < F.lit(float(edges[0]))) | (x > F.lit(float(edges[-1]))), F.lit(None))
            .when(x == F.lit(float(edges[0])), F.lit(0))
            .otherwise(raw)).cast("int")


def bin_searchsorted(x: ColumnOrName, n_bins: int) -> Column:
    """``calibration_curve`` placement: ``searchsorted(edges[1:-1], x)``,
    i.e. (lo, hi] with 0 in the first bin and 1 in the last."""
    x = _c(x)
    inner = linspace_edges(n_bins)[1:-1]
    if not inner:
        return F.lit(0)
    return _count([F.lit(float(e)) < x for e in inner]).cast("int")


def bin_table(df: DataFrame, bin_col: ColumnOrName, n_bins: int,
              sums: dict[str, Column], group_cols: Sequence[str] = (),
              extra: dict[str, Column] | None = None,
              over_bins: dict | None = None) -> DataFrame:
    """Dense per-bin table, one row per (group, bin in 0..n-1).

    ``sums`` are additive aggregates (count/sum/min/max) computed per bin.
    ``extra`` are aggregates over *all* rows of the group, including those in
    no bin (they are merged from the per-bin partials, so they must be sums,
    mins or maxes named ``sum_*``, ``min_*``, ``max_*`` or ``n``).

    ``over_bins`` maps a name to ``fn(values) -> Column`` where ``values``
    is the array of per-bin structs of the in-range bins; it is evaluated on
    the folded row (totals over bins without a window or a join).

    Rows are reduced map-side by ``groupBy(group, bin)``; the result has at
    most ``groups x (n+2)`` rows, so the second-level fold per group is
    bounded by the bin count, not by the data.
    """
    gcols = list(group_cols)
    b = _c(bin_col).alias("_bin")
    per_bin = df.groupBy(*gcols, b).agg(*[v.alias(k) for k, v in sums.items()])
    names = list(sums)

    def merge(name: str) -> Column:
        if name.startswith("min_"):
            return F.min(name)
        if name.startswith("max_"):
            return F.max(name)
        return F.sum(name)

    folded = per_bin.groupBy(*gcols).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct(
            F.col("_bin"), F.struct(*[F.col(k) for k in names]))))).alias("_m"),
        *[merge(k).alias(f"all_{k}") for k in names])
    entries = F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)),
        lambda i: F.struct(i.alias("bin"),
                           *[F.try_element_at(F.col("_m"), i).getField(k).alias(k)
                             for k in names]))
    folds = {}
    if over_bins:
        in_range = F.map_values(F.map_filter("_m", lambda k, v: (k >= 0) & (k < F.lit(n_bins))))
        folds = {name: fn(in_range) for name, fn in over_bins.items()}
    out = folded.select(*gcols, *[f"all_{k}" for k in names],
                        *[c.alias(k) for k, c in folds.items()], F.inline(entries))
    if extra:
        out = out.withColumns(extra)
    return out


def histogram(df: DataFrame, x: ColumnOrName, edges: Sequence[float],
              hue: Sequence[str] = (), density: bool = False) -> DataFrame:
    """A5: counts per [lo, hi) bin, last bin closed; optional per-hue density
    (count / (total in range * width))."""
    n = len(edges) - 1
    total = {"_in_range": lambda vals: F.aggregate(vals, F.lit(0).cast("long"),
                                                    lambda a, v: a + v["n"])}
    t = bin_table(df, bin_left_closed(x, edges), n, {"n": F.count(F.lit(1))},
                  group_cols=hue, over_bins=total)
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in edges[1:]]), F.col("bin") + 1)
    out = t.select(*hue, "bin", lo.alias("bin_lo"), hi.alias("bin_hi"),
                   F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"), "_in_range")
    if density:
        tot = F.col("_in_range")
        out = out.withColumn("density", F.when(tot > 0, F.col("n") / (tot * (F.col("bin_hi") - F.col("bin_lo")))))
    return out.drop("_in_range")
