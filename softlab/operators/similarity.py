"""Mean pairwise cosine similarity without pairs.

The reference builds the dense N x N cosine matrix (and caps N at 20,000
to survive).  With unit vectors u_i the sum over unordered pairs is

    sum_{i<j} u_i . u_j = (||S||^2 - q) / 2,   S = sum_i u_i,  q = #non-zero u_i

so every mean below needs only per-class vector sums: one map-side
``Summarizer.sum`` per class (D doubles per group and task in the
shuffle), no join, no pair emission.  Zero vectors normalise to 0 and so
contribute similarity 0 to every pair, as in the reference.

Multi-label (A27): rows are intra-class when they share at least one class.
Grouping rows by their class bitmask and applying inclusion-exclusion over
the non-empty subsets A of classes (pairs sharing all of A come from
``T_A = sum of S_m over masks m containing A``) gives the same sum, still
without pairs.  The subset table is bounded by 2^C (C classes).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_row

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda s, v: s + v)


def norm2(a: ColumnOrName) -> Column:
    return F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0).cast("double"),
                       lambda s, v: s + v)


def l2_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0).cast("double"), lambda s, v: s + v))


def cosine_similarity(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine similarity; null when either vector is zero."""
    d = F.sqrt(norm2(a)) * F.sqrt(norm2(b))
    return F.when(d > 0, dot(a, b) / d)


def unit(v: ColumnOrName) -> Column:
    """Unit vector as an array column; the zero vector stays zero."""
    from ..functions.labels import with_scalar
    v = _c(v)
    n = F.sqrt(norm2(v))
    return with_scalar(v, F.when(n > 0, n).otherwise(F.lit(1.0)), lambda x, t: x / t)


def class_sums(df: DataFrame, emb: str, by: Sequence[ColumnOrName]) -> DataFrame:
    """Per-group (n, q, S) with S the sum of unit vectors (as an array).

    Always grouped (a constant key when ``by`` is empty), so an empty input
    gives an empty table instead of an empty Summarizer."""
    keys = list(by) if by else [F.lit(0).alias("_all")]
    e = F.col(emb).cast("array<double>")
    v = df.select(*keys, array_to_vector(e).alias("_x"),
                  F.exists(e, lambda x: x != 0).cast("long").alias("_nz"))
    kcols = [c for c in v.columns if c not in ("_x", "_nz")]
    # JVM-side L2 normalisation (a zero vector is returned unchanged)
    u = Normalizer(inputCol="_x", outputCol="_v", p=2.0).transform(v)
    return u.groupBy(*kcols).agg(F.count(F.lit(1)).alias("n"), F.sum("_nz").alias("q"),
                                 vector_to_array(Summarizer.sum(F.col("_v"))).alias("S"))


def _pair_sum(S: Column, q: Column) -> Column:
    return (norm2(S) - q) / 2.0


def _pairs(n: Column) -> Column:
    return n.cast("double") * (n.cast("double") - 1) / 2.0


def _mean(sum_col: Column, pairs_col: Column) -> Column:
    return F.when(pairs_col > 0, sum_col / pairs_col).otherwise(F.lit(0.0))


def _total(sums: DataFrame) -> DataFrame:
    """Whole-corpus pair sum from the per-group sums (one row, zeros when
    empty): ||sum_c S_c||^2, the vectors added map-side by ``Summarizer``."""
    all_ = sums.withColumn("_v", array_to_vector("S")).groupBy(F.lit(0).alias("_all")) \
        .agg(F.sum("n").alias("n"), F.sum("q").alias("q"), vector_to_array(Summarizer.sum(F.col("_v"))).alias("S"))
    r = all_.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("q"), F.lit(0)).alias("q"),
                 F.coalesce(F.max(norm2("S")), F.lit(0.0)).alias("s2"))
    return r.select("n", ((F.col("s2") - F.col("q")) / 2.0).alias("all_sum"),
                    _pairs(F.col("n")).alias("all_pairs"))


def mean_pairwise_cosine(df: DataFrame, emb: str = "embedding") -> DataFrame:
    """Mean cosine over i<j; fewer than 2 rows gives 0.0."""
    t = _total(class_sums(df, emb, []))
    return t.select("n", _mean(F.col("all_sum"), F.col("all_pairs")).alias("mean_cosine"))


def cosine_by_class(df: DataFrame, emb: str = "embedding", label: str = "label") -> DataFrame:
    """(inter, intra) mean cosine; class = label equality (a float soft
    label makes each distinct value its own class)."""
    per = class_sums(df, emb, [F.col(label).alias("_cls")])
    intra = per.agg(F.coalesce(F.sum(_pair_sum(F.col("S"), F.col("q"))), F.lit(0.0)).alias("intra_sum"),
                    F.coalesce(F.sum(_pairs(F.col("n"))), F.lit(0.0)).alias("intra_pairs"),
                    F.count(F.lit(1)).alias("n_classes"))
    r = one_row(intra, _total(per))
    return r.select(
        "n", "n_classes",
        _mean(F.col("all_sum") - F.col("intra_sum"), F.col("all_pairs") - F.col("intra_pairs")).alias("inter"),
        _mean(F.col("intra_sum"), F.col("intra_pairs")).alias("intra"),
        _mean(F.col("all_sum"), F.col("all_pairs")).alias("average"))


def cosine_multilabel(df: DataFrame, emb: str, classes: Sequence[str]) -> DataFrame:
    """intra = pairs sharing >= 1 class (values cast to int, all-zero
    rows never intra); inter = the other pairs.

    Rows are summed by the set of classes they have.  Two sets that share a
    class meet once, under their smallest common class, so the work follows
    the sets that occur, not 2^C, and any number of classes will do."""
    own = F.filter(F.array(*[F.when(F.col(c).cast("int") != 0, F.lit(i)) for i, c in enumerate(classes)]),
                   lambda x: x.isNotNull())
    per = class_sums(df, emb, [F.concat_ws(",", own).alias("_m")])
    some = per.filter(F.col("_m") != "").withColumn("_set", F.split("_m", ",").cast("array<int>"))
    listed = some.select(F.explode("_set").alias("_c"), "_m", "_set", "n", "S")
    other = listed.select("_c", F.col("_m").alias("_m2"), F.col("_set").alias("_set2"), F.col("n").alias("n2"), F.col("S").alias("S2"))
    met = listed.join(other, "_c").filter((F.col("_m") < F.col("_m2"))
                                          & (F.col("_c") == F.array_min(F.array_intersect("_set", "_set2"))))
    dot = F.aggregate(F.zip_with("S", "S2", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    between = met.select(dot.alias("s"), (F.col("n") * F.col("n2")).cast("double").alias("p"))
    inside = some.select(_pair_sum(F.col("S"), F.col("q")).alias("s"), _pairs(F.col("n")).alias("p"))
    intra = inside.unionByName(between).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("intra_sum"),
                                            F.coalesce(F.sum("p"), F.lit(0.0)).alias("intra_pairs"))
    r = one_row(intra, _total(per))
    return r.select(
        "n",
        _mean(F.col("all_sum") - F.col("intra_sum"), F.col("all_pairs") - F.col("intra_pairs")).alias("inter"),
        _mean(F.col("intra_sum"), F.col("intra_pairs")).alias("intra"))
