"""Classification metrics (A7–A14, A21/A22 wrappers, A38).

Every metric is an aggregate over a scored DataFrame: confusion counts are
one ``groupBy(y, yhat)`` (at most K^2 groups), ranking metrics use the
two-level prefix table of ``ranking`` (distinct scores, never a global
window).  The evaluators return one row; the scored input is expected to be
cached by the caller when several metrics are taken from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import calibration as C
from .common import one_row, scalar_of
from .ranking import prefix_table

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _div0(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (sklearn zero_division=0)."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


# ------------------------------------------------------------- confusion
def confusion(df: DataFrame, y: ColumnOrName, yhat: ColumnOrName, group_cols=()) -> DataFrame:
    """Long confusion matrix (y, yhat, n), per group."""
    return df.groupBy(*group_cols, _c(y).cast("int").alias("y"), _c(yhat).cast("int").alias("yhat")) \
        .agg(F.count(F.lit(1)).alias("n"))


def per_class_counts(df: DataFrame | None, y: ColumnOrName, yhat: ColumnOrName,
                     cm: DataFrame | None = None, group_cols=()) -> DataFrame:
    """tp, predicted and support per class over the union of true and
    predicted labels (<= K rows a group); reuses a confusion table when given."""
    cm = cm if cm is not None else confusion(df, y, yhat, group_cols)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(zero)
    sides = F.array(F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("pred"), hit.alias("tp")),
                    F.struct(F.col("yhat").alias("cls"), zero.alias("support"), F.col("n").alias("pred"), zero.alias("tp")))
    return cm.select(*group_cols, F.inline(sides)).groupBy(*group_cols, "cls").agg(
        F.sum("tp").cast("long").alias("tp"), F.sum("pred").cast("long").alias("pred"),
        F.sum("support").cast("long").alias("support"))


def _prf(pc: DataFrame) -> DataFrame:
    prec = _div0(F.col("tp").cast("double"), F.col("pred").cast("double"))
    rec = _div0(F.col("tp").cast("double"), F.col("support").cast("double"))
    pc = pc.withColumn("precision", prec).withColumn("recall", rec)
    return pc.withColumn("f1", _div0(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))


def classification_report(df: DataFrame, y: ColumnOrName, yhat: ColumnOrName) -> DataFrame:
    """A10: per-class precision/recall/f1/support plus accuracy, macro avg
    and weighted avg rows (``label`` is the class as text or the row name)."""
    per = _prf(per_class_counts(df, y, yhat))
    cls_rows = per.select(F.col("cls").cast("string").alias("label"), "precision", "recall", "f1",
                          F.col("support").cast("long").alias("support"))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n").cast("double")
    acc = _div0(F.col("tp").cast("double"), n)
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"),
                 acc.alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), _div0(F.col("wp"), n).alias("precision"),
                 _div0(F.col("wr"), n).alias("recall"), _div0(F.col("wf"), n).alias("f1"),
                 F.col("n").cast("long").alias("support")))))
    return cls_rows.unionByName(summary)


def prf(df: DataFrame | None, y: ColumnOrName, yhat: ColumnOrName, average: str = "macro",
        pos_label: int = 1, cm: DataFrame | None = None, group_cols=()) -> DataFrame:
    """One row (precision, recall, f1) for binary / macro / weighted /
    micro averaging, per group; zero division gives 0."""
    per = _prf(per_class_counts(df, y, yhat, cm, group_cols)).groupBy(*group_cols)
    if average == "binary":
        pos = F.col("cls") == F.lit(pos_label)
        return per.agg(*[F.coalesce(F.max(F.when(pos, F.col(m))), F.lit(0.0)).alias(m)
                         for m in ("precision", "recall", "f1")])
    if average == "macro":
        return per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                       F.avg("f1").alias("f1"))
    if average == "weighted":
        s = F.sum("support").cast("double")
        return per.agg(_div0(F.sum(F.col("precision") * F.col("support")), s).alias("precision"),
                       _div0(F.sum(F.col("recall") * F.col("support")), s).alias("recall"),
                       _div0(F.sum(F.col("f1") * F.col("support")), s).alias("f1"))
    if average == "micro":
        a = per.agg(F.sum("tp").cast("double").alias("tp"), F.sum("pred").cast("double").alias("pr"),
                    F.sum("support").cast("double").alias("su"))
        p, r = _div0(F.col("tp"), F.col("pr")), _div0(F.col("tp"), F.col("su"))
        return a.select(*group_cols, p.alias("precision"), r.alias("recall"), _div0(2 * p * r, p + r).alias("f1"))
    raise ValueError(f"unknown average {average!r}")


def accuracy(y: ColumnOrName, yhat: ColumnOrName) -> Column:
    """A8 as an aggregate Column."""
    return F.avg((_c(y) == _c(yhat)).cast("double"))


# ---------------------------------------------------------- ranking metrics
def auc_ap_table(df: DataFrame, y: ColumnOrName, score: ColumnOrName,
                 group_cols=()) -> DataFrame:
    """A11 + A14 per group: (n_pos, n_neg, roc_auc, average_precision).

    AUC  = sum_v neg_v * (TP_before_v + tp_v / 2) / (P * N)   (ties averaged)
    AP   = sum_v (tp_v / P) * TP_through_v / n_through_v       (step sum)
    Undefined (one class only) gives null.
    """
    yy = _c(y).cast("long")
    d = df.select(*group_cols, yy.alias("_y"), _c(score).cast("double").alias("_s"))
    pt = prefix_table(d, "_s", {"tp": F.sum("_y"), "nn": F.count(F.lit(1))},
                      descending=True, group_cols=group_cols)
    neg = F.col("nn") - F.col("tp")
    agg = pt.groupBy(*group_cols).agg(
        F.sum("tp").alias("P"), F.sum(neg).alias("N"),
        F.sum(neg.cast("double") * (F.col("tp_before") + F.col("tp") / 2.0)).alias("_auc"),
        F.sum(F.col("tp").cast("double") * F.col("tp_through") / F.col("nn_through")).alias("_ap"))
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    return agg.select(*group_cols, F.col("P").cast("long").alias("n_pos"),
                      F.col("N").cast("long").alias("n_neg"),
                      F.when((P > 0) & (N > 0), F.col("_auc") / (P * N)).alias("roc_auc"),
                      F.when(P > 0, F.col("_ap") / P).alias("average_precision"))


def explode_ovr(df: DataFrame, y: ColumnOrName, probs: ColumnOrName, group_cols=()) -> DataFrame:
    """(cls, p, y_bin) per row and class."""
    return df.select(*group_cols, _c(y).alias("_y"), F.posexplode(_c(probs)).alias("cls", "p")) \
        .select(*group_cols, "cls", "p", (F.col("_y") == F.col("cls")).cast("int").alias("y"))


def ovr_auc_ap(df: DataFrame, y: ColumnOrName, probs: ColumnOrName, group_cols=()) -> DataFrame:
    """Per-class one-vs-rest AUC and AP with prevalence."""
    return auc_ap_table(explode_ovr(df, y, probs, group_cols), "y", "p", group_cols=[*group_cols, "cls"])


def ovr_average(per: DataFrame, metric: str, average: str = "macro") -> DataFrame:
    if average == "macro":
        return per.agg(F.avg(metric).alias(metric))
    if average == "weighted":
        return per.agg((F.sum(F.col(metric) * F.col("n_pos")) / F.sum("n_pos")).alias(metric))
    raise ValueError("average must be 'macro' or 'weighted'")


def class_score_table(df: DataFrame, y: ColumnOrName, probs: ColumnOrName, k: int, group_cols=()) -> DataFrame:
    """Per class column ``cls`` and distinct score in it: rows of every true class
    (``n``, a vector of K counts) and, of those of ``cls`` itself, ``own`` with its
    running sums in falling order.  K records a row, one table for every
    one-vs-one and one-vs-rest curve."""
    own = F.col("_y") == F.col("cls")
    ex = df.select(*group_cols, _c(y).cast("int").alias("_y"), F.posexplode(_c(probs)).alias("cls", "_s")) \
        .filter(F.col("_y").between(0, k - 1) & F.col("cls").between(0, k - 1))
    counts = {f"_n{j}": F.count_if(F.col("_y") == j) for j in range(k)}
    pt = prefix_table(ex, "_s", {"own": F.count_if(own)}, descending=True, group_cols=[*group_cols, "cls"], carried=counts)
    return pt.select(*group_cols, "cls", "score", "own", "own_through", "own_before", F.array(*counts).alias("n"))


def auc_of_pairs(table: DataFrame, k: int, group_cols=()) -> DataFrame:
    """From ``class_score_table``: (c, d, n_c, n_d, auc) for every ordered pair of
    classes: AUC of P_c with positives of class c and negatives of class d, ties halved."""
    middle = F.col("own_before") + F.col("own") / 2.0
    per = table.groupBy(*group_cols, F.col("cls").alias("c")).agg(
        F.sum("own").alias("n_c"),
        F.array(*[F.struct(F.lit(j).alias("d"), F.sum(F.col("n")[j]).alias("n_d"), F.sum(F.col("n")[j] * middle).alias("u"))
                  for j in range(k)]).alias("others"))
    each = per.select(*group_cols, "c", "n_c", F.inline("others")).filter(F.col("c") != F.col("d"))
    both = F.col("n_c").cast("double") * F.col("n_d")
    return each.select(*group_cols, "c", "d", "n_c", "n_d", F.when(both > 0, F.col("u") / both).alias("auc"), "u")


def roc_auc_ovo(df: DataFrame, y: ColumnOrName, probs: ColumnOrName, k: int, group_cols=()) -> DataFrame:
    """Macro one-vs-one AUC (Hand & Till).  For every ordered class pair
    (c, d) over rows with y in {c, d}: AUC of score P_c with positives y = c;
    pair score = mean of both directions; result = mean over pairs."""
    per_dir = auc_of_pairs(class_score_table(df, y, probs, k, group_cols), k, group_cols)
    per_pair = per_dir.groupBy(*group_cols, F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).agg(F.avg("auc").alias("pair_auc"))
    return per_pair.groupBy(*group_cols).agg(F.avg("pair_auc").alias("roc_auc_ovo"))


def roc_auc_ovr_from_pairs(df: DataFrame, y: ColumnOrName, probs: ColumnOrName, k: int, group_cols=()) -> DataFrame:
    """A12 from the same table: (cls, n_pos, n_neg, roc_auc); the negatives of a class
    are those of all others."""
    pairs = auc_of_pairs(class_score_table(df, y, probs, k, group_cols), k, group_cols)
    neg = F.sum("n_d")
    return pairs.groupBy(*group_cols, F.col("c").alias("cls")).agg(
        F.max("n_c").alias("n_pos"), neg.alias("n_neg"),
        F.when((F.max("n_c") > 0) & (neg > 0), F.sum("u") / (F.max("n_c").cast("double") * neg)).alias("roc_auc"))


# --------------------------------------------------------------- evaluators
def _score_table_metrics(pt: DataFrame, group_cols=(), threshold: float | None = 0.5,
                         n_bins: int = 10) -> DataFrame:
    """Every binary metric from one distinct-score prefix table
    (score, tp, nn, *_through, *_before): threshold counts, AUC, AP and the
    (lo, hi] ECE (bins are a function of the score, so they fold from the
    same table): sums by bin, then over the bins."""
    from .binning import bin_right_closed, linspace_edges
    g = list(group_cols)
    neg = F.col("nn") - F.col("tp")
    ge = F.col("score") >= F.lit(threshold) if threshold is not None else F.lit(False)
    bins = pt.groupBy(*g, bin_right_closed("score", linspace_edges(n_bins)).alias("_b")).agg(
        F.sum("tp").alias("P"), F.sum("nn").alias("NA"),
        F.sum(neg.cast("double") * (F.col("tp_before") + F.col("tp") / 2.0)).alias("_auc"),
        F.sum(F.col("tp").cast("double") * F.col("tp_through") / F.col("nn_through")).alias("_ap"),
        F.sum(F.when(ge, F.col("tp")).otherwise(0)).alias("TPt"),
        F.sum(F.when(ge, F.col("nn")).otherwise(0)).alias("PPt"),
        F.sum(F.col("score") * F.col("nn")).alias("_s"))
    inside = (F.col("_b") >= 0) & (F.col("_b") < n_bins)
    j = bins.groupBy(*g).agg(*[F.sum(c).alias(c) for c in ("P", "NA", "_auc", "_ap", "TPt", "PPt")],
                             F.sum(F.when(inside, F.abs(F.col("P") - F.col("_s")))).alias("_ece"))
    ece_num = F.coalesce(F.col("_ece"), F.lit(0.0))
    P, NA = F.col("P").cast("double"), F.col("NA").cast("double")
    N = NA - P
    tp, pp = F.col("TPt").cast("double"), F.col("PPt").cast("double")
    return j.select(
        *g, F.col("P").cast("long").alias("n_pos"), N.cast("long").alias("n_neg"),
        _div0(tp + (NA - pp) - (P - tp), NA).alias("accuracy"),
        _div0(tp, pp).alias("precision"), _div0(tp, P).alias("recall"),
        _div0(2 * tp, pp + P).alias("f1_score"),
        F.when((P > 0) & (N > 0), F.col("_auc") / (P * N)).alias("roc_auc"),
        F.when(P > 0, F.col("_ap") / P).alias("auprc"),
        F.coalesce(F.when(NA > 0, ece_num / NA), F.lit(0.0)).alias("ece"))


def _number(x: Column, what: str) -> Column:
    """``x`` as a double; a null or NaN is an error when its row is read."""
    v = x.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"{what} must be numbers: null or NaN found")).cast("double")).otherwise(v)


def evaluate_binary(df: DataFrame, y: ColumnOrName, p: ColumnOrName,
                    threshold: float = 0.5, n_bins: int = 10, group_cols=()) -> DataFrame:
    """A38 (binary): accuracy, precision, recall, f1 at ``p >= t``, ROC AUC,
    average precision and ECE in one row (a group), all folded from one
    distinct-score prefix table (one scan, one shuffle of distinct scores).
    Labels and scores must be numbers: a null or NaN raises."""
    g = list(group_cols)
    d = df.select(*g, _number(_c(y), "labels").cast("long").alias("_y"), _number(_c(p), "scores").alias("_s"))
    pt = prefix_table(d, "_s", {"tp": F.sum("_y"), "nn": F.count(F.lit(1))}, descending=True, group_cols=g)
    return _score_table_metrics(pt, g, threshold, n_bins).select(
        *g, "accuracy", "precision", "recall", "f1_score", "roc_auc", "auprc", "ece")


def evaluate_multiclass(df: DataFrame, y: ColumnOrName, probs: ColumnOrName,
                        average: str = "macro", n_bins: int = 10, group_cols=()) -> DataFrame:
    """A38 (multiclass): accuracy and P/R/F1 (average) from the confusion
    counts; OvR ROC AUC, OvR AP and per-class ECE from one per-(class,
    score) prefix table; averaged the same way; one row (a group)."""
    if average not in ("macro", "weighted"):
        raise ValueError("average must be 'macro' or 'weighted'")
    g = list(group_cols)
    s = df.select(*g, _c(y).cast("int").alias("y"), _c(probs).alias("probs")).withColumn("yhat", L.argmax("probs"))
    counts = _prf(per_class_counts(s, "y", "yhat", group_cols=g))     # accuracy and P/R/F1 share one K x K table
    n = F.sum("support").cast("double")
    mean = {m: F.avg(m) if average == "macro" else _div0(F.sum(F.col(m) * F.col("support")), n) for m in ("precision", "recall", "f1")}
    cls = counts.groupBy(*g).agg(_div0(F.sum("tp").cast("double"), n).alias("accuracy"), mean["precision"].alias("precision"),
                                 mean["recall"].alias("recall"), mean["f1"].alias("f1_score"))
    ex = explode_ovr(s, "y", "probs", g)
    pt = prefix_table(ex.select(*g, "cls", F.col("y").cast("long").alias("_y"), F.col("p").alias("_s")), "_s",
                      {"tp": F.sum("_y"), "nn": F.count(F.lit(1))}, descending=True, group_cols=[*g, "cls"])
    per = _score_table_metrics(pt, [*g, "cls"], None, n_bins)
    w = F.col("n_pos").cast("double")
    ovr = per.groupBy(*g).agg(*[(F.avg(m) if average == "macro" else F.sum(F.col(m) * w) / F.sum(w)).alias(m)
                                for m in ("roc_auc", "auprc", "ece")])
    return cls.join(ovr, g) if g else one_row(cls, ovr)


def _one_row(*parts: DataFrame) -> DataFrame:
    return one_row(*parts)


def brier_binary(df: DataFrame, y: ColumnOrName, p: ColumnOrName) -> DataFrame:
    return df.agg(C.brier_binary(df, y, p).alias("brier"))



# Metric registry, name -> builder over a scored DataFrame (y, proba)
def _m_accuracy(s, y, proba, average):
    return s.agg(accuracy(y, L.argmax(proba)).alias("accuracy"))


def _m_prf(name):
    def f(s, y, proba, average):
        return prf(s.withColumn("_yhat", L.argmax(proba)), y, "_yhat", average).select(
            F.col(name).alias(name if name != "f1" else "f1_score"))
    return f


def _m_roc_auc(s, y, proba, average):
    return ovr_average(ovr_auc_ap(s, y, proba), "roc_auc", average)


def _m_auprc(s, y, proba, average):
    per = ovr_auc_ap(s, y, proba).withColumnRenamed("average_precision", "auprc")
    return ovr_average(per, "auprc", average)


def _m_ece(s, y, proba, average):
    return C.ece_per_class_avg(s, y, proba, 10, average)


METRIC_REGISTRY = {"accuracy": _m_accuracy, "precision": _m_prf("precision"), "recall": _m_prf("recall"),
                   "f1_score": _m_prf("f1"), "roc_auc": _m_roc_auc, "auprc": _m_auprc, "ece": _m_ece}


def evaluate(scored: DataFrame, y: str, proba: str, metrics=None, average: str = "macro",
             kind: str = "multiclass", threshold: float = 0.5) -> DataFrame:
    """Any subset of the registered metrics, one row.  ``kind="binary"``:
    ``proba`` is the probability of class 1, predicted from ``threshold`` on."""
    names = list(metrics or METRIC_REGISTRY)
    unknown = [n for n in names if n not in METRIC_REGISTRY]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    if kind == "binary":
        return evaluate_binary(scored, y, proba, threshold).select(*names)
    if kind != "multiclass":
        raise ValueError(f"unknown kind {kind!r}")
    return one_row(*[METRIC_REGISTRY[n](scored, y, proba, average) for n in names])
