"""Downstream experiments (M12–M15) and trial summaries.

A grid cell = (filter setting, training size, trial).  A trial's training set
is a bootstrap of the filtered pool: ``size`` draws with replacement, as
(id, weight) rows from the partition-independent hash sampler (seed +
trial), so the size holds whatever the pool's.  All sizes and trials (and their
cross-validations) of a setting are fitted together by ``cells`` and evaluated
by one grouped evaluation of each split.  The summary is a Spark ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from . import metrics as M
from . import models as MD
from .cells import Blocks, Cell, fit_cells, scored_rows
from .filters import entropy_at_most, margin_inclusive, top_gap_at_least
from .ranking import hash_rank
from .sampling import bootstrap_weights, hash_key

METRICS = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "auprc", "ece")


def trial_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """NaN-ignoring mean and sample std (ddof=1) across trials; one
    trial gives a null std, all-NaN gives null."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(F.col(m)), F.col(m))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_trials"), *aggs)


def training_draws(pool: DataFrame, sizes: Sequence[int], trials: int, seed: int, id_col: str = "id") -> DataFrame:
    """(size, trial, id, weight): the bootstrap draws of every grid cell.  Their
    weights add up to ``size`` exactly."""
    parts = [bootstrap_weights(pool, int(s), trials, seed, id_col).withColumn("size", F.lit(int(s)).cast("long")) for s in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("size", "trial", id_col, "weight")


def downstream_experiment(train: DataFrame, test: DataFrame, sizes: Sequence[int], trials: int,
                          variant: str = "soft", features: str = "embedding", probs: str = "label",
                          y: str = "y", C: float | None = None, q: float = 0.9, seed: int = 0,
                          id_col: str = "id", setting: dict | None = None, cs: int | Sequence[float] = 10,
                          folds: int = 5) -> DataFrame:
    """For every size and trial, bootstrap ``size`` training rows (seed +
    trial), fit the variant (standard / soft / gce; C by cross-validation
    unless given) and evaluate on the whole training pool and on ``test``.
    Returns one metric row per (size, trial, split); an empty pool gives none."""
    spark = train.sparkSession
    cols = list((setting or {}).keys())
    schema = ", ".join([f"{c} double" for c in cols] + ["variant string", "size long", "trial int", "split string"]
                       + [f"{m} double" for m in METRICS])
    if train.isEmpty():
        return spark.createDataFrame([], schema)
    if variant not in ("soft", "gce", "standard"):
        raise ValueError(f"unknown variant {variant!r}")
    k = MD.vector_length(train, probs)
    trials_of = [(int(s), t) for s in sizes for t in range(trials)]
    rows = with_trials(train, trials_of, training_draws(train, sizes, trials, seed, id_col), seed, folds if C is None else None, id_col)
    hard = L.argmax(probs)
    if variant == "gce":
        target, loss = F.col(probs), "gce"
    else:
        target, loss = MD._target(hard, k) if variant == "standard" else MD._soft_target(probs, k)[0], "odds" if k == 2 else "softmax"
    how = {"loss": loss, "soft": variant == "soft", "q": q}
    if variant == "gce":
        how["start"] = MD._gce_start(MD.vector_length(train, features), k, 0 if C is not None else seed)
    if C is None:
        models = MD.cross_validate(rows, features, target, hard, F.col("_w"), F.col("_fold"), folds, MD.logspace_cs(cs),
                                   "neg_log_loss", k, len(trials_of), **how).models
    else:
        blocks = Blocks(rows, features, target, F.col("_w"))
        try:
            models = fit_cells(blocks, [Cell(t, None, C) for t in range(len(trials_of))], features=features, **how)
        finally:
            blocks.close()
    out = None
    for split, part in (("train", train), ("test", test)):
        scored = scored_rows(part, features, F.col(y), models)
        if k == 2:
            got = M.evaluate_binary(scored.withColumn("_p1", F.col("proba")[1]), "y", "_p1", group_cols=["cell"])
        else:
            got = M.evaluate_multiclass(scored, "y", "proba", group_cols=["cell"])
        got = got.select(*[F.lit(float(v)).alias(c) for c, v in (setting or {}).items()], F.lit(variant).alias("variant"),
                         *[F.array(*[F.lit(x[i]).cast(kind) for x in trials_of])[F.col("cell")].alias(name)
                           for i, (name, kind) in enumerate((("size", "long"), ("trial", "int")))],
                         F.lit(split).alias("split"), *[F.coalesce(F.col(m).cast("double"), F.lit(float("nan"))).alias(m) for m in METRICS])
        out = got if out is None else out.unionByName(got)
    return out


def with_trials(train: DataFrame, trials: Sequence[tuple[int, int]], draws: DataFrame, seed: int, folds: int | None,
                id_col: str = "id") -> DataFrame:
    """``train`` with its weight in every trial (``_w``, 0: not drawn) and, with
    ``folds``, its fold there (``_fold``, -1: none): folds are dealt among the
    rows of each trial, by the hash of seed + trial."""
    if folds is not None:
        draws = hash_rank(draws, hash_key(F.lit(seed) + F.col("trial"), id_col), "_rk", ["size", "trial"], tie=id_col) \
            .withColumn("_f", (F.col("_rk") % folds).cast("int"))
    else:
        draws = draws.withColumn("_f", F.lit(0))
    number = {x: i for i, x in enumerate(trials)}
    # at most one entry for each trial
    of = draws.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(":", F.col("size").cast("string"), F.col("trial").cast("string")),
        F.struct(F.col("weight").cast("double").alias("w"), F.col("_f").alias("f"))))).alias("_of"))
    rows = train.join(of, id_col)
    keys = F.array(*[F.lit(f"{s}:{t}") for s, t in number])
    entries = F.transform(keys, lambda key: F.try_element_at("_of", key))
    return rows.withColumn("_w", F.transform(entries, lambda e: F.coalesce(e["w"], F.lit(0.0)))) \
        .withColumn("_fold", F.transform(entries, lambda e: F.coalesce(e["f"], F.lit(-1)))).drop("_of")


def pool_sizes(pool: DataFrame, ratios: Sequence[float]) -> list[int]:
    """The training sizes int(N * r), one row at least."""
    n = pool.count()
    return [max(1, int(n * r)) for r in ratios]


def gold_subset_curve(train: DataFrame, test: DataFrame, sizes: Sequence[int], trials: int,
                      features: str = "embedding", label: str = "y", C: float | None = None,
                      seed: int = 0, id_col: str = "id", k: int = 2, **kw) -> DataFrame:
    """M12 with hard gold labels (standard variant), summarised by split."""
    tr = train.withColumn("_probs", L.one_hot(F.col(label), k))
    res = downstream_experiment(tr, test, sizes, trials, "standard", features, "_probs", label, C,
                                seed=seed, id_col=id_col, **kw)
    return trial_summary(res, ["size", "split"], ["accuracy", "f1_score"])


def sweep(train: DataFrame, test: DataFrame, settings: Sequence[float],
          keep: Callable[[float], object], name: str, sizes: Sequence[int], trials: int,
          variant: str = "soft", **kw) -> DataFrame:
    """M12 on the *filtered* pool for every setting; an empty pool
    is skipped (no rows for that setting)."""
    out = None
    for s in settings:
        pool = train.filter(keep(s))
        res = downstream_experiment(pool, test, sizes, trials, variant, setting={name: float(s)}, **kw)
        out = res if out is None else out.unionByName(res)
    return out


def margin_sweep(train, test, margins, sizes, trials, p_col="p", **kw) -> DataFrame:
    """Inclusive margin filter on the binary soft label."""
    return sweep(train, test, margins, lambda m: margin_inclusive(p_col, m), "margin", sizes, trials, **kw)


def entropy_sweep(train, test, thresholds, sizes, trials, probs="label", **kw) -> DataFrame:
    """Normalised-entropy filter (<= t)."""
    return sweep(train, test, thresholds, lambda t: entropy_at_most(probs, t), "threshold", sizes,
                 trials, probs=probs, **kw)


def top_gap_sweep(train, test, gaps, sizes, trials, probs="label", **kw) -> DataFrame:
    """Top-gap filter (>= gap)."""
    return sweep(train, test, gaps, lambda g: top_gap_at_least(probs, g), "gap", sizes, trials,
                 probs=probs, **kw)
