"""Sampling and label generation.

All randomness is a pure function of ``(seed, row id, draw)`` through md5,
so results do not depend on partitioning, retries or executor loss (a
re-run task recomputes the same draws).  ``rand()`` and
``monotonically_increasing_id()`` are never used.

Distribution samplers that need gamma/beta draws (Dirichlet, Beta) transform
hash uniforms of ``(seed, id, draw)`` with numpy, whole Arrow batches at a
time: no generator per row, and a row's draw depends on its id only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scalar_of
from .ranking import hash_rank, take_smallest

ColumnOrName = Column | str
#: The named strategies and their concentration; "mixed" picks one per row.
DIRICHLET_ALPHAS = {"very spiky": 0.1, "spikier": 0.3, "slightly spiky": 0.5, "flat": 1.0, "very flat": 5.0}


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash_key(seed: int | Column, id_col: ColumnOrName, draw: ColumnOrName | None = None) -> Column:
    """md5 hex of ``seed:id[:draw]``."""
    s = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    parts = [s, F.lit(":"), _c(id_col).cast("string")]
    if draw is not None:
        parts += [F.lit(":"), _c(draw).cast("string")]
    return F.md5(F.concat(*parts))


def hash_uniform(h: ColumnOrName) -> Column:
    """U[0, 1) from the first 13 hex digits (52 bits) of a hash."""
    return F.conv(F.substring(_c(h), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def hash_int(h: ColumnOrName, modulo: int | Column) -> Column:
    """Integer in [0, modulo) from the first 15 hex digits of a hash."""
    m = modulo if isinstance(modulo, Column) else F.lit(int(modulo))
    return F.pmod(F.conv(F.substring(_c(h), 1, 15), 16, 10).cast("long"), m.cast("long"))


# ------------------------------------------------------------------ N1, N2
def sample_n(df: DataFrame, n: int | Column, seed: int, id_col: str = "id",
             strict: bool = True) -> DataFrame:
    """N rows without replacement, the n smallest ``md5(seed:id)``.

    Exact and distributed: whole hash-prefix chunks are kept or dropped by
    their counts; only the boundary chunk is ranked.  ``strict`` fails the
    job when n exceeds the row count (checked with a scalar subquery)."""
    out = take_smallest(df, hash_key(seed, id_col), n, tie=id_col)
    if strict:
        total = scalar_of(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
        nn = n if isinstance(n, Column) else F.lit(int(n))
        out = out.filter(F.when(total < nn, F.raise_error(F.lit("sample size exceeds rows")))
                         .otherwise(F.lit(True)))
    return out


def auto_limit(synthetic: DataFrame, gold: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """Sample the synthetic set down to min(|gold|, |synthetic|)."""
    ns = scalar_of(synthetic.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    ng = scalar_of(gold.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    return sample_n(synthetic, F.least(ns, ng), seed, id_col, strict=False)


# ---------------------------------------------------------------------- N3
def bootstrap_weights(df: DataFrame, size: int, trials: int, seed: int,
                      id_col: str = "id", replace: bool = True) -> DataFrame:
    """(trial, id, weight) for ``trials`` resamples of ``size`` rows;
    trial t uses seed + t.

    With replacement: draw j of trial t picks position
    ``hash(seed+t, j) mod N`` in the hash order of the rows; draws are
    counted per (trial, position) and joined to the rows by position.
    Without replacement: the ``size`` smallest ``md5(seed+t:id)`` per trial.
    """
    spark = df.sparkSession
    if replace:
        idx = hash_rank(df.select(id_col), hash_key(seed, id_col), out="_pos", tie=id_col)
        n_rows = scalar_of(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
        draws = spark.range(trials * size).select(
            (F.col("id") / F.lit(size)).cast("long").alias("trial"),
            (F.col("id") % F.lit(size)).alias("j"))
        draws = draws.select("trial", hash_int(hash_key(F.lit(seed) + F.col("trial"), "j"), n_rows).alias("_pos"))
        w = draws.groupBy("trial", "_pos").agg(F.count(F.lit(1)).alias("weight"))
        return w.join(idx, "_pos").select("trial", id_col, "weight")
    rows = df.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    keyed = rows.withColumn("_k", hash_key(F.lit(seed) + F.col("trial"), id_col))
    picked = take_smallest(keyed, "_k", size, group_cols=["trial"], tie=id_col, few_groups=True)
    return picked.select(F.col("trial").cast("long").alias("trial"), id_col, F.lit(1).cast("long").alias("weight"))


def poisson_from_uniform(u: Column, lam: float) -> Column:
    """Inverse-CDF Poisson(lam) draw from a uniform column, JVM-side.  The
    uniform rides in the accumulator so it is evaluated once per row."""
    import math
    kmax = int(math.ceil(lam + 12 * math.sqrt(lam) + 12))
    e = math.exp(-lam)
    init = F.struct(F.lit(0).alias("k"), F.lit(e).alias("term"), F.lit(e).alias("cdf"), u.alias("u"))

    def step(acc, i):
        nxt = acc["term"] * F.lit(lam) / i.cast("double")
        return F.when(acc["u"] > acc["cdf"], F.struct(i.alias("k"), nxt.alias("term"),
                                                      (acc["cdf"] + nxt).alias("cdf"), acc["u"].alias("u"))) \
            .otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), init, step, lambda acc: acc["k"]).cast("long")


def bootstrap_poisson(df: DataFrame, size: int, trials: int, seed: int, n_rows: int,
                      id_col: str = "id") -> DataFrame:
    """N3 fast mode: each row gets weight ~ Poisson(size / N) per trial from
    a hash of (seed + trial, id).  No shuffle at all; the resample size is
    only approximately ``size``.  Zero weights are dropped."""
    lam = float(size) / float(n_rows)
    rows = df.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    u = hash_uniform(hash_key(F.lit(seed) + F.col("trial"), id_col, F.lit("poisson")))
    w = rows.select(F.col("trial").cast("long").alias("trial"), id_col, poisson_from_uniform(u, lam).alias("weight"))
    return w.filter(F.col("weight") > 0)


# ---------------------------------------------------------------------- N4
def undersample(df: DataFrame, label: str, seed: int, id_col: str = "id") -> DataFrame:
    """Every class cut to the minority class count (hash order)."""
    return take_smallest(df, hash_key(seed, id_col), None, group_cols=[label],
                         n_from_min_group=True, tie=id_col)


def minority_count(df: DataFrame, label: str) -> DataFrame:
    """Size of the smallest class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("minority_count"))


# ---------------------------------------------------------------------- N5
def ratio_sizes(df: DataFrame, ratios: Sequence[float]) -> DataFrame:
    """``int(N * r)`` for each ratio."""
    a = df.agg(F.count(F.lit(1)).alias("n"))
    return a.select(F.inline(F.array(*[
        F.struct(F.lit(float(r)).alias("ratio"),
                 F.floor(F.col("n") * F.lit(float(r))).cast("long").alias("size")) for r in ratios])))


# --------------------------------------------------------------- N6, N7, N9
def sample_hard_labels(id_col: ColumnOrName, k: int, seed: int) -> Column:
    """Uniform class in [0, k)."""
    return hash_int(hash_key(seed, id_col, F.lit("cls")), k).cast("int")


def sample_soft_labels(id_col: ColumnOrName, seed: int) -> Column:
    """U[0, 1) rounded half-even to 3 decimals."""
    return F.bround(hash_uniform(hash_key(seed, id_col, F.lit("soft"))), 3)


def sample_margin_uniform(id_col: ColumnOrName, positive: Column, m: float, seed: int) -> Column:
    """U[.5+m, 1] for positives, U[0, .5-m] for negatives."""
    u = hash_uniform(hash_key(seed, id_col, F.lit("margin")))
    return F.when(positive, F.lit(0.5 + m) + u * F.lit(0.5 - m)).otherwise(u * F.lit(0.5 - m))


# ------------------------------------------------------ N8, N10, N11, N16
def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_uniforms(ids: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """U(0, 1) of each id for one draw."""
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + draw * 0xD6E8FEB86659FD93 + 1) % 2**64)
    x = _mixed(_mixed(ids.astype(np.int64).view(np.uint64) + key) ^ key)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def hash_gammas(ids: np.ndarray, shape: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Gamma(shape, 1) of each id: Marsaglia and Tsang's method on whole arrays;
    the ids that reject draw again."""
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out = np.empty(len(ids))
    left = np.arange(len(ids))
    draw = stream << 32
    while len(left):
        u, w, a = (hash_uniforms(ids[left], seed, draw + k) for k in (1, 2, 3))
        draw += 3
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * w)
        v = (1 + c[left] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(a) < 0.5 * x * x + d[left] * (1 - v + np.log(np.where(v > 0, v, 1))))
        out[left[ok]] = (d[left] * v)[ok]
        left = left[~ok]
    boost = hash_uniforms(ids, seed, stream << 32) ** (1 / np.where(small, shape, 1))
    return np.where(small, out * boost, out)


def hash_betas(ids: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int, stream: int) -> np.ndarray:
    x, y = hash_gammas(ids, a, seed, stream), hash_gammas(ids, b, seed, stream + 1)
    return x / (x + y)


def sample_dirichlet(df: DataFrame, k: int, alpha: float | str | Sequence[float], seed: int,
                     id_col: str = "id", out: str = "label") -> DataFrame:
    """Dirichlet(alpha * 1_k) per row; ``alpha`` may be a float, a named
    strategy, or ``"mixed"`` (alpha chosen per row from the named set)."""
    if isinstance(alpha, str):
        if alpha == "mixed":
            alphas = list(DIRICHLET_ALPHAS.values())
        elif alpha in DIRICHLET_ALPHAS:
            alphas = [DIRICHLET_ALPHAS[alpha]]
        else:
            raise ValueError(f"unknown Dirichlet strategy {alpha!r}")
    elif isinstance(alpha, (int, float)):
        alphas = [float(alpha)]
    else:
        alphas = [float(a) for a in alpha]
    choices = np.array(alphas)

    @F.pandas_udf("array<double>")
    def draw(ids: pd.Series) -> pd.Series:
        i = ids.to_numpy()
        a = choices[(hash_uniforms(i, seed, 0) * len(choices)).astype(int)]
        x = np.stack([hash_gammas(i, a, seed, 1 + j) for j in range(k)], axis=1)
        total = x.sum(axis=1, keepdims=True)
        return pd.Series(list(np.where(total > 0, x / np.where(total > 0, total, 1), 1.0 / k)))

    return df.withColumn(out, draw(F.col(id_col).cast("long")))


def sample_margin_beta(df: DataFrame, positive: str, m: float, seed: int,
                       id_col: str = "id", out: str = "p", shape: tuple[float, float] = (5.0, 1.5)) -> DataFrame:
    """Beta(a, b) (positives) or Beta(b, a) (negatives) for ``shape`` = (a, b),
    rescaled to [.5+m, 1] or [0, .5-m]."""
    @F.pandas_udf("double")
    def draw(ids: pd.Series, pos: pd.Series) -> pd.Series:
        yes = pos.to_numpy().astype(bool)
        a, b = np.where(yes, *shape), np.where(yes, *shape[::-1])
        x = hash_betas(ids.to_numpy(), a, b, seed, 101)
        return pd.Series(np.where(yes, 0.5 + m + x * (0.5 - m), x * (0.5 - m)))

    return df.withColumn(out, draw(F.col(id_col).cast("long"), F.col(positive).cast("boolean")))


def sample_intensity(df: DataFrame, seed: int, beta: bool = False, id_col: str = "id",
                     out: str = "intensity", shape: tuple[float, float] = (5.0, 1.5)) -> DataFrame:
    """U[.8, 1] (column arithmetic) or Beta(``shape``)."""
    if not beta:
        return df.withColumn(out, F.lit(0.8) + hash_uniform(hash_key(seed, id_col, F.lit("int"))) * F.lit(0.2))

    @F.pandas_udf("double")
    def draw(ids: pd.Series) -> pd.Series:
        a, b = (np.full(len(ids), x) for x in shape)
        return pd.Series(hash_betas(ids.to_numpy(), a, b, seed, 103))

    return df.withColumn(out, draw(F.col(id_col).cast("long")))


# --------------------------------------------------------------------- N12
def balanced_requests(batches: DataFrame, batch_col: str, k: int, mode: str, seed: int,
                      group_cols: Sequence[str] = (), alpha: float | str = 1.0, margin: float = 0.0) -> DataFrame:
    """One request row per slot of each batch.

    binary: floor(b/2) positives, the rest (the extra one) negative.
    hard:   b // k per class, the remainder to one class chosen by hash.
    soft:   Dirichlet(``alpha``) label per request (see ``sample_dirichlet``).
    soft_binary: as binary, with a score of N9 for each side of ``margin``."""
    b = F.col(batch_col)
    rows = batches.select(*group_cols, b.alias("_b"),
                          F.explode(F.sequence(F.lit(0), b - 1)).alias("slot"))
    if mode == "binary":
        return rows.select(*group_cols, "slot", (F.col("slot") < (F.col("_b") / 2).cast("long"))
                           .cast("int").alias("label"))
    if mode == "hard":
        per = (F.col("_b") / F.lit(k)).cast("long")
        gkey = F.concat_ws("|", *[F.col(c).cast("string") for c in group_cols]) if group_cols else F.lit("")
        extra_cls = hash_int(hash_key(seed, gkey, F.lit("extra")), k)
        lab = F.when(F.col("slot") < per * k, (F.col("slot") / per).cast("long") if k else F.lit(0)) \
            .otherwise(extra_cls)
        return rows.select(*group_cols, "slot", lab.cast("int").alias("label"))
    if mode == "soft_binary":
        positive = F.col("slot") < (F.col("_b") / 2).cast("long")
        slot = F.concat_ws("|", *[F.col(c).cast("string") for c in group_cols], F.col("slot").cast("string"))
        return rows.select(*group_cols, "slot", sample_margin_uniform(slot, positive, margin, seed).alias("label"))
    if mode == "soft":
        keyed = rows.withColumn("_rid", F.conv(F.substring(hash_key(seed, F.concat_ws(
            "|", *[F.col(c).cast("string") for c in group_cols], F.col("slot").cast("string"))), 1, 15), 16, 10)
            .cast("long"))
        return sample_dirichlet(keyed, k, alpha, seed, "_rid", "label").drop("_rid", "_b")
    raise ValueError(f"unknown mode {mode!r}")


# --------------------------------------------------------------------- N13
def kfold(df: DataFrame, k: int, seed: int, id_col: str = "id") -> DataFrame:
    """fold = (rank by md5(seed:id)) mod k; fold sizes differ by <= 1."""
    r = hash_rank(df, hash_key(seed, id_col), out="_rk", tie=id_col)
    return r.withColumn("fold", (F.col("_rk") % k).cast("int")).drop("_rk")


# --------------------------------------------------------------------- N14
def few_shot_positions(prompts: DataFrame, pool_size: Column, k: int, seed: int,
                       prompt_col: str = "prompt_id") -> DataFrame:
    """K *distinct* pool positions per prompt, uniformly at random,
    without rejection (Floyd's subset algorithm over hashed draws).  No
    positions when the pool holds fewer than k rows."""
    prompts = prompts.select(prompt_col, pool_size.cast("long").alias("_np"))
    p = F.col("_np")

    def step(acc, j):
        t = hash_int(hash_key(seed, F.col(prompt_col), j), j + 1)
        return F.array_append(acc, F.when(F.array_contains(acc, t), j).otherwise(t))

    seq = F.sequence(p - F.lit(k), p - F.lit(1))
    chosen = F.when(p >= F.lit(k), F.aggregate(seq, F.array().cast("array<bigint>"), step)) \
        .otherwise(F.array().cast("array<bigint>"))
    return prompts.select(prompt_col, F.posexplode(chosen).alias("shot", "pos"))


def few_shot_sample(prompts: DataFrame, pool: DataFrame, k: int, seed: int,
                    prompt_col: str = "prompt_id", pool_id: str = "id") -> DataFrame:
    """Join the chosen positions to the pool (indexed by hash order)."""
    n_pool = scalar_of(pool.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    idx = hash_rank(pool, hash_key(seed, pool_id), out="pos", tie=pool_id)
    pos = few_shot_positions(prompts, n_pool, k, seed, prompt_col)
    return pos.join(idx, "pos")


# --------------------------------------------------------------------- N15
def feedback_gate(iteration: ColumnOrName, prob: float, seed: int) -> Column:
    """Use few-shot examples in this batch with probability p."""
    return hash_uniform(hash_key(seed, iteration, F.lit("gate"))) < F.lit(prob)
