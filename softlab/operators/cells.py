"""Linear classifiers fitted many at a time.

A grid of fits (C x fold, size x trial, or all of these) differs in the rows'
weights and in C only.  So all *cells* of a grid are fitted together: each row is
kept with its weight and fold in every trial, and every pass over the rows
returns loss, gradient and (two classes) Hessian of all cells that aren't done,
added up in one reduction.  The number of Spark jobs is the number of iterations of the slowest
cell, whatever the number of cells.  The driver holds model-sized vectors.

* Two classes: one vector of log odds, by Newton's method (iteratively
  reweighted least squares: each pass sums X'WX and X'r).
* More classes, or Hessians that would be too large together: L-BFGS
  preconditioned with the Gram matrix X'WX of each set of weights (one more pass),
  which bounds the softmax's Hessian whatever the model.
* Generalised cross-entropy isn't convex: L-BFGS from the given start.

Every pass evaluates one trial point of every cell: a cell whose step was too
long tries a shorter one in the next pass while others go on.

The convex optimum is unique, so results don't depend on the path.  Without a
penalty and with classes that a plane separates there is no optimum: such a fit
ends where the loss can't be lowered by ``TOLERANCE`` of itself or one (all
training rows are then on their side) and warns if that isn't reached.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import labels as L

TOLERANCE = 1e-12
BOUNDED_TOLERANCE = 1e-9     # of L-BFGS: the expected gain of a step, relative to the loss
HESSIANS = 1 << 22     # numbers of all cells' Hessians (32 MB a task); beyond, Gram matrices bound them
MEMORY = 10            # steps that L-BFGS remembers


@dataclass(frozen=True)
class Cell:
    """One fit: the rows of ``trial`` but those of ``fold`` (None: all of them)."""
    trial: int = 0
    fold: int | None = None
    C: float | None = 1.0


@dataclass
class LinearSoftmax:
    """A fitted linear softmax head (W: d x K, b: K) usable in Spark."""
    W: np.ndarray
    b: np.ndarray
    features: str
    iterations: int = 0
    gradient_norm: float = float("nan")
    converged: bool = True

    def _with(self, df: DataFrame, out: str, kind: str, of) -> DataFrame:
        """An Arrow-batched pandas UDF doing one numpy matmul per batch (the
        model, d x K numbers, travels in the closure; it is not inlined as d*K
        literals into the plan)."""
        W, b = self.W, self.b

        @F.pandas_udf(kind)
        def value(x: pd.Series) -> pd.Series:
            X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, W.shape[0]))
            return pd.Series(list(of(X @ W + b)))

        return df.withColumn(out, value(F.col(self.features).cast("array<double>")))

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """softmax(x W + b) per row."""
        return self._with(df, out, "array<double>", softmax)

    def margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        """Log odds of class 1 (two classes), not clipped."""
        if self.W.shape[1] != 2:
            raise ValueError("a margin needs two classes")
        return self._with(df, out, "double", lambda z: z[:, 1] - z[:, 0])

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return self.predict_proba(df, "_p").withColumn(out, L.argmax("_p")).drop("_p")

    @property
    def coefficients(self) -> np.ndarray:
        """K x d; two classes: one row, of the log odds of class 1."""
        return (self.W[:, 1:] - self.W[:, :1]).T if self.W.shape[1] == 2 else self.W.T

    @property
    def intercepts(self) -> np.ndarray:
        return self.b[1:] - self.b[:1] if len(self.b) == 2 else self.b


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return e / (e.sum(axis=-1, keepdims=True) + 1e-12)


# ------------------------------------------------------------------- blocks
def _matrix(column: pa.Array, name: str) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    if column.null_count or column.flatten().null_count:
        raise ValueError(f"{name}: null in a training vector")
    size = np.asarray(pc.list_value_length(column))
    if len(size) and (size != size[0]).any():
        raise ValueError(f"{name}: vectors of one length are needed, found {size.min()} to {size.max()}")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


_BLOCK = "x binary, t binary, w binary, fold binary, y binary, n long, x_min int, x_max int, t_min int, t_max int, least double, total array<double>"
BLOCK_NUMBERS = 1 << 17     # features in a block (1 MB)
DIRECT = 64                 # tasks whose sums the driver adds up; of more, tasks do first


def _lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), -1))


def _packed(batches):
    """Rows as blocks of numbers, with what tells whether they can be fitted."""
    for batch in batches:
        size = {c: _lengths(batch.column(c)) for c in ("x", "t")}
        step = max(16, BLOCK_NUMBERS // max(int(size["x"].max(initial=1)), 1))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            own = {c: n[at:at + step] for c, n in size.items()}
            block = {"n": part.num_rows, **{f"{c}_min": int(n.min()) for c, n in own.items()}, **{f"{c}_max": int(n.max()) for c, n in own.items()}}
            w = _matrix(part.column("w"), "w")
            block |= {"least": float(w.min()), "total": w.sum(axis=0).tolist()}
            if all(block[f"{c}_min"] == block[f"{c}_max"] >= 1 for c in own):     # others raise in the driver
                block |= {"w": w.tobytes(), **{c: _matrix(part.column(c), c).tobytes() for c in ("x", "t")}}
                block |= {"fold": _matrix(part.column("fold"), "fold").astype(np.int32).tobytes(), "y": np.asarray(part.column("y"), np.int32).tobytes()}
            yield pa.RecordBatch.from_pylist([block], _BLOCK_ARROW)


_BLOCK_ARROW = pa.schema([(c.split()[0], {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}.get(
    c.split()[1], pa.list_(pa.float64()))) for c in _BLOCK.split(", ")])


class Blocks:
    """Rows for fits: features ``x``, soft targets ``t`` (K numbers; two classes may
    give the one of class 1), true class ``y``, and by trial the weight ``w`` and the ``fold``.

    A fit reads them in every pass, so they are kept as blocks of numbers: a row each
    for about a MB, which a task takes as they are."""

    def __init__(self, df: DataFrame, features: str, probs: Column, weights: Column, folds: Column | None = None,
                 y: Column | None = None):
        w = weights.cast("array<double>")
        rows = df.select(
            F.col(features).cast("array<double>").alias("x"), probs.cast("array<double>").alias("t"), w.alias("w"),
            (F.transform(w, lambda _: F.lit(0)) if folds is None else folds).cast("array<int>").alias("fold"),
            (F.lit(0) if y is None else y).cast("int").alias("y"))
        # an RDD: a pass is then one small job, without a plan of its own
        self.blocks = rows.mapInArrow(_packed, _BLOCK).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        self.spark = df.sparkSession
        self.table = self.spark.createDataFrame(self.blocks, _BLOCK, verifySchema=False)
        try:
            whole = self.table.agg(
                F.sum("n").alias("n"), F.min("least").alias("least"), *[f(f"{c}_{f.__name__}").alias(f"{c}_{f.__name__}") for c in ("x", "t") for f in (F.min, F.max)],
                vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")).first()
            if not whole["n"]:
                raise ValueError("no rows to fit on")
            for c in ("x", "t"):
                low, high = whole[f"{c}_min"], whole[f"{c}_max"]
                if low != high or low < 1:
                    raise ValueError(f"vectors of one length are needed, found {low} to {high}")
            if whole["least"] < 0 or max(whole["total"]) <= 0:
                raise ValueError("weights must be >= 0, and their sum positive")
        except ValueError:
            self.close()
            raise
        self.n, self.d, self.k = whole["n"], whole["x_min"], whole["t_min"]

    def close(self) -> None:
        self.blocks.unpersist()

    def summed(self, run) -> np.ndarray:
        """The arrays that ``run`` yields for the blocks of each task, added up."""
        few = self.blocks.getNumPartitions() <= DIRECT
        return self.blocks.mapPartitions(lambda rows: run(map(_numbers, rows))).treeReduce(np.add, 1 if few else 2)


def _numbers(block) -> tuple[np.ndarray, ...]:
    """x, t, w, fold and y of a block."""
    return tuple(np.frombuffer(b, np.int32 if i > 2 else np.float64).reshape(block[5], -1) for i, b in enumerate(block[:5]))


def _of_blocks(batches):
    for batch in batches:
        yield from map(_numbers, zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))


def _of_rows(batches):
    for batch in batches:
        yield *(_matrix(batch.column(name), name) for name in ("x", "t", "w", "fold")), np.asarray(batch.column("y"))


def matrices(parts, width: int):
    """(x with a last column of ones, t, w, fold, y) of some rows at a time, so
    many that ``width`` numbers of each take 8 MB at most."""
    step = max(16, (1 << 20) // max(width, 1))
    for rows in parts:
        for at in range(0, len(rows[0]), step):
            x, t, w, fold, y = (v[at:at + step] for v in rows)
            yield np.concatenate([x, np.ones((len(x), 1))], axis=1), t, w, fold, y.ravel()


def cell_weights(cells: Sequence[Cell], w: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Weight of every row (rows) in every cell (columns)."""
    trial = np.array([c.trial for c in cells])
    out = np.array([-1 if c.fold is None else c.fold for c in cells])
    return w[:, trial] * (fold[:, trial] != out)


# ------------------------------------------------------------------- passes
def _sums(x, t, w, theta, loss, q, hessian):
    """Loss (cells), gradient (cells x parameters) and Hessian of all cells over one block.

    ``theta``: cells x (d + 1) x logits."""
    cells, d1, logits = theta.shape
    z = (x @ theta.transpose(1, 0, 2).reshape(d1, -1)).reshape(len(x), cells, logits)
    if loss == "odds":
        z = z[:, :, 0]
        p = t[:, -1:]
        value = np.logaddexp(0, z) - p * z
        with np.errstate(over="ignore"):
            s = 1 / (1 + np.exp(-z))
        grad = (w * (s - p))[:, :, None]
    else:
        z = z - z.max(axis=2, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=2, keepdims=True)
        if loss == "softmax":
            value = np.log(total[:, :, 0]) - np.einsum("nk,nck->nc", t, z)
            grad = w[:, :, None] * (e / total * t.sum(axis=1)[:, None, None] - t[:, None, :])
            value += (t.sum(axis=1) - 1)[:, None] * np.log(total[:, :, 0])
        else:
            own = e / (total + 1e-12)
            raised = np.power(np.clip(own, 1e-12, 1.0), q)
            value = (t[:, None, :] * (1 - raised) / q).sum(axis=2)
            both = t[:, None, :] * raised
            grad = w[:, :, None] * (own * both.sum(axis=2, keepdims=True) - both)
    gradient = (x.T @ grad.reshape(len(x), -1)).reshape(d1, cells, logits).transpose(1, 0, 2).reshape(cells, -1)
    h = None
    if hessian:
        curve = w * s * (1 - s)
        h = np.stack([(x * curve[:, c:c + 1]).T @ x for c in range(cells)])
    return (w * value).sum(axis=0), gradient, h


def evaluate_cells(blocks: Blocks, cells, points: dict[int, np.ndarray], loss: str, q: float, hessian: bool):
    """(loss, gradient, Hessian) of each cell in ``points`` (its number -> parameters), from one job."""
    numbers = sorted(points)
    d1 = blocks.d + 1
    shipped = blocks.spark.sparkContext.broadcast(np.stack([points[i].reshape(d1, -1) for i in numbers]))
    own = [cells[i] for i in numbers]
    width = len(own) * shipped.value.shape[2] + d1

    def run(parts):
        done = None
        for x, t, w, fold, _ in matrices(parts, width):
            got = _sums(x, t, cell_weights(own, w, fold), shipped.value, loss, q, hessian)
            done = got if done is None else tuple(None if a is None else a + b for a, b in zip(done, got, strict=True))
        if done is not None:
            value, g, h = done
            yield np.stack([np.concatenate([[value[c]], g[c], h[c].ravel() if hessian else []]) for c in range(len(own))])

    try:
        got = blocks.summed(run)
    finally:
        shipped.destroy()
    p = len(points[numbers[0]])
    return {i: (v[0], v[1:1 + p], v[1 + p:].reshape(d1, d1) if hessian else None) for i, v in zip(numbers, got, strict=True)}


def _grams(blocks: Blocks, cells) -> dict[tuple, np.ndarray]:
    """X'WX of each set of weights that cells have."""
    kinds = sorted({(c.trial, -1 if c.fold is None else c.fold) for c in cells})
    own = [Cell(t, None if f < 0 else f) for t, f in kinds]
    d1 = blocks.d + 1

    def run(parts):
        done = 0
        for x, _, w, fold, _ in matrices(parts, len(own) + d1):
            weight = cell_weights(own, w, fold)
            done = done + np.stack([(x * weight[:, c:c + 1]).T @ x for c in range(len(own))])
        if not isinstance(done, int):
            yield done

    return dict(zip(kinds, blocks.summed(run), strict=True))


# ------------------------------------------------------------------- methods
class _Search:
    """One cell's search: ``point`` is to be evaluated next, ``tell`` takes the result."""

    def __init__(self, start: np.ndarray):
        self.x = self.point = start
        self.f = self.g = self.h = None
        self.step, self.iterations, self.done, self.converged = 1.0, 0, False, False

    def tell(self, f: float, g: np.ndarray, h) -> None:
        if self.f is not None:
            room = 1e-14 * max(1.0, abs(self.f))
            if not f <= self.f + 1e-4 * self.step * self.slope + room:     # also where f isn't a number
                self.step *= 0.5
                if self.step < 1e-12:
                    self.done = True
                self.point = self.x + self.step * self.direction
                return
        self.moved(f, g)
        self.x, self.f, self.g, self.h = self.point, f, g, h
        self.iterations += 1
        if not self.done:
            self.turn()

    def moved(self, f, g) -> None:
        """Called with an accepted point before it is taken."""

    def go(self, direction: np.ndarray) -> None:
        self.direction, self.slope, self.step = direction, float(self.g @ direction), 1.0
        self.point = self.x + direction


class _Newton(_Search):
    def turn(self) -> None:
        size = len(self.x)
        ridge = 1e-13 * max(np.trace(self.h) / size, 1e-300)
        direction = -np.linalg.lstsq(self.h + ridge * np.eye(size), self.g, rcond=None)[0]
        self.go(direction)
        if -self.slope / 2 <= TOLERANCE * max(1.0, abs(self.f)):
            self.x = self.point       # quadratic from here: the step is taken unseen
            self.done = self.converged = True


class _Lbfgs(_Search):
    """``scaled``: the preconditioner's product with a vector."""

    def __init__(self, start, scaled=None, tol: float = TOLERANCE):
        super().__init__(start)
        self.scaled, self.tol, self.s, self.y = scaled or (lambda v: v), tol, [], []
        self.plain = scaled is None

    def moved(self, f, g) -> None:
        if self.f is None:
            return
        s, y = self.point - self.x, g - self.g
        if y @ s > 1e-12 * np.linalg.norm(y) * np.linalg.norm(s):
            self.s, self.y = [*self.s, s][-MEMORY:], [*self.y, y][-MEMORY:]
        if self.plain and abs(self.f - f) <= self.tol * max(1.0, abs(f)):
            self.done = self.converged = True

    def turn(self) -> None:
        v, back = self.g.copy(), []
        for s, y in zip(reversed(self.s), reversed(self.y), strict=True):
            a = s @ v / (y @ s)
            back.append(a)
            v -= a * y
        if self.s:
            s, y = self.s[-1], self.y[-1]
            v = self.scaled(v) * (s @ y) / (y @ self.scaled(y))
        else:
            v = self.scaled(v)
        for s, y, a in zip(self.s, self.y, reversed(back), strict=True):
            v += s * (a - y @ v / (y @ s))
        self.go(-v)
        if self.slope >= 0:
            self.s, self.y = [], []
            self.go(-self.scaled(self.g))
        if -self.slope / 2 <= self.tol * max(1.0, abs(self.f)) or (self.plain and np.linalg.norm(self.g) < self.tol * max(1.0, abs(self.f))):
            self.done = self.converged = True


def fit_cells(blocks: Blocks, cells: Sequence[Cell], loss: str = "odds", q: float = 0.7, soft: bool = False,
              start: np.ndarray | None = None, max_iter: int = 200, tol: float | None = None,
              features: str = "embedding") -> list[LinearSoftmax]:
    """A model for every cell: minimises sum_i w_i loss_i + |W|^2 / (2C), intercepts free.

    ``loss``: "odds" (two classes, one vector), "softmax" or "gce".  ``soft``: the
    penalty is that of a softmax with a vector for each of the two classes (half of
    it on their difference).  ``start``: (d + 1) x logits."""
    d1 = blocks.d + 1
    logits = 1 if loss == "odds" else blocks.k
    lam = [0.0 if c.C is None or np.isinf(c.C) else 1.0 / (2 * c.C if soft and loss == "odds" else c.C) for c in cells]
    mask = np.ones((d1, logits))
    mask[-1] = 0
    mask = mask.ravel()
    x0 = np.zeros(d1 * logits) if start is None else np.asarray(start, float).ravel()
    newton = loss == "odds" and len(cells) * d1 * d1 <= HESSIANS
    if newton:
        searches = [_Newton(x0) for _ in cells]
    elif loss == "gce":
        searches = [_Lbfgs(x0, tol=tol or 1e-8) for _ in cells]
    else:
        grams = _grams(blocks, cells)
        searches = [_Lbfgs(x0, _bound(grams[c.trial, -1 if c.fold is None else c.fold], lam[i], logits), tol or BOUNDED_TOLERANCE)
                    for i, c in enumerate(cells)]
    for _ in range(max_iter):
        open_ = {i: s.point for i, s in enumerate(searches) if not s.done}
        if not open_:
            break
        for i, (f, g, h) in evaluate_cells(blocks, cells, open_, loss, q, newton).items():
            at = open_[i]
            searches[i].tell(f + lam[i] / 2 * float(mask @ (at * at)), g + lam[i] * mask * at,
                             None if h is None else h + lam[i] * np.diag(mask))
    return [_model(s, d1, logits, features, c) for s, c in zip(searches, cells, strict=True)]


def _bound(gram: np.ndarray, lam: float, logits: int):
    """Product with the inverse of a bound of the Hessian (the same for every class)."""
    d1 = len(gram)
    penalty = np.full(d1, lam)
    penalty[-1] = 0
    full = gram * (0.25 if logits == 1 else 1.0 / logits) + np.diag(penalty)
    inverse = np.linalg.pinv(full + 1e-12 * max(np.trace(full) / d1, 1e-300) * np.eye(d1), hermitian=True)
    return lambda v: (inverse @ v.reshape(d1, logits)).ravel()


def _model(s: _Search, d1: int, logits: int, features: str, cell: Cell) -> LinearSoftmax:
    theta = s.x.reshape(d1, logits)
    if logits == 1:
        theta = np.concatenate([-theta / 2, theta / 2], axis=1)
    norm = float(np.linalg.norm(s.g)) if s.g is not None else float("nan")
    if not s.converged:
        warnings.warn(f"fit of {cell} stopped after {s.iterations} iterations, gradient norm {norm:.3g}", stacklevel=3)
    b = theta[-1]
    return LinearSoftmax(theta[:-1], b - b.mean(), features, s.iterations, norm, s.converged)


# ------------------------------------------------------------------- scoring
def scored_cells(blocks: Blocks, cells: Sequence[Cell], models: Sequence[LinearSoftmax]) -> DataFrame:
    """(cell, y, proba): for every cell the rows of its trial that are in its fold
    (without a fold: all rows), under its model."""
    return _scored(blocks.table, cells, models)


def _scored(table: DataFrame, cells, models, read=_of_blocks) -> DataFrame:
    theta = np.stack([np.concatenate([m.W, m.b[None]]) for m in models])
    shipped = table.sparkSession.sparkContext.broadcast(theta)
    own, width = list(cells), theta.shape[1] + theta.shape[2]

    def run(batches):
        for x, _, w, fold, y in matrices(read(batches), width):
            for i, c in enumerate(own):
                rows = slice(None) if c.fold is None else np.flatnonzero((fold[:, c.trial] == c.fold) & (w[:, c.trial] > 0))
                p = softmax(x[rows] @ shipped.value[i])
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(np.full(len(p), i), pa.int32()), "y": pa.array(y[rows], pa.int32()),
                    "proba": pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))})

    return table.mapInArrow(run, "cell int, y int, proba array<double>")


def scored_rows(df: DataFrame, features: str, y: Column, models: Sequence[LinearSoftmax]) -> DataFrame:
    """(cell, y, proba): every row of ``df`` under every model."""
    rows = df.select(F.col(features).cast("array<double>").alias("x"), F.array().cast("array<double>").alias("t"),
                     F.array(F.lit(1.0)).alias("w"), F.array(F.lit(0)).alias("fold"), y.cast("int").alias("y"))
    return _scored(rows, [Cell() for _ in models], models, _of_rows)
