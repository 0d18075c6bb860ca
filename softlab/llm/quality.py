"""Quality classifier with hierarchical empirical Bayes over sites.

1. *Document evidence.*  Two logistic models, good writing and toxicity, are
   fitted on labelled documents (``max_labelled`` at most, chosen by hash of
   id: the one bounded sample here).  Their inputs are the text's shape (blank
   lines, capitals, symbols, repeats, ...) and how strongly its words and word
   beginnings speak for a class: log odds of document counts, taken for each
   half of the sample from the other half, so the models learn how far such
   odds can be trusted.  Each feature of the sample has an entry of its own
   (64-bit keys), and words that aren't in it are unknown.  A document's evidence is the probability that it is
   good and not toxic, from its whole text.
2. *Sites.*  The evidence of all documents is summed by host and by path.  A
   host's mean is a beta posterior: the prior is the global mean, with the
   strength that the spread between hosts calls for (method of moments).  A
   path's prior is its host's posterior mean, with a strength from the spread
   of paths in hosts.  Sparse sites shrink to their host, and it to the world.
3. *Posterior.*  A document's prior is its path's mean without itself; its
   odds are the prior's times the evidence's over the global odds.

Sums by site are aggregated before they are shuffled, so a host with a third
of all rows is one row per task; site means are joined to (id, evidence) rows
without text.

Null and empty texts are scored as such by the shape inputs.  A null host or
path has no site of its own and the prior above it.  With no labels, or of one
class only, the evidence is the (smoothed) share of that label for all.
Repeated rows count as often as they occur.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from . import words as W

MAX_LABELLED = 20_000
RANGES = 16               # of feature keys, summed apart
BEGINNINGS = (3, 4, 5)    # bytes
SAMPLE_TASKS = 8
_EDGE = 1e-6

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>?@^_`{|}~\\"]] = True


def _row_sums(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of a row's entries that are equal to another before them."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16) if len(first) < 1 << 16 else row[order], kind="stable")]
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    seen = np.bincount(row[order][1:][again], minlength=len(first) - 1)
    return seen / np.maximum(np.diff(first), 1)


def shape(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x inputs that don't depend on any label."""
    words = W.Words(buf, offsets, W.NOT_BLANK)
    n = np.maximum(np.diff(words.first), 1)
    size = np.maximum(np.diff(offsets), 1)
    at, five = words.windows(5)
    pairs = np.zeros(len(words), bool)
    if len(words) > 1:
        pairs[1:] = (words.hash[1:] == words.hash[:-1]) & (words.rows[1:] == words.rows[:-1])
    last = buf[words.end - 1] if len(words) else np.empty(0, np.uint8)
    columns = [
        np.log1p(np.diff(words.first)),
        size / n / 10,
        _row_sums(_UPPER[buf], offsets) / np.maximum(_row_sums(_LETTER[buf], offsets), 1),
        _row_sums(_SYMBOL[buf], offsets) / size,
        _row_sums(_SYMBOL[last], words.first) / n,
        _row_sums(_DIGIT[buf], offsets) / size,
        _row_sums(buf == 0x7C, offsets) / n,
        _row_sums(buf == 0x2E, offsets) / n,
        _row_sums(buf == 0x0A, offsets) / n,
        _row_sums(buf >= 0x80, offsets) / size,
        _row_sums(pairs, words.first) / n,
        _repeats(words.hash, words.first),
        _repeats(five, np.searchsorted(at, words.first)),
    ]
    return np.stack(columns, axis=1)


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit keys of each distinct word and its beginnings (distinct words x features),
    each word's place among the distinct, and the rows' offsets in the words."""
    words = W.Words(buf, offsets, W.ALNUM, lower=True)
    distinct, at, place = np.unique(words.hash, return_index=True, return_inverse=True)
    out = np.empty((len(distinct), 1 + len(BEGINNINGS)), np.uint64)
    out[:, 0] = distinct
    order = np.argsort(at)      # as they stand in the text
    start, end = words.start[at[order]], words.end[at[order]]
    for i, k in enumerate(BEGINNINGS, 1):
        out[order, i] = W.mix(W.hash_ranges(words.buf, start, np.minimum(end, start + k)), k)
    return out, place, words.first


def tokens(buf: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each word's features among the sorted keys ``known`` (words x features;
    ``len(known)`` if unknown) and the rows' offsets in the words."""
    keys, place, first = features(buf, offsets)
    at = np.searchsorted(known, keys)
    if len(known):
        at[known[np.minimum(at, len(known) - 1)] != keys] = len(known)
    return at.astype(np.int32)[place], first


class Odds:
    """Log odds of both labels by feature, from document counts; the last entry is
    that of all unknown features (no documents)."""

    def __init__(self, counts: np.ndarray, totals: np.ndarray):
        # counts: (good, bad, toxic, civil) x features; totals: documents of each
        counts = np.hstack([counts, np.zeros((4, 1), counts.dtype)])
        rate = np.log((counts + 0.5) / (totals[:, None] + 1.0))
        self.good = (rate[0] - rate[1]).astype(np.float32)
        self.toxic = (rate[2] - rate[3]).astype(np.float32)

    def inputs(self, found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of both models from the words of each row."""
        rows = len(first) - 1
        n = np.maximum(np.diff(first), 1)
        some = np.flatnonzero(np.diff(first))
        good, toxic = self.good[found[:, 0]], self.toxic[found].max(axis=1, initial=-np.inf)
        top = np.zeros(rows)
        if len(some):
            top[some] = np.maximum.reduceat(toxic, first[:-1][some])
        strong = [np.minimum(_row_sums(toxic > t, first), 5) for t in (3, 5, 7)]
        odds = np.stack([_row_sums(good, first) / n, _row_sums(np.minimum(good, 0) < -2, first) / n], axis=1)
        return odds, np.stack([top, np.maximum(top - 4, 0), np.maximum(top - 6, 0), *strong,
                               _row_sums(np.maximum(toxic - 3, 0), first) / n], axis=1)


class Logistic:
    """L2 logistic regression on standardised inputs, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], l2)
        penalty[-1] = 1e-6
        for _ in range(100):
            p = _sigmoid(z @ self.w)
            gradient = z.T @ (p - y) + penalty * self.w
            hessian = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 4.0 / np.abs(step).max())
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Constant:
    def __init__(self, p: float):
        self.p = p

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.p)


class Evidence:
    """Probability that a text is good and not toxic."""

    def __init__(self, known: np.ndarray, odds: Odds | None, good, toxic):
        self.known, self.odds, self.good, self.toxic = known, odds, good, toxic

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Good writing, toxicity."""
        buf, offsets = W.text_buffer(column)
        if self.odds is None:
            none = np.zeros((len(offsets) - 1, 1))
            return self.good(none), self.toxic(none)
        (a, b), = inputs(buf, offsets, self.known, [self.odds])
        return self.good(a), self.toxic(b)


def inputs(buf: np.ndarray, offsets: np.ndarray, known: np.ndarray, odds: list[Odds]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inputs of both models by each of some odds."""
    form, (found, first) = shape(buf, offsets), tokens(buf, offsets, known)
    both = [o.inputs(found, first) for o in odds]
    return [(np.hstack([form, good]), np.hstack([form[:, :1], toxic])) for good, toxic in both]


_COUNTS = "range int, keys binary, counts binary"


def _packet(r: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary()),
                                       "counts": pa.array([np.ascontiguousarray(counts).tobytes()], pa.binary())})


def _count(batches):
    """Documents with each feature, by half and label (8 rows of counts), by range of keys;
    the numbers of documents stand under one key of a range of their own."""
    shift = np.uint64(64 - RANGES.bit_length() + 1)
    for batch in batches:
        for part in W.slices(batch, "text"):
            keys, place, first = features(*W.text_buffer(part.column("text")))
            keys, found = np.unique(keys, return_inverse=True)
            found = found.reshape(-1, 1 + len(BEGINNINGS))[place]
            row = np.repeat(np.arange(len(first) - 1), np.diff(first) * found.shape[1])
            pair = np.unique(row * len(keys) + found.reshape(-1))
            row, at = np.divmod(pair, max(len(keys), 1))
            half, good, toxic = (np.asarray(part.column(c)) for c in ("half", "good", "toxic"))
            groups = [(half == h) & yes for h in (0, 1) for yes in (good == 1, good == 0, toxic == 1, toxic == 0)]
            counts = np.stack([np.bincount(at[mine[row]], minlength=len(keys)) for mine in groups]).astype(np.int32)
            yield _packet(RANGES, np.zeros(1, np.uint64), np.array([[mine.sum()] for mine in groups], np.int32))
            cuts = np.searchsorted(keys >> shift, np.arange(RANGES + 1, dtype=np.uint64))
            for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if a < b:
                    yield _packet(r, keys[a:b], counts[:, a:b])


def _add(batches):
    """One packet per range: its distinct keys in order and their counts."""
    sent: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for r, keys, counts in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            sent.setdefault(r, []).append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int32).reshape(8, -1)))
    for r, own in sent.items():
        keys, place = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
        sums, done = np.zeros((8, len(keys)), np.int32), 0
        for x, counts in own:
            sums[:, place[done:done + len(x)]] += counts       # distinct in a packet
            done += len(x)
        yield _packet(r, keys, sums)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labelled: int = MAX_LABELLED) -> Evidence:
    """The document models, from ``max_labelled`` labelled documents at most
    (``labels``: id, quality, toxic; other values than 0 and 1 are left out)."""
    spark = docs.sparkSession
    rows = labels.select(labels[id_col].alias("id"), labels["quality"].cast("int").alias("good"),
                         labels["toxic"].cast("int").alias("toxic"))
    rows = rows.filter("id is not null and good in (0, 1) and toxic in (0, 1)").dropDuplicates(["id"])
    chosen = rows.orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(max_labelled)
    sample = shared_table(chosen.withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")), "labelled")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    known = shared_table(texts.join(F.broadcast(sample), "id").dropDuplicates(["id"]).coalesce(SAMPLE_TASKS), "labelled-texts")
    packets = known.mapInArrow(_count, _COUNTS).repartition("range").mapInArrow(_add, _COUNTS)
    got = {r: (np.frombuffer(keys, np.uint64), np.frombuffer(found, np.int32).reshape(2, 4, -1))
           for r, keys, found in packets.toLocalIterator()}
    totals = got.pop(RANGES)[1][:, :, 0].astype(np.int64) if got else np.zeros((2, 4), np.int64)
    if not totals.sum():
        return Evidence(np.empty(0, np.uint64), None, Constant(0.5), Constant(0.0))
    keys = np.concatenate([np.empty(0, np.uint64), *(got[r][0] for r in sorted(got))])
    counts = np.concatenate([np.empty((2, 4, 0), np.int32), *(got[r][1] for r in sorted(got))], axis=2)
    other = spark.sparkContext.broadcast((keys, [Odds(counts[1], totals[1]), Odds(counts[0], totals[0])]))

    def measure(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                buf, offsets = W.text_buffer(part.column("text"))
                both = inputs(buf, offsets, *other.value)
                half = np.asarray(part.column("half"))
                x = [np.where((half == 0)[:, None], both[0][k], both[1][k]) for k in (0, 1)]
                yield pa.RecordBatch.from_pydict({
                    "good": part.column("good"), "toxic": part.column("toxic"),
                    "a": pa.array(x[0].tolist(), pa.list_(pa.float64())), "b": pa.array(x[1].tolist(), pa.list_(pa.float64()))})

    got = known.mapInArrow(measure, "good int, toxic int, a array<double>, b array<double>").toArrow()
    models = []
    for label, x in (("good", "a"), ("toxic", "b")):
        y = np.asarray(got.column(label)).astype(float)
        z = got.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        models.append(Logistic(z, y) if 0 < y.sum() < len(y) else Constant(float((y.sum() + 0.5) / (len(y) + 1))))
    other.unpersist()
    del got
    return Evidence(keys, Odds(counts.sum(axis=0), totals.sum(axis=0)), *models)


def strength(mean: float, spread: float, noise: float) -> float:
    """Beta prior strength with which sites of true means around ``mean`` have the
    variance ``spread - noise``."""
    true = max(spread - noise, 1e-9)
    return float(min(max(mean * (1 - mean) / true - 1, 1.0), 1e6))


def _logit(x: Column) -> Column:
    x = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), x))
    return F.log(x / (1 - x))


def posteriors(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``scored`` (``id``, ``host``, ``path``, ``evidence``, ...) with ``prior`` (the
    path's mean without the row), ``posterior`` and ``kept``."""
    path = (scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"),
                                               F.sum(F.col("evidence") * F.col("evidence")).alias("q")))
    path = shared_table(path, "paths")
    host = path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("q").alias("hq"))
    total = host.agg(F.sum("hn"), F.sum("hs")).first()
    if not total[0]:
        return scored.withColumns({"prior": F.lit(0.5), "posterior": F.lit(0.5), "kept": F.lit(True)})
    mean = min(max(total[1] / total[0], _EDGE), 1 - _EDGE)

    def fitted(sites: DataFrame, n: str, s: str, q: str, around) -> float:
        """Strength from the sites' spread around what is above them."""
        m = F.col(s) / F.col(n)
        own = F.greatest(F.lit(0.0), F.col(q) / F.col(n) - m * m) / F.col(n)   # variance of a site's mean
        row = sites.filter(F.col(n) > 1).agg(F.avg((m - around) * (m - around)), F.avg(own)).first()
        return strength(mean, row[0] or 0.0, row[1] or 0.0)

    above = fitted(host, "hn", "hs", "hq", F.lit(mean))
    hosts = host.filter("host is not null").select("host", ((above * mean + F.col("hs")) / (above + F.col("hn"))).alias("host_mean"))
    paths = path.filter("host is not null and path is not null").join(hosts, "host")
    below = fitted(paths, "n", "s", "q", F.col("host_mean"))
    paths = paths.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s"))
    rows = scored.join(hosts, "host", "left").join(paths, ["host", "path"], "left")
    top = F.coalesce("host_mean", F.lit(mean))
    n = F.coalesce("path_n", F.lit(1)) - 1
    s = F.coalesce("path_s", F.col("evidence")) - F.col("evidence")
    prior = (below * top + F.greatest(F.lit(0.0), s)) / (below + n)
    odds = _logit(prior) + _logit(F.col("evidence")) - float(np.log(mean / (1 - mean)))
    rows = rows.withColumns({"prior": prior, "posterior": 1 / (1 + F.exp(-odds))})
    return rows.select(*scored.columns, "prior", "posterior", (F.col("posterior") >= threshold).alias("kept"))


def score(docs: DataFrame, evidence: Evidence, id_col: str, text_col: str, host: Column, path: Column,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, path, quality, toxic, evidence) of every whole text, and the columns ``carry``."""
    model = docs.sparkSession.sparkContext.broadcast(evidence)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                good, toxic = model.value(part.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "host": part.column("host"), "path": part.column("path"),
                    "quality": pa.array(good), "toxic": pa.array(toxic), "evidence": pa.array(good * (1 - toxic)),
                    **{c: part.column(c) for c in carry}})

    rows = docs.select(docs[id_col].alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                       docs[text_col].alias("text"), *[docs[c] for c in carry])
    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"id {kind}, host string, path string, quality double, toxic double, evidence double{more}")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host: Column | None = None, path: Column | None = None, threshold: float = 0.5,
             max_labelled: int = MAX_LABELLED, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, ``host``, ``path``, ``quality``, ``toxic``, ``evidence``, the columns ``carry``
    as they are, ``prior``, ``posterior`` and ``kept``.  By default a document's host is its ``source``,
    and its path the ``lang`` below it."""
    host = docs["source"] if host is None else host
    path = docs["lang"] if path is None else path
    evidence = fit(docs, labels, id_col, text_col, max_labelled)
    scored = shared_table(score(docs, evidence, id_col, text_col, host, path, carry), "evidence")
    return posteriors(scored, threshold).withColumnRenamed("id", id_col)


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL (null where there is none)."""
    return (F.lower(F.try_parse_url(url, F.lit("HOST"))),
            F.nullif(F.split_part(F.try_parse_url(url, F.lit("PATH")), F.lit("/"), F.lit(2)), F.lit("")))
