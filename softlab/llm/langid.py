"""Language identification by a linear-chain conditional random field.

Every word gets a language, from its own features (bytes at its beginning and
end, its byte n-grams, membership in each language's learned lexicon) and
learned transitions from word to word; so a text may switch languages.  A
document's language is the one with the largest sum of word posteriors
(forward-backward), its score their mean.

The model is fitted on sequences of words of ``max_docs`` documents at most
(``per_doc`` of ``SEQUENCE`` words from anywhere in each, chosen by hash: the
one bounded sample here), labelled with their document's language.  Sequences
of different documents are joined piece by piece, so that there are switches
to learn from.

Forward-backward runs over all words of a sub-batch at once: the words are
cut into lanes of equal length, each lane's product of transition matrices is
taken side by side, lanes are combined in turn, and a second run fills in the
vectors.  Rows begin with a reset, so documents don't touch, whatever their
lengths; a very long text is cut into many lanes and is still exact.

Null texts and texts without a letter are ``und`` with score 0; so are all, if
there is nothing to learn from.  Of equal languages the first by name is
taken.  Rows are independent and nothing is shuffled; repeated rows repeat.
Only the text is read for a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

MAX_DOCS, PER_DOC, SEQUENCE = 4000, 2, 40
BUCKETS = 1 << 17
AFFIXES = (1, 2, 3, 4)
LEXICON = 300            # most telling words of each language
LEAST_DOCS = 200         # labelled documents of a language that are learned from, if it has them
MAX_LANGS = 500          # languages, the most frequent ones, in a sample
LANES = 1024
STEPS = 60
UNKNOWN = "und"


class Vocabulary:
    """Distinct words of a buffer: their features, and which word is which."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        words = W.Words(buf, offsets, W.ALNUM, lower=True)
        self.first = words.first
        self.hash, at, self.which = np.unique(words.hash, return_index=True, return_inverse=True)
        start, size = words.start[at], (words.end - words.start)[at]
        n = len(at)
        # the distinct words between two marks each, one after another
        begin = np.cumsum(size + 2) - (size + 2)
        text = np.full(int((size + 2).sum()), 2, np.uint8)
        text[begin] = 1
        text[W.ranges(begin + 1, size)] = words.buf[W.ranges(start, size)]
        owner = np.repeat(np.arange(n), size + 2)
        left = np.repeat(begin + size + 2, size + 2) - np.arange(len(text))
        own, found = [], []
        for k in (2, 3):
            key = np.zeros(max(len(text) - k + 1, 0), np.uint64)
            for i in range(k):
                key = key * np.uint64(256) + text[i:i + len(key)]
            ok = left[:len(key)] >= k
            own.append(owner[:len(key)][ok])
            found.append(W.mix(key[ok], 20 + k))
        for k in AFFIXES:
            for side, (a, b) in enumerate(((begin + 1, np.minimum(begin + 1 + k, begin + 1 + size)),
                                           (np.maximum(begin + 1 + size - k, begin + 1), begin + 1 + size))):
                own.append(np.arange(n))
                found.append(W.mix(W.hash_ranges(text, a, b), 30 + 2 * k + side))
        self.owner = np.concatenate(own)
        self.feature = (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)
        self.size = n


class Crf:
    """Feature, lexicon and transition weights of some languages."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((BUCKETS, k))
        self.lexicon = np.empty(0, np.uint64)     # sorted word hashes
        self.member = np.zeros((0, k), bool)
        self.known = np.zeros((k, k))             # weight of label given membership
        self.step = np.zeros((k, k))              # from, to
        self.begin = np.zeros(k)

    def membership(self, v: Vocabulary) -> np.ndarray:
        out = np.zeros((v.size, len(self.labels)), bool)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, v.hash), len(self.lexicon) - 1)
            hit = self.lexicon[at] == v.hash
            out[hit] = self.member[at[hit]]
        return out

    def emissions(self, v: Vocabulary) -> np.ndarray:
        """Scores of the distinct words."""
        out = self.membership(v) @ self.known
        for j in range(len(self.labels)):
            out[:, j] += np.bincount(v.owner, self.weights[v.feature, j], v.size)
        return out


def _positive(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30


def marginals(e: np.ndarray, first: np.ndarray, step: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors (each normalised) and word posteriors.
    e: positive word potentials; first: offsets of the rows; step, begin: positive."""
    n, k = e.shape
    lanes = min(LANES, max(1, n // 64))
    length = -(-n // lanes)
    padded = np.full((lanes * length, k), 1.0)
    padded[:n] = e
    e_ = padded.reshape(lanes, length, k).transpose(1, 0, 2)      # by step, then lane
    reset = np.zeros(lanes * length, bool)
    reset[first[:-1][np.diff(first) > 0]] = True
    reset[n:] = True
    reset = reset.reshape(lanes, length).T

    def forward(state: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        for t in range(length):
            new = (state.reshape(-1, k) @ step).reshape(state.shape)
            r = np.flatnonzero(reset[t])
            if len(r):
                new[r] = state[r].sum(axis=-1, keepdims=True) * begin
            e_t = e_[t] if state.ndim == 2 else e_[t][:, None, :]
            state = new * e_t
            state /= state.sum(axis=-1, keepdims=True) if state.ndim == 2 else state.sum(axis=(1, 2), keepdims=True)
            if keep is not None:
                keep[t] = state
        return state

    def backward(state: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
        for t in reversed(range(length)):
            if keep is not None:
                keep[t] = state
            e_t = e_[t] if state.ndim == 2 else e_[t][:, None, :]
            weighed = state * e_t
            new = (weighed.reshape(-1, k) @ step.T).reshape(state.shape)
            r = np.flatnonzero(reset[t])
            if len(r):
                new[r] = (weighed[r] * begin).sum(axis=-1, keepdims=True)
            state = new / (new.sum(axis=-1, keepdims=True) if state.ndim == 2 else new.sum(axis=(1, 2), keepdims=True))
        return state

    eye = np.broadcast_to(np.eye(k), (lanes, k, k))
    ahead, behind = forward(eye, None), backward(eye, None)       # rows: the state that the lane is entered with
    enter = np.full((lanes, k), 1.0 / k)
    for i in range(1, lanes):
        x = enter[i - 1] @ ahead[i - 1]
        enter[i] = x / x.sum()
    leave = np.full((lanes, k), 1.0 / k)
    for i in range(lanes - 2, -1, -1):
        x = leave[i + 1] @ behind[i + 1]
        leave[i] = x / x.sum()
    alpha, beta = np.empty_like(e_), np.empty_like(e_)
    forward(enter, alpha)
    backward(leave, beta)
    alpha, beta = (x.transpose(1, 0, 2).reshape(-1, k)[:n] for x in (alpha, beta))
    post = alpha * beta
    return alpha, beta, post / post.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 5) -> Crf:
    """Fit on word sequences: conditional likelihood with an L2 penalty, by Adam."""
    labels = sorted(set(langs))
    model = Crf(labels)
    if not labels:
        return model
    k = len(labels)
    rng = np.random.Generator(np.random.PCG64(seed))
    v = Vocabulary(*W.text_buffer(pa.array(texts, pa.string())))
    of = np.array([labels.index(x) for x in langs])
    size = np.diff(v.first)
    # pieces of 5 to 20 words, dealt into sequences at random
    pieces = [(a, min(a + s, e)) for b, e in zip(v.first[:-1], v.first[1:], strict=True)
              for s in [int(rng.integers(5, 21))] for a in range(int(b), int(e), s)]
    order = rng.permutation(len(pieces))
    span = np.array(pieces, np.int64).reshape(-1, 2)[order]
    at = W.ranges(span[:, 0], span[:, 1] - span[:, 0])
    y = np.repeat(of, size)[at]
    which = v.which[at]
    if not len(at):
        return model
    cuts = np.concatenate([[0], np.cumsum(span[:, 1] - span[:, 0])])
    first = np.unique(np.concatenate([cuts[::4], cuts[-1:]]))
    counts = np.zeros((v.size, k))
    np.add.at(counts, (which, y), 1)
    # the lexicon: words of three and more, by how much more often one language has them
    share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * v.size)
    telling = np.where(counts.sum(axis=1, keepdims=True) >= 3, counts * np.log(share / share.mean(axis=1, keepdims=True)), 0)
    member = np.zeros((v.size, k), bool)
    for j in range(k):
        top = np.argsort(-telling[:, j], kind="stable")[:LEXICON]
        member[top[telling[top, j] > 0], j] = True
    listed = member.any(axis=1)
    model.lexicon, model.member = v.hash[listed], member[listed]     # hashes are sorted

    n = len(at)
    start = first[:-1]
    inner = np.ones(n, bool)
    inner[start] = False
    real = np.zeros((k, k))
    np.add.at(real, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    real_begin = np.bincount(y[start], minlength=k).astype(float)
    gold = np.zeros((v.size, k))
    np.add.at(gold, (which, y), 1)
    params = [model.weights, model.known, model.step, model.begin]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    inside = model.membership(v).astype(float)
    for i in range(1, STEPS + 1):
        e = _positive(model.emissions(v))[which]
        step, begin = np.exp(model.step), np.exp(model.begin)
        alpha, beta, post = marginals(e, first, step, begin)
        word = np.stack([np.bincount(which, post[:, j], v.size) for j in range(k)], axis=1) - gold
        weight = np.stack([np.bincount(v.feature, word[v.owner, j], BUCKETS) for j in range(k)], axis=1)
        weighed = (e * beta)[1:][inner[1:]]
        pair = alpha[:-1][inner[1:]][:, :, None] * step * weighed[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        gradients = [weight / n + 1e-7 * model.weights, inside.T @ word / n + 1e-6 * model.known,
                     (pair.sum(axis=0) - real) / n + 1e-6 * model.step, (post[start].sum(axis=0) - real_begin) / n]
        for p, g, (m, s) in zip(params, gradients, moment, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-10)
    return model


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_DOCS, per_doc: int = PER_DOC) -> Crf:
    """A model from rows with a language and a text."""
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[lang_col].alias("lang")).dropna()
    # by language: its share of the sample, and LEAST_DOCS at least (or all it has)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    total = sum(r["n"] for r in sizes)
    share = [(r["lang"], r["n"], max(LEAST_DOCS, round(max_docs * r["n"] / total))) for r in sizes]
    quota = df.sparkSession.createDataFrame(share, "lang string, n long, most int")
    h = F.xxhash64("id", F.lit("crf"))
    # four times the share by hash, of which the first are ranked: no language is sorted whole
    some = rows.select("id", "lang").join(F.broadcast(quota), "lang").filter(F.pmod(h, F.lit(1 << 20)) / float(1 << 20) <= 4.0 * F.col("most") / F.col("n"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(h, "id")))
    chosen = ranked.filter("rank <= most").select("id", "lang").distinct()
    known = rows.join(F.broadcast(chosen), ["id", "lang"]).dropDuplicates(["id"])

    def cut(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts, langs = [], []
                buf, offsets = W.text_buffer(part.column("text"))
                words = W.Words(buf, offsets, W.ALNUM, lower=True)
                for r, lang in enumerate(part.column("lang").to_pylist()):
                    a, b = int(words.first[r]), int(words.first[r + 1])
                    begins = np.arange(a, b, SEQUENCE)
                    for s in begins[np.argsort(W.mix(words.hash[begins]))[:per_doc]].tolist():
                        texts.append(buf[words.start[s]:words.end[min(s + SEQUENCE, b) - 1]].tobytes().decode())
                        langs.append(lang)
                yield pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())})

    got = sorted((r[0], r[1]) for r in known.mapInArrow(cut, "text string, lang string").collect())
    return train([t for t, _ in got], [x for _, x in got])


def label_words(text: pa.Array, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words (words x languages) and the rows' offsets."""
    v = Vocabulary(*W.text_buffer(text))
    if not v.size:
        return np.zeros((0, len(model.labels))), v.first
    e = _positive(model.emissions(v))[v.which]
    return marginals(e, v.first, np.exp(model.step), np.exp(model.begin))[2], v.first


def identify(df: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` (0 to 1) and ``segments``: runs of words of one
    language (``lang``, ``start`` and ``n`` in words of letters and digits)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                yield _answer(part, sent.value)

    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).withColumn("letter", letter)
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, "
                                "segments array<struct<lang:string,start:int,n:int>>").withColumnRenamed("id", id_col)


_SEGMENT = pa.struct([("lang", pa.string()), ("start", pa.int32()), ("n", pa.int32())])


def _answer(part: pa.RecordBatch, model: Crf) -> pa.RecordBatch:
    n = part.num_rows
    letter = np.asarray(part.column("letter"))
    names = np.array([*model.labels, UNKNOWN], object)
    best, score = np.full(n, len(model.labels)), np.zeros(n)
    offsets, labels, start, size = np.zeros(n + 1, np.int32), [], np.empty(0), np.empty(0)
    if model.labels:
        post, first = label_words(part.column("text"), model)
        sums = np.vstack([np.zeros(post.shape[1]), np.cumsum(post, axis=0)])
        total = sums[first[1:]] - sums[first[:-1]]
        mean = total / np.maximum(np.diff(first), 1)[:, None]
        best = np.where(letter, mean.argmax(axis=1), len(model.labels))
        score = np.where(letter, np.clip(mean.max(axis=1), 0, 1), 0.0)
        word = post.argmax(axis=1) if len(post) else np.empty(0, np.int64)
        row = np.repeat(np.arange(n), np.diff(first))
        at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (row[1:] != row[:-1])])) if len(word) else np.empty(0, np.int64)
        size = np.diff(at, append=len(word))
        start = at - first[row[at]]
        labels = word[at]
        offsets = np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)
    segments = pa.StructArray.from_arrays(
        [pa.array(names[labels].tolist() if len(labels) else [], pa.string()), pa.array(start, pa.int32()), pa.array(size, pa.int32())],
        fields=list(_SEGMENT))
    return pa.RecordBatch.from_pydict({
        "id": part.column("id"), "lang_pred": pa.array(names[best].tolist(), pa.string()), "score": pa.array(score),
        "segments": pa.ListArray.from_arrays(pa.array(offsets), segments)})


def held_out(doc_id: Column) -> Column:
    """Rows that a model must not learn from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
