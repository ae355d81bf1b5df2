"""Toxicity: a linear-chain conditional random field tags toxic words; documents get scores and spans.

Labels are of documents, so words are labelled first: a word of a toxic document counts as toxic
if one of its features (the word, its beginnings, its ending) is in far more toxic documents than
clean ones, by a lower confidence bound of the log odds. The field has two states, weights for
hashed features and for transitions, and is fitted to segments of those documents. Its
forward-backward marginals give each word's probability; sums and maxima of them, by a logistic
model fitted to the labels, give the document's score, and runs of likely words its spans.

The fit uses a bounded sample of labelled rows, and of their segments, in one task; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Labelled rows to fit on at most: those with the least hashes of their doc_id.
SAMPLE = 4_000
BITS = 18
#: Lengths in bytes of the beginnings of a word that are features, and of its ending.
PREFIXES, SUFFIX = (4, 5, 6, 7, 8), 4
#: Words of a segment; a text's last one, or a short text's only one, is padded.
SEGMENT = 24
#: Segments to fit on at most: with suspect words, and without (as many as with, if those are more).
HARD_SEGMENTS, OTHER_SEGMENTS = 20_000, 2_000
SPANS = "array<struct<start:int,end:int,probability:double>>"


@dataclass
class Model:
    weights: np.ndarray  # of features, for the toxic state
    bias: float
    transitions: np.ndarray  # 2 x 2, as factors
    document: np.ndarray  # weights of document features; the first is the intercept


def _split(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, text offsets, words' starts and ends, first words, hashes."""
    data, at = T.flat(column)
    low = T.LOWER[data]
    starts, ends, first = T.spans(low, at, T.NOT_ALNUM)
    hashes = np.empty(len(starts), np.uint64)
    for i, j in T.slices(at):
        a, b = first[i], first[j]
        hashes[a:b] = T.span_hash(low[at[i] : at[j]], starts[a:b] - at[i], ends[a:b] - at[i])
    return low, at, starts, ends, first, hashes


def _features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words x features: hashed feature numbers; a feature that a short word lacks repeats the word itself."""
    lengths = ends - starts
    total = np.cumsum(lengths)
    own = total - lengths
    small = low[np.arange(int(total[-1]) if len(total) else 0) - np.repeat(own, lengths) + np.repeat(starts, lengths)]
    out = np.empty((len(starts), len(PREFIXES) + 2), np.int32)
    mask = np.uint64((1 << BITS) - 1)
    for k, p in enumerate((None, *PREFIXES)):
        end = total if p is None else np.minimum(own + p, total)
        salt = np.where(end < total, np.uint64(0x5851F42D4C957F2D), np.uint64(1))
        out[:, k] = T.mix(T.span_hash(small, own, end) * salt) & mask
    begin = np.maximum(total - SUFFIX, own)
    salt = np.where(begin > own, np.uint64(0x14057B7EF767814F), np.uint64(1))
    out[:, -1] = T.mix(T.span_hash(small, begin, total) * salt) & mask
    return out


def _distinct(low, starts, ends, hashes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the distinct words, and the number of each word among them."""
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return _features(low, starts[index], ends[index]), inverse


# Fitting


def _marginals(e: np.ndarray, t: np.ndarray, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For segments x words of log odds and log transitions: P(toxic), and the sum of pair probabilities.

    Words of a segment that aren't `real` come after those that are. They have no odds and their transitions don't count, so
    the rest is as if they weren't there; their own probability means nothing.
    """
    s, n = e.shape
    real = np.ones((s, n), bool) if real is None else real
    e = np.where(real, e, 0.0)
    emit = np.stack([np.zeros_like(e), e], 2)
    a, b = np.empty((s, n, 2)), np.zeros((s, n, 2))
    a[:, 0] = emit[:, 0]
    for i in range(1, n):
        x = emit[:, i] + np.logaddexp(a[:, i - 1, :1] + t[0], a[:, i - 1, 1:] + t[1])
        a[:, i] = np.where(real[:, i, None], x, a[:, i - 1])
    for i in range(n - 2, -1, -1):
        x = emit[:, i + 1] + b[:, i + 1]
        b[:, i] = np.where(real[:, i + 1, None], np.logaddexp(t[:, 0] + x[:, :1], t[:, 1] + x[:, 1:]), 0.0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        x = a[:, i - 1, :, None] + t + (emit[:, i] + b[:, i])[:, None, :] - z[:, None, None]
        pairs += np.exp(np.minimum(x, 0))[real[:, i]].sum(0)
    return np.exp(np.minimum(a[:, :, 1] + b[:, :, 1] - z[:, None], 0)), pairs


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 0.3
        step = np.linalg.solve(h, x.T @ (y - p) - 0.3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(p)]
    total = sums[first[1:]] - sums[first[:-1]]
    n = np.diff(first)
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.stack([np.log1p(total), np.sqrt(total), top, np.log1p(100 * total / np.maximum(n, 20)), np.minimum(total, 3)], 1)


def fit(rows: list[tuple[str | None, int]], seed: int = 1) -> Model:
    """Fits to (text, toxic) rows. Without rows of both labels the model scores every text alike, at the share of toxic rows."""
    y = np.array([int(t or 0) for _, t in rows], float)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    none = Model(np.zeros(1 << BITS, np.float32), -30.0, np.ones((2, 2)), np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    if not len(y) or y.min() == y.max():
        return none
    low, _, starts, ends, first, hashes = _split(pa.array([t for t, _ in rows], pa.string()))
    if not len(starts):
        return none
    features, word = _distinct(low, starts, ends, hashes)
    word, doc = word.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(first))
    del low, starts, ends, hashes
    # words by document once, then features by document once, some documents at a time
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for low_doc in range(0, len(rows), 250):
        a, b = first[low_doc], first[min(low_doc + 250, len(rows))]
        pairs = np.unique(doc[a:b].astype(np.int64) * len(features) + word[a:b])
        d, w = pairs // len(features), pairs % len(features)
        seen = np.unique((d[:, None] << BITS | features[w]).ravel())
        toxic_doc = y[seen >> BITS] > 0
        slot = seen & ((1 << BITS) - 1)
        pos += np.bincount(slot[toxic_doc], minlength=1 << BITS)
        neg += np.bincount(slot[~toxic_doc], minlength=1 << BITS)
    n_pos, n_neg = y.sum(), len(y) - y.sum()
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    bound = odds - 2 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    bound[pos < 4] = -9
    suspect = (bound[features].max(1) > 1.2)[word]
    label = suspect & (y[doc] > 0)
    # segments of documents; all with suspect words, and as many others
    size = -(-np.diff(first) // SEGMENT)
    begin = np.repeat(first[:-1], size) + (np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)) * SEGMENT
    left = np.minimum(np.repeat(first[1:], size) - begin, SEGMENT)
    real = np.arange(SEGMENT) < left[:, None]
    at = np.minimum(begin[:, None] + np.arange(SEGMENT), len(word) - 1)
    hot = (suspect[at] & real).any(1)
    hard = np.flatnonzero(hot)
    rng = np.random.default_rng(seed)
    other = rng.permutation(np.flatnonzero(~hot))[: max(OTHER_SEGMENTS, len(hard))]
    use = np.r_[rng.permutation(hard)[:HARD_SEGMENTS], other]
    at, real = at[use], real[use]
    f, target = features[word[at]], np.where(real, label[at], False).astype(float)
    weights, bias, t = np.zeros(1 << BITS), -2.0, np.zeros((2, 2))
    g_w, g_b, g_t = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    wanted = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            wanted[i, j] = ((target[:, :-1] == i) & (target[:, 1:] == j) & real[:, 1:]).sum()
    for _ in range(40):
        p, pairs = _marginals(weights[f].sum(2) + bias, t, real)
        error = np.where(real, target - p, 0.0)
        grad = np.bincount(f.ravel(), np.repeat(error.ravel(), f.shape[2]), 1 << BITS) - 0.02 * weights
        g_w += grad**2
        weights += 0.4 * grad / np.sqrt(g_w)
        g = error.sum()
        g_b += g * g
        bias += 0.4 * g / np.sqrt(g_b)
        g = wanted - pairs - 1.0 * t
        g_t += g**2
        t += 0.2 * g / np.sqrt(g_t)
    model = Model(weights.astype(np.float32), float(bias), np.exp(np.clip(t, -8, 8)), np.zeros(6))
    p = _words(model, features, word, first)
    model.document = _logistic(_document_features(p, first), y)
    return model


# Scoring


def _words(model: Model, features: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """P(toxic) of every word: forward and backward ratios of the two states, over all texts at once."""
    odds = np.exp(np.clip(model.weights[features].sum(1) + model.bias, -30, 30))[word]
    (s00, s01), (s10, s11) = model.transitions
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    forward, backward = np.empty(len(word)), np.empty(len(word))
    r = np.zeros(0)
    for i, k in enumerate(live.tolist()):
        at = begin[:k] + i
        r = odds[at] if not i else odds[at] * (s01 + s11 * r[:k]) / (s00 + s10 * r[:k])
        forward[at] = r
    b = np.zeros(0)
    for i in range(len(live) - 1, -1, -1):
        k = int(live[i])
        at = begin[:k] + i
        new = np.ones(k)
        m = len(b)
        if m:
            x = odds[at[:m] + 1] * b
            new[:m] = (s10 + s11 * x) / (s00 + s01 * x)
        backward[at] = b = new
    x = forward * backward
    return x / (1 + x)


def _spans(p: np.ndarray, low: np.ndarray, at: np.ndarray, starts, ends, first, least: float) -> list[list[dict]]:
    """Runs of words of at least that probability, as code point offsets into each text."""
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    hot = np.flatnonzero(p >= least)
    if not len(hot):
        return out
    doc = np.searchsorted(first, hot, "right") - 1
    cuts = np.flatnonzero((np.diff(hot) > 1) | (np.diff(doc) > 0)) + 1
    for run in np.split(np.arange(len(hot)), cuts):
        d, a, b = int(doc[run[0]]), int(starts[hot[run[0]]]), int(ends[hot[run[-1]]])
        lead = int(np.count_nonzero((low[at[d] : a] & 0xC0) != 0x80))
        out[d].append({"start": lead, "end": lead + int(np.count_nonzero((low[a:b] & 0xC0) != 0x80)), "probability": float(p[hot[run]].max())})
    return out


def score_batch(model: Model, column) -> tuple[np.ndarray, tuple]:
    low, at, starts, ends, first, hashes = _split(column)
    if len(starts):
        features, word = _distinct(low, starts, ends, hashes)
        p = _words(model, features, word, first)
    else:
        p = np.zeros(0)
    x = np.c_[np.ones(len(first) - 1), _document_features(p, first)] @ model.document
    return 1 / (1 + np.exp(-np.clip(x, -30, 30))), (p, low, at, starts, ends, first)


def _sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` ids and labels: small enough for every task
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> list[tuple[str | None, int]]:
    """At most `most` labelled texts, those with the least hashes of doc_id; rows without a label don't count."""
    got = _sample(docs, labels, label, most).toArrow()
    return list(zip(got["text"].to_pylist(), got["label"].to_pylist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Model:
    """A model of `labelled_sample`, fitted by one task on an executor; the driver gets the model alone."""

    def run(batches):
        rows = [x for b in batches for x in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True)]
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    row = _sample(docs, labels, label, most).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(row[0])) if row else fit([])


def annotate(docs: DataFrame, model: Model, spans: bool = True, least: float = 0.5) -> DataFrame:
    """The documents, with all columns, and toxic_score (0 to 1) and toxic_spans (code point offsets of likely toxic runs).

    Only text is read. Null and empty texts get the score of a text without toxic words, and no spans. Every row is scored
    by itself, so repeated rows get equal scores; existing columns of those two names are replaced. A text may be of any length.
    """
    docs = docs.drop("toxic_score", "toxic_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches):
        for block in T.blocks(batches, "text", 2 << 20):
            score, rest = score_batch(shared.value, block.column("text"))
            found = _spans(*rest, least) if spans else [None] * block.num_rows
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            yield pa.record_batch([*block.columns, pa.array(score), pa.array(found, kind)], names=[*block.schema.names, "toxic_score", "toxic_spans"])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + f", toxic_score double, toxic_spans {SPANS}"
    return docs.mapInArrow(emit, schema)


def training_rows(doc_id: str = "doc_id"):
    """Rows to learn labels from: those whose crc32 of the doc_id as text isn't divisible by 5, or that have no doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(True))
