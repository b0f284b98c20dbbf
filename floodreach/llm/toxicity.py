"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and character n-grams inside words is trained in numpy from documents confirmed as toxic
and from unlabelled documents, by a risk estimator that corrects for the share of toxic documents among the latter (the class
prior p): ``p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic))``, with the logistic loss. Where the estimate of the negative risk is
below zero in a batch, the batch is being overfitted and the step goes the other way. No document is trained on as clean.

The prior, unless given, is the mean label over the labelled documents that may be learned from. Values are roots of counts times
rarity among the unlabelled, scaled to length one. Weights are shrunk at every step, so features of single examples stay at zero,
and afterwards stretched again by one factor, fitted by the same risk.

Scale: training uses about ``POSITIVES`` toxic and ``UNLABELLED`` other documents, by hash, fewer where they are long: about ``TRAIN_CHARS``
characters of each kind at most. Only these reach the driver. Scoring is one pass over all whole texts without a shuffle, with two
fixed tables of ``BUCKETS`` numbers; memory holds the features of ``scan.SLICE`` bytes, or of the longest text.

Defined cases: a null or wordless text has the score of the intercept; a document with several labels counts with their mean, 0.5
and more as toxic; null labels and null ids do not train; without toxic examples or without unlabelled text every score is the prior
(``DEFAULT_PRIOR`` where no label tells it); repeated rows are scored each and train as one; long texts are scored whole, but those above
``LONGEST_TRAINED`` are not trained on; nothing is ranked, so ties are no matter; an empty table has no rows; other columns are not read."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan
from .sample import hash_share

SIZES, BUCKETS_LOG2 = (3, 4, 5, 6), 18
BUCKETS = 1 << BUCKETS_LOG2
POSITIVES, UNLABELLED = 2000, 4000
TRAIN_CHARS, LONGEST_TRAINED = 16_000_000, 60_000
EPOCHS, BATCH, RATE, SEED = 12, 64, 0.1, 5
SHRINK = 1e-4
SLACK, BACK = 0.0, 1.0  # how far below zero the negative risk may fall, and the weight of a step back
DEFAULT_PRIOR = 0.1
HOLD_MOD = 5  # a remainder of 0 is held out
LIMIT = 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every run of 3 to 6 characters inside a word, where its start in the word is told apart."""
    data = scan.LOWER[data]
    start, end, row, word = scan.runs(data, offsets, scan.ALNUM)
    rows, found = [row], [scan.mix(word ^ _ODD)]
    if len(start):
        size = end - start
        inside = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        letters = data[inside]
        first = np.flatnonzero((letters & 0xC0) != 0x80)  # where characters begin
        of_word = np.repeat(np.arange(len(start)), size)[first]
        # A character's bytes as one number
        code = letters[first].astype(np.uint64)
        stop = np.append(first[1:], len(letters))
        for j in range(1, 4):
            more = first + j < stop
            code[more] = code[more] * np.uint64(256) + letters[first[more] + j]
        code = scan.mix(code + np.uint64(1))
        opens = np.ones(len(first), bool)
        opens[1:] = of_word[1:] != of_word[:-1]
        run = np.where(opens, code + _ODD, code)
        for n in range(2, max(SIZES) + 1):
            run = run[:-1] * np.uint64(0xD1342543DE82EF95) + code[n - 1:] if len(run) > 1 else run[:0]
            if n in SIZES:
                whole = of_word[:len(run)] == of_word[n - 1:] if len(run) else np.zeros(0, bool)
                found.append(scan.mix(run[whole] + np.uint64(n)))
                rows.append(row[of_word[:len(run)][whole]])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def vectors(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the occurring features, rows ascending: roots of counts times rarity, their squares adding up to one in a row."""
    row, bucket = features(data, offsets)
    key, count = np.unique(row * BUCKETS + bucket, return_counts=True)
    row, at = key >> BUCKETS_LOG2, key & (BUCKETS - 1)
    value = np.sqrt(count) if rarity is None else np.sqrt(count) * rarity[at]
    norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
    return row, at, value / np.maximum(norm, 1e-12)[row]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(z: np.ndarray, toxic: np.ndarray, prior: float, slack: float = SLACK, back: float = BACK) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores ``z``, and the direction of the step: its gradient, or where the negative part is below
    ``-slack`` that part's gradient turned round."""
    n_p, n_u = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    as_toxic, as_clean = np.logaddexp(0, -z), np.logaddexp(0, z)  # losses
    s = _sigmoid(z)
    positive = prior * as_toxic[toxic].sum() / n_p
    negative = as_clean[~toxic].sum() / n_u - prior * as_clean[toxic].sum() / n_p
    step = np.where(toxic, -prior * s / n_p, s / n_u)  # of the negative part
    if negative < -slack:
        return positive, -back * step
    return positive + negative, step + np.where(toxic, -prior * (1 - s) / n_p, 0.0)


def stretched(z: np.ndarray, toxic: np.ndarray, prior: float, bias: float, steps: int = 4000) -> tuple[float, float]:
    """Scale and intercept of the scores ``z``, whose spread the shrinking of weights has narrowed, by the same risk over all examples."""
    unit = max(1e-9, float(z.std()))
    x, ab, grown = np.stack([z / unit, np.ones(len(z))]), np.array([unit, bias]), np.full(2, 1e-10)
    for _ in range(steps):
        g = x @ risk(ab @ x, toxic, prior)[1]
        grown += g * g
        ab = ab - 0.5 * g / np.sqrt(grown)
    return float(max(0.0, ab[0]) / unit), float(ab[1])


def fit(texts: list[str], toxic: list[bool], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, rarity and intercept from toxic and unlabelled texts, by stochastic gradient descent with a rate per weight."""
    flags = np.array(toxic, bool)
    weights, rarity, bias = np.zeros(BUCKETS), np.ones(BUCKETS), float(np.log(prior / (1 - prior)))
    if not flags.any() or flags.all():
        return weights, rarity, bias
    docs = []
    for t in texts:
        t = t.encode("utf-8", "replace")
        at, count = np.unique(features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1], return_counts=True)
        docs.append((at.astype(np.int32), np.sqrt(count)))
    pos, rest = np.flatnonzero(flags), np.flatnonzero(~flags)
    met = np.bincount(np.concatenate([docs[j][0] for j in rest]), minlength=BUCKETS)
    rarity = np.log((1 + len(rest)) / (1 + met)) + 1e-3
    for j, (at, value) in enumerate(docs):
        value = value * rarity[at]
        docs[j] = at, (value / max(1e-12, np.sqrt(value @ value))).astype(np.float32)
    rng = np.random.default_rng(SEED)
    steps = max(1, -(-len(rest) // BATCH))
    grown, grown_bias = np.full(BUCKETS, 1e-10), 1e-10
    bias = 0.0
    for _ in range(EPOCHS):
        p, u = rng.permutation(pos), rng.permutation(rest)
        for i in range(steps):
            # Every batch has both kinds: toxic examples are gone through again when they run out
            share = min(len(p), BATCH // 2)
            own = np.concatenate([np.take(p, np.arange(i * share, (i + 1) * share), mode="wrap"), u[i * BATCH:(i + 1) * BATCH]])
            doc = np.repeat(np.arange(len(own)), [len(docs[j][0]) for j in own])
            at, value = np.concatenate([docs[j][0] for j in own]), np.concatenate([docs[j][1] for j in own])
            _, step = risk(np.bincount(doc, weights[at] * value, len(own)) + bias, np.arange(len(own)) < share, prior)
            g = np.bincount(at, step[doc] * value, BUCKETS)
            grown += g * g
            pace = RATE / np.sqrt(grown)
            weights -= pace * g
            weights -= np.clip(weights, -pace * SHRINK, pace * SHRINK)  # what occurs in a single example stays at zero
            grown_bias += step.sum() ** 2
            bias -= RATE * step.sum() / np.sqrt(grown_bias)
    z = np.array([weights[at] @ value for at, value in docs])
    scale, bias = stretched(z, flags, prior, bias)
    return weights * scale, rarity, bias


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, rarity: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 per row."""
    row, at, value = vectors(data, offsets, rarity)
    return _sigmoid(np.bincount(row, weights[at] * value, len(offsets) - 1) + bias)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_MOD == 0, F.lit(False))


def _chosen(texts: DataFrame, wanted: int) -> list[str]:
    """About ``wanted`` distinct rows of (doc_id, text), fewer where they are long, in order of id; a hash picks them."""
    n, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    share = min(wanted / max(1, n), TRAIN_CHARS / max(1, chars or 0))
    picked = texts.filter(hash_share("doc_id", "text") < F.lit(share)).groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.min("text").alias("text"))
    return [r["text"] for r in sorted(picked.collect(), key=lambda r: (r["doc_id"], r["key"]))]


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, rarity and intercept from the documents that are not held out."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("_toxic"))
    if prior is None:
        mean = own.agg(F.avg(F.col("_toxic").cast("int"))).first()[0]
        prior = DEFAULT_PRIOR if mean is None or mean == 1 else mean
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") <= LONGEST_TRAINED))
    toxic = _chosen(texts.join(own.filter("_toxic").select("doc_id"), "doc_id", "left_semi"), POSITIVES)
    rest = _chosen(texts, UNLABELLED)
    return fit(toxic + rest, [True] * len(toxic) + [False] * len(rest), min(0.999, max(0.001, prior)))


def judge(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    weights, rarity, bias = train(docs, labels, prior)
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), rarity.astype(np.float32), bias))  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scan.held()
        for batch in batches:
            data, offsets = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets):
                own = scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], *shared.value)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(own)], ["doc_id", "score"])
    out = scan.small_batches(docs).select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
