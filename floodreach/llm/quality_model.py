"""Quality classifier: supervised subword embeddings.

Every word and every run of 3, 4 and 5 characters (code points) of a text is hashed to a learned vector, and so is the event of a repeated word; a document is the average of its vectors,
and a softmax layer over it gives the class. Vectors and layer are trained together by stochastic gradient descent in
numpy. With two classes the score depends on vectors only through their product with the layer, so scoring sums one number
per feature.

Scale: training uses about ``TRAIN_DOCS`` labelled documents, chosen by id hash, whatever the size of the tables.
Scoring is one pass over all whole texts without a shuffle, with a table of ``BUCKETS`` numbers.

Defined cases: a null or empty text has the score of the intercept; documents with several labels train with the mean, rounded;
null labels and null ids do not train; without any label of either class every score is 0.5; repeated rows are scored each."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan
from .sample import sample

GRAMS, BUCKETS_LOG2, WIDTH = (3, 4, 5), 17, 8
BUCKETS = 1 << BUCKETS_LOG2
TRAIN_DOCS, EPOCHS, BATCH, RATE, SEED = 4000, 6, 16, 3.0, 11
MAX_TRAIN_CHARS = 100_000  # longer texts are scored like any other, but not trained on
HOLD_MOD = 5  # a remainder of 0 is held out
LIMIT = 0.3


def _blocks(n: int):
    for at in range(0, n, scan.SLICE):
        yield at, min(n, at + scan.SLICE)


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number per character of UTF-8 ``data`` (its bytes, the first one lowest), and where rows begin among them."""
    if not len(data) or data.max() < 0x80:
        return data, offsets
    first = (data & 0xC0) != 0x80  # every other byte continues a character
    out = []
    for at, to in _blocks(len(data)):
        start = np.flatnonzero(first[at:to]) + at
        values = data[start].astype(np.uint32)
        more = np.ones(len(start), bool)
        for k in range(1, 4):
            spot = np.minimum(start + k, len(data) - 1)
            more &= (start + k < len(data)) & ~first[spot]
            values += (data[spot].astype(np.uint32) << np.uint32(8 * k)) * more
        out.append(values)
    count = np.add.reduceat(first, np.minimum(offsets[:-1], len(data) - 1), dtype=np.int64) * (np.diff(offsets) > 0)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(count)])


def _buckets(characters: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the ``size`` characters from every position on."""
    m = max(0, len(characters) - size + 1)
    h = np.full(m, 2166136261 + size, np.uint32)
    for j in range(size):
        h *= np.uint32(0x85EBCA6B)
        h += characters[j:j + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    return h >> np.uint32(32 - BUCKETS_LOG2)


def _word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and bucket 0 for every word that repeats the one before it; with their rows."""
    _, _, row, word = scan.runs(data, offsets, scan.NOT_SPACE)
    again = row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])]
    own = (word >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    return np.concatenate([own, np.zeros(len(again), np.int64)]), np.concatenate([row, again])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    data = np.frombuffer(text.encode(), np.uint8)
    whole = np.array([0, len(data)])
    found = [_buckets(_characters(data, whole)[0], n) for n in GRAMS] + [_word_buckets(data, whole)[0]]
    at, count = np.unique(np.concatenate([f.astype(np.int64) for f in found]), return_counts=True)
    return at, (count / max(1, count.sum())).astype(np.float32)


def scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, intercept: float) -> np.ndarray:
    """Probability of label 1 per row."""
    n = len(offsets) - 1
    total, count = np.zeros(n), np.zeros(n)
    word, row = _word_buckets(data, offsets)
    data, offsets = _characters(data, offsets)
    lengths = np.diff(offsets)
    for size in GRAMS:
        count += np.maximum(0, lengths - size + 1)
        ends = np.maximum(offsets[:-1], offsets[1:] - size + 1)  # grams of a row start before this place
        for at, to in _blocks(len(data)):
            run = np.concatenate([[0.0], np.cumsum(table[_buckets(data[at:to + size - 1], size)], dtype=np.float64)])
            a, b = (np.clip(x - at, 0, len(run) - 1) for x in (offsets[:-1], ends))
            total += run[b] - run[a]
    total += np.bincount(row, table[word], n)[:n]
    count += scan.per_row(row, n)
    return 1 / (1 + np.exp(-(total / np.maximum(1, count) + intercept)))


def gradients(vectors, layer, bias, spot, share, doc, want):
    """Gradients of the summed cross entropy of a batch: by layer, by bias, and the touched vectors with theirs.

    Features come as (vector ``spot``, ``share``, document ``doc``); ``want`` has a row per document."""
    def sums(at, rows, n):
        return np.stack([np.bincount(at, rows[:, k], n) for k in range(vectors.shape[1])], axis=1).astype(vectors.dtype)

    mean = sums(doc, vectors[spot] * share[:, None], len(want))
    z = mean @ layer + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    wrong = p / p.sum(axis=1, keepdims=True) - want
    touched, inverse = np.unique(spot, return_inverse=True)
    return mean.T @ wrong, wrong.sum(axis=0), touched, sums(inverse, (wrong @ layer.T)[doc] * share[:, None], len(touched))


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """The score table and intercept: embeddings times softmax layer, class 1 less class 0."""
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(SEED)
    docs = [features(t) for t in texts]
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    want = np.eye(2, dtype=np.float32)[labels]
    steps, done = EPOCHS * -(-len(docs) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            own = [i for i in order[at:at + BATCH]]
            size = np.array([len(docs[i][0]) for i in own])
            spot, share = np.concatenate([docs[i][0] for i in own]), np.concatenate([docs[i][1] for i in own])
            doc = np.repeat(np.arange(len(own)), size)
            to_layer, to_bias, touched, to_vectors = gradients(vectors, layer, bias, spot, share, doc, want[own])
            rate = RATE * (1 - done / steps)
            layer -= rate / len(own) * to_layer
            bias -= rate / len(own) * to_bias
            vectors[touched] -= rate * to_vectors
            done += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_MOD == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on about ``TRAIN_DOCS`` labelled documents that are not held out."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("_label"))
    chosen = sample(own, own.count(), TRAIN_DOCS, "doc_id")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.length("text") <= MAX_TRAIN_CHARS)
    rows = sorted(texts.join(chosen, "doc_id").limit(2 * TRAIN_DOCS).collect(), key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in rows], [min(1, max(0, r["_label"])) for r in rows])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    table, intercept = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets):
                own = scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shared.value, intercept)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(own)], ["doc_id", "score"])
    out = scan.small_batches(docs).select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))
