"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as consecutive segments of ``SEGMENT`` bytes. In each, one recurrent pass runs forward and one backward; the two
states at a position give it a label distribution, and a document's distribution is the mean over all its positions.
The network is trained in numpy by backpropagation through time. Gates use x / (1 + |x|) in place of exponentials.

Scale: training sees about ``PER_LANGUAGE`` documents of every language, chosen by id hash, and ``STEPS * BATCH`` segments, whatever
the size of the tables; above ``FULL_LANGUAGES`` languages fewer documents of each and more steps. Prediction is one pass over all whole texts without
a shuffle; all segments of about ``scan.SLICE`` bytes advance together.

Defined cases: a null text or one without a letter is ``und`` with score 0; languages are those of the sample; without any, all
is ``und``; ties go to the first language in order; null languages and ids do not train; repeated rows are judged each."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import scan
from .sample import hash_share

SEGMENT, HIDDEN = 64, 8
PER_LANGUAGE, FULL_LANGUAGES = 300, 64  # with more languages than these, fewer documents of each and more steps
STEPS, BATCH, RATE, SEED = 350, 192, 0.02, 5
MAX_TRAIN_CHARS = 100_000  # longer texts train, by their start, only where a language has no other
HOLD_MOD, HOLD_AT = 4, 2


def _soft(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare
    return x


class Direction:
    """One recurrent pass. Arrays are features by batch; gate rows are update, reset, candidate."""

    def __init__(self, rng: np.random.Generator | None = None):
        if rng is not None:
            self.byte = rng.normal(0, 0.3, (3 * HIDDEN, 256)).astype(np.float32)
            self.state = rng.normal(0, HIDDEN ** -0.5, (3 * HIDDEN, HIDDEN)).astype(np.float32)

    def run(self, text: np.ndarray) -> np.ndarray:
        """States at every position: (positions, HIDDEN, batch) for bytes (positions, batch)."""
        steps, n = text.shape
        out = np.empty((steps, HIDDEN, n), np.float32)
        h = np.zeros((HIDDEN, n), np.float32)
        gate, back = np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32)
        spare = np.empty((2 * HIDDEN, n), np.float32)
        both, new = gate[:2 * HIDDEN], gate[2 * HIDDEN:]
        for t in range(steps):
            np.take(self.byte, text[t], axis=1, out=gate, mode="clip")
            np.matmul(self.state, h, out=back)
            both += back[:2 * HIDDEN]
            _soft(both, spare)
            both += 1
            both *= 0.5
            back[2 * HIDDEN:] *= gate[HIDDEN:2 * HIDDEN]
            new += back[2 * HIDDEN:]
            _soft(new, spare[:HIDDEN])
            h -= new
            h *= gate[:HIDDEN]
            h += new
            out[t] = h
        return out

    def gradient(self, text: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time: gradients of ``byte`` and ``state`` for gradients ``given`` of all states."""
        steps, n = text.shape
        h, kept = np.zeros((HIDDEN, n), np.float32), []
        for t in range(steps):
            u = self.state @ h
            a = self.byte[:, text[t]]
            x = a[:2 * HIDDEN] + u[:2 * HIDDEN]
            g = 0.5 + 0.5 * x / (1 + np.abs(x))
            y = a[2 * HIDDEN:] + g[HIDDEN:] * u[2 * HIDDEN:]
            c = y / (1 + np.abs(y))
            kept.append((h, u[2 * HIDDEN:], x, g, y, c))
            h = c + g[:HIDDEN] * (h - c)
        d_byte, d_state, d = np.zeros_like(self.byte), np.zeros_like(self.state), np.zeros((HIDDEN, n), np.float32)
        for t in range(steps - 1, -1, -1):
            h, u, x, g, y, c = kept[t]
            d = d + given[t]
            z, r = g[:HIDDEN], g[HIDDEN:]
            d_y = d * (1 - z) / (1 + np.abs(y)) ** 2
            d_x = np.concatenate([d * (h - c), d_y * u]) * 0.5 / (1 + np.abs(x)) ** 2
            d_gate = np.concatenate([d_x, d_y])
            d_u = np.concatenate([d_x, d_y * r])
            for k in range(3 * HIDDEN):
                d_byte[k] += np.bincount(text[t], d_gate[k], 256)
            d_state += d_u @ h.T
            d = d * z + self.state.T @ d_u
        return d_byte, d_state


class Network:
    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.behind = Direction(rng), Direction(rng)
        self.out = [rng.normal(0, 0.3, (len(languages), HIDDEN)).astype(np.float32) for _ in range(2)]
        self.bias = np.zeros((len(languages), 1), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.behind.byte, self.behind.state, *self.out, self.bias]

    def labels(self, text: np.ndarray) -> np.ndarray:
        """Label distribution of every position: (positions, languages, batch)."""
        p = np.matmul(self.out[0], self.ahead.run(text))
        p += np.matmul(self.out[1], self.behind.run(text[::-1])[::-1])
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def train(self, segments: np.ndarray, sizes: np.ndarray, language: np.ndarray, steps: int = STEPS) -> None:
        """``segments`` (n, SEGMENT) of which the first ``sizes`` bytes count."""
        rng = np.random.default_rng(SEED)
        first, second = ([np.zeros_like(x) for x in self._parameters()] for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(segments), BATCH)
            text, want = segments[pick].T, language[pick]
            real = (np.arange(SEGMENT)[:, None] < sizes[pick]).astype(np.float32)
            h = [self.ahead.run(text), self.behind.run(text[::-1])[::-1]]
            z = np.matmul(self.out[0], h[0]) + np.matmul(self.out[1], h[1]) + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[:, want, np.arange(BATCH)] -= 1
            p *= real[:, None] / real.sum()
            d_out = [np.einsum("tcb,thb->ch", p, x) for x in h]
            d_ahead = self.ahead.gradient(text, np.matmul(self.out[0].T, p))
            d_behind = self.behind.gradient(text[::-1], np.matmul(self.out[1].T, p)[::-1])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, g, m, v in zip(self._parameters(), [*d_ahead, *d_behind, *d_out, p.sum(axis=(0, 2))[:, None]], first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean label distribution over all bytes of each row: (rows, languages); zero for empty rows."""
        n, lengths = len(offsets) - 1, np.diff(offsets)
        total = np.zeros((n, len(self.languages)))
        per = -(-lengths // SEGMENT)
        row = np.repeat(np.arange(n), per)
        start = offsets[row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
        size = np.minimum(SEGMENT, offsets[row + 1] - start)
        group = max(1, scan.SLICE // SEGMENT * 16 // max(16, len(self.languages)))
        padded = np.concatenate([data, np.zeros(SEGMENT, np.uint8)])
        for at in range(0, len(row), group):
            s, z = start[at:at + group], size[at:at + group]
            real = np.arange(SEGMENT)[:, None] < z
            text = np.where(real, padded[s + np.arange(SEGMENT)[:, None]], 0)
            p = self.labels(text)
            p *= real[:, None]
            own = p.sum(axis=0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row[at:at + group], own[k], n)
        return total / np.maximum(1, lengths)[:, None]


def fit(texts: list[str], languages: list[str]) -> Network | None:
    names = sorted(set(languages))
    if not names:
        return None
    pieces, sizes, label = [], [], []
    for text, name in zip(texts, languages):
        data = np.frombuffer(text.encode(), np.uint8)
        for at in range(0, len(data), SEGMENT):
            own = data[at:at + SEGMENT]
            pieces.append(np.pad(own, (0, SEGMENT - len(own))))
            sizes.append(len(own))
            label.append(names.index(name))
    network = Network(names)
    if pieces and len(names) > 1:
        rng, label = np.random.default_rng(SEED), np.array(label)
        steps = STEPS * max(1, -(-len(names) // FULL_LANGUAGES))
        most = max(1, steps * BATCH // len(names))  # equally many segments of each language
        pick = np.concatenate([rng.choice(np.flatnonzero(label == k), most) for k in range(len(names)) if (label == k).any()])
        network.train(np.stack(pieces)[pick], np.array(sizes)[pick], label[pick], steps)
    return network


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HOLD_MOD == HOLD_AT, F.lit(False))


def train(docs: DataFrame) -> Network | None:
    """Fit on about ``PER_LANGUAGE`` documents of each language, none held out; with more than ``FULL_LANGUAGES`` languages on
    so many fewer that all together stay bounded, but one at least."""
    text = F.col("text").cast("string")
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), (F.length(text) > MAX_TRAIN_CHARS).alias("long"), F.substring(text, 1, MAX_TRAIN_CHARS).alias("text"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    sizes = own.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n"), F.min(hash_share("doc_id")).alias("least"))
    sizes = materialize(sizes.groupBy("lang").agg(F.min(F.struct("long", "n", "least")).alias("s")).select("lang", "s.*"), "languages")
    n = sizes.count()
    if not n:
        return None
    per = max(1, PER_LANGUAGE * FULL_LANGUAGES // max(n, FULL_LANGUAGES))
    share = sizes.select("lang", "long", F.greatest(F.lit(per) / F.col("n"), F.col("least")).alias("share"))  # the first one by hash at least
    chosen = own.join(share, ["lang", "long"]).filter(hash_share("doc_id") <= F.col("share"))
    rows = sorted(chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["doc_id"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def judge(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    network = network or train(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets):
                lettered = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                names, score = np.full(b - a, "und", object), np.zeros(b - a)
                if network is not None:
                    p = network.pooled(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    best = p.argmax(axis=1)
                    names[lettered] = np.array(network.languages, object)[best[lettered]]
                    score[lettered] = np.minimum(1.0, p[np.arange(b - a), best][lettered])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
    text = F.col("text").cast("string")
    inputs = scan.small_batches(docs).select("doc_id", text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    out = inputs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
