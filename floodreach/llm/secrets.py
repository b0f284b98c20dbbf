"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Base spans come from three patterns. Any other run of identifier characters that is long enough, and what base
spans leave of one, is scored by two first-order Markov models; where the likelihood ratio per character says "random", the run is a secret too; where it does not for the whole run, any stretch of it that
gains enough on the limit is. Short runs of ``SHORT_RUN`` characters and more are judged whole, with a limit for each length, since few
characters tell less; one without a letter is a number and no secret. Models are trained by counting
transitions in labelled samples: values behind the base patterns and seeded random strings of common alphabets on one side,
words of the corpus and identifiers composed of them on the other. The limit lies between the samples held back.

Scale: training reads the texts of at most about ``TRAIN_DOCS`` documents (chosen by id hash, up to ``TRAIN_CHARS`` characters
each), scanning is one pass with a table of some 4,500 numbers, without a shuffle. Every text is scanned whole.

Defined cases: null is the empty text; without any trainable text the models rest on the random strings and a few fixed words;
repeated rows are scanned each on its own; offsets count code points."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scan
from .sample import sample

KINDS = ["assign", "access", "hex", "random"]
# The base patterns and their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
KEYWORDS = ("passw", "secret", "token", "api")

SHORT_RUN, MIN_RUN, MAX_SCORED = 12, 20, 4096  # characters: below the first not judged, below the second by limits of their own; the mean over blocks of the third
SHORT_CALM = 0.9995  # share of ordinary runs of a short length that its limit passes over
TRAIN_DOCS, TRAIN_CHARS, RANDOM_STRINGS, SEED = 2000, 20_000, 4000, 7
JOINT = re.compile("[/=_-]")
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORT_RUN},}}")
LETTER = re.compile("[A-Za-z]")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_N = len(_ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _codes(run: str) -> np.ndarray:
    return _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]


def _transitions(samples: list[str]) -> np.ndarray:
    counts = np.ones((_N, _N))  # one of each: no transition is impossible
    for s in samples:
        c = _codes(s)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class Model:
    """``ratio``: per transition, log likelihood as random less that as ordinary; ``limit``: mean ratio from which a run is random;
    ``gain``: sum of ratios less ``limit`` from which a part of a run is; ``short``: the limit of each length from ``SHORT_RUN`` to below ``MIN_RUN``."""

    def __init__(self, ratio: np.ndarray, limit: float, gain: float = np.inf, short: list[float] | None = None):
        self.ratio, self.limit, self.gain = ratio, limit, gain
        self.short = short or [np.inf] * (MIN_RUN - SHORT_RUN)
        self.steps = None

    def score(self, run: str) -> float:
        c = _codes(run)
        return float(self.ratio[c[:-1], c[1:]].mean())

    def is_secret(self, run: str) -> bool:
        return self.score(run) > self.limit

    def climb(self, run: str) -> float:
        """The highest sum of the ratios less ``limit`` over any part of a run."""
        c = _codes(run)
        total = np.concatenate([[0.0], np.cumsum(self.ratio[c[:-1], c[1:]] - self.limit)])
        return float((total - np.minimum.accumulate(total)).max())

    def parts(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the stretches of a run over which the ratios less ``limit`` sum to ``gain`` and more. One ends at its
        highest sum, once the sum has fallen from it by twice ``gain`` or to 0, and the next is looked for from there on."""
        if self.steps is None:
            self.steps = {a + b: x for a, row in zip(_ALPHABET, (self.ratio - self.limit).tolist()) for b, x in zip(_ALPHABET, row)}
        out, t, n = [], 0, len(run) - 1
        start, end, total, most = 0, 0, 0.0, 0.0
        while t < n or most >= self.gain:
            if t < n:
                total += self.steps[run[t:t + 2]]
                t += 1
                if total > most:
                    most, end = total, t + 1
                    continue
                if total > 0 and total >= most - 2 * self.gain:
                    continue
            if most >= self.gain:
                if end - start >= MIN_RUN:
                    out.append((start, end))
                t = end
            start, end, total, most = t, t, 0.0, 0.0
        return out

    def secret_parts(self, run: str) -> list[tuple[int, int]]:
        """The whole run where its mean is above the limit (of its length, where it is short), else its random parts, out to the next joint within ``MIN_RUN`` characters."""
        if len(run) < MIN_RUN:
            secret = len(run) >= SHORT_RUN and LETTER.search(run) and self.score(run) > self.short[len(run) - SHORT_RUN]
            return [(0, len(run))] if secret else []
        blocks = [run[k:k + MAX_SCORED] for k in range(0, len(run), MAX_SCORED)]
        if np.average([self.score(b) if len(b) > 1 else 0.0 for b in blocks], weights=[len(b) for b in blocks]) > self.limit:
            return [(0, len(run))]
        out = []
        for s, e in self.parts(run):
            before, after = JOINT.search(run[max(0, s - MIN_RUN):s][::-1]), JOINT.search(run, e, e + MIN_RUN)
            s, e = s - before.start() if before else max(0, s - MIN_RUN), after.start() if after else min(len(run), e + MIN_RUN)
            if out and s <= out[-1][1]:
                s = out.pop()[0]
            out.append((s, e))
        return out


def _random_strings(rng: np.random.Generator) -> list[str]:
    alphabets = ["0123456789abcdef", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:26] + "0123456789", _ALPHABET[26:62]]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), rng.integers(MIN_RUN, 65))) for i in range(RANDOM_STRINGS)]


def _identifiers(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words as they are and joined in the ways of identifiers, paths and version strings; rulers of one character."""
    pool = sorted({w for w in words if 2 <= len(w) <= 24})
    out = [w for w in pool if len(w) >= 8]
    out += [c * int(n) for c in _ALPHABET for n in rng.integers(MIN_RUN, 80, 20)]
    for i in range(RANDOM_STRINGS):
        own = [pool[j] for j in rng.integers(0, len(pool), rng.integers(3, 7))]
        joined = ["_".join(own), "-".join(own), "/".join(own), "".join(w.capitalize() for w in own), "".join(own), "_".join(own).upper(), f"{'-'.join(own)}-{rng.integers(1, 2030)}"][i % 7]
        out.append(joined)
    return out


def fit(texts: list[str]) -> Model:
    """Models from labelled samples; two thirds train, a third sets the limit."""
    rng = np.random.default_rng(SEED)
    secret, words = _random_strings(rng), ["token", "value", "content", "number", "function", "option", "default", "license", "version", "example"]
    for text in texts:
        spans = base_spans(text)
        secret += [v.group() for s, e, _ in spans for v in RUN.finditer(text, s, e)]
        kept, at = [], 0
        for s, e, _ in spans:
            kept.append(text[at:s])
            at = max(at, e)
        words += re.findall(r"[A-Za-z]+", " ".join([*kept, text[at:]]))
    plain = _identifiers(words, rng)
    order = [rng.permutation(len(x)) for x in (secret, plain)]
    train = [[x[i] for i in o if i % 3] for x, o in zip((secret, plain), order)]
    held = [[x[i] for i in o if not i % 3] for x, o in zip((secret, plain), order)]
    model = Model(_transitions(train[0]) - _transitions(train[1]), 0.0)
    low = np.quantile([model.score(x) for x in held[0]], 0.02)
    high = np.quantile([model.score(x) for x in held[1] if len(x) >= MIN_RUN] or [0.0], 0.99)
    model.limit = float(max(0.0, (low + high) / 2))
    climbs = [[model.climb(x) for x in h if len(x) >= MIN_RUN] for h in held]
    low, high = np.quantile(climbs[0], 0.02), np.quantile(climbs[1] or [0.0], 0.999)
    model.gain = float(max(1.0, high, (low + high) / 2))
    model.short = _short_limits(model, [*held[1], *_stamps(rng)], rng)
    return model


def _stamps(rng: np.random.Generator) -> list[str]:
    """Ordinary runs of digits with a letter or two: days and hours, version and part numbers."""
    n = rng.integers(1, 1000, (RANDOM_STRINGS // 4, 4)).tolist()
    return [x for a, b, c, d in n for x in (f"20{a % 100:02}-{b % 12 + 1:02}-{c % 28 + 1:02}T{d % 24:02}", f"version-{a % 20}-{b % 40}-{c}", f"item{a:04}-{b:04}-{c % 100:02}")]


def _short_limits(model: Model, ordinary: list[str], rng: np.random.Generator) -> list[float]:
    """A limit for each short length, no lower than that of the longer ones: what only 1 in 2,000 ordinary runs exceeds, counting those
    of the length and one window of that length of each longer one."""
    out = [model.limit]
    for length in range(MIN_RUN - 1, SHORT_RUN - 1, -1):
        starts = [(run, int(rng.integers(0, len(run) - length + 1))) for run in ordinary if len(run) >= length]
        scores = [model.score(run[at:at + length]) for run, at in starts]
        out.append(max(out[-1], float(np.quantile(scores, SHORT_CALM)) if scores else np.inf))
    return out[:0:-1]


def train(docs: DataFrame) -> Model:
    """The models, from a bounded sample of documents."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = sample(own, own.count(), TRAIN_DOCS, "doc_id").filter(F.length("text") <= TRAIN_CHARS)
    return fit(sorted(r["text"] for r in chosen.collect()))


def _rests(start: int, end: int, base: list[tuple[int, int]]):
    """What the base spans (sorted) leave of a run."""
    for s, e in base:
        if s >= end:
            break
        if e > start:
            if s > start:
                yield start, s
            start = e
    if start < end:
        yield start, end


def spans(text: str, model: Model) -> list[tuple[int, int, int]]:
    """All spans by start, then kind: the base ones, and random runs beside them."""
    found = base_spans(text)
    more, i = [], 0
    base = []  # joined where they overlap
    for s, e, _ in found:
        if base and s < base[-1][1]:
            base[-1] = base[-1][0], max(base[-1][1], e)
        else:
            base.append((s, e))
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][1] <= m.start():
            i += 1
        j = i
        while j < len(base) and base[j][0] < m.end():
            j += 1
        for s, e in _rests(*m.span(), base[i:j]):
            if e - s < SHORT_RUN:
                continue
            more += [(s + a, s + b, 3) for a, b in model.secret_parts(text[s:e])]
    return sorted(found + more, key=lambda x: (x[0], x[2])) if more else found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text_key (a hash of the text) and spans, an array of (kind, start, end), of every row."""
    model = model or train(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scan.held()
        for batch in batches:
            _, offsets = scan.buffers(batch.column(2))
            for a, b in scan.slices(offsets):
                part = batch.slice(a, b - a)
                found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans(t or "", model)] for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, _SPANS)], ["doc_id", "text_key", "spans"])
    inputs = scan.small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return inputs.mapInArrow(run, f"doc_id {kind}, text_key bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, model: Model | None = None, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mask`` (overlapping spans by one); ``n_chars``, where there is one, follows."""
    model = model or train(docs)

    def masked(text: str) -> str:
        out, at = [], 0
        for s, e, _ in spans(text, model):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]]) if out else text

    def run(batches):
        scan.held()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            _, offsets = scan.buffers(batch.column(at))
            for a, b in scan.slices(offsets):
                part = batch.slice(a, b - a)
                clean = pa.array([t if t is None else masked(t) for t in part.column(at).to_pylist()], part.column(at).type)
                yield part.set_column(at, part.schema.field(at), clean)
    out = scan.small_batches(docs).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def judge(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    found = find(docs, model)
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != KINDS[3])

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"))
