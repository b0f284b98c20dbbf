"""Phrase collocations by Toivonen's method: a sample proposes the frequent phrases, whole passes count them and their negative border.

A hash sample of the documents, at a lowered threshold, proposes frequent phrases of one to four words. The full pass counts,
over all documents, every occurring phrase whose two parents (the phrase less its last and less its first word) are proposed:
these are the proposals and their negative border, the latter never spelt out but met in the texts. All words are counted, as
their parent is the empty phrase. A border phrase that turns out frequent is a failure: its extensions were not looked at. So
the set is enlarged by all that is frequent and closed under its borders (every phrase whose words and pairs of words are in the
set), and a further pass counts what is new in that, until nothing new is frequent. Then, by induction over the length, every
frequent phrase has been counted, whatever the sample missed; counts are exact in every pass. The words of the frequent ones are read off the
sample, where nearly all of them occur, and those of the rest off all texts.

Scale: passes read the texts in place; what is shuffled are counts by a hash of 96 bits, summed per block of words, then per task, then
per phrase, so a frequent phrase meets in one task as one row a task. Proposals go to the tasks as a Bloom filter of at most
``FILTER_BITS``, made by an aggregate of its 64-bit words, of which the driver sees at most that many bits. A false member only
has more phrases counted. Scores, subsumption and ranks are equality joins and aggregates over frequent phrases alone.

Defined cases: a null text is empty, a null lang is ``und`` (together with documents that say so); a null doc_id is sampled by
its text; repeated rows count each; empty tables and tables without a frequent phrase give no rows; a long text is handled in
blocks of words with four words of lookahead; equal scores and counts are ranked by the phrase's bytes; other columns are not
read, whatever their names."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import scan
from .sample import hash_share

LONGEST = 5
SAMPLE_SHARE, LOWERED = 0.0625, 0.8  # part of the documents, and part of the expected count that makes a proposal
FILTER_BITS = 1 << 27
BLOCK = 1 << 18  # words handled at once
_TOLD = 1 << 20  # phrases a task remembers to have said

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_PIECE_END
_WORD[[0x20, 0x09]] = False
_STEP, _CHECK = np.uint64(0xD1342543DE82EF95), np.uint64(0x9FB21C651E98DF25)


class _Words:
    """Words of some rows, lower-cased: hash (of language and word), number of its piece, row, and the bytes space-joined."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        data = scan.LOWER[data]
        self.data = data
        self.start, self.end, self.row, word = scan.runs(data, offsets, _WORD)
        self.hash = scan.mix(word ^ langs[self.row])
        new = np.ones(len(self.start), bool)
        if len(new):
            ends = np.concatenate([[0], np.cumsum(_PIECE_END[data])])
            new[1:] = (self.row[1:] != self.row[:-1]) | (ends[self.start[1:]] > ends[self.end[:-1]])
        self.piece = np.cumsum(new)

    def blocks(self):
        """(first word, words owned, words seen) of each block; the words seen beyond those owned only end phrases."""
        for at in range(0, len(self.hash), BLOCK):
            own = min(BLOCK, len(self.hash) - at)
            yield at, own, min(own + LONGEST - 1, len(self.hash) - at)

    def phrases(self, at: int, seen: int):
        """For lengths 1 to ``LONGEST``: a hash of the phrase from every word on, a second one, and whether it lies in one piece."""
        h, piece = self.hash[at:at + seen], self.piece[at:at + seen]
        one, two = h.copy(), h.copy()
        for k in range(1, LONGEST + 1):
            if k > 1:
                one, two = one[:-1] * _STEP + h[k - 1:], two[:-1] * _CHECK + h[k - 1:]
            yield k, scan.mix(one), two, piece[:max(0, seen - k + 1)] == piece[k - 1:]
            if seen <= k:
                break

    def strings(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words from the words ``first`` on, their words joined by single spaces."""
        words = (first[:, None] + np.arange(k)).ravel()
        sizes = self.end[words] - self.start[words] + 1
        stops = np.cumsum(sizes)
        place = np.repeat(self.start[words] - (stops - sizes), sizes) + np.arange(int(stops[-1]) if len(stops) else 0)
        text = self.data[np.minimum(place, max(0, len(self.data) - 1))] if len(place) else np.zeros(0, np.uint8)
        text[stops - 1] = 0x20
        keep = np.ones(len(text), bool)
        keep[stops[k - 1::k] - 1] = False
        offsets = np.concatenate([[0], stops[k - 1::k] - np.arange(1, len(first) + 1)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(text[keep])])


def _counted(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct phrase occurs first, and how often it occurs; two hashes of 64 bits tell phrases apart."""
    _, at, inverse, n = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    if not np.array_equal(two[at][inverse], two):
        _, at, n = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_counts=True)
    return at, n


def _digest(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def _words(batches, docs_at: int = 0):
    """Words of each slice of rows, with the languages of its rows as a list."""
    scan.held()
    for batch in batches:
        data, offsets = scan.buffers(batch.column(docs_at + 1))
        names = batch.column(docs_at).to_pylist()
        codes = {x: _digest(x) for x in set(names)}
        langs = np.array([codes[x] for x in names], np.uint64)
        for a, b in scan.slices(offsets):
            yield _Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], langs[a:b]), names[a:b]


def _proposed(batches):
    for words, _ in _words(batches):
        for at, own, seen in words.blocks():
            for k, one, _, whole in words.phrases(at, seen):
                if k == LONGEST:
                    break
                found, n = np.unique(one[:own][whole[:own]], return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return scan.small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def proposals(docs: DataFrame, min_count: int, share: float = SAMPLE_SHARE, lowered: float = LOWERED) -> DataFrame:
    """``hash`` of every phrase of up to four words that is frequent, at the lowered threshold, in the sample."""
    least = max(1, int(min_count * share * lowered))
    counts = _texts(docs.filter(hash_share("doc_id", "text") < F.lit(share))).mapInArrow(_proposed, "hash bigint, n bigint")
    return counts.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("hash")


class Members:
    """A Bloom filter of phrase hashes with two probes."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __contains__(self, _):
        raise TypeError("use has()")

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for spot in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            out &= (self.words[(spot >> np.uint64(6)).view(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, hashes: DataFrame, limit: int = FILTER_BITS) -> "Members":
        """Filter of the column ``hash`` of a written table, 16 bits a phrase but never more than ``limit`` bits."""
        bits = 1 << 16
        n = hashes.count()
        while bits < min(limit, 16 * n):
            bits *= 2
        spots = hashes.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("s")).select(F.col("s").bitwiseAND(F.lit(bits - 1)).alias("s"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
        table = spots.groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(bit).alias("word")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        if len(table):
            words[table["at"].to_numpy()] = table["word"].to_numpy().view(np.uint64)
        return cls(words)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _mark(x: np.ndarray, k: int, known: np.ndarray | int = 0) -> pa.Array:
    """The upper half of the second hash (with the first it makes 96 bits), the length and a flag in one integer."""
    return pa.array(((x >> np.uint64(32)) << np.uint64(4)).view(np.int64) + (2 * k + known))


def _told(counts: DataFrame) -> DataFrame:
    """What ``_mark`` has packed: k, two, known."""
    mark = F.col("mark")
    return counts.withColumns({"k": F.shiftright(mark, 1).bitwiseAND(F.lit(7)).cast("int"), "two": F.shiftright(mark, 4), "known": mark % 2 == 1}).drop("mark")


def _candidates(words: _Words, at: int, seen: int, rules: list[tuple[Members, bool]]):
    """For each length, what phrases of ``words`` from ``at`` on hash to, whether they lie in one piece, whether they are members of the first
    rule's filter, and for each rule whether they are its candidates: of a border, both parents are members; of a closed set, every word or pair is."""
    parents, runs = [None] * len(rules), [None] * len(rules)
    for k, one, two, whole in words.phrases(at, seen):
        fits, known = [], None
        for r, (members, closed) in enumerate(rules):
            has = whole & members.has(one) if k < LONGEST and (not closed or k < 3) or r == 0 else None
            known = has if r == 0 else known
            if k == 1:
                fits.append(np.ones(len(one), bool))
            elif closed and k > 2:
                runs[r] = runs[r][:-1] & parents[r][k - 2:]  # parents still holds the pairs
                fits.append(whole & runs[r])
            else:
                fits.append(whole & parents[r][:-1] & parents[r][1:])
            if not closed or k < 3:
                parents[r] = has
            if closed and k == 2:
                runs[r] = has
        yield k, one, two, whole, known, fits


def count_pass(docs: DataFrame, members: Members, before: list[tuple[Members, bool]]) -> DataFrame:
    """Exact counts: k, one, two (the phrase's hashes), n and known (it is itself a member).

    Without earlier passes all phrases whose parents are both in ``members`` are counted, and as k = 0 all word occurrences of each language; else
    all of the closed set that no rule in ``before`` had counted."""
    first = not before
    shared = docs.sparkSession.sparkContext.broadcast([(m.words, closed) for m, closed in [(members, not first), *before]])  # of bounded size

    def run(batches):
        rules = [(Members(w), closed) for w, closed in shared.value]
        names = ["one", "mark", "n"]
        for words, langs in _words(batches):
            if first and len(words.row):
                n = np.bincount(words.row, minlength=len(langs))
                total: dict[str, int] = {}
                for lang, x in zip(langs, n.tolist()):
                    total[lang] = total.get(lang, 0) + x
                own = np.array([_digest(x) for x in total], np.uint64)
                yield pa.record_batch([_signed(own), _mark(own, 0), pa.array(list(total.values()), pa.int64())], names)
            for at, own, seen in words.blocks():
                for k, one, two, whole, known, (take, *old) in _candidates(words, at, seen, rules):
                    take = take & whole
                    for x in old:
                        take &= ~x
                    spot = np.flatnonzero(take[:own])
                    if not len(spot):
                        continue
                    here, n = _counted(one[spot], two[spot])
                    here = spot[here]
                    yield pa.record_batch([_signed(one[here]), _mark(two[here], k, known[here]), pa.array(n.astype(np.int64))], names)
    return _told(_texts(docs).mapInArrow(run, "one bigint, mark bigint, n bigint").groupBy("one", "mark").agg(F.sum("n").alias("n")))


def _spelt_in(docs: DataFrame, found: DataFrame) -> DataFrame:
    """lang, k, phrase, one, two, n of those counted phrases that occur in ``docs``, read off the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(Members.of(found.filter("k > 0").select(F.col("one").alias("hash"))).words)  # of bounded size

    fields = ["one", "mark", "lang", "phrase"]

    def run(batches):
        members, told = Members(shared.value), np.zeros(_TOLD, np.uint64)
        for words, langs in _words(batches):
            own = sorted(set(langs))
            code = np.array([_digest(x) for x in own], np.uint64)
            yield pa.record_batch([_signed(code), _mark(code, 0), pa.array(own, pa.string()), pa.array([""] * len(own), pa.string())], fields)
            names = pa.array(langs, pa.string())
            for at, size, seen in words.blocks():
                for k, one, two, whole in words.phrases(at, seen):
                    spot = np.flatnonzero((whole & members.has(one))[:size])
                    key = one[spot] ^ two[spot]
                    slot = (key % np.uint64(_TOLD)).astype(np.int64)
                    new = told[slot] != key  # the last phrase said from this slot is another
                    told[slot[new]] = key[new]
                    spot = spot[new]
                    if not len(spot):
                        continue
                    spot = spot[_counted(one[spot], two[spot])[0]]
                    yield pa.record_batch([_signed(one[spot]), _mark(two[spot], k), names.take(pa.array(words.row[at + spot])), words.strings(at + spot, k)], fields)
    read = _texts(docs).mapInArrow(run, "one bigint, mark bigint, lang string, phrase string").groupBy("one", "mark").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    return _told(read).drop("known").join(found.select("k", "one", "two", "n"), ["k", "one", "two"])


def spelt(docs: DataFrame, found: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """lang, k, phrase, n of counted phrases. A sample of the documents holds nearly all of them and tells each a few times instead of
    once a task; one more pass over all documents, for what the sample lacks, finds the rest."""
    most = materialize(_spelt_in(docs.filter(hash_share("doc_id", "text") < F.lit(share)), found), "spelt")
    rest = materialize(found.join(most.select("k", "one", "two"), ["k", "one", "two"], "left_anti"), "unspelt")
    out = most if rest.isEmpty() else most.unionByName(_spelt_in(docs, rest))
    return out.select("lang", "k", "phrase", "n")


def frequent(docs: DataFrame, min_count: int = 100, share: float = SAMPLE_SHARE, lowered: float = LOWERED) -> DataFrame:
    """lang, k, phrase, n: every phrase of 1 to 5 words with n >= ``min_count``, and as k = 0 all word occurrences of each lang."""
    known = materialize(proposals(docs, min_count, share, lowered), "proposed")
    members, passes, found = Members.of(known), [], None
    while True:
        new = materialize(count_pass(docs, members, passes).filter((F.col("n") >= min_count) | (F.col("k") == 0)), "frequent")
        # A border stops at any unknown phrase, a closed set only at an unknown word or pair
        failed = new.filter(~F.col("known") & F.col("k").between(1, 2 if passes else LONGEST - 1)).select(F.col("one").alias("hash"))
        found = new if found is None else found.unionByName(new)
        if failed.isEmpty():
            return spelt(docs, materialize(found, "counted"), share)
        passes.append((members, bool(passes)))
        known = materialize(known.unionByName(new.filter("k > 0").select(F.col("one").alias("hash"))).distinct(), "proposed")
        members = Members.of(known)


def _part(words: Column, at: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, at, size), " ")


def scored(found: DataFrame, subsumed_percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two words and more that no longer one subsumes."""
    total = found.filter("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    counts = found.filter("k > 0").select("lang", "phrase", F.col("n").alias("a"), "k")
    candidates = counts.filter("k > 1").withColumn("w", F.split("phrase", " "))
    # Every candidate tells the phrases inside it how often it occurs: one aggregate instead of a join
    inside = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("k") - 1)), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _part(F.col("w"), i, m)))), lambda p: p != F.col("phrase"))
    told = candidates.select("lang", F.explode(inside).alias("phrase"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("int").alias("k"), F.col("a").alias("longer"))
    kept = candidates.select("lang", "phrase", "a", "k", F.lit(None).cast("bigint").alias("longer")).unionByName(told)
    kept = kept.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("k").alias("k"), F.max("longer").alias("longer"))
    kept = kept.filter(F.col("a").isNotNull() & (F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(subsumed_percent) * F.col("a"))))
    w = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(w, 1, F.col("cut")).alias("first"), _part(w, F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(total, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    thousand = (F.lit(1000).cast("decimal(4,0)") * wide["a"]) * wide["n"]  # exact: at most 38 digits
    cuts = cuts.withColumn("num", thousand.cast("decimal(38,0)")).withColumn("den", (wide["l"] * wide["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def ranked(scores: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang with their rank. Shares of a lang are ranked first, so one task never meets more than ``top`` of each."""
    from pyspark.sql import Window
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    part = scores.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top).drop("share", "rank")
    out = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = 100, top: int = 2000, subsumed_percent: int = 100, share: float = SAMPLE_SHARE, lowered: float = LOWERED) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the ``top`` collocations of each language."""
    found = materialize(frequent(docs, min_count, share, lowered), "counts")
    return ranked(scored(found, subsumed_percent), top)
