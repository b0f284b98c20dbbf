"""Benchmark decontamination by winnowing.

Texts become lower-cased words. Of every 9 consecutive 5-word grams the smallest hash is kept, for documents and
benchmark items alike, so any shared span of 13 words keeps a common fingerprint. Fingerprints are joined by equality and
each meeting is extended word by word; a run of 13 equal words or more is a hit. Items of fewer words are looked up whole.

Scale: documents are read once and never shuffled. A Bloom filter of the benchmark's fingerprints (never above
``BLOOM_MAX`` bits) only keeps most document fingerprints from being written; the join that follows is exact, so a full
filter costs time, not results. What is joined are the few surviving fingerprints with eight words around each.

Defined cases: null or wordless text has no words and no hits; an item without words has no window; repeated document rows
are judged each on its own; repeated item rows count once; rows of a null item id mark words but are not listed."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from . import scan
from .rows import same_row, without

SPAN, GRAM = 13, 5
AROUND = SPAN - GRAM
BLOOM_MIN, BLOOM_MAX = 1 << 18, 1 << 26  # bits

_MEETING = pa.struct([("hash", pa.int64()), ("gram", pa.string()), ("pos", pa.int32()), ("size", pa.int32()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
_MEETING_DDL = "struct<hash:bigint,gram:string,pos:int,size:int,left:array<string>,right:array<string>>"


def winnow(hashes: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest hash of some full window of ``width`` valid grams of one row (all of them on ties)."""
    keep = np.zeros(len(hashes), bool)
    m = len(hashes) - width + 1
    if m <= 0:
        return keep
    low, span = hashes, 1
    while span * 2 <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:m], low[width - span:width - span + m])
    for j in range(width):
        keep[j:j + m] |= (hashes[j:j + m] == low) & valid
    return keep


class _Words:
    """Words of one slice of rows, with texts on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = scan.LOWER[data]
        self.start, self.end, self.row, self.hash = scan.runs(self.data, offsets, scan.ALNUM)
        self.count = scan.per_row(self.row, len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def texts(self, a: int, b: int) -> list[str]:
        return [self.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[a:b], self.end[a:b])]

    def meeting(self, at: int, size: int, value: np.uint64, around: int) -> dict:
        lo, hi = self.first[self.row[at]], self.first[self.row[at] + 1]
        return {"hash": int(value.astype(np.int64)), "gram": " ".join(self.texts(at, at + size)), "pos": int(at - lo), "size": size,
                "left": self.texts(max(lo, at - around), at)[::-1], "right": self.texts(at + size, min(hi, at + size + around))}

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, _ = scan.grams(self.hash, self.row, GRAM)
        whole = self.row[:-SPAN + 1] == self.row[SPAN - 1:] if len(self.row) >= SPAN else np.zeros(0, bool)
        return hashes, winnow(hashes, whole, AROUND + 1)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, data, offsets = batch.column(0), *scan.buffers(batch.column(1))
        for a, b in scan.slices(offsets):
            w = _Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            hashes, keep = w.fingerprints()
            out, owner, need = [], [], []
            for at in np.flatnonzero(keep):
                out.append(w.meeting(at, GRAM, hashes[at], AROUND))
                owner.append(a + int(w.row[at]))
                need.append(SPAN)
            for r in np.flatnonzero((w.count > 0) & (w.count < SPAN)):
                lo, n = int(w.first[r]), int(w.count[r])
                size = min(n, GRAM)
                own, _ = scan.grams(w.hash[lo:lo + n], w.row[lo:lo + n], size)
                at = int(np.argmin(own))
                out.append(w.meeting(lo + at, size, own[at], n - size))
                owner.append(a + int(r))
                need.append(n)
            yield pa.record_batch([ids.take(pa.array(owner, pa.int64())), pa.array(need, pa.int32()), pa.array(out, _MEETING)], ["item_id", "need", "at"])


def _meetings(bits: np.ndarray, sizes: list[int]):
    """Per document: its number of words, and its fingerprints that the filter lets through."""
    mask = np.uint64(len(bits) * 8 - 1)

    def listed(h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for p in (h & mask, (h >> np.uint64(32)) & mask):
            found &= (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan.held()
        for batch in batches:
            data, offsets = scan.buffers(batch.column(2))
            for a, b in scan.slices(offsets):
                w = _Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                found: list[tuple[int, int, np.uint64]] = []
                hashes, keep = w.fingerprints()
                if SPAN in sizes:
                    at = np.flatnonzero(keep)
                    found += [(i, GRAM, hashes[i]) for i in at[listed(hashes[at])]]
                for size in sizes:  # items shorter than the span: every gram of their anchor's size
                    if size < SPAN:
                        own, valid = scan.grams(w.hash, w.row, size)
                        at = np.flatnonzero(valid)
                        found += [(i, size, own[i]) for i in at[listed(own[at])] if not (size == GRAM and SPAN in sizes and keep[i])]
                found.sort(key=lambda x: (x[0], x[1]))
                counts = scan.per_row(w.row[np.array([x[0] for x in found], np.int64)], b - a)
                meet = pa.array([w.meeting(i, size, h, AROUND if size == GRAM else 0) for i, size, h in found], _MEETING)
                yield pa.record_batch([*[batch.column(i).slice(a, b - a) for i in (0, 1)], pa.array(w.count), scan.list_array(meet, counts)], ["doc_id", "text_key", "n_words", "meetings"])
    return run


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, need (words that must agree) and the fingerprint ``at`` with its surroundings; written once."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return materialize(benchmark.select("item_id", F.col("text").cast("string")).mapInArrow(_items, f"item_id {kind}, need int, at {_MEETING_DDL}"), "windows")


def _bloom(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter (at most ``BLOOM_MAX`` bits reach the driver) and the kinds of windows there are (13, and anchor sizes up to 5)."""
    size = F.when(F.col("need") >= SPAN, SPAN).otherwise(F.col("at.size"))
    n, sizes = windows.agg(F.approx_count_distinct("at.hash"), F.collect_set(size)).first()
    bits = min(BLOOM_MAX, max(BLOOM_MIN, 1 << (16 * max(1, n) - 1).bit_length()))
    h = F.col("at.hash")
    spot = windows.select(F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("p"))
    parts = spot.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in parts:
        m = np.frombuffer(bytes(m), np.uint8)
        out[(b - 1) * 4096:(b - 1) * 4096 + len(m)] = m[:len(out) - (b - 1) * 4096]
    return out, sorted(sizes)


def _agree(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, n).otherwise(differ - 1).cast("int")


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, hits, items): texts has a row ``rid`` for each document row with doc_id, text_key
    (a hash of the text) and n_words; hits has rid, start and
    end of runs of hit words (end exclusive, runs may overlap); items has the distinct rid, item_id pairs."""
    windows = benchmark_windows(benchmark)
    bits, sizes = _bloom(windows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    inputs = scan.small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    texts = inputs.mapInArrow(_meetings(bits, sizes), f"doc_id {kind}, text_key bigint, n_words bigint, meetings array<{_MEETING_DDL}>")
    texts = materialize(texts.withColumn("rid", F.monotonically_increasing_id()), "meetings")
    context = windows.select(F.col("need"), F.col("at.hash").alias("hash"), F.col("at.gram").alias("gram"), F.col("at.left").alias("ileft"), F.col("at.right").alias("iright"), F.col("item_id"))
    key = ["hash", "gram", "need", "ileft", "iright"]
    context = context.withColumn("ctx", F.sha2(F.to_json(F.struct(*key)), 256))
    met = texts.select("rid", F.inline("meetings"))
    met = met.join(context.select("ctx", *key).distinct(), ["hash", "gram"])
    left, right = _agree(F.col("left"), F.col("ileft")), _agree(F.col("right"), F.col("iright"))
    met = met.withColumn("l", left).withColumn("r", right).filter(F.col("l") + F.col("size") + F.col("r") >= F.col("need"))
    met = met.select("rid", "ctx", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("size") + F.col("r")).alias("end"))
    met = materialize(met, "hits")
    items = met.select("rid", "ctx").distinct().join(context.select("ctx", "item_id").distinct(), "ctx").select("rid", "item_id").distinct()
    return texts.select("rid", "doc_id", "text_key", "n_words"), met.select("rid", "start", "end").distinct(), items


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated for every document row."""
    texts, hits, items = contamination(docs, benchmark)
    order = W.partitionBy("rid").orderBy("start", "end")
    seen = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fresh = hits.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), seen)))
    n_hit = fresh.groupBy("rid").agg(F.sum("fresh").cast("bigint").alias("n_hit"))
    listed = items.groupBy("rid").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("bigint"))
    out = texts.join(n_hit.join(listed, "rid"), "rid", "left")
    return out.select("doc_id", "text_key", "n_words", hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                      ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = materialize(judge(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    return without(docs, bad, same_row(docs, bad))
