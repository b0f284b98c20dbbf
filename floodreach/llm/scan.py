"""Byte-level scanning of Arrow text columns with numpy: runs of bytes (words, lines), their hashes, and sums per row.

UTF-8 lets every rule whose delimiters are ASCII work on bytes: bytes of other characters are all 0x80 or more.
Memory is bounded by ``SLICE`` bytes of text at a time, plus a few numbers per word of the longest text."""
from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE = 1 << 20  # bytes of text scanned at once; hashing works in blocks of this size, also inside one long text
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE ^= (_BASE ^ 5) & 7  # 5 modulo 8, so powers keep their period
_GRAM = np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
NOT_NEWLINE = np.arange(256) != 0x0A
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
CONTINUATION = (np.arange(256) & 0xC0) == 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after telling its session to hand workers fewer rows at a time than its default of 10,000: texts are long, and
    a batch stands in the memory of both the executor and the worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


_held: dict[object, object] = {}
_powers: dict[str, np.ndarray] = {}


def held(key: object = None, build=None) -> object:
    """One large table at a time for the tasks of a worker process. Workers go on to other stages, which ask for
    another table or, with ``held()``, for none, and so let the last one go. A new table takes the place of the powers, too."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()  # tables may hold cycles, and Python's lists of free objects keep their memory from being returned
        if build is not None:
            _powers.clear()
        pa.default_memory_pool().release_unused()
        if build is not None:
            _held[key] = build()
    return _held.get(key)


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers.get(kind, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (int64, from 0) of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, ...]:
    """Maximal runs of member bytes inside rows: start, end (byte positions), row and 64-bit hash of each."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    inside = np.zeros(0, bool)
    while at < n:
        to = min(n, at + SLICE)
        while to < n and member[data[to - 1]]:  # never cut a run: go on to the next byte outside it
            ahead = member[data[to:to + 4096]]
            gap = np.flatnonzero(~ahead)
            to += int(gap[0]) + 1 if len(gap) else len(ahead)
        block = data[at:to]
        inside = member[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = offsets[np.searchsorted(offsets, at, "left"):np.searchsorted(offsets, to, "right")] - at
        here = cuts[cuts < len(block)]
        first[here] = inside[here]
        before = cuts[cuts > 0] - 1
        last[before] = inside[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if hashed and len(s):
            power, back = _power("up", _BASE, len(block)), _power("down", pow(_BASE, -1, 1 << 64), len(block))
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[:len(block)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * back[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row, (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` consecutive runs, and whether they all lie in one row."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for j in range(1, n):
        out *= _GRAM
        out += hashes[j:j + m]
    return mix(out), row[:m] == row[n - 1:]


def per_row(row: np.ndarray, n_rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Integer count or sum per row."""
    return np.bincount(row, weights, n_rows)[:n_rows].round().astype(np.int64)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths over consecutive values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
