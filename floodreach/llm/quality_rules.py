"""Quality rules: per-text counts, and lines that repeat across the documents of a host.

A line is normalised (A-Z lower-cased, digits as 0, white space collapsed) and hashed. A line that more than ``MAX_DOCUMENTS``
distinct documents of its host carry is boilerplate and removed; a document that keeps less than ``KEEP_SHARE`` of its words
is depleted and rejected. So that copies of one text do not turn its own lines into boilerplate, documents count as distinct
by what is their own: all lines but the frequent ones (above the limit in distinct texts) and edits of these. An edit has ``MIN_EDIT``
words or more, up to one more or fewer than a frequent line, the same ``EDGE`` words at its start or end, and a 64-bit SimHash of its words
that differs in at most ``MAX_BITS_PERCENT`` of the bits; common first words alone make no edit. Where several frequent lines of one size share
those words, only bits on which they agree are compared, and where these are under ``MIN_BITS`` there are no edits. A document that
owns nothing is told apart by all its lines, or, if one of them is an edit, by the least hash of its frequent lines: pages put together
from template lines alone are distinct, edited copies of one text are not.

Scale: texts are read once and never shuffled. Line hashes are counted with partial sums per host and line; exact counts follow
only for lines above the limit, as a distinct over (line, text) and one over (line, hash of a document's own lines). A line or
a host of a third of all rows is thus summed in all tasks before it meets in one. Lines too short for an edit get keys of their own in
the joins, so they do not meet in one task. Nothing is collected.

Defined cases: null has no words and fails; a null host is a host of its own; lines without a word are never counted; repeated
rows count as one document and get the same verdict; an empty table has no rows; texts are measured whole, long ones in blocks; of columns
beside doc_id, text and the host none is read, whatever its name."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from . import scan
from .rows import same_row, without

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50  # fixed values: the base rules
MAX_DOCUMENTS, KEEP_SHARE = 20, 0.2
EDGE = 4  # words at either end by which an edited line is looked for; half of a shorter line
MIN_EDIT = 5  # words: with one of them changed four fifths are left
MAX_BITS_PERCENT, MIN_BITS = 28, 32
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_FOLD = scan.LOWER.copy()
_FOLD[0x30:0x3A] = 0x30

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LINES = pa.struct([("line", pa.int64()), ("words", pa.int32()), ("size", pa.int32()), ("head", pa.int64()), ("tail", pa.int64()), ("print", pa.int64())])


def _total(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many flags are set in each range [a, b)."""
    run = np.concatenate([[0], np.cumsum(flags)])
    return run[b] - run[a]


def _repeated(key: np.ndarray) -> np.ndarray:
    """True for every key that occurs twice or more."""
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def prints(words: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of consecutive runs of word hashes: a bit is set where it is in over half the words of the run."""
    out = np.zeros(len(first), np.uint64)
    if len(first):
        for bit in range(64):
            ones = np.add.reduceat((words >> np.uint64(bit)).astype(np.uint8) & 1, first, dtype=np.int32)
            out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each row, and its distinct lines as an array of structs with the number of them per row."""
    n = len(offsets) - 1
    start, end, row, word = scan.runs(data, offsets, scan.NOT_SPACE)
    of_row = scan.mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    out = {"n_words": scan.per_row(row, n), "word_chars": scan.per_row(row, n, _total(~scan.CONTINUATION[data], start, end)),
           "n_symbols": _total(_SYMBOL[data], offsets[:-1], offsets[1:])}
    gram, valid = scan.grams(word, row, 3)
    again = np.zeros(len(word), bool)
    if len(gram):
        found = np.zeros(len(gram), bool)
        found[valid] = _repeated(gram[valid] ^ of_row[row[:len(gram)][valid]])
        for j in range(3):
            again[j:j + len(gram)] |= found
    out["n_repeat_words"] = scan.per_row(row[again], n)

    l_start, l_end, l_row, line = scan.runs(data, offsets, scan.NOT_NEWLINE)
    words = np.searchsorted(start, l_end) - np.searchsorted(start, l_start)
    l_start, l_end, l_row, line, words = (x[words > 0] for x in (l_start, l_end, l_row, line, words))
    key = line ^ of_row[l_row]
    out["n_dup_lines"] = scan.per_row(l_row, n) - scan.per_row(l_row[np.unique(key, return_index=True)[1]], n)

    _, _, _, folded = scan.runs(_FOLD[data], offsets, scan.NOT_SPACE)
    first = np.searchsorted(start, l_start)
    shown = prints(folded, first, words)  # words outside lines there are none: the runs follow each other
    mixed, head, tail = (np.zeros(len(l_row), np.uint64) for _ in range(3))  # from the words' hashes and their places
    if len(l_row):
        place = np.arange(len(word)) - np.repeat(first, words)
        power = scan.mix(np.arange(1, max(EDGE, int(words.max())) + 1, dtype=np.uint64)) | np.uint64(1)
        mixed = scan.mix(np.add.reduceat(folded * power[place], first))
        edge = np.minimum(EDGE, words // 2)
        for j in range(EDGE):
            own = edge > j
            head[own] += folded[first[own] + j] * power[j]
            tail[own] += folded[(first + words - edge)[own] + j] * power[j]
    key = mixed ^ of_row[l_row]
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(inverse, words).astype(np.int32)  # words of all lines alike
    rank = np.sort(at)
    total = total[inverse[rank]]
    l_row, mixed, head, tail, shown, words = (x[rank] for x in (l_row, mixed, head, tail, shown, words))
    hashes = [pa.array(x.view(np.int64)) for x in (mixed, head, tail, shown)]
    lines = pa.StructArray.from_arrays([hashes[0], pa.array(total, pa.int32()), pa.array(words, pa.int32()), *hashes[1:]], fields=list(_LINES))
    return out, lines, scan.per_row(l_row, n)


def _measured(batches):
    scan.held()
    for batch in batches:
        data, offsets = scan.buffers(batch.column(3))
        for a, b in scan.slices(offsets):
            counts, lines, per = measure(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            part = batch.slice(a, b - a)
            yield pa.record_batch([*part.columns[:3], *[pa.array(counts[c]) for c in _COUNTS], scan.list_array(lines, per)], ["doc_id", "host", "text_key", *_COUNTS, "lines"])


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_key (a hash of the text), the base counts and the distinct lines of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    inputs = scan.small_batches(docs).select("doc_id", F.col(host).cast("string").alias("host"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string"))
    return inputs.mapInArrow(_measured, f"doc_id {kind}, host string, text_key bigint, {', '.join(c + ' bigint' for c in _COUNTS)}, lines array<struct<line:bigint,words:int,size:int,head:bigint,tail:bigint,print:bigint>>")


def _ends(frequent: DataFrame, end: str) -> DataFrame:
    """What frequent lines show that an edit of one word more, fewer or as many may share an end with: the bits set in all of them and in any."""
    sized = frequent.select("host", end, "print", F.explode(F.array(*[(F.col("size") + d).cast("int") for d in (-1, 0, 1)])).alias("size"))
    keyed = sized.select(F.xxhash64("host", "size", end).alias(end + "_key"), "print")
    return materialize(keyed.groupBy(end + "_key").agg(F.bit_and("print").alias(end + "_all"), F.bit_or("print").alias(end + "_any")), end)


def _alike(end: str) -> Column:
    """Whether a line's SimHash is near those of the frequent lines that share its end; false where there are none."""
    every, some = F.col(end + "_all"), F.col(end + "_any")
    sure = F.bitwise_not(every.bitwiseXOR(some))
    apart = F.bit_count(F.col("print").bitwiseXOR(every).bitwiseAND(sure))
    return F.coalesce((F.bit_count(sure) >= MIN_BITS) & (100 * apart <= MAX_BITS_PERCENT * F.bit_count(sure)), F.lit(False))


def boilerplate(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """key (of host and line) of every line above the limit."""
    key = F.xxhash64("host", "line").alias("key")
    lines = rows.select("rid", "host", "text_key", F.inline("lines"))
    often = lines.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_documents).select("key")
    often = materialize(often, "often")
    held = lines.select(key, "host", "text_key", "size", "head", "tail", "print").join(often, "key")
    texts = held.select("key", "text_key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > max_documents)
    seen = held.groupBy("key", "host", "size", "head", "tail", "print").agg(F.count(F.lit(1)).alias("n")).drop("n")
    frequent = materialize(seen.join(texts.select("key"), "key"), "frequent")

    ends = {end: _ends(frequent, end) for end in ("head", "tail")}
    known = materialize(frequent.select("key").distinct().withColumn("often", F.lit(True)), "known")
    own_key = F.xxhash64("rid", "line", F.lit("short"))  # of a line that can be no edit: it meets no other
    marked = lines.select("rid", "line", "print", key, *[F.when(F.col("size") >= MIN_EDIT, F.xxhash64("host", "size", end)).otherwise(own_key).alias(end + "_key") for end in ends])
    marked = marked.join(known, "key", "left")
    for end, table in ends.items():
        marked = marked.join(table, end + "_key", "left")
    often = F.coalesce("often", F.lit(False))
    edit = ~often & (_alike("head") | _alike("tail"))
    classes = marked.select("rid", "line", often.alias("often"), edit.alias("edit")).groupBy("rid").agg(
        F.bit_xor(F.when(~F.col("often") & ~F.col("edit"), F.col("line"))).alias("own"), F.min(F.when(F.col("often"), F.col("line"))).alias("least"),
        F.bit_xor("line").alias("all"), F.bool_or("edit").alias("edited"))
    classes = classes.withColumn("own", F.coalesce("own", F.when(~F.col("edited"), F.col("all"))))
    classes = classes.filter("least is not null").select("rid", F.coalesce("own", "least").alias("class"))
    met = lines.select("rid", key).join(known.select("key"), "key").join(classes, "rid").select("key", "class").distinct()
    return met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_documents).select("key")


def verdicts(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """doc_id, host, text_key, the base counts, base_failed, n_removed_words and kept of every row."""
    rows = materialize(measured(docs, host).withColumn("rid", F.monotonically_increasing_id()), "measured")
    bad = materialize(boilerplate(rows, max_documents), "boilerplate")
    lines = rows.select("rid", "host", F.inline("lines")).select("rid", F.xxhash64("host", "line").alias("key"), "words")
    removed = lines.join(bad, "key").groupBy("rid").agg(F.sum("words").alias("removed"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    gone = F.coalesce(F.col("removed"), F.lit(0).cast("bigint"))
    depleted = F.col("n_words") - gone < F.lit(KEEP_SHARE) * F.col("n_words")
    return rows.drop("lines").join(removed, "rid", "left").select("doc_id", "host", "text_key", *_COUNTS, failed.alias("base_failed"), gone.alias("n_removed_words"), (~failed & ~depleted).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` without the rejected rows."""
    bad = verdicts(docs, host).filter("not kept").select(F.col("doc_id").alias("_doc"), F.col("host").alias("_host"), F.col("text_key").alias("_key")).distinct()
    bad = materialize(bad, "rejected")
    return without(docs, bad, same_row(docs, bad) & docs[host].cast("string").eqNullSafe(bad["_host"]))
