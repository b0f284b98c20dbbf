"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints within 3 bits agree, in one of only two 32-bit segments, up to one bit. Segments are indexed by their one-wildcard
variants: of the distinct segment values, at most two share a variant, and these differ in just the wildcard bit. So an
aggregate finds all neighbouring segment values, an equality join brings the fingerprints behind equal or neighbouring
segments together, and the rest of the bits is verified.

Scale: copies collapse to distinct fingerprints before anything is joined. Groups of more than ``PAIRS_WITHIN`` fingerprints
are not paired but cut again by the same rule, on 16 and then on 8 bits of what they have not agreed on yet; after that a
group cannot hold more than 2^11 different fingerprints, so no bucket grows with the data. Nothing is collected; links and
component labels are written to the shared folder.

Defined cases: a null or wordless text has fingerprint 0 and is linked like any other; a text of fewer than three words is
one shingle; repeated rows get the same result; rows of a null doc_id never name a component, and a component of such rows
alone has a null id; an empty table has no rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from . import scan
from .components import components
from .rows import same_row, without

SHINGLE, SEED, DISTANCE = 3, 42, 3
PAIRS_WITHIN = 64


def fingerprint(text: str) -> int:
    """SimHash of a text as a signed 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    scan.held()
    for batch in batches:
        _, offsets = scan.buffers(batch.column(2))
        for a, b in scan.slices(offsets):
            part = batch.slice(a, b - a)
            yield pa.record_batch([part.column(0), part.column(1), pa.array([fingerprint(t or "") for t in part.column(2).to_pylist()], pa.int64())], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and fp (signed 64-bit) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan.small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string")).mapInArrow(_fingerprints, f"doc_id {kind}, text_key bigint, fp bigint")


def _narrow(members: DataFrame, width: int) -> DataFrame:
    """(g, fp, rest of ``width`` bits) to smaller groups (g, fp, rest of ``width``/2 bits): two members of a group whose rests
    differ by at most 3 bits share one of the new groups."""
    half = width // 2
    mask = (1 << half) - 1
    low, high = F.col("rest").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("rest", half).bitwiseAND(F.lit(mask))
    cut = members.select("g", "fp", F.inline(F.array(F.struct(F.lit(0).alias("h"), low.alias("v"), high.alias("rest")), F.struct(F.lit(1).alias("h"), high.alias("v"), low.alias("rest")))))
    same = cut.select(F.xxhash64("g", "h", "v").alias("g"), "fp", "rest")
    parts = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), cut.sparkSession.sparkContext.defaultParallelism)
    # Hardly any two values share a variant, so rows are dealt out before they are aggregated, and no task holds more than its share
    values = cut.select("g", "h", "v").repartition(parts, "g", "h", "v").distinct()
    variant = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: F.col("v").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))) + (i + half * F.col("h")) * F.lit(1 << 32))
    keyed = values.select("g", "h", "v", F.explode(variant).alias("key")).repartition(parts, "g", "key")  # variant, bit and segment in one integer
    pairs = keyed.groupBy("g", "key").agg(F.min("h").alias("h"), F.min("v").alias("v0"), F.max("v").alias("v1")).filter("v0 < v1")
    sides = pairs.select("g", "h", F.xxhash64("g", "h", "v0", "v1").alias("to"), F.explode(F.array("v0", "v1")).alias("v"))
    near = cut.join(sides, ["g", "h", "v"]).select(F.col("to").alias("g"), "fp", "rest")
    return same.unionByName(near)


def links(prints: DataFrame, within: int = PAIRS_WITHIN) -> DataFrame:
    """a, b: all pairs of the distinct fingerprints ``fp`` that differ in 1 to 3 bits, each once."""
    found, members, width = None, prints.select(F.col("fp").bitwiseAND(F.lit(0)).alias("g"), "fp", F.col("fp").alias("rest")), 64
    while True:
        groups = materialize(_narrow(members, width), "groups")
        width //= 2
        sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        few = groups.join(sizes.filter(F.col("n") <= within) if width > 8 else sizes, "g")
        one, two = few.select("g", F.col("fp").alias("a")), few.select("g", F.col("fp").alias("b"))
        pairs = one.join(two, "g").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b").distinct()
        found = pairs if found is None else found.unionByName(pairs)
        if width == 8:
            break
        members = materialize(groups.join(sizes.filter(F.col("n") > within), "g", "left_semi"), "crowded")
        if members.isEmpty():
            break
    return found.distinct()


def cluster(prints: DataFrame, within: int = PAIRS_WITHIN) -> DataFrame:
    """fp, component_id for every distinct fingerprint of ``prints`` (doc_id, fp)."""
    own = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    joined = components(links(own, within)).withColumnRenamed("node", "fp")
    least = own.join(joined, "fp").groupBy("root").agg(F.min("doc_id").alias("least"))
    moved = joined.join(least, "root").select("fp", "least", F.lit(True).alias("linked"))
    return own.join(moved, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    prints = materialize(fingerprints(docs), "prints")
    named = materialize(cluster(prints), "components")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (nulls last), of its texts the one with the
    smallest key, of equal rows one."""
    prints = materialize(fingerprints(docs), "prints")
    named = materialize(components(links(prints.select("fp").distinct())), "components").withColumnRenamed("node", "fp")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    first = prints.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.join(named, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = materialize(first.select(F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key")), "kept")
    keys = materialize(prints.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).count(), "keys")
    gone = keys.join(kept, keys["_doc"].eqNullSafe(kept["_doc"]) & (keys["_key"] == kept["_key"]), "left_anti").drop("count")
    gone = materialize(gone, "gone")
    out = without(docs, gone, same_row(docs, gone))
    repeated = materialize(keys.filter("count > 1").drop("count"), "repeated")
    if not repeated.isEmpty():  # only rows that are there more than once go through a shuffle of their own
        out = without(out, repeated, same_row(out, repeated)).unionByName(out.join(repeated, same_row(out, repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
