"""Merkle manifest of a table: every row's leaf, its source's subtree, one root over all sources, and a proof for every row.

Leaves of a source stand in order of doc_id and are dealt into aligned parts of ``FANOUT ** PART_LEVELS``; a part's subtree is
hashed in one task. Upper proofs come by a butterfly exchange: in round r, a part swaps subtree roots with the parts whose numbers differ
from its own in digit r only (base ``FANOUT``), hashes the common ancestor itself, as do its partners, and keeps the other roots as
the next piece of its proof. After the rounds of its source it goes on likewise among the sources. Every part so ends with the
root and its own upper proof, and nothing is sent down the tree. Where the last group of a level is ragged, a partner stands
in for the missing one: that subtree's parts in turn.

Scale: texts become leaves where they are read; a leaf of 64 characters, its tampered form where that differs, doc_id and
source are what is shuffled: once by range (the order), once into parts. A round is an equality join and an aggregate of at most ``FANOUT``
rows a key, over one row a part (6,561 leaves), and there are log3(parts) + log3(sources) rounds, each written to the
shared folder. A source of a third of all rows is just more parts. Nothing is collected.

Defined cases: null fields hash as ``-``; a null source is a source of its own and the first; null doc_ids stand first in
their source and are never tampered with; equal doc_ids are ordered by their leaves, so equal rows take neighbouring places and each
has its own proof; a single row is leaf, subroot and root at once, with an empty proof; an empty table has no rows; other columns are not read."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.common import global_rank
from ..session import materialize
from . import scan

FANOUT = 3  # fixed by the manifest's format
PART_LEVELS = 8  # levels of the tree inside a part


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, *fields: Column) -> Column:
    """Digest of the fields and the text, in lowercase hex."""
    return F.sha2(F.concat(*[_field(f) for f in fields], _field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, tampered (the leaf after tampering; null where it is the same)."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    changed = F.when(struck, leaf(F.replace(text, F.lit("\n"), F.lit("")), *fields))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(text, *fields).alias("leaf"), changed.alias("tampered"))


def placed(rows: DataFrame, part_levels: int = PART_LEVELS) -> DataFrame:
    """``rows`` with sid (a number for the source, in order, from 0), part (of the source) and pos (in the part), each from 0."""
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc_nulls_first("tampered")]
    rows = materialize(global_rank(rows, order, "_rank"), "ordered")
    first = rows.groupBy("source").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_size"))
    sources = materialize(global_rank(first, [F.asc("_first")], "_number"), "sources")
    own = sources.select(F.col("source").alias("_source"), "_first", (F.col("_number") - 1).alias("sid"), "_size")
    size = FANOUT ** part_levels
    place = F.col("_rank") - F.col("_first")
    out = rows.join(own, rows["source"].eqNullSafe(own["_source"]))
    return out.select("doc_id", "source", "leaf", "tampered", "sid", F.floor(place / F.lit(size)).alias("part"), F.pmod(place, F.lit(size)).alias("pos"), F.ceil(F.col("_size") / F.lit(size)).alias("parts"))


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def tree(nodes: list[str], levels: int | None) -> list[list[str]]:
    """Levels of the tree over ``nodes``, up to a single node, or exactly ``levels`` above the leaves."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([digest(below[i:i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def proof(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    """Siblings (to the left, to the right) of leaf ``at``, level by level below the top."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        out.append((nodes[first:at], nodes[at + 1:first + FANOUT]))
        at //= FANOUT
    return out


def fold(node: str, steps: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in steps:
        node = digest([*left, node, *right])
    return node


def _parts(batches, n_cols: int):
    """Rows of one part at a time from batches sorted by (sid, part): key and columns as lists."""
    held: list[list] = [[] for _ in range(n_cols)]
    key = None
    for batch in batches:
        sid, part = (batch.column(i).to_numpy() for i in (0, 1))
        cuts = np.flatnonzero((sid[1:] != sid[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sid)]):
            if a == b:
                continue
            if key is not None and key != (sid[a], part[a]):
                yield key, held
                held = [[] for _ in range(n_cols)]
            key = (sid[a], part[a])
            for own, col in zip(held, batch.columns[2:]):
                own += col.slice(a, b - a).to_pylist()
    if key is not None:
        yield key, held


def _by_part(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("sid", "part").sortWithinPartitions("sid", "part", *order)


def part_roots(rows: DataFrame, part_levels: int = PART_LEVELS) -> DataFrame:
    """sid, part, parts (of the source), root of the part's subtree."""
    def run(batches):
        scan.held()
        for (sid, part), (leaf_, parts) in _parts(batches, 2):
            top = tree(leaf_, part_levels if parts[0] > 1 else None)[-1]
            yield pa.record_batch([pa.array([sid], pa.int64()), pa.array([part], pa.int64()), pa.array([parts[0]], pa.int64()), pa.array(top, pa.string())], ["sid", "part", "parts", "root"])
    ordered = _by_part(rows.select("sid", "part", "pos", "leaf", "parts"), "pos").select("sid", "part", "leaf", "parts")
    return ordered.mapInArrow(run, "sid bigint, part bigint, parts bigint, root string")


def _swap(parts: DataFrame, wide: int, within: bool, sources: DataFrame) -> DataFrame:
    """One round of the butterfly at subtrees of ``wide`` nodes: parts of a source, or sources, in groups of ``FANOUT``."""
    number, total = (F.col("sid"), F.col("n_sources")) if not within else (F.col("part"), F.col("parts"))
    nodes = F.ceil(total / F.lit(wide))
    own = F.floor(number / F.lit(wide))
    first = own - F.pmod(own, F.lit(FANOUT))
    active = parts.filter(nodes > 1)
    asked = active.select("sid", "part", own.alias("own"), F.pmod(number, F.lit(wide)).alias("low"), total.alias("total"), F.explode(F.sequence(first, F.least(first + (FANOUT - 1), nodes - 1))).alias("node"))
    start = F.col("node") * F.lit(wide)
    partner = start + F.pmod(F.col("low"), F.least(F.lit(wide), F.col("total") - start))
    asked = asked.select("sid", "part", "own", "node", partner.alias("partner"))
    if within:
        asked = asked.withColumns({"_sid": F.col("sid"), "_part": F.col("partner")})
    else:  # any part of the partner's source holds its root: they answer in turn
        asked = asked.join(sources.select(F.col("sid").alias("_sid"), F.col("parts").alias("_parts")), F.col("partner") == F.col("_sid")).withColumn("_part", F.pmod(F.col("part"), F.col("_parts")))
    answers = active.select(F.col("sid").alias("_sid"), F.col("part").alias("_part"), "root")
    got = asked.join(answers, ["_sid", "_part"]).groupBy("sid", "part").agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("nodes"), F.first("own").alias("own"))
    sides = [F.array_join(F.transform(F.filter("nodes", test), lambda x: x["root"]), "") for test in (lambda x: x["node"] < F.col("own"), lambda x: x["node"] > F.col("own"))]
    got = got.select("sid", "part", F.sha2(F.array_join(F.transform("nodes", lambda x: x["root"]), "").cast("binary"), 256).alias("_root"), F.struct(sides[0].alias("left"), sides[1].alias("right")).alias("_step"))
    # Every source's own rounds come first, so a part without this round keeps what it has
    joined = parts.join(got, ["sid", "part"], "left")
    return joined.select("sid", "part", "parts", "n_sources", F.coalesce("_root", "root").alias("root"), "subroot", F.when(F.col("_step").isNull(), F.col("steps")).otherwise(F.array_append("steps", F.col("_step"))).alias("steps"))


def exchanged(parts: DataFrame) -> DataFrame:
    """``parts`` (sid, part, parts, root) with root of the whole tree, subroot of the source, and steps: the sides of the upper proof."""
    parts = materialize(parts, "parts")
    sources = materialize(parts.filter("part = 0").select("sid", "parts"), "source_parts")
    most, n_sources = sources.agg(F.max("parts"), F.count(F.lit(1))).first()
    parts = parts.select("*", F.lit(n_sources).alias("n_sources"), F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    wide = 1
    while wide < (most or 0):
        parts = materialize(_swap(parts, wide, True, sources), "swap")
        wide *= FANOUT
    parts, wide = parts.withColumn("subroot", F.col("root")), 1
    while wide < n_sources:
        parts = materialize(_swap(parts, wide, False, sources), "swap")
        wide *= FANOUT
    return parts


_OUT = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs: DataFrame, part_levels: int = PART_LEVELS, proofs: bool = False) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of every row; with ``proofs`` also ``proof``, its siblings."""
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    rows = materialize(placed(leaves(docs), part_levels), "placed")
    upper = exchanged(part_roots(rows, part_levels))
    # A part's upper proof travels as one row before its leaves, not on every leaf
    head = upper.select("sid", "part", F.lit(-1).cast("bigint").alias("pos"), F.col("root").alias("leaf"), F.col("subroot").alias("tampered"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("source"), "parts", "steps")
    body = rows.select("sid", "part", "pos", "leaf", "tampered", "doc_id", "source", "parts", F.lit(None).cast(head.schema["steps"].dataType).alias("steps"))
    ordered = _by_part(body.unionByName(head), "pos").select("sid", "part", "doc_id", "source", "leaf", "tampered", "parts", "steps")
    fields = ["doc_id", "source", *_OUT, *(["proof"] if proofs else [])]

    def run(batches):
        scan.held()
        for _, (ids, sources, leaf_, tampered, parts, steps) in _parts(batches, 6):
            root, subroot = leaf_[0], tampered[0]
            above = [([x["left"]], [x["right"]]) for x in steps[0]]
            tail = "".join(x["left"] + x["right"] for x in steps[0])
            own = leaf_[1:]
            levels = tree(own, part_levels if parts[0] > 1 else None)
            digests, folded, texts = [], [], []
            for i, changed in enumerate(tampered[1:]):
                below = proof(levels, i)
                siblings = "".join(y for left, right in below for y in (*left, *right)) + tail
                digests.append(digest([siblings]))
                folded.append(fold(own[i] if changed is None else changed, below + above))
                if proofs:
                    texts.append(siblings)
            n = len(own)
            cols = [pa.array(ids[1:], id_type), pa.array(sources[1:], pa.string()), pa.array(own, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()),
                    pa.array(digests, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
            yield pa.record_batch(cols + ([pa.array(texts, pa.string())] if proofs else []), fields)
    types = f"doc_id {kind}, source string, " + ", ".join(f"{c} {'boolean' if c == 'verified' else 'string'}" for c in _OUT) + (", proof string" if proofs else "")
    return ordered.mapInArrow(run, types)
