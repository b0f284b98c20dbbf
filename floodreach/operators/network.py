"""Scenario graphs, connected components, multi-source shortest paths, village status and routes.

A scenario is a (threshold, date, mode) key carried by every row, so all of them are solved in the same rounds."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import distance, merge_lines
from ..functions.rounding import half_even
from ..params import Params
from ..session import materialize
from .common import distinct_values, global_rank

SCENARIO = ["threshold", "date", "mode"]
MODES = ("pessimistic", "optimistic")
CHUNK = 1 << 18  # links contracted at a time


def assign_blocks(edges: DataFrame, p: Params = Params(), base: float = 500.0, levels: int = 6) -> DataFrame:
    """Give each edge a spatial block holding at most ``p.block_cap`` edges: (edge_id, block).

    A block is the coarsest square around the edge that is small enough. A finest square that is still too
    full is split by hash. Any split is correct; locality only reduces the number of rounds."""
    at = lambda axis: F.floor(F.coalesce(F.get("geom", F.lit(0))[axis], F.lit(0.0)) / F.lit(base))  # noqa: E731  an edge without geometry is a link like any other
    e = edges.select("edge_id", at("x").alias("fx"), at("y").alias("fy"))
    fine = e.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("c"))
    ladder = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col("fx") / 4 ** k).alias("bx"), F.floor(F.col("fy") / 4 ** k).alias("by")) for k in range(levels)])
    wide = fine.select("fx", "fy", "c", F.explode(ladder).alias("l")).select("fx", "fy", "c", "l.*")
    fits = wide.groupBy("k", "bx", "by").agg(F.sum("c").alias("n")).filter(F.col("n") <= p.block_cap)
    best = wide.join(fits, ["k", "bx", "by"]).groupBy("fx", "fy").agg(F.max(F.struct("k", "bx", "by")).alias("b"))
    cell = (fine.join(best, ["fx", "fy"], "left")
            .withColumn("parts", F.when(F.col("b").isNull(), F.ceil(F.col("c") / p.block_cap)).otherwise(1)))
    split = F.concat_ws("/", F.lit("s"), "fx", "fy", F.pmod(F.xxhash64("edge_id"), F.col("parts")))
    home = F.when(F.col("b").isNull(), split).otherwise(F.concat_ws("/", "b.k", "b.bx", "b.by"))
    return e.join(cell, ["fx", "fy"]).select("edge_id", home.alias("block"))


def length_mm(length_m) -> Column:
    """Exact integer weight; a zero-length link counts one millimetre so that paths strictly grow."""
    return F.greatest(F.lit(1), F.round(length_m * 1000)).cast("bigint")


def full_status(edges: DataFrame, status: DataFrame, scenarios: Column) -> DataFrame:
    """Status of every edge in every (threshold, date); a missing one is unknown, never open.

    ``pos`` is the place of the pair in ``scenarios``, a short integer that stands for it in shuffles."""
    dense = edges.select("edge_id", F.posexplode(scenarios).alias("pos", "s")).select("edge_id", "pos", "s.threshold", "s.date")
    return (dense.join(status.select("threshold", "date", "edge_id", "status"), ["threshold", "date", "edge_id"], "left")
            .withColumn("status", F.coalesce("status", F.lit("unknown"))))


def usable_links(edges: DataFrame, status: DataFrame, modes=MODES) -> DataFrame:
    """Links of every scenario: scenario, threshold, date, mode, u, v, edge_id, w (and block, if assigned).

    Pessimistic graphs hold roads seen open, optimistic ones every road not seen cut. Self-loops go; parallel
    roads stay, which no shortest path minds."""
    usable = {"pessimistic": F.col("status") == "open", "optimistic": F.col("status") != "cut"}
    ways = F.array_compact(F.array(*[F.when(usable[m], F.struct(F.lit(MODES.index(m)).alias("i"), F.lit(m).alias("mode"))) for m in modes]))
    cols = [c for c in ("block",) if c in edges.columns]
    road = edges.filter(F.col("u") != F.col("v")).select(
        "edge_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), length_mm(F.col("length_m")).alias("w"), *cols)
    j = status.select("pos", "threshold", "date", "edge_id", F.explode(ways).alias("m")).join(road, "edge_id")
    return j.select((F.col("pos") * 2 + F.col("m.i")).alias("scenario"), "threshold", "date", "m.mode", "u", "v", "edge_id", "w", *cols)


def build_graph(edges: DataFrame, status: DataFrame, modes=MODES) -> DataFrame:
    """Simple scenario graphs: of parallel usable roads the shortest stays (ties: smaller edge_id)."""
    links = usable_links(edges, status, modes)
    return links.groupBy(*SCENARIO, "u", "v").agg(F.min(F.struct("w", "edge_id")).alias("b")).select(*SCENARIO, "u", "v", "b.*")


def _contract(keys: list[str]):
    def run(batches):
        """Replace links, ``CHUNK`` of a partition at a time, by links to the smallest node each one reaches among them."""
        held, size = [], 0
        for p in batches:
            held, size = [*held, p], size + len(p)
            if size >= CHUNK:
                yield contracted(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if size:
            yield contracted(pd.concat(held, ignore_index=True))

    def contracted(e):
        n = len(e)
        group = e.groupby(keys, sort=False).ngroup().to_numpy() if keys else np.zeros(n, np.int64)
        names, rank = np.unique(np.concatenate([e["a"].to_numpy(), e["b"].to_numpy()]), return_inverse=True)
        code, pos = np.unique(np.concatenate([group, group]) * len(names) + rank, return_inverse=True)
        a, b, root = pos[:n], pos[n:], np.arange(len(code))
        while True:
            low, new = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        hit = np.flatnonzero(root != np.arange(len(code)))
        out = pd.DataFrame({"a": names[code[hit] % len(names)], "b": names[code[root[hit]] % len(names)]})
        if keys:
            head = e[keys].groupby(group).first()
            for k in reversed(keys):
                out.insert(0, k, head[k].reindex(code[hit] // len(names)).to_numpy())
        return out
    return run


def components(pairs: DataFrame, keys: list[str] = (), u: str = "u", v: str = "v") -> DataFrame:
    """Smallest node of each node's component: keys, node, component.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which need a logarithmic number of
    rounds; each is a ``min`` aggregate and a join back, so a hub never gathers its neighbours. Before every
    write a partition first contracts the links it happens to hold, in chunks of bounded size, which costs no shuffle and leaves later
    rounds only what spans partitions."""
    keys = list(keys)
    e = pairs.filter(F.col(u) != F.col(v)).select(*keys, F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
    contract = lambda df: materialize(df.mapInPandas(_contract(keys), df.schema), "cc")
    e = contract(e)
    print_sum = F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))
    seen = e.agg(F.count(F.lit(1)).alias("n"), print_sum.alias("s")).first()
    while True:
        both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter(F.col("b") > F.col("a")).join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        hook = large.join(least, [*keys, "a"]).filter(F.col("b") != F.col("m")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        small = hook.unionByName(least.select(*keys, "a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b"))
        e = contract(small)
        mark = e.agg(F.count(F.lit(1)).alias("n"), print_sum.alias("s")).first()
        if mark == seen:
            break
        seen = mark
    roots = e.select(*keys, F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def reachable_from(graph: DataFrame, nodes: DataFrame, sources: DataFrame, keys: list[str] = (), scenarios: DataFrame | None = None) -> DataFrame:
    """Nodes that share a component with a source. ``nodes`` are the junctions of any edge, open or not; ``scenarios`` has the
    keys of all scenarios, also of those without a usable road (else those of ``graph``)."""
    keys = list(keys)
    cc = components(graph, keys)
    src = sources.select("node").distinct().join(nodes.select("node").distinct(), "node")
    hit = cc.join(src, "node", "left_semi").select(*keys, "component").distinct()
    reached = cc.join(hit, [*keys, "component"], "left_semi").select(*keys, "node")
    if not keys:
        return reached.unionByName(src).distinct()
    alone = src.withColumn("_k", F.explode(distinct_values(graph if scenarios is None else scenarios, *keys)))
    alone = alone.select(*([F.col("_k").alias(keys[0])] if len(keys) == 1 else ["_k.*"]), "node")
    return reached.unionByName(alone.select(*reached.columns)).distinct()


def _relax_block(keys: list[str], unit: int):
    def run(links: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        """Relax one block until nothing changes, touching only links of nodes that just improved.

        Distance and place of the source travel as one integer, ``unit`` of it to the millimetre."""
        n = len(links)
        ids, pos = np.unique(np.concatenate([links["u"].to_numpy(), links["v"].to_numpy(), seeds["node"].to_numpy()]), return_inverse=True)
        far = np.iinfo(np.int64).max
        best = np.full(len(ids), far)
        np.minimum.at(best, pos[2 * n:], seeds["code"].to_numpy())
        ends, tails = np.concatenate([pos[:n], pos[n:2 * n]]), np.concatenate([pos[n:2 * n], pos[:n]])
        order = np.argsort(ends, kind="stable")
        first = np.searchsorted(ends[order], np.arange(len(ids) + 1))
        to, long = tails[order], np.concatenate([links["w"].to_numpy()] * 2)[order]
        if long.max(initial=0) > far // unit:
            raise OverflowError("a road is too long for 64 bits")
        weight = long * unit
        fresh = np.flatnonzero(best < far)
        while len(fresh):
            count = first[fresh + 1] - first[fresh]
            arc = np.repeat(first[fresh] - np.cumsum(count) + count, count) + np.arange(count.sum())
            new = np.repeat(best[fresh], count) + weight[arc]
            if new.min(initial=0) < 0:
                raise OverflowError("a path is too long for 64 bits")
            better = new < best[to[arc]]
            reached = to[arc[better]]
            np.minimum.at(best, reached, new[better])
            fresh = np.unique(reached)
        hit = best < far
        head = seeds if len(seeds) else links
        return pd.DataFrame({**{k: head[k].iloc[0] for k in keys}, "node": ids[hit], "code": best[hit]})
    return run


def shortest_distances(graph: DataFrame, sources: DataFrame, keys: list[str], compact_every: int = 8) -> DataFrame:
    """Distance (mm) to the nearest source and which one, ties to the smaller source: keys, node, dist, src.

    ``graph``: keys, block, u, v, w, read once per round, so it should be a written table. ``sources``: keys, node,
    present in the scenario's network even when all their roads are cut. Each round relaxes whole blocks to a
    fixed point in tasks of bounded size, then blocks exchange only nodes that improved and lie in several
    blocks. Rounds end when nothing improves; they grow with the number of block borders on a path, not with its
    number of junctions. What is known is kept in a few written pieces, merged every ``compact_every`` rounds, and only
    looked up for nodes a round has reached. Distance and place of the source are one integer, whose ``min`` is a hash aggregate."""
    keys = list(keys)
    on = [*keys, "node"]
    g = graph.select(*keys, "block", "u", "v", "w")
    numbered = materialize(global_rank(sources.select("node").distinct(), [F.col("node").asc()], "no"), "sources")
    member = materialize(g.select(*keys, "block", F.explode(F.array("u", "v")).alias("node")).distinct(), "member")
    shared = materialize(member.groupBy(*on).agg((F.count(F.lit(1)) > 1).alias("shared")).filter("shared"), "shared")
    unit = 1 << max(1, int(numbered.count()).bit_length())  # places start at 1
    known = materialize(sources.select(*on).distinct().join(numbered, "node").select(*on, F.col("no").alias("code")), "dist")
    pieces, active, schema = [known], known, known.schema
    least = F.min("code")
    while True:
        inbox = active.join(member, on).select(*keys, "block", "node", "code")
        links = g.join(inbox.select(*keys, "block").distinct(), [*keys, "block"], "left_semi")
        found = (links.groupBy(*keys, "block").cogroup(inbox.groupBy(*keys, "block")).applyInPandas(_relax_block(keys, unit), schema))
        found = materialize(found, "found")
        new = found.groupBy(*on).agg(least.alias("code"))
        old = reduce(DataFrame.unionByName, pieces).join(found.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(least.alias("old"))
        better = new.join(old, on, "left").filter(F.col("old").isNull() | (F.col("code") < F.col("old"))).select(*on, "code")
        better = materialize(better.join(shared, on, "left"), "better")
        pieces.append(better.drop("shared"))
        active = better.filter("shared").drop("shared")
        if active.isEmpty():
            break
        if len(pieces) >= compact_every:
            pieces = [materialize(reduce(DataFrame.unionByName, pieces).groupBy(*on).agg(least.alias("code")), "dist")]
    best = reduce(DataFrame.unionByName, pieces).groupBy(*on).agg(least.alias("code"))
    best = best.select(*on, F.shiftright("code", unit.bit_length() - 1).alias("dist"), (F.col("code") % unit).alias("no"))
    return best.join(numbered.withColumnRenamed("node", "src"), "no").select(*on, "dist", "src")


def shelter_by_junction(shelters: DataFrame) -> DataFrame:
    """Which shelter stands for a junction: the smallest id among the road-reachable ones."""
    return shelters.filter("road_reachable").groupBy("node_id").agg(F.min("shelter_id").alias("shelter_id"))


def scenario_axis(road_status: DataFrame) -> DataFrame:
    """The (threshold, date) pairs there are, as a small written table that later steps read instead of the status."""
    return materialize(road_status.select("threshold", "date").distinct(), "axis")


_WORD = 62  # (threshold, date) pairs per word of a road's states
_SOURCE, _BORDER = -1, -2  # kinds of a block's rows that hold in every scenario; others name their scenario


def road_words(edges: DataFrame, road_status: DataFrame, axis: Column, pairs: int) -> DataFrame:
    """Every road once, with its states in all scenarios as bits: edge_id, u, v, w, block, open0.., cut0.. (one word per ``_WORD`` pairs).

    A road without a row in a pair is neither open nor cut there, which is unknown. The words are a hash aggregate, so no table of roads times
    scenarios is joined or kept."""
    pos = (F.array_position(axis, F.struct("threshold", "date")) - 1).cast("int")
    rows = road_status.filter(F.col("status").isin("open", "cut")).select("edge_id", "status", pos.alias("pos"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % _WORD)
    names = [(s, k) for s in ("open", "cut") for k in range(-(-pairs // _WORD))]
    words = rows.groupBy("edge_id").agg(*[F.bit_or(F.when((F.col("status") == s) & (F.floor(F.col("pos") / _WORD) == k), bit)).alias(f"{s}{k}") for s, k in names])
    road = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select(
        "edge_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), length_mm(F.col("length_m")).alias("w"), "block")
    return road.join(words, "edge_id", "left").fillna(0, [f"{s}{k}" for s, k in names])


def scenario_links(roads: DataFrame, axis: Column, pairs: int) -> DataFrame:
    """Links of every scenario off the words of its roads: threshold, date, mode, u, v, edge_id, w, as ``usable_links`` gives them."""
    at = lambda s: F.getbit(F.get(F.array(*[f"{s}{k}" for k in range(-(-pairs // _WORD))]), F.floor(F.col("pos") / _WORD).cast("int")), F.col("pos") % _WORD) == 1
    ways = F.array_compact(F.array(F.when(at("open"), F.lit(MODES[0])), F.when(~at("cut"), F.lit(MODES[1]))))
    wide = roads.filter(F.col("u") != F.col("v")).select("*", F.posexplode(axis).alias("pos", "s"))
    return wide.select("s.threshold", "s.date", F.explode(ways).alias("mode"), "u", "v", "edge_id", "w")


def _relax_lane(pairs: int, lanes: int, unit: int, whole: bool, every: bool):
    def run(key, roads: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Relax one block in each scenario of a lane (all of them if ``every``, else those a border row names) until nothing changes.

        Distance and place of the source travel as one integer, ``unit`` of it to the millimetre. Out come the nodes inside the block if
        ``whole``, else the border nodes that improve on what came in."""
        n, far = len(roads), np.iinfo(np.int64).max
        kind, code = rows["kind"].to_numpy(), rows["code"].to_numpy(np.int64)
        ids, pos = np.unique(np.concatenate([roads["u"].to_numpy(), roads["v"].to_numpy(), rows["node"].to_numpy()]), return_inverse=True)
        a, b, at = pos[:n], pos[n:2 * n], pos[2 * n:]
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        ends, tails = np.concatenate([a, b])[order], np.concatenate([b, a])[order]
        weight = np.tile(roads["w"].to_numpy(np.int64), 2)[order]
        if weight.max(initial=0) > far // unit:
            raise OverflowError("a road is too long for 64 bits")
        weight, border, own = weight * unit, np.zeros(len(ids), bool), np.full(len(ids), far)
        border[at[kind == _BORDER]] = True
        np.minimum.at(own, at[kind == _SOURCE], code[kind == _SOURCE])
        valued = kind != _BORDER
        place, one = np.unique(code[valued] % unit, return_index=True)
        source = rows["src"].to_numpy()[valued][one]
        todo = np.arange(int(key[1]), 2 * pairs, lanes) if every else np.unique(kind[kind >= 0])
        out = []
        for s in todo.tolist():
            word, bit = divmod(s // 2, _WORD)
            state = np.tile(roads[f"{('open', 'cut')[s % 2]}{word}"].to_numpy(np.int64), 2)[order] >> bit & 1
            use = np.flatnonzero(state == 1 - s % 2)  # open roads, or those not cut
            to, long, first = tails[use], weight[use], np.searchsorted(ends[use], np.arange(len(ids) + 1))
            told = np.full(len(ids), far)
            np.minimum.at(told, at[kind == s], code[kind == s])
            best = np.minimum(own, told)
            fresh = np.flatnonzero(best < far)
            while len(fresh):
                count = first[fresh + 1] - first[fresh]
                arc = np.repeat(first[fresh] - np.cumsum(count) + count, count) + np.arange(count.sum())
                new = np.repeat(best[fresh], count) + long[arc]
                if new.min(initial=0) < 0:
                    raise OverflowError("a path is too long for 64 bits")
                better = new < best[to[arc]]
                reached = to[arc[better]]
                np.minimum.at(best, reached, new[better])
                fresh = np.unique(reached)
            hit = np.flatnonzero((best < far) & ~border if whole else border & (best < told))
            out.append((np.full(len(hit), s, np.int32), ids[hit], best[hit]))
        if not out:
            return pd.DataFrame({"scenario": np.zeros(0, np.int32), "node": ids[:0], "code": np.zeros(0, np.int64), "src": ids[:0]})
        scenario, node, best = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"scenario": scenario, "node": node, "code": best, "src": source[np.searchsorted(place, best % unit)] if len(best) else ids[:0]})
    return run


def scenario_distances(roads: DataFrame, sources: DataFrame, pairs: int, at_once: int = 32, groups: int = 48) -> DataFrame:
    """Distance (mm) to the nearest source and which one, ties to the smaller source, in every scenario: scenario, node, dist, src.

    ``roads``: from ``road_words``, written, as each round reads it. A task holds one block with its bits and solves ``at_once`` scenarios of it one after
    the other, so a road travels once for these and not once for each. Between rounds only nodes that lie in several blocks are exchanged, and only
    blocks to which such a node came nearer go on, with all they know of their border. When none does, one last pass tells what lies inside the blocks.
    Sources hold in every scenario, also where all their roads are cut."""
    spark = roads.sparkSession
    places = materialize(global_rank(sources.select("node").distinct(), [F.col("node").asc()], "no"), "sources")
    unit = 1 << max(1, int(places.count()).bit_length())  # places start at 1
    member = materialize(roads.select("block", F.explode(F.array("u", "v")).alias("node")).distinct(), "member")
    blocks = member.select("block").distinct().count()
    lanes = min(2 * pairs, max(-(-2 * pairs // at_once), -(-groups // max(blocks, 1))))
    shared = member.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    border = materialize(member.join(shared, "node", "left_semi"), "border")
    row = lambda kind, code, src: ["block", F.lit(kind).alias("kind"), "node", F.lit(code).cast("bigint").alias("code"), F.col(src).alias("src")]
    fixed = member.join(places, "node").select(*row(_SOURCE, F.col("no"), "node")).unionByName(border.select(*row(_BORDER, 0, "node")))
    fixed = materialize(fixed, "fixed")
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    tasks = max(4, 3 * spark.sparkContext.defaultParallelism)  # a block's rows are few bytes and much work, so tasks are not merged by size
    node = roads.schema["u"].dataType.simpleString()
    links = roads.drop("edge_id")

    def solved(rows, where, whole, every):
        here = links.select("*", every_lane) if where is None else links.join(where, "block")
        both = [d.repartition(tasks, "block", "lane").groupBy("block", "lane") for d in (here, rows)]
        return materialize(both[0].cogroup(both[1]).applyInPandas(_relax_lane(pairs, lanes, unit, whole, every), f"scenario int, node {node}, code bigint, src {node}"), "found")

    told = lambda known: known.join(border, "node").select("block", F.col("scenario").alias("kind"), "node", "code", "src")
    lane_of = (F.col("kind") % lanes).alias("lane")
    least = lambda df: df.groupBy("scenario", "node").agg(F.min(F.struct("code", "src")).alias("b")).select("scenario", "node", "b.*")
    better = materialize(least(solved(fixed.select("*", every_lane), None, False, True)), "better")
    known = better
    while not better.isEmpty():
        news = told(better).select("block", "kind").distinct()
        rows = materialize(told(known).join(news, ["block", "kind"], "left_semi").select("*", lane_of), "rows")
        where = materialize(rows.select("block", "lane").distinct(), "where")
        better = materialize(least(solved(rows.unionByName(fixed.join(where, "block")), where, False, False)), "better")
        known = materialize(least(known.unionByName(better)), "known")
    rows = told(known).select("*", lane_of).unionByName(fixed.select("*", every_lane))
    best = solved(rows, None, True, True).unionByName(known)
    return best.select("scenario", "node", F.shiftright("code", unit.bit_length() - 1).alias("dist"), "src")


def solve(edges: DataFrame, road_status: DataFrame, villages: DataFrame, shelters: DataFrame, p: Params = Params(), pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both graphs of every scenario and the distances over them. ``pairs``: from ``scenario_axis``."""
    pairs = scenario_axis(road_status) if pairs is None else pairs
    axis, n = distinct_values(pairs, "threshold", "date"), pairs.count()
    e = edges.select("edge_id", "u", "v", "length_m").join(assign_blocks(edges, p), "edge_id")
    roads = materialize(road_words(e, road_status, axis, n), "roads")
    junctions = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    src = shelter_by_junction(shelters).select(F.col("node_id").alias("node")).join(junctions, "node", "left_semi")
    d = scenario_distances(roads, src, n)
    which = F.get(axis, F.floor(F.col("scenario") / 2).cast("int"))
    mode = F.when(F.col("scenario") % 2 == 0, MODES[0]).otherwise(MODES[1])
    solved = d.withColumn("_s", which).select("_s.threshold", "_s.date", mode.alias("mode"), "node", "dist", "src")
    return scenario_links(roads, axis, n), materialize(solved, "solved")


def village_status(solved: DataFrame, road_status: DataFrame, villages: DataFrame, shelters: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Status of every village in every (threshold, date).

    boat_dependent wins, then connected (reached over open roads), isolated (not reached over any road that is
    not cut), and uncertain in between."""
    axis = distinct_values(road_status if pairs is None else pairs, "threshold", "date")
    v = villages.select("village_id", "node_id", "boat_dependent", F.explode(axis).alias("s")).select("village_id", "node_id", "boat_dependent", "s.*")
    lived = villages.select(F.col("node_id").alias("node")).distinct()
    near = solved.join(lived, "node", "left_semi").groupBy("threshold", "date", F.col("node").alias("node_id")).agg(
        F.min(F.when(F.col("mode") == "pessimistic", F.col("dist"))).alias("dist"),
        F.min(F.when(F.col("mode") == "pessimistic", F.col("src"))).alias("src"), F.lit(True).alias("reach"))
    named = shelter_by_junction(shelters).select(F.col("node_id").alias("src"), "shelter_id")
    j = v.join(near, ["threshold", "date", "node_id"], "left").join(named, "src", "left")
    state = (F.when(F.col("boat_dependent"), "boat_dependent").when(F.col("dist").isNotNull(), "connected")
             .when(F.col("reach").isNull(), "isolated").otherwise("uncertain"))
    return j.select("threshold", "date", "village_id", state.alias("status"),
                    half_even(F.col("dist") / 1000, 1).alias("dist_to_shelter_m"), F.col("shelter_id").alias("nearest_shelter_id"))


def status_counts(status: DataFrame) -> DataFrame:
    names = ["boat_dependent", "connected", "isolated", "uncertain"]
    return status.groupBy("threshold", "date").agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])


def shortest_path_tree(graph: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    """Next junction towards the shelter for every reached node: keys, node, next, edge_id, dist."""
    both = graph.select(*keys, F.col("u").alias("node"), F.col("v").alias("next"), "w", "edge_id").unionByName(
        graph.select(*keys, F.col("v").alias("node"), F.col("u").alias("next"), "w", "edge_id"))
    here = solved.select(*keys, "node", "dist", "src")
    there = solved.select(*keys, F.col("node").alias("next"), F.col("dist").alias("_d"), F.col("src").alias("_s"))
    tight = (both.join(here, [*keys, "node"]).join(there, [*keys, "next"])
             .filter((F.col("dist") == F.col("_d") + F.col("w")) & (F.col("src") == F.col("_s"))))
    return tight.groupBy(*keys, "node", "dist").agg(F.min(F.struct("next", "edge_id")).alias("n")).select(*keys, "node", "dist", "n.*")


def route_steps(tree: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """All tree steps from each start to its root: keys, village_id, node, next, edge_id, dist.

    Jump tables of doubling length reach every ancestor in log(hops) joins; distance gives the order."""
    keys = list(keys)
    jumps = [materialize(tree.select(*keys, "node", F.col("next").alias("to")), "jump")]
    while True:
        last = jumps[-1]
        twice = last.join(last.select(*keys, F.col("node").alias("to"), F.col("to").alias("far")), [*keys, "to"]).select(*keys, "node", F.col("far").alias("to"))
        twice = materialize(twice, "jump")
        if twice.isEmpty():
            break
        jumps.append(twice)
    on = starts.select(*keys, "village_id", F.col("node_id").alias("node"))
    for jump in reversed(jumps):
        on = materialize(on.unionByName(on.join(jump, [*keys, "node"]).select(*keys, "village_id", F.col("to").alias("node"))), "steps")
    return on.join(tree, [*keys, "node"])


def routes_to_shelters(graph: DataFrame, solved: DataFrame, starts: DataFrame, edges: DataFrame, nodes: DataFrame,
                       shelters: DataFrame, keys: list[str]) -> DataFrame:
    """Shortest open route per start ``(keys, village_id, node_id)``: shelter, length in whole metres, line."""
    keys = list(keys)
    need = distinct_values(starts, *keys)  # scenarios are few, and their keys would deal links out to as few tasks
    asked = (F.col("mode") == "pessimistic") & F.array_contains(need, F.col(keys[0]) if len(keys) == 1 else F.struct(*keys))
    g = materialize(graph.filter(asked), "graph")
    s = solved.filter(asked)
    steps = route_steps(shortest_path_tree(g, s, keys), starts, keys)
    line = edges.filter(F.size("geom") > 0).select("edge_id", "u", "geom")
    here = nodes.select(F.col("node_id").alias("node"), F.col("x").cast("double").alias("_nx"), F.col("y").cast("double").alias("_ny"))
    ends = [distance(q["x"], q["y"], F.col("_nx"), F.col("_ny")) for q in (F.element_at("geom", 1), F.element_at("geom", -1))]
    onward = (ends[0] < ends[1]) | ((ends[0] == ends[1]) & (F.col("u") == F.col("node")))  # lines may be stored either way round
    part = steps.join(line, "edge_id").join(here, "node").withColumn("geom", F.when(onward, F.col("geom")).otherwise(F.reverse("geom")))
    lines = (part.groupBy(*keys, "village_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "geom"))).alias("p"))
             .select(*keys, "village_id", merge_lines(F.col("p.geom")).alias("geom")))
    here = starts.join(s.select(*keys, F.col("node").alias("node_id"), "dist", "src"), [*keys, "node_id"])
    spot = nodes.select("node_id", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_p"))
    named = shelters.filter("road_reachable").groupBy(F.col("node_id").alias("src")).agg(F.min(F.struct("shelter_id", "name")).alias("_s"))
    return (here.join(lines, [*keys, "village_id"], "left").join(spot, "node_id").join(named, "src")
            .select(*keys, "village_id", F.col("_s.shelter_id").alias("shelter_id"), F.col("_s.name").alias("shelter_name"),
                    F.rint(F.col("dist") / 1000).cast("bigint").alias("length_m"),
                    F.coalesce("geom", F.array("_p", "_p")).alias("geom")))


def exit_routes(graph: DataFrame, solved: DataFrame, summary: DataFrame, villages: DataFrame, edges: DataFrame,
                nodes: DataFrame, shelters: DataFrame, p: Params = Params()) -> DataFrame:
    """Routes at the main threshold on each village's own safe-exit date; one solve serves every date."""
    starts = (summary.filter(F.col("safe_exit_date").isNotNull()).select("village_id", F.col("safe_exit_date").alias("date"))
              .join(villages.select("village_id", "node_id"), "village_id")
              .withColumn("threshold", F.lit(float(p.main_threshold))))
    r = routes_to_shelters(graph, solved, starts, edges, nodes, shelters, ["threshold", "date"])
    return r.select("village_id", "date", "shelter_id", "shelter_name", "length_m", "geom")
