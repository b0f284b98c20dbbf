"""Iterative and spatial operators against brute force on small random inputs, crowded ones included."""
import heapq
import math
import random
from collections import defaultdict
from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodreach import Grid, Params
from floodreach.operators import clusters, common, focal, fuzzy, nearest, network, polygons, raster, zones

from .conftest import rows


def test_nearest_matches_brute_force(spark):
    rng = random.Random(1)
    pts = [(f"p{i:03d}", rng.uniform(-3000, 9000), rng.uniform(-3000, 9000)) for i in range(150)]
    pts += [(f"q{i:03d}", rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(50)]                     # crowded with their targets
    pts += [("limit", 5000.0 + 500.0, 5000.0), ("far", 90000.0, -70000.0)]
    tgt = [(f"t{i:03d}", rng.uniform(0, 6000), rng.uniform(0, 6000)) for i in range(80)]
    tgt += [(f"u{i:03d}", rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(300)] + [("w1", 7.0, 7.0), ("w0", 7.0, 7.0), ("c", 5000.0, 5000.0)]
    ddl = "id string, x double, y double"
    got = nearest.nearest(spark.createDataFrame(pts, "pid string, x double, y double"), spark.createDataFrame(tgt, ddl), "pid", "id", p=Params(knn_bucket_cap=16))
    best = {p: min((np.sqrt((x - a) * (x - a) + (y - b) * (y - b)), t) for t, a, b in tgt) for p, x, y in pts}
    assert {r.pid: (r.distance_m, r.target_id) for r in got.collect()} == best
    near = nearest.nearest(spark.createDataFrame(pts, "pid string, x double, y double"), spark.createDataFrame(tgt, ddl), "pid", "id", max_distance=500.0)
    assert {r.pid for r in near.collect() if r.target_id is None} == {p for p, (d, _) in best.items() if d > 500}


def test_nearest_among_an_outlier_and_a_crowded_square(spark):
    """Three thousand sites in one square kilometre and one far away: exact, and no leaf above the cap."""
    rng = random.Random(12)
    sites = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(3000)] + [(9999, 4e7, -3e7)]
    points = [(f"p{i}", rng.uniform(-200, 1200), rng.uniform(-200, 1200)) for i in range(300)] + [("far", 3e7, -3e7), ("mid", 2e5, 2e5)]
    targets = spark.createDataFrame(sites, "id bigint, x double, y double")
    got = {r.pid: r.target_id for r in nearest.nearest(spark.createDataFrame(points, "pid string, x double, y double"), targets, "pid", "id", p=Params(knn_bucket_cap=20)).collect()}
    assert got == {p: min(sites, key=lambda s: (math.hypot(s[1] - x, s[2] - y), s[0]))[0] for p, x, y in points}
    levels, leaves = nearest._tree(nearest._sites(targets, "id"), 20)
    assert leaves.count() == 3001 and leaves.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 20 and len(levels) > 3


def test_zones_follow_nearest_village(spark):
    v = spark.createDataFrame([("a", 100.0, 900.0), ("b", 800.0, 200.0)], "village_id string, x double, y double")
    grid = Grid(0, 1000, 10, 10, 100)
    pop = spark.createDataFrame([(r, c, -5.0 if r == c else float(r + 1)) for r in range(10) for c in range(10)], "row int, col int, pop double")
    got = {r.village_id: r.population for r in zones.zonal_population(pop, pop, v, grid).collect()}
    want = {"a": 0.0, "b": 0.0}
    for r in range(10):
        for c in range(10):
            x, y = 100 * c + 50, 1000 - (100 * r + 50)
            near = min(("a", "b"), key=lambda k: (np.hypot(x - {"a": 100, "b": 800}[k], y - {"a": 900, "b": 200}[k]), k))
            want[near] += 0 if r == c else r + 1
    assert got == {k: int(round(s)) for k, s in want.items()}


def _random_graph(seed, n=60, m=90):
    rng = random.Random(seed)
    es = []
    for i in range(m):
        u, v = rng.randrange(n), rng.randrange(n)
        es.append((f"e{i:03d}", u, v, rng.choice([0.0, 5.5, 10.0, 10.0, 37.25]), rng.uniform(0, 3000), rng.uniform(0, 3000)))
    return es


def _dijkstra(adj, sources):
    best, heap = {}, [(0, s, s) for s in sources]
    while heap:
        d, s, x = heapq.heappop(heap)
        if x in best and best[x] <= (d, s):
            continue
        best[x] = (d, s)
        for y, w in adj[x]:
            if y not in best or (d + w, s) < best[y]:
                heapq.heappush(heap, (d + w, s, y))
    return best


@pytest.mark.parametrize("cap", [12, 10_000])
def test_shortest_distances_match_heap_search(spark, cap):
    es = _random_graph(3)
    hub = [(f"h{i:03d}", 1000, i, 3.0 + i, 10.0, 10.0) for i in range(40)]      # one junction holding a third of the edges
    es += hub
    edges = spark.createDataFrame([(e, u, v, w, [(x, y), (x + 1, y)]) for e, u, v, w, x, y in es], "edge_id string, u bigint, v bigint, length_m double, geom array<struct<x:double,y:double>>")
    import datetime as dt
    days = [dt.date(2022, 6, 1), dt.date(2022, 6, 2)]
    rng = random.Random(9)
    state = {(d, e[0]): rng.choice(["open", "open", "open", "cut", "unknown"]) for d in days for e in es}
    rs = spark.createDataFrame([(0.2, d, e, s) for (d, e), s in state.items()], "threshold double, date date, edge_id string, status string")
    v = spark.createDataFrame([("v", 0, False)], "village_id string, node_id bigint, boat_dependent boolean")
    sh = spark.createDataFrame([("s1", 5, True), ("s2", 17, True), ("s0", 17, True), ("s3", 33, False), ("s4", 5555, True)], "shelter_id string, node_id bigint, road_reachable boolean")
    graph, solved = network.solve(edges, rs, v, sh, Params(block_cap=cap))
    got = {(r.date, r.mode, r.node): (r.dist, r.src) for r in solved.collect()}
    want = {}
    for d in days:
        for mode in ("pessimistic", "optimistic"):
            adj = defaultdict(list)
            for e, a, b, w, *_ in es:
                if a != b and (state[d, e] == "open" or (mode == "optimistic" and state[d, e] != "cut")):
                    mm = max(1, round(w * 1000))
                    adj[a].append((b, mm))
                    adj[b].append((a, mm))
            known = {x for e in es for x in (e[1], e[2])}
            want |= {(d, mode, x): b for x, b in _dijkstra(adj, [s for s in (5, 17) if s in known]).items()}
    assert got == want
    # pessimistic reach is contained in optimistic reach
    reach = {m: {(d, x) for (d, mm, x) in got if mm == m} for m in ("pessimistic", "optimistic")}
    assert reach["pessimistic"] <= reach["optimistic"]
    # every route follows real edges and adds up to the distance
    g = graph.filter("mode = 'pessimistic'")
    tree = network.shortest_path_tree(g, solved.filter("mode = 'pessimistic'"), ["threshold", "date"])
    starts = solved.filter("mode = 'pessimistic' and dist > 0").select("threshold", "date", F.col("node").cast("string").alias("village_id"), F.col("node").alias("node_id"))
    steps = network.route_steps(tree, starts, ["threshold", "date"]).join(g.select("threshold", "date", "edge_id", "w"), ["threshold", "date", "edge_id"])
    total = {(r.date, int(r.village_id)): r.s for r in steps.groupBy("date", "village_id").agg(F.sum("w").alias("s")).collect()}
    assert total == {(d, x): dist for (d, m, x), (dist, _) in got.items() if m == "pessimistic" and dist > 0}


def test_blocks_are_bounded(spark):
    rng = random.Random(2)
    pts = [(f"e{i}", [(rng.uniform(0, 10), 0.0)]) for i in range(500)] + [(f"f{i}", [(rng.uniform(0, 9e5), rng.uniform(0, 9e5))]) for i in range(300)]
    b = network.assign_blocks(spark.createDataFrame(pts, "edge_id string, geom array<struct<x:double,y:double>>"), Params(block_cap=50))
    assert b.count() == 800 and b.groupBy("block").count().agg(F.max("count")).first()[0] <= 90


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [("k1", rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [("k2", i, i + 1) for i in range(120)] + [("k3", 0, i) for i in range(1, 90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for k, a, b in pairs:
        if a != b:
            ra, rb = sorted((find((k, a)), find((k, b))))
            parent[rb] = ra
    df = spark.createDataFrame(pairs, "k string, u bigint, v bigint").repartition(7)
    got = {(r.k, r.node): r.component for r in network.components(df, ["k"]).collect()}
    assert got == {x: find(x)[1] for x in parent}


def _dbscan(pts, eps, m):
    ids = list(pts)
    near = {p: [q for q in ids if (pts[p][0] - pts[q][0]) ** 2 + (pts[p][1] - pts[q][1]) ** 2 <= eps * eps] for p in ids}
    core = {p for p in ids if len(near[p]) >= m}
    label = {}
    for p in sorted(core):
        if p not in label:
            stack = [p]
            while stack:
                q = stack.pop()
                if q not in label:
                    label[q] = p
                    stack += [r for r in near[q] if r in core and r not in label]
    for p in ids:
        if p not in core:
            c = [((pts[p][0] - pts[q][0]) ** 2 + (pts[p][1] - pts[q][1]) ** 2, q) for q in near[p] if q in core]
            label[p] = label[min(c)[1]] if c else None
    return label


def test_density_clusters_match_brute_force(spark):
    rng = random.Random(7)
    raw = [(rng.gauss(0, 25), rng.gauss(0, 25)) for _ in range(150)] + [(rng.gauss(130, 30), rng.gauss(20, 30)) for _ in range(60)]
    raw += [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(80)] + [(300.0, 300.0)] * 12 + [(300.0 + 60.0, 300.0)]
    raw += [(42.0 + i * 0.01, 400.0) for i in range(60)] + [(102.3 + i * 0.01, 400.0) for i in range(60)]        # two crowded cells 0.3 short of / within reach
    pts = {i: p for i, p in enumerate(raw)}
    got = clusters.density_clusters(spark.createDataFrame([(i, *p) for i, p in pts.items()], "point_id bigint, x double, y double"))
    assert {r.point_id: r.cluster for r in got.collect()} == _dbscan(pts, 60.0, 10)


def test_settlement_names(spark):
    pts = spark.createDataFrame([(i, 10.0 * (i % 3), 0.0) for i in range(12)] + [(100 + i, 9000.0, 9000.0) for i in range(10)], "point_id bigint, x double, y double")
    v = spark.createDataFrame([("v1", "Dholposhi", "ধল", 500.0, 0.0)], "village_id string, name string, name_bn string, x double, y double")
    got = {r.village_id: (r.name, r.name_bn, r.n_buildings) for r in clusters.settlements(clusters.density_clusters(pts), v).collect()}
    assert got == {"ob00001": ("Dholposhi", "ধল", 12), "ob00002": ("Settlement 2", None, 10)}


@pytest.mark.parametrize("cutoff", [0.6, 0.75])
def test_best_match_equals_library_search(spark, cutoff):
    rng = random.Random(11)
    names = sorted({"".join(rng.choice("abcdehr") for _ in range(rng.randrange(3, 12))) for _ in range(120)} | {"axbxc", "sunamganj sadar", "chhatak", "dowarabazar"})
    queries = sorted({"abc", "sunamganj", "chatak", "doarabazar", "zzz", "", *names[:15], *[n[:3] + n[4:] for n in names[20:50]], *["".join(rng.sample(n, len(n))) for n in names[50:80]]})
    got = {r.query: (r["match"], r.score) for r in fuzzy.best_match(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame([(n,) for n in names], "cand string"), cutoff).collect()}
    for q in queries:
        best = get_close_matches(q, names, n=1, cutoff=cutoff)
        assert got.get(q) == ((best[0], SequenceMatcher(None, q, best[0]).ratio()) if best else None), q


def _grid_cells(spark, a, days=1):
    import datetime as dt
    return spark.createDataFrame([(dt.date(2022, 6, 1), r, c, int(v)) for (r, c), v in np.ndenumerate(a) if v != 255], "date date, row int, col int, value int")


def test_focal_and_edges_match_arrays(spark):
    rng = np.random.default_rng(4)
    a = rng.choice([0, 1, 255], size=(32, 32))
    cells = _grid_cells(spark, a)
    f, d = a == 1, a == 0
    nb = np.zeros_like(d)
    nb[1:] |= d[:-1]; nb[:-1] |= d[1:]; nb[:, 1:] |= d[:, :-1]; nb[:, :-1] |= d[:, 1:]
    assert rows(focal.flood_edge(cells, p=Params(tile_px=8)), "row", "col") == sorted(((int(r), int(c)) for r, c in np.argwhere(f & nb)), key=repr)
    got = {(r.row, r.col): r.value for r in focal.focal_median(cells.withColumn("value", F.col("value").cast("double")), Grid(0, 0, 32, 32, 20.0), 30.0, p=Params(tile_px=8)).collect()}
    for r in range(32):
        for c in range(32):
            if a[r, c] != 255:
                w = a[max(0, r - 1):r + 2, max(0, c - 1):c + 2]
                assert got[r, c] == np.median(w[w != 255])
    assert len(got) == (a != 255).sum()


def test_overview_counts_unknown(spark):
    a = np.full((8, 8), 255)
    a[:4, :4] = [[1, 1, 0, 0]] * 4
    a[4:, 4:] = 1
    got = {(r.orow, r.ocol): r.value for r in focal.overview(_grid_cells(spark, a), Grid(0, 0, 8, 8, 1.0), 2).collect()}
    assert got == {(0, 0): 0, (1, 1): 1}


def test_overview_of_a_long_grid_keeps_a_column(spark):
    a = np.full((64, 3), 255)
    a[:20] = 1
    got = {(r.orow, r.ocol): r.value for r in focal.overview(_grid_cells(spark, a), Grid(0, 0, 3, 64, 1.0), 16).collect()}
    assert got == {(i, 0): 1 for i in range(5)}


def test_merge_fills_only_unknown(spark):
    rng = np.random.default_rng(8)
    import datetime as dt
    names = Params().source_priority
    arrs = [rng.choice([0, 1, 255], size=(16, 16)) for _ in names]
    rowsin = [(dt.date(2022, 6, 1), s, r, c, int(v)) for s, a in zip(names, arrs) for (r, c), v in np.ndenumerate(a)]
    merged = np.full((16, 16), 255)
    for a in arrs:
        m = (merged == 255) & (a != 255)
        merged[m] = a[m]
    cells = spark.createDataFrame(rowsin, "date date, source string, row int, col int, value int")
    got = np.full((16, 16), 255)
    for r in raster.merge_by_date(cells.unionAll(cells)).collect():
        got[r.row, r.col] = r.value
    assert (got == merged).all()
    s = raster.coverage(raster.merge_by_date(cells), Grid(0, 0, 16, 16), spark.createDataFrame([(dt.date(2022, 6, 2),)], "date date")).orderBy("date").collect()
    assert abs(s[0].flooded_pct + s[0].dry_pct + s[0].unknown_pct - 100) <= 0.02 and s[0].sources.startswith("sentinel1+unosat")
    assert (s[1].sources, s[1].unknown_pct) == ("", 100.0)


def test_exact_median(spark):
    rng = random.Random(6)
    data = {"a": [rng.gauss(5, 2) for _ in range(201)], "b": [rng.choice([1.0, 2.0, 7.5]) for _ in range(100)], "c": [0.2, 9.7]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k string, v double")
    got = {r.k: r["median"] for r in common.exact_median(df, ["k"], "v", 1.0).collect()}
    assert got == {k: pytest.approx(float(np.median(xs)), abs=1e-12) for k, xs in data.items()}


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int").repartition(5)
    assert all(r.rank == r.v + 1 for r in common.global_rank(df, [F.col("v").asc()]).collect())


def test_burn_and_resample(spark):
    tri = spark.createDataFrame([(1, [[(12.0, 12.0), (88.0, 12.0), (50.0, 91.0)]])], "polygon_id int, rings array<array<struct<x:double,y:double>>>")
    got = set(rows(polygons.burn(tri, Grid(0, 100, 10, 10, 10)), "row", "col"))

    def inside(x, y):
        p = [(12, 12), (88, 12), (50, 91)]
        return sum((y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1])) % 2 == 1
    assert got == {(r, c) for r in range(10) for c in range(10) if inside(10 * c + 5, 100 - (10 * r + 5))}
    src = spark.createDataFrame([("d", r, c, (r + c) % 2) for r in range(4) for c in range(4)], "date string, row int, col int, value int")
    out = {(r.row, r.col): r.value for r in polygons.resample_nearest(src, Grid(10, 90, 4, 4, 20), Grid(0, 100, 10, 10, 10)).collect()}
    want = {}
    for r in range(10):
        for c in range(10):
            sc, sr = int(np.floor((10 * c + 5 - 10) / 20)), int(np.floor((90 - (100 - (10 * r + 5))) / 20))
            if 0 <= sc < 4 and 0 <= sr < 4:
                want[r, c] = (sr + sc) % 2
    assert out == want


def test_resample_from_lonlat(spark):
    src = spark.createDataFrame([("d", r, c, (r + c) % 2) for r in range(6) for c in range(6)], "date string, row int, col int, value int")
    sg, g = Grid(91.0, 25.06, 6, 6, 0.01), Grid(298000.0, 2773000.0, 14, 12, 500.0)
    got = {(r.row, r.col): r.value for r in polygons.resample_from_lonlat(src, sg, g).collect()}
    from floodreach.functions.geometry import to_lonlat
    centres = spark.createDataFrame([(r, c, 298000.0 + 500 * (c + 0.5), 2773000.0 - 500 * (r + 0.5)) for r in range(12) for c in range(14)], "row int, col int, x double, y double")
    lon, lat = to_lonlat(F.col("x"), F.col("y"))
    want = {}
    for r in centres.withColumn("lon", lon).withColumn("lat", lat).collect():
        sc, sr = int(np.floor((r.lon - 91.0) / 0.01)), int(np.floor((25.06 - r.lat) / 0.01))
        if 0 <= sc < 6 and 0 <= sr < 6:
            want[r.row, r.col] = (sr + sc) % 2
    assert got == want and 0 < len(got) < 168


def test_long_routes_stay_linear(spark):
    """A 70-junction chain: many doublings, every step kept."""
    import datetime as dt
    day = dt.date(2022, 6, 1)
    edges = spark.createDataFrame([(f"e{i:03d}", i, i + 1, 10.0, [(10.0 * i, 0.0), (10.0 * i + 10, 0.0)]) for i in range(70)], "edge_id string, u bigint, v bigint, length_m double, geom array<struct<x:double,y:double>>")
    nodes = spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(71)], "node_id bigint, x double, y double")
    rs = spark.createDataFrame([(0.2, day, f"e{i:03d}", "open") for i in range(70)], "threshold double, date date, edge_id string, status string")
    v = spark.createDataFrame([("v", 0, False)], "village_id string, node_id bigint, boat_dependent boolean")
    sh = spark.createDataFrame([("s", "S", 70, True)], "shelter_id string, name string, node_id bigint, road_reachable boolean")
    graph, solved = network.solve(edges, rs, v, sh, Params(block_cap=40))
    starts = v.select("village_id", "node_id", F.lit(0.2).alias("threshold"), F.lit(day).alias("date"))
    r = network.routes_to_shelters(graph, solved, starts, edges, nodes, sh, ["threshold", "date"]).first()
    assert r.length_m == 700 and [p.x for p in r.geom] == [10.0 * i for i in range(71)]


def test_split_by_hash_is_exact(spark):
    from floodreach.operators.evaluate import split_by_hash
    df = spark.createDataFrame([(i, i % 3) for i in range(301)], "id bigint, label int")
    s = split_by_hash(df, "id", 0.2, 1, by="label")
    got = {r.label: (r.n, r.v) for r in s.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "validation").alias("v")).collect()}
    assert got == {0: (101, 21), 1: (100, 20), 2: (100, 20)}


def test_points_within_lays_edges_out_like_brute_force(spark):
    """Steep, level, upright and slanted edges of several tile sizes; every pair within reach is found once."""
    rng = np.random.default_rng(12)
    rings = [[(float(x), float(y)) for x, y in rng.integers(-900, 900, (3, 2))] for _ in range(12)] + [[(0.0, 0.0), (0.0, 700.0), (400.0, 700.0), (400.0, 0.0)]]
    polys = spark.createDataFrame([(i, [[{"x": x, "y": y} for x, y in r]]) for i, r in enumerate(rings)], "polygon_id int, rings array<array<struct<x:double,y:double>>>")
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1100, 1100, (400, 2)))]
    got = sorted(tuple(r) for r in polygons.points_within(spark.createDataFrame(pts, "node_id int, x double, y double"), polys, "node_id", 60.0).select("node_id", "polygon_id").collect())
    want = []
    for i, px, py in pts:
        for k, r in enumerate(rings):
            ends, inside, near = list(zip(r, r[1:] + r[:1])), False, np.inf
            for (x0, y0), (x1, y1) in ends:
                inside ^= (y0 > py) != (y1 > py) and px < x0 + (py - y0) / (y1 - y0) * (x1 - x0)
                l2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
                t = 0.0 if l2 == 0 else min(1.0, max(0.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / l2))
                near = min(near, np.hypot(px - x0 - t * (x1 - x0), py - y0 - t * (y1 - y0)))
            want += [(i, k)] if inside or near <= 60.0 else []
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["points_in_polygon", "buffered_area", "road_density", "village_at_click"])
def test_nothing_is_broadcast_by_an_estimate(spark, name):
    import __spark_entry__ as entry
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {c: spark.conf.get(c, None) for c in names}
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
        entry.queries()["op10_url_filter"](spark, "/root/testdata/sf0.001")
        assert {c: spark.conf.get(c, None) for c in names} == before
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_paths_combine_by_hash_and_refuse_overflow(spark):
    """Distance and source are one integer: no round sorts, ties go to the smaller source, and what passes 64 bits is an error."""
    ddl = "k int, block string, u long, v long, w long"
    edges = [(0, "a", 1, 2, 5), (0, "a", 2, 3, 5), (0, "b", 3, 4, 1), (0, "b", 4, 5, 9), (1, "a", 1, 2, 7)]
    src = spark.createDataFrame([(0, 1), (0, 3), (1, 1)], "k int, node long")
    d = network.shortest_distances(spark.createDataFrame(edges, ddl), src, ["k"])
    assert rows(d, "k", "node", "dist", "src") == [(0, 1, 0, 1), (0, 2, 5, 1), (0, 3, 0, 3), (0, 4, 1, 3), (0, 5, 10, 3), (1, 1, 0, 1), (1, 2, 7, 1)]
    assert "SortAggregate" not in d._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="too long"):
        network.shortest_distances(spark.createDataFrame([(0, "a", 1, 2, 1 << 61), (0, "a", 2, 3, 1 << 61)], ddl), src.filter("k = 0 and node = 1"), ["k"]).collect()
