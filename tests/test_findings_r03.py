"""One test per step that the findings of round 3 made change."""
import datetime as dt
import difflib
import glob
import heapq
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from floodreach import Grid, Params
from floodreach.functions.simplify import simplify
from floodreach.operators import clusters, common, fuzzy, nearest, network, patches, polygons, zones
from floodreach.session import shared_dir

from .conftest import rows
from .test_algorithms import _dbscan


def test_roads_travel_once_for_all_scenarios(spark):
    """70 dates (two words of bits), blocks of 15 roads: distances equal a heap search, links equal the dense table's, and no table of roads times scenarios is written."""
    rng, days = random.Random(4), [dt.date(2022, 1, 1) + dt.timedelta(i) for i in range(70)]
    es = [(f"e{i:02d}", rng.randrange(30), rng.randrange(30), float(rng.choice([1, 5, 5, 9])), [(rng.uniform(0, 3000), rng.uniform(0, 3000))] * 2) for i in range(60)]
    edges = spark.createDataFrame(es, "edge_id string, u bigint, v bigint, length_m double, geom array<struct<x:double,y:double>>")
    state = {(d, e[0]): s for d in days for e in es if (s := rng.choice(["open", "open", "cut", "unknown", None]))}  # None: no row
    rs = spark.createDataFrame([(0.2, d, e, s) for (d, e), s in state.items()], "threshold double, date date, edge_id string, status string")
    sh = spark.createDataFrame([("s1", 5, True), ("s2", 17, True)], "shelter_id string, node_id bigint, road_reachable boolean")
    before = set(glob.glob(f"{shared_dir(spark)}/*/*"))
    graph, solved = network.solve(edges, rs, None, sh, Params(block_cap=15))
    got = {(r.date, r.mode, r.node): (r.dist, r.src) for r in solved.collect()}
    want = {}
    for d in days:
        for mode in network.MODES:
            adj = defaultdict(list)
            for e, a, b, w, _ in es:
                if state.get((d, e)) == "open" or (mode == "optimistic" and state.get((d, e)) != "cut"):
                    adj[a].append((b, int(w * 1000)))
                    adj[b].append((a, int(w * 1000)))
            best, heap = {}, [(0, s, s) for s in (5, 17) if any(s in e[1:3] for e in es)]
            while heap:
                dist, s, x = heapq.heappop(heap)
                if x not in best:
                    best[x] = (dist, s)
                    for y, w in adj[x]:
                        heapq.heappush(heap, (dist + w, s, y))
            want |= {(d, mode, x): b for x, b in best.items()}
    assert got == want
    axis = common.distinct_values(rs, "threshold", "date")
    dense = network.usable_links(edges, network.full_status(edges, rs, axis))
    cols = ("threshold", "date", "mode", "u", "v", "edge_id", "w")
    assert rows(graph, *cols) == rows(dense, *cols)
    written = set(glob.glob(f"{shared_dir(spark)}/*/*")) - before
    assert not any("/scenarios-" in p for p in written)
    assert [spark.read.parquet(p).count() for p in written if "/roads-" in p] == [len(es)]


def test_no_task_sums_roads_times_dates_before_they_are_dealt_out(spark):
    """Rows of an edge meet by a shuffle first; a sum over a whole input partition would hold every edge on every date."""
    import __spark_entry__ as entry
    df = entry.queries()["road_status"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(edge_id#\d+, \d+\), REPARTITION_BY_COL", plan) and not re.search(r"Exchange hashpartitioning\(date#\d+, edge_id", plan)


def test_lines_are_simplified_without_an_object_per_vertex(spark):
    peak = [{"x": float(i), "y": 9.0 if i == 2 else 0.0} for i in range(5)]
    df = spark.createDataFrame([(1, peak), (2, peak[:2]), (3, []), (4, None)], "id int, geom array<struct<x:double,y:double>>").select("id", simplify(F.col("geom"), 1.0).alias("g"))
    got = {r.id: r.g and [(q.x, q.y) for q in r.g] for r in df.collect()}
    assert got == {1: [(0.0, 0.0), (2.0, 9.0), (4.0, 0.0)], 2: [(0.0, 0.0), (1.0, 0.0)], 3: [], 4: None}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"run\(transform\(geom", plan), plan
    import __spark_entry__ as entry
    assert entry.queries()["simplified_lines"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_patches_are_built_many_at_a_time(spark):
    cells = spark.createDataFrame([(dt.date(2022, 6, 1), r, c, float(r * 100 + c)) for r in range(150) for c in (0, 3, 9, 15)], "date date, row int, col int, h0 double").withColumn("target", F.lit(1))
    df = patches.patches(cells, Grid(0.0, 0.0, 16, 150, 1.0), 8, ["h0"])
    got = {(r.prow, r.pcol): r for r in df.collect()}
    assert sorted(got) == [(r, c) for r in sorted({min(s, 142) for s in range(0, 150, 4)}) for c in (0, 4, 8)]
    for (r0, c0), p in got.items():
        assert p.sample_id == f"20220601_{r0}_{c0}" and p.h0 == [(r0 + i // 8) * 100 + c0 + i % 8 if c0 + i % 8 in (0, 3, 9, 15) else 255 for i in range(64)]
    assert re.search(r"FlatMapGroupsIn\w+ \[date#\d+, _brow", df._jdf.queryExecution().executedPlan().toString())


def test_polygon_queries_broadcast_no_estimate_and_spread_areas(spark):
    import __spark_entry__ as entry
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {c: spark.conf.get(c, None) for c in names}
    try:
        plan = {n: entry.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("buffered_area_near", "road_density")}
        assert all("BroadcastExchange" not in p for p in plan.values()) and "REPARTITION_BY_NUM" in plan["road_density"]
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def _most_shuffled(spark, run):
    """What ``run`` returns, and the most rows that one of its stages has written for a shuffle."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}
    before = stages()
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return out, max(n for k, n in stages().items() if k not in before)


def test_points_do_not_travel_with_every_cell_or_site(spark):
    """800 points among 4000 sites: before, a point was shuffled with each child of the cells it descends to."""
    rng = random.Random(20)
    sites = [(i, rng.uniform(0, 300), rng.uniform(0, 30000)) for i in range(4000)]
    points = [(i, rng.uniform(0, 300), rng.uniform(0, 30000)) for i in range(800)]
    s = spark.createDataFrame(sites, "id bigint, x double, y double")
    q = spark.createDataFrame(points, "pid bigint, x double, y double")
    got, most = _most_shuffled(spark, lambda: nearest.nearest(q, s, "pid", "id", p=Params(knn_bucket_cap=20), bucket=3000.0).collect())
    assert {r.pid: r.target_id for r in got} == {p: min(sites, key=lambda t: (math.hypot(t[1] - x, t[2] - y), t[0]))[0] for p, x, y in points}
    assert most <= 9 * len(sites)  # the sites laid out in their neighbourhoods; before 51,200 and more


def test_cells_under_many_polygons_travel_as_bits(spark):
    """Squares of 70 columns over each other: the cells of all, each once, from two or three rows a span."""
    def square(x, y, size):
        return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size)]]
    shapes = [(i, square(13.0 * i, 7.0 * i, 700.0)) for i in range(40)] + [(99, square(-50.0, 900.0, 95.0)), (100, square(315.0, 1180.0, 10.0))]
    polys = spark.createDataFrame(shapes, "polygon_id bigint, rings array<array<struct<x:double,y:double>>>")
    grid = Grid(0.0, 1200.0, 130, 120, 10.0)
    want = sorted({(r.row, r.col) for r in polygons.burn(polys, grid).collect()})
    got, most = _most_shuffled(spark, lambda: rows(polygons.burn_any(polys, grid), "row", "col"))
    assert sorted(got) == want and most < 3 * polygons.row_spans(polys, grid).count() < polygons.burn(polys, grid).count() / 10
    v = spark.createDataFrame([("a", 100.0, 100.0), ("b", 900.0, 800.0)], "village_id string, x double, y double")
    pop = spark.createDataFrame([(r, c, 1.0) for r in range(120) for c in range(130)] + [(5, 5, None)], "row int, col int, pop double")
    once, often = (zones.zonal_population(pop, a, v, grid).agg(F.sum("population")).first()[0] for a in (polygons.burn_any(polys, grid), polygons.burn(polys, grid)))
    assert once == often == len(want)


def test_points_travel_to_few_tiles_for_their_neighbours(spark):
    """Before, a point of a thin cell was shuffled 21 times, once for each cell around it."""
    rng = random.Random(24)
    pts = [(i, rng.uniform(-2000, 2000), rng.uniform(-2000, 2000)) for i in range(3000)] + [(3000 + i, 240.0 * (i % 5) - 480.0, 240.0 * (i // 5)) for i in range(25)]
    got, most = _most_shuffled(spark, lambda: clusters.density_clusters(spark.createDataFrame(pts, "point_id bigint, x double, y double"), min_points=7).collect())
    assert {r.point_id: r.cluster for r in got} == _dbscan({i: (x, y) for i, x, y in pts}, 60.0, 7)
    assert len({r.cluster for r in got}) > 5 and most < 3 * len(pts)


def test_near_names_are_compared_without_their_letters(spark):
    """Pairs met by a deletion carry names alone; before, the arrays of their letters went through the join and its distinct."""
    names = ["Rampur", "Rampura", "Ranpur", "Sonapur", "Shonapur", "ab", "b", "aa", ""]
    pairs = [(a, b) for a in names for b in names if a != b]
    got = {r.query: (r.cand, r.s) for r in fuzzy._score(spark.createDataFrame(pairs, "query string, cand string"), 0.6).collect()}
    want = {}
    for a, b in pairs:
        s = difflib.SequenceMatcher(None, b, a).ratio()
        if s >= 0.6:
            want[a] = max(want.get(a, (0.0, "")), (s, b))
    assert got == {a: (b, s) for a, (s, b) in want.items()}
