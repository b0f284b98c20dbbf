"""Access over a small ring road with a spur, road states, check-points, timelines, and dates of which nothing is known.

Junctions 1 to 6 form a rectangle of 5 km around; 7 hangs off 4. The shelter is at 1; lines are stored in mixed directions."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.views import Views
from floodreach import Grid, Params
from floodreach.functions.classify import road_state
from floodreach.operators import nearest, network, patches, raster, roads, timeline
from floodreach.plans import engine

MON, THU = dt.date(2023, 8, 14), dt.date(2023, 8, 17)
SPOTS = {1: (0.0, 0.0), 2: (800.0, 0.0), 3: (1600.0, 0.0), 4: (1600.0, 900.0), 5: (800.0, 900.0), 6: (0.0, 900.0), 7: (2100.0, 900.0)}
ROADS = [("r12", 1, 2, False), ("r23", 2, 3, True), ("r34", 3, 4, False), ("r54", 5, 4, True), ("r56", 5, 6, False), ("r61", 6, 1, True), ("r47", 4, 7, True)]
LINE = "array<struct<x:double,y:double>>"


def _length(u, v):
    return abs(SPOTS[u][0] - SPOTS[v][0]) + abs(SPOTS[u][1] - SPOTS[v][1])


@pytest.fixture(scope="module")
def town(spark):
    nodes = spark.createDataFrame([(k, *at) for k, at in SPOTS.items()], "node_id bigint, x double, y double")
    edges = spark.createDataFrame([(e, u, v, _length(u, v), [SPOTS[v], SPOTS[u]] if turned else [SPOTS[u], SPOTS[v]]) for e, u, v, turned in ROADS],
                                  f"edge_id string, u bigint, v bigint, length_m double, geom {LINE}")
    places = spark.createDataFrame([("mill", "Mill", "কল", 40, 790.0, 930.0), ("quay", "Quay", None, 900, 2130.0, 880.0), ("isle", "Isle", None, 7, 800.0, 3100.0)],
                                   "village_id string, name string, name_bn string, population bigint, x double, y double")
    halls = spark.createDataFrame([("hall", "Town hall", 0.0, -15.0), ("tent", "Tent", 900.0, 9000.0)], "shelter_id string, name string, x double, y double")
    return nodes, edges, places, nearest.snap_villages(places, nodes), nearest.snap_shelters(halls, nodes)


def _solved(spark, town, odd, day=MON):
    _, edges, _, v, s = town
    rs = spark.createDataFrame([(0.2, day, e, odd.get(e, "open")) for e, *_ in ROADS if odd.get(e) != "absent"], "threshold double, date date, edge_id string, status string")
    graph, solved = network.solve(edges, rs, v, s)
    return graph, solved, {r.village_id: r for r in network.village_status(solved, rs, v, s).collect()}


def test_snapping_limits(town):
    *_, v, s = town
    assert {r.village_id: (r.node_id, r.boat_dependent) for r in v.collect()} == {"mill": (5, False), "quay": (7, False), "isle": (5, True)}
    assert {r.shelter_id: (r.node_id, r.road_reachable) for r in s.collect()} == {"hall": (1, True), "tent": (5, False)}


@pytest.mark.parametrize("odd, mill, quay", [
    ({}, ("connected", 1700.0), ("connected", 3000.0)),
    ({"r61": "cut"}, ("connected", 3300.0), ("connected", 3000.0)),
    ({"r61": "cut", "r12": "cut"}, ("isolated", None), ("isolated", None)),
    ({"r61": "unknown", "r12": "cut"}, ("uncertain", None), ("uncertain", None)),
    ({"r47": "absent"}, ("connected", 1700.0), ("uncertain", None)),
    ({"r34": "cut", "r54": "unknown"}, ("connected", 1700.0), ("uncertain", None)),
])
def test_village_states(spark, town, odd, mill, quay):
    _, _, got = _solved(spark, town, odd)
    assert (got["mill"].status, got["mill"].dist_to_shelter_m) == mill and (got["quay"].status, got["quay"].dist_to_shelter_m) == quay
    assert got["isle"].status == "boat_dependent"
    assert all((r.nearest_shelter_id == "hall") == (r.dist_to_shelter_m is not None) for r in got.values())


def test_routes_run_from_village_to_shelter_whichever_way_lines_are_stored(spark, town):
    nodes, edges, _, v, s = town
    starts = v.filter("not boat_dependent").select("village_id", "node_id", F.lit(0.2).alias("threshold"), F.lit(MON).alias("date"))
    for odd, want in (({}, {"mill": [5, 6, 1], "quay": [7, 4, 3, 2, 1]}), ({"r61": "cut"}, {"mill": [5, 4, 3, 2, 1], "quay": [7, 4, 3, 2, 1]}), ({"r47": "cut"}, {"mill": [5, 6, 1]})):
        graph, solved, _ = _solved(spark, town, odd)
        got = {r.village_id: r for r in network.routes_to_shelters(graph, solved, starts, edges, nodes, s, ["threshold", "date"]).collect()}
        assert {k: [(q.x, q.y) for q in r.geom] for k, r in got.items()} == {k: [SPOTS[n] for n in way] for k, way in want.items()}
        assert all(r.length_m == sum(map(_length, way, way[1:])) for r, way in ((got[k], want[k]) for k in want))


def test_shelter_at_the_doorstep(spark, town):
    nodes, edges, places, _, s = town
    v = nearest.snap_villages(places.filter("village_id = 'mill'").withColumn("y", F.lit(5.0)).withColumn("x", F.lit(3.0)), nodes)
    graph, solved, got = _solved(spark, (nodes, edges, places, v, s), {e: "cut" for e, *_ in ROADS})
    assert (got["mill"].status, got["mill"].dist_to_shelter_m) == ("connected", 0.0)
    starts = v.select("village_id", "node_id", F.lit(0.2).alias("threshold"), F.lit(MON).alias("date"))
    r = network.routes_to_shelters(graph, solved, starts, edges, nodes, s, ["threshold", "date"]).first()
    assert r.length_m == 0 and [(q.x, q.y) for q in r.geom] == [SPOTS[1]] * 2


def test_edges_without_geometry_stay_in_the_graph(spark, town):
    nodes, edges, places, v, s = town
    bare = edges.withColumn("geom", F.when(F.col("edge_id") != "r56", F.col("geom")))
    _, _, got = _solved(spark, (nodes, bare, places, v, s), {"r54": "cut"})
    assert got["mill"].dist_to_shelter_m == 1700.0


def test_rounds_end_only_when_nothing_improves(spark):
    """A chain cut into hash blocks of three links: far more exchanges than any compaction interval."""
    n = 90
    links = spark.createDataFrame([(0, f"b{i // 3}", i, i + 1, 10) for i in range(n)], "scenario int, block string, u bigint, v bigint, w bigint")
    src = spark.createDataFrame([(0, 0), (0, n)], "scenario int, node bigint")
    got = {r.node: (r.dist, r.src) for r in network.shortest_distances(links, src, ["scenario"], compact_every=3).collect()}
    assert got == {i: (10 * min(i, n - i), 0 if i <= n - i else n) for i in range(n + 1)}


@pytest.mark.parametrize("flooded, unknown, state", [(0.21, 0.0, "cut"), (0.2, 0.5, "open"), (0.2, 0.51, "unknown"), (0.6, 0.4, "cut"), (0.0, 1.0, "unknown"), (0.0, 0.0, "open")])
def test_road_state_rule(spark, flooded, unknown, state):
    assert spark.range(1).select(road_state(F.lit(flooded), F.lit(unknown), F.lit(0.2), F.lit(0.5))).first()[0] == state


def test_check_points_meet_cells(spark):
    grid = Grid(100, 340, 6, 4, 40)  # x from 100 to 340, y from 180 to 340
    wet = spark.createDataFrame([(MON, 1, c, int(c in (2, 3)), 0) for c in range(5)], "date date, row int, col int, value int, source_rank int")
    edges = spark.createDataFrame([("along", [(110.0, 280.0), (330.0, 280.0)]), ("out", [(330.0, 280.0), (430.0, 280.0)])], f"edge_id string, geom {LINE}")
    points = {(r.edge_id, r.k): r.x for r in roads.check_points(edges, 25.0).collect()}
    assert [points["along", k] for k in range(10)] == pytest.approx([110 + 220 * k / 9 for k in range(10)]) and ("along", 10) not in points
    got = {(r.date, r.edge_id): (r.frac_flooded, r.frac_unknown) for r in roads.edge_fractions(edges, wet, grid, 25.0, spark.createDataFrame([(MON,), (THU,)], "date date")).collect()}
    assert got[MON, "along"] == pytest.approx((0.4, 0.2)) and got[MON, "out"] == (0.0, 1.0)
    assert got[THU, "along"] == got[THU, "out"] == (0.0, 1.0)


def test_check_points_of_bent_and_empty_lines(spark):
    edges = spark.createDataFrame([("hook", [(0.0, 0.0), (0.0, 45.0), (0.0, 45.0), (15.0, 45.0)]), ("dot", [(3.0, 4.0), (3.0, 4.0)])], f"edge_id string, geom {LINE}")
    got = {}
    for r in roads.check_points(edges, 20).orderBy("edge_id", "k").collect():
        got.setdefault(r.edge_id, []).append((r.k, round(r.x, 6), round(r.y, 6)))
    assert got == {"hook": [(0, 0, 0), (1, 0, 20), (2, 0, 40), (3, 15, 45)], "dot": [(0, 3, 4), (1, 3, 4)]}


def _timelines(spark, days, words):
    name = {"c": "connected", "i": "isolated", "u": "uncertain", "b": "boat_dependent"}
    return spark.createDataFrame([(v, days[k], name[x]) for v, s in words.items() for k, x in enumerate(s)], "village_id string, date date, status string")


def test_timeline_dates_and_ranks(spark):
    days = [dt.date(2023, 8, k) for k in (1, 5, 6, 20)]
    status = _timelines(spark, days, {"ferry": "cciu", "ghat": "iicc", "haor": "ccci", "kanda": "cucc", "nala": "biic", "pur": "ciui"})
    people = spark.createDataFrame([("ferry", "F", 5), ("ghat", "G", 1), ("haor", "H", None), ("kanda", "K", 9), ("nala", "N", 9), ("pur", "P", 6)], "village_id string, name string, population bigint")
    got = {r.village_id: r for r in timeline.summarise(status, people).collect()}
    dates = lambda r: (r.last_connected, r.first_isolated, r.isolated_from_earliest, r.reconnected, r.n_dates_isolated)
    d = lambda k: dt.date(2023, 8, k)
    assert dates(got["ferry"]) == (d(5), d(6), d(6), None, 1) and dates(got["ghat"]) == (None, d(1), d(1), d(6), 2)
    assert dates(got["haor"]) == (d(6), d(20), d(7), None, 1) and dates(got["pur"]) == (d(1), d(5), d(2), None, 2)
    assert {v: r.outcome for v, r in got.items() if r.outcome != "isolated"} == {"kanda": "uncertain", "nala": "boat_dependent"}
    assert dates(got["nala"])[:4] == (None,) * 4 and got["nala"].n_dates_isolated == 2 and got["kanda"].urgency_rank is None
    assert sorted((r.urgency_rank, v) for v, r in got.items() if r.urgency_rank) == [(1, "ghat"), (2, "pur"), (3, "ferry"), (4, "haor")]
    assert got["haor"].aid_deadline == d(14) and got["haor"].isolation_range == "isolated between 07 Aug and 20 Aug" and got["ghat"].isolation_range == "isolated on or before 01 Aug"


def test_a_date_of_which_nothing_is_known_makes_the_outcome_uncertain(spark, town):
    nodes, edges, places, *_ = town
    halls = spark.createDataFrame([("hall", "Town hall", 0.0, -15.0)], "shelter_id string, name string, x double, y double")
    dry = [(MON, "unosat", r, c, 0) for r in range(12) for c in range(24)]
    cells = spark.createDataFrame(dry + [(THU, "unosat", 0, 0, 255)], "date date, source string, row int, col int, value int")
    t = engine.run(cells, nodes, edges, places, halls, Grid(-100.0, 1100.0, 24, 12, 100.0))
    assert {(r.date, r.status) for r in t["road_status"].collect()} == {(MON, "open"), (THU, "unknown")}
    assert {r.village_id: r.outcome for r in t["village_summary"].collect()} == {"mill": "uncertain", "quay": "uncertain", "isle": "boat_dependent"}
    assert {r.date: r.unknown_pct for r in t["coverage"].collect()} == {MON: 0.0, THU: 100.0}
    assert {r.village_id: r.name_bn for r in t["village_summary"].collect()}["mill"] == "কল"
    area = cells.filter("row < 3 and col < 4").select("row", "col").distinct()
    assert {(r.date, r.flooded_km2, r.unknown_pct) for r in raster.daily_area(cells, area, Grid(0, 0, 24, 12, 100.0)).collect()} == {(MON, 0.0, 0.0), (THU, 0.0, 100.0)}


def test_history_keeps_unknown_dates_and_missing_context(spark):
    day = [dt.date(2023, 8, k) for k in (1, 2, 3, 4)]
    merged = spark.createDataFrame([(day[0], 0, 0, 1), (day[1], 0, 0, 0), (day[3], 0, 0, 1)], "date date, row int, col int, value int")
    registered = spark.createDataFrame([(x,) for x in day], "date date")
    h = patches.history(merged, dates=registered)
    assert [(r.date, r.h0, r.h1, r.h2, r.target) for r in h.collect()] == [(day[3], 1, 0, 255, 1)]
    none = patches.with_context(h, spark.createDataFrame([], "date date, mm double"), spark.createDataFrame([], "row int, col int, elevation double"))
    r = patches.patches(none, Grid(0, 0, 2, 2), 2, ["h0", "h2", "rain", "elevation"]).first()
    assert (r.target, r.h0, r.rain, r.elevation) == ([1, 255, 255, 255], [1.0, 255.0, 255.0, 255.0], [0.0] * 4, [0.0] * 4)


def test_sources_without_priority_are_an_error(spark):
    cells = spark.createDataFrame([(MON, "drone", 0, 0, 1)], "date date, source string, row int, col int, value int")
    with pytest.raises(Exception, match="no priority for source drone"):
        raster.merge_by_date(cells).collect()


def test_thresholds_are_nested(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    s = engine.road_status_for(v.cells, v.edges, v.grid)
    cut = {t: {(r.date, r.edge_id) for r in s.filter((F.col("status") == "cut") & (F.col("threshold") == t)).collect()} for t in Params().thresholds}
    assert cut[0.4] < cut[0.2] <= cut[0.1]
