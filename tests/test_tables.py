"""Scans, sinks, documents, contracts, text, replayed result tables, streams."""
import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.views import X0, Y0, Views
from floodreach import Grid, Params
from floodreach.functions import geometry, text
from floodreach.functions.simplify import simplify
from floodreach.operators import common, evaluate, focal, network, patches, places, polygons, quality, rain, raster, readpath, timeline, water_level
from floodreach.schema import REPORTS, SHELTERS_CSV
from floodreach.sources import documents, tables
from floodreach.streaming import feeds

from .conftest import rows

D = dt.date


def test_grid_snaps_outward(spark, tmp_path):
    pts = spark.createDataFrame([(1003.0, 2017.0), (1500.0, 1990.5), (1238.4, 2960.0)], "x double, y double")
    g = Grid.from_row(tables.grid_from_points(pts).first())
    assert g == Grid(500.0, 3460.0, 75, 99, 20.0) and (g.xmax, g.ymin) == (2000.0, 1480.0)
    tables.save_grid(spark, g, str(tmp_path / "grid"))
    assert tables.load_grid(spark, str(tmp_path / "grid")) == g


def test_tiles(spark):
    grid = Grid(0, 0, 13, 7, 5)
    t = focal.chunk_bounds(spark, grid, 5, 3).collect()
    covered = [(x, y) for r in t for x in range(r.x0, r.x1) for y in range(r.y0, r.y1)]
    assert len(t) == 9 and len(covered) == len(set(covered)) == grid.size and max(r.x1 for r in t) == 13 and max(r.y1 for r in t) == 7
    with pytest.raises(ValueError, match="positive"):
        focal.chunk_bounds(spark, grid, 5, -1)


def test_shelter_csv_and_selection(spark, tmp_path):
    (tmp_path / "all.csv").write_text("shelter_id,name,lat,lon,verified\n007,School,25.0,91.5,YES\n8,Clinic,25.1,91.6,no\n")
    s = tables.shelters_from_csv(spark, str(tmp_path / "all.csv"))
    assert rows(s, "shelter_id", "name", "type") == [("007", "School", None), ("8", "Clinic", None)]
    assert rows(tables.load_shelters(spark, str(tmp_path / "all.csv"), "x"), "shelter_id") == [("007",)]
    with pytest.warns(UserWarning):
        assert tables.load_shelters(spark, str(tmp_path / "none.csv"), str(tmp_path / "all.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("shelter_id,name\n1,x\n")
    with pytest.raises(ValueError, match="lat"):
        tables.shelters_from_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "plain.csv").write_text("shelter_id,name,lat,lon\n1,x,25,91\n2,y,25,91\n")
    assert tables.load_shelters(spark, str(tmp_path / "plain.csv"), "x").count() == 2
    (tmp_path / "no.csv").write_text("shelter_id,name,lat,lon,verified\n1,x,25,91,no\n")
    with pytest.raises(ValueError, match="verified"):
        tables.load_shelters(spark, str(tmp_path / "no.csv"), "x")


def test_register_flood_maps_replaces_maps(spark, tmp_path):
    root, ddl = str(tmp_path / "flood"), "date date, source string, row int, col int, value int"
    cells = lambda *cols: rows(tables.read_cells(spark, root)[0], *cols)
    a = spark.createDataFrame([(D(2022, 6, 1), "modis", 0, 0, 1), (D(2022, 6, 1), "unosat", 0, 0, 0), (D(2022, 6, 1), "modis", 0, 1, 255)], ddl)
    notes = a.select("date", "source", F.lit("first").alias("note")).distinct()
    tables.register_flood_maps(a, notes, root)
    b = spark.createDataFrame([(D(2022, 6, 1), "modis", 5, 5, 0)], ddl)
    before = tables.read_cells(spark, root)[0]
    got = tables.register_flood_maps(b, b.select("date", "source", F.lit(None).cast("string").alias("note")), root)
    assert rows(got, "source", "note") == rows(tables.load_manifest(spark, f"{root}/manifest"), "source", "note") == [("modis", ""), ("unosat", "first")]
    assert cells("source", "row", "value") == [("modis", 5, 0), ("unosat", 0, 0)]
    assert rows(before, "source", "row", "value") == [("modis", 0, 1), ("unosat", 0, 0)]  # who read before goes on undisturbed
    tables.register_flood_maps(b.limit(0), b.select("date", "source", F.lit("all cloud").alias("note")), root)
    known, days = tables.read_cells(spark, root)
    assert rows(known, "source", "row", "value") == [("unosat", 0, 0)] and rows(days) == [(D(2022, 6, 1),)]
    assert tables.read_cells(spark, root, sources=["modis"])[0].isEmpty() and rows(tables.read_cells(spark, root, [D(2022, 6, 1)], ["modis"])[1]) == [(D(2022, 6, 1),)]
    assert tables.read_cells(spark, root, [D(2022, 6, 2)])[0].isEmpty()
    strange = b.withColumn("source", F.lit("drone"))
    with pytest.raises(ValueError, match="unknown source drone"):
        tables.register_flood_maps(strange, strange.select("date", "source", F.lit("").alias("note")), root)
    tables.register_flood_maps(b.withColumn("source", F.lit("unosat")), b.select("date", "source", F.lit("n").alias("note")), root)
    assert cells("source", "row") == [("unosat", 0)]  # cells without a note are left alone
    assert tables.drop_superseded(spark, root) == 3 and tables.drop_superseded(spark, root) == 0
    assert cells("source", "row") == [("unosat", 0)]
    bad = b.select("date", F.lit("drone").alias("source"), F.lit("p").alias("path"), F.lit("").alias("note"))
    with pytest.raises(Exception, match="unknown source"):
        tables.upsert_manifest(tables.load_manifest(spark, str(tmp_path / "absent")), bad).collect()
    assert tables.load_manifest(spark, str(tmp_path / "absent")).count() == 0


def test_utm_is_exact_on_the_meridian_and_reversible(spark):
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)

    def arc(lat, n=20000):
        h = math.radians(lat) / n
        m = [a * (1 - e2) / (1 - e2 * math.sin(i * h) ** 2) ** 1.5 for i in range(n + 1)]
        return h / 3 * (m[0] + m[-1] + 4 * sum(m[1:-1:2]) + 2 * sum(m[2:-1:2]))
    df = spark.createDataFrame([(93.0, 25.0), (91.4, 24.9), (90.0, 0.0), (95.9, 60.0)], "lon double, lat double")
    x, y = geometry.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = geometry.to_lonlat(F.col("x"), F.col("y"))
    r = df.withColumn("x", x).withColumn("y", y).withColumn("lo", lon).withColumn("la", lat).collect()
    assert r[0].x == pytest.approx(500000, abs=1e-6) and r[0].y == pytest.approx(0.9996 * arc(25.0), abs=1e-3)
    assert r[2].x == pytest.approx(166021.443, abs=2e-3)
    assert all(abs(q.lo - q.lon) < 1e-10 and abs(q.la - q.lat) < 1e-10 for q in r)


def test_line_helpers(spark):
    ddl = "line array<struct<x:double,y:double>>"
    df = spark.createDataFrame([([(0.0, 0.0), (5.0, 1.0), (10.0, 0.0), (10.0, 10.0)],), ([(0.0, 0.0), (1.0, 1.0)],)], ddl)
    got = [[(p.x, p.y) for p in r[0]] for r in df.select(simplify(F.col("line"), 2.0)).collect()]
    assert got == [[(0, 0), (10, 0), (10, 10)], [(0, 0), (1, 1)]]
    ring = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (6.0, 10.0), (6.0, 2.0), (4.0, 2.0), (4.0, 10.0), (0.0, 10.0)],)], "ring array<struct<x:double,y:double>>")
    px, py = geometry.ring_interior_point(F.col("ring"))
    r = ring.select(geometry.ring_contains(F.col("ring"), px, py), geometry.ring_area(F.col("ring")), geometry.ring_distance(F.col("ring"), F.lit(13.0), F.lit(14.0))).first()
    assert r[0] and r[1] == pytest.approx(84) and r[2] == pytest.approx(5.0)


def test_geojson_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("v1", D(2022, 6, 7), 500000.0, 2765000.0), ("v2", None, 400000.0, 2765000.0)], "village_id string, day date, x double, y double")
    documents.write_geojson(v, str(tmp_path / "v"), ["village_id", "day"])
    one = json.loads(spark.read.text(str(tmp_path / "v")).filter("value like '%v1%'").first()[0])
    assert one["properties"] == {"village_id": "v1", "day": "2022-06-07"} and one["geometry"]["type"] == "Point"
    assert one["geometry"]["coordinates"][0] == 93.0 and len(str(one["geometry"]["coordinates"][1]).split(".")[1]) <= 5
    back = documents.read_geojson(spark, str(tmp_path / "v"), "village_id string, day string")
    assert rows(back, "village_id", "day") == [("v1", "2022-06-07"), ("v2", None)]


def test_a_failed_registration_changes_nothing(spark, tmp_path, monkeypatch):
    root, ddl = str(tmp_path / "flood"), "date date, source string, row int, col int, value int"
    day = lambda d, v: spark.createDataFrame([(D(2022, 6, d), "modis", 0, 0, v)], ddl)
    put = lambda c: tables.register_flood_maps(c, c.select("date", "source", F.lit(None).cast("string").alias("note")), root)
    state = lambda: rows(tables.read_cells(spark, root)[0], "date", "value")
    put(day(1, 1))
    commit = tables._commit

    def fails(entries, root):
        raise OSError("store is away")

    monkeypatch.setattr(tables, "_commit", fails)
    with pytest.raises(OSError, match="away"):
        put(day(1, 0))
    assert state() == [(D(2022, 6, 1), 1)]  # the cells of the second are written, nobody reads them

    def another_first(entries, root):
        monkeypatch.setattr(tables, "_commit", commit)
        put(day(2, 1))  # a whole other registration between the writes of this one
        put(day(3, 1))
        commit(entries, root)

    monkeypatch.setattr(tables, "_commit", another_first)
    put(day(3, 0))
    assert [d for d, _ in state()] == [D(2022, 6, 1), D(2022, 6, 2), D(2022, 6, 3)]
    assert state() == state() and tables.drop_superseded(spark, root) == 1
    put(day(3, 0))
    assert state() == [(D(2022, 6, 1), 1), (D(2022, 6, 2), 1), (D(2022, 6, 3), 0)]


def test_files_of_any_size_are_digested_in_chunks(spark, tmp_path):
    whole = hashlib.sha256()
    with open(tmp_path / "large.bin", "wb") as f:  # more than a binary column can hold
        f.truncate(9 << 28)
    for _ in range(9):
        whole.update(bytes(1 << 28))
    (tmp_path / "x y%20.bin").write_bytes(b"flood" * 1000)
    (tmp_path / "empty").write_bytes(b"")
    got = documents.file_inventory(spark, str(tmp_path))
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(got) == [("empty", hashlib.sha256(b"").hexdigest(), 0), ("large.bin", whole.hexdigest(), 9 << 28), ("x y%20.bin", hashlib.sha256(b"flood" * 1000).hexdigest(), 5000)]
    small = documents.file_inventory(spark, str(tmp_path / "x y%20.bin"), chunk=7)
    assert rows(small, "sha256", "bytes") == [(hashlib.sha256(b"flood" * 1000).hexdigest(), 5000)]
    head = json.loads(documents.manifest_document(small, "p", "live", model=small).first()[0])
    assert head["model"]["bytes"] == 5000 and head["model"]["sha256"] == hashlib.sha256(b"flood" * 1000).hexdigest()
    assert json.loads(documents.manifest_document(small, "p", "live").first()[0])["model"] is None


def test_quantiles_across_tasks(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=5001), "b": np.repeat([1.0, 1e9, -3.5], [4000, 3, 700]), "c": np.array([2.5]), "d": np.array([0.0, 4.0]), "e": np.exp(rng.normal(size=3000) * 20)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None)], "k string, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.k: (r.n, r.q) for r in common.exact_quantiles(df, ["k"], "v", at).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k][0] == len(vs) and np.allclose(got[k][1], np.quantile(vs, at), rtol=1e-12, atol=0)
    assert common.exact_quantiles(df.limit(0), ["k"], "v", at).isEmpty()


def test_file_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"flood")
    (tmp_path / "manifest.json").write_text("{}")
    got = rows(documents.file_inventory(spark, str(tmp_path)))
    assert got == [("a/x.bin", hashlib.sha256(b"flood").hexdigest(), 5)]
    lines = [json.loads(r[0]) for r in documents.manifest_document(documents.file_inventory(spark, str(tmp_path)), "p", "live").collect()]
    assert lines[0]["configuration"]["cut_threshold"] == 0.2 and lines[1]["bytes"] == 5


def test_annotations(spark, tmp_path):
    for image, label in (("77", "Flooded"), ("a-3", " non flooded")):
        q = "{'Question': 'What is the overall condition of the given image?', " + f"'Ground_Truth': '{label}'}}"
        (tmp_path / f"{image}.JPG.json").write_text(json.dumps({"tags": [{"name": "question", "value": q}]}))
    labels = documents.read_annotations(spark, str(tmp_path))
    assert rows(labels) == [("77", 1), ("a-3", 0)]
    seen = spark.createDataFrame([("a-3",), ("77",), ("77",), ("b",)], "image_id string")
    paired, missing = documents.pair_images(seen, labels)
    assert rows(paired) == [("77", 1), ("a-3", 0)] and missing.isEmpty()
    with pytest.raises(Exception, match="each class"):
        documents.pair_images(seen.filter("image_id = '77'"), labels)[0].collect()
    (tmp_path / "1.json").write_text(json.dumps({"tags": [{"name": "question", "value": q.replace("non flooded", "half wet")}]}))
    with pytest.raises(Exception, match="unsupported label"):
        documents.read_annotations(spark, str(tmp_path)).collect()


def _published(spark):
    """A consistent dataset of three villages and two dates around easting 400 000."""
    v = Views(spark, "/root/testdata/sf0.001")
    at = lambda df: df.withColumn("x", F.col("x") + X0).withColumn("y", F.col("y") + Y0)
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)
    villages = at(fixed(v.villages.orderBy("village_id").limit(3)))
    days = fixed(v.cells.select("date").distinct().orderBy("date").limit(2))
    cells = v.cells.join(days, "date", "left_semi")
    status = villages.select("village_id", F.explode(F.array(*[F.lit(r.date) for r in days.collect()])).alias("date"), F.lit("connected").alias("status"), F.lit(12.5).alias("dist_to_shelter_m"), F.lit("s").alias("nearest_shelter_id"))
    lines = v.edges.limit(5).select("edge_id", F.lit("v").alias("village_id"), F.transform("geom", lambda q: F.struct((q["x"] + X0).alias("x"), (q["y"] + Y0).alias("y"))).alias("geom"))
    return {"meta": documents.meta_document(raster.coverage(raster.merge_by_date(cells), v.grid, cells), v.grid, "trial"), "villages": villages, "village_status": status,
            "shelters": at(fixed(v.shelters.orderBy("shelter_id").limit(2))), "exit_routes": lines, "cut_roads": lines, "flood": cells}


def _faults(tables_):
    return {(r.table_name, r.rule): (r.severity, r.n_bad) for r in quality.quality_report(tables_, ()).filter("n_bad > 0").collect()}


def test_contract_finds_planted_faults(spark):
    good = _published(spark)
    assert _faults(good) == {} and quality.is_valid(quality.quality_report(good))
    state, meta = good["village_status"], good["meta"]
    fixed = lambda df: spark.createDataFrame(df.collect(), df.schema)
    bad = good | {"village_status": state.unionAll(fixed(state.limit(1)).withColumn("status", F.lit("dry"))), "flood": good["flood"].withColumn("value", F.col("value") + 1),
                  "villages": good["villages"].withColumn("y", F.when(F.col("village_id") > "v000000", F.col("y"))),
                  "shelters": good["shelters"].select("shelter_id", (F.col("x") / 1e6).alias("x"), (F.col("y") / 1e6).alias("y")),
                  "meta": meta.withColumn("dates", F.reverse("dates")).withColumn("app_end", F.lit(None).cast("string")).withColumn("data_label", F.lit(""))}
    bad.pop("cut_roads")
    n = good["flood"].filter("value <> 0").count()
    assert _faults(bad) == {("village_status", "unique_key"): ("error", 1), ("village_status", "status_domain"): ("error", 1), ("flood", "class_domain"): ("error", n), ("villages", "geometry"): ("error", 1),
                            ("shelters", "projected"): ("warning", 1), ("meta", "chronological"): ("error", 1), ("meta", "window"): ("error", 1), ("meta", "label"): ("error", 1), ("cut_roads", "present"): ("error", 1)}


def test_routes_known_by_a_day(spark):
    known = [("w", D(2023, 3, k), f"hall{k}", f"Hall {k}", 100 * k) for k in (2, 9, 30)] + [("z", D(2023, 4, 1), "far", "Far", 5)]
    routes = spark.createDataFrame(known, "village_id string, date date, shelter_id string, shelter_name string, length_m bigint")
    asked = spark.createDataFrame([("w", D(2023, 3, 9)), ("z", D(2023, 3, 31))], "village_id string, day date")
    assert rows(readpath.routes_available(routes, asked), "village_id", "shelter_id") == [("w", "hall2"), ("w", "hall9")]
    assert readpath.routes_available(routes.drop("date"), asked).count() == 4


def test_notice_texts(spark):
    s = spark.createDataFrame([("v1", "Patharia", "পাথারিয়া", "isolated", D(2022, 5, 18), D(2022, 5, 23), D(2022, 5, 19), D(2022, 5, 26)), ("v2", "Jawa", None, "isolated", None, D(2022, 6, 3), D(2022, 6, 3), D(2022, 6, 10))],
                              "village_id string, name string, name_bn string, outcome string, last_connected date, first_isolated date, isolated_from_earliest date, aid_deadline date")
    routes = spark.createDataFrame([("v1", D(2022, 5, 18), "s1", "School", 5653)], "village_id string, date date, shelter_id string, shelter_name string, length_m bigint")
    days = spark.createDataFrame([("v1", D(2022, 5, 25)), ("v2", D(2022, 6, 1))], "village_id string, day date")
    en = {r.village_id: r for r in readpath.village_card(s, routes, days).collect()}
    assert en["v1"].notice == "Provisional: Patharia may be isolated during 19 May - 23 May. Last safe route: 5.7 km by road to School. Follow official flood alerts."
    assert en["v2"].notice == "Provisional: Jawa may be isolated during on or before 03 Jun. Last safe route: not available. Follow official flood alerts."
    assert (en["v1"].days_left, en["v1"].urgent, en["v2"].days_left) == (1, True, None)
    bn = {r.village_id: r.notice for r in readpath.village_card(s, routes, days, "bn").collect()}
    assert "পাথারিয়া" in bn["v1"] and "১৯ মে - ২৩ মে" in bn["v1"] and "৫.৭ কিমি" in bn["v1"] and "৩ জুন বা তার আগে" in bn["v2"]


def test_missing_dem_is_an_error(spark):
    flood = spark.createDataFrame([(D(2022, 5, 20),)], "date date")
    with pytest.raises(Exception, match="Real DEM"):
        patches.require_dem(flood, flood.limit(0)).collect()


def test_patches_are_complete(spark):
    cells = spark.createDataFrame([(D(2022, 6, d), r, c, (r + c + d) % 2) for d in range(1, 6) for r in range(10) for c in range(10) if (r, c) != (9, 9)], "date date, row int, col int, value int")
    h = patches.history(cells).withColumn("rain", F.lit(1.5))
    p = patches.patches(h, Grid(0, 0, 10, 10), 4, ["h0", "h1", "h2", "rain"])
    assert p.count() == 2 * 16 and patches.patch_starts(10, 4) == [0, 2, 4, 6]
    r = p.filter("prow = 6 and pcol = 6").orderBy("date").first()
    assert r.target[-1] == 255 and r.h0[-1] == 255.0 and r.target[0] == (6 + 6 + 4) % 2 and r.h0[0] == (12 + 1) % 2 and r.rain[0] == 1.5
    with pytest.raises(ValueError, match="smaller"):
        patches.patches(h, Grid(0, 0, 10, 10), 16, ["h0"])


def test_daily_levels(spark):
    lv = spark.createDataFrame([(D(2022, 6, 1), 3.0), (D(2022, 6, 5), 5.0)], "date date, water_level_m double")
    assert rows(water_level.daily_levels(lv)) == [(D(2022, 6, d), 3.0 + (d - 1) / 2, d in (1, 5)) for d in range(1, 6)]
    with pytest.raises(Exception, match="at least two"):
        water_level.daily_levels(lv.limit(1)).collect()
    dem = spark.createDataFrame([(0, 0, 3.4), (0, 1, 3.5), (0, 2, float("nan"))], "row int, col int, elevation double")
    got = water_level.bathtub(dem, water_level.daily_levels(lv)).filter("date = '2022-06-02'")
    assert rows(got, "col", "value") == [(0, 1), (1, 1), (2, 255)]


def test_metrics(spark):
    p = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (255, 0), (1, 1)], "label int, pred int")
    r = evaluate.confusion(p, ignore=255).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 2) and r.accuracy == pytest.approx(0.6) and r.f1 == pytest.approx(2 / 3)
    assert tuple(evaluate.pixel_accuracy(p).first()) == (0.5, 0.6)
    none = evaluate.confusion(p.filter("label = 0 and pred = 0")).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_report_matching(spark):
    s = spark.createDataFrame([("a", "Dholposhi", "isolated", D(2022, 5, 19), D(2022, 5, 23)), ("b", "Kusiura", "never_isolated", None, None)], "village_id string, name string, outcome string, isolated_from_earliest date, first_isolated date")
    rep = spark.createDataFrame([("Dolposhi", "", "", "2022-05-20", "", "", "", "", ""), ("x", "", "", "2022-05-30", "no", "", "", "a", ""), ("Nowhere at all", "", "", "2022-05-20", "yes", "", "", "", ""), ("Kusiura", "", "", "", "yes", "", "", "", "")], REPORTS)
    got = {r.place_name: r for r in evaluate.score_reports(evaluate.match_reports(rep, s), s).collect()}
    assert got["Dolposhi"]["match"] == "auto (0.94)" and got["Dolposhi"].error_days == 3 and got["Dolposhi"].report_in_range and got["Dolposhi"].days_outside_range == 0
    assert got["x"]["match"] == "manual" and got["x"].error_days == -7 and got["x"].days_outside_range == 7
    assert got["Nowhere at all"]["match"] == "no match" and got["Nowhere at all"].village_id is None
    assert got["Kusiura"]["match"] == "auto (1.00)" and got["Kusiura"].error_days is None


# --- replayed results ------------------------------------------------------------------------------------------

# Date, flooded, dry and unknown share of published flood maps, which the decision must reproduce
SUMMARY = """2022-05-16 3.74 40.92 55.33|2022-05-18 1.32 54.89 43.79|2022-05-23 39.33 60.67 0.0|2022-05-25 36.59 63.41 0.0|2022-05-28 6.31 38.34 55.35|2022-05-30 12.12 43.97 43.91|2022-06-04 34.71 65.29 0.0
2022-06-06 37.07 62.93 0.0|2022-06-09 6.35 38.18 55.47|2022-06-11 2.72 53.3 43.98|2022-06-16 34.81 65.19 0.0|2022-06-18 42.86 57.14 0.0|2022-06-21 7.32 37.29 55.39|2022-06-23 1.87 54.19 43.93
2022-06-28 40.83 59.17 0.0|2022-06-30 41.08 58.92 0.0|2022-07-03 7.1 37.52 55.38|2022-07-05 5.75 50.34 43.91|2022-07-12 33.21 66.79 0.0"""


def test_replay_go_no_go(spark):
    r = [x.split() for x in SUMMARY.replace("\n", "|").split("|")]
    df = spark.createDataFrame([(D.fromisoformat(a), float(f), float(d), float(u)) for a, f, d, u in r], "date date, flooded_pct double, dry_pct double, unknown_pct double")
    g = raster.go_no_go(df).first()
    assert g.go and g.peak == D(2022, 6, 18) and g.usable_dates == 14
    assert df.filter("abs(flooded_pct + dry_pct + unknown_pct - 100) > 0.02").count() == 0


def test_replay_village_summary(spark):
    # Two published village results
    isolated = [("Dholkotob village", "2022-05-18", "2022-05-23", "2022-05-19", "2022-05-26", "isolated between 19 May and 23 May"), ("Patharia", None, "2022-05-23", "2022-05-23", "2022-05-30", "isolated on or before 23 May")]
    df = spark.createDataFrame([(n, "isolated", a, b, c, d, t) for n, a, b, c, d, t in isolated], "name string, outcome string, lc string, fi string, ie string, dl string, txt string")
    for c in ("lc", "fi", "ie", "dl"):
        df = df.withColumn(c, F.col(c).cast("date"))
    got = timeline.add_deadlines(df.withColumnRenamed("ie", "isolated_from_earliest"))
    ok = (F.col("aid_deadline") == F.col("dl")) & (text.isolation_range_text(F.col("outcome"), F.col("lc"), F.col("isolated_from_earliest"), F.col("fi")) == F.col("txt"))
    assert got.filter(ok).count() == 2


def test_utm_is_right_to_the_last_millimetre(spark):
    """Northings just above half a millimetre, by the sixth order series in 80-bit floats; the fourth order fell below it."""
    want = [(32.6326, 93.2405, 3610583.6745000297), (31.6006, 93.09, 3496170.1225000418), (25.0008, 92.8515, 2765044.5375000513)]
    df = spark.createDataFrame([(i, lat, lon) for i, (lat, lon, _) in enumerate(want)], "i int, lat double, lon double")
    x, y = geometry.to_utm(F.col("lon"), F.col("lat"))
    df = df.withColumns({"x": x, "y": y})
    lon, lat = geometry.to_lonlat(F.col("x"), F.col("y"))
    for r, (a, b, north) in zip(df.select("x", "y", lon.alias("lon"), lat.alias("lat")).orderBy("i").collect(), want):
        assert abs(r.y - north) < 1e-8 and abs(r.lat - a) < 1e-13 and abs(r.lon - b) < 1e-13


# --- streams ---------------------------------------------------------------------------------------------------

def test_rain_stream_equals_batch(spark, tmp_path):
    ddl = "ts timestamp, box string, cell bigint, mm_per_h double"
    t0 = dt.datetime(2022, 6, 1, 0, 0)
    data = [(t0 + dt.timedelta(minutes=30 * i), "b", i % 2, float(i % 5)) for i in range(200)]
    spark.createDataFrame(data, ddl).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = (feeds.rain_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("rain_days")
         .outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("rain_days").groupBy("date", "box").agg(F.avg("mm").alias("mm")).select("date", "box", F.round("mm", 1).alias("mm"))
    assert rows(got) == rows(rain.daily_rain(spark.createDataFrame(data, ddl)))


def test_register_stream(spark, tmp_path):
    ddl = "date date, source string, row int, col int, value int, note string"
    spark.createDataFrame([(D(2022, 6, 1), "modis", 0, 0, 1, "n1")], ddl).write.parquet(str(tmp_path / "in"))
    q = feeds.register_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(tables.load_manifest(spark, str(tmp_path / "out" / "manifest")), "source", "note") == [("modis", "n1")]


def test_flagship_entry(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["threshold", "date", "edge_id", "frac_flooded", "frac_unknown", "status"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
