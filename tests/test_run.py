"""The whole run on the small projections, published and checked against the contract."""
import json

import pytest

from pyspark.sql import functions as F

from checks.views import Views
from floodreach.operators import quality
from floodreach.plans import engine
from floodreach.sources import documents


def test_run_and_publish(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    reports = v.reports.withColumn("date_reported", F.lit("2022-06-05"))
    t = engine.run(v.cells, v.nodes, v.edges, v.villages, v.shelters, v.grid, reports, label="DEMO")
    out = str(tmp_path / "app")
    rain = spark.createDataFrame([("2022-06-01", 1.5)], "date string, sunamganj_mm double")
    engine.publish(t, v.edges, out, cells=v.cells, rainfall=rain)
    listed = {json.loads(r[0])["path"] for r in spark.read.text(f"{out}/manifest.json").collect() if "path" in r[0]}
    assert {x.split("/")[0] for x in listed} >= {"villages.geojson", "cut_roads.geojson", "rainfall_daily", "sensitivity", "road_cut_summary", "village_status", "meta"}
    with pytest.raises(ValueError, match="flood.class_domain"):
        engine.publish(t, v.edges, str(tmp_path / "bad"), cells=v.cells.withColumn("value", F.lit(9)))
    assert not (tmp_path / "bad").exists()
    n = v.villages.count()
    counts = t["sensitivity"].select((F.col("boat_dependent") + F.col("connected") + F.col("isolated") + F.col("uncertain")).alias("n"))
    assert counts.count() == 33 and counts.filter(F.col("n") != n).count() == 0
    assert documents.read_geojson(spark, f"{out}/villages.geojson", "village_id string").count() == n
    meta = json.loads(spark.read.text(f"{out}/meta").first()[0])
    assert meta["dates"] == sorted(meta["dates"]) and len(meta["dates"]) == 11
    main = t["village_status"].filter("threshold = 0.2").drop("threshold")
    assert spark.read.parquet(f"{out}/village_status").count() == main.count() == 11 * n
    parts = {"meta": t["meta"], "villages": v.villages, "village_status": main, "shelters": t["shelters_snapped"], "exit_routes": t["exit_routes"],
             "cut_roads": v.edges.select("edge_id", "geom"), "flood": v.cells}
    assert quality.is_valid(quality.quality_report(parts))
    summary = t["village_summary"]
    assert summary.filter("safe_exit_date is not null and exit_route_m is null").count() == 0
    assert t["validation"].filter("match = 'no match' and village_id is not null").count() == 0
