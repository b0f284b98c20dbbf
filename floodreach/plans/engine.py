"""The offline run: flood cells and a road network in, every published table out."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import nearest, network, quality, raster, roads, timeline
from ..operators.evaluate import match_reports, score_reports
from ..params import Grid, Params
from ..session import materialize
from ..sources.documents import file_inventory, manifest_document, meta_document, write_geojson
from ..sources.tables import write_by_date, write_csv


def road_status_for(cells: DataFrame, edges: DataFrame, grid: Grid, p: Params = Params(), sources: list[str] | None = None) -> DataFrame:
    """Minimum slice: which roads are cut on each date."""
    merged = raster.merge_by_date(cells, sources, p)
    dates = (cells.filter(F.col("source").isin(list(sources))) if sources else cells).select("date")
    return roads.road_status(roads.edge_fractions(edges, merged, grid, p.spacing_m, dates), p)


def run(cells: DataFrame, nodes: DataFrame, edges: DataFrame, villages: DataFrame, shelters: DataFrame, grid: Grid,
        reports: DataFrame | None = None, p: Params = Params(), label: str = "", dates: DataFrame | None = None) -> dict[str, DataFrame]:
    """All result tables. Stages that several later ones read are written once: merged cells, road status,
    snapped places, solved scenarios, village status.

    ``dates`` lists the registered dates (a manifest, say); without it, all dates of ``cells``, known or not. On a date
    whose maps know nothing every road is unknown."""
    t: dict[str, DataFrame] = {}
    days = materialize((cells if dates is None else dates).select("date").distinct(), "dates")
    t["merged"] = materialize(raster.merge_by_date(cells, p=p), "merged")
    t["coverage"] = materialize(raster.coverage(t["merged"], grid, days, p), "coverage")
    t["road_status"] = materialize(roads.road_status(roads.edge_fractions(edges, t["merged"], grid, p.spacing_m, days), p), "road_status")
    t["road_cut_summary"] = roads.cut_km(t["road_status"], edges, p)
    t["villages_snapped"] = materialize(nearest.snap_villages(villages, nodes, p), "villages")
    t["shelters_snapped"] = materialize(nearest.snap_shelters(shelters, nodes, p), "shelters")
    pairs = network.scenario_axis(t["road_status"])
    graph, solved = network.solve(edges, t["road_status"], t["villages_snapped"], t["shelters_snapped"], p, pairs)
    t["village_status"] = materialize(network.village_status(solved, t["road_status"], t["villages_snapped"], t["shelters_snapped"], pairs), "village_status")
    t["sensitivity"] = network.status_counts(t["village_status"])
    main = t["village_status"].filter(F.col("threshold") == F.lit(float(p.main_threshold)))
    summary = materialize(timeline.summarise(main, villages, p.supply_days), "summary")
    t["exit_routes"] = materialize(network.exit_routes(graph, solved, summary, t["villages_snapped"], edges, nodes, t["shelters_snapped"], p), "routes")
    t["village_summary"] = timeline.with_exit_routes(summary, t["exit_routes"])
    t["sensitivity_summary"] = timeline.sensitivity(t["village_status"], villages, p)
    t["meta"] = meta_document(t["coverage"], grid, label, p)
    if reports is not None:
        t["validation"] = score_reports(match_reports(reports, summary), summary)
    return t


def contract(t: dict[str, DataFrame], edges: DataFrame, cells: DataFrame, p: Params = Params()) -> DataFrame:
    """The contract report of a run, before anything of it is published."""
    main = F.col("threshold") == F.lit(float(p.main_threshold))
    cut = t["road_status"].filter(main & (F.col("status") == "cut")).select("edge_id").distinct()
    return quality.quality_report({
        "meta": t["meta"], "villages": t["villages_snapped"], "village_status": t["village_status"].filter(main).drop("threshold"), "shelters": t["shelters_snapped"],
        "exit_routes": t["exit_routes"], "cut_roads": edges.filter(F.size("geom") > 0).join(cut, "edge_id", "left_semi"), "flood": cells}, ())


def publish(t: dict[str, DataFrame], edges: DataFrame, out: str, p: Params = Params(), cells: DataFrame | None = None, rainfall: DataFrame | None = None,
            flood_area: DataFrame | None = None) -> None:
    """Write the reader's package: GeoJSON features, status tables, rain and area series, metadata, file inventory.

    With ``cells``, the contract is checked first, and a breach raises before anything is written."""
    if cells is not None:
        broken = contract(t, edges, cells, p).filter((F.col("severity") == "error") & (F.col("n_bad") > 0)).collect()
        if broken:
            raise ValueError("contract broken: " + "; ".join(f"{r.table_name}.{r.rule} ({r.n_bad})" for r in broken))
    main = F.col("threshold") == F.lit(float(p.main_threshold))
    snapped = t["villages_snapped"].select("village_id", "x", "y", "snap_dist_m", "boat_dependent")
    v = t["village_summary"].join(snapped, "village_id")
    write_geojson(v, f"{out}/villages.geojson", [c for c in v.columns if c not in ("x", "y")])
    s = t["shelters_snapped"]
    write_geojson(s, f"{out}/shelters.geojson", [c for c in ("shelter_id", "name", "type", "source") if c in s.columns])
    write_geojson(t["exit_routes"], f"{out}/exit_routes.geojson", ["village_id", "date", "shelter_id", "shelter_name", "length_m"], simplify_m=5.0)
    keep = [c for c in ("edge_id", "highway", "geom") if c in edges.columns]
    cut = t["road_status"].filter(main & (F.col("status") == "cut")).select("date", "edge_id").join(edges.select(*keep), "edge_id")
    write_geojson(cut, f"{out}/cut_roads.geojson", [c for c in cut.columns if c != "geom"], simplify_m=10.0)
    write_by_date(t["village_status"].filter(main).drop("threshold"), f"{out}/village_status")
    write_csv(t["sensitivity_summary"], f"{out}/sensitivity_summary")
    write_csv(t["sensitivity"], f"{out}/sensitivity")
    write_csv(t["road_cut_summary"], f"{out}/road_cut_summary")
    for name, table in (("rainfall_daily", rainfall), ("flood_area", flood_area)):
        if table is not None:
            write_csv(table, f"{out}/{name}")
    if "validation" in t:
        write_csv(t["validation"], f"{out}/validation")
    t["meta"].select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{out}/meta")
    files = materialize(file_inventory(t["meta"].sparkSession, out), "inventory")
    manifest_document(files, "floodreach", "", p).write.mode("overwrite").text(f"{out}/manifest.json")
