"""Typed scans and sinks of the domain tables."""
from __future__ import annotations

import uuid
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import to_utm
from ..operators.places import verified_only
from ..params import Grid, Params
from ..schema import CELLS, COMMITS, MANIFEST, ddl


def read_or_none(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame | None:
    reader = spark.read.format(fmt).options(**options)
    try:
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def typed(df: DataFrame, schema: str, required: list[str] | None = None) -> DataFrame:
    """Columns by name in the declared types; optional ones that are absent become null, required ones must exist."""
    fields = ddl(schema).fields
    missing = sorted(set(required if required is not None else [f.name for f in fields]) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """Header-driven CSV scan: everything is read as text and cast to the declared types, nothing is inferred."""
    return typed(spark.read.csv(path, header=True, multiLine=False, escape='"'), schema, required)


def shelters_from_csv(spark: SparkSession, path: str) -> DataFrame:
    from ..schema import SHELTERS_CSV
    raw = spark.read.csv(path, header=True, multiLine=False, escape='"')
    s = typed(raw, SHELTERS_CSV, ["shelter_id", "name", "lat", "lon"])
    x, y = to_utm(F.col("lon"), F.col("lat"))
    s = s.withColumn("x", x).withColumn("y", y)
    return s if "verified" in raw.columns else s.drop("verified")  # a list without the column counts as checked


def load_shelters(spark: SparkSession, verified_path: str, candidates_path: str) -> DataFrame:
    """The hand-checked list when there is one, else all candidates with a warning."""
    try:
        return verified_only(shelters_from_csv(spark, verified_path))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    warnings.warn("no verified shelter list found: using unverified candidates")
    return shelters_from_csv(spark, candidates_path)


def load_network(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    from ..schema import EDGES, NODES
    return (typed(spark.read.parquet(nodes_path), NODES),
            typed(spark.read.parquet(edges_path), EDGES, ["edge_id", "u", "v", "length_m", "geom"]))


def load_villages(spark: SparkSession, path: str) -> DataFrame:
    from ..schema import VILLAGES
    return typed(spark.read.parquet(path), VILLAGES, ["village_id", "name", "x", "y"])


def grid_from_points(points: DataFrame, p: Params = Params()) -> DataFrame:
    """One-row grid covering all points, padded and snapped outward."""
    res, pad = F.lit(p.grid_res_m), F.lit(p.grid_pad_m)
    b = points.agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))
    down = lambda v: F.floor((v - pad) / res) * res
    up = lambda v: F.ceil((v + pad) / res) * res
    b = b.select(down(F.col("w")).alias("xmin"), up(F.col("n")).alias("ymax"), up(F.col("e")).alias("xmax"), down(F.col("s")).alias("ymin"))
    return b.select("xmin", "ymax", F.rint((F.col("xmax") - F.col("xmin")) / res).cast("int").alias("width"),
                    F.rint((F.col("ymax") - F.col("ymin")) / res).cast("int").alias("height"), res.alias("res"), F.lit("EPSG:32646").alias("crs"))


def load_grid(spark: SparkSession, path: str) -> Grid:
    return Grid.from_row(spark.read.json(path, multiLine=True, schema="xmin double, ymax double, width int, height int, res double, crs string").first())


def save_grid(spark: SparkSession, grid: Grid, path: str) -> None:
    spark.createDataFrame([(grid.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """All entries ever committed to a manifest; one without versions is the oldest, an absent one is empty."""
    log = read_or_none(spark, path, schema=COMMITS)
    return spark.createDataFrame([], COMMITS) if log is None else log.select(*ddl(COMMITS).names).na.fill(0, ["version"])


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Registered flood maps: of each (date, source) the entry last committed. An absent manifest is an empty one, missing notes are blank."""
    last = _commits(spark, path).na.fill("", ["path", "note"]).groupBy("date", "source").agg(F.max(F.struct("version", "path", "note")).alias("m"))
    return last.select("date", "source", "m.path", "m.note")


def upsert_manifest(manifest: DataFrame, new: DataFrame, p: Params = Params()) -> DataFrame:
    """Replace entries of the same (date, source), add the others; an unknown source is an error."""
    ok = F.when(F.col("source").isin(*p.source_priority), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("unknown source "), "source")))
    both = manifest.withColumn("_v", F.lit(0)).unionByName(new.withColumn("source", ok).withColumn("_v", F.lit(1)))
    return (both.groupBy("date", "source").agg(F.max(F.struct("_v", "path", "note")).alias("m"))
            .select("date", "source", "m.path", "m.note").orderBy("date", "source"))


def register_flood_maps(cells: DataFrame, notes: DataFrame, root: str, p: Params = Params()) -> DataFrame:
    """Write flood cells (known ones only) under ``root``, then record them in the manifest beside them; returns the manifest.

    Nothing that is registered is ever overwritten. The cells of one call go to a folder of their own, and a commit of one small
    file names it; readers follow the last commit of each (date, source). A call that fails before its commit changes nothing
    for readers, and two calls at once cannot lose each other's maps; of two for the same map one wins, for all readers the same.
    Only maps named in ``notes`` are registered; one without any known cell is a single UNKNOWN marker row. Rows are clustered by
    tile so that later readers can skip row groups. Sources are checked before anything is written."""
    spark = cells.sparkSession
    strange = sorted(str(r[0]) for r in notes.select("source").distinct().filter(~F.coalesce(F.col("source").isin(*p.source_priority), F.lit(False))).collect())
    if strange:
        raise ValueError(f"unknown source {', '.join(strange)}")
    version = _commits(spark, f"{root}/manifest").agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    folder = f"cells/version={uuid.uuid4().hex}"
    cells = cells.join(notes.select("date", "source").distinct(), ["date", "source"], "left_semi")
    tile = [F.floor(F.col("row") / p.tile_px), F.floor(F.col("col") / p.tile_px)]
    marker = notes.select("date", "source", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(255).alias("value"))
    (cells.filter(F.col("value") != 255).select("date", "source", "row", "col", "value").unionByName(marker).repartition("date", "source", *tile)
     .sortWithinPartitions("date", "source", "row", "col").write.partitionBy("date", "source").parquet(f"{root}/{folder}"))
    path = F.concat(F.lit(f"{folder}/date="), F.col("date").cast("string"), F.lit("/source="), F.col("source"))
    new = notes.groupBy("date", "source").agg(F.max(F.coalesce("note", F.lit(""))).alias("note"))
    new = new.select("date", "source", path.alias("path"), "note", F.lit(version).cast("bigint").alias("version"))
    _commit(new, root)
    return load_manifest(spark, f"{root}/manifest")


def _commit(entries: DataFrame, root: str) -> None:
    """One file in a folder of its own: it appears whole or not at all, and no other commit is touched."""
    entries.coalesce(1).write.parquet(f"{root}/manifest/commit={uuid.uuid4().hex}")


def read_cells(spark: SparkSession, root: str, dates: list | None = None, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, dates) as registered under ``root``: the known cells of the chosen maps, and all registered dates among the
    chosen, also those of maps that know nothing. Only the folders that the manifest names are listed and read."""
    maps = load_manifest(spark, f"{root}/manifest")
    maps = maps if dates is None else maps.filter(F.col("date").isin([str(d) for d in dates]))
    maps = maps if sources is None else maps.filter(F.col("source").isin(sources))
    folders = [f"{root}/{r[0]}" for r in maps.select("path").collect()]  # one per map
    if not folders:
        return spark.createDataFrame([], CELLS), maps.select("date").distinct()
    cells = spark.read.schema(CELLS).option("basePath", f"{root}/cells").parquet(*folders).select(*ddl(CELLS).names)
    return cells.filter(F.col("row").isNotNull()), maps.select("date").distinct()


def drop_superseded(spark: SparkSession, root: str) -> int:
    """Delete the cells of maps that a later commit has replaced; returns how many. What is not committed (yet) stays.

    Readers that took their folders before the later commit fail on them: call it when none is at work."""
    log = _commits(spark, f"{root}/manifest").select("path").distinct()
    old = log.join(load_manifest(spark, f"{root}/manifest").select("path"), "path", "left_anti")
    gone = 0
    for row in old.toLocalIterator():  # one per replaced map
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{row[0]}")
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def write_by_date(df: DataFrame, path: str) -> None:
    """Long result tables, one folder per date, replacing only the dates present; a date of many rows is several tasks and files."""
    df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
