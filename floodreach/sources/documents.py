"""GeoJSON, metadata documents, file inventories and annotation files."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import to_lonlat
from ..functions.rounding import half_even
from ..functions.simplify import simplify
from ..params import Grid, Params

# Label names and the question that carries them.
LABELS = {"flooded": 1, "non flooded": 0}
QUESTION = "What is the overall condition of the given image?"


def _lonlat(x, y):
    lon, lat = to_lonlat(x, y)
    return F.array(half_even(lon, 5), half_even(lat, 5))


def to_geojson(df: DataFrame, properties: list[str], simplify_m: float = 0.0) -> DataFrame:
    """One GeoJSON feature per row in ``value``; dates become ISO text, coordinates 5-decimal lon/lat.

    Rows carry either a line in ``geom`` or a point in ``x``, ``y``."""
    if "geom" in df.columns:
        line = simplify(F.col("geom"), simplify_m) if simplify_m else F.col("geom")
        df = df.withColumn("_line", line)
        geometry = F.struct(F.lit("LineString").alias("type"), F.transform("_line", lambda p: _lonlat(p["x"], p["y"])).alias("coordinates"))
    else:
        geometry = F.struct(F.lit("Point").alias("type"), _lonlat(F.col("x"), F.col("y")).alias("coordinates"))
    kinds = dict(df.dtypes)
    props = F.struct(*[(F.date_format(c, "yyyy-MM-dd") if kinds[c] in ("date", "timestamp") else F.col(c)).alias(c) for c in properties])
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str], simplify_m: float = 0.0) -> None:
    """Newline-delimited features, written in parallel."""
    to_geojson(df, properties, simplify_m).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, properties: str, kind: str = "Point") -> DataFrame:
    """Newline-delimited features back to properties plus lon/lat (points) or ``coordinates`` (lines)."""
    coords = "array<double>" if kind == "Point" else "array<array<double>>"
    f = spark.read.schema(f"properties struct<{properties}>, geometry struct<type:string,coordinates:{coords}>").json(path)
    if kind == "Point":
        return f.select("properties.*", F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"))
    return f.select("properties.*", F.col("geometry.coordinates").alias("coordinates"))


def lonlat_box(grid: Grid):
    """[[south, west], [north, east]] of the grid as one column, from its four corners."""
    c = [to_lonlat(F.lit(x), F.lit(y)) for x in (grid.xmin, grid.xmax) for y in (grid.ymin, grid.ymax)]
    lon, lat = [a for a, _ in c], [b for _, b in c]
    return F.array(F.array(F.least(*lat), F.least(*lon)), F.array(F.greatest(*lat), F.greatest(*lon)))


def meta_document(summary: DataFrame, grid: Grid, label: str, p: Params = Params()) -> DataFrame:
    """One-row metadata document built from the coverage table (one row per date)."""
    day = F.date_format("date", "yyyy-MM-dd")
    rows = summary.select(day.alias("d"), "sources", "unknown_pct")
    g = rows.agg(F.sort_array(F.collect_list(F.struct("d", "sources", "unknown_pct"))).alias("r"))
    pick = lambda f: F.map_from_entries(F.transform("r", lambda x: F.struct(x["d"].alias("k"), f(x).alias("v"))))
    return g.select(F.lit(label).alias("data_label"), F.transform("r", lambda x: x["d"]).alias("dates"), pick(lambda x: lonlat_box(grid)).alias("flood_bounds"),
                    pick(lambda x: x["sources"]).alias("sources"), pick(lambda x: x["unknown_pct"]).alias("unknown_pct"), F.lit(p.main_threshold).alias("cut_threshold"),
                    F.lit(p.supply_days).alias("default_supply_days"), F.array(*[F.lit(d) for d in p.supply_days_range]).alias("supply_days_range"),
                    F.lit(p.app_start).alias("app_start"), F.lit(p.app_end).alias("app_end"))


def _stream(url: str):
    """Input stream of a local file, or of any store that Arrow knows by its scheme."""
    from pyarrow import fs
    if urlsplit(url).scheme in ("", "file"):
        return open("/" + url.removeprefix("file:").lstrip("/"), "rb")
    store, path = fs.FileSystem.from_uri(url)
    return store.open_input_stream(path)


def file_inventory(spark: SparkSession, root: str, opener: Callable = _stream, chunk: int = 1 << 20) -> DataFrame:
    """Relative path, SHA-256 and size of every file below ``root``, except manifest.json; ``root`` may be a single file.

    Spark lists paths and lengths and packs the files into tasks by size (hidden ones, starting with "_" or ".", are left out); a task reads its files ``chunk`` bytes at a time, so
    memory does not depend on their size. ``opener`` gives the stream of a path where Arrow does not know the store. A file that
    changes its length while it is read fails the task."""
    def digest(batches):
        for batch in batches:
            sums = []
            for url, length in zip(batch.column("url").to_pylist(), batch.column("bytes").to_pylist()):
                sha, got = hashlib.sha256(), 0
                with opener(url) as stream:
                    while part := stream.read(chunk):
                        sha.update(part)
                        got += len(part)
                if got != length:
                    raise OSError(f"{url}: {got} bytes read of {length}")
                sums.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sums, pa.string()), batch.column("bytes")], names=["path", "sha256", "bytes"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = listed.select("path", "length")
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(name)),) for name in listed.inputFiles()], "path string")  # of what the driver has listed to plan the scan
    files = files.unionByName(names.join(files, "path", "left_anti").withColumn("length", F.lit(0).cast("bigint")))  # a scan leaves empty files out
    inside = F.element_at(F.split("path", "\\Q" + root.rstrip("/") + "/\\E"), -1)
    files = files.filter(~F.col("path").rlike("(^|/)manifest\\.json$")).select(F.col("path").alias("url"), inside.alias("path"), F.col("length").alias("bytes"))
    return files.mapInArrow(digest, "path string, sha256 string, bytes bigint")


def manifest_document(inventory: DataFrame, project: str, label: str, p: Params = Params(), model: DataFrame | None = None) -> DataFrame:
    """Reproducibility document: configuration values and the model's entry (null without one), then one entry per file, as rows of text lines.

    ``model`` is the inventory of a single file."""
    entry = "struct<path:string,sha256:string,bytes:bigint>"
    of_model = F.lit(None).cast(entry) if model is None else model.agg(F.first(F.struct("path", "sha256", "bytes"))).scalar()
    head = F.to_json(F.struct(F.lit(project).alias("project"), F.lit(label).alias("data_label"), of_model.alias("model"), F.struct(
        F.lit(p.grid_res_m).alias("grid_res_m"), F.lit(p.main_threshold).alias("cut_threshold"), F.lit(p.boat_dependent_m).alias("boat_dependent_m"),
        F.lit(p.supply_days).alias("default_supply_days")).alias("configuration")), {"ignoreNullFields": "false"})
    spark = inventory.sparkSession
    return spark.range(1).select(head.alias("value")).unionByName(inventory.select(F.to_json(F.struct("path", "sha256", "bytes")).alias("value")))


def annotations_to_labels(docs: DataFrame) -> DataFrame:
    """(image_id, label) from annotation documents ``(file_name, value)``: the first tag asking the condition question.

    The tag value is a quoted dictionary, read as JSON with single quotes; an unknown label is an error."""
    doc = F.from_json("value", "tags array<struct<name:string,value:string>>")
    t = docs.select(F.regexp_replace(F.regexp_replace("file_name", "\\.json$", ""), "\\.JPG$", "").alias("image_id"), doc["tags"].alias("tags"))
    asked = F.transform(F.filter("tags", lambda x: x["name"] == "question"), lambda x: F.from_json(
        x["value"], "Question string, Ground_Truth string", {"allowSingleQuotes": "true"}))
    hit = F.get(F.filter(asked, lambda q: q["Question"] == QUESTION), F.lit(0))
    t = t.select("image_id", F.lower(F.trim(F.coalesce(hit["Ground_Truth"], F.when(hit.isNotNull(), "")))).alias("name")).filter(F.col("name").isNotNull())
    label = F.lit(None).cast("int")
    for name, value in LABELS.items():
        label = F.when(F.col("name") == name, value).otherwise(label)
    return t.select("image_id", F.when(F.col("name").isin(*LABELS), label).otherwise(F.raise_error(F.concat(F.lit("unsupported label: "), "name")).cast("int")).alias("label"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return annotations_to_labels(docs)


def pair_images(images: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paired samples, annotated ids without an image); both classes must be present among the pairs."""
    paired = images.select("image_id").distinct().join(labels, "image_id")
    classes = paired.agg(F.count_distinct("label").alias("c")).scalar()
    guarded = paired.withColumn("_c", classes).filter(F.when(F.col("_c") < 2, F.raise_error(F.lit("at least one image of each class is required")).cast("boolean")).otherwise(F.lit(True))).drop("_c")
    return guarded, labels.join(images.select("image_id").distinct(), "image_id", "left_anti").select("image_id")
