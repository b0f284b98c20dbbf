"""The same daily rain and manifest upsert, fed by streams."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..params import Params
from ..sources.tables import register_flood_maps


def rain_stream(rain: DataFrame, lateness: str = "6 hours", step_hours: float = 0.5, p: Params = Params()) -> DataFrame:
    """Local-day rain per box and cell over a stream of half-hourly rates; state is dropped once a day is past the watermark.

    Box averages follow from these rows with one batch aggregation (`operators.rain.daily_rain` does both at once)."""
    start = f"{(24 - p.utc_offset_hours) % 24} hours"
    g = (rain.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day", "1 day", start).alias("w"), "box", "cell")
         .agg((F.sum("mm_per_h") * F.lit(step_hours)).alias("mm")))
    return g.select(F.to_date(F.col("w.start") + F.expr(f"interval {p.utc_offset_hours} hours")).alias("date"), "box", "cell", "mm")


def register_stream(cells: DataFrame, root: str, checkpoint: str, p: Params = Params()):
    """Register arriving flood maps (date, source, row, col, value, note) batch by batch; a replayed batch rewrites the same partitions.

    A map must arrive within one batch, because its (date, source) partition is replaced as a whole."""
    def upsert(batch: DataFrame, _: int) -> None:
        batch.persist()
        notes = batch.groupBy("date", "source").agg(F.max("note").alias("note"))
        register_flood_maps(batch.drop("note"), notes, root, p)
        batch.unpersist()

    return cells.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
