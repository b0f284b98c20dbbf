"""Flood-access analytics on PySpark: which settlements can still reach a shelter by road, and when."""
from .params import DRY, FLOODED, UNKNOWN, Grid, Params

__all__ = ["DRY", "FLOODED", "UNKNOWN", "Grid", "Params"]
