"""Removing rows by a list of keys without moving the texts where the list is short."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 1 << 18  # of under 100 bytes each; a longer list is joined by a shuffle


def without(docs: DataFrame, keys: DataFrame, same: Column) -> DataFrame:
    """``docs`` less the rows for which ``same`` finds a key. ``keys`` is a written table, so counting it reads only its footers."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, same, "left_anti")


def same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Whether a key (_doc, _key) names the row: its id and the hash of its text."""
    return docs["doc_id"].eqNullSafe(keys["_doc"]) & (F.xxhash64(docs["text"]) == keys["_key"])
