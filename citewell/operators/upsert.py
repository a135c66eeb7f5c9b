"""Catalog changes as set operations: the old relation and the new rows give the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows only where the key is unknown; the first writer wins."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str, identity: str, order: str) -> DataFrame:
    """All rows of the parents that new rows name go; of new rows with one identity the first stays."""
    place = F.row_number().over(Window.partitionBy(parent, identity).orderBy(order))
    first = new.withColumn("_n", place).filter(F.col("_n") == 1)
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(old.columns).unionByName(first.select(old.columns))


def staged_first(staged: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of both, a staged row in place of a known one."""
    return staged.unionByName(known.join(staged.select(key), key, "left_anti").select(staged.columns))


def page_references(pages: DataFrame) -> DataFrame:
    """ref, page_id: a page is named by its id or its path."""
    return pages.select(F.explode(F.array("page_id", "path")).alias("ref"), "page_id").distinct()
