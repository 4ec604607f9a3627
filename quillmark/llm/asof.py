"""As-of joins that need no whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import OWN


def latest_earlier(rows: DataFrame, keys: list[str], at: str, offered: Column, taken: Column, out: str, partitions: int | None = None) -> DataFrame:
    """The rows where `taken`, with `out`: the latest `offered` struct of an earlier row of the same keys.

    offered is a struct whose first field is `at` (or null where the row offers
    nothing); earlier means a smaller `at`, a whole number. Rows are cut into
    cells, the ranges of (keys, at) of a range partitioning, which hold about as
    many rows each, and are written once so: a running maximum within each cell,
    and one over the cells' maxima, so that a hot key's rows are spread over
    tasks whatever the unit of `at`. Rows of one key and `at` are in one cell.
    """
    cell, own = OWN + "cell", OWN + "offer"
    order = [F.col(k) for k in (*keys, at)]
    rows = rows.withColumn(own, offered)
    rows = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    rows = common.written(rows.withColumn(cell, F.spark_partition_id()), "asof")
    within = Window.partitionBy(*keys, cell).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, cell).agg(F.max(own).alias(own), F.min(at).alias(at))
    # Each cell gets the maximum of all cells before it; a key has at most as many cells as there are partitions.
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cells = tops.withColumn(OWN + "carried", F.max(own).over(before)).drop(own, at)
    inside = rows.withColumn(out, F.max(own).over(within)).where(taken)
    return inside.join(cells, [*keys, cell], "left").withColumn(out, F.coalesce(out, OWN + "carried")).drop(cell, own, OWN + "carried")
