"""Row numbers within groups that may hold any share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.sources.shared import Stored


def row_numbers(df: DataFrame, group: str, order: list[Column], name: str, range_name: str | None = None) -> DataFrame:
    """Adds 1, 2, ... by ``order`` within the group; rows that tie in all of it are numbered in any order. ``range_name`` keeps the
    number of the row's range: within a group, ranges rise with the rows' numbers.

    Rows are dealt by ranges of group and order, so a large group lies in several partitions; each numbers its own rows,
    and the group's rows in the partitions before are added. Written once, so that a row's partition is settled.
    """
    part, key = "__part", "__group"
    ranged = Stored(df.repartitionByRange(F.col(group), *order).withColumn(part, F.spark_partition_id()), "ranged").df
    counts = ranged.groupBy(F.col(group).alias(key), part).agg(F.count("*").alias("__n"))
    base = counts.select(key, F.col(part).alias("__at"), (F.sum("__n").over(W.partitionBy(key).orderBy(part)) - F.col("__n")).alias("__base"))
    inside = F.row_number().over(W.partitionBy(group, part).orderBy(*order))
    on = reduce(lambda a, b: a & b, [F.col(group).eqNullSafe(F.col(key)), F.col(part) == F.col("__at")])
    return ranged.withColumn("__inside", inside).join(base, on).withColumn(name, (F.col("__base") + F.col("__inside")).cast("int")).select(*[c for c in df.columns if c != name], name, *([F.col(part).alias(range_name)] if range_name else []))
