"""Shared helpers of the training-data operators: column hygiene and the contract's word rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.sources.shared import Stored

__all__ = ["WORD_SPLIT", "Stored", "col", "pick", "release", "settled", "table"]

#: Fixed value of the task contract: a word is a run of anything but ASCII white space.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters or dots the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Projects ``new=old`` columns only, so extra columns of the input cannot clash with internal ones."""
    return df.select(*[col(df, old).alias(new) for new, old in names.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Plan nodes under which every read of a file gives the same rows to the same task.
_STEADY = {"Project", "Filter", "LogicalRelation", "LocalRelation", "SubqueryAlias", "DataSourceV2ScanRelation"}


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain scan, else its rows written once: operators that read their input twice need the same rows in the same tasks."""
    plan = df._jdf.queryExecution().optimizedPlan()
    steady = df._jdf.queryExecution().analyzed().deterministic() and plan.deterministic()
    while steady:
        steady = plan.nodeName().split(" ")[0] in _STEADY
        children = plan.children()
        if children.size() == 0:
            break
        plan, steady = children.apply(0), steady and children.size() == 1
    return df if steady else Stored(df, "settled").df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, instead of at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
