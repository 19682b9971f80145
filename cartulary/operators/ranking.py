"""Ranks and first rows over whole levels, by ranges instead of one window over all of a level's rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.sources.areas import checkpointed


def ranked(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Adds name: the place of each row in its group by order (which must not tie), from 1.

    Rows are cut into ranges of (group, order), numbered inside each range, and the counts of a group's earlier ranges are
    added: a row per group and range, whatever the size of a group. The ranges are fixed by a checkpoint.
    """
    cut = rows.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*order))
    cut = checkpointed(cut.withColumn("__in", inside))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    met = cut.join(offsets, cut[group].eqNullSafe(offsets["__g"]) & (cut["__part"] == offsets["__p"]))
    return met.withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__part", "__in", "__g", "__p", "__before")
