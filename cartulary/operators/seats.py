"""Proportional seats: D'Hondt with minimum and maximum per area."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.sources.areas import checkpointed

#: Points of the grid on which a pass narrows the last winning quotient, passes, and slack for floating point.
GRID, PASSES, SLACK = 16, 3, 1e-9


def habitant_total(areas: DataFrame, habitant: int) -> DataFrame:
    """One row (total): the seats that one per `habitant` inhabitants, rounded up in each area, make."""
    return areas.agg(F.sum(F.ceil(F.greatest(F.coalesce("pop_latest", F.lit(0)), F.lit(0)) / habitant)).cast("long").alias("total"))


def dhondt(areas: DataFrame, group: str, total: Column, minimum: Column, maximum: Column | None = None) -> DataFrame:
    """(group, code, seats) of areas (group, code, pop_latest): in every group, total seats.

    Each area starts at its minimum; the others go one by one to the largest population / (seats + 1), ties to the
    lowest code, up to the maximum. As quotients: a group's seats beyond its minima are its largest quotients. The last
    one that wins is bracketed by PASSES aggregates, and only quotients inside the bracket become rows, so work doesn't
    grow with the seats. A group whose minima exceed its total fails.
    """
    rows = areas.select(group, "code", F.greatest(F.coalesce("pop_latest", F.lit(0)), F.lit(0)).cast("double").alias("pop"), total.alias("total"), minimum.alias("low"), (maximum if maximum is not None else F.lit(None).cast("int")).alias("high"))
    sums = rows.groupBy(group).agg((F.first("total") - F.sum("low")).alias("rest"), F.max("pop").alias("hi"), F.min(F.when(F.col("pop") > 0, F.col("pop"))).alias("least"), F.max("low").alias("lows"))
    sums = sums.withColumn("rest", F.when(F.col("rest") < 0, F.raise_error(F.concat(F.lit("minima exceed the total of "), F.col(group).cast("string"))).cast("long")).otherwise(F.col("rest")))
    bounds = sums.select(group, "rest", (F.col("hi") * 1.001).alias("hi"), (F.col("least") / (F.col("lows") + F.col("rest") + 1)).alias("lo"))
    rows = rows.join(bounds.select(group, "rest"), group)
    rows = rows.withColumn("most", F.least(F.col("rest"), F.greatest(F.coalesce(F.col("high") - F.col("low"), F.col("rest")), F.lit(0))))
    for _ in range(PASSES):
        bounds = narrowed(rows, bounds, group)
    bounds = checkpointed(bounds)  # a row per group, used several times
    # quotients above the upper bound win; those between the bounds are few, and are ordered
    at = rows.join(bounds.drop("rest"), group).withColumns({"sure": F.coalesce(won_at(F.col("hi") * (1 + SLACK)), F.lit(0)), "upto": F.coalesce(won_at(F.col("lo") * (1 - SLACK)), F.col("most"))})
    at = at.withColumn("sure", F.least("sure", "upto"))
    left = at.groupBy(group).agg((F.first("rest") - F.sum("sure")).alias("left"))
    quotients = at.where("upto > sure").withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("upto"))))
    place = F.row_number().over(Window.partitionBy(group).orderBy((F.col("pop") / (F.col("low") + F.col("k"))).desc(), "code", "k"))
    won = quotients.join(left, group).withColumn("place", place).where("place <= left").groupBy(group, "code").agg(F.count("*").alias("won"))
    return at.join(won, [group, "code"], "left").select(group, "code", (F.col("low") + F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("seats"))


def won_at(quotient: Column) -> Column:
    """Seats beyond its minimum that an area wins while quotients down to this one win; null without a quotient."""
    return F.when(quotient > 0, F.least(F.col("most"), F.greatest(F.floor(F.try_divide(F.col("pop"), quotient)) - F.col("low"), F.lit(0)))).cast("long")


def narrowed(rows: DataFrame, bounds: DataFrame, group: str) -> DataFrame:
    """Bounds (group, rest, hi, lo) of the last quotient that wins, narrowed to a step of a grid: one aggregate over all
    areas, for all groups at once. At hi fewer than rest win; at lo at least so many, or lo is null: quotients of 0 win."""
    grid = lambda j: F.col("hi") * F.pow(F.try_divide("lo", "hi"), F.lit(j / GRID))
    at = rows.drop("rest").join(bounds, group).groupBy(group).agg(F.first("rest").alias("rest"), F.first("hi").alias("hi"), F.first("lo").alias("lo"), F.array(*(F.sum(won_at(grid(j))) for j in range(GRID + 1))).alias("n"))
    first = F.get(F.filter(F.sequence(F.lit(0), F.lit(GRID)), lambda j: F.get("n", j) >= F.col("rest")), F.lit(0))
    near = lambda j: F.col("hi") * F.pow(F.try_divide("lo", "hi"), j / GRID)
    found = at.withColumn("j", first)
    hi = F.when(F.col("lo").isNull(), F.col("hi")).when(F.col("j").isNull(), F.col("lo")).when(F.col("j") > 0, near(F.col("j") - 1)).otherwise(F.col("hi"))
    lo = F.when(F.col("j").isNotNull(), near(F.col("j")))
    return found.select(group, "rest", hi.alias("hi"), lo.alias("lo"))
