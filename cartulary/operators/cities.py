"""Cities made of several areas: one row in their place, and the areas moved below it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.hierarchy import closure


def city_rows(areas: DataFrame, communes: DataFrame, cities: DataFrame) -> DataFrame:
    """A row for each of cities (city, name, level, parent_id, entity_type) out of its communes (city, id): population
    with unknown as 0, known areas to two places (null if none is known), inhabitants a square kilometre."""
    sums = communes.distinct().join(areas, "id").groupBy("city").agg(F.coalesce(F.sum("pop_latest"), F.lit(0)).alias("pop_latest"), F.round(F.sum("area_km2"), 2).alias("area_km2"))
    density = F.try_divide(F.col("pop_latest").cast("double"), F.nullif(F.col("area_km2"), F.lit(0)).cast("double"))
    return cities.join(sums, "city").select(F.col("city").alias("id"), "name", "level", "parent_id", "entity_type", "pop_latest", "area_km2", density.alias("density"))


def collapsed(areas: DataFrame, communes: DataFrame, cities: DataFrame) -> DataFrame:
    """As city_rows, with the latest date and census year of the communes, for areas that have them; a city without any
    commune has no inhabitants and no area."""
    return summed(communes.distinct().join(areas, "id"), cities)


def summed(communes: DataFrame, cities: DataFrame) -> DataFrame:
    """As collapsed, of communes that are areas with the city of each."""
    sums = communes.groupBy("city").agg(F.sum("pop_latest").alias("pop"), F.round(F.sum("area_km2"), 2).cast(communes.schema["area_km2"].dataType).alias("area_km2"), F.max("pop_latest_date").alias("pop_latest_date"), F.max("last_census_year").alias("last_census_year"))
    rows = cities.join(sums, "city", "left").withColumn("pop_latest", F.coalesce("pop", F.lit(0)))
    return rows.select(F.col("city").alias("id"), "name", "level", "parent_id", "entity_type", "pop_latest", "area_km2", "pop_latest_date", "last_census_year")


def shifts(areas: DataFrame, communes: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, shift): levels that communes move down to stand below their city, and their descendants with the nearest."""
    depth = cities.select("city", F.col("level").alias("city_level"))
    moved = communes.distinct().join(depth, "city").join(areas.select("id", "level"), "id").select(F.col("id").alias("ancestor"), (F.col("city_level") + 1 - F.col("level")).alias("shift"))
    return closure(areas).join(moved, "ancestor").groupBy(F.col("node").alias("id")).agg(F.min_by("shift", "dist").alias("shift"))


def rewritten(areas: DataFrame, communes: DataFrame, cities: DataFrame) -> DataFrame:
    """The tree with cities: old rows of a city's id go, its communes hang on it, and all below them shift along.

    A commune listed for two cities hangs on the one with the lowest id.
    """
    communes = communes.groupBy("id").agg(F.min("city").alias("city"))
    new = city_rows(areas, communes, cities)
    kept = areas.join(cities.select(F.col("city").alias("id")), "id", "left_anti")
    placed = kept.join(communes, "id", "left").join(shifts(areas, communes, cities), "id", "left")
    density = F.try_divide(F.col("pop_latest").cast("double"), F.nullif(F.col("area_km2"), F.lit(0)).cast("double"))
    old = placed.select("id", "name", (F.col("level") + F.coalesce("shift", F.lit(0))).alias("level"), F.coalesce("city", "parent_id").alias("parent_id"), "entity_type", "pop_latest", "area_km2", density.alias("density"))
    return old.unionByName(new)


def latest(rows: DataFrame, key: str, date: str, year: str) -> DataFrame:
    """(key, date, year): the latest known date and census year of each key's rows, null where none is known."""
    return rows.groupBy(key).agg(F.max(date).alias(date), F.max(year).alias(year))
