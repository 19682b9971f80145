"""Exports: path reports whose repeated cells are blank, totals, and text files."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shown_once(rows: DataFrame, order: str, keys: list[str], blocks: dict[str, list[str]], heads: list[str]) -> DataFrame:
    """Rows with the columns of each key blank but on the key's first row by `order` (unique), and the columns `heads`
    blank but on the very first row. A key's rows must follow one another. First rows come from aggregates."""
    out = rows
    for key in keys:
        first = rows.groupBy(key).agg(F.min(order).alias(f"__{key}"))
        out = out.join(first, key, "left")  # paths may be shorter than the deepest
    top = rows.agg(F.min(order)).first()[0]
    columns = []
    for c in rows.columns:
        key = next((k for k in keys if c in blocks[k]), None)
        if c in heads:
            columns.append(F.when(F.col(order) == F.lit(top), F.col(c)).alias(c))
        elif key is not None:
            columns.append(F.when(F.col(order) == F.col(f"__{key}"), F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def country_totals(areas: DataFrame, level: int) -> DataFrame:
    """One row (area, pop): sums of the areas one level below the root only."""
    return areas.where(F.col("level") == level).agg(F.sum("area_km2").alias("area"), F.sum("pop_latest").alias("pop"))


def subdivisions(areas: DataFrame, units: DataFrame) -> DataFrame:
    """(id, n): how many children an area has, else of how many source units (id, units) it is made; null for none."""
    children = areas.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    out = areas.select("id").join(children, "id", "left").join(units, "id", "left")
    return out.select("id", F.coalesce("children", F.nullif(F.col("units"), F.lit(0))).alias("n"))


def scan(areas: DataFrame, root: str, capitals: DataFrame, places: DataFrame, units: DataFrame, most: int | None = None) -> DataFrame:
    """What an export reads of a country in one scan: the root and its areas down to level `most`, with `capitals`, an
    array<struct<name, id, pop>> by name, `city`, the most populated place as such a struct, and `units`, how many source
    areas it is made of.

    capitals (area, id), places (area, id) and units (area, id) are links; areas (country, id, code, name, level,
    parent_id, pop_latest, ...). Rows aren't sorted: order by level and code is the reader's.
    """
    level = areas.where(F.col("id") == root).select("level").first()
    wanted = areas.where((F.col("id") == root) | (F.col("country") == root) & (F.col("level") > (level[0] if level else 0)))
    wanted = wanted.where(F.col("level") <= most) if most is not None else wanted
    about = areas.select("id", F.struct("name", "id", F.col("pop_latest").alias("pop")).alias("place"))
    asked = wanted.select(F.col("id").alias("area"))
    held = capitals.join(asked, "area", "left_semi").distinct().join(about, "id").groupBy("area").agg(F.array_sort(F.collect_list("place")).alias("capitals"))
    city = places.join(asked, "area", "left_semi").join(about, "id").groupBy("area").agg(F.min("place").alias("city"))
    number = units.join(asked, "area", "left_semi").groupBy("area").agg(F.count("*").alias("units"))
    out = wanted
    for links in (held, city, number):
        out = out.join(links.withColumnRenamed("area", "id"), "id", "left")
    none = F.array().cast("array<struct<name string, id string, pop long>>")
    return out.withColumns({"capitals": F.coalesce("capitals", none), "units": F.coalesce("units", F.lit(0).cast("long"))})


def stamped(country: str, at: datetime) -> str:
    """Name of a country's export."""
    return f"{country}_{at:%Y%m%d_%H%M%S}.csv"


def write_export(report: DataFrame, folder: str, country: str, at: datetime, order: list[str], *, rows: int = 1_000_000) -> str:
    """Writes a country's report, in order, as semicolon-separated parts of at most `rows` rows under its stamped name,
    which is returned; part names sort like the rows."""
    path = f"{folder.rstrip('/')}/{stamped(country, at)}"
    report.orderBy(*order).write.option("sep", ";").option("header", True).option("encoding", "UTF-8").option("maxRecordsPerFile", rows).csv(path)
    return path
