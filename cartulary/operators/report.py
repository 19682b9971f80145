"""Wide path reports: a row per leaf, a block of columns per level."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import percentage
from cartulary.operators.export import shown_once
from cartulary.operators.hierarchy import climbed, first_step, seat_totals
from cartulary.operators.ranking import ranked

FIELDS = ("id", "name", "pop", "area", "rank_pop", "rank_area", "pct_level", "pct_parent", "seats")


def blocks(areas: DataFrame, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, level, block): what a report says of each area. Unknown values rank as 0; ties go by the columns `ties`."""
    sums = areas.groupBy("level").agg(F.sum("pop_latest").alias("level_pop"))
    parents = areas.select(F.col("id").alias("parent_id"), F.col("pop_latest").alias("parent_pop"))
    rows = areas.join(sums, "level").join(parents, "parent_id", "left").join(seat_totals(areas), "id")
    for name, value in (("rank_pop", "pop_latest"), ("rank_area", "area_km2")):
        rows = ranked(rows, "level", [F.coalesce(value, F.lit(0)).desc(), *map(F.col, ties)], name)
    values = (F.col("id"), F.col("name"), F.col("pop_latest"), F.col("area_km2").cast("double"), F.col("rank_pop"), F.col("rank_area"), percentage(F.col("pop_latest"), F.col("level_pop")), percentage(F.col("pop_latest"), F.col("parent_pop")), F.nullif(F.col("total"), F.lit(0)))
    return rows.select("id", "parent_id", "level", F.struct(*(v.alias(f) for v, f in zip(values, FIELDS, strict=True))).alias("block"))


def levels_below_root(areas: DataFrame) -> range:
    """The levels of a tree below its root: one aggregate says how many blocks a report has."""
    found = areas.agg(F.min("level").alias("first"), F.max("level").alias("last")).first()
    return range(0) if found["first"] is None else range(found["first"] + 1, found["last"] + 1)


def shown_report(areas: DataFrame, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """(path, leaf, root, root_pop, L<n>_<field> ...): a path_report of all levels that the tree has, in which an area's
    block stands on the first row of its leaves by path, and the root's cells on the very first."""
    levels = levels_below_root(areas)
    rows = path_report(areas, levels, ties)
    rows = rows.withColumn("path", F.concat_ws(">", *(f"L{n}_id" for n in levels)))
    keys = [f"L{n}_id" for n in levels[:-1]]
    out = shown_once(rows, "path", keys, {f"L{n}_id": [f"L{n}_{f}" for f in FIELDS] for n in levels[:-1]}, ["root", "root_pop"])
    return out.select("path", "leaf", "root", "root_pop", *(f"L{n}_{f}" for n in levels for f in FIELDS))


def path_report(areas: DataFrame, levels: range, ties: tuple[str, ...] = ("id",)) -> DataFrame:
    """(leaf, root, root_pop, L<n>_<field> ...): leaves whose root is missing have no row; levels off a path are null."""
    told = blocks(areas, ties)
    parents = areas.select(F.col("parent_id").alias("leaf")).where("leaf IS NOT NULL").distinct()
    up = climbed(told, "level", "block").withColumnRenamed("node", "leaf").join(parents, "leaf", "left_anti")
    of = lambda n: first_step("steps", lambda s: s["level"] == n)["block"].alias(f"L{n}")
    wide = up.select("leaf", *(of(n) for n in (0, *levels)))
    shown = [F.col(f"L{n}.{f}").alias(f"L{n}_{f}") for n in levels for f in FIELDS]
    return wide.where("L0 IS NOT NULL").select("leaf", F.col("L0.name").alias("root"), F.col("L0.pop").alias("root_pop"), *shown)
