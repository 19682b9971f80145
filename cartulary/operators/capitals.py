"""Capitals: maps of capitals validated against the tree, lookups by label, changes of pointers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.hierarchy import climbed


def valid(named: DataFrame, areas: DataFrame) -> DataFrame:
    """The rows of named (area, capital) whose capital exists and is the area or lies below it."""
    up = climbed(areas).select(F.col("node").alias("capital"), F.explode("steps.id").alias("area"))
    return named.distinct().join(up, ["area", "capital"], "left_semi")


def replaced(current: DataFrame, named: DataFrame, areas: DataFrame) -> DataFrame:
    """(area, capitals, changed): what each named area of the tree has afterwards, and whether that set is another one."""
    of = lambda rows, name: rows.groupBy("area").agg(F.sort_array(F.collect_set("capital")).alias(name))
    none = F.array().cast("array<string>")
    asked = named.select("area").distinct().join(areas.select(F.col("id").alias("area")), "area")
    out = asked.join(of(valid(named, areas), "capitals"), "area", "left").join(of(current, "before"), "area", "left")
    return out.select("area", F.coalesce("capitals", none).alias("capitals"), (F.coalesce("capitals", none) != F.coalesce("before", none)).alias("changed"))


def container_capitals(asked: DataFrame, areas: DataFrame) -> DataFrame:
    """(container, label, id) of asked (container, label, country, place): the first of the container's countries that
    has an area at its legal level (all levels where it has none) with that name in any case, else with that code."""
    keyed = lambda column, tier: areas.where("legal_level IS NULL OR level = legal_level").select("country", "id", F.lower(column).alias("key"), F.lit(tier).alias("tier"))
    known = keyed("name", 1).unionByName(keyed("code", 2)).where("key IS NOT NULL")
    hits = asked.withColumn("key", F.lower("label")).where("key <> ''").join(known, ["country", "key"])
    return hits.groupBy("container", "label").agg(F.min_by("id", F.struct("place", "tier", "id")).alias("id"))


def spec_capitals(asked: DataFrame, legal: DataFrame, members: DataFrame, macros: DataFrame, areas: DataFrame) -> DataFrame:
    """(territory, label, id) of asked (territory, label): a candidate at the legal level, legal (label, id), counts if
    one of the territory's members is it or lies below it, or if it is one of the territory's macro areas; else a member
    of that name; else a macro area of that name. A label found nowhere fails."""
    named = areas.select("id", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("code")))).alias("key"))
    by_name = asked.withColumn("key", F.lower(F.trim("label"))).join(named.hint("merge"), "key").select("territory", "label", "id")
    at_legal = asked.join(legal.hint("merge"), "label").select("territory", "label", "id")
    # Members climb to candidates alone, and are read once, past a hash table of areas instead of sorted
    candidates = at_legal.unionByName(by_name).select("territory", "id").distinct()
    up = climbed(areas).select(F.col("node").alias("member"), F.explode("steps").alias("s")).select("member", F.col("s.id").alias("id"), F.col("s.dist").alias("dist"))
    up = up.join(candidates.select("id").distinct(), "id", "left_semi")
    held = members.select("territory", F.col("id").alias("member")).join(up.hint("shuffle_hash"), "member").groupBy("territory", "id").agg(F.min("dist").alias("dist"))
    good = held.select("territory", "id").unionByName(macros.select("territory", "id")).distinct()
    tiers = [at_legal.join(good, ["territory", "id"], "left_semi"), by_name.join(held.where("dist = 0"), ["territory", "id"], "left_semi"), by_name.join(macros, ["territory", "id"], "left_semi")]
    hits = None
    for place, rows in enumerate(tiers):
        rows = rows.select("territory", "label", "id", F.lit(place).alias("place"))
        hits = rows if hits is None else hits.unionByName(rows)
    found = hits.groupBy("territory", "label").agg(F.min_by("id", F.struct("place", "id")).alias("id"))
    missing: Column = F.raise_error(F.concat(F.lit("capital outside its territory: "), F.col("label"))).cast("string")
    return asked.join(found, ["territory", "label"], "left").select("territory", "label", F.coalesce("id", missing).alias("id"))


def pointer_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where new has another value than old, nulls compared; absent rows don't change."""
    before = old.select(key, F.col(value).alias("__before"))
    return new.join(before, key).where(~F.col(value).eqNullSafe(F.col("__before"))).select(key, value)
