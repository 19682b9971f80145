"""Configured cities: labels looked up among areas, the parts of a city found, configurations applied in turn.

Areas here are (id, code, name, level, parent_id, entity_type, ...) with an `ordinal`, their place in the given order.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import casefolded
from cartulary.operators import cities
from cartulary.operators.hierarchy import climbed
from cartulary.sources.areas import checkpointed


def matches(asked: DataFrame, areas: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """(by..., label, id, tier): all areas that a label names in its best tier: 1 where it is an id, code or name as
    written, else 2 where it is one in normal form. `by` are columns that asked and areas share, such as a level.

    Each area lends its at most six keys to one equi-join with the labels; nothing is compared all with all. Labels that
    are `few`, as those of configurations, go to the areas.
    """
    names = F.array_distinct(F.array("id", "code", "name"))
    norms = F.array_distinct(F.transform(F.array("id", "code", "name"), casefolded))
    keyed = lambda keys, tier: areas.select(*by, "id", F.explode(keys).alias("key"), F.lit(tier).alias("tier"))
    known = keyed(names, 1).unionByName(keyed(norms, 2)).where("key IS NOT NULL")
    labels = asked.select(*by, "label").distinct()
    wanted = labels.withColumns({"key": F.col("label"), "tier": F.lit(1)}).unionByName(labels.withColumns({"key": casefolded(F.col("label")), "tier": F.lit(2)}))
    hits = known.join(F.broadcast(wanted) if few else wanted, [*by, "key", "tier"]).select(*by, "label", "id", "tier").distinct()
    best = hits.groupBy(*by, "label").agg(F.min("tier").alias("tier"))
    return hits.join(best, [*by, "label", "tier"]).select(*by, "label", "id", "tier")


def first_match(asked: DataFrame, areas: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, id): of the areas that match in the best tier the first in the given order."""
    hits = matches(asked, areas, by).join(areas.select("id", "ordinal"), "id")
    return hits.groupBy(*by, "label").agg(F.min_by("id", "ordinal").alias("id"))


def named(asked: DataFrame, areas: DataFrame, by: list[str], *keep: str) -> DataFrame:
    """first_match with columns of the area to keep, for labels of configurations: these are few and go to the areas, of
    which only those are taken apart that share `by` with one. Equal places are told apart by id."""
    labels = asked.select(*by, "label").distinct()
    wanted = labels.withColumns({"key": F.col("label"), "tier": F.lit(1)}).unionByName(labels.withColumns({"key": casefolded(F.col("label")), "tier": F.lit(2)}))
    near = areas.join(F.broadcast(labels.select(*by).distinct()), by, "left_semi")
    keys = lambda tier, *of: [F.struct(k.alias("key"), F.lit(tier).alias("tier")) for k in of]
    own = [F.col(c) for c in ("id", "code", "name")]
    known = near.select(*by, "id", "ordinal", *keep, F.inline(F.array(*keys(1, *own), *keys(2, *map(casefolded, own)))))
    best = known.join(F.broadcast(wanted), [*by, "key", "tier"]).groupBy(*by, "label").agg(F.min_by(F.struct("id", *keep), F.struct("tier", "ordinal", "id")).alias("best"))
    return best.select(*by, "label", "best.*")


def of_types(entity_type: Column, types: Column) -> Column:
    """Whether a type is among types in normal form; an empty list means all."""
    return (F.size(types) == 0) | F.array_contains(F.transform(types, casefolded), casefolded(entity_type))


def nearest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key's rows those at the smallest level."""
    least = rows.groupBy(key).agg(F.min("level").alias("level"))
    return rows.join(least, [key, "level"])


def districts(areas: DataFrame, configs: DataFrame) -> DataFrame:
    """(city, id) of configs (city, from_id, types), a row for each area that a city is made from: the areas strictly
    below one of them, of the city's types, not the city itself, at the smallest level where there are any."""
    up = climbed(areas, "level").select(F.col("node").alias("id"), F.explode(F.filter("steps", lambda s: s["dist"] > 0)).alias("s"))
    below = up.select("id", F.col("s.id").alias("from_id"), F.col("s.level").alias("from_level")).join(configs, "from_id")
    rows = below.join(areas.select("id", "level", "entity_type"), "id").where((F.col("level") > F.col("from_level")) & of_types(F.col("entity_type"), F.col("types")) & (F.col("id") != F.col("city")))
    return nearest(rows.select("city", "id", "level").distinct(), "city").select("city", "id")


def communes(asked: DataFrame, areas: DataFrame, configs: DataFrame, few: bool = False) -> DataFrame:
    """(city, label, id) of asked (city, label), configs (city, city_level, from_id, and types where only areas of these
    count): of the children that a label names that of an area the city is made from, at the deepest level up to the
    city's; else a child of the city itself. `few`: what is asked and the configs are broadcast."""
    put = F.broadcast if few else lambda rows: rows
    own = areas.select("id", "code", "name", "level", "ordinal", "parent_id", "entity_type")
    configs = configs if "types" in configs.columns else configs.withColumn("types", F.array().cast("array<string>"))
    parents = configs.select("city", "city_level", "types", F.col("from_id").alias("parent_id")).join(areas.select(F.col("id").alias("parent_id"), F.col("level").alias("above")), "parent_id")
    children = own.join(put(parents), "parent_id").where("level = above + 1 AND id <> city").withColumn("kind", F.lit(0))
    inner = own.join(put(configs.select("city", "city_level", "types", F.col("city").alias("parent_id")).distinct()), "parent_id").where("level = city_level + 1").withColumn("kind", F.lit(1))
    children, inner = (rows.where(of_types(F.col("entity_type"), F.col("types"))) for rows in (children, inner))
    columns = ["city", "city_level", "id", "code", "name", "level", "ordinal", "kind"]
    candidates = checkpointed(children.select(*columns).unionByName(inner.select(*columns)))  # read three times
    hits = matches(asked, candidates, ["city"], few).join(candidates, ["city", "id"]).where("kind = 1 OR level <= city_level")
    return hits.groupBy("city", "label").agg(F.min_by("id", F.struct("kind", -F.col("level"), "ordinal")).alias("id"))


def folded(areas: DataFrame, steps: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The tree after each configuration in turn, given as (communes, cities) for cities.rewritten: a later one sees the
    cities of those before it. The list of configurations is written by hand, so the plan stays short."""
    for parts, towns in steps:
        areas = cities.rewritten(areas, parts, towns)
    return areas
