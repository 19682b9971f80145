"""Derived trees: recipes flattened to rows, countries of sources, roll-ups, rebuilds of a country."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.operators.hierarchy import rolled_up
from cartulary.sources.areas import checkpointed

#: Beginnings of a derived country's name, and the country that its areas come from.
SOURCES = {"spanish_": "spain", "spain_": "spain", "morocco_": "morocco"}


def source_country(country: Column, given: Column) -> Column:
    """The country that a derived one takes its areas from: as given, else by its name's beginning, else itself."""
    found = given
    for start, source in SOURCES.items():
        found = F.coalesce(found, F.when(country.startswith(start), F.lit(source)))
    return F.coalesce(found, country)


def listed(*lists: Column) -> Column:
    """Lists of a recipe joined, each item once, in order."""
    return F.array_distinct(F.concat(*lists))


def tree(recipes: DataFrame, territories: DataFrame, root: DataFrame) -> DataFrame:
    """A derived tree: the root's row, a row per recipe (id, name, parent_id, level, entity_type, territory), and values:
    recipes with a territory take the territory's (territory, pop, area); the others are containers and take the sums of
    what lies below them, containers of containers included."""
    values = territories.select("territory", F.col("pop").alias("pop_latest"), F.col("area").alias("area_km2"))
    rows = recipes.join(values, "territory", "left").withColumn("container", F.col("territory").isNull())
    both = rows.select("id", "name", "parent_id", "level", "entity_type", "pop_latest", "area_km2", "container")
    both = checkpointed(both.unionByName(root.withColumn("container", F.lit(True)), allowMissingColumns=True))  # climbed below
    sums = rolled_up(both, "container").select("id", F.col("pop").alias("__pop"), F.col("area").alias("__area"))
    of = lambda own, summed: F.when(F.col("container"), F.col(summed)).otherwise(F.col(own)).alias(own)
    out = both.join(sums, "id", "left").select("id", "name", "parent_id", "level", "entity_type", of("pop_latest", "__pop"), of("area_km2", "__area"))
    return out.withColumn("density", F.try_divide(F.col("pop_latest").cast("double"), F.nullif(F.col("area_km2"), F.lit(0)).cast("double")))


def rebuilt(nodes: DataFrame, new: DataFrame, country: str, root: str) -> DataFrame:
    """A country's nodes replaced: its root stays, updated where new has it, all other nodes of it go, new ones come
    without seats. Other countries are untouched."""
    cleared = new.withColumn("representatives", F.lit(None).cast("long"))
    kept = nodes.where((F.col("country") != country) | (F.col("id") == root))
    kept = kept.join(cleared.where(F.col("id") == root).select("id"), "id", "left_anti")
    return kept.unionByName(cleared.withColumn("country", F.lit(country)), allowMissingColumns=True)


def links_replaced(links: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A bridge table after the links of each key in new are set to those given there; a null partner clears them."""
    others = links.join(new.select(key).distinct(), key, "left_anti")
    partner = next(c for c in links.columns if c != key)
    return others.unionByName(new.where(F.col(partner).isNotNull()).select(*links.columns).distinct())


def without_country(nodes: DataFrame, country: str) -> DataFrame:
    """All nodes but a country's; those of unknown country stay."""
    return nodes.where(~F.col("country").eqNullSafe(F.lit(country)))
