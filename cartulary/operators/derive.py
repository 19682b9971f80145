"""Derived countries as a program: recipes checked as a whole, labels resolved, territories computed, trees built.

All that is wrong comes out as rows before the algebra runs; countries with a violation are left out of the tree, others
are built. Sources of a specification are taken in order of their names, since objects don't keep theirs.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators import build, labels, territory
from cartulary.sources import recipes
from cartulary.sources.areas import checkpointed

RULES = ("no atomic level", "no area of this label", "below the atomic level", "no units", "capital outside the territory")


@dataclass
class Derived:
    """tree (id, country, code, name, parent_id, level, entity_type, pop_latest, area_km2, density, capitals,
    most_populated), members (territory, id), violations (country, path, code, rule, label)."""

    tree: DataFrame
    members: DataFrame
    violations: DataFrame


def resolved(asked: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows of recipes.labels with the id of the area that each names in its source country and level, null for none."""
    found = labels.resolve(asked.select("source", "level", "label").distinct(), areas, ("source", "level")).select("source", "level", "label", "id")
    return asked.join(found.hint("merge"), ["source", "level", "label"], "left")


def among_members(asked: DataFrame, hits: DataFrame, own: territory.Held) -> DataFrame:
    """(territory, label, tier, depth, id) of asked (territory, label): the hits (label, tier, depth, id) that are members
    of the territory. Both sides meet by label and included area, so hits elsewhere make no rows."""
    placed = hits.withColumnRenamed("id", "node").join(own.nodes.hint("merge"), "node")
    parts = asked.select("territory", "label").join(own.parts.select("territory", "id").hint("merge"), "territory")
    met = territory.members_of(parts.join(placed.hint("merge"), ["label", "id"]), own, "label", "tier", "depth")
    return met.withColumnRenamed("node", "id").select("territory", "label", "tier", "depth", "id")


def capitals(asked: DataFrame, spec: DataFrame, own: territory.Held, areas: DataFrame, legal: DataFrame) -> DataFrame:
    """(territory, label, id, place) of asked (territory, label), id null for a label that no tier finds.

    Tiers: an area of a source country's legal level (legal: source, legal_level) that is a member, or has one below it,
    or is a macro area; a member; a macro area (an included one above the atomic level). Labels are resolved among the
    areas of each tier: for the first among all of the legal level, so that a like-named area elsewhere hides no member.
    """
    sources = spec.select("territory", "source").distinct()
    at_legal = areas.join(F.broadcast(legal), "source").where("level = legal_level")
    first = labels.resolve(asked.join(sources, "territory").select("source", "label"), at_legal, ("source",)).select("source", "label", "id")
    macros = spec.where("sign = 'include' AND level < atomic").select("territory", "id").distinct()
    wanted = checkpointed(asked.join(sources, "territory").join(first.hint("merge"), ["source", "label"]).select("territory", "label", "source", "id"))
    inside = territory.holding(wanted, own, areas).unionByName(macros)
    one = checkpointed(wanted.join(inside.hint("merge"), ["territory", "id"], "left_semi").select("territory", "label", "id", F.lit(0).alias("place"), "source"))
    rest = checkpointed(asked.join(one.hint("merge"), ["territory", "label"], "left_anti"))
    two = labels.equals(rest.select("label").distinct(), areas, [])
    two = checkpointed(among_members(rest, two, own))
    rest = checkpointed(rest.join(two.hint("merge"), ["territory", "label"], "left_anti"))
    if not rest.isEmpty():
        two = two.unionByName(among_members(rest, labels.contained(rest.select("label").distinct(), areas, []), own))
    two = two.groupBy("territory", "label").agg(F.min(F.struct("tier", "depth", "id"))["id"].alias("id"))
    tiers = [one, two.withColumns({"place": F.lit(1), "source": F.lit("")})]
    some = areas.join(macros.join(rest.select("territory").distinct(), "territory", "left_semi").hint("merge"), "id")
    tiers.append(labels.resolve(rest, some, ("territory",)).select("territory", "label", "id", F.lit(2).alias("place"), F.lit("").alias("source")))
    every = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    best = every.groupBy("territory", "label").agg(F.min(F.struct("place", "source", "id")).alias("best"))
    return asked.join(best.hint("merge"), ["territory", "label"], "left").select("territory", "label", "best.id", "best.place")


def largest(among: DataFrame, areas: DataFrame) -> DataFrame:
    """(territory, most_populated): the area with the largest known population, then the lowest id."""
    known = among.join(areas.where("pop_latest IS NOT NULL").select("id", "pop_latest"), "id")
    return known.groupBy("territory").agg(F.min_by("id", F.struct(-F.col("pop_latest"), "id")).alias("most_populated"))


def derived(texts: DataFrame, areas: DataFrame, atomic: DataFrame, legal: DataFrame, prefix: str = "") -> Derived:
    """Countries derived from recipes (country, recipe) out of areas (source, id, code, name, level, parent_id,
    pop_latest, area_km2), by the atomic level (source, atomic) and the legal level (source, legal_level) of sources."""
    nodes = recipes.nodes(texts, prefix)
    own = F.concat("country", F.lit("-"), "code")
    nodes = nodes.withColumn("id", own)
    asked = recipes.labels(nodes)
    spec = checkpointed(resolved(asked, areas).join(F.broadcast(atomic), "source", "left").withColumn("territory", own))
    wrong = F.when(F.col("atomic").isNull(), "no atomic level").when(F.col("id").isNull(), "no area of this label").when(F.col("level") > F.col("atomic"), "below the atomic level")
    columns = ("country", "path", "code", "rule", "label")
    bad = spec.select("country", "path", "code", wrong.alias("rule"), "label").where("rule IS NOT NULL")
    bad = recipes.violations(texts, prefix).withColumn("label", F.lit(None).cast("string")).select(*columns).unionByName(bad)
    bad = checkpointed(bad)
    sound = lambda rows: rows.join(bad.select("country").distinct(), "country", "left_anti")
    nodes, spec = sound(nodes), sound(spec)

    leveled = areas.join(F.broadcast(atomic), "source")
    chosen = checkpointed(spec.select("territory", "id", "sign", "level", "atomic", "source").distinct())
    held_parts = territory.held(chosen, leveled, "atomic")  # members in a row each are the product of territories and areas
    full = checkpointed(held_parts.parts.where("left > 0").select("territory").distinct())
    macros = chosen.where("sign = 'include' AND level < atomic").select("territory", "id").distinct()
    units = full.unionByName(macros.select("territory")).distinct()
    specs = nodes.where("kind = 'spec'").withColumn("territory", F.col("id"))
    empty = specs.join(units, "territory", "left_anti").select("country", "path", "code", F.lit("no units").alias("rule"), F.lit(None).cast("string").alias("label"))
    wanted = specs.select("country", "path", "code", "territory", F.explode("capitals").alias("label")).withColumn("label", F.trim("label")).where("label <> ''")
    seats = checkpointed(capitals(wanted.select("territory", "label").distinct(), chosen, held_parts, areas, legal))
    lost = wanted.join(seats.where("id IS NULL"), ["territory", "label"]).select("country", "path", "code", F.lit("capital outside the territory").alias("rule"), "label")
    bad = checkpointed(bad.unionByName(empty.select(*columns)).unionByName(lost.select(*columns)))
    nodes = nodes.join(bad.select("country").distinct(), "country", "left_anti")

    totals = territory.totals(chosen, leveled, "atomic").withColumnRenamed("area", "own")
    forced = specs.select("territory", "forced_area_km2").join(totals, "territory").select("territory", "pop", F.round(F.coalesce("forced_area_km2", "own"), 2).cast("decimal(14,2)").alias("area"))
    parent = F.coalesce(F.concat("country", F.lit("-"), "parent_code"), F.col("country"))
    rows = nodes.select("id", "name", parent.alias("parent_id"), "level", "entity_type", F.when(F.col("kind") == "spec", F.col("id")).alias("territory"))
    root = nodes.select(F.col("country").alias("id")).distinct().select("id", F.initcap(F.replace("id", F.lit("-"), F.lit(" "))).alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit("Country").alias("entity_type"))
    tree = build.tree(rows, forced, root)
    top = territory.largest_member(held_parts, areas)
    spare = largest(macros.join(full, "territory", "left_anti"), areas)
    auto = nodes.where("kind = 'spec' AND auto_most_populated").select(F.col("id").alias("territory"))
    best = top.unionByName(spare).join(auto, "territory", "left_semi").withColumnRenamed("territory", "id")
    held = seats.where("id IS NOT NULL").groupBy(F.col("territory").alias("key")).agg(F.sort_array(F.collect_set("id")).alias("capitals")).withColumnRenamed("key", "id")
    names = nodes.select("id", "country", "code")
    out = tree.join(names, "id", "left").join(held, "id", "left").join(best, "id", "left")
    out = out.withColumns({"country": F.coalesce("country", "id"), "code": F.coalesce("code", "id"), "capitals": F.coalesce("capitals", F.array().cast("array<string>"))})
    held_by = nodes.select(F.col("id").alias("territory"))
    members = territory.members(chosen.join(held_by, "territory", "left_semi"), leveled, "atomic").withColumnRenamed("node", "id")
    return Derived(out, members, bad)
