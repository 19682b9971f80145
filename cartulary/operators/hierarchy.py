"""Trees given as (id, parent_id, level): closures, ancestors, roll-ups, paths, codes."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels are 0 to 5, so no path has more hops.
DEPTH = 5


def climbed(areas: DataFrame, *columns: str, depth: int = DEPTH) -> DataFrame:
    """(node, steps): each area with its chain of ancestors, itself first, as array<struct<id, dist, columns...>>.

    One left join a hop, to the areas that are parents: they are few beside the leaves, and no row is copied. A chain ends
    at a missing parent and at `depth`, so cycles end.
    """
    held = areas.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct()
    step = lambda d: F.struct(F.col("id"), F.lit(d).alias("dist"), *columns)
    inner = areas.join(held, "id", "left_semi")
    chain = areas.select(F.col("id").alias("node"), F.col("parent_id").alias("up0"), step(0).alias("s0"))
    for d in range(1, depth + 1):
        above = inner.select(F.col("id").alias(f"id{d}"), F.col("parent_id").alias(f"up{d}"), step(d).alias(f"s{d}"))
        chain = chain.join(above, F.col(f"up{d - 1}") == F.col(f"id{d}"), "left").drop(f"up{d - 1}", f"id{d}")
    return chain.select("node", F.filter(F.array(*(f"s{d}" for d in range(depth + 1))), lambda s: s.isNotNull()).alias("steps"))


def closure(areas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(ancestor, node, dist) for every pair, itself included."""
    return climbed(areas, depth=depth).select("node", F.explode("steps").alias("s")).select(F.col("s.id").alias("ancestor"), "node", F.col("s.dist").alias("dist"))


def first_step(steps: str, test) -> Column:
    """The nearest of a chain's steps that passes the test; null if none does."""
    return F.get(F.filter(steps, test), F.lit(0))


def descendants_at_level(areas: DataFrame, level: int) -> DataFrame:
    """(ancestor, node): descendants exactly level - ancestor's level hops below, whatever their own levels are."""
    roots = areas.where(F.col("level") <= level).select(F.col("id").alias("ancestor"), (F.lit(level) - F.col("level")).alias("dist"))
    return closure(areas).join(roots, ["ancestor", "dist"]).select("ancestor", "node")


def first_below_at_level(areas: DataFrame, level: int) -> DataFrame:
    """(ancestor, node): descendants of that level with only shallower ones between."""
    pairs, own = closure(areas), areas.select(F.col("id").alias("node"), F.col("level").alias("node_level"))
    at = pairs.where("dist > 0").join(own, "node").where(F.col("node_level") == level)
    deep = pairs.where("dist > 0").join(own, "node").where(F.col("node_level") >= level).select("ancestor", F.col("node").alias("mid"))
    hidden = deep.join(pairs.where("dist > 0").select(F.col("ancestor").alias("mid"), "node"), "mid").select("ancestor", "node").distinct()
    return at.join(hidden, ["ancestor", "node"], "left_anti").select("ancestor", "node")


def lowest_common_ancestor(groups: DataFrame, areas: DataFrame) -> DataFrame:
    """(group, ancestor) of groups (group, node): the deepest area that is an ancestor of, or is, all of a group's nodes."""
    members = groups.select("group", "node").distinct()
    size = members.groupBy("group").agg(F.count("*").alias("n"))
    shared = members.join(closure(areas), "node").groupBy("group", "ancestor").agg(F.count("*").alias("held"))
    levels = areas.select(F.col("id").alias("ancestor"), "level")
    common = shared.join(size, "group").where("held = n").join(levels, "ancestor")
    return common.groupBy("group").agg(F.max_by("ancestor", F.struct("level", "ancestor")).alias("ancestor"))


def closest_level(level: Column, target: Column) -> Column:
    """Sort key: nearest to target, then the shallower."""
    return F.struct(F.abs(level - target), level > target, level)


def roots(areas: DataFrame) -> DataFrame:
    """(id, root): the last area of each chain, a country's topmost one."""
    return climbed(areas).select(F.col("node").alias("id"), F.element_at("steps", -1)["id"].alias("root"))


def atomic_levels(areas: DataFrame) -> DataFrame:
    """(root, deepest): the deepest level of each country."""
    return areas.join(roots(areas), "id").groupBy("root").agg(F.max("level").alias("deepest"))


def candidate_levels(areas: DataFrame, legal: int | None = None) -> DataFrame:
    """(id, chosen): the level at which each area's most populated descendant is sought; areas without one are left out.
    The target is the legal level above it, else the deepest one of the area's country."""
    up = climbed(areas, "level").withColumn("root", F.element_at("steps", -1)["id"])
    deepest = up.groupBy("root").agg(F.max(F.get("steps", F.lit(0))["level"]).alias("deepest"))
    own = up.select("root", F.get("steps", F.lit(0))["level"].alias("node_level"), F.explode(F.slice("steps", 2, DEPTH)).alias("s")).join(deepest, "root")
    below = own.select(F.col("s.id").alias("id"), F.col("s.level").alias("level"), "node_level", "deepest").distinct()
    legal_level = F.lit(legal) if legal is not None else F.col("deepest")
    target = F.when(F.col("level") < legal_level, legal_level).otherwise(F.col("deepest"))
    below = below.withColumn("target", target).where("target > level AND node_level > level")
    return below.groupBy("id").agg(F.min_by("node_level", closest_level(F.col("node_level"), F.col("target"))).alias("chosen"))


def most_populated(areas: DataFrame, legal: int | None = None) -> DataFrame:
    """(id, most_populated): of the descendants at the chosen level that with the largest known population, then the
    lowest id. An area whose chosen level has no known population gets none."""
    nodes = areas.where("pop_latest IS NOT NULL").select(F.col("id").alias("node"), F.col("level").alias("chosen"), "pop_latest")
    below = closure(areas).where("dist > 0").select(F.col("ancestor").alias("id"), "node")
    found = candidate_levels(areas, legal).join(below.join(nodes, "node"), ["id", "chosen"])
    return found.groupBy("id").agg(F.min_by("node", F.struct(-F.col("pop_latest"), "node")).alias("most_populated"))


def inherited(areas: DataFrame, column: str) -> DataFrame:
    """(id, column): the nearest known value up the tree, the area's own first."""
    return climbed(areas, column).select(F.col("node").alias("id"), first_step("steps", lambda s: s[column].isNotNull())[column].alias(column))


def seat_totals(areas: DataFrame, column: str = "representatives") -> DataFrame:
    """(id, total): own seats and those of all descendants."""
    own = areas.select(F.col("id").alias("node"), F.coalesce(column, F.lit(0)).alias("n"))
    return closure(areas).join(own, "node").groupBy(F.col("ancestor").alias("id")).agg(F.sum("n").alias("total"))


def recursive_seats(areas: DataFrame, column: str = "representatives") -> DataFrame:
    """(id, seats): the own value, else the sum of the children's if above 0, else null. A value hides what is below it:
    each one climbs to the areas above, up to the first that has its own."""
    up = climbed(areas, column).where(F.get("steps", F.lit(0))[column].isNotNull())
    blocker = first_step("steps", lambda s: (s["dist"] > 0) & s[column].isNotNull())["dist"]
    fed = F.filter("steps", lambda s: (s["dist"] > 0) & (s["dist"] < F.coalesce(blocker, F.lit(DEPTH + 1))))
    sums = up.select(F.get("steps", F.lit(0))[column].alias("n"), F.explode(fed).alias("s")).groupBy(F.col("s.id").alias("id")).agg(F.sum("n").alias("sum"))
    return areas.join(sums, "id", "left").select("id", F.coalesce(column, F.when(F.col("sum") > 0, F.col("sum"))).alias("seats"))


def container_rollup(areas: DataFrame) -> DataFrame:
    """(id, pop, area, density) of every parent, from its direct children; density null without an area."""
    sums = areas.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.coalesce(F.sum("pop_latest"), F.lit(0)).alias("pop"), F.sum("area_km2").alias("area"))
    return sums.withColumn("density", F.try_divide(F.col("pop").cast("double"), F.nullif(F.col("area"), F.lit(0)).cast("double")))


def paths(areas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(leaf, path): root to leaf, path an array of (level, id); ordering by path is depth first."""
    parents = areas.select(F.col("parent_id").alias("leaf")).where("leaf IS NOT NULL").distinct()
    up = climbed(areas, "level", depth=depth).select(F.col("node").alias("leaf"), F.sort_array(F.transform("steps", lambda s: F.struct(s["level"].alias("level"), s["id"].alias("id")))).alias("path"))
    return up.join(parents, "leaf", "left_anti")


def rolled_up(areas: DataFrame, containers: str, depth: int = DEPTH) -> DataFrame:
    """(id, pop, area, density) of every container (a boolean column): sums over what lies below it, deepest first, so
    that containers of containers hold their contents' sums. An area that is no container counts with its own values and
    hides what is below it."""
    up = climbed(areas, containers, depth=depth).where(~F.get("steps", F.lit(0))[containers])
    blocker = first_step("steps", lambda s: (s["dist"] > 0) & ~s[containers])["dist"]
    fed = F.filter("steps", lambda s: (s["dist"] > 0) & (s["dist"] < F.coalesce(blocker, F.lit(depth + 1))))
    values = areas.select(F.col("id").alias("node"), "pop_latest", "area_km2")
    sums = up.select("node", F.explode(fed).alias("s")).join(values, "node").groupBy(F.col("s.id").alias("id")).agg(F.coalesce(F.sum("pop_latest"), F.lit(0)).alias("pop"), F.sum("area_km2").alias("area"))
    return sums.withColumn("density", F.try_divide(F.col("pop").cast("double"), F.nullif(F.col("area"), F.lit(0)).cast("double")))


def parent_by_stack(rows: DataFrame, page: str, ordinal: str, level: str) -> DataFrame:
    """Adds parent: the ordinal of the last row one level up, unless a shallower one has come since; else null."""
    before = Window.partitionBy(page).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(ordinal))).over(before) for k in range(DEPTH + 1)]
    same = F.element_at(F.array(F.lit(None).cast("long"), *last), F.col(level) + 1)
    above = F.greatest(F.lit(-1).cast("long"), *(F.when(F.col(level) - 1 > k, last[k]) for k in range(DEPTH + 1)))
    return rows.withColumn("parent", F.when(same > above, same))


def joined_code(parent_code: Column, code: Column, level: Column) -> Column:
    """parent-child, without a double prefix; codes of level 1 stay."""
    return F.when((level <= 1) | code.startswith(F.concat(parent_code, F.lit("-"))), code).otherwise(F.concat(parent_code, F.lit("-"), code))


def full_codes(areas: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, full_code) of areas (id, parent_id, level, code): codes joined from the root down, see joined_code."""
    path = climbed(areas, "level", "code", depth=depth).select(F.col("node").alias("id"), F.reverse("steps").alias("path"))
    joined = F.aggregate(F.slice("path", 2, depth), F.element_at("path", 1)["code"], lambda code, x: joined_code(code, x["code"], x["level"]))
    return path.select("id", joined.alias("full_code"))


def duplicate_codes(areas: DataFrame) -> DataFrame:
    """(full_code, n) of full codes that more than one area has."""
    return full_codes(areas).groupBy("full_code").agg(F.count("*").alias("n")).where("n > 1")
