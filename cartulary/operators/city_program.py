"""Configured cities as a program: a table of configurations applied to a tree, with what is wrong as rows.

Configurations are meant in order, each on the tree that those before it left. Those whose parts of the tree have nothing to
do with each other come to the same in any order, so they are applied together, as a layer: the plan is as long as there are
layers, not as the list. A layer's result is kept before the next one begins.

Areas: (id, code, name, level, parent_id, entity_type, pop_latest, area_km2, pop_latest_date, last_census_year, ordinal).
Configurations: (place, city, name, level, entity_type, district_types, parent_from, communes); city is the id of its area,
parent_from maps levels to labels of the areas that it is made from, communes are labels of its parts, if not all districts.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import casefolded
from cartulary.operators import cities, configured
from cartulary.operators.hierarchy import DEPTH, climbed
from cartulary.operators.labels import longest_prefix
from cartulary.sources.areas import checkpointed, stored

AREA = ("id", "code", "name", "level", "parent_id", "entity_type", "pop_latest", "area_km2", "pop_latest_date", "last_census_year", "ordinal")
#: Parents that are broadcast at most, with their chains about 10 MB; more of them meet areas in merge joins.
FEW = 50_000

Spine = tuple[DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]


def spine(areas: DataFrame) -> Spine:
    """(parents, chains, put): areas that are parents (id, parent_id, level, entity_type), the chain of each (parent_id,
    steps), itself first, and the hint for tables with a row or a few for a parent. What lies above an area is its
    parent's chain, so that only parents climb, and each area meets its parent once."""
    held = checkpointed(areas.select(F.col("parent_id").alias("id")).where("id IS NOT NULL").distinct())
    few = held.count() <= FEW
    put = F.broadcast if few else lambda rows: rows.hint("merge")
    parents = areas.join(put(held), "id", "left_semi").select("id", "parent_id", "level", "entity_type")
    parents = checkpointed(parents.repartition(1) if few else parents)  # few in one partition climb without an exchange
    return parents, checkpointed(climbed(parents, "level", depth=DEPTH - 1).withColumnRenamed("node", "parent_id")), put


def chained(rows: DataFrame, tree: Spine) -> DataFrame:
    """rows (id, level, parent_id, ...) with the chain of each, an array of (level, id), itself first."""
    _, chains, put = tree
    above = F.coalesce(F.transform("steps", lambda s: F.struct(s["level"].alias("level"), s["id"].alias("id"))), F.array())
    return rows.join(put(chains), "parent_id", "left").withColumn("chain", F.concat(F.array(F.struct("level", "id")), above)).drop("steps")


def made_from(areas: DataFrame, configs: DataFrame, tree: Spine) -> DataFrame:
    """(city, level, label, id, chain): the area that each label of parent_from names, nulls for none."""
    asked = configs.select("city", F.explode("parent_from").alias("level", "labels")).select("city", "level", F.explode("labels").alias("label"))
    named = chained(configured.named(asked, areas, ["level"], "parent_id"), tree).select("level", "label", "id", "chain")
    return checkpointed(asked.join(F.broadcast(named), ["level", "label"], "left").repartition(1))


def layers(areas: DataFrame, configs: DataFrame, tree: Spine | None = None, found: DataFrame | None = None) -> list[list[str]]:
    """Cities in layers: one comes after those before it in the list that may change what it sees. These are ones that
    work in the same part of the tree (the lowest common ancestor of one's areas is above or below the other's, or the
    city stands there), bear a name that it asks for, or are not found yet. Configurations are few, and so is what comes
    here of the tree: a chain of ancestors for each label and city."""
    tree = spine(areas) if tree is None else tree
    found = made_from(areas, configs, tree) if found is None else found
    chains: dict[str, list[list[str] | None]] = {}
    for r in found.select("city", "chain.id").collect():
        chains.setdefault(r.city, []).append(r.id)
    at: dict[str, list[list[str]]] = {}
    for city, own in chains.items():
        shared = [] if None in own else [x for x in own[0] if all(x in chain for chain in own)]
        if shared:
            at[city] = [shared]  # from the lowest common ancestor up
    headed = set(at)
    standing = areas.join(F.broadcast(configs.select(F.col("city").alias("id")).distinct()), "id", "left_semi").select("id", "level", "parent_id")
    for r in chained(standing, tree).select("id", F.col("chain.id").alias("chain")).collect():
        at.setdefault(r.id, []).append(r.chain)
    norm = lambda text: " ".join(str(text).casefold().split())
    rows = configs.select("place", "city", "name", "parent_from", "communes").orderBy("place", "city").collect()
    asks = {r.city: {norm(x) for labels in (r.parent_from or {}).values() for x in labels} | {norm(x) for x in r.communes or []} for r in rows}
    level: dict[str, int] = {}
    for i, r in enumerate(rows):
        before = [0]
        for other in rows[:i]:
            apart = other.city in headed and r.city in headed and other.city != r.city and not asks[r.city] & {norm(other.name), norm(other.city)}
            related = any(a[0] in b or b[0] in a for a in at.get(r.city, []) for b in at.get(other.city, []))
            if not apart or related:
                before.append(level[other.city])
        level[r.city] = 1 + max(before)
    return [[c for c, k in level.items() if k == n] for n in range(1, max(level.values(), default=0) + 1)]


def listed(areas: DataFrame, configs: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communes (city, id), violations (city, rule, label)) of configs that list communes and whose areas are origins
    (city, from_id, from_level): children of those areas or of the city, by label."""
    asked = configs.select("city", F.explode("communes").alias("label")).distinct()
    hits = checkpointed(configured.communes(asked, areas, configs.join(origins.select("city", "from_id"), "city").select("city", "from_id", F.col("level").alias("city_level"), F.col("district_types").alias("types")), few=True))
    lost = asked.join(hits, ["city", "label"], "left_anti").select("city", F.lit("no commune of this label").alias("rule"), "label")
    return hits.select("city", "id").distinct(), lost


def passes(rule: Column) -> Column:
    """Whether an area (level, id, folded: its type in normal form) is below a rule's level, of its types, no city itself."""
    return (F.col("level") > rule["above"]) & ((F.size(rule["types"]) == 0) | F.array_contains(rule["types"], F.col("folded"))) & (F.col("id") != rule["city"])


def rules(areas: DataFrame, towns: DataFrame, origins: DataFrame, tree: Spine) -> DataFrame:
    """(parent_id, parts, stale): what becomes of a parent's children. Those that pass one of parts (city, city_level,
    above, types, nearest) at its nearest level are communes of that city; of stale children see `marked`.

    A town without listed communes takes the children that it has already, of its types, at the nearest level; and
    without such the nearest ones below its areas."""
    _, chains, put = tree
    free = towns.where("size(communes) = 0").select("city", F.col("level").alias("city_level"), "types")
    kids = free.select("*", F.lit(0).alias("kind"), F.col("city").alias("parent_id"), F.col("city_level").alias("above"))
    under = chains.select("parent_id", F.explode("steps.id").alias("from_id")).join(F.broadcast(origins), "from_id").groupBy("parent_id", "city").agg(F.min("from_level").alias("above"))
    below = under.join(F.broadcast(free), "city").select("city", "city_level", "types", F.lit(1).alias("kind"), "parent_id", "above")
    known = checkpointed(kids.unionByName(below))
    met = areas.select("id", "level", "parent_id", casefolded(F.col("entity_type")).alias("folded")).join(put(known.select("parent_id", F.struct("city", "above", "types", "kind").alias("rule"))), "parent_id").where(passes(F.col("rule")))
    nearest = met.groupBy("rule.city").agg(F.min(F.struct("rule.kind", "level")).alias("least")).select("city", "least.kind", F.col("least.level").alias("nearest"))
    parts = known.join(F.broadcast(nearest), ["city", "kind"]).select("parent_id", F.struct("city", "city_level", "above", "types", "nearest").alias("part"))
    stale = towns.select(F.col("city").alias("parent_id"), F.struct("city", F.col("level").alias("above"), "types", F.col("parent_id").alias("head")).alias("stale"))
    return checkpointed(parts.unionByName(stale, allowMissingColumns=True).groupBy("parent_id").agg(F.collect_list("part").alias("parts"), F.any_value("stale", F.lit(True)).alias("stale")))


def marked(rows: DataFrame, known: DataFrame, put: Callable[[DataFrame], DataFrame], chosen: DataFrame | None) -> DataFrame:
    """rows with `of`, the (city, city_level) of a commune, and `own`, how an area itself moves (rank, dist, shift, to):
    children of a town that are not of its types go up to where it stands, before communes go below their town. chosen
    (id, of) are communes by label. One listed for two cities is the lowest one's."""
    rows = rows.withColumn("folded", casefolded(F.col("entity_type"))).join(put(known), "parent_id", "left")
    fits = F.filter("parts", lambda p: (F.col("level") == p["nearest"]) & passes(p))
    of = F.array_min(F.transform(fits, lambda p: F.struct(p["city"].alias("city"), p["city_level"].alias("city_level"))))
    rows = rows.withColumn("of", of) if chosen is None else rows.join(F.broadcast(chosen.withColumnRenamed("of", "chosen")), "id", "left").withColumn("of", F.least(of, "chosen")).drop("chosen")
    move = lambda rank, shift, to: F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("dist"), shift.cast("int").alias("shift"), to.alias("to"))
    left = (F.col("level") > F.col("stale.above")) & (F.size("stale.types") > 0) & ~F.array_contains("stale.types", F.coalesce("folded", F.lit("")))
    own = F.when(left, move(0, F.lit(-1), F.col("stale.head"))).when(F.col("of").isNotNull(), move(1, F.col("of.city_level") + 1 - F.col("level"), F.col("of.city")))
    return rows.withColumn("own", own).drop("folded", "parts", "stale")


def by_code(placed: DataFrame, least: int) -> DataFrame:
    """placed where what lies below no commune by its parents does by its code: below the longest commune's that begins it."""
    loose = placed.where(~F.col("moves") & (F.col("was") > least)).select("id", "code", F.col("was").alias("level"))
    roots = placed.where("of IS NOT NULL").select("id", "code", F.col("was").alias("level"), (F.col("of.city_level") + 1 - F.col("was")).alias("shift"))
    heads = longest_prefix(loose, roots.select("code", "level")).withColumnRenamed("parent", "head_code")
    steps = heads.join(roots.select(F.col("code").alias("head_code"), F.col("id").alias("head_id"), "shift"), "head_code").select("id", "head_id", "shift")
    return placed.join(steps, "id", "left").withColumns({"level": F.col("level") + F.coalesce("shift", F.lit(0)), "parent_id": F.coalesce("parent_id", "head_id")}).drop("head_id", "shift")


def layer(areas: DataFrame, configs: DataFrame, tree: Spine, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, violations) after configs that don't touch each other. A config with a violation changes nothing.

    What configs say is put to parents, and each area then meets its parent's row once: areas are read, not moved."""
    parents, chains, put = tree
    lost = found.where("id IS NULL").select("city", F.lit("no area of this label").alias("rule"), "label")
    none = configs.join(found, "city", "left_anti").select("city", F.lit("made from nothing").alias("rule"), F.lit(None).cast("string").alias("label"))
    origins = found.where("id IS NOT NULL").select("city", F.col("id").alias("from_id"), F.col("level").alias("from_level")).distinct()
    met = found.where("id IS NOT NULL").groupBy("city").agg(F.collect_list("chain").alias("all"))
    shared = F.aggregate("all", F.element_at("all", 1), F.array_intersect)
    heads = met.select("city", F.array_max(shared)["id"].alias("head"))  # the deepest
    apart = heads.where("head IS NULL").select("city", F.lit("no common area").alias("rule"), F.lit(None).cast("string").alias("label"))
    bad, chosen, naming = lost.unionByName(none).unionByName(apart), None, configs.where("size(communes) > 0")
    if not naming.isEmpty():
        chosen, missing = listed(areas, naming, origins)
        bad = bad.unionByName(missing)
    bad = checkpointed(bad.repartition(1))
    good = lambda rows: rows.join(F.broadcast(bad.select("city").distinct()), "city", "left_anti")
    types = F.transform("district_types", casefolded).alias("types")
    towns = checkpointed(good(configs).join(F.broadcast(heads.where("head IS NOT NULL")), "city").select("place", "city", "name", "level", "entity_type", types, "communes", F.col("head").alias("parent_id")))
    if chosen is not None:
        chosen = checkpointed(chosen.join(F.broadcast(towns.select("city", F.col("level").alias("city_level"))), "city").groupBy("id").agg(F.min(F.struct("city", "city_level")).alias("of")))

    kept = lambda rows: rows.join(F.broadcast(towns.select(F.col("city").alias("id"))), "id", "left_anti")
    known = rules(areas, towns, origins, tree)
    # The nearest move up the tree counts, one of stale children before one of communes
    moves = marked(kept(parents), known, put, chosen).where("own IS NOT NULL").select("id", "own")
    far = F.struct(F.col("own.rank").alias("rank"), (F.col("s.dist") + 1).alias("dist"), F.col("own.shift").alias("shift"), F.lit(None).cast("string").alias("to"))
    passed = chains.select("parent_id", F.explode("steps").alias("s")).join(put(moves.withColumnRenamed("id", "at")), F.col("s.id") == F.col("at")).groupBy("parent_id").agg(F.min(far).alias("passed"))
    known = checkpointed(known.join(passed, "parent_id", "full"))
    move = F.least("own", "passed")
    placed = marked(kept(areas), known, put, chosen).withColumn("move", move).withColumns({"was": F.col("level"), "moves": F.col("move").isNotNull(), "level": F.col("level") + F.coalesce("move.shift", F.lit(0)), "parent_id": F.coalesce("move.to", "parent_id")})
    placed = stored(placed.select(*AREA, "was", "moves", "of"))
    least, deepest = placed.agg(F.min(F.when(F.col("of").isNotNull(), F.col("was"))), F.max(F.when(~F.col("moves"), F.col("was")))).first()
    if least is not None and deepest is not None and deepest > least:
        placed = stored(by_code(placed, least).select(*AREA, "was", "moves", "of"))
    last = areas.agg(F.max("ordinal").alias("last"))
    new = cities.summed(placed.where("of IS NOT NULL").withColumn("city", F.col("of.city")), towns.select("city", "name", "level", "parent_id", "entity_type"))
    new = new.withColumn("code", F.col("id")).join(F.broadcast(towns.select(F.col("city").alias("id"), "place")), "id").crossJoin(F.broadcast(last)).withColumn("ordinal", F.col("last") + 1 + F.col("place"))
    return placed.select(*AREA).unionByName(stored(new.select(*AREA))), bad


def applied(areas: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(areas, violations (city, rule, label)) after all configurations."""
    configs = checkpointed(configs.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("district_types", "communes")}).repartition(1))
    areas = stored(areas.select(*AREA))
    bad = configs.sparkSession.createDataFrame([], "city string, rule string, label string")
    tree = spine(areas)
    found = made_from(areas, configs, tree)
    for i, names in enumerate(layers(areas, configs, tree, found)):
        now = configs.where(F.col("city").isin(names))
        if i > 0:  # the tree is another one
            tree = spine(areas)
            found = made_from(areas, now, tree)
        areas, wrong = layer(areas, now, tree, found.where(F.col("city").isin(names)))
        bad = bad.unionByName(wrong)
    return areas, bad
