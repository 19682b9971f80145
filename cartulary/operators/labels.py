"""Labels to areas: tiers of keys, tried in order, as equi-joins on (tier, key); containment by shared character grams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import normalised
from cartulary.sources.areas import checkpointed

#: Labels that are broadcast at most, about 10 MB of them; tables of areas and of all labels never are, whatever size
#: their files or compressed shuffles suggest.
BROADCAST_LABELS = 50_000
#: Longest gram that stands for a label in the search for names that contain it.
GRAM = 3


def keyed(df: DataFrame, keys: list[Column], *keep: str) -> DataFrame:
    """A row (keep, tier, key) for every known key; tiers count from 1."""
    tiers = F.array(*(F.struct(F.lit(i).alias("tier"), k.alias("key")) for i, k in enumerate(keys, 1)))
    return df.select(*keep, F.inline(tiers)).where("key IS NOT NULL")


def equal_tiers(code: Column, name: Column, own: Column) -> list[Column]:
    return [own, F.lower(code), F.lower(name), normalised(code), normalised(name)]


def grams(text: Column) -> Column:
    """The distinct substrings of 1 to GRAM characters."""
    of = []
    for n in range(1, GRAM + 1):
        size = F.lit(n)
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - n + 1, F.lit(1)))
        of.append(F.transform(starts, lambda i: F.substr(text, i, size)))  # noqa: B023 - called at once
    return F.array_distinct(F.concat(*of))


def containing(labels: DataFrame, areas: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by..., label, id, level): areas whose normalised column contains the normalised label. Exact: such a text holds
    all grams of the label, so both sides join on the one that fewest texts hold, and the join is then checked. A label
    with a gram that no text holds is contained in none. Only texts of the groups that labels ask for are taken apart."""
    texts = areas.select(*by, "id", "level", normalised(F.col(column)).alias("text")).where("text <> ''")
    texts = texts.join(labels.select(*by).distinct(), by, "left_semi") if by else texts
    held = texts.select(*by, "id", "level", "text", F.explode(grams(F.col("text"))).alias("gram"))
    sought = labels.withColumn("part", normalised(F.col("label"))).where("part <> ''")
    longest = F.filter(grams(F.col("part")), lambda g: F.char_length(g) == F.least(F.char_length("part"), F.lit(GRAM)))
    asked = sought.select(*by, "label", "part", F.explode(longest).alias("gram"))
    holders = held.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    ranked = asked.join(holders.hint("merge"), [*by, "gram"], "left").groupBy(*by, "label", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    rarest = checkpointed(ranked.where("least.n > 0").select(*by, "label", "part", "least.gram"))
    few = rarest.count() <= BROADCAST_LABELS  # then texts are taken apart and met where they stand, not shuffled with each gram
    return held.join(F.broadcast(rarest) if few else rarest.hint("merge"), [*by, "gram"]).where(F.contains("text", "part")).select(*by, "label", "id", "level")


def equals(labels: DataFrame, areas: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, tier, depth, id): all areas that a label equals, in each of the equal tiers."""
    own = keyed(areas, equal_tiers(F.col("code"), F.col("name"), F.col("id")), *by, "id")
    asked = keyed(labels, [F.col("label"), F.lower("label"), F.lower("label"), normalised(F.col("label")), normalised(F.col("label"))], *by, "label")
    return asked.join(own.hint("merge"), [*by, "tier", "key"]).select(*by, "label", "tier", F.lit(0).alias("depth"), "id")


def contained(labels: DataFrame, areas: DataFrame, by: list[str]) -> DataFrame:
    """(by..., label, tier, depth, id): all areas whose name or code contains a label."""
    name, code = (containing(labels, areas, c, by).select(*by, "label", F.lit(t).alias("tier"), (-F.col("level")).alias("depth"), "id") for t, c in ((6, "name"), (7, "code")))
    return name.unionByName(code)


def resolve(labels: DataFrame, areas: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., label, id, tier) of labels (by..., label) against areas (by..., id, code, name, level) of the same group;
    `by` are columns such as a country and a level that both have.

    Tiers: id; code, name without case; code, name normalised; name, code containing the label. Within the equal tiers
    the lowest id wins, within the containing ones the deepest level, then the lowest id. Blank labels contain nothing.
    Labels without an area are left out.
    """
    by = list(by)
    labels = labels.select(*by, "label").where("label IS NOT NULL").distinct()
    equal = equals(labels, areas, by)
    rest = labels.join(equal.hint("merge"), [*by, "label"], "left_anti")
    best = equal.unionByName(contained(rest, areas, by)).groupBy(*by, "label").agg(F.min(F.struct("tier", "depth", "id")).alias("best"))
    return best.select(*by, "label", "best.id", "best.tier")


def missing(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Labels that no tier resolves."""
    return labels.select("label").where("label IS NOT NULL").distinct().join(resolve(labels, areas).hint("merge"), "label", "left_anti")


def overridden(areas: DataFrame, overrides: DataFrame, default: Column) -> DataFrame:
    """(id, value) of all areas (id, code, name): the value of the override (key, value) that equals the id, code or name,
    then one of these normalised, else the default; of equal keys the lowest value."""
    plain = [F.col(c) for c in ("id", "code", "name")]
    own = keyed(areas, plain + [normalised(c) for c in plain], "id")
    given = keyed(overrides, [F.col("key")] * 3 + [normalised(F.col("key"))] * 3, "value")
    best = own.join(given, ["tier", "key"]).groupBy("id").agg(F.min(F.struct("tier", "value")).alias("best"))
    return areas.select("id").join(best, "id", "left").select("id", F.coalesce("best.value", default).alias("value"))


def longest_prefix(entities: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, parent) of entities (id, code, level) that have one: of parents (code, level) above them, that whose code is
    the longest prefix of theirs. Prefixes are spelt out, so this is an equi-join."""
    heads = F.transform(F.sequence(F.lit(1), F.char_length("code")), lambda n: F.substr("code", F.lit(1), n))
    spelt = entities.where("code <> ''").select("id", "level", F.explode(heads).alias("head"))
    above = parents.select(F.col("code").alias("head"), F.col("level").alias("above")).distinct()
    found = spelt.join(above, "head").where("level > above")
    return found.groupBy("id").agg(F.max_by("head", F.char_length("head")).alias("parent"))
