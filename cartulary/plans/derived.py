"""Registered queries on configured cities, capitals, derived trees, exports and sinks, each with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.operators import build, capitals, changes, cities, configured, export, hierarchy, territory
from cartulary.operators.city_program import applied as cities_of
from cartulary.plans.catalogue import SPEC, spec
from cartulary.sources.areas import areas, checkpointed, table, with_areas

QUERIES, ORACLES = {}, {}
NAMED = ", named AS (SELECT 'n'||s_nationkey AS area, 'c'||s_suppkey AS capital FROM supplier UNION SELECT 'r'||(s_suppkey % 5), 'c'||s_suppkey FROM supplier UNION SELECT 'zz', 'c1'), good AS (SELECT area, capital FROM named JOIN closure ON ancestor = area AND node = capital)"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def ordered(tree: DataFrame) -> DataFrame:
    """The tree with codes (the id in upper case) and a place in order of level and id's number."""
    return tree.withColumns({"code": F.upper("id"), "ordinal": F.struct("level", F.length("id").alias("n"), "id")})


ASKED = """, lab AS (SELECT 3 AS level, 'c'||s_suppkey AS label FROM supplier UNION SELECT 3, 'C'||s_suppkey FROM supplier UNION SELECT 3, '  customer#'||lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier
UNION SELECT 2, '  '||lower(n_name)||' ' FROM nation UNION SELECT 2, n_name FROM nation UNION SELECT 2, 'Customer#000000001' UNION SELECT 3, 'nowhere'||c_custkey FROM customer),
k AS (SELECT level, id, unnest([id, upper(id), name]) AS k FROM area),
hit AS (SELECT DISTINCT lab.level, label, id, CASE WHEN k = label THEN 1 ELSE 2 END AS tier FROM lab JOIN k ON k.level = lab.level AND lower(k) = lower(trim(label)) UNION SELECT lab.level, label, id, 1 FROM lab JOIN k ON k.level = lab.level AND k = label),
best AS (SELECT level, label, min(tier) AS tier FROM hit GROUP BY ALL)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation, customer = (table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    key = F.col("s_suppkey").cast("string")
    leaves = supplier.select(F.lit(3).alias("level"), F.explode(F.array(F.concat(F.lit("c"), key), F.concat(F.lit("C"), key), F.concat(F.lit("  customer#"), F.lpad(key, 9, "0")))).alias("label"))
    inner = nation.select(F.lit(2).alias("level"), F.explode(F.array(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")), F.col("n_name"), F.lit("Customer#000000001"))).alias("label"))
    return leaves.unionByName(inner).unionByName(customer.select(F.lit(3).alias("level"), F.concat(F.lit("nowhere"), "c_custkey").alias("label")))


@query(with_areas(ASKED + " SELECT level, label, id, tier FROM hit JOIN best USING (level, label, tier)"))
def city_labels(spark, sf_dir):
    """All areas that each label names in its best tier."""
    return configured.matches(asked(spark, sf_dir), ordered(areas(spark, sf_dir)), ["level"])


@query(with_areas(ASKED + " SELECT level, label, arg_min(id, struct_pack(n := length(id), i := id)) AS id FROM hit JOIN best USING (level, label, tier) GROUP BY ALL"))
def city_from_labels(spark, sf_dir):
    """The first area that each label names at its level."""
    return configured.first_match(asked(spark, sf_dir), ordered(areas(spark, sf_dir)), ["level"])


@query(with_areas(""", cfg AS (SELECT 'm'||r_regionkey AS city, 'r'||r_regionkey AS from_id, CASE r_regionkey % 3 WHEN 0 THEN ['building'] WHEN 1 THEN [] ELSE ['nation', 'building'] END AS types FROM region
UNION ALL SELECT 'm'||n_nationkey||'x', 'n'||n_nationkey, ['automobile', 'building'] FROM nation),
b AS (SELECT city, a.id, a.level FROM cfg JOIN closure c ON c.ancestor = from_id AND dist > 0 JOIN area a ON a.id = node WHERE len(types) = 0 OR list_contains(types, lower(entity_type)))
SELECT city, id FROM b WHERE level = (SELECT min(level) FROM b x WHERE x.city = b.city)"""))
def nearest_level(spark, sf_dir):
    """Districts of a city: below its areas, of its types, at the level nearest to the top."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    types = F.when(F.col("r_regionkey") % 3 == 0, strings(" Building")).when(F.col("r_regionkey") % 3 == 1, strings()).otherwise(strings("NATION", "Building"))
    configs = region.select(F.concat(F.lit("m"), "r_regionkey").alias("city"), F.concat(F.lit("r"), "r_regionkey").alias("from_id"), types.alias("types"))
    configs = configs.unionByName(nation.select(F.concat(F.lit("m"), "n_nationkey", F.lit("x")).alias("city"), F.concat(F.lit("n"), "n_nationkey").alias("from_id"), strings("Automobile", "building").alias("types")))
    return configured.districts(areas(spark, sf_dir), configs)


@query("""SELECT 'n'||c_nationkey AS city, upper(c_name)||' ' AS label, 'c'||c_custkey AS id FROM customer
UNION ALL SELECT 'n'||c_nationkey||'x', c_name, 'c'||c_custkey FROM customer WHERE c_custkey % 2 = 0""")
def city_communes(spark, sf_dir):
    """Each nation as a city of its own children, and as a city made from itself that asks for some by name."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    of = F.concat(F.lit("n"), "c_nationkey")
    labels = customer.select(of.alias("city"), F.concat(F.upper("c_name"), F.lit(" ")).alias("label"))
    labels = labels.unionByName(customer.where("c_custkey % 2 = 0").select(F.concat(of, F.lit("x")).alias("city"), F.col("c_name").alias("label")))
    key = F.concat(F.lit("n"), "n_nationkey")
    configs = nation.select(key.alias("city"), F.lit(2).alias("city_level"), F.lit("none").alias("from_id"))
    configs = configs.unionByName(nation.select(F.concat(key, F.lit("x")).alias("city"), F.lit(3).alias("city_level"), key.alias("from_id")))
    return configured.communes(labels, ordered(areas(spark, sf_dir)), configs)


@query(with_areas(""", m1 AS (SELECT id, 'city-'||parent_id AS city FROM area WHERE level = 3 AND entity_type = 'BUILDING'),
c1 AS (SELECT city AS id, 'City' AS name, 3 AS level, any_value(parent_id) AS parent_id, 'City' AS entity_type, CAST(coalesce(sum(pop), 0) AS BIGINT) AS pop, CAST(round(sum(km2), 2) AS DOUBLE) AS area FROM m1 JOIN area USING (id) GROUP BY 1),
t1 AS (SELECT a.id, name, a.level + CASE WHEN city IS NULL THEN 0 ELSE 1 END AS level, coalesce(city, parent_id) AS parent_id, entity_type, pop, CAST(km2 AS DOUBLE) AS area FROM area a LEFT JOIN m1 USING (id) UNION ALL SELECT * FROM c1),
m2 AS (SELECT t1.id, 'metro-'||n.parent_id AS city FROM t1 JOIN area n ON n.id = t1.parent_id WHERE t1.entity_type = 'City'),
c2 AS (SELECT city AS id, 'Metro' AS name, 2 AS level, 'r'||split_part(city, '-r', 2) AS parent_id, 'Metro' AS entity_type, CAST(coalesce(sum(pop), 0) AS BIGINT) AS pop, CAST(round(sum(area), 2) AS DOUBLE) AS area FROM m2 JOIN t1 USING (id) GROUP BY 1)
SELECT id, name, level, parent_id, entity_type, pop, round(area, 2) AS area FROM (SELECT t1.id, name, t1.level, coalesce(city, parent_id) AS parent_id, entity_type, pop, area FROM t1 LEFT JOIN m2 USING (id) UNION ALL SELECT * FROM c2)"""))
def city_fold(spark, sf_dir):
    """Two configurations in turn: a city in every nation, then a metropolis in every region, made of those cities."""
    tree = areas(spark, sf_dir)
    parts = tree.where("level = 3 AND entity_type = 'BUILDING'").select(F.concat(F.lit("city-"), "parent_id").alias("city"), "id", "parent_id")
    towns = parts.select("city", F.lit("City").alias("name"), F.lit(3).alias("level"), "parent_id", F.lit("City").alias("entity_type")).distinct()
    up = tree.where("level = 2").select(F.col("id").alias("parent_id"), F.col("parent_id").alias("region"))
    metros = towns.join(up, "parent_id").select(F.concat(F.lit("metro-"), "region").alias("metro"), F.col("city").alias("id"), "region")
    second = metros.select(F.col("metro").alias("city"), F.lit("Metro").alias("name"), F.lit(2).alias("level"), F.col("region").alias("parent_id"), F.lit("Metro").alias("entity_type")).distinct()
    out = configured.folded(tree, [(parts.select("city", "id"), towns), (metros.select(F.col("metro").alias("city"), "id"), second)])
    return out.select("id", "name", "level", "parent_id", "entity_type", F.col("pop_latest").alias("pop"), F.round(F.col("area_km2").cast("double"), 2).alias("area"))


@query(with_areas(NAMED + """, top AS (SELECT ancestor AS id, arg_min(node, struct_pack(p := -pop, n := node)) AS node FROM closure JOIN area ON id = node WHERE dist > 0 AND level = 3 AND pop IS NOT NULL GROUP BY 1),
c AS (SELECT g.area, string_agg(name||':'||id||':'||coalesce(CAST(pop AS VARCHAR), ''), '|' ORDER BY name, id) AS c FROM good g JOIN area ON id = capital GROUP BY 1), u AS (SELECT 'n'||s_nationkey AS area, count(*) AS n FROM supplier GROUP BY 1)
SELECT a.id, a.level, a.name, a.parent_id, coalesce(c, '') AS capitals, t.name||':'||t.id||':'||t.pop AS city, coalesce(u.n, 0) AS units FROM area a LEFT JOIN c ON c.area = a.id LEFT JOIN u ON u.area = a.id LEFT JOIN top ON top.id = a.id LEFT JOIN area t ON t.id = top.node WHERE a.level <= 2"""))
def export_scan(spark, sf_dir):
    """An export's scan: areas with their capitals, most populated place and number of source units nested."""
    tree = areas(spark, sf_dir)
    units = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("area"), F.concat(F.lit("s"), "s_suppkey").alias("id"))
    held = capitals.valid(named(spark, sf_dir), tree).withColumnRenamed("capital", "id")
    places = hierarchy.most_populated(tree).select(F.col("id").alias("area"), F.col("most_populated").alias("id"))
    out = export.scan(tree.withColumns({"country": F.lit("w"), "code": F.col("id")}), "w", held, places, units, 2)
    text = lambda p: F.concat(p["name"], F.lit(":"), p["id"], F.lit(":"), F.coalesce(p["pop"].cast("string"), F.lit("")))
    return out.select("id", "level", "name", "parent_id", F.array_join(F.transform("capitals", text), "|").alias("capitals"), F.when(F.col("city").isNotNull(), text(F.col("city"))).alias("city"), "units")


@query(ORACLES["city_fold"])
def city_program(spark, sf_dir):
    """The same cities out of a table of configurations, in two layers: one for each nation that has such parts, for a city
    without any would be made too, then one for each region of such a nation."""
    tree = areas(spark, sf_dir)
    dates = {"pop_latest_date": F.lit(None).cast("date"), "last_census_year": F.lit(None).cast("int"), "code": F.col("id")}
    tree = tree.withColumns(dates | {"ordinal": F.col("level").cast("long")})
    held = tree.where("level = 3 AND entity_type = 'BUILDING'").select("parent_id").distinct()
    nation = table(spark, sf_dir, "nation").withColumn("parent_id", F.concat(F.lit("n"), "n_nationkey")).join(held, "parent_id", "left_semi")
    region = table(spark, sf_dir, "region").join(nation, F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    shape = lambda rows, key, sign, name, level, of, types, place: rows.select((F.col(key) + place).cast("long").alias("place"), F.concat(F.lit(f"{name.lower()}-{sign}"), key).alias("city"), F.lit(name).alias("name"), F.lit(level).alias("level"), F.lit(name).alias("entity_type"), F.array(F.lit(types)).alias("district_types"), F.create_map(F.lit(level - 1), F.array(of)).alias("parent_from"), F.array().cast("array<string>").alias("communes"))
    configs = shape(nation, "n_nationkey", "n", "City", 3, F.lower("n_name"), "building", 0)
    configs = configs.unionByName(shape(region, "r_regionkey", "r", "Metro", 2, F.concat(F.lit("r"), "r_regionkey"), "CITY", 1000))
    out, _ = cities_of(tree, configs)
    return out.select("id", "name", "level", "parent_id", "entity_type", F.col("pop_latest").alias("pop"), F.round(F.col("area_km2").cast("double"), 2).alias("area"))




def named(spark, sf_dir):
    supplier, capital = table(spark, sf_dir, "supplier"), F.concat(F.lit("c"), "s_suppkey").alias("capital")
    own = supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("area"), capital).unionByName(supplier.select(F.concat(F.lit("r"), F.col("s_suppkey") % 5).alias("area"), capital))
    return own.unionByName(supplier.select(F.lit("zz").alias("area"), F.lit("c1").alias("capital"))).distinct()


@query(with_areas(NAMED + " SELECT area, capital FROM good"))
def capital_valid(spark, sf_dir):
    """Capitals of a map that exist and lie in their area."""
    return capitals.valid(named(spark, sf_dir), areas(spark, sf_dir))


@query(with_areas(NAMED + """, cur AS (SELECT area, min(capital) AS capital FROM good GROUP BY 1), n AS (SELECT area, string_agg(capital, '|' ORDER BY capital) AS c FROM good GROUP BY 1)
SELECT a.area, coalesce(c, '') AS capitals, coalesce(c, '') <> coalesce(capital, '') AS changed FROM (SELECT DISTINCT area FROM named WHERE area IN (SELECT id FROM area)) a LEFT JOIN n USING (area) LEFT JOIN cur USING (area)"""))
def capital_assign(spark, sf_dir):
    """Each area's capitals set from the map, and whether the set is another one than before (its first capital)."""
    tree, wanted = areas(spark, sf_dir), named(spark, sf_dir)
    before = capitals.valid(wanted, tree).groupBy("area").agg(F.min("capital").alias("capital"))
    out = capitals.replaced(before, wanted, tree)
    return out.select("area", F.array_join("capitals", "|").alias("capitals"), "changed")


@query(with_areas(""", asked AS (SELECT 'k'||s_suppkey % 7 AS container, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE 'N'||s_nationkey END AS label, unnest(['r'||s_suppkey % 5, 'r'||n_regionkey]) AS country, unnest([0, 1]) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey),
known AS (SELECT parent_id AS country, id, lower(name) AS key, 1 AS tier FROM area WHERE level = 2 UNION ALL SELECT parent_id, id, lower(id), 2 FROM area WHERE level = 2)
SELECT container, label, arg_min(id, struct_pack(p := place, t := tier, i := id)) AS id FROM asked JOIN known ON known.country = asked.country AND key = lower(label) GROUP BY 1, 2"""))
def container_capitals(spark, sf_dir):
    """Containers' capitals, sought in their countries in order, at the legal level, by name and then by code."""
    tree = areas(spark, sf_dir).where("level = 2").select(F.col("parent_id").alias("country"), "id", "name", F.col("id").alias("code"), "level", F.lit(2).alias("legal_level"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("N"), "s_nationkey"))
    countries = F.array(F.concat(F.lit("r"), F.col("s_suppkey") % 5), F.concat(F.lit("r"), "n_regionkey"))
    asked = rows.select(F.concat(F.lit("k"), F.col("s_suppkey") % 7).alias("container"), label.alias("label"), F.posexplode(countries).alias("place", "country"))
    return capitals.container_capitals(asked, tree)


@query(with_areas(SPEC + """, m AS (SELECT territory, node FROM grown WHERE sign = 'include' EXCEPT SELECT territory, node FROM grown WHERE sign = 'subtract'),
asked AS (SELECT territory, any_value(parent_id) AS p, min(node) AS first, max(node) AS last FROM m JOIN area ON id = node GROUP BY 1)
SELECT territory, 'nation of '||first AS label, (SELECT parent_id FROM area WHERE id = first) AS id FROM asked UNION ALL SELECT territory, ' '||upper((SELECT name FROM area WHERE id = last)), last FROM asked"""))
def territory_capitals(spark, sf_dir):
    """Capitals of territories: at the legal level where a member lies below the candidate, else a member by name."""
    tree = areas(spark, sf_dir)
    held = territory.members(spec(spark, sf_dir), tree, 3).withColumnRenamed("node", "id")
    ends = checkpointed(held.groupBy("territory").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    own = tree.select(F.col("id").alias("last"), "name").hint("merge")
    asked = ends.select("territory", F.concat(F.lit("nation of "), "first").alias("label")).unionByName(ends.join(own, "last").select("territory", F.concat(F.lit(" "), F.upper("name")).alias("label")))
    legal = tree.where("level = 3").select(F.concat(F.lit("nation of "), "id").alias("label"), F.col("parent_id").alias("id"))
    macros = held.limit(0).select("territory", "id")
    return capitals.spec_capitals(asked, legal, held, macros, tree.withColumn("code", F.col("id")))


@query(with_areas(""", old AS (SELECT id, CASE WHEN level = 2 THEN 'c'||substr(id, 2) END AS top FROM area), leaf3 AS (SELECT ancestor AS id, arg_min(node, struct_pack(p := -pop, n := node)) AS top FROM closure JOIN area ON id = node WHERE dist > 0 AND level = 3 AND pop IS NOT NULL GROUP BY 1)
SELECT n.id, n.top AS most_populated FROM leaf3 n JOIN old o USING (id) WHERE n.top IS DISTINCT FROM o.top"""))
def most_populated_changes(spark, sf_dir):
    """Pointers to the most populated place that differ from those that stand (here: the one with the nation's number)."""
    tree = areas(spark, sf_dir)
    old = tree.select("id", F.when(F.col("level") == 2, F.concat(F.lit("c"), F.substring("id", 2, 20))).alias("most_populated"))
    return capitals.pointer_changes(old, hierarchy.most_populated(tree), "id", "most_populated")


@query(with_areas("SELECT id, coalesce(seats, 0) + CASE WHEN level = 3 AND pop > 5000 THEN 1 ELSE 0 END AS seats FROM area WHERE seats IS NULL OR (level = 3 AND pop > 5000)"))
def seat_changes(spark, sf_dir):
    """Seats that differ from those that stand; unknown ones differ from 0."""
    old = areas(spark, sf_dir).select("id", "level", "pop_latest", F.col("representatives").alias("seats"))
    more = F.when((F.col("level") == 3) & (F.col("pop_latest") > 5000), 1).otherwise(0)
    return capitals.pointer_changes(old, old.select("id", (F.coalesce("seats", F.lit(0)) + more).alias("seats")), "id", "seats")


@query(with_areas(SPEC + """, tot AS (SELECT territory, CAST(sum(f * coalesce(pop, 0)) AS BIGINT) AS pop, sum(f * coalesce(km2, 0)) AS area FROM (SELECT territory, id, 1 AS f FROM spec WHERE sign = 'include' UNION ALL SELECT territory, node, -1 FROM grown WHERE sign = 'subtract') JOIN area USING (id) GROUP BY 1),
u AS (SELECT territory AS id, 'p'||(CAST(substr(territory, 2) AS INT) % 6) AS parent_id, 3 AS level, pop, area FROM tot), p AS (SELECT parent_id AS id, 's'||(CAST(substr(parent_id, 2) AS INT) % 2) AS parent_id, 2 AS level, CAST(sum(pop) AS BIGINT) AS pop, sum(area) AS area FROM u GROUP BY 1),
s AS (SELECT parent_id AS id, 'top' AS parent_id, 1 AS level, CAST(sum(pop) AS BIGINT) AS pop, sum(area) AS area FROM p GROUP BY 1)
SELECT id, parent_id, level, pop, CAST(area AS DOUBLE) AS area FROM (SELECT * FROM u UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s UNION ALL SELECT 'top', NULL, 0, CAST(sum(pop) AS BIGINT), sum(area) FROM s)"""))
def tree_build(spark, sf_dir):
    """A derived tree: territories in provinces in states, the containers' values rolled up deepest first."""
    totals = territory.totals(spec(spark, sf_dir), areas(spark, sf_dir), 3)
    number = F.substring("territory", 2, 9).cast("int")
    rows = totals.select(F.col("territory").alias("id"), F.concat(F.lit("p"), number % 6).alias("parent_id"), F.lit(3).alias("level"), "territory")
    one = lambda rows, level, number: rows.select(F.col("parent_id").alias("id"), number.alias("parent_id"), F.lit(level).alias("level"), F.lit(None).cast("string").alias("territory")).distinct()
    provinces = one(rows, 2, F.concat(F.lit("s"), F.substring("parent_id", 2, 9).cast("int") % 2))
    states = one(provinces, 1, F.lit("top"))
    recipes = rows.unionByName(provinces).unionByName(states).withColumns({"name": F.col("id"), "entity_type": F.lit("Part")})
    root = spark.range(1).select(F.lit("top").alias("id"), F.lit("Top").alias("name"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("level"), F.lit("Country").alias("entity_type"))
    out = build.tree(recipes, totals, root)
    return out.select("id", "parent_id", "level", F.col("pop_latest").alias("pop"), F.col("area_km2").cast("double").alias("area"))


@query(with_areas("""SELECT id, name, country, seats FROM (SELECT id, name, CASE WHEN id = 'w' THEN 'w' ELSE 'r'||(length(id) % 5) END AS country, seats FROM area) WHERE country <> 'r2' OR id = 'n7'
UNION ALL SELECT 'new'||s_suppkey, s_name, 'r2', NULL FROM supplier"""))
def tree_rebuild(spark, sf_dir):
    """A country's nodes replaced by new ones without seats; its root and other countries stay."""
    nodes = areas(spark, sf_dir).select("id", "name", F.when(F.col("id") == "w", F.lit("w")).otherwise(F.concat(F.lit("r"), F.length("id") % 5)).alias("country"), "representatives")
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("new"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return build.rebuilt(nodes, new, "r2", "n7").select("id", "name", "country", F.col("representatives").alias("seats"))


@query("""SELECT o_custkey AS area, o_orderkey AS unit FROM orders WHERE o_custkey % 3 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT c_custkey, c_custkey * 10 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0""")
def links_replaced(spark, sf_dir):
    """Links of every third customer set anew, cleared for those with odd numbers."""
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("area"), F.col("o_orderkey").alias("unit"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("area"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 10).alias("unit"))
    return build.links_replaced(links, new, "area")


@query("SELECT c_custkey, c_mktsegment AS country FROM customer WHERE c_mktsegment <> 'BUILDING'")
def country_reset(spark, sf_dir):
    """All nodes but a country's."""
    return build.without_country(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("country")), "BUILDING")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'spain' WHEN 1 THEN 'morocco' WHEN 2 THEN 'given' ELSE 'france_'||p_partkey END AS source, CASE WHEN p_size = p_size % 7 THEN CAST(p_size AS VARCHAR) ELSE p_size||','||p_size % 7 END AS items, 'x_'||p_partkey||'_'||p_size AS id FROM part""")
def recipe_sources(spark, sf_dir):
    """Countries of sources by a derived country's name, lists joined without repeats, composite ids."""
    i, size = F.col("p_partkey") % 4, F.col("p_size")
    country = F.concat(F.when(i == 0, F.when(size % 2 == 0, "spanish_").otherwise("spain_")).when(i == 1, "morocco_").when(i == 2, "spain_").otherwise("france_"), "p_partkey")
    items = build.listed(F.array(size, size % 7), F.array(size % 7, size))
    source = build.source_country(country, F.when(i == 2, F.lit("given")))
    return table(spark, sf_dir, "part").select("p_partkey", source.alias("source"), F.array_join(items, ",").alias("items"), text.composite_id(F.lit("x"), F.col("p_partkey").cast("string"), size.cast("string")).alias("id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS amount, CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
CASE WHEN o_orderkey % 3 < 2 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) END AS shown FROM orders""")
def typed_text(spark, sf_dir):
    """Decimals and dates out of text, null where it is none, and fixed decimals as text."""
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    i, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    amount = text.decimal_of(F.when(i == 0, F.concat(F.lit(" "), price)).when(i == 1, price).otherwise(F.concat(price, F.lit(" km"))))
    j = F.col("o_orderkey") % 4
    date = text.date_of(F.when(j == 0, day).when(j == 1, F.concat(day, F.lit("T10:00:00"))).when(j == 2, F.lit("2021-02-30")).otherwise(F.concat(F.lit("on "), day)))
    return table(spark, sf_dir, "orders").select("o_orderkey", amount.alias("amount"), date.cast("string").alias("day"), text.fixed(amount).alias("shown"))


@query(with_areas(""", p AS (SELECT id, name, row_number() OVER (ORDER BY level, id) AS r, count(*) OVER () AS n FROM area WHERE level > 1 AND level <= 3)
SELECT 'far' AS asked, id, name FROM p WHERE r > (ceil(n / 50.0) - 1) * 50 UNION ALL SELECT 'x', id, name FROM p WHERE r <= 50 UNION ALL SELECT '3', id, name FROM p WHERE r > 100 AND r <= 150"""))
def page_clamp(spark, sf_dir):
    """Pages of 50: a page that is no number is the first, one beyond the end the last."""
    rows = areas(spark, sf_dir).where("level > 1 AND level <= 3").select("level", "id", "name")
    pages = [changes.page(rows, ["level", "id"], asked, 50).select(F.lit(name).alias("asked"), "id", "name") for name, asked in (("far", "1000000000"), ("x", "x"), ("3", "3"))]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("SELECT page_id, CASE WHEN html IS NULL OR page_id % 6 = 5 THEN 'missing' WHEN page_id % 6 IN (1, 2) OR regexp_matches(lower(substr(html, 1, 4000)), 'captcha|just a moment|access denied|cloudflare') THEN 'blocked' ELSE 'ok' END AS status FROM pages")
def page_errors(spark, sf_dir):
    """Fetched pages by what they are: missing (404), blocked (403, a captcha or a challenge), or usable."""
    i = F.col("page_id") % 6
    code = F.when(i == 5, 404).when(i == 1, 403).otherwise(200)
    html = F.when(i == 2, F.concat(F.lit("<html><title>Just a moment...</title> please solve the CAPTCHA "), F.coalesce("html", F.lit("")))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", changes.fetch_status(code, html).alias("status"))


@query(with_areas(""", x AS (SELECT a.id AS leaf, w.name AS root, n.id AS nation, n.name AS nation_name, r.id AS region, r.name AS region_name, r.id||'>'||n.id||'>'||a.id AS path FROM area a JOIN area n ON n.id = a.parent_id JOIN area r ON r.id = n.parent_id JOIN area w ON w.id = r.parent_id WHERE a.level = 3),
c AS (SELECT sum(pop) AS pop FROM area WHERE level = 1)
SELECT leaf, path, CASE WHEN path = (SELECT min(path) FROM x) THEN root END AS root, CASE WHEN path = (SELECT min(path) FROM x) THEN CAST((SELECT pop FROM c) AS BIGINT) END AS root_pop,
CASE WHEN row_number() OVER (PARTITION BY region ORDER BY path) = 1 THEN region_name END AS region_name, CASE WHEN row_number() OVER (PARTITION BY nation ORDER BY path) = 1 THEN nation_name END AS nation_name FROM x"""))
def export_rows(spark, sf_dir):
    """The export's rows: an area's cells stand on its first row, the country's on the very first; its total is that of
    the level below it."""
    tree = areas(spark, sf_dir)
    up = hierarchy.climbed(tree, "name", "level").where(F.get("steps", F.lit(0))["level"] == 3)
    at = lambda n, c: F.element_at("steps", n + 1)[c]
    rows = up.select(F.col("node").alias("leaf"), at(1, "id").alias("nation"), at(1, "name").alias("nation_name"), at(2, "id").alias("region"), at(2, "name").alias("region_name"), at(3, "name").alias("root"))
    rows = rows.withColumn("path", F.concat_ws(">", "region", "nation", "leaf")).crossJoin(F.broadcast(export.country_totals(tree, 1).select(F.col("pop").alias("root_pop"))))  # one row
    out = export.shown_once(rows, "path", ["region", "nation"], {"region": ["region_name"], "nation": ["nation_name"]}, ["root", "root_pop"])
    return out.select("leaf", "path", "root", "root_pop", "region_name", "nation_name")


@query(with_areas("SELECT id, CAST(coalesce(nullif((SELECT count(*) FROM area x WHERE x.parent_id = area.id), 0), u.units) AS BIGINT) AS n FROM area LEFT JOIN (SELECT 'c'||o_custkey AS k, count(*) AS units FROM orders GROUP BY 1) u ON u.k = area.id"))
def subdivision_counts(spark, sf_dir):
    """How many children an area has, else of how many source units it is made."""
    units = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("id")).agg(F.count("*").alias("units"))
    return export.subdivisions(areas(spark, sf_dir), units)


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'absent' WHEN o.c_name <> n.c_name THEN 'updated' ELSE 'kept' END AS status
FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) o FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name||'!' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 4 <> 0) n ON o.c_custkey = n.c_custkey) GROUP BY 1""")
def change_counters(spark, sf_dir):
    """How many rows a run creates, updates, keeps and finds absent."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    new = customers.where("c_custkey % 4 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return changes.merged(customers.where("c_custkey % 5 <> 0"), new, "c_custkey").groupBy("status").agg(F.count("*").alias("n"))


@query(with_areas("SELECT id, name FROM area WHERE (id ILIKE '%7%' OR name ILIKE '%7%') AND entity_type = 'MACHINERY'"))
def area_search(spark, sf_dir):
    """Areas of a type whose id or name holds a text."""
    return changes.searched(areas(spark, sf_dir), "7", ["id", "name"]).where("entity_type = 'MACHINERY'").select("id", "name")


@query(with_areas("SELECT 'w' AS root, CAST(max(level) AS INT) AS deepest FROM area"))
def atomic_levels(spark, sf_dir):
    """The deepest level of each country."""
    return hierarchy.atomic_levels(areas(spark, sf_dir))


@query("SELECT event_type, strftime(max(CASE WHEN event_id % 3 > 0 THEN ts END), '%Y-%m-%d') AS latest, CAST(max(CASE WHEN event_id % 5 > 0 THEN user_id % 150 + 1850 END) AS BIGINT) AS census FROM events GROUP BY 1")
def latest_known(spark, sf_dir):
    """The latest known date and census year of each group, unknown ones left out."""
    return cities.latest(table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 > 0, F.to_date("ts")).alias("date"), F.when(F.col("event_id") % 5 > 0, F.col("user_id") % 150 + 1850).alias("year")), "event_type", "date", "year").select("event_type", F.col("date").cast("string").alias("latest"), F.col("year").cast("long").alias("census"))
