"""Queries on recipes: countries derived from nations, written as nested JSON out of the given tables and read back.

A recipe for every nation and block of customers: a node per market segment, whose childs take the nation less some
customers, list customers, or join a customer with a supplier of the second source country, `v`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import derive
from cartulary.plans.pages import BLOCK
from cartulary.sources import recipes
from cartulary.sources.areas import areas, checkpointed, table, with_areas

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, recipe). Customers of a segment fall into three childs by number; codes are given, left out, or composed
    already; labels are single or lists; every fifth nation's may name a supplier that there isn't."""
    key, k = F.col("c_custkey"), F.col("k")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.col("n_nationkey").alias("k"), "n_name", F.floor(key / BLOCK).alias("b"), F.col("c_mktsegment").alias("s"), (key % 3).alias("p")).agg(F.array_sort(F.collect_list("c_name")).alias("names"), F.min("c_custkey").alias("least"))
    code = F.when(k % 2 == 0, F.concat(F.lit("X"), F.left("s", F.lit(1)))).otherwise(F.col("s"))
    number = F.when(k % 5 == 0, F.col("least")).otherwise(F.col("least") % 10 + 1).cast("string")
    supplier = F.concat(F.lit("Supplier#"), F.lpad(number, 9, "0"))
    one = lambda **fields: F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())))
    held = lambda *pairs: F.create_map(*(x for name, value in pairs for x in (F.lit(name), value)))
    plain = lambda inner: F.concat(F.lit("{"), *inner, F.lit("}"))
    quoted = lambda text: F.concat(F.lit('"'), text, F.lit('"'))
    inner = one(name=F.lit("inner"), capitals=F.array("n_name"), level=F.lit(None).cast("int"))
    spec = plain([F.lit('"2":'), F.to_json(held(("w", F.lower("n_name")))), F.lit(',"restar":{"3":'), F.to_json(held(("w", F.col("names")))), F.lit("}")])
    listing = one(name=F.lit("listed"), code=F.concat(code, F.lit("-LS")), entity_type=F.lit("List"), dat=held(("3", F.col("names"))), capitals=F.array(F.get("names", F.lit(0))))
    both = plain([F.lit('"name":"both","forced_area_km2":12.345,"capital":'), quoted(supplier), F.lit(',"auto_set_most_populated":false,"spec":{"3":{"w":'), quoted(F.get("names", F.lit(0))), F.lit('},"2":{"v":['), quoted(supplier), F.lit("]}}")])
    with_spec = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"spec":'), F.col("spec"), F.lit("}"))
    child = rows.withColumns({"j": inner, "spec": spec}).withColumn("child", F.when(F.col("p") == 0, with_spec).when(F.col("p") == 1, listing).otherwise(both))
    nodes = child.groupBy("k", "b", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "child"))), lambda c: c["child"]).alias("childs"))
    node = F.concat(F.lit('{"name":'), quoted(F.col("s")), F.when(k % 2 == 0, F.concat(F.lit(',"code":'), quoted(F.concat(F.lit("X"), F.left("s", F.lit(1)))))).otherwise(""), F.lit(',"childs":['), F.array_join("childs", ","), F.lit("]}"))
    seats = F.when(k % 7 == 0, "").when(k % 2 == 0, F.lit(',"REPRESENTATION":{"level":1,"habitant":5000,"system":"dhondt"}')).otherwise(F.concat(F.lit(',"ESCANHOS":[{"nivel":2,"escanhos":'), (k + 10).cast("string"), F.lit(',"min":1}]')))
    whole = nodes.withColumn("node", node).groupBy("k", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "node"))), lambda c: c["node"]).alias("nodes"))
    text = F.concat(F.lit('{"SOURCE_COUNTRY":"w","DIVISIONS":['), F.array_join("nodes", ","), F.lit("]"), seats, F.lit("}"))
    return checkpointed(whole.select(F.concat(F.lit("d"), "k", F.lit("-"), "b").alias("country"), text.alias("recipe")))


RECIPES = f""", cu AS (SELECT n_nationkey AS k, c_custkey // {BLOCK} AS b, c_mktsegment AS s, c_custkey % 3 AS p, c_custkey AS key, c_name AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT 'd'||k||'-'||b AS country, k, b, s, p, n_name, min(key) AS least, min(name) AS name, CASE WHEN k % 2 = 0 THEN 'X'||left(s, 1) ELSE s END AS seg,
  CASE p WHEN 0 THEN 'inner' WHEN 1 THEN 'LS' ELSE 'both' END AS own, dense_rank() OVER (PARTITION BY k, b ORDER BY s) - 1 AS i, row_number() OVER (PARTITION BY k, b, s ORDER BY p) - 1 AS j,
  'Supplier#'||lpad(CAST(CASE WHEN k % 5 = 0 THEN min(key) ELSE min(key) % 10 + 1 END AS VARCHAR), 9, '0') AS supplier FROM cu GROUP BY k, b, s, p, n_name)"""


@query(with_areas(RECIPES + """ SELECT DISTINCT country, CAST(i AS VARCHAR) AS path, seg AS code, CAST(NULL AS VARCHAR) AS parent_code, s AS name, CAST(NULL AS VARCHAR) AS entity_type, 1 AS level, 'container' AS kind, CAST(NULL AS DOUBLE) AS forced, '' AS capitals FROM g
UNION ALL SELECT country, i||'.'||j, seg||'-'||own, seg, CASE p WHEN 1 THEN 'listed' ELSE own END, CASE p WHEN 1 THEN 'List' ELSE 'Subdivision' END, 2, 'spec', CASE p WHEN 2 THEN 12.345 END, CASE p WHEN 0 THEN n_name WHEN 1 THEN name ELSE supplier END FROM g"""))
def recipe_nodes(spark, sf_dir):
    """Nested recipes as a row per node, codes composed from the top down."""
    rows = recipes.nodes(texts(spark, sf_dir))
    return rows.select("country", F.array_join("path", ".").alias("path"), "code", "parent_code", "name", "entity_type", "level", "kind", F.col("forced_area_km2").cast("double").alias("forced"), F.array_join("capitals", "|").alias("capitals"))


@query(with_areas(RECIPES + """ SELECT country, seg||'-'||own AS code, sign, CAST(level AS INT) AS level, source, label, CAST(place AS INT) AS place FROM
(SELECT country, seg, own, 'include' AS sign, 2 AS level, 'w' AS source, lower(n_name) AS label, 0 AS place FROM g WHERE p = 0
UNION ALL SELECT g.country, seg, own, CASE p WHEN 0 THEN 'subtract' ELSE 'include' END, 3, 'w', cu.name, row_number() OVER (PARTITION BY k, b, s, p ORDER BY cu.name) - 1 FROM g JOIN cu USING (k, b, s, p) WHERE p < 2
UNION ALL SELECT country, seg, own, 'include', 3, 'w', name, 0 FROM g WHERE p = 2 UNION ALL SELECT country, seg, own, 'include', 2, 'v', supplier, 0 FROM g WHERE p = 2)"""))
def recipe_rows(spark, sf_dir):
    """Specifications, short forms included, as a row per label."""
    return recipes.labels(recipes.nodes(texts(spark, sf_dir))).select("country", "code", "sign", "level", "source", "label", "place")


@query(with_areas(RECIPES + " SELECT DISTINCT country, CASE WHEN k % 2 = 0 THEN 1 ELSE 2 END AS level, CASE WHEN k % 2 = 1 THEN k + 10 END AS total, CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END AS minimum, CASE WHEN k % 2 = 0 THEN 5000 END AS habitant, 'dhondt' AS system FROM g WHERE k % 7 > 0"))
def recipe_seats(spark, sf_dir):
    """Seat rules of recipes, those in the older form as well."""
    return recipes.seat_rules(texts(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of two source countries: the tree `w`, and `v`, with suppliers below their nations."""
    columns = ("source", "id", "code", "name", "level", "parent_id", "pop_latest", "area_km2")
    own = areas(spark, sf_dir).withColumns({"source": F.lit("w"), "code": F.col("id")}).select(*columns)
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(2).alias("level"), F.concat(F.lit("vn"), "s_nationkey").alias("parent_id"), F.floor(F.abs("s_acctbal")).cast("long").alias("pop_latest"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("vn"), "n_nationkey").alias("id"), F.concat(F.lit("Vice "), "n_name").alias("name"), F.lit(1).alias("level"), F.lit("v").alias("parent_id"), F.lit(None).cast("long").alias("pop_latest"))
    other = supplier.unionByName(nation).withColumns({"source": F.lit("v"), "code": F.col("id"), "area_km2": F.lit(None).cast("decimal(12,2)")})
    return own.unionByName(other.select(*columns))


def derived(spark: SparkSession, sf_dir: str) -> derive.Derived:
    atomic = spark.createDataFrame([("w", 3), ("v", 2)], "source string, atomic int")
    legal = spark.createDataFrame([("w", 2), ("v", 1)], "source string, legal_level int")
    return derive.derived(texts(spark, sf_dir), checkpointed(sources(spark, sf_dir)), atomic, legal)


BAD = ", bad AS (SELECT country, i||'.'||j AS path, seg||'-'||own AS code, 'no area of this label' AS rule, supplier AS label FROM g WHERE p = 2 AND supplier NOT IN (SELECT s_name FROM supplier))"


@query(with_areas(RECIPES + BAD + " SELECT * FROM bad"))
def derived_violations(spark, sf_dir):
    """All that is wrong with the recipes, a row each."""
    return derived(spark, sf_dir).violations.withColumn("path", F.array_join("path", "."))


@query(with_areas(RECIPES + BAD + """, ok AS (SELECT * FROM g WHERE country NOT IN (SELECT country FROM bad)),
leaf3 AS (SELECT cu.*, 'c'||key AS id, a.parent_id, pop, km2 FROM cu JOIN area a ON a.id = 'c'||key), sup AS (SELECT s_name, 's'||s_suppkey AS id, CAST(floor(abs(s_acctbal)) AS BIGINT) AS pop FROM supplier),
sums AS (SELECT k, b, s, p, sum(coalesce(pop, 0)) AS pop, sum(coalesce(km2, 0)) AS km2, arg_min(id, struct_pack(x := -pop, y := id)) FILTER (pop IS NOT NULL) AS top FROM leaf3 GROUP BY ALL),
t AS (SELECT country, seg, own, p, ok.name, CASE p WHEN 0 THEN n.pop - x.pop WHEN 1 THEN x.pop ELSE coalesce(f.pop, 0) + sup.pop END AS pop, CASE p WHEN 0 THEN n.km2 - x.km2 WHEN 1 THEN x.km2 ELSE 12.35 END AS km2,
  CASE p WHEN 0 THEN n.id WHEN 1 THEN f.id ELSE sup.id END AS capital, CASE p WHEN 0 THEN (SELECT arg_min(l.id, struct_pack(x := -l.pop, y := l.id)) FROM leaf3 l WHERE l.k = ok.k AND l.pop IS NOT NULL AND NOT (l.b = ok.b AND l.s = ok.s AND l.p = ok.p)) WHEN 1 THEN x.top END AS top
  FROM ok JOIN area n ON n.id = 'n'||ok.k JOIN sums x USING (k, b, s, p) JOIN leaf3 f ON f.key = least LEFT JOIN sup ON s_name = supplier),
seg AS (SELECT country, seg, any_value(s) AS s, sum(t.pop) AS pop, sum(t.km2) AS km2 FROM t JOIN (SELECT DISTINCT country, seg, s FROM ok) USING (country, seg) GROUP BY 1, 2)
SELECT country||'-'||seg||'-'||own AS id, country, seg||'-'||own AS code, CASE p WHEN 1 THEN 'listed' ELSE own END AS name, country||'-'||seg AS parent_id, 2 AS level, CASE p WHEN 1 THEN 'List' ELSE 'Subdivision' END AS entity_type, CAST(pop AS BIGINT) AS pop, CAST(km2 AS DOUBLE) AS area, capital AS capitals, top AS most_populated FROM t
UNION ALL SELECT country||'-'||seg, country, seg, s, country, 1, NULL, CAST(pop AS BIGINT), CAST(km2 AS DOUBLE), '', NULL FROM seg
UNION ALL SELECT country, country, country, 'D'||substr(replace(country, '-', ' '), 2), NULL, 0, 'Country', CAST(sum(pop) AS BIGINT), CAST(sum(km2) AS DOUBLE), '', NULL FROM seg GROUP BY country"""))
def derived_trees(spark, sf_dir):
    """Derived countries' trees: territories, containers and roots with values, capitals and most populated places."""
    out = derived(spark, sf_dir).tree
    return out.select("id", "country", "code", "name", "parent_id", "level", "entity_type", F.col("pop_latest").alias("pop"), F.col("area_km2").cast("double").alias("area"), F.array_join("capitals", "|").alias("capitals"), "most_populated")
