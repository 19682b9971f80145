"""Queries that run whole programs over pages: the area tree is written as pages of several layouts, some of which fail,
and countries (the regions) are read, saved over an older table, and given their pointers and seats."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import scraping
from cartulary.plans.pages import BLOCK, HEAD, row, safe
from cartulary.sources.areas import areas, checkpointed, table, with_areas
from cartulary.sources.configs import page_url

QUERIES, ORACLES = {}, {}
BASE = "https://pages.example/"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@query("""WITH new AS (SELECT 'g'||c_custkey % 3 AS country, c_custkey AS k, CAST(c_custkey % 4 AS INT) AS level, CASE WHEN c_custkey % 10 > 0 THEN c_custkey + 3 * (c_custkey * 7 % 11 - 5) END AS p FROM customer),
old AS (SELECT 'g'||c_custkey % 3 AS country, c_custkey AS k FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT 'g'||s_suppkey % 3, -s_suppkey FROM supplier)
SELECT n.country||'_'||n.k AS id, n.level, CASE WHEN o.k IS NOT NULL OR (m.level, m.k) < (n.level, n.k) THEN n.country||'_'||n.p END AS parent_id, CASE WHEN b.k IS NULL THEN 'created' ELSE 'updated' END AS status
FROM new n LEFT JOIN old o ON o.country = n.country AND o.k = n.p LEFT JOIN new m ON m.country = n.country AND m.k = n.p LEFT JOIN old b ON b.country = n.country AND b.k = n.k
UNION ALL SELECT country||'_'||k, 1, NULL, 'deleted' FROM old WHERE k < 0""")
def upsert_parents(spark, sf_dir):
    """Areas saved over old ones: parents that stood before, that come earlier, later or never, and areas that go."""
    customer, supplier, key = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), F.col("c_custkey")
    country = lambda k: F.concat(F.lit("g"), k % 3)
    parent = F.when(key % 10 > 0, (key + 3 * (key * 7 % 11 - 5)).cast("string"))
    new = customer.select(country(key).alias("country_code"), key.cast("string").alias("code"), (key % 4).cast("int").alias("level"), parent.alias("parent_code"), key.alias("ordinal"))
    old = customer.where("c_custkey % 6 = 0").select(country(key).alias("country_code"), key.cast("string").alias("code"))
    old = old.unionByName(supplier.select(country(F.col("s_suppkey")).alias("country_code"), (-F.col("s_suppkey")).cast("string").alias("code"))).withColumns({"id": F.concat_ws("_", "country_code", "code"), "level": F.lit(1)})
    empty = {c: F.lit(None).cast("string") for c in (*scraping.SET, *scraping.LEFT)}
    both = [df.withColumns({c: v for c, v in empty.items() if c not in df.columns}) for df in (new, old)]
    return scraping.saved(checkpointed(both[0].drop("parent_id")), both[1]).select("id", "level", "parent_id", "status")


def page_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(plan, store): a region is a country, with a page about it, and of each nation's places a page for every BLOCK of
    numbers: of layout admin for even nations, double for odd ones, both for every third. Region 3 has pages that fail."""
    tree = areas(spark, sf_dir)
    inner = tree.where("level = 2").select(F.col("id").alias("nation"), F.col("name").alias("nation_name"), F.col("parent_id").alias("region"))
    leaves = tree.where("level = 3").withColumn("key", F.substring("id", 2, 20).try_cast("long")).withColumn("block", F.floor(F.col("key") / BLOCK))
    held = leaves.groupBy(F.col("parent_id").alias("nation"), "block").agg(F.array_sort(F.collect_list(F.struct("key", "id", "name", "entity_type", "pop_latest", "area_km2"))).alias("people")).join(inner, "nation")
    number = F.substring("nation", 2, 9).cast("int")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    named = text("<tbody class='admin0'><tr onclick=\"javascript:sym('", F.col("nation"), "')\"><td class='rname' title='Nation'>", safe(F.col("nation_name")), "</tr></tbody>")
    people = F.array_join(F.transform("people", lambda p: row(p, in_attribute=p["key"] % 2 == 0)), "")
    admin = text(f"<html><body><table id='tl'>{HEAD}", named, "<tbody class='admin1'>", people, "</tbody></table></body></html>")
    first = text("<tr><td class='rname' id='i", F.col("nation"), "'>", safe(F.col("nation_name")), "</tr>")
    rows = F.array_join(F.transform("people", lambda p: row(p, text("<td class='radm' data-admid='", F.col("nation"), "'>"), p["key"] > -1)), "")
    double = text(f"<html><body><h2>Contents: Nations</h2><table id='tl'>{HEAD}<tbody>", first, f"</tbody></table><h2>Places</h2><table id='ts'>{HEAD}<tbody>", rows, "</tbody></table></body></html>")
    place = (number * 10_000_000 + F.col("block") * 2 + 1).cast("long")
    shape = lambda layout, html, more, where: held.where(where).select(F.col("region").alias("slug"), (place + more).alias("place"), text(F.col("nation"), "/", F.col("block").cast("string"), f"/{layout}").alias("path"), F.lit(layout).alias("layout"), F.lit(1).alias("lowest_level"), html.alias("html"))
    pages = shape("admin", admin, 0, (number % 2 == 0) | (number % 3 == 0)).unionByName(shape("double", double, 1, (number % 2 == 1) | (number % 3 == 0)))
    about = text("<html><body><section class='infosection mainsection'><div class='infoname'>", safe(F.col("name")), "</div><div class='infotext'>Region</div><p data-newpop='", F.coalesce(F.col("pop_latest").cast("string"), F.lit("")), "' data-newdate='2021-07-01'></p></section></body></html>")
    roots = tree.where("level = 1").select(F.col("id").alias("slug"), F.lit(0).cast("long").alias("place"), F.lit("info").alias("path"), F.lit("infosection").alias("layout"), F.lit(0).alias("lowest_level"), about.alias("html"))
    odd = spark.createDataFrame([("r3", -1, "odd", "mosaic", 0, "<html></html>")], "slug string, place long, path string, layout string, lowest_level int, html string")
    both = pages.unionByName(roots).unionByName(odd).withColumn("country_code", F.col("slug")).withColumn("url", page_url(F.lit(BASE), F.concat("slug", F.lit("/"), "path")))
    both = checkpointed(both.repartition(spark.sparkContext.defaultParallelism, "url"))
    plan = both.select("slug", "country_code", "place", "path", "layout", "lowest_level", "url")
    refused = (F.col("slug") == "r3") & (F.col("layout") == "double")
    store = both.where("slug <> 'r3' OR path <> 'info'").select("url", F.when(refused, 403).otherwise(200).alias("code"), "html")
    return plan, store


PAGES_SQL = f"""leaf3 AS (SELECT a.*, CAST(substr(a.id, 2) AS BIGINT) AS k, CAST(substr(a.id, 2) AS BIGINT) // {BLOCK} AS b, n.id AS nation, CAST(substr(n.id, 2) AS INT) AS n, n.parent_id AS region FROM area a JOIN area n ON n.id = a.parent_id WHERE a.level = 3),
page AS (SELECT region AS slug, n * 10000000 + b * 2 + 1 AS place, nation||'/'||b||'/admin' AS path, 'admin' AS layout, 1 + count(*) AS found FROM leaf3 WHERE n % 2 = 0 OR n % 3 = 0 GROUP BY region, n, b, nation
UNION ALL SELECT region, n * 10000000 + b * 2 + 2, nation||'/'||b||'/double', 'double', 1 + count(*) FROM leaf3 WHERE n % 2 = 1 OR n % 3 = 0 GROUP BY region, n, b, nation
UNION ALL SELECT id, 0, 'info', 'infosection', 1 FROM area WHERE level = 1 UNION ALL SELECT 'r3', -1, 'odd', 'mosaic', 0)"""


def old_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run left: four fifths of the places, even nations, and places that are on no page any more."""
    tree, supplier = areas(spark, sf_dir), table(spark, sf_dir, "supplier")
    inner = tree.where("level = 2").select(F.col("id").alias("nation"), F.col("parent_id").alias("region"))
    key = F.substring("id", 2, 20).cast("long")
    own = lambda code: F.concat("region", F.lit("_"), code)
    gone = supplier.select(F.concat(F.lit("x"), "s_suppkey").alias("code"), F.concat(F.lit("n"), "s_nationkey").alias("nation")).join(inner, "nation")
    first = gone.groupBy("nation").agg(F.min("code").alias("first"))
    places = tree.where("level = 3").where(key % 5 != 0).select(F.col("id").alias("code"), F.col("parent_id").alias("nation"), (key % 4).alias("representatives")).join(inner, "nation")
    columns = lambda df, level, parent, seats, top: df.select(own(F.col("code")).alias("id"), F.col("region").alias("country_code"), "code", F.concat(F.lit("old "), "code").alias("name"), F.lit(level).alias("level"), parent.alias("parent_id"), seats.cast("long").alias("representatives"), top.alias("most_populated"))
    none = F.lit(None).cast("string")
    rows = columns(places, 2, own(F.col("nation")), F.col("representatives"), none).unionByName(columns(gone, 2, own(F.col("nation")), F.lit(1), none))
    even = inner.where(F.substring("nation", 2, 9).cast("int") % 2 == 0).join(first, "nation", "left").withColumn("code", F.col("nation"))
    rows = rows.unionByName(columns(even, 1, F.concat("region", F.lit("_"), "region"), F.lit(None), own(F.col("first"))))
    kinds = {"entity_type": "string", "area_km2": "decimal(12,2)", "density": "decimal(12,4)", "pop_latest": "long", "pop_latest_date": "date", "last_census_year": "int", "url": "string"}
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})


@query(with_areas(f""", {PAGES_SQL}
SELECT slug, CAST(place AS BIGINT) AS place, path, layout, '{BASE}'||slug||'/'||path||'/' AS url, s AS status, CASE WHEN s = 'ok' THEN found END AS found FROM
(SELECT *, CASE WHEN layout = 'mosaic' THEN 'unknown layout' WHEN slug = 'r3' AND path = 'info' THEN 'missing' WHEN slug = 'r3' AND layout = 'double' THEN 'blocked' ELSE 'ok' END AS s FROM page)"""))
def scrape_pages(spark, sf_dir):
    """The report of a run: every page with its status, and how many areas were found on it."""
    return scraping.page_report(*scraping.found_on(*page_data(spark, sf_dir)))


@query(with_areas(f""", {PAGES_SQL},
fresh AS (SELECT region AS country, id AS code, name, 2 AS level, entity_type, nation AS parent, pop, km2, CASE WHEN n % 2 = 0 OR n % 3 = 0 THEN 'https://pages.example' ELSE '{BASE}'||region||'/'||nation||'/'||b||'/double/' END||'#i'||id AS url FROM leaf3
UNION ALL SELECT a.parent_id, a.id, a.name, 1, 'Nation', CASE WHEN CAST(substr(a.id, 2) AS INT) % 2 = 1 AND CAST(substr(a.id, 2) AS INT) % 3 > 0 THEN a.parent_id END, NULL, NULL, CASE WHEN CAST(substr(a.id, 2) AS INT) % 2 = 1 AND CAST(substr(a.id, 2) AS INT) % 3 > 0 THEN '{BASE}'||a.parent_id||'/'||a.id||'/'||(SELECT min(b) FROM leaf3 WHERE nation = a.id)||'/double/#i'||a.id END FROM area a WHERE a.level = 2 AND a.id IN (SELECT nation FROM leaf3)
UNION ALL SELECT id, id, name, 0, 'Region', NULL, pop, NULL, '{BASE}'||id||'/info/' FROM area WHERE level = 1),
new AS (SELECT country||'_'||code AS id, country, code, name, level, entity_type, country||'_'||parent AS parent_id, pop, km2, url FROM fresh WHERE country <> 'r3'),
gone AS (SELECT 'x'||s_suppkey AS code, 'n'||s_nationkey AS nation, n.parent_id AS region FROM supplier JOIN area n ON n.id = 'n'||s_nationkey),
old AS (SELECT region||'_'||id AS id, region AS country, 'old '||id AS name, 2 AS level, region||'_'||nation AS parent_id, k % 4 AS seats, CAST(NULL AS VARCHAR) AS top FROM leaf3 WHERE k % 5 <> 0
UNION ALL SELECT region||'_'||code, region, 'old '||code, 2, region||'_'||nation, 1, CAST(NULL AS VARCHAR) FROM gone
UNION ALL SELECT parent_id||'_'||id, parent_id, 'old '||id, 1, parent_id||'_'||parent_id, NULL, parent_id||'_'||(SELECT min(code) FROM gone WHERE nation = area.id) FROM area WHERE level = 2 AND CAST(substr(id, 2) AS INT) % 2 = 0),
q AS (SELECT country, code, coalesce(pop, 0) / k AS q, k FROM new, (SELECT unnest(range(1, 101)) AS k) WHERE level = 2 AND country IN ('r1', 'r2')),
seats AS (SELECT country||'_'||code AS id, count_if(r <= 100) AS seats FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY q DESC, code, k) AS r FROM q) GROUP BY 1),
below AS (SELECT parent_id AS id, id AS node, pop, country FROM new WHERE level = 2 UNION ALL SELECT n.parent_id, l.id, l.pop, l.country FROM new l JOIN new n ON n.id = l.parent_id WHERE l.level = 2 AND n.parent_id IS NOT NULL AND n.country <> 'r0'),
top AS (SELECT id, arg_min(node, struct_pack(p := -pop, i := node)) AS top FROM below WHERE pop IS NOT NULL GROUP BY 1)
SELECT n.id, n.country AS country_code, n.name, n.level, n.entity_type, n.parent_id, n.pop AS pop_latest, CAST(n.km2 AS DOUBLE) AS area_km2, n.url, coalesce(s.seats, o.seats) AS representatives, t.top AS most_populated, CASE WHEN o.id IS NULL THEN 'created' ELSE 'updated' END AS status
FROM new n LEFT JOIN old o USING (id) LEFT JOIN seats s USING (id) LEFT JOIN top t USING (id)
UNION ALL SELECT id, country, name, level, NULL, parent_id, NULL, NULL, NULL, seats, top, CASE WHEN country = 'r3' THEN 'untouched' ELSE 'deleted' END FROM old WHERE id NOT IN (SELECT id FROM new)"""))
def scrape_run(spark, sf_dir):
    """The table after a run: pages read by layout, areas kept first, saved with their parents; seats and pointers set."""
    jobs = spark.createDataFrame([("r0", 1, None, None, None), ("r1", None, 2, 100, 0), ("r2", None, 2, 100, 0), ("r3", None, 2, 100, 0), ("r4", None, None, None, None)], "country_code string, legal_level int, seat_level int, total int, minimum int")
    out = scraping.run(*scraping.found_on(*page_data(spark, sf_dir)), old_areas(spark, sf_dir), jobs)
    return out.select("id", "country_code", "name", "level", "entity_type", "parent_id", "pop_latest", F.col("area_km2").cast("double").alias("area_km2"), "url", "representatives", "most_populated", "status")
