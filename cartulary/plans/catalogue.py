"""Registered queries over the area tree, each with the SQL that DuckDB checks it with."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.operators import changes, cities, hierarchy, labels, report, seats, territory
from cartulary.operators.ranking import ranked
from cartulary.sources.areas import areas, table, with_areas

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


CHOSEN = """, below AS (SELECT c.ancestor AS id, n.id AS node, n.level AS nl, n.pop, CASE WHEN a.level < 2 THEN 2 ELSE 3 END AS target FROM closure c JOIN area a ON a.id = c.ancestor JOIN area n ON n.id = c.node WHERE dist > 0 AND n.level > a.level AND a.level < 3),
chosen AS (SELECT id, nl AS chosen FROM (SELECT id, nl, row_number() OVER (PARTITION BY id ORDER BY abs(nl - target), nl > target, nl) AS r FROM below) WHERE r = 1)"""


@query(with_areas(CHOSEN + """ SELECT id, node AS most_populated FROM (SELECT b.id, node, row_number() OVER (PARTITION BY b.id ORDER BY pop DESC, node) AS r FROM below b JOIN chosen ch ON b.id = ch.id AND nl = chosen WHERE pop IS NOT NULL) WHERE r = 1"""))
def most_populated_per_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.most_populated(areas(spark, sf_dir), legal=2)


@query(with_areas(CHOSEN + " SELECT id, chosen FROM chosen"))
def closest_level_choice(spark, sf_dir):
    return hierarchy.candidate_levels(areas(spark, sf_dir), legal=2)


@query(with_areas("SELECT ancestor, node, dist FROM closure"))
def area_closure(spark, sf_dir):
    return hierarchy.closure(areas(spark, sf_dir))


@query(with_areas("SELECT node, ancestor FROM closure JOIN area ON id = node WHERE level = 3"))
def ancestors_of_leaf(spark, sf_dir):
    tree = areas(spark, sf_dir)
    leaves = tree.where("level = 3").select(F.col("id").alias("node"))
    return hierarchy.closure(tree).join(leaves, "node", "left_semi").select("node", "ancestor")


@query(with_areas(""", g AS (SELECT 's'||(l_orderkey % 500) AS grp, 'c'||o_custkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT grp, count(*) AS n FROM g GROUP BY 1),
s AS (SELECT grp, ancestor, count(*) AS held FROM g JOIN closure c ON c.node = g.node GROUP BY 1, 2)
SELECT grp AS "group", ancestor FROM (SELECT s.grp, ancestor, row_number() OVER (PARTITION BY s.grp ORDER BY level DESC, ancestor DESC) AS r FROM s JOIN n ON n.grp = s.grp AND held = n JOIN area ON id = ancestor) WHERE r = 1"""))
def lca_of_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    groups = lines.select(F.concat(F.lit("s"), F.col("l_orderkey") % 500).alias("group"), F.concat(F.lit("c"), "o_custkey").alias("node"))
    return hierarchy.lowest_common_ancestor(groups, areas(spark, sf_dir))


@query(with_areas("SELECT ancestor, node FROM closure c JOIN area a ON a.id = ancestor WHERE a.level <= 3 AND dist = 3 - a.level"))
def descendants_at_level(spark, sf_dir):
    return hierarchy.descendants_at_level(areas(spark, sf_dir), 3)


@query(with_areas("SELECT ancestor, node FROM closure JOIN area ON id = node WHERE level = 2 AND dist > 0"))
def descendants_by_label(spark, sf_dir):
    return hierarchy.first_below_at_level(areas(spark, sf_dir), 2)


@query(with_areas("SELECT node AS id, arg_min(mlevel, dist) AS municipal_level FROM closure LEFT JOIN area ON id = ancestor AND mlevel IS NOT NULL GROUP BY 1"))
def effective_municipal_level(spark, sf_dir):
    return hierarchy.inherited(areas(spark, sf_dir), "municipal_level")


@query(with_areas("SELECT ancestor AS id, CAST(sum(coalesce(seats, 0)) AS BIGINT) AS total FROM closure JOIN area ON id = node GROUP BY 1"))
def seat_totals(spark, sf_dir):
    return hierarchy.seat_totals(areas(spark, sf_dir))


@query(with_areas(""", s3 AS (SELECT id, parent_id, seats FROM area WHERE level = 3),
s2 AS (SELECT a.id, a.parent_id, coalesce(a.seats, (SELECT CASE WHEN sum(x.seats) > 0 THEN sum(x.seats) END FROM s3 x WHERE x.parent_id = a.id)) AS seats FROM area a WHERE level = 2),
s1 AS (SELECT a.id, a.parent_id, coalesce(a.seats, (SELECT CASE WHEN sum(x.seats) > 0 THEN sum(x.seats) END FROM s2 x WHERE x.parent_id = a.id)) AS seats FROM area a WHERE level = 1),
s0 AS (SELECT a.id, a.parent_id, coalesce(a.seats, (SELECT CASE WHEN sum(x.seats) > 0 THEN sum(x.seats) END FROM s1 x WHERE x.parent_id = a.id)) AS seats FROM area a WHERE level = 0)
SELECT id, CAST(seats AS BIGINT) AS seats FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""))
def recursive_seats(spark, sf_dir):
    return hierarchy.recursive_seats(areas(spark, sf_dir))


@query(with_areas("SELECT parent_id AS id, CAST(coalesce(sum(pop), 0) AS BIGINT) AS pop, CAST(sum(km2) AS DOUBLE) AS area, round(coalesce(sum(pop), 0) / nullif(CAST(sum(km2) AS DOUBLE), 0), 4) AS density FROM area WHERE parent_id IS NOT NULL GROUP BY 1"))
def container_rollup(spark, sf_dir):
    return hierarchy.container_rollup(areas(spark, sf_dir)).select("id", "pop", F.col("area").cast("double").alias("area"), F.round("density", 4).alias("density"))


@query(with_areas("SELECT entity_type, count(*) AS n, CAST(sum(pop) AS BIGINT) AS pop, CAST(count_if(pop IS NULL) AS BIGINT) AS unknown FROM area GROUP BY 1"))
def country_summary(spark, sf_dir):
    return areas(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("pop_latest").alias("pop"), F.count_if(F.col("pop_latest").isNull()).alias("unknown"))


@query(with_areas("SELECT count(*) AS n, CAST(count_if(parent_id IS NULL) AS BIGINT) AS roots, count(DISTINCT level) AS levels, CAST(sum(km2) AS DOUBLE) AS area FROM area"))
def dashboard_counts(spark, sf_dir):
    return areas(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.countDistinct("level").alias("levels"), F.sum("area_km2").cast("double").alias("area"))


@query(with_areas("SELECT a.id, a.name, p.name AS parent_name FROM area a LEFT JOIN area p ON p.id = a.parent_id WHERE a.name ILIKE '%00%' AND a.level = 3 ORDER BY a.name, a.id LIMIT 50 OFFSET 50"))
def area_list_page(spark, sf_dir):
    """The second page of 50 of the areas whose names hold a text."""
    tree = areas(spark, sf_dir)
    parents = tree.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    found = tree.where(F.col("name").ilike("%00%") & (F.col("level") == 3)).join(parents, "parent_id", "left")
    return found.orderBy("name", "id").select("id", "name", "parent_name").offset(50).limit(50)


def ranks(spark, sf_dir, by):
    rows = areas(spark, sf_dir)
    for name, value in (("by_area", "area_km2"), ("by_pop", "pop_latest")):
        rows = ranked(rows, by, [F.coalesce(value, F.lit(0)).desc(), F.col("level"), F.col("id")], name)
    return rows.select("id", "by_area", "by_pop")


RANKS = "SELECT id, row_number() OVER (PARTITION BY {0} ORDER BY coalesce(km2, 0) DESC, level, id) AS by_area, row_number() OVER (PARTITION BY {0} ORDER BY coalesce(pop, 0) DESC, level, id) AS by_pop FROM area"


@query(with_areas(RANKS.format("level")))
def level_ranks(spark, sf_dir):
    return ranks(spark, sf_dir, "level")


@query(with_areas(RANKS.format("parent_id")))
def sibling_ranks(spark, sf_dir):
    return ranks(spark, sf_dir, "parent_id")


@query(with_areas("SELECT a.id, round(CAST(pop AS DOUBLE) / CAST(nullif(total, 0) AS DOUBLE) * 100, 2) AS pct FROM area a JOIN (SELECT level, sum(pop) AS total FROM area GROUP BY 1) t USING (level)"))
def pct_of_level(spark, sf_dir):
    tree = areas(spark, sf_dir)
    sums = tree.groupBy("level").agg(F.sum("pop_latest").alias("total"))  # a row per level, no level in one task
    return tree.join(sums, "level").select("id", text.percentage(F.col("pop_latest"), F.col("total")).alias("pct"))


@query(with_areas("SELECT a.id, round(CAST(a.pop AS DOUBLE) / CAST(nullif(p.pop, 0) AS DOUBLE) * 100, 2) AS pct FROM area a LEFT JOIN area p ON p.id = a.parent_id"))
def pct_of_parent(spark, sf_dir):
    tree = areas(spark, sf_dir)
    parents = tree.select(F.col("id").alias("parent_id"), F.col("pop_latest").alias("total"))
    return tree.join(parents, "parent_id", "left").select("id", text.percentage(F.col("pop_latest"), F.col("total")).alias("pct"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def keep_first_dedup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""WITH e AS (SELECT user_id, event_id, CAST(abs(user_id * 7 + event_id * 13) % 4 AS INT) AS level FROM events)
SELECT user_id, event_id, level, CASE WHEN a > coalesce(b, -1) THEN a END AS parent FROM (SELECT e.*, (SELECT max(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.event_id < e.event_id AND x.level = e.level - 1) AS a,
(SELECT max(x.event_id) FROM e x WHERE x.user_id = e.user_id AND x.event_id < e.event_id AND x.level < e.level - 1) AS b FROM e)""")
def parent_stack_ffill(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.abs(F.col("user_id") * 7 + F.col("event_id") * 13) % 4).cast("int").alias("level"))
    return hierarchy.parent_by_stack(rows, "user_id", "event_id", "level")


SEATS = """, q AS (SELECT parent_id AS g, id AS code, CAST(greatest(coalesce(pop, 0), 0) AS DOUBLE) AS pop, {low} AS low, {high} AS high, {total} AS total FROM area WHERE level = 3),
r AS (SELECT *, total - sum(low) OVER (PARTITION BY g) AS rest FROM q), k AS (SELECT g, code, row_number() OVER (PARTITION BY g ORDER BY pop / (low + k) DESC, code, k) AS place, rest FROM r, unnest(range(1, CAST(rest AS BIGINT) + 1)) u(k) WHERE high IS NULL OR low + k <= high)
SELECT r.g AS "group", r.code, CAST(r.low + coalesce((SELECT count(*) FROM k WHERE k.g = r.g AND k.code = r.code AND place <= k.rest), 0) AS BIGINT) AS seats FROM r"""


def allotted(spark, sf_dir, total, low, high=None):
    leaves = areas(spark, sf_dir).where("level = 3").select(F.col("parent_id").alias("group"), F.col("id").alias("code"), "pop_latest")
    return seats.dhondt(leaves, "group", total(leaves), low, high)


@query(with_areas(SEATS.format(low="0", high="NULL", total="350")))
def dhondt_plain(spark, sf_dir):
    return allotted(spark, sf_dir, lambda _: F.lit(350), F.lit(0))


@query(with_areas(SEATS.format(low="1", high="CASE WHEN id LIKE '%1' THEN 3 END", total="(SELECT count(*) + 100 FROM area x WHERE x.parent_id = area.parent_id)")))
def dhondt_min_max(spark, sf_dir):
    return allotted(spark, sf_dir, lambda leaves: F.count("*").over(Window.partitionBy("group")) + 100, F.lit(1), F.when(F.col("code").endswith("1"), 3))


@query(with_areas(SEATS.format(low="0", high="NULL", total="(SELECT CAST(sum(ceil(greatest(coalesce(x.pop, 0), 0) / 2000)) AS BIGINT) FROM area x WHERE x.parent_id = area.parent_id)")))
def dhondt_habitant(spark, sf_dir):
    each = F.ceil(F.greatest(F.coalesce("pop_latest", F.lit(0)), F.lit(0)) / 2000)
    return allotted(spark, sf_dir, lambda leaves: F.sum(each).over(Window.partitionBy("group")), F.lit(0))


SPEC = """, spec AS (SELECT 't'||(c_custkey % 40) AS territory, 'n'||(c_custkey % 25) AS id, 'include' AS sign FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL UNION ALL
SELECT 't'||(c_custkey % 40), 'c'||c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'include' ELSE 'subtract' END FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 7 = 0),
grown AS (SELECT territory, sign, node FROM spec JOIN area a USING (id) JOIN closure c ON c.ancestor = id AND dist = 3 - a.level GROUP BY ALL)"""


def spec(spark, sf_dir):
    key, customers = F.col("c_custkey"), table(spark, sf_dir, "customer")
    of = F.concat(F.lit("t"), key % 40).alias("territory")
    nations = customers.where(key % 3 == 0).select(of, F.concat(F.lit("n"), key % 25).alias("id"), F.lit("include").alias("sign")).distinct()
    return nations.unionByName(customers.where((key % 4 < 3) & (key % 7 == 0)).select(of, F.concat(F.lit("c"), key).alias("id"), F.when(key % 4 == 1, "include").otherwise("subtract").alias("sign")))


@query(with_areas(SPEC + " SELECT territory, node FROM grown WHERE sign = 'include' EXCEPT SELECT territory, node FROM grown WHERE sign = 'subtract'"))
def territory_members(spark, sf_dir):
    return territory.members(spec(spark, sf_dir), areas(spark, sf_dir), 3)


@query(with_areas(SPEC + """ SELECT territory, CAST(sum(f * coalesce(pop, 0)) AS BIGINT) AS pop, CAST(sum(f * coalesce(km2, 0)) AS DOUBLE) AS area FROM (SELECT territory, id, 1 AS f FROM spec WHERE sign = 'include' UNION ALL SELECT territory, node, -1 FROM grown WHERE sign = 'subtract') JOIN area USING (id) GROUP BY 1"""))
def territory_totals(spark, sf_dir):
    return territory.totals(spec(spark, sf_dir), areas(spark, sf_dir), 3).select("territory", "pop", F.col("area").cast("double").alias("area"))


@query(with_areas(""", path AS (SELECT c.node AS leaf, string_agg(a.id, '>' ORDER BY a.level) AS path FROM closure c JOIN area a ON a.id = ancestor WHERE c.node NOT IN (SELECT parent_id FROM area WHERE parent_id IS NOT NULL) GROUP BY 1)
SELECT leaf, path, row_number() OVER (PARTITION BY split_part(path, '>', 3) ORDER BY path) = 1 AS shows_nation FROM path"""))
def path_report_blanked(spark, sf_dir):
    """Root-to-leaf paths; a nation is shown on its first row only."""
    rows = hierarchy.paths(areas(spark, sf_dir)).select("leaf", F.array_join(F.transform("path", lambda x: x["id"]), ">").alias("path"))
    rows = rows.withColumn("nation", F.split_part("path", F.lit(">"), F.lit(3)))
    first = rows.groupBy("nation").agg(F.min("path").alias("first"))  # no nation's rows in one window
    return rows.join(first, "nation").select("leaf", "path", (F.col("path") == F.col("first")).alias("shows_nation"))


@query(with_areas("SELECT parent_id AS id, string_agg(name, ' | ' ORDER BY name) AS names FROM area WHERE parent_id IS NOT NULL GROUP BY 1"))
def capitals_string(spark, sf_dir):
    named = areas(spark, sf_dir).where("parent_id IS NOT NULL")
    return named.groupBy(F.col("parent_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("names"))


@query("""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'deleted' WHEN o.c_name IS DISTINCT FROM n.c_name THEN 'updated' ELSE 'kept' END AS status
FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0) o FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name||'!' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 4 <> 0) n USING (c_custkey)""")
def upsert_status(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    old = customers.where("c_custkey % 5 <> 0").select("c_custkey", F.col("c_name").alias("before"), F.lit(True).alias("was"))
    new = customers.where("c_custkey % 4 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("after"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "updated").otherwise("kept")
    return old.join(new, "c_custkey", "full").select("c_custkey", status.alias("status"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(strip_accents(lower(p_name||' (Čačak, Şırnak Đà) '||p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" (Čačak, Şırnak Đà) "), "p_brand")).alias("slug"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 < 3 THEN year(o_orderdate) END AS year FROM orders")
def year_from_text(spark, sf_dir):
    """Years out of ISO dates, of words before a year, of a year before words; none where there is no year."""
    date, i = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey") % 4
    written = F.when(i == 0, date).when(i == 1, F.concat(F.lit("census "), F.substring(date, 1, 4))).when(i == 2, F.concat(F.substring(date, 1, 4), F.lit("-13-45 estimate of 1801"))).otherwise("no 199 year")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.year(written).cast("long").alias("year"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"')) AS links FROM pages")
def page_title_links(spark, sf_dir):
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="'), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), links.alias("links"))


LABELS = """, lab AS (SELECT lower(n_name) AS label FROM nation UNION SELECT '  '||n_name||' ' FROM nation UNION SELECT 'C'||s_suppkey FROM supplier UNION SELECT 'c'||c_custkey FROM customer
UNION SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0')||'1' FROM supplier UNION SELECT 'zz'||s_suppkey FROM supplier),
hit AS (SELECT * FROM (SELECT label, id, level, CASE WHEN id = label THEN 1 WHEN lower(id) = lower(label) THEN 2 WHEN lower(name) = lower(label) THEN 3 WHEN lower(id) = lower(trim(label)) THEN 4 WHEN lower(name) = lower(trim(label)) THEN 5
WHEN contains(lower(name), lower(trim(label))) THEN 6 WHEN contains(lower(id), lower(trim(label))) THEN 7 END AS tier FROM lab, area) WHERE tier IS NOT NULL)"""


def asked_labels(spark, sf_dir):
    """Labels as users write them: other case, blanks, ids, parts of names, and some that nothing has."""
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    key = F.col("s_suppkey").cast("string")
    own = supplier.select(F.explode(F.array(F.concat(F.lit("C"), key), F.concat(F.lpad(key, 4, "0"), F.lit("1")), F.concat(F.lit("zz"), key))).alias("label"))
    named = nation.select(F.explode(F.array(F.lower("n_name"), F.concat(F.lit("  "), "n_name", F.lit(" ")))).alias("label"))
    return own.unionByName(named).unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("label")))


def coded(tree):
    return tree.withColumn("code", F.col("id"))


@query(with_areas(LABELS + " SELECT label, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tier, CASE WHEN tier > 5 THEN -level ELSE 0 END, id) AS r FROM hit) WHERE r = 1"))
def label_resolve_tiers(spark, sf_dir):
    return labels.resolve(asked_labels(spark, sf_dir), coded(areas(spark, sf_dir)))


@query(with_areas(LABELS + " SELECT label FROM lab WHERE label NOT IN (SELECT label FROM hit)"))
def label_missing(spark, sf_dir):
    return labels.missing(asked_labels(spark, sf_dir), coded(areas(spark, sf_dir)))


@query(with_areas(""", o AS (SELECT 'c'||s_suppkey * 3 AS key, s_suppkey % 9 + 1 AS value FROM supplier UNION ALL SELECT upper(replace(s_name, 'Supplier', 'Customer')), s_suppkey % 5 + 11 FROM supplier UNION ALL SELECT n_name, n_nationkey + 100 FROM nation)
SELECT id, coalesce((SELECT min(value) FROM o WHERE key = id), (SELECT min(value) FROM o WHERE key = name), (SELECT min(value) FROM o WHERE lower(key) = lower(id)), (SELECT min(value) FROM o WHERE lower(key) = lower(name)), 2) AS value FROM area"""))
def override_lookup(spark, sf_dir):
    supplier, key = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    given = supplier.select(F.concat(F.lit("c"), key * 3).alias("key"), (key % 9 + 1).alias("value"))
    given = given.unionByName(supplier.select(F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("key"), (key % 5 + 11).alias("value")))
    given = given.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), (F.col("n_nationkey") + 100).cast("long").alias("value")))
    return labels.overridden(coded(areas(spark, sf_dir)), given, F.lit(2).cast("long"))


@query("""SELECT o_orderkey AS id, arg_max(p.code, len(p.code)) AS parent FROM orders JOIN (SELECT CAST(c_custkey AS VARCHAR) AS code, c_custkey % 3 AS level FROM customer) p
ON starts_with(CAST(o_orderkey AS VARCHAR), p.code) AND o_custkey % 4 > p.level GROUP BY 1""")
def longest_prefix_parent(spark, sf_dir):
    entities = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("code"), (F.col("o_custkey") % 4).alias("level"))
    return labels.longest_prefix(entities, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code"), (F.col("c_custkey") % 3).alias("level")))


CODES = """, n AS (SELECT id, parent_id||'-'||id AS full_code FROM area WHERE level = 2)"""


@query(with_areas(CODES + " SELECT id, id AS full_code FROM area WHERE level < 2 UNION ALL SELECT * FROM n UNION ALL SELECT a.id, n.full_code||'-'||a.id FROM area a JOIN n ON n.id = a.parent_id"))
def hier_codes(spark, sf_dir):
    """Nations with even keys have codes that begin with the region's already."""
    tree = areas(spark, sf_dir)
    ready = (F.col("level") == 2) & F.col("id").rlike("[02468]$")
    return hierarchy.full_codes(tree.withColumn("code", F.when(ready, F.concat("parent_id", F.lit("-"), "id")).otherwise(F.col("id"))))


@query(with_areas(CODES + " SELECT n.full_code||'-'||entity_type AS full_code, count(*) AS n FROM area a JOIN n ON n.id = a.parent_id GROUP BY 1 HAVING count(*) > 1"))
def dup_codes(spark, sf_dir):
    return hierarchy.duplicate_codes(areas(spark, sf_dir).withColumn("code", F.when(F.col("level") == 3, F.col("entity_type")).otherwise(F.col("id"))))


BLOCK = "a{0}.id AS L{0}_id, a{0}.name AS L{0}_name, a{0}.pop AS L{0}_pop, CAST(a{0}.km2 AS DOUBLE) AS L{0}_area, a{0}.rank_pop AS L{0}_rank_pop, a{0}.rank_area AS L{0}_rank_area, a{0}.pct_level AS L{0}_pct_level, round(CAST(a{0}.pop AS DOUBLE) / CAST(nullif(a{1}.pop, 0) AS DOUBLE) * 100, 2) AS L{0}_pct_parent, a{0}.total AS L{0}_seats"


@query(with_areas(""", t AS (SELECT ancestor AS id, CAST(nullif(sum(coalesce(seats, 0)), 0) AS BIGINT) AS total FROM closure JOIN area ON id = node GROUP BY 1),
x AS (SELECT area.*, total, row_number() OVER (PARTITION BY level ORDER BY coalesce(pop, 0) DESC, id) AS rank_pop, row_number() OVER (PARTITION BY level ORDER BY coalesce(km2, 0) DESC, id) AS rank_area,
round(CAST(pop AS DOUBLE) / CAST(nullif(sum(pop) OVER (PARTITION BY level), 0) AS DOUBLE) * 100, 2) AS pct_level FROM area JOIN t USING (id))
SELECT a3.id AS leaf, a0.name AS root, a0.pop AS root_pop, """ + ", ".join(BLOCK.format(n, n - 1) for n in (1, 2, 3)) + " FROM x a3 JOIN x a2 ON a2.id = a3.parent_id JOIN x a1 ON a1.id = a2.parent_id JOIN x a0 ON a0.id = a1.parent_id WHERE a3.level = 3"))
def path_report(spark, sf_dir):
    return report.path_report(areas(spark, sf_dir), range(1, 4))


def shown_sql(sql: str) -> str:
    """A path report with each block on the first row of its area only."""
    once = ", ".join(f"CASE WHEN row_number() OVER (PARTITION BY L{n}_id ORDER BY path) = 1 THEN L{n}_{f} END AS L{n}_{f}" for n in (1, 2) for f in report.FIELDS)
    last = ", ".join(f"L3_{f}" for f in report.FIELDS)
    return f"SELECT path, leaf, CASE WHEN row_number() OVER (ORDER BY path) = 1 THEN root END AS root, CASE WHEN row_number() OVER (ORDER BY path) = 1 THEN root_pop END AS root_pop, {once}, {last} FROM (SELECT *, L1_id||'>'||L2_id||'>'||L3_id AS path FROM ({sql}))"


@query(shown_sql(ORACLES["path_report"]))
def path_report_levels(spark, sf_dir):
    """The report with as many blocks as the tree has levels, repeated cells blank; ties by id."""
    return report.shown_report(areas(spark, sf_dir))


@query(shown_sql(ORACLES["path_report"].replace("coalesce(pop, 0) DESC, id", "coalesce(pop, 0) DESC, name DESC, id").replace("coalesce(km2, 0) DESC, id", "coalesce(km2, 0) DESC, name DESC, id")))
def path_report_ties(spark, sf_dir):
    """The same with ties by another order, here by a code that runs against the names."""
    tree = areas(spark, sf_dir)
    against = F.transform(F.split("name", ""), lambda c: -F.ascii(c))
    return report.shown_report(tree.withColumn("order", against), ("order", "id"))


@query(with_areas(SPEC + """, m AS (SELECT territory, node FROM grown WHERE sign = 'include' EXCEPT SELECT territory, node FROM grown WHERE sign = 'subtract')
SELECT s.territory, s.capital, m.node IS NOT NULL AS valid FROM (SELECT 't'||s_suppkey % 40 AS territory, 'c'||s_suppkey AS capital FROM supplier) s LEFT JOIN m ON m.territory = s.territory AND m.node = s.capital"""))
def territory_capital_valid(spark, sf_dir):
    """Whether each named capital lies in its territory."""
    named = table(spark, sf_dir, "supplier").select(F.concat(F.lit("t"), F.col("s_suppkey") % 40).alias("territory"), F.concat(F.lit("c"), "s_suppkey").alias("capital"))
    held = territory.members_among(named.withColumnRenamed("capital", "node"), spec(spark, sf_dir), areas(spark, sf_dir), 3).select("territory", F.col("node").alias("capital"), F.lit(True).alias("held"))
    return named.join(held, ["territory", "capital"], "left").select("territory", "capital", F.col("held").isNotNull().alias("valid"))


@query(with_areas(""", m AS (SELECT id, 'city-'||parent_id AS city FROM area WHERE level = 3 AND entity_type = 'BUILDING' AND parent_id LIKE '%1'),
c AS (SELECT city, 'City of '||any_value(p.name) AS name, any_value(p.id) AS parent_id, CAST(coalesce(sum(a.pop), 0) AS BIGINT) AS pop, sum(a.km2) AS km2 FROM m JOIN area a USING (id) JOIN area p ON p.id = a.parent_id GROUP BY 1),
u AS (SELECT a.id, a.name, a.level + CASE WHEN city IS NULL THEN 0 ELSE 1 END AS level, coalesce(city, a.parent_id) AS parent_id, entity_type, pop, CAST(km2 AS DOUBLE) AS area FROM area a LEFT JOIN m USING (id) UNION ALL SELECT city, name, 3, parent_id, 'City', pop, CAST(km2 AS DOUBLE) FROM c)
SELECT *, round(CAST(pop AS DOUBLE) / nullif(area, 0), 4) AS density FROM u"""))
def city_collapse(spark, sf_dir):
    """In some nations the areas of one type become parts of a city."""
    tree = areas(spark, sf_dir)
    parts = tree.where("level = 3 AND entity_type = 'BUILDING' AND parent_id LIKE '%1'").select(F.concat(F.lit("city-"), "parent_id").alias("city"), "id")
    towns = tree.where("level = 2 AND id LIKE '%1'").select(F.concat(F.lit("city-"), "id").alias("city"), F.concat(F.lit("City of "), "name").alias("name"), F.lit(3).alias("level"), F.col("id").alias("parent_id"), F.lit("City").alias("entity_type"))
    rows = cities.rewritten(tree, parts, towns)
    return rows.select("id", "name", "level", "parent_id", "entity_type", F.col("pop_latest").alias("pop"), F.col("area_km2").cast("double").alias("area"), F.round("density", 4).alias("density"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def anti_delete(spark, sf_dir):
    """Customers left when those without an order are deleted."""
    return changes.without_missing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN o.c_name ELSE n.c_name END AS c_name, CASE WHEN n.c_custkey IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment,
CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'absent' WHEN o.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'updated' ELSE 'kept' END AS status
FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) o FULL JOIN (SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 4 <> 0) n ON o.c_custkey = n.c_custkey""")
def upsert_rows(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = customers.where("c_custkey % 4 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")))
    return changes.merged(customers.where("c_custkey % 5 <> 0"), new, "c_custkey")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN v WHEN 1 THEN v WHEN 2 THEN CAST(w AS DOUBLE) WHEN 3 THEN w / 10.0 WHEN 4 THEN CASE WHEN w < 1000000 THEN w / 1000.0 END ELSE w / 1000.0 END AS value
FROM (SELECT p_partkey, (p_partkey * 7919 % 100000000) / 100.0 AS v, p_partkey * 7919 % 90000000 + 10000 AS w FROM part)""")
def number_parse_locale(spark, sf_dir):
    """Numbers as pages write them: both signs, commas that part thousands, a comma as the decimal sign, several dots (no
    number), and a lone dot. They come back as they were."""
    k, w, i = F.col("p_partkey") * 7919 % 100000000, F.col("p_partkey") * 7919 % 90000000 + 10000, F.col("p_partkey") % 6
    english = F.concat(F.format_number(F.floor(k / 100), 0), F.lit("."), F.lpad((k % 100).cast("string"), 2, "0"))
    grouped = F.format_number(w, 0)
    tenths = F.concat(F.floor(w / 10).cast("string"), F.lit(","), (w % 10).cast("string"))
    dotted = F.concat(F.floor(w / 1000).cast("string"), F.lit("."), F.lpad((w % 1000).cast("string"), 3, "0"))
    several = F.when(w < 1000000, dotted).otherwise(F.translate(grouped, ",", "."))
    written = F.when(i == 0, english).when(i == 1, F.concat(F.translate(english, ",.", ".,"), F.lit(" km"))).when(i == 2, F.concat(grouped, F.lit(" km²"))).when(i == 3, tenths).when(i == 4, several).otherwise(F.concat(F.lit("~ "), dotted))
    return table(spark, sf_dir, "part").select("p_partkey", text.locale_number(written).alias("value"))


@query(r"SELECT c_custkey, trim(regexp_replace(strip_accents(lower(' Á  '||c_name||'   Ñandú Şırnak Čačak Łódź İzmir '||c_mktsegment||' Đà Nẵng ')), '\s+', ' ', 'g')) AS norm FROM customer")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalised(F.concat(F.lit(" Á  "), "c_name", F.lit("   Ñandú Şırnak Čačak Łódź İzmir "), "c_mktsegment", F.lit(" Đà Nẵng "))).alias("norm"))
