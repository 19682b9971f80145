"""Queries that write the area tree as pages of the known layouts and read the areas back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.sources.areas import areas, with_areas
from cartulary.sources.layouts import extracted

#: Customers whose numbers share this quotient and a nation are on one page, so pages stay small at any size.
BLOCK = 1000

READ_SQL = f"""SELECT a.parent_id || '/' || CAST(CAST(substr(a.id, 2) AS BIGINT) // {BLOCK} AS VARCHAR) AS page_id, a.* FROM area a WHERE a.level = 3"""


def safe(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, parent_id, parent_name, people): leaves by page, in order of id; area as attribute or as cell."""
    tree = areas(spark, sf_dir)
    leaves = tree.where("level = 3").withColumn("key", F.substring("id", 2, 20).try_cast("long"))
    page = F.concat("parent_id", F.lit("/"), F.floor(F.col("key") / BLOCK).cast("string"))
    held = leaves.groupBy(page.alias("page_id"), "parent_id").agg(F.array_sort(F.collect_list(F.struct("key", "id", "name", "entity_type", "pop_latest", "area_km2"))).alias("people"))
    return held.join(tree.where("level = 2").select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name")), "parent_id")


def row(p, extra=None, in_attribute=None):
    attribute = F.coalesce(F.when(in_attribute, F.concat(F.lit(" data-area='"), p["area_km2"].cast("string"), F.lit("'"))), F.lit(""))
    cell = F.coalesce(F.when(~in_attribute, F.format_number(p["area_km2"], 2)), F.lit(""))
    return F.concat(F.lit("<tr><td class='rname' id='i"), p["id"], F.lit("' data-status='"), safe(p["entity_type"]), F.lit("'"), attribute, F.lit("><span itemprop='name'>"), safe(p["name"]), F.lit("</span><td class='rpop'>"), F.coalesce(F.format_number(p["pop_latest"], 0), F.lit("...")), F.lit("<td class='rpop'>7<td class='rarea'>"), cell, extra if extra is not None else F.lit(""), F.lit("</tr>"))


HEAD = "<thead><tr><th class='rname'>Name<th class='rpop' style='display: table-cell' data-coldate='2021-07-01'>2021<th class='rpop' style='display: none' data-coldate='2024-01-01'>2024<th class='rarea'>Area</tr></thead>"


def pages(df: DataFrame, html, layout: str, level: int = 2) -> DataFrame:
    """Pages dealt over all cores: parsing them takes more than moving them."""
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism, "page_id")
    return df.select("page_id", html.alias("html"), F.concat(F.lit("https://pages.example/"), "page_id", F.lit("/")).alias("url"), F.lit("w").alias("country_code"), F.lit(level).alias("level"), F.lit(layout).alias("layout"))


def shown(df: DataFrame) -> DataFrame:
    return extracted(df).select("page_id", "code", "name", "level", "parent_code", "entity_type", "pop_latest", F.round("area_km2", 2).alias("area_km2"), "last_census_year", "url")


def layout_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin pages: a nation's row, then its leaves in a deeper body; parents by the stack of levels."""
    df = listing(spark, sf_dir)
    people = F.array_join(F.transform("people", lambda p: row(p, in_attribute=p["key"] % 2 == 0)), "")
    nation = F.concat(F.lit("<tbody class='admin0'><tr onclick=\"javascript:sym('"), "parent_id", F.lit("')\"><td class='rname' title='Nation'>"), safe(F.col("parent_name")), F.lit("</tr></tbody>"))
    html = F.concat(F.lit(f"<html><body><table id='tl'>{HEAD}"), nation, F.lit("<tbody class='admin1'>"), people, F.lit("</tbody></table></body></html>"))
    return shown(pages(df, html, "admin"))


def layout_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double pages: nations in the first table, leaves in the second, whose parents are given by id or by name."""
    df = listing(spark, sf_dir)
    nation = F.concat(F.lit("<tr><td class='rname' id='i"), "parent_id", F.lit("'>"), safe(F.col("parent_name")), F.lit("</tr>"))
    by = lambda p: F.when(p["key"] % 3 == 0, F.concat(F.lit("<td class='radm' data-admid='"), "parent_id", F.lit("'>"))).otherwise(F.concat(F.lit("<td class='radm'> "), F.lower(safe(F.col("parent_name"))), F.lit(" ")))
    people = F.array_join(F.transform("people", lambda p: row(p, by(p), p["key"] > -1)), "")
    html = F.concat(F.lit(f"<html><body><h2>Contents: Nations</h2><table id='tl'>{HEAD}<tbody>"), nation, F.lit(f"</tbody></table><h2>Places</h2><table id='ts'>{HEAD}<tbody>"), people, F.lit("</tbody></table></body></html>"))
    return shown(pages(df, html, "double"))


def layout_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table pages: leaves in the body, their nation in the foot, whose type comes from its title."""
    df = listing(spark, sf_dir)
    people = F.array_join(F.transform("people", lambda p: row(p, in_attribute=p["key"] % 2 == 0)), "")
    size = F.size("people")
    foot = F.concat(F.lit("<tfoot><tr><td class='rname' title='Nation' id='i"), "parent_id", F.lit("'>"), safe(F.col("parent_name")), F.lit("<td class='rpop'>"), F.format_number(size, 0), F.lit("<td class='rpop'>9<td class='rarea'>"), F.format_number(size, 2), F.lit("</tr></tfoot>"))
    html = F.concat(F.lit(f"<html><body><h2>Places</h2><table id='tl'>{HEAD}<tbody>"), people, F.lit("</tbody>"), foot, F.lit("</table></body></html>"))
    return shown(pages(df, html, "table"))


SECTION = "<section class='infosection mainsection'><div class='infoname'>Contents: World</div><div class='infotext'>Planet</div><p data-newpop='77' data-newdate='2020-05-01' data-area='12.5' data-density='6.16'></p></section>"


def layout_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities pages: the country in a head section, nations a level below it, leaves below them by name."""
    df = listing(spark, sf_dir)
    nation = F.concat(F.lit("<tr><td class='rname' data-status='State' id='i"), "parent_id", F.lit("'>"), safe(F.col("parent_name")), F.lit("</tr>"))
    people = F.array_join(F.transform("people", lambda p: row(p, F.concat(F.lit("<td class='radm'>"), safe(F.col("parent_name"))), p["key"] > -1)), "")
    html = F.concat(F.lit(f"<html><body>{SECTION}<h2>States</h2><table id='tl'>{HEAD}<tbody>"), nation, F.lit(f"</tbody></table><h2>Places</h2><table id='ts'>{HEAD}<tbody>"), people, F.lit("</tbody></table></body></html>"))
    return shown(pages(df, html, "cities", 1))


def layout_infosection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a head section alone, or, where a page has none, its table's foot as the country."""
    df = listing(spark, sf_dir)
    size, even = F.size("people"), F.size("people") % 2 == 0
    section = F.concat(F.lit("<div class='infosection mainsection'><div class='infoname'>"), safe(F.col("parent_name")), F.lit("</div><div class='infotext'><span class='val'>x</span></div><div class='infotext'>Nation</div><p data-oldpop='"), size.cast("string"), F.lit("' data-olddate='2011-01-01' data-area='"), (size / 4).cast("string"), F.lit("'></p></div>"))
    foot = F.concat(F.lit(f"<table id='tl'>{HEAD}<tbody></tbody><tfoot><tr><td class='rname' title='Total' id='ifoot'>"), safe(F.col("parent_name")), F.lit("<td class='rpop'>"), size.cast("string"), F.lit("<td class='rpop'>8</tr></tfoot></table>"))
    html = F.concat(F.lit("<html><body>"), F.when(even, section).otherwise(foot), F.lit("</body></html>"))
    return shown(pages(df, html, "infosection"))


def layout_sql(base: str, nation_url: str, nation_parent: str) -> str:
    """The rows that either layout gives; base is what row anchors stand on."""
    return with_areas(f""", p AS ({READ_SQL})
SELECT page_id, id AS code, name, 3 AS level, parent_id AS parent_code, entity_type, pop AS pop_latest, CAST(km2 AS DOUBLE) AS area_km2, 2021 AS last_census_year, {base} || '#i' || id AS url FROM p
UNION ALL SELECT DISTINCT page_id, n.id, n.name, 2, {nation_parent}, 'Nation', CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), 2021, {nation_url} FROM p JOIN area n ON n.id = p.parent_id""")


QUERIES = {f.__name__: f for f in (layout_admin, layout_double, layout_table, layout_cities, layout_infosection)}
LEAVES_SQL = "page_id, id AS code, name, 3 AS level, parent_id AS parent_code, entity_type, pop AS pop_latest, CAST(km2 AS DOUBLE) AS area_km2, 2021 AS last_census_year, 'https://pages.example/'||page_id||'/#i'||id AS url"
ORACLES = {
    "layout_admin": layout_sql("'https://pages.example'", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"),
    "layout_double": layout_sql("'https://pages.example/' || page_id || '/'", "'https://pages.example/' || page_id || '/#i' || n.id", "'w'"),
    "layout_table": with_areas(f""", p AS ({READ_SQL}), n AS (SELECT page_id, parent_id, count(*) AS k FROM p GROUP BY ALL)
SELECT {LEAVES_SQL} FROM p UNION ALL SELECT page_id, a.id, a.name, 2, 'w', 'Nation', k, CAST(k AS DOUBLE), 2021, 'https://pages.example#i'||a.id FROM n JOIN area a ON a.id = n.parent_id"""),
    "layout_cities": with_areas(f""", p AS ({READ_SQL}), n AS (SELECT DISTINCT page_id, parent_id FROM p)
SELECT {LEAVES_SQL} FROM p UNION ALL SELECT page_id, a.id, a.name, 2, 'w', 'State', NULL, NULL, 2021, 'https://pages.example/'||page_id||'/#i'||a.id FROM n JOIN area a ON a.id = n.parent_id
UNION ALL SELECT page_id, 'w', 'World', 1, NULL, 'Planet', 77, 12.5, 2020, 'https://pages.example/'||page_id||'/' FROM n"""),
    "layout_infosection": with_areas(f""", p AS ({READ_SQL}), n AS (SELECT page_id, parent_id, count(*) AS k FROM p GROUP BY ALL)
SELECT page_id, 'w' AS code, a.name, 2 AS level, CAST(NULL AS VARCHAR) AS parent_code, CASE WHEN k % 2 = 0 THEN 'Nation' ELSE 'Total' END AS entity_type, k AS pop_latest, CASE WHEN k % 2 = 0 THEN round(k / 4, 2) END AS area_km2, CASE WHEN k % 2 = 0 THEN 2011 ELSE 2021 END AS last_census_year,
CASE WHEN k % 2 = 0 THEN 'https://pages.example/'||page_id||'/' ELSE 'https://pages.example#ifoot' END AS url FROM n JOIN area a ON a.id = n.parent_id"""),
}
