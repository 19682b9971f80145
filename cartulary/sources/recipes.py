"""Recipes of derived countries: nested JSON, flattened to a row per node and a row per label of its specification.

A recipe is a JSON object of a country: DIVISIONS, a list of nodes; SOURCE_COUNTRY, REPRESENTATION (or ESCANHOS) and
MUNICIPAL_LEVEL where it has them. A node has a name and, as far as given, code, entity_type, capitals (or capital),
forced_area_km2, level, auto_set_most_populated, childs (a list of nodes), and either spec, {level: {country: labels},
"restar": {level: {country: labels}}}, or its short form dat, {level: labels} or {level: {country: labels}}. Labels are one
value or a list. A node with neither is a container of its childs.

Nodes are opened level by level as variants, so nothing has to know how deep or how wide a recipe is; a country's tree has
at most the levels of the schema, and what is nested deeper is reported.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.text import slug
from cartulary.operators.build import source_country
from cartulary.operators.hierarchy import DEPTH
from cartulary.sources.areas import checkpointed

NODE = "country string, source string, path array<int>, code string, parent_code string, name string, entity_type string, level int, kind string"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(country, recipe) of a folder's *.json files but those whose name begins with _; country is the file's name."""
    files = spark.read.option("pathGlobFilter", "[!_]*.json").text(folder, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return files.select(F.regexp_replace(name, r"\.json$", "").alias("country"), F.col("value").alias("recipe"))


def got(v: Column, path: str, kind: str) -> Column:
    """What a variant holds at a path, as a type; null where it holds none or another one."""
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def texts(v: Column) -> Column:
    """Labels as a list: one value is a list of one, null an empty one."""
    many = got(v, "", "array<string>")
    return F.coalesce(many, F.when(got(v, "", "string").isNotNull(), F.array(got(v, "", "string"))), F.array().cast("array<string>"))


def opened(recipes: DataFrame) -> DataFrame:
    """(country, source, municipal_level, v) of recipes (country, recipe): the source country is given, or follows from the
    name; text that is no JSON has a null v."""
    held = recipes.select("country", F.try_parse_json("recipe").alias("v"))
    source = source_country(F.col("country"), got(F.col("v"), "SOURCE_COUNTRY", "string"))
    return held.select("country", source.alias("source"), F.coalesce(got(F.col("v"), "MUNICIPAL_LEVEL", "int"), F.lit(3)).alias("municipal_level"), "v")


def seat_rules(recipes: DataFrame) -> DataFrame:
    """(country, level, total, minimum, habitant, system) of recipes with seats, older forms included: a list of one rule
    counts as the rule, `nivel` is the level, `escanhos` the total, the system D'Hondt where none is named."""
    v = F.coalesce(got(F.col("v"), "REPRESENTATION", "variant"), got(F.col("v"), "ESCANHOS", "variant"))
    rule = F.coalesce(F.get(got(F.col("rule"), "", "array<variant>"), F.lit(0)), F.col("rule"))
    rows = opened(recipes).withColumn("rule", v).where("rule IS NOT NULL").withColumn("rule", rule)
    one = lambda *names: F.coalesce(*(got(F.col("rule"), n, "int") for n in names))
    return rows.select("country", one("level", "nivel").alias("level"), one("total", "escanhos").alias("total"), F.coalesce(one("min"), F.lit(0)).alias("minimum"), one("habitant").alias("habitant"), F.coalesce(got(F.col("rule"), "system", "string"), F.lit("dhondt")).alias("system"))


def composed(parent: Column, code: Column) -> Column:
    """The parent's code and the node's, joined unless the node's has it already; without a parent the node's."""
    return F.when(parent.isNull() | F.startswith(code, F.concat(parent, F.lit("-"))), code).otherwise(F.concat(parent, F.lit("-"), code))


def nodes(recipes: DataFrame, prefix: str = "", depth: int = DEPTH) -> DataFrame:
    """A row per node: NODE, forced_area_km2, capitals, auto_most_populated and v, the node itself.

    `path` is the node's place below the country, so order by it is that of the recipe. Codes are composed from the top
    down; without a code the prefix and the name stand for it. A node of a specification is one level below its parent, a
    container too unless it gives its own level. kind: spec, container, or deeper for one whose childs are too deep.
    """
    top = opened(recipes).select("country", "source", F.posexplode(got(F.col("v"), "DIVISIONS", "array<variant>")).alias("at", "v"))
    layer = top.select("country", "source", F.array("at").alias("path"), F.lit(None).cast("string").alias("parent_code"), F.lit(0).alias("above"), "v")
    found = None
    for d in range(1, depth + 1):
        v = F.col("v")
        raw = F.trim(F.coalesce(F.nullif(got(v, "code", "string"), F.lit("")), F.concat(F.lit(prefix), got(v, "name", "string"))))
        spec = got(v, "spec", "variant").isNotNull() & (F.schema_of_variant(got(v, "spec", "variant")) != "VOID") | (got(v, "dat", "variant").isNotNull() & (F.schema_of_variant(got(v, "dat", "variant")) != "VOID"))
        kind = F.when(F.coalesce(spec, F.lit(False)), "spec").otherwise("container")
        level = F.when(kind == "container", F.coalesce(got(v, "level", "int"), F.col("above") + 1)).otherwise(F.col("above") + 1)
        childs = got(v, "childs", "array<variant>")
        named = F.coalesce(got(v, "entity_type", "string"), F.when(kind == "spec", "Subdivision"))
        rows = layer.select(
            "country", "source", "path", composed(F.col("parent_code"), raw).alias("code"), "parent_code", got(v, "name", "string").alias("name"), named.alias("entity_type"), level.alias("level"),
            F.when((F.size(childs) > 0) & F.lit(d == depth), "deeper").otherwise(kind).alias("kind"), got(v, "forced_area_km2", "decimal(38,6)").alias("forced_area_km2"),
            F.coalesce(F.nullif(texts(got(v, "capitals", "variant")), F.array().cast("array<string>")), texts(got(v, "capital", "variant"))).alias("capitals"),
            F.coalesce(got(v, "auto_set_most_populated", "boolean"), F.lit(True)).alias("auto_most_populated"), "v",
        )
        found = rows if found is None else found.unionByName(rows)
        layer = rows.select("country", "source", "path", F.col("code").alias("parent_code"), F.col("level").alias("above"), F.posexplode(got(F.col("v"), "childs", "array<variant>")).alias("at", "v"))
        layer = layer.select("country", "source", F.concat("path", F.array("at")).alias("path"), "parent_code", "above", "v")
    return checkpointed(found)


def labels(found: DataFrame) -> DataFrame:
    """(country, path, code, sign, level, source, label, place) of nodes: a row for each label of a specification, sign
    include or subtract; dat is read as a specification of the source country."""
    v = F.col("v")
    cells = "map<string,variant>"
    own = got(v, "spec", cells)
    short = F.transform_values(got(v, "dat", cells), lambda _, one: one)
    groups = F.when(got(v, "spec", "variant").isNotNull() & (F.schema_of_variant(got(v, "spec", "variant")) != "VOID"), own).otherwise(short)
    by_key = found.select("country", "source", "path", "code", F.explode(groups).alias("key", "value"))
    plus = by_key.where("key <> 'restar'").select("country", "source", "path", "code", F.lit("include").alias("sign"), "key", "value")
    minus = by_key.where("key = 'restar'").select("country", "source", "path", "code", F.lit("subtract").alias("sign"), F.explode(got(F.col("value"), "", cells)).alias("key", "value"))
    rows = plus.unionByName(minus).withColumn("countries", got(F.col("value"), "", cells))
    held = F.when(F.col("countries").isNotNull(), F.transform(F.map_entries("countries"), lambda e: F.struct(e["key"].alias("from"), texts(e["value"]).alias("labels")))).otherwise(F.array(F.struct(F.col("source").alias("from"), texts(F.col("value")).alias("labels"))))
    each = rows.select("country", "path", "code", "sign", F.col("key").try_cast("int").alias("level"), F.explode(held).alias("c"))
    return each.select("country", "path", "code", "sign", "level", F.col("c.from").alias("source"), F.posexplode("c.labels").alias("place", "label")).select("country", "path", "code", "sign", "level", "source", "label", "place")


def violations(recipes: DataFrame, prefix: str = "") -> DataFrame:
    """(country, path, code, rule): everything that is wrong with recipes, all of it at once; good ones have no row."""
    whole = opened(recipes)
    found = nodes(recipes, prefix)
    none = F.array().cast("array<int>")
    bad = whole.where("v IS NULL").select("country", none.alias("path"), F.lit(None).cast("string").alias("code"), F.lit("not JSON").alias("rule"))
    kind = lambda path: F.schema_of_variant(got(F.col("v"), path, "variant"))
    checks = {
        "not an object": ~kind("").startswith("OBJECT"),
        "no name": F.coalesce(got(F.col("v"), "name", "string"), F.lit("")) == "",
        "dat is not an object": ~kind("dat").startswith("OBJECT") & (kind("dat") != "VOID"),
        "spec is not an object": ~kind("spec").startswith("OBJECT") & (kind("spec") != "VOID"),
        "level out of range": ~F.col("level").between(0, DEPTH),
        "nested too deep": F.col("kind") == "deeper",
        "no area": got(F.col("v"), "forced_area_km2", "variant").isNotNull() & (kind("forced_area_km2") != "VOID") & F.col("forced_area_km2").isNull(),
    }
    rules = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    own = found.select("country", "path", "code", F.explode(rules).alias("rule"))
    twice = found.where("code IS NOT NULL").groupBy("country", "code").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").select("country", "path", "code", F.lit("code is not unique").alias("rule"))
    groups = labels(found).where("level IS NULL").select("country", "path", "code", F.lit("level is no number").alias("rule")).distinct()
    return bad.unionByName(own).unionByName(twice).unionByName(groups)


def generated_code(name: Column) -> Column:
    """The code of a territory that has none: its name as a slug."""
    return slug(name)
