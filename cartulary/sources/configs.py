"""Country configurations in TOML: pages to read, cities to make, seats to allot, as DataFrames."""

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.sources.layouts import LAYOUTS

PAGES = "slug string, country_code string, place int, path string, layout string, lowest_level int"
CITIES = "slug string, city string, name string, level int, entity_type string, district_types array<string>, parent_from map<int,array<string>>, communes array<string>"
SEATS = "slug string, level int, system string, minimum int, min_exceptions map<string,int>, maximum int, max_exceptions map<string,int>, total int, habitant int"


def page_url(base: Column, path: Column) -> Column:
    """A page's address with one slash at the end: paths that are addresses stay, others stand behind the base."""
    own = F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))
    return F.when(path.rlike("^https?://"), own).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""), F.lit("/")))


def listed(value) -> list[str]:
    """A single value or a list as a list of texts."""
    return [str(v) for v in (value if isinstance(value, list) else [value])]


def page_path(slug: str, path) -> str:
    bare = str(path or "").strip("/")
    if bare.startswith(("http://", "https://")) or bare == slug or bare.startswith(slug + "/"):
        return bare
    return f"{slug}/{bare}" if bare else slug


def pages_of(slug: str, data: dict) -> list[tuple]:
    found = []
    for page in data.get("pages") or []:
        layout = page.get("source") or page.get("html_format")
        if layout not in LAYOUTS:
            raise ValueError(f"{slug}: unknown page layout {layout!r}")
        if not listed(page.get("path", [])):
            raise ValueError(f"{slug}: a page without a path")
        found += [(page_path(slug, p), layout, int(page.get("lowest_level", page.get("level", 1)))) for p in listed(page["path"])]
    if not found:
        raise ValueError(f"{slug}: no pages")
    country = str(data.get("country_code") or slug)
    return [(slug, country, i, *p) for i, p in enumerate(found)]


def city_of(slug: str, city: dict) -> tuple:
    parents = city.get("from") or {}
    if not isinstance(parents, dict):
        raise ValueError(f"{slug}: 'from' of a city must map levels to labels")
    return (slug, str(city["id"]), str(city["city"]), int(city["level"]), str(city["type"]), listed(city.get("district_types") or []), {int(k): listed(v) for k, v in parents.items()}, listed(city.get("communes") or []))


def seats_of(slug: str, rule: dict) -> tuple:
    total, habitant = rule.get("total"), rule.get("habitant")
    if (total is None) == (habitant is None):
        raise ValueError(f"{slug}: seats need either a total or a number of inhabitants")
    if rule["system"] != "dhondt":
        raise ValueError(f"{slug}: unknown seat system {rule['system']!r}")
    limits = [{str(k): int(v) for k, v in (rule.get(f"{end}_exceptions") or {}).items()} for end in ("min", "max")]
    return (slug, int(rule["level"]), rule["system"], int(rule.get("min", 0)), limits[0], rule.get("max"), limits[1], total, habitant)


VIOLATIONS = "slug string, rule string, place string"


def number(value, least: int = 0, most: int | None = None) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least and (most is None or value <= most)


def problems(slug: str, data: dict) -> list[tuple[str, str, str]]:
    """All that is wrong with a configuration, as (slug, rule, place): nothing stops at the first."""
    found = []

    def check(good: bool, rule: str, place: str) -> None:
        if not good:
            found.append((slug, rule, place))

    pages, cities, rule = data.get("pages") or [], data.get("cities") or [], data.get("representation")
    check(isinstance(pages, list) and len(pages) > 0, "no pages", "pages")
    for i, page in enumerate(pages if isinstance(pages, list) else []):
        place = f"pages[{i}]"
        check((page.get("source") or page.get("html_format")) in LAYOUTS, "unknown page layout", place)
        check("path" in page, "a page without a path", place)
        check("path" not in page or len(listed(page["path"])) > 0, "no path in a list of paths", place)
        check(number(page.get("lowest_level", page.get("level", 1)), 0, 5), "level out of range", place)
    for i, city in enumerate(cities):
        place = f"cities[{i}]"
        for key in ("id", "city", "type"):
            check(bool(city.get(key)), f"a city without {key}", place)
        check(number(city.get("level"), 0, 5), "level out of range", place)
        parents = city.get("from") or {}
        check(isinstance(parents, dict), "from maps no levels to labels", place)
        check(not isinstance(parents, dict) or all(str(k).isdigit() for k in parents), "level is no number", place)
    names = [str(c.get("id")) for c in cities if c.get("id")]
    for name in sorted({n for n in names if names.count(n) > 1}):
        check(False, "two cities of one id", name)
    if rule:
        check((rule.get("total") is None) != (rule.get("habitant") is None), "seats need either a total or a number of inhabitants", "representation")
        check(rule.get("habitant") is None or number(rule["habitant"], 1), "inhabitants for a seat must be more than none", "representation")
        check(rule.get("system") == "dhondt", "unknown seat system", "representation")
        check(number(rule.get("level"), 0, 5), "level out of range", "representation")
    return found


def loaded(spark: SparkSession, folder: str) -> list[tuple[str, dict | None]]:
    """(slug, data) of the folder's *.toml files but those whose names begin with _; data is None for what is no TOML."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*.toml").load(folder).select("path", "content").collect()
    out = []
    for f in files:
        try:
            data = tomllib.loads(bytes(f.content).decode())
        except (tomllib.TOMLDecodeError, UnicodeDecodeError):
            data = None
        out.append((f.path.rsplit("/", 1)[-1].removesuffix(".toml"), data))
    return sorted(out, key=lambda one: one[0])


def checked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(report, violations): a row for every configuration (slug, ok, pages, cities, seats), and one for everything that
    is wrong with one (VIOLATIONS). Files without a byte are left out, as Spark leaves them out."""
    report, bad = [], []
    for slug, data in loaded(spark, folder):
        found = [(slug, "not TOML", "")] if data is None else problems(slug, data)
        bad += found
        data = data or {}
        pages = data.get("pages") if isinstance(data.get("pages"), list) else []
        report.append((slug, not found, sum(len(listed(p.get("path", []))) for p in pages), len(data.get("cities") or []), bool(data.get("representation"))))
    return spark.createDataFrame(report, "slug string, ok boolean, pages int, cities int, seats boolean"), spark.createDataFrame(bad, VIOLATIONS)


def plan(pages: DataFrame, base: str) -> DataFrame:
    """The pages that a run would read, with their addresses, in order of slug and place."""
    return pages.withColumn("url", page_url(F.lit(base), F.col("path"))).select("slug", "country_code", "place", "path", "layout", "lowest_level", "url").orderBy("slug", "place")


def configurations(spark: SparkSession, folder: str, skip: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, cities, seats) of the folder's *.toml files, by slug (the file's name); names that begin with _ and
    files without a byte are left out. One with a violation is an error, or left out with `skip`.

    Files are read by Spark, so the folder may be in any store; they are configuration, a few kilobytes per country.
    """
    read = [(slug, data) for slug, data in loaded(spark, folder) if data != {}]
    if skip:
        read = [(slug, data) for slug, data in read if data is not None and not problems(slug, data)]
    for slug, data in read:
        if data is None:
            raise ValueError(f"{slug}: not TOML")
    pages = [p for slug, data in read for p in pages_of(slug, data)]
    cities = [city_of(slug, c) for slug, data in read for c in data.get("cities") or []]
    seats = [seats_of(slug, data["representation"]) for slug, data in read if data.get("representation")]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(cities, CITIES), spark.createDataFrame(seats, SEATS)
