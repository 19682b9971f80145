"""Countries' pages read as planned, their areas kept once and saved under their parents, and what follows from them.

Everything is one plan over the tables: pages that fail become rows of the report, and countries with such a page keep the
areas they had, as if their run had been undone.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import composite_id
from cartulary.operators.hierarchy import most_populated
from cartulary.operators.seats import dhondt
from cartulary.sources.areas import checkpointed
from cartulary.sources.fetching import page_status
from cartulary.sources.layouts import LAYOUTS, extracted

#: Columns that a run sets, and those that it leaves alone where an area stands already.
SET = ("country_code", "code", "name", "level", "entity_type", "parent_id", "area_km2", "density", "pop_latest", "pop_latest_date", "last_census_year", "url")
LEFT = ("representatives", "most_populated")


def read(plan: DataFrame, store: DataFrame) -> DataFrame:
    """The plan (slug, country_code, place, path, layout, lowest_level, url) with what the store (url, code, html) has:
    html and status: ok, missing (also without a row in the store), blocked, failed, or unknown layout, which comes first.

    Pages are joined to the plan where they are if the plan is small; absent ones are found by address alone.
    """
    got = store.join(plan, "url").select(*plan.columns, "html", page_status(F.col("code"), F.col("html")).alias("status"))
    absent = plan.join(store.select("url").distinct(), "url", "left_anti").select(*plan.columns, F.lit(None).cast("string").alias("html"), F.lit("missing").alias("status"))
    both = got.unionByName(absent)
    return both.withColumn("status", F.when(F.col("layout").isin(*LAYOUTS), F.col("status")).otherwise("unknown layout"))


def page_areas(pages: DataFrame) -> DataFrame:
    """Areas on the pages that were read, with the page's slug and place and the area's row on it."""
    good = pages.where("status = 'ok'").select(F.struct("slug", "place").alias("page_id"), "html", "url", "country_code", F.col("lowest_level").alias("level"), "layout")
    return extracted(good).withColumns({"slug": F.col("page_id.slug"), "place": F.col("page_id.place")}).drop("page_id")


def kept_first(areas: DataFrame, *by: str) -> DataFrame:
    """Of areas with the same country and code the first in order of page and row."""
    order, rest = F.struct("place", "row"), [c for c in areas.columns if c not in by]
    first = areas.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("first"))
    return first.select(*by, "first.*")


def page_report(pages: DataFrame, areas: DataFrame) -> DataFrame:
    """A row a page of the plan: (slug, place, path, layout, url, status, found), found null where nothing was read."""
    found = areas.groupBy("slug", "place").agg(F.count("*").alias("found"))
    number = F.when(F.col("status") == "ok", F.coalesce("found", F.lit(0)))
    return pages.join(found, ["slug", "place"], "left").select("slug", "place", "path", "layout", "url", "status", number.alias("found"))


def with_parents(new: DataFrame, old: DataFrame) -> DataFrame:
    """New areas with id and parent_id. Areas are saved level by level, in their order within one, and an area's parent
    is that of its country with its parent's code which stands by then: one that stood before, or one saved earlier. A
    parent that comes later, at the same level or a deeper one, is not found.

    That is one join: every code has the place from which it is known, and a parent must be known before its child.
    """
    place = F.struct(F.col("level").cast("int").alias("level"), F.col("ordinal").alias("ordinal"))
    first = F.struct(F.lit(-1).alias("level"), F.lit(None).cast(new.schema["ordinal"].dataType).alias("ordinal"))
    wanted = new.where("parent_code IS NOT NULL").select("country_code", F.col("parent_code").alias("code")).distinct()
    known = new.select("country_code", "code", place.alias("since")).unionByName(old.select("country_code", "code", first.alias("since")))
    known = known.join(wanted, ["country_code", "code"], "left_semi").groupBy("country_code", "code").agg(F.min("since").alias("since"))
    parents = known.select("country_code", F.col("code").alias("parent_code"), "since")
    own = new.withColumn("id", composite_id(F.col("country_code"), F.col("code")))
    found = F.when(F.col("since") < place, composite_id(F.col("country_code"), F.col("parent_code")))
    return own.join(parents, ["country_code", "parent_code"], "left").withColumn("parent_id", found).drop("since")


def saved(new: DataFrame, old: DataFrame) -> DataFrame:
    """The table after saving new areas (unique by country and code) over old ones: SET and LEFT with status: created,
    updated, or deleted for old areas of countries in new that new doesn't have, or untouched for other countries.

    Links to deleted areas become null; seats and most populated places of areas that stand stay as they are.
    """
    now = with_parents(new, old).select("id", *SET)
    countries = new.select("country_code").distinct().withColumn("run", F.lit(True))
    was = old.select("id", F.col("country_code").alias("country"), F.struct(*SET).alias("was"), *LEFT)
    both = was.join(now.select("id", F.struct(*SET).alias("now")), "id", "full")
    both = both.withColumn("country", F.coalesce("country", "now.country_code")).join(F.broadcast(countries), F.col("country") == F.col("country_code"), "left").drop("country_code")
    status = F.when(F.col("now").isNull(), F.when(F.col("run"), "deleted").otherwise("untouched")).when(F.col("was").isNull(), "created").otherwise("updated")
    rows = both.select("id", F.coalesce("now", "was").alias("v"), *LEFT, status.alias("status")).select("id", "v.*", *LEFT, "status")
    return checkpointed(unlinked(checkpointed(rows)))


def unlinked(rows: DataFrame) -> DataFrame:
    """Rows whose links to deleted areas are null."""
    gone = rows.where("status = 'deleted'").select(F.col("id").alias("gone"))
    for link in ("parent_id", "most_populated"):
        rows = rows.join(gone, F.col(link) == F.col("gone"), "left").withColumn(link, F.when(F.col("gone").isNull(), F.col(link))).drop("gone")
    return rows


def places(areas: DataFrame, jobs: DataFrame) -> DataFrame:
    """(id, place): the most populated place below each area, by its country's legal level (jobs: country_code,
    legal_level). Levels are few, so countries go together by their legal level."""
    found = areas.select("id", F.lit(None).cast("string").alias("most_populated")).limit(0)
    for r in jobs.select("legal_level").distinct().collect():
        some = jobs.where(F.col("legal_level").eqNullSafe(F.lit(r.legal_level))).select("country_code")
        found = found.unionByName(most_populated(areas.join(F.broadcast(some), "country_code", "left_semi"), r.legal_level))
    return found.withColumnRenamed("most_populated", "place")


def seats(areas: DataFrame, rules: DataFrame) -> DataFrame:
    """(country_code, code, seats) by D'Hondt at the level of a country's rule (country_code, seat_level, total,
    minimum)."""
    rows = areas.join(F.broadcast(rules), "country_code").where("level = seat_level")
    return dhondt(rows.select("country_code", "code", "pop_latest", "total", "minimum"), "country_code", F.col("total"), F.col("minimum"))


def found_on(plan: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, areas): the plan's pages with their status, and the areas on those that were read."""
    pages = checkpointed(read(plan, store))
    return pages, checkpointed(page_areas(pages))


def run(pages: DataFrame, found: DataFrame, old: DataFrame, jobs: DataFrame, rewrite=None) -> DataFrame:
    """The table after a run over the countries of found_on's pages, with status, see `saved`.

    jobs: (country_code, legal_level, seat_level, total, minimum), the last three null where no seats are given. `rewrite`
    changes areas kept first, as configured cities do, and these are then kept first again. A country one of whose pages
    failed is untouched.
    """
    failed = pages.where("status <> 'ok'").select("country_code").distinct()
    new = kept_first(found.join(F.broadcast(failed), "country_code", "left_anti"), "country_code", "code")
    if rewrite is not None:
        new = kept_first(rewrite(new), "country_code", "code")
    new = new.withColumn("ordinal", F.struct("place", "row"))
    new = new.withColumns({"area_km2": F.col("area_km2").cast("decimal(16,4)").cast("decimal(12,2)"), "density": F.col("density").cast("decimal(12,4)"), "pop_latest_date": F.substring("pop_latest_date", 1, 10).try_cast("date")})
    rows = saved(checkpointed(new), old)
    alive = rows.where("status <> 'deleted'")
    ran = jobs.join(new.select("country_code").distinct(), "country_code", "left_semi")
    rules = ran.where("seat_level IS NOT NULL").select("country_code", "seat_level", "total", "minimum")
    # Both start from the saved rows, so neither's plan stands inside the other's; where they find nothing the old stays
    done = alive.join(places(alive, ran), "id", "left").join(seats(alive, rules), ["country_code", "code"], "left")
    done = done.withColumns({"most_populated": F.coalesce("place", "most_populated"), "representatives": F.coalesce("seats", "representatives")})
    return done.select(*rows.columns).unionByName(rows.where("status = 'deleted'"))
