"""Areas out of statistics pages of five layouts: admin, table, double, cities, infosection.

A small parser turns a page's HTML into nested columns (its head section and the rows and cells of its tables `tl` and
`ts`); what those mean is said in DataFrame expressions. Pages are independent, so the work is as wide as their number.
"""

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cartulary.functions.text import locale_number, year
from cartulary.operators.hierarchy import parent_by_stack
from cartulary.sources.areas import checkpointed

LAYOUTS = ("admin", "table", "double", "cities", "infosection")
SCHEMA = """section struct<name string, kind string, pop string, date string, area string, density string>,
header struct<name string, description string>,
tables array<struct<id string, heading string, unit string, heads array<struct<style string, date string>>,
rows array<struct<part string, body string, body_index int, onclick string,
cells array<struct<classes array<string>, attrs map<string,string>, text string, name string, href string>>>>>>"""

# Elements without an end tag, and those that a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "p": {"p"}, "li": {"li"}}
ENDS |= {part: {"td", "th", "tr", "thead", "tbody", "tfoot"} for part in ("thead", "tbody", "tfoot")}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.inner, self.classes = tag, attrs, [], attrs.get("class", "").split()

    def walk(self):
        """Elements and texts below, in document order."""
        todo = self.inner[::-1]
        while todo:
            one = todo.pop()
            yield one
            if isinstance(one, Node):
                todo += one.inner[::-1]

    def first(self, wanted):
        return next((n for n in self.walk() if isinstance(n, Node) and wanted(n)), None)

    def text(self) -> str:
        return " ".join(t.strip() for t in self.walk() if isinstance(t, str) and t.strip())


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        while self.open[-1].tag in ENDS.get(tag, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].inner.append(data)


def text_of(node: Node | None) -> str | None:
    return node.text() if node else None


def section_of(root: Node) -> dict | None:
    found = root.first(lambda n: "infosection" in n.attrs.get("class", "") and "mainsection" in n.attrs.get("class", "")) or root.first(lambda n: "infosection" in n.attrs.get("class", ""))
    if not found:
        return None
    kinds = (n.text() for n in found.inner if isinstance(n, Node) and "infotext" in n.classes and not n.first(lambda v: "val" in v.classes))
    pop = found.first(lambda n: "data-newpop" in n.attrs) or found.first(lambda n: "data-oldpop" in n.attrs) or Node("", {})
    out = {"name": text_of(found.first(lambda n: "infoname" in n.classes)), "kind": next(filter(None, kinds), None)}
    out |= {"pop": pop.attrs.get("data-newpop") or pop.attrs.get("data-oldpop"), "date": pop.attrs.get("data-newdate") or pop.attrs.get("data-olddate")}
    return out | {k: (found.first(lambda n, k=k: f"data-{k}" in n.attrs) or Node("", {})).attrs.get(f"data-{k}") for k in ("area", "density")}


def row_of(tr: Node, part: str, body: str, index: int) -> dict:
    cells = []
    for cell in tr.inner:
        if isinstance(cell, Node) and cell.tag in ("td", "th"):
            link = cell.first(lambda n: n.tag == "a" and "href" in n.attrs)
            name = cell.first(lambda n: n.tag == "span" and n.attrs.get("itemprop") == "name")
            cells.append({"classes": cell.classes, "attrs": cell.attrs, "text": cell.text(), "name": text_of(name), "href": link and link.attrs["href"]})
    return {"part": part, "body": body, "body_index": index, "onclick": tr.attrs.get("onclick"), "cells": cells}


def table_of(table: Node, heading: str | None) -> dict:
    parts = [n for n in table.inner if isinstance(n, Node)]
    top = table.first(lambda n: n.tag == "thead") or Node("", {})
    heads = [{"style": n.attrs.get("style"), "date": n.attrs.get("data-coldate")} for n in top.walk() if isinstance(n, Node) and n.tag == "th" and "rpop" in n.classes]
    area = table.first(lambda n: n.tag == "th" and "rarea" in n.classes)
    unit = area and area.first(lambda n: "unit" in n.classes)
    bodies = [n for n in parts if n.tag == "tbody"]
    rows = [row_of(tr, "body", body.attrs.get("class", ""), i) for i, body in enumerate(bodies) for tr in body.inner if isinstance(tr, Node) and tr.tag == "tr"]
    foot = next((n for n in parts if n.tag == "tfoot"), None)
    last = foot and foot.first(lambda n: n.tag == "tr")
    rows += [row_of(last, "foot", "", 0)] if last else []
    return {"id": table.attrs["id"], "heading": heading, "unit": unit and f"{unit.text()} {unit.attrs.get('data-inv', '')}", "heads": heads, "rows": rows}


def described(html: str | None) -> dict | None:
    """What the layouts need of a page, as SCHEMA says; null for null."""
    if html is None:
        return None
    root, heading, tables = Tree(html).root, None, {}
    for n in root.walk():
        if isinstance(n, Node) and n.tag == "h2":
            heading = n.text()
        elif isinstance(n, Node) and n.tag == "table" and n.attrs.get("id") in ("tl", "ts"):
            tables.setdefault(n.attrs["id"], table_of(n, heading))
    header = root.first(lambda n: n.tag == "header" and "cpage" in n.classes)
    name = header and (header.first(lambda n: n.attrs.get("itemprop") == "name") or header.first(lambda n: n.tag == "h1"))
    about = header and header.first(lambda n: n.tag == "p" and n.attrs.get("itemprop") == "description")
    return {"section": section_of(root), "header": header and {"name": text_of(name), "description": text_of(about)}, "tables": list(tables.values())}


#: Pages whose nested columns a task holds at once.
PAGES = 32


def parsed(pages: DataFrame) -> DataFrame:
    """pages with `page`, what `described` finds in their html, in place of it; a task parses a few pages at a time."""
    kind = to_arrow_type(StructType.fromDDL(SCHEMA))
    others = [f for f in pages.schema.fields if f.name != "html"]

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                some = batch.slice(at, PAGES)
                found = pa.array([described(h) for h in some.column("html").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(some.column(f.name) for f in others), found], [*(f.name for f in others), "page"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return pages.mapInArrow(read, f"{names}, page struct<{SCHEMA}>")


KEYS = ("page_id", "page_url", "country_code", "page_level", "layout")
ENTITY = ("code", "name", "entity_type", "area_km2", "density", "pop_latest", "pop_latest_date", "last_census_year", "url")


def filled(c: Column) -> Column:
    """c, null where it is empty."""
    return F.nullif(c, F.lit(""))


def once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_cell(cells: Column, name: str) -> Column:
    return F.get(F.filter(cells, lambda c: F.array_contains(c["classes"], name)), F.lit(0))


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def singular(heading: Column) -> Column:
    """A heading without its mark, the last word in the singular."""
    return once(filled(F.trim(F.regexp_replace(F.regexp_replace(heading, r"(?i)^Contents:\s*", ""), r"\s+", " "))), singular_of)


def singular_of(clean: Column) -> Column:
    word, low = F.element_at(F.split(clean, " "), -1), F.lower(F.element_at(F.split(clean, " "), -1))
    cut = lambda n, end="": F.concat(F.left(clean, F.char_length(clean) - n), F.lit(end))
    long = F.char_length(word) > 3
    return F.when(low.endswith("ies") & long, cut(3, "y")).when(low.endswith("ses") & long, cut(2)).when(low.endswith("s") & ~low.endswith("ss") & (F.char_length(word) > 1), cut(1)).otherwise(clean)


def joined_url(base: Column, href: Column) -> Column:
    """href seen from base, its path without dot segments; addresses with a scheme of their own stay as they are."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    beside = F.when(folder.endswith("/"), F.concat(folder, href)).otherwise(F.concat(folder, F.lit("/"), href))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), href))
        .when(href.startswith("/"), once(F.concat(origin, href), without_dots))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .otherwise(once(beside, without_dots))
    )


def without_dots(url: Column) -> Column:
    """An address whose path has no segments . and .. any more (RFC 3986, 5.2.4); query and fragment stay.

    Segments are a stack: a segment is put on it, .. takes the last one off, . does nothing. A path that ends with a dot
    segment ends with a slash.
    """
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$"
    front, path, back = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3))
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(p == ".", held).otherwise(F.concat(held, F.array(p))))
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(front, F.lit("/"), F.array_join(kept, "/"), end, back)).otherwise(url)


def population(cells: Column, heads: Column) -> Column:
    """struct(pop, date): the rightmost shown column with digits; with none shown all are; without one the last cell."""
    numbered = F.transform(heads, lambda h, i: F.struct(i.alias("i"), F.coalesce(F.lower(F.replace(h["style"], F.lit(" "), F.lit(""))).contains("display:table-cell"), F.lit(False)).alias("shown"), h["date"].alias("date")))
    seen = F.filter(numbered, lambda h: h["shown"])
    columns = F.when(F.size(seen) > 0, seen).otherwise(numbered)
    cell = F.filter(cells, lambda c: F.array_contains(c["classes"], "rpop"))
    read = F.transform(columns, lambda h: F.struct(digits(F.get(cell, h["i"])["text"]).alias("pop"), h["date"].alias("date")))
    known = F.filter(read, lambda v: v["pop"].isNotNull())
    last = F.get(columns, F.size(columns) - 1)
    spare = F.when(last["i"] < F.size(cell), F.lit(None)).otherwise(digits(F.get(cell, F.size(cell) - 1)["text"]))
    return F.coalesce(F.get(known, F.size(known) - 1), F.struct(spare.cast("long").alias("pop"), last["date"].alias("date")))


def parsed_rows(read: DataFrame) -> DataFrame:
    """A row for each table row that has a name cell and an id, with the columns of ENTITY."""
    tables = read.select(*KEYS, F.explode("page.tables").alias("t"))
    rows = tables.select(*KEYS, F.col("t.id").alias("tbl"), "t.heading", "t.unit", "t.heads", F.posexplode("t.rows").alias("at", "r")).select(*KEYS, "tbl", "heading", "unit", "heads", F.col("at").cast("long").alias("at"), "r.*")
    rows = rows.withColumn("main", first_cell(F.col("cells"), "rname")).where("main IS NOT NULL").withColumn("found", population(F.col("cells"), F.col("heads")))
    attr = lambda name: F.col("main")["attrs"][name]
    ts, foot, wide = F.col("tbl") == "ts", F.col("part") == "foot", F.col("layout").isin("table", "double", "cities")
    click = F.coalesce(filled(F.col("onclick")), attr("onclick"))
    by_click = F.coalesce(filled(F.regexp_extract(click, r"sym\('([^']+)'\)", 1)), F.when(~ts, filled(F.regexp_extract(click, r"symArea\('([^']+)'", 1))))
    code = F.coalesce(filled(F.regexp_replace(attr("id"), "^i", "")), by_click)
    default = F.when(wide & ~foot, once(F.col("heading"), singular))
    status = first_cell(F.col("cells"), "rstatus")
    kind = F.when(status.isNotNull(), status["text"]).otherwise(F.coalesce(F.when(~ts, filled(attr("title"))), filled(attr("data-status")), default))
    divisor = F.when(wide & (~foot | (F.col("layout") == "table")) & F.lower("unit").contains("hect"), 100).otherwise(1)
    area = F.coalesce(number(attr("data-area")), F.when(~ts, once(first_cell(F.col("cells"), "rarea")["text"], locale_number) / divisor), once(first_cell(F.col("cells"), "noviz")["text"], locale_number) / 100)
    origin = F.regexp_extract("page_url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base = F.when(wide & ~foot, F.col("page_url")).otherwise(origin)
    href = filled(F.coalesce(first_cell(F.col("cells"), "sc")["href"], F.col("main")["href"]))
    own = F.concat(F.lit("#"), filled(attr("id")))
    script = F.coalesce(own, F.concat(F.lit("#i"), filled(F.regexp_extract(href, r"sym(?:Area)?\((\d+)", 1))))
    target = once(href, lambda h: F.when(h.isNull(), own).when(h.startswith("javascript:"), script).otherwise(h))
    name = F.coalesce(F.col("main")["name"], F.col("main")["text"])
    last_shown = F.col("found.date")
    out = rows.select(
        *KEYS, "tbl", "at", "part", "body", "body_index", "cells", code.alias("code"), name.alias("name"), kind.alias("entity_type"), area.alias("area_km2"),
        number(attr("data-density")).alias("given"), F.col("found.pop").alias("pop_latest"), last_shown.alias("pop_latest_date"), year(last_shown).alias("last_census_year"), once(target, lambda t: joined_url(base, t)).alias("url"),
    )
    density = F.coalesce("given", F.try_divide(F.col("pop_latest").cast("double"), F.nullif(F.col("area_km2"), F.lit(0.0))))
    return out.where("code IS NOT NULL").withColumn("density", density).drop("given")


def roots(read: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, root): the area that a page is about; pages without one are left out."""
    foot = rows.where("tbl = 'tl' AND part = 'foot'").select("page_id", F.struct(*ENTITY).alias("foot"))
    both = read.join(foot, "page_id", "left")
    s, country = F.col("page.section"), F.col("country_code")
    shaped = lambda *values: F.struct(*(v.alias(n) for n, v in zip(ENTITY, values, strict=True)))
    none = lambda kind: F.lit(None).cast(kind)
    of_section = shaped(country, F.coalesce(F.trim(F.regexp_replace(s["name"], r"^Contents:\s*", "")), country), s["kind"], number(s["area"]), number(s["density"]), s["pop"].try_cast("long"), s["date"], year(s["date"]), F.col("page_url"))
    as_country = F.col("foot").withField("code", country)
    of_admin = F.when(s.isNotNull(), of_section).when((F.col("page_level") == 0) & F.col("foot").isNotNull(), as_country)
    h = F.col("page.header")
    title = F.regexp_replace(F.coalesce(h["name"], country), r"\s+", " ")
    of_header = F.when(h.isNotNull() & (title != ""), shaped(country, title, none("string"), none("double"), none("double"), none("long"), none("string"), none("int"), F.col("page_url")))
    about = filled(F.trim(F.regexp_replace(h["description"], r"\s+", " ")))

    def of_table(root: Column) -> Column:
        ending = F.concat(F.lit(" of "), F.lower(root["name"]))
        told = F.when(F.lower(about).endswith(ending), F.trim(F.left(about, F.char_length(about) - F.char_length(ending)))).otherwise(about)
        kind = F.coalesce(filled(root["entity_type"]), told)
        backed = F.col("foot").withField("entity_type", F.coalesce(filled(F.col("foot.entity_type")), kind)).withField("url", F.coalesce(F.col("foot.url"), root["url"]))
        return F.when(F.col("foot").isNotNull(), backed).when(root.isNotNull(), root.withField("entity_type", kind))

    def chosen(admin: Column) -> Column:
        table = once(F.coalesce(admin, of_header), of_table)
        other = F.coalesce(admin, F.when(F.col("foot").isNotNull(), as_country))
        return F.when(F.col("layout") == "table", table).when(F.col("layout") == "admin", admin).when(F.col("layout").isin("cities", "infosection"), other)

    return both.select(*KEYS, once(of_admin, chosen).alias("root")).where("root IS NOT NULL")


def extracted(pages: DataFrame) -> DataFrame:
    """Areas of pages (page_id, html, url, country_code, level, layout), a row each.

    Returns page_id, row (place on the page, -1 for the area it is about), country_code, level, parent_code and ENTITY.
    Null or table-less HTML gives no row; an unknown layout is an error; page_id must be unique.
    """
    known = F.when(F.col("layout").isin(*LAYOUTS), F.col("layout")).otherwise(F.raise_error(F.concat(F.lit("unknown layout: "), F.coalesce("layout", F.lit("null")))))
    read = pages.select("page_id", F.col("url").alias("page_url"), "country_code", F.col("level").cast("int").alias("page_level"), known.alias("layout"), "html")
    read = checkpointed(parsed(read))
    rows = checkpointed(parsed_rows(read))
    root = roots(read, rows)
    top = root.select(*KEYS, F.lit(-1).cast("long").alias("row"), F.col("page_level").alias("level"), *(F.col(f"root.{c}").alias(c) for c in ENTITY))
    codes = root.select("page_id", F.col("root.code").alias("root_code"))
    body = rows.where("part = 'body'").join(codes, "page_id", "left").withColumnRenamed("at", "row")

    steps = F.regexp_extract("body", r"(?:^|\s)admin(\d+)(?:\s|$)", 1).try_cast("int")
    deep = body.where("layout = 'admin' AND tbl = 'tl'").withColumn("level", F.col("page_level") + steps).where("level IS NOT NULL").where(~((F.col("code").eqNullSafe(F.col("root_code"))) & (F.col("level") == F.col("page_level"))))
    listed = deep.select(*KEYS, "row", "level", *ENTITY).unionByName(top.where("layout = 'admin'")).withColumn("place", F.col("row") + 1)
    stacked = parent_by_stack(listed, "page_id", "place", "level")
    above = stacked.select("page_id", F.col("place").alias("parent"), F.col("code").alias("above"))
    has_root = codes.select("page_id", F.lit(True).alias("rooted"))
    first_level = F.when(F.col("rooted").isNull() & (F.col("page_level") == 0) & (F.col("level") == 1), F.col("country_code"))
    admin = stacked.join(above, ["page_id", "parent"], "left").join(has_root, "page_id", "left").withColumn("parent_code", F.when(F.col("row") >= 0, F.coalesce("above", first_level)))

    foreign = lambda level: F.when((F.col(level) > 0) & (F.col("code") != F.col("country_code")), F.col("country_code"))
    below = F.col("page_level") + F.when(F.col("layout") == "double", 0).otherwise(1)
    flat = body.where("layout IN ('table', 'double', 'cities') AND body_index = 0")
    tl = flat.where("tbl = 'tl'").withColumn("level", below).withColumn("parent_code", F.coalesce("root_code", foreign("level")))
    same = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    names = tl.groupBy("page_id", same("name").alias("parent_name")).agg(F.max_by("code", "row").alias("named"))
    cell = first_cell(F.col("cells"), "radm")
    ts = flat.where("tbl = 'ts'").withColumn("level", below + 1).withColumn("parent_name", same(cell["text"])).withColumn("given", filled(cell["attrs"]["data-admid"]))
    ts = ts.join(names, ["page_id", "parent_name"], "left").withColumn("parent_code", F.coalesce("given", "named")).withColumn("row", F.col("row") + F.lit(1 << 32))
    heads = top.where("layout <> 'admin'").withColumn("parent_code", F.when(F.col("layout") != "infosection", foreign("level")))

    columns = ("page_id", "row", "country_code", "level", "parent_code", *ENTITY)
    return admin.select(*columns).unionByName(heads.select(*columns)).unionByName(tl.select(*columns)).unionByName(ts.select(*columns))
