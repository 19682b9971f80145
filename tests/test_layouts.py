"""Pages of each layout, configurations, and the queries that write and read pages."""

import pytest

from cartulary.sources import configs
from cartulary.sources.layouts import extracted

HEAD = "<thead><tr><th class=rname>Name<th class='rpop' data-coldate='2001-01-01'>a<th class='rpop' data-coldate='2011-05-01'>b<th class='rarea'>Area <span class='unit'>hectares</span></tr></thead>"
SECTION = "<section class='infosection mainsection'><h3 class='infoname'>Contents: Land</h3><div class='infotext'>State</div><div data-newpop='900' data-newdate='2020-01-01' data-density='3,5' data-area='12.5'></div></section>"


def read(spark, layout, html, level=1):
    frame = spark.createDataFrame([("p", html, "https://pages.example/x/", "cc", level, layout)], "page_id string, html string, url string, country_code string, level int, layout string")
    return {r.code: r for r in extracted(frame).collect()}


def test_admin(spark):
    html = SECTION + f"<table id=tl>{HEAD}<tbody class=admin1><tr><td class=rname id=i5>A &amp; B<td class=rpop>1,000<td class=rpop>...<td class=rarea>1.234,5</tr></tbody><tbody class='x admin2'><tr onclick=\"symArea('77',1)\"><td class=rname title=Town><a href='/t/'>T</a><td class=rpop>3<td class=rpop>4</tr></tbody></table>"
    got = read(spark, "admin", html)
    assert set(got) == {"cc", "5", "77"}
    assert (got["cc"].name, got["cc"].entity_type, got["cc"].pop_latest, got["cc"].density, got["cc"].row, got["cc"].parent_code) == ("Land", "State", 900, 3.5, -1, None)
    five = got["5"]
    assert (five.name, five.level, five.parent_code, five.pop_latest, five.last_census_year, five.area_km2, five.url) == ("A & B", 2, "cc", 1000, 2001, 1234.5, "https://pages.example#i5")
    assert (got["77"].level, got["77"].parent_code, got["77"].entity_type, got["77"].pop_latest, got["77"].url) == (3, "5", "Town", 4, "https://pages.example/t/")


def test_admin_without_root(spark):
    html = f"<table id=tl>{HEAD}<tbody class=admin1><tr><td class=rname id=i5>A</tr></tbody></table>"
    assert read(spark, "admin", html, 0)["5"].parent_code == "cc"
    assert read(spark, "admin", html, 1)["5"].parent_code is None


def test_table_root_of_header_and_foot(spark):
    header = "<header class='cpage'><h1>  Big   Land </h1><p itemprop=description>Free State of Big Land</p></header>"
    rows = "<h2>Contents: Provinces and Cities</h2><table id=tl>" + HEAD + "<tbody><tr><td class=rname id=i1>P<td class=rarea>250</tr></tbody>{}</table>"
    got = read(spark, "table", header + rows.format(""))
    assert (got["cc"].name, got["cc"].entity_type, got["1"].parent_code, got["1"].level, got["1"].area_km2, got["1"].entity_type) == ("Big Land", "Free State", "cc", 2, 2.5, "Provinces and City")
    got = read(spark, "table", header + rows.format("<tfoot><tr><td class=rname id=iF>Foot<td class=rpop>9<td class=rpop>8</tr></tfoot>"))
    assert set(got) == {"F", "1"} and (got["F"].parent_code, got["F"].entity_type, got["F"].pop_latest, got["1"].parent_code) == ("cc", "Free State", 8, "F")


def test_double_cities_infosection(spark):
    tables = f"<table id=tl>{HEAD}<tbody><tr><td class=rname id=i1>Old  Town</tr></tbody></table><table id=ts>{HEAD}<tbody><tr><td class=rname id=i2>a<td class=radm>old town</tr><tr><td class=rname id=i3>b<td class=radm data-admid=9>x<td class=noviz>150</tr><tr><td>no name</tr></tbody></table>"
    got = read(spark, "double", tables)
    assert {c: (r.level, r.parent_code) for c, r in got.items()} == {"1": (1, "cc"), "2": (2, "1"), "3": (2, "9")} and got["3"].area_km2 == 1.5
    assert {c: (r.level, r.parent_code) for c, r in read(spark, "cities", SECTION + tables).items()} == {"cc": (1, None), "1": (2, "cc"), "2": (3, "1"), "3": (3, "9")}
    assert set(read(spark, "infosection", SECTION + tables)) == {"cc"}


def test_odd_pages(spark):
    assert read(spark, "admin", None) == {} and read(spark, "double", "") == {} and read(spark, "table", "<table id=tl><tr><td>") == {}
    with pytest.raises(Exception, match="unknown layout"):
        read(spark, "other", "")


def test_configurations(spark, tmp_path):
    (tmp_path / "xa.toml").write_text('country_code = "x"\n[[pages]]\nsource = "admin"\npath = ["a", "/xa/b/", ""]\n[[cities]]\ncity = "C"\nid = 7\nlevel = 2\ntype = "City"\nfrom = { 1 = ["P"] }\n[representation]\nlevel = 2\nsystem = "dhondt"\ntotal = 9\n')
    (tmp_path / "_skip.toml").write_text("not toml")
    pages, cities, seats = configs.configurations(spark, str(tmp_path))
    assert [(r.path, r.lowest_level, r.country_code) for r in pages.orderBy("place").collect()] == [("xa/a", 1, "x"), ("xa/b", 1, "x"), ("xa", 1, "x")]
    assert (cities.first().city, cities.first().parent_from, seats.first().total) == ("7", {1: ["P"]}, 9)
    for bad in ("name = 'x'\n", '[[pages]]\nsource = "zz"\npath = "a"\n', '[[pages]]\nsource = "admin"\npath = "a"\n[representation]\nlevel = 1\nsystem = "dhondt"\n'):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError):
            configs.configurations(spark, str(tmp_path))


def test_links_as_browsers_read_them(spark):
    import itertools
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from cartulary.sources.layouts import joined_url

    bases = ["https://a.example/b/c/d", "https://a.example/b/c/", "https://a.example/b?x=1/2#f", "https://a.example"]
    parts = ["..", ".", "g", "h..", ".i"]
    links = ["/".join(p) + end for n in (1, 2, 3) for p in itertools.product(parts, repeat=n) for end in ("", "/")]
    links += ["/" + link for link in links[:40]] + ["../../../g", "/./g", "g?y/../x", "g#s/../x", "?q=../z", "#top", "//h.example/a/../b", "http://o.example/a/../b"]
    rows = spark.createDataFrame([(b, link) for b in bases for link in links], "b string, h string")
    same = [(r.b, r.h, r.u) for r in rows.select("b", "h", joined_url(F.col("b"), F.col("h")).alias("u")).collect() if "h.example/a" not in r.h and "o.example" not in r.h]
    assert [(b, h, u) for b, h, u in same if u != urljoin(b, h)] == []
    got = {r.h: r.u for r in rows.where("h LIKE '%example%'").select("h", joined_url(F.col("b"), F.col("h")).alias("u")).collect()}
    assert got["http://o.example/a/../b"] == "http://o.example/a/../b" and got["//h.example/a/../b"] == "https://h.example/a/../b"
