"""Whole programs: versions of tables, pages fetched, areas saved in order, recipes and derived countries."""

import json
import os
import random
import subprocess
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from cartulary.operators import city_program, derive, scraping
from cartulary.sources import configs, fetching, recipes
from cartulary.sources.configs import page_url
from cartulary.sources.versions import Conflict, Versions

# versions


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_change_together(spark, tmp_path):
    tables = Versions(spark, f"file://{tmp_path}/v")
    assert tables.number() == 0 and tables.folders() == {}
    with tables.transaction() as change:
        change.write("areas", spark.range(3))
        change.write("links", spark.range(5))
    with tables.transaction() as change:
        change.write("areas", change.read("areas").where("id > 0"))
        assert ids(tables.read("areas")) == [0, 1, 2] and ids(change.read("areas")) == [1, 2] and ids(change.read("links")) == [0, 1, 2, 3, 4]
    assert ids(tables.read("areas")) == [1, 2] and ids(tables.read("areas", 1)) == [0, 1, 2] and ids(tables.read("links")) == [0, 1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError), tables.transaction() as change:
        change.write("areas", spark.range(9))
        raise ZeroDivisionError
    assert tables.number() == 2 and ids(tables.read("areas")) == [1, 2]
    assert tables.cleared() == 2 and ids(tables.read("areas")) == [1, 2] and ids(tables.read("links")) == [0, 1, 2, 3, 4]


def test_two_runs_at_once_conflict(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(Conflict), tables.transaction() as late:
        late.write("areas", spark.range(1))
        with tables.transaction() as soon:
            soon.write("areas", spark.range(2))
    assert tables.number() == 1 and ids(tables.read("areas")) == [0, 1]


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from cartulary.sources.versions import Versions
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
with Versions(spark, sys.argv[1]).transaction() as change:
    change.write("areas", spark.range(7))
    os.kill(os.getpid(), 9)
    change.write("links", spark.range(7))
"""


def test_a_killed_run_leaves_the_old_version(spark, tmp_path):
    tables = Versions(spark, str(tmp_path / "v"))
    with tables.transaction() as change:
        change.write("areas", spark.range(3))
        change.write("links", spark.range(3))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path / "v")], env=os.environ | {"PYTHONPATH": root}, timeout=120, capture_output=True)
    assert run.returncode == -9
    staged = list((tmp_path / "v/data/areas").iterdir())
    assert len(staged) == 2 and tables.number() == 1
    assert ids(tables.read("areas")) == [0, 1, 2] and ids(tables.read("links")) == [0, 1, 2]


# pages


class Site(BaseHTTPRequestHandler):
    asked = {}

    def do_GET(self):
        n = self.asked[self.path] = self.asked.get(self.path, 0) + 1
        body = {"/human": "Check for Humans", "/script": "please enable JavaScript, says Cloudflare", "/half": "enable JavaScript"}.get(self.path, "fine é")
        code = {"/absent": 404, "/refused": 403, "/broken": 500}.get(self.path, 500 if self.path == "/once" and n == 1 else 200)
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


def test_pages_are_fetched(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    (tmp_path / "page").write_text("from a file é")
    names = ["/ok", "/absent", "/refused", "/broken", "/once", "/human", "/script", "/half"]
    urls = [base + n for n in names] + [f"file://{tmp_path}/page", f"file://{tmp_path}/none", "http://127.0.0.1:1/", "odd://x"]
    rows = {r.url.removeprefix(base): r for r in fetching.fetched(spark, urls, pages="3", pause="0.01").collect()}
    server.shutdown()
    assert len(rows) == len(urls)
    status = {n: (rows[n].status, rows[n].attempts) for n in names}
    assert status == {"/ok": ("ok", 1), "/absent": ("missing", 1), "/refused": ("blocked", 2), "/broken": ("failed", 2), "/once": ("ok", 2), "/human": ("blocked", 2), "/script": ("blocked", 2), "/half": ("ok", 1)}
    assert rows["/ok"].html == "fine é" and rows["/refused"].html is None and rows["/broken"].error == "status 500"
    file, none, dead, odd = (rows[u] for u in urls[-4:])
    assert (file.status, file.html) == ("ok", "from a file é") and (none.status, none.attempts) == ("missing", 1)
    assert (dead.status, dead.code, dead.attempts) == ("failed", None, 2) and dead.error and odd.status == "failed"
    assert fetching.fetched(spark, []).collect() == []


def test_pages_stand_in_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/one.html").write_text("é")
    urls = spark.createDataFrame([("u1", "b/one.html"), ("u2", "b/two.html")], "url string, file string")
    got = {r.url: (r.code, r.html) for r in fetching.stored(spark, urls, f"file://{tmp_path}/a").collect()}
    assert got == {"u1": (200, "é"), "u2": (404, None)}


def test_page_urls(spark):
    rows = spark.createDataFrame([("https://x.example/", "/a/b/"), ("https://x.example", "a"), ("https://x.example", "https://y.example/q//")], "base string, path string")
    assert [r[0] for r in rows.select(page_url(F.col("base"), F.col("path"))).collect()] == ["https://x.example/a/b/", "https://x.example/a/", "https://y.example/q/"]


# saving


def saved_one_by_one(new, old):
    known, out = {(c, k) for c, k in old}, {}
    for country, code, level, parent, place in sorted(new, key=lambda a: (a[2], a[4])):
        out[f"{country}_{code}"] = f"{country}_{parent}" if parent is not None and (country, parent) in known else None
        known.add((country, code))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_parents_are_those_saved_before(spark, seed):
    rng = random.Random(seed)
    new = [(f"g{i % 2}", f"a{i}", rng.randint(0, 4), rng.choice([None, "gone", *(f"a{j}" for j in range(60)), "o1"]), place) for i, place in zip(range(60), rng.sample(range(99), 60), strict=True)]
    old = [("g0", "o1"), ("g1", "a3"), ("g1", "a9"), ("g0", "a8"), ("other", "o1")]
    a = spark.createDataFrame(new, "country_code string, code string, level int, parent_code string, ordinal int")
    b = spark.createDataFrame([(f"{c}_{k}", c, k) for c, k in old], "id string, country_code string, code string")
    assert {r.id: r.parent_id for r in scraping.with_parents(a, b).collect()} == saved_one_by_one(new, old)


def test_links_to_deleted_areas_become_null(spark):
    none = {c: F.lit(None).cast("string") for c in (*scraping.SET, *scraping.LEFT)}
    fill = lambda df: df.withColumns({c: v for c, v in none.items() if c not in df.columns})
    old = fill(spark.createDataFrame([("g_a", "g", "a", None, "g_z", 5), ("g_z", "g", "z", "g_a", None, 1), ("h_q", "h", "q", None, "h_q", 2)], "id string, country_code string, code string, parent_id string, most_populated string, representatives long"))
    new = fill(spark.createDataFrame([("g", "a", 0, "z", 0), ("g", "b", 1, "a", 1)], "country_code string, code string, level int, parent_code string, ordinal int")).drop("parent_id")
    got = {r.id: (r.parent_id, r.most_populated, r.representatives, r.status) for r in scraping.saved(new, old.withColumn("level", F.lit(0))).collect()}
    assert got == {"g_a": (None, None, 5, "updated"), "g_b": ("g_a", None, None, "created"), "g_z": ("g_a", None, 1, "deleted"), "h_q": (None, "h_q", 2, "untouched")}


# recipes and derived countries


def recipe_table(spark, **countries):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in countries.items()], "country string, recipe string")


@pytest.fixture(scope="module")
def places(spark):
    rows = [("x", "x", "X", 0, None, 460, None), ("x_A", "A", "Alpha", 1, "x", 410, "30.00"), ("x_B", "B", "Beta", 1, "x", 50, None), ("x_A1", "A1", "Ánnex", 2, "x_A", 100, "10.00"), ("x_A2", "A2", "Alpha", 2, "x_A", 300, "20.00"), ("x_B1", "B1", "Bay", 2, "x_B", None, "5.00"), ("x_B2", "B2", "Bog", 2, "x_B", 50, None)]
    df = spark.createDataFrame([("x", *r) for r in rows] + [("y", "y_1", "1", "Odd", 1, None, 7, "1.00")], "source string, id string, code string, name string, level int, parent_id string, pop_latest long, a string")
    return df.withColumn("area_km2", F.col("a").cast("decimal(12,2)")).drop("a")


def test_recipes_of_any_depth(spark):
    five = {"name": "e", "childs": [{"name": "f", "spec": {}}]}
    deep = {"name": "a", "code": "A", "childs": [{"name": "b", "code": "A-B", "childs": [{"name": "c", "childs": [{"name": "d", "level": 2, "childs": [five]}]}]}, {"name": "s", "capital": "K", "capitals": [], "dat": {"2": "one", "1": {"y": ["p", 7]}}}]}
    table = recipe_table(spark, spain_x={"DIVISIONS": [deep, {"name": "t", "spec": {"3": {"z": ["q"]}, "restar": {"1": {"z": "r"}}}}]}, plain={"SOURCE_COUNTRY": "src"}, none="{")
    rows = {r.code: r for r in recipes.nodes(table).collect()}
    assert list(rows) and {c: (r.level, r.kind, list(r.path)) for c, r in rows.items()} == {"A": (1, "container", [0]), "t": (1, "spec", [1]), "A-B": (2, "container", [0, 0]), "A-s": (2, "spec", [0, 1]), "A-B-c": (3, "container", [0, 0, 0]), "A-B-c-d": (2, "container", [0, 0, 0, 0]), "A-B-c-d-e": (3, "deeper", [0, 0, 0, 0, 0])}
    assert rows["A-s"].capitals == ["K"] and rows["A-s"].entity_type == "Subdivision" and rows["A"].source == "spain"
    got = {(r.code, r.sign, r.level, r.source, r.label) for r in recipes.labels(recipes.nodes(table)).collect()}
    assert got == {("A-s", "include", 2, "spain", "one"), ("A-s", "include", 1, "y", "p"), ("A-s", "include", 1, "y", "7"), ("t", "include", 3, "z", "q"), ("t", "subtract", 1, "z", "r")}
    assert {(r.country, r.code, r.rule) for r in recipes.violations(table).collect()} == {("spain_x", "A-B-c-d-e", "nested too deep"), ("none", None, "not JSON")}


def test_all_violations_come_at_once(spark):
    table = recipe_table(spark, bad={"DIVISIONS": ["text", {"code": "N"}, {"name": "a", "dat": [1]}, {"name": "b", "level": 9}, {"name": "c", "spec": "s"}, {"name": "a"}, {"name": "f", "forced_area_km2": "x", "spec": {"one": {"x": "A"}}}]}, good={"DIVISIONS": []})
    assert sorted((r.rule, r.path) for r in recipes.violations(table).collect()) == [("code is not unique", [2]), ("dat is not an object", [2]), ("level is no number", [6]), ("level out of range", [3]), ("no area", [6]), ("no name", [0]), ("no name", [1]), ("not an object", [0]), ("spec is not an object", [4])]


def test_older_seat_rules(spark):
    table = recipe_table(spark, a={"ESCANHOS": [{"nivel": 2, "escanhos": 100, "min": 1}]}, b={"REPRESENTATION": {"level": 1, "habitant": 5, "system": "dhondt"}, "ESCANHOS": {"nivel": 9}}, c={})
    assert {r.country: (r.level, r.total, r.minimum, r.habitant, r.system) for r in recipes.seat_rules(table).collect()} == {"a": (2, 100, 1, None, "dhondt"), "b": (1, None, 0, 5, "dhondt")}


def built(spark, places, table):
    atomic = spark.createDataFrame([("x", 2)], "source string, atomic int")
    return derive.derived(table, places, atomic, spark.createDataFrame([("x", 1)], "source string, legal_level int"))


def test_derived_countries(spark, places):
    t1 = {"name": "one", "code": "P-ONE", "capitals": ["alpha", "bog"], "spec": {"1": {"x": ["A"]}, "2": {"x": "B2"}, "restar": {"2": {"x": ["annex"]}}}}
    t2 = {"name": "two", "forced_area_km2": 1.005, "capital": "BETA", "auto_set_most_populated": False, "spec": {"1": {"x": "Beta"}, "restar": {"2": {"x": ["B1", "B2"]}}}}
    out = built(spark, places, recipe_table(spark, land={"SOURCE_COUNTRY": "x", "DIVISIONS": [{"name": "p", "code": "P", "childs": [t1, t2]}]}))
    assert out.violations.collect() == []
    rows = {r.id: (r.parent_id, r.level, r.pop_latest, None if r.area_km2 is None else str(r.area_km2), r.capitals, r.most_populated) for r in out.tree.collect()}
    assert rows["land-P-ONE"] == ("land-P", 2, 360, "20.00", ["x_A", "x_B2"], "x_A2")  # alpha: at the legal level, its members below
    assert rows["land-P-two"] == ("land-P", 2, 0, "1.01", ["x_B"], None)  # nothing is left of it: a macro area is the capital
    assert rows["land-P"][:4] == ("land", 1, 360, "21.01") and rows["land"][:3] == (None, 0, 360)
    assert sorted((r.territory, r.id) for r in out.members.collect()) == [("land-P-ONE", "x_A2"), ("land-P-ONE", "x_B2")]


def test_derived_violations(spark, places):
    one = lambda **node: {"SOURCE_COUNTRY": "x", "DIVISIONS": [{"name": "n", **node}, {"name": "good", "dat": {"2": "A1"}}]}
    table = recipe_table(spark, a=one(dat={"2": ["A1", "nowhere", "neither"]}), b=one(dat={"1": {"y": "Odd"}}), c=one(dat={"2": "A1"}, capitals=["Bog"]), d=one(spec={}), e=one(dat={"2": "A1"}))
    deeper = places.unionByName(places.where("id = 'x_A1'").withColumns({"id": F.lit("x_A1x"), "level": F.lit(3), "name": F.lit("below")}))
    table = table.union(recipe_table(spark, f=one(dat={"3": "below"})))
    out = built(spark, deeper, table)
    assert sorted((r.country, r.code, r.rule, r.label) for r in out.violations.collect()) == [("a", "n", "no area of this label", "neither"), ("a", "n", "no area of this label", "nowhere"), ("b", "n", "no atomic level", "Odd"), ("c", "n", "capital outside the territory", "Bog"), ("d", "n", "no units", None), ("f", "n", "below the atomic level", "below")]
    assert sorted({r.country for r in out.tree.collect()}) == ["e"]


# configured cities


def test_fifty_configurations_are_one_layer(spark):
    areas = spark.createDataFrame([("t", "Top", 0, None)] + [(f"n{i}", f"N{i}", 1, "t") for i in range(50)] + [(f"l{i}", f"L{i}", 2, f"n{i % 50}") for i in range(150)], "id string, name string, level int, parent_id string")
    none = {"entity_type": "string", "pop_latest": "long", "area_km2": "decimal(12,2)", "pop_latest_date": "date", "last_census_year": "int"}
    areas = areas.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"code": F.col("id"), "ordinal": F.col("level").cast("long")})
    table = spark.createDataFrame([(i, f"c{i}", f"C{i}", 2, "City", [], {1: [f"N{i}"]}, []) for i in range(50)], "place long, city string, name string, level int, entity_type string, district_types array<string>, parent_from map<int,array<string>>, communes array<string>")
    assert len(city_program.layers(areas, table)) == 1
    out, bad = city_program.applied(areas, table)
    assert bad.collect() == [] and {r.id: r.parent_id for r in out.where("level = 3").collect()} == {f"l{i}": f"c{i % 50}" for i in range(150)}


def test_codes_place_what_has_no_parent(spark):
    areas = spark.createDataFrame([("t", 0, None), ("t1", 1, "t"), ("t11", 2, "t1"), ("t1101", 3, None), ("t1201", 3, None)], "id string, level int, parent_id string")
    none = {"entity_type": "string", "pop_latest": "long", "area_km2": "decimal(12,2)", "pop_latest_date": "date", "last_census_year": "int"}
    areas = areas.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"code": F.col("id"), "name": F.col("id"), "ordinal": F.col("level").cast("long")})
    table = spark.createDataFrame([(0, "m", "M", 2, "City", [], {1: ["t1"]}, [])], "place long, city string, name string, level int, entity_type string, district_types array<string>, parent_from map<int,array<string>>, communes array<string>")
    out, _ = city_program.applied(areas, table)
    assert {r.id: (r.level, r.parent_id) for r in out.collect()} == {"t": (0, None), "t1": (1, "t"), "m": (2, "t1"), "t11": (3, "m"), "t1101": (4, "t11"), "t1201": (3, None)}


# configurations


def test_configurations_are_checked_as_a_whole(spark, tmp_path):
    files = {
        "good": '[[pages]]\nsource = "admin"\npath = ["a", "/good/b/", "https://x.example/c"]\n[[cities]]\nid = "m"\ncity = "M"\nlevel = 2\ntype = "City"\nfrom = { 1 = "A" }\n[representation]\nlevel = 2\nsystem = "dhondt"\ntotal = 9\n',
        "bad": '[[pages]]\nsource = "mosaic"\nlowest_level = 7\n[[pages]]\nsource = "table"\npath = []\n[[cities]]\nid = "m"\nlevel = 9\nfrom = ["x"]\n[[cities]]\nid = "m"\ncity = "M"\nlevel = 1\ntype = "T"\nfrom = { one = "x" }\n[representation]\nlevel = 1\nsystem = "other"\ntotal = 1\nhabitant = 0\n',
        "broken": "[[pages",
        "_left": "x = 1",
        "none": "",
        "few": "x = 1",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.toml").write_text(text)
    report, bad = configs.checked(spark, str(tmp_path))
    assert {tuple(r) for r in report.collect()} == {("good", True, 3, 1, True), ("bad", False, 0, 2, True), ("broken", False, 0, 0, False), ("few", False, 0, 0, False)}
    assert sorted((r.slug, r.place, r.rule) for r in bad.collect()) == sorted(
        [("bad", "cities[0]", r) for r in ("a city without city", "a city without type", "from maps no levels to labels", "level out of range")]
        + [("bad", "cities[1]", "level is no number"), ("bad", "m", "two cities of one id"), ("bad", "pages[0]", "a page without a path"), ("bad", "pages[0]", "level out of range"), ("bad", "pages[0]", "unknown page layout"), ("bad", "pages[1]", "no path in a list of paths")]
        + [("bad", "representation", r) for r in ("inhabitants for a seat must be more than none", "seats need either a total or a number of inhabitants", "unknown seat system")]
        + [("broken", "", "not TOML"), ("few", "pages", "no pages")]
    )
    pages, cities, seats = configs.configurations(spark, str(tmp_path), skip=True)
    assert [(r.place, r.url) for r in configs.plan(pages, "https://y.example/").collect()] == [(0, "https://y.example/good/a/"), (1, "https://y.example/good/b/"), (2, "https://x.example/c/")]
    assert cities.count() == seats.count() == 1
    with pytest.raises(ValueError, match="broken|bad"):
        configs.configurations(spark, str(tmp_path))
