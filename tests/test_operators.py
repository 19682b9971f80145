"""Rules of the label, city, code, merge and output operators on small trees."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import changes, cities, hierarchy, labels, seats, territory
from cartulary.plans.catalogue import QUERIES

AREAS = "id string, code string, name string, level int, parent_id string, entity_type string, pop_latest long, a string"


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        ("x", "x", "Land", 0, None, "Country", 100, "9.00"), ("x1", "A", "Málaga", 1, "x", "Region", 60, "5.00"), ("x2", "B", "Malaga Alta", 1, "x", "Region", 40, None),
        ("x11", "A1", "Uno", 2, "x1", "Town", None, None), ("x12", "A2", "Dos", 2, "x1", "Town", 7, "1.25"), ("x13", "A-3", "Tres", 2, "x1", "Town", 5, "2.25"), ("x131", "Q", "Barrio", 3, "x13", "Ward", 2, None),
    ]
    return spark.createDataFrame(rows, AREAS).selectExpr("*", "CAST(a AS decimal(12,2)) AS area_km2").drop("a")


def test_label_tiers(spark, tree):
    want = {"x1": ("x1", 1), "a1": ("x11", 2), "DOS": ("x12", 3), " a2 ": ("x12", 4), "malaga": ("x1", 5), "ALAG": ("x1", 6), "arr": ("x131", 6), "-": ("x13", 7)}
    asked = spark.createDataFrame([(k,) for k in [*want, "x1", "none", "", "  ", None]], "label string")
    assert {r.label: (r.id, r.tier) for r in labels.resolve(asked, tree).collect()} == want
    assert {r.label for r in labels.missing(asked, tree).collect()} == {"none", "", "  "}
    assert labels.resolve(asked.limit(0), tree).count() == 0 and labels.resolve(asked, tree.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["label_missing", "label_resolve_tiers"])
def test_labels_and_areas_are_not_broadcast(spark, name):
    """Files of a million areas are under Spark's threshold, which measures them compressed; their hash tables fill the driver."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line]
    assert all("[gram#" in line for line in joins) and "SortMergeJoin" in plan


def test_overrides(spark, tree):
    given = spark.createDataFrame([("MALAGA", 5), ("x1", 3), ("x1", 2), ("b", 8), (None, 1)], "key string, value int")
    got = {r.id: r.value for r in labels.overridden(tree, given, F.lit(0)).collect()}
    assert (got["x1"], got["x2"], got["x11"], len(got)) == (2, 8, 0, 7)


def test_longest_prefix(spark):
    entities = spark.createDataFrame([(1, "abc", 3), (2, "abd", 1), (3, "", 3), (4, None, 3), (5, "zz", 3)], "id int, code string, level int")
    parents = spark.createDataFrame([("a", 0), ("ab", 2), ("abc", 3), ("", 0)], "code string, level int")
    assert {r.id: r.parent for r in labels.longest_prefix(entities, parents).collect()} == {1: "ab", 2: "a"}


def test_city(spark, tree):
    communes = spark.createDataFrame([("c", "x12"), ("c", "x13"), ("c", "x13")], "city string, id string")
    city = spark.createDataFrame([("c", "City", 2, "x1", "City")], "city string, name string, level int, parent_id string, entity_type string")
    got = {r.id: r for r in cities.rewritten(tree, communes, city).collect()}
    assert len(got) == 8 and (got["c"]["pop_latest"], float(got["c"]["area_km2"])) == (12, 3.5)
    assert [(got[i].level, got[i].parent_id) for i in ("x11", "x12", "x13", "x131")] == [(2, "x1"), (3, "c"), (3, "c"), (4, "x13")]
    again = {r.id for r in cities.rewritten(tree.withColumn("id", F.when(F.col("id") == "x11", "c").otherwise(F.col("id"))), communes, city).collect()}
    assert len(again) == 7


def test_codes(tree):
    got = {r.id: r.full_code for r in hierarchy.full_codes(tree).collect()}
    assert got == {"x": "x", "x1": "A", "x2": "B", "x11": "A-A1", "x12": "A-A2", "x13": "A-3", "x131": "A-3-Q"}
    same = tree.withColumn("code", F.when(F.col("level") == 2, F.lit("T")).otherwise(F.col("code")))
    assert [tuple(r) for r in hierarchy.duplicate_codes(same).collect()] == [("A-T", 3)]


def test_merge_and_csv(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "d"), (4, "é;")], "k int, v string")
    got = changes.merged(old, new, "k")
    assert {tuple(r) for r in got.collect()} == {(1, "a", "absent"), (2, None, "kept"), (3, "d", "updated"), (4, "é;", "created")}
    assert {r.k for r in changes.without_missing(old, new, "k").collect()} == {2, 3}
    changes.write_csv(got, str(tmp_path / "out"), "k")
    back = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", "a", "absent"), ("2", None, "kept"), ("3", "d", "updated"), ("4", "é;", "created")]


def test_folding():
    import unicodedata

    from cartulary.functions import text

    for c, plain in {**dict(zip(text._ONE, text._TO, strict=True)), **text._MANY}.items():
        assert plain == "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def test_text_of_hostile_inputs(spark):
    from cartulary.functions import text

    words = {"Şırnak Čačak Łódź": "sırnak cacak łodz", "  Málaga   Ciudad ": "malaga ciudad", "ﬁ ½ Ⅷ №": "fi 1⁄2 viii no", "é̂ İzmir": "e izmir", None: None, "": ""}
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.normalised(F.col("t")).alias("n"), text.slug(F.col("t")).alias("s"), text.casefolded(F.concat("t", F.lit("ß"))).alias("c"))
    got = {r.t: r for r in df.collect()}
    assert {t: r.n for t, r in got.items()} == words
    assert got["Şırnak Čačak Łódź"].s == "s-rnak-cacak-od" or got["Şırnak Čačak Łódź"].s == "s-rnak-cacak-odz" and got["  Málaga   Ciudad "].c == "malaga ciudad ss"
    numbers = {"1,234,567": 1234567, "1,141,748 km²": 1141748, "12.345.678,9": 12345678.9, "12,345,678.9": 12345678.9, "1,23": 1.23, "1,2345": 1.2345, "1.234.567": None, "-": None, ",": None, "-1,500": -1500, "": None, None: None}
    found = spark.createDataFrame([(w,) for w in numbers], "t string").select("t", text.locale_number(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in found} == numbers


def test_dhondt_ties_caps_and_zero(spark):
    """Seat by seat against the plain algorithm: ties, minima, maxima, populations of 0, more seats than maxima allow."""
    import random

    rng = random.Random(2)
    groups, rows = {}, []
    for g in range(40):
        areas = [(f"a{i:02}", rng.choice([0, 0, 50, 100, 100, 300, rng.randint(0, 10**6)]), rng.choice([0, 1, 2]), rng.choice([None, 0, 1, 3, 5, 100])) for i in range(rng.randint(1, 9))]
        total = sum(low for _, _, low, _ in areas) + rng.choice([0, 1, 7, 40, 400])
        won = {code: low for code, _, low, _ in areas}
        for _ in range(total - sum(won.values())):
            able = [(-pop / (won[code] + 1), code) for code, pop, _, high in areas if high is None or won[code] < high]
            if not able:
                break
            won[min(able)[1]] += 1
        groups[g] = won
        rows += [(g, code, pop, low, high, total) for code, pop, low, high in areas]
    df = spark.createDataFrame(rows, "g int, code string, pop_latest long, low int, high int, total int")
    got = {}
    for r in seats.dhondt(df, "g", F.col("total"), F.col("low"), F.col("high")).collect():
        got.setdefault(r.g, {})[r.code] = r.seats
    assert got == groups


def test_ranks_by_ranges(spark):
    """Places within a group over many ranges, ties by id, null groups."""
    from cartulary.operators.ranking import ranked

    rows = [(None if i % 7 == 0 else i % 3, i % 50, i) for i in range(1000)]
    got = ranked(spark.createDataFrame(rows, "g int, v int, id int").repartition(5), "g", [F.col("v").desc(), F.col("id")], "r").collect()
    want = {}
    for g in (None, 0, 1, 2):
        want |= {i: k for k, (_, i) in enumerate(sorted((-v, i) for x, v, i in rows if x == g), start=1)}
    assert {r.id: r.r for r in got} == want


def test_roll_up_of_nested_containers(spark):
    rows = [("t", None, True, None), ("s", "t", True, 99), ("p", "s", True, None), ("a", "p", False, 3), ("b", "s", False, 4), ("c", "b", False, 100), ("d", "p", False, None)]
    df = spark.createDataFrame(rows, "id string, parent_id string, container boolean, pop_latest long").selectExpr("*", "CAST(1 AS decimal(12,2)) AS area_km2")
    assert {r.id: r.pop for r in hierarchy.rolled_up(df, "container").collect()} == {"t": 7, "s": 7, "p": 3}


def test_areas_below_the_atomic_level_fail(spark):
    import pytest

    tree = spark.createDataFrame([("x", None, 0), ("a", "x", 1), ("b", "a", 2)], "id string, parent_id string, level int")
    spec = spark.createDataFrame([("t", "b", "include")], "territory string, id string, sign string")
    with pytest.raises(Exception, match="below the atomic level"):
        territory.members(spec, tree, 1).collect()


def test_export_parts(spark, tmp_path):
    from datetime import datetime

    from cartulary.operators import export

    rows = spark.createDataFrame([(i, f"é{i}" if i % 2 else None) for i in range(25)], "n int, t string")
    path = export.write_export(rows, str(tmp_path), "spain", datetime(2024, 2, 3, 4, 5, 6), ["n"], rows=10)
    assert path == f"{tmp_path}/spain_20240203_040506.csv"
    files = sorted(f for f in (tmp_path / "spain_20240203_040506.csv").iterdir() if f.name.startswith("part-"))
    lines = [f.read_text(encoding="utf-8").splitlines() for f in files]
    assert all(part[0] == "n;t" and len(part) <= 11 for part in lines) and [line for part in lines for line in part[1:]] == [f"{i};é{i}" if i % 2 else f"{i};" for i in range(25)]


def test_members_equal_brute_force(spark):
    """On trees whose levels skip, with areas chosen inside others; no member is made twice or sorted to find that out."""
    rng = random.Random(4)
    nodes = [("a0", 0, None)]
    for i in range(1, 60):
        up = rng.choice([n for n in nodes if n[1] < 4])
        nodes.append((f"a{i}", min(4, up[1] + rng.choice([1, 1, 1, 2])), up[0]))
    pop = {n[0]: rng.randint(1, 9) for n in nodes}
    parent, level = {n[0]: n[2] for n in nodes}, {n[0]: n[1] for n in nodes}
    areas = spark.createDataFrame([(*n, pop[n[0]]) for n in nodes], "id string, level int, parent_id string, pop_latest long").withColumn("area_km2", F.lit(None).cast("decimal(12,2)"))
    rows = {(f"t{rng.randint(0, 5)}", rng.choice([n[0] for n in nodes if n[1] <= 3]), rng.choice(["include", "subtract"])) for _ in range(80)}
    spec = spark.createDataFrame(sorted(rows), "territory string, id string, sign string")

    def above(n, hops):
        for _ in range(hops):
            n = parent.get(n)
        return n

    grown = {s: {(t, n) for t, i, sign in rows if sign == s for n in level if above(n, 3 - level[i]) == i} for s in ("include", "subtract")}
    want = grown["include"] - grown["subtract"]
    got = territory.members(spec, areas, 3)
    assert sorted((r.territory, r.node) for r in got.collect()) == sorted(want)
    assert "keys=[territory" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "node#" in x.split("functions=")[0])
    asked = spark.createDataFrame([(f"t{t}", n) for t in range(6) for n in level], "territory string, node string")
    assert sorted((r.territory, r.node) for r in territory.members_among(asked, spec, areas, 3).collect()) == sorted(want)
    sums = {t: sum(pop[i] for x, i, s in rows if (x, s) == (t, "include")) - sum(pop[n] for x, n in grown["subtract"] if x == t) for t, _, _ in rows}
    assert {r.territory: r["pop"] for r in territory.totals(spec, areas, 3).collect()} == sums


def test_members_held_without_a_row_each(spark):
    """Thirty territories of one country less some areas: tables grow with areas and specifications, not their product."""
    leaves = [(f"l{i:02}", 2, f"r{i % 4}", 100 - i) for i in range(40)]
    areas = spark.createDataFrame([("w", 0, None, None), *((f"r{i}", 1, "w", None) for i in range(4)), *leaves], "id string, level int, parent_id string, pop_latest long")
    less = {f"t{t}": {f"l{i:02}" for i in (range(0, 40, 4) if t == 0 else range(t % 5))} for t in range(30)}
    rows = [(t, "w", "include") for t in less] + [(t, n, "subtract") for t, some in less.items() for n in some]
    own = territory.held(spark.createDataFrame(rows, "territory string, id string, sign string"), areas, 2)
    assert (own.parts.count(), own.nodes.count(), own.gone.count()) == (30, 40, len(rows) - 30)
    members = {t: {x[0] for x in leaves} - some for t, some in less.items()}
    assert {r.territory: r.most_populated for r in territory.largest_member(own, areas).collect()} == {t: min(m) for t, m in members.items()}
    asked = [(t, i) for t in ("t0", "t1", "t4") for i in ("w", "r0", "r1", "l00", "l03", "l04")]
    inside = {x[0]: {x[0], x[2], "w"} for x in leaves}
    want = sorted((t, i) for t, i in asked if any(i in inside[n] for n in members[t]))
    assert sorted((r.territory, r.id) for r in territory.holding(spark.createDataFrame(asked, "territory string, id string"), own, areas).collect()) == want
