"""Search, vector codes and URL filters against brute force on random and odd tables, and the given tables against SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import codes, entries, search, urls

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_block_max_search", "op12_vector_codes", "op13_url_verdicts"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = entries.QUERIES[name](spark, SF).toPandas(), con.sql(entries.ORACLES[name]).df()
    columns, key = sorted(want.columns), list(want.columns[:2])
    assert sorted(got.columns) == columns and len(got) == len(want) > 0
    plain = [f[columns].sort_values(key).astype(object).where(f[columns].sort_values(key).notna(), None).to_numpy().tolist() for f in (got, want)]
    assert plain[0] == plain[1]


# search


def terms(text):
    return re.findall(search.TERM, (text or "").translate(LOWER))


def best_by_brute_force(docs, items, top):
    held = [(key, Counter(terms(text)), len(terms(text))) for key, text in docs]
    held = [h for h in held if h[2]]
    n, size = len(held), sum(h[2] for h in held)
    df = Counter(t for _, own, _ in held for t in own)
    asked, out = defaultdict(set), {}
    for item, text in items:
        asked[item].update(terms(text))
    for item, wanted in asked.items():
        scores = []
        for key, own, k in held:
            m = 10 + 90 * k * n // size
            scores.append((sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in wanted if t in own), key))
        scores = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:top]
        out |= {(item, i): (key, score) for i, (score, key) in enumerate(scores, 1)}
    return out


def found(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def test_search_equals_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 200])))) for i in range(300)]
    docs += [(i + 300, docs[i][1].upper()) for i in range(60)] + [(None, "w1 w2"), (None, "w1 w2"), (7, docs[7][1])]
    docs += [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))) for i in range(25)] + [(3, "w5 w6"), (None, "W1"), (90, None), (91, " - "), (92, "le CHAT est; a1a1 é ß"), (93, "nowhere")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("row", F.lit("x")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("y"))
    want = best_by_brute_force(docs, items, 10)
    assert found(search.search(table, asked)) == want
    assert found(search.search(table, asked, most=40)) == want  # slices of items
    monkeypatch.setattr(search, "CELLS", 20_000)
    assert found(search.search(table, asked)) == want  # many shards


def test_search_skips_blocks():
    """Two kinds of documents: a query for one leaves the other's blocks of a common term closed, and misses nothing."""
    rng = random.Random(3)
    asked = search.Asked([["both", "a1", "a2"]])
    number = {t: i for i, t in enumerate(asked.terms)}
    which = [np.array([number["both"]] + ([number["a1"], number["a2"]] if i % 10 == 0 else []), np.int32) for i in range(2000)]
    counts = [np.array([rng.randint(1, 9)] + [1 + i % 7] * (len(w) - 1)) for i, w in enumerate(which)]
    shard = search.shard_of([50] * 2000, which, counts, (2000, 100_000), asked)
    weight = np.zeros(len(asked.terms), np.int64)
    weight[number["both"]], weight[number["a1"]], weight[number["a2"]] = 1, 2000, 2000
    asked.weigh(weight)
    best = [search.Best()]
    import pyarrow as pa

    opened = search.searched_shard(shard, pa.array(range(2000)), asked, best, 10)
    blocks = len(shard["sizes"])
    value = lambda tf: 10**9 * int(tf) // (1000 * int(tf) + 8 * 100)
    scores = sorted(((-sum(int(weight[t]) * value(c) for t, c in zip(w, k, strict=True)), i) for i, (w, k) in enumerate(zip(which, counts, strict=True))))[:10]
    assert [(s, i) for s, _, i in best[0].rows] == [(-s, i) for s, i in scores] and opened < blocks / 2


def test_search_of_a_stored_index(spark, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 40)
    docs = spark.createDataFrame([(i, f"a b{i % 3} " * (i % 4)) for i in range(30)], "doc_id long, text string")
    asked = search.Asked([["a", "b1"], ["b2"]])
    asked.weigh(np.array([3, 100, 100], np.int64))
    postings = search.counted(docs, ["doc_id"], "text", asked)
    totals = tuple(postings.agg(F.count("*"), F.sum("n")).first())
    table = search.index(postings, totals, asked)
    assert table.count() > 2
    got = sorted(tuple(r) for r in search.search_index(table, asked, top=100).collect())
    held = [(r.row.doc_id, r.n, dict(zip(r.terms, r.counts, strict=True))) for r in postings.collect()]
    want = []
    for number, q in enumerate(asked.queries):
        for key, n, own in held:
            m = 10 + 90 * n * totals[0] // totals[1]
            score = sum((3 if t == 0 else 100) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t in q if t in own)
            want += [(number, key, score)] if score else []
    assert got == sorted(want)


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_search_of_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty != "items" else [(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([] if empty != "docs" else [(1, "a b")], "item_id long, text string")
    out = search.search(docs, items)
    assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# vector codes


def codes_by_brute_force(rows):
    kept = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // 8
    first = {}
    for (key, _, _), v in sorted(zip(kept, ints, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1])):
        if key is not None:
            first.setdefault(key, v)
    book = [[v[p * width : (p + 1) * width] for v in list(first.values())[:16]] for p in range(8)]

    def assign():
        out = []
        for v in ints:
            far = [[sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)) for e in book[p]] for p in range(8)]
            out.append([(min(f), f.index(min(f))) for f in far])
        return out

    for _ in range(6):
        own = assign()
        for p in range(8):
            for e in range(len(book[p])):
                held = [v[p * width : (p + 1) * width] for v, o in zip(ints, own, strict=True) if o[p][1] == e]
                if held:
                    book[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    own = assign()
    sums = Counter()
    for (_, _, label), o in zip(kept, own, strict=True):
        sums[label] += sum(f for f, _ in o)
    digest = hashlib.sha256(",".join(str(x) for part in book for e in part for x in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{e:02x}" for _, e in o), sum(f for f, _ in o), sums[label], digest) for (k, _, label), o in zip(kept, own, strict=True)), key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.3, dim)], int(k) % 3 if k % 4 else None) for k in rng.permutation(n)]


@pytest.mark.parametrize(("n", "dim"), [(200, 16), (5, 8), (60, 24)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dim):
    monkeypatch.setattr(codes, "BLOCK", 37)
    rows = vectors(n, dim, n)
    rows += [(9001, None, 1), (9002, [None] * dim, 1), (9003, [math.nan] + [0.0] * (dim - 1), 1), (9004, [math.inf] + [0.0] * (dim - 1), 2), (None, [0.25] * dim, 1), rows[0], (rows[1][0], [1.5] * dim, 0), (9005, [30.0] * dim, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("row", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == codes_by_brute_force(rows)


def test_codes_of_empty_and_wrong_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.compressed(spark.createDataFrame([], schema)).collect() == []
    assert [(r.vec_id, r.code, r.error) for r in codes.compressed(spark.createDataFrame([(None, [1.0] * 8, None)], schema)).collect()] == [(None, "00" * 8, 0)]
    for wrong in ([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], [(1, [1.0] * 9, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(Exception, match="vectors of|too large"):
            codes.compressed(spark.createDataFrame(wrong, schema)).collect()


def test_sums_beyond_what_is_broadcast(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"l{i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "label string, error long")
    sums = Counter()
    for label, error in rows:
        sums[label] += error
    got = sorted(((r.label, r.error, r.total) for r in codes.with_sums(df, "label", "error", "total", most=10).collect()), key=str)
    assert got == sorted(((label, error, sums[label]) for label, error in rows), key=str)


# URL filters


@pytest.mark.parametrize(("listed", "others"), [(0, 10), (1, 0), (300, 20_000), (5_000, 100)])
def test_cascades_are_exact(spark, monkeypatch, listed, others):
    monkeypatch.setattr(urls, "LISTED", 64)
    keys = [(f"key {i}",) for i in range(listed + others)]
    table = spark.createDataFrame(keys, "key string")
    own = spark.createDataFrame(keys[:listed] + keys[: listed // 2] + [(None,), ("elsewhere",)], "key string")
    made = urls.cascades(own, table.union(table))
    rows = table.select("key", F.array(urls.hashed(F.col("key"))).alias("hashes"))
    for most in (urls.HELD, 200):
        got = {r.key for r in urls.with_listed(rows, "hashes", made, "is", most).where("is[0]").collect()}
        assert got == {k for (k,) in keys[:listed]}


def test_a_cascade_alternates():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 1 << 63, (60_000, 2), dtype=np.uint64)
    filters = urls.cascade(key[:1000], key[1000:])
    assert len(filters) > 3 and sum(f.bits for f in filters) < 1000 * 24
    assert not urls.listed_in(filters[:1], key[1000:, 0], key[1000:, 1]).all() and urls.listed_in(filters[:1], key[1000:, 0], key[1000:, 1]).any()
    assert urls.listed_in(filters, key[:, 0], key[:, 1]).tolist() == [True] * 1000 + [False] * 59_000
    with pytest.raises(ValueError, match="share"):
        urls.cascade(key[:1], key[:1])


def judged_by_brute_force(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = host.translate(LOWER)
    fit = [(len(h + p), h + p, v == "block") for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    verdict = best[2] if best else host in listed and host != ""
    return host, path, best and best[1], "block" if verdict else "allow"


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(2)
    rules = [*entries.URL_RULES, ("allow", "co.uk", ""), ("block", "b.co.uk", "/é"), ("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("allow", "net", "/fr/ok")]
    hosts = ["com", "a.com", "EXAMPLE.com", "www.example.com", "m.www.example.com", "net", "a.net", "xcom", "b.co.uk", "c.b.co.uk", "co.uk", ".com", "com.", "", "spam.org", "a.com:80", "x" * 5000 + ".com", ".".join("a" * 3000) + ".net"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/es/", "/fr/ok/1", "/x", "/xy", "/é/1", "/" + "p" * 100_000]
    data = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=://x/', '#top', '?', '/#?'])}") for i in range(900)]
    data += [(901, None), (902, ""), (903, "www.example.com/en/"), (904, "://"), (5, data[5][1]), (None, "http://a://com/"), (905, "http://a\n.com/\nx")]
    pages = spark.createDataFrame(data, "page_id long, url string").withColumns({"host": F.lit(1), "row": F.lit(2), "verdict": F.lit(3)})
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    listed = spark.createDataFrame([("spam.org",), ("",), ("xcom",), ("not.here",)], "key string")
    out = urls.judged(pages, table, listed, ["page_id"]).collect()
    want = [(k, *judged_by_brute_force(url, rules, {"spam.org", "xcom"})) for k, url in data]
    assert sorted((tuple(r) for r in out), key=str) == sorted(want, key=str)


def test_verdicts_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string"), spark.createDataFrame([], "key string")
    assert [tuple(r) for r in urls.judged(pages, *none, ["page_id"]).collect()] == [(1, "a.com", "/", None, "allow")]
    assert urls.judged(pages.limit(0), *none, ["page_id"]).collect() == []


def test_hosts_with_words(spark):
    pages = spark.createDataFrame([("http://spam-farm.example.org/",), ("http://spammer.org",), ("http://x.SPAM.org/a",), (None,)], "url string")
    assert {r.key for r in urls.hosts_with_words(pages, entries.HOST_WORDS).collect()} == {"spam-farm.example.org", "x.spam.org"}


# earlier operators


def test_pivot_links_span_without_being_all():
    from cartulary.llm import voronoi

    rng = np.random.default_rng(4)
    for _ in range(40):
        n, p = int(rng.integers(1, 60)), int(rng.integers(0, 9))
        links = rng.random((n, p)) < rng.choice([0.05, 0.4, 0.95])
        selves = [k if k < p else None for k in range(n)]
        for k in range(min(n, p)):
            links[k, k] = True

        def parts(pairs, n=n, p=p):
            group = list(range(n + p))
            for a, b in pairs:
                group = [group[a] if g == group[b] else g for g in group]
            return {frozenset(i for i in range(n + p) if group[i] == g) for g in group}

        same = [(k, n + k) for k in range(min(n, p))]  # a pivot's row is the pivot
        got = voronoi.pivots_met(links, selves)
        assert parts([(i, n + k) for i, ks in enumerate(got) for k in ks] + same) == parts([(i, n + k) for i, k in zip(*np.nonzero(links), strict=True)] + same)
        assert sum(map(len, got)) <= n + p


def test_language_scores_of_very_many_pieces():
    from cartulary.llm import langid

    pieces = [None, "▁", *"abcdefghijklmnopqrstuvwxyz", "ab"]
    for count in (10**13, 10**18):
        m = langid.Model([("x", 1, count), ("x", 2, count), ("y", 1, count), ("y", 3, count), ("x", -1, 1), ("y", -1, 1)], pieces)
        scores = m.word_scores(["▁" + "z" * 24, "▁" + "a" * 24, "▁q" + "ω" * 23, "▁"])
        assert np.isfinite(scores).all() and scores[1, 0] > scores[1, 1] + 400
