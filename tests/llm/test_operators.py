"""Operators against brute force, round trips and held-out accuracy, on small tables and on odd ones."""

import functools
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import common, entries, jaccard, langid, licenses, mixing, ogg, packing, pii, ppm, syncmers, voronoi, warc

SF = "/root/testdata/sf0.001"
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# packing


def test_packing_equals_tokenizers(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(entries.tokenizer_file("byte_bpe_50k.json"))
    rows = entries.op1_best_fit_packing(spark, SF).collect()
    docs = texts(spark)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == docs.keys()
    for doc_id, pieces in by_doc.items():
        ids = [*plain.encode(docs[doc_id].text or "", add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 1024) and all(r.length == 1024 for r in pieces[1:])
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    check_sequences(rows, 1024)
    least = -(-sum(r.length for r in rows) // 1024)
    assert len({r.sequence_id for r in rows}) <= least * 1.05 + 2


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(entries.tokenizer_file("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> \n<|endoftext|><|endoftext|> x", "<|endoftext|", "one  <|endoftext|>  two's <|endofprompt|>", "<<|endoftext|>>  "]
    rows = entries.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in rows}
    for i, text in enumerate(texts):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert 50256 in plain.encode(texts[0], add_special_tokens=False).ids


def test_packing_of_long_white_space(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(entries.tokenizer_file("byte_bpe_50k.json"))
    encode = packing.encoder(entries.tokenizer_file("byte_bpe_50k.tiktoken"), entries.BYTE_PATTERN, packing.added_tokens(entries.tokenizer_file("byte_bpe_50k.json")))
    rng = random.Random(1)
    blanks = "".join(rng.choice(" \n\t\r\u3000\xa0\u2003 ") for _ in range(30_000))
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" + " " * 2000 + "b", "a" + " " * 2000 + "<|endoftext|>  b" + "\n" * 1500, "x" + blanks + "y's", "\x1c" * 2000 + " a", " " * 10_000_000 + "end"]
    for text in texts:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids
    assert {r.doc_id: r.length for r in entries.pack(spark.createDataFrame([(0, texts[1][:5000])], "doc_id long, text string")).where("piece = 0").collect()}


def check_sequences(rows, size):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size


def test_best_fit_against_a_list_of_bins():
    """Open bins in the order in which they reached their free space: of equally full ones the last is used and closed."""
    rng = random.Random(5)
    for bins_open in (1, 3, 50):
        lengths = [rng.randint(1, 30) for _ in range(400)]
        number, offset = packing.best_fit(lengths, 30, bins_open)
        bins: list[list[int]] = []  # [free, number], latest last
        used = 0
        for n, b, o in zip(lengths, number, offset, strict=True):
            fits = [x for x in bins if x[0] >= n]
            if fits:
                chosen = [x for x in fits if x[0] == min(f for f, _ in fits)][-1]
                bins.remove(chosen)
            else:
                chosen, used = [30, used], used + 1
            assert (b, o) == (chosen[1], 30 - chosen[0])
            if chosen[0] > n:
                bins.append([chosen[0] - n, chosen[1]])
            if len(bins) > bins_open:
                bins.remove([x for x in bins if x[0] == min(f for f, _ in bins)][-1])


def test_packing_of_odd_rows(spark, odd_docs):
    rows = entries.pack(odd_docs).collect()
    check_sequences(rows, 1024)
    assert sum(r.doc_id == 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert entries.pack(odd_docs.limit(0)).count() == 0


# PPM


def brute_ppm(train, text, order):
    """log10 P of a text: escapes by estimate C, symbols of longer contexts excluded."""
    counts = defaultdict(Counter)
    for t in train:
        s = bytes([ppm.START]) * order + t + bytes([ppm.END])
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    s, total = bytes([ppm.START]) * order + text + bytes([ppm.END]), 0.0
    for i in range(order, len(s)):
        out: set = set()
        for k in range(order, -1, -1):
            seen = {b: n for b, n in counts.get(s[i - k : i], {}).items() if b not in out}
            whole = sum(seen.values()) + len(seen)
            if not whole:
                continue
            if s[i] in seen:
                total += math.log10(seen[s[i]] / whole)
                break
            total += math.log10(len(seen) / whole)
            out |= seen.keys()
        else:
            total -= math.log10(255 - len(out))
    return total


@pytest.mark.parametrize("fan", [2, ppm.FAN])
def test_ppm_equals_brute_force(spark, fan):
    """Many blocks, which a cell meets at once, or through slices of two, level by level."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900")
    got = {r.doc_id: r for r in ppm.score(docs, "crc32(CAST(CAST(doc_id AS string) AS binary)) % 7 <> 2", block_bytes=4000, fan=fan).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    train = {d: t.encode() for d, t in rows.items() if zlib.crc32(str(d).encode()) % 7 != 2}
    words = Counter(w for t in train.values() for w in t.lower().split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    assert len(rows) > 20 and got.keys() == rows.keys() and sum(map(len, rows.values())) > 4 * 4000
    for d, text in rows.items():
        tokens = text.encode().lower().split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((len(train) + 1) / (n + v + 1))
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(tokens) + 1, sum(w in words for w in tokens) + 1, n)
        assert got[d].base_score == pytest.approx(base)
    for d in list(rows)[:25]:
        assert got[d].score == pytest.approx(brute_ppm(list(train.values()), rows[d].encode(), ppm.ORDER), rel=1e-4)


def test_ppm_sums_to_one():
    train = [b"abracadabra", b"abba", b"\xc3\xa9t\xc3\xa9"]
    keys, _ = ppm.grams(train, 3)
    low = np.bincount((keys & np.uint64(0xFFFF)).astype(int), minlength=65536).reshape(256, 256).astype(float)
    for context in (b"abr", b"zab", b"zzz", b"\xfe\xfe\xfe"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256) if s != ppm.START], np.uint64)
        distinct, back = np.unique(np.concatenate([keys, asked]), return_inverse=True)
        counts = np.bincount(back[: len(keys)], minlength=len(distinct)).astype(float)
        got = ppm.log_probabilities(distinct, counts, low, 3)[np.searchsorted(distinct, asked)]
        assert (10**got).sum() == pytest.approx(1)


def test_ppm_of_odd_rows(spark, odd_docs):
    rows = ppm.score(odd_docs, "doc_id % 2 = 1").collect()
    assert len(rows) == 12 and all(r.score < 0 for r in rows) and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    unlearned = ppm.score(odd_docs, "false").where("doc_id = 3").first()
    assert unlearned.score == pytest.approx(-math.log10(255)) and unlearned.n_known == 0
    assert ppm.score(odd_docs.limit(0), "true").count() == 0


# mixing


def water_fill(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        live = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("odd", [False, True])
def test_mix_meets_targets(spark, odd_docs, odd):
    docs = odd_docs if odd else spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, ["doc_id", "text", "source"]).collect()
    sizes, taken, smallest, largest = Counter(), Counter(), {}, Counter()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["size"] == len(spaced(r.text)) and 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        if r["size"]:
            smallest[r.source] = min(smallest.get(r.source, 10**9), r["size"])
    want = water_fill(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        coarse = largest[s] / 2 if odd else 0  # one document may be nearly all of a source
        assert abs(taken[s] - want[s]) <= max(smallest.get(s, 0), 0.02 * want[s], coarse) + 1e-6, s
    again = mixing.mix(docs, ["doc_id"]).collect()
    assert sorted((r.doc_id or -1, r.copies) for r in again) == sorted((r.doc_id or -1, r.copies) for r in rows)
    assert mixing.mix(docs.limit(0), ["doc_id"]).count() == 0


def test_mix_of_many_sizes(spark):
    """A source of 6,000 distinct sizes: copies end within a small document of the target."""
    rows = [(i, "w " * (i % 6000 + 1), "a") for i in range(0, 7000, 2)] + [(10_000 + i, "w " * 3000, "b") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).groupBy("target").agg(F.sum("taken").alias("t"), F.min("size").alias("s")).collect()
    assert len(got) == 2 and all(abs(r.t - r.target) <= r.s for r in got)


def test_mix_solves_the_dual(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for of in by.values():
        assert sum(r.rate * r["size"] for r in of) == pytest.approx(of[0].target, rel=1e-6)
        # log odds of rate / cap are linear in size: an exponential tilt
        points = [(r["size"], math.log(r.rate / (3 - r.rate))) for r in of if 0 < r["size"] and 1e-9 < r.rate < 3 - 1e-9]
        if len(points) > 2 and points[0][0] != points[-1][0]:
            (x0, y0), (x1, y1) = min(points), max(points)
            assert all(y == pytest.approx(y0 + (y1 - y0) * (x - x0) / (x1 - x0), abs=1e-6) for x, y in points if x1 > x0)


# Ogg


def slow_crc(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum_and_round_trip():
    rng = random.Random(3)
    for n in (64, 255 * 64, 4096, 4097, 70_016, 300_032):
        payload = rng.randbytes(n)
        media = ogg.write(payload)
        assert slow_crc(payload[:300]) == ogg.checksum(payload[:300])
        got, seen = ogg.read(media)
        assert got == payload and seen["streams"] == 2 and seen["seconds"] == n / ogg.RATE
        for at in (0, 30, len(media) // 2, len(media) - 1):
            broken = bytearray(media)
            broken[at] ^= 1
            with pytest.raises(ValueError):
                ogg.read(bytes(broken))
        with pytest.raises(ValueError):
            ogg.read(media[:-1])


def brute_feature(media):
    """Streams, pages, packets and seconds, read off the page heads alone."""
    at, serials, pages, packets, last = 0, set(), 0, 0, 0
    while at < len(media):
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        serials.add(media[at + 14 : at + 18])
        last = max(last, int.from_bytes(media[at + 6 : at + 14], "little", signed=True))
        pages, packets = pages + 1, packets + sum(n < 255 for n in lacing)
        at += 27 + len(lacing) + sum(lacing)
    return len(serials), pages, packets, last / 8000


def test_ogg_query(spark, odd_docs):
    docs = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = ogg.features(ogg.stored(odd_docs, ["doc_id", "size"]), ["doc_id", "n_bytes", "size"]).collect()
    assert len(rows) == 12
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        whole = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.write(whole)).hexdigest()
        assert r.feature == "ogg:{} streams,{} pages,{} packets,{:.6f} s".format(*brute_feature(ogg.write(whole)))
    assert ogg.features(ogg.stored(odd_docs.limit(0), ["doc_id"]), ["doc_id"]).count() == 0


# licenses


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), places


@pytest.fixture(scope="module")
def licensed(spark, odd_docs):
    text = licenses.TEMPLATES["mit-text"].split()
    rows = [
        (50, "x " + " ".join(text) + " y", "en", "a"),
        (51, " ".join(text[:9]) + " really " + " ".join(text[9:]), "en", "a"),
        (52, " ".join(text[:6]), "en", "a"),
        (53, "CC-BY-NC, cc by nc; Apache License, Version 2.0 under the MIT license under the MIT-License", "en", "a"),
        (54, "K under the mit K licenses", "en", "a"),
    ]
    return odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)


def test_licenses(spark, licensed):
    docs = {r.doc_id: r.text for r in licensed.collect()}
    rows = licenses.scan(licensed).collect()
    assert len(rows) == len(licensed.collect())
    got = {r.doc_id: r for r in rows}
    for d, r in got.items():
        n, places = base_places(docs[d])
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None)), d
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
    assert got[50].labels == "mit-text" and got[50].score == 1 and got[51].labels == "mit-text" and 0.8 < got[51].score < 1
    assert got[52].labels == "" and got[53].n_base == 5 and got[54].n_base == 0
    assert licenses.scan(licensed.limit(0)).count() == 0


def brute_labels(text, near, least):
    """Labels and best share, by counting every diagonal's neighbourhood."""
    k, words = licenses.K, re.findall(licenses.SPLIT, text.lower())
    grams = defaultdict(list)
    for p in range(len(words) - k + 1):
        grams[tuple(words[p : p + k])].append(p)
    got = {}
    for label, template in licenses.TEMPLATES.items():
        t = template.split()
        at = defaultdict(set)
        for q in range(len(t) - k + 1):
            for p in grams[tuple(t[q : q + k])]:
                at[p - q].add(q)
        best = max((len(set().union(*(at[e] for e in at if abs(e - d) <= near))) for d in list(at)), default=0) / (len(t) - k + 1)
        if best >= least:
            got[label] = best
    return got


def test_license_labels_equal_brute_force(spark):
    rng = random.Random(4)
    apache, mit = licenses.TEMPLATES["apache-2-notice"], licenses.TEMPLATES["mit-text"]
    texts = ["apache license version " * 20 + apache, "licensed under the " * 20 + apache, apache + " " + "licensed under the " * 500 + mit, apache.replace("not", "not ever and ever"), (mit + " ") * 3]
    pool = [" ".join(t.split()[i : i + n]) for t in licenses.TEMPLATES.values() for i in range(0, 30, 7) for n in (4, 9, 20)]
    texts += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_labels(texts[r.doc_id], licenses.NEAR, licenses.LEAST)
        base = set(filter(None, r.base_labels.split(",")))
        assert set(filter(None, r.labels.split(","))) == set(want) | base, texts[r.doc_id]
        assert abs(r.score - max([*want.values(), *(1.0 for _ in base)], default=0.0)) < 1e-9
    assert all("apache-2-notice" in r.labels for r in rows if r.doc_id in (0, 1, 2))


def test_licenses_on_given_rows(spark):
    docs = texts(spark)
    for r in licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        n, places = base_places(docs[r.doc_id].text)
        assert (r.n_words, r.n_base) == (n, len(places))


# WARC


def test_warc(spark):
    big, other = "é" * 700, "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", other), (8, "u v", other), (9, "u", other), (9, "u", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.archive_folder(spark)
    manifest = warc.write(warc.roles(pages), folder, archive_bytes=900)
    got = warc.read(spark, manifest, split_bytes=137).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = []
    for p, _, html in rows:
        raw = (html or "").encode()
        last = max(x[0] or 0 for x in rows if (x[2] or "") == (html or ""))
        visit = len(raw) >= 1000 and p != last
        want.append((p, "revisit" if visit else "response", last if visit else None, len(raw), hashlib.sha1(raw).hexdigest(), None if visit else raw))
    found = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in got]
    found = [(*x[:5], b"" if x[5] is None and x[3] == 0 else x[5]) for x in found]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert warc.read(spark, warc.write(warc.roles(pages.limit(0)), folder)).count() == 0


def test_warc_false_magic():
    import io

    one, two = (warc.record(i, "u", random.Random(i).randbytes(5000), None) for i in (1, 2))
    noise = warc.MAGIC + b"noise" + warc.MAGIC
    whole = one + two
    for cut in (1, 100, len(one), len(one) + 1, len(whole)):
        a = list(warc.members(io.BytesIO(whole), 0, cut, len(whole)))
        b = list(warc.members(io.BytesIO(whole), cut, len(whole), len(whole)))
        assert len(a + b) == 2
    assert len(list(warc.members(io.BytesIO(noise + one), 1, len(noise + one), len(noise + one)))) == 1
    with pytest.raises(ValueError, match="must follow"):
        list(warc.members(io.BytesIO(noise + one), 0, 10, len(noise + one)))
    assert warc.page_of(warc.record_id(-5)) == -5 and warc.page_of(warc.record_id(None)) is None


def test_warc_damage(spark, tmp_path):
    """Zeroed bytes anywhere in a record raise, whatever range they fall into; so does a record that is gone."""
    pages = spark.createDataFrame([(i, "u", f"page {i} " + random.Random(i).randbytes(300).hex()) for i in range(40)], "page_id long, url string, html string").repartition(1)
    manifest = warc.write(warc.roles(pages), f"file://{tmp_path}/archives")
    assert warc.read(spark, manifest, split_bytes=999).count() == 40
    path = manifest.first().path.removeprefix("file://")
    with open(path, "rb") as f:
        whole = f.read()
    for at in (0, 700, len(whole) // 2, len(whole) - 30):
        with open(path, "wb") as f:
            f.write(whole[:at] + bytes(20) + whole[at + 20 :])
        with pytest.raises(Exception, match="damaged|must follow|cut|aren't all there|wrong payload"):
            warc.read(spark, manifest, split_bytes=999).count()
    with open(path, "wb") as f:
        f.write(whole)
    with pytest.raises(ValueError, match="aren't all there"):
        warc.read(spark, manifest.withColumn("records", F.col("records") + 1))


# Jaccard


def brute_components(rows, k, num, den):
    def shingles(t):
        w = spaced((t or "").translate(ASCII_LOWER))
        return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def variants(seed):
    """Groups of near copies around the threshold, a large one, exact copies, and texts that share passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 3000)}"
    passage = [word() for _ in range(60)]
    out = []
    for size, n in ((12, 6), (40, 10), (90, 400), (30, 30), (3, 4), (2, 4), (1, 3)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = [word()]
            out.append(" ".join(w))
    out += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(60)]
    out += [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(spark, k, num, den):
    rows = variants(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, k, num, den, pivots=6, leaf=20, slice_docs=30).collect()}
    assert got == brute_components(rows, k, num, den)


def one_segment_empty(m, n):
    """A text of n three-word shingles that leaves exactly one of m segments empty."""
    for seed in itertools.count():
        rng = random.Random(seed)
        t = [f"t{rng.randint(0, 10**6)}" for _ in range(n + 2)]
        filled = np.unique(jaccard.shingles(" ".join(t), 3).astype(np.float64) * m // 2.0**64)
        if len(filled) == m - 1:
            return " ".join(t)


def test_jaccard_of_short_texts_on_a_template(spark):
    """Nine shingles in four segments, one of them empty: most that is shared with the template is held by all."""
    base = one_segment_empty(4, 9)
    rows = list(enumerate([f"{base} own{i}" for i in range(500)] + [base]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5)])
def test_linked_sets_keep_a_common_hash(num, den):
    """Whatever order says which hashes the most documents hold, linked sets don't both drop all that they share."""
    rng = random.Random(3)
    segments = jaccard.Segments(num, den)
    for n in [*range(4, 60), *range(60, 1200, 40)] * 5:
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: -(-n * num // den)]  # as far apart as may be
        order = rng.getrandbits(64)
        kept = []
        for x in (a, b):
            h, tags = segments.of(np.array(sorted(x), np.uint64))
            kept.append({k for tag in set(tags.tolist()) for k in sorted(h[tags == tag].tolist(), key=lambda k: k * 0x9E3779B97F4A7C15 % 2**64 ^ order)[tag & 0xFFFF :]})
        assert len(b) == n or kept[0] & kept[1]


def test_holders_are_dealt_into_bounded_buckets(spark):
    """Of 3,000 holders of one hash, no bucket holds more than about two slices, and all pairs meet on sides that differ."""
    rows = [(i, 7, 3000) for i in range(3000)] + [(i, 8, 4) for i in range(4)]
    buckets = defaultdict(list)
    for r in jaccard.dealt_holders(spark.createDataFrame(rows, "node long, held_by long, holders long"), 300).collect():
        buckets[r.segment].append((r.node, r.side))
    assert len(buckets) == 56 and max(map(len, buckets.values())) < 2 * 400
    met = np.zeros((3000, 3000), bool)
    for held in buckets.values():
        doc, side = np.array(sorted(held)).T
        met[np.ix_(doc, doc)] |= (side[:, None] != side) | (side == 0)
    assert met.all()


def test_reached_equals_leaders():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 3, (8, jaccard.CLASSES))
    counts = (base[rng.integers(0, 8, 400)] + (rng.random((400, jaccard.CLASSES)) < 0.05)).astype(np.int16)
    sizes = counts.sum(1, dtype=np.int64)
    for num, den in ((9, 10), (4, 5), (24, 25)):
        of = jaccard.reached(np.zeros(400, np.int8), sizes, counts, num, den)
        assert (of == jaccard.leaders(np.zeros(400, np.int64), sizes, counts, num, den)).all()


def test_jaccard_of_dealt_holders(spark):
    rows = variants(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, 3, 9, 10, slice_holders=60).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_jaccard_on_given_rows(spark):
    rows = [(d, r.text) for d, r in texts(spark).items()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entries.op7_jaccard_components(spark, SF).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def test_jaccard_of_odd_rows(spark, odd_docs):
    rows = jaccard.components(odd_docs, 3, 9, 10).collect()
    assert len(rows) == 12
    got = {r.doc_id: r.component_id for r in rows}
    assert got[5] == got[6] == got[7] == 5 and got[2] == 2 and got[3] == 3 and got[None] is None
    assert jaccard.components(odd_docs.limit(0), 3, 9, 10).count() == 0
    kept = jaccard.near_duplicates_removed(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 11]


@pytest.mark.parametrize("copies", [150, 205, 1000])
def test_jaccard_of_many_holders(spark, copies):
    """Two texts of 9 and 10 shingles that share one filled segment, which many others hold, link at any number of holders."""
    base = one_segment_empty(4, 9)
    rows = list(enumerate([f"{base} own{i}" for i in range(copies)])) + [(5000, base), (6000, base.upper() + " last")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == brute_components(rows, 3, 9, 10)


def parts_of(nodes, links):
    """The smallest node that links reach, of each node."""
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_voronoi_cells_split(spark):
    """Sixty clusters in one region: pivots and cells of several levels find what comparing all finds."""
    rng = random.Random(5)
    rows = []
    for c in range(60):
        for _ in range(15):
            t = [f"c{c}w{i}" for i in range(100)]
            for _ in range(rng.choice([0, 2, 6, 9])):
                t[rng.randrange(100)] = f"z{rng.randint(0, 10**6)}"
            rows.append(" ".join(t))
    rng.shuffle(rows)

    def sets_of(texts):
        sets = [jaccard.shingles(t, 1) for t in texts]
        return sets, [jaccard.digest(x) for x in sets]

    sets, nodes = sets_of(rows)
    linked, _ = voronoi.measured(sets, sets, 9, 10)
    want = parts_of(nodes, [(nodes[a], nodes[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    local = voronoi.Local(sets, 9, 10)
    assert local.splits > 3 and parts_of(nodes, [(nodes[a], nodes[b]) for a, b in local.links]) == want
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    regions = spark.createDataFrame([(1, n, i) for n, i in {n: i for i, n in enumerate(nodes)}.items()], "region long, node long, doc_id long")
    found = voronoi.joined(docs, regions, sets_of, 9, 10, pivots=24, leaf=100, slice_docs=200).collect()
    assert parts_of(nodes, [(r.a, r.b) for r in found]) == want
    assert {"pivot 1", "pivot 2", "cell"} <= {r.how for r in found} and "slices" not in {r.how for r in found}


def test_voronoi_windows_hold_all_partners():
    rng = np.random.default_rng(1)
    for eps in (0.1, 0.2):
        points = np.array([np.unique(rng.integers(0, 200, 40)) for _ in range(200)], dtype=object)
        sets = [x.astype(np.uint64) for x in points] + [np.unique(np.concatenate([x[2:], rng.integers(300, 400, 1)])).astype(np.uint64) for x in points]
        linked, _ = voronoi.measured(sets, sets, round(100 * (1 - eps)), 100)
        _, distance = voronoi.measured(sets, sets[:12], 9, 10)
        home, holds = voronoi.cells_of(distance, eps)
        assert holds[np.arange(len(sets)), home].all()
        for a, b in zip(*np.nonzero(linked), strict=True):
            assert holds[b, home[a]] or holds[a, home[b]]


def test_jaccard_of_one_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, a)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect())
    assert got == [(1, 58, 1), (1, 58, 1), (2, 59, 1), (3, 59, 1), (4, 58, 1)]
    kept = jaccard.near_duplicates_removed(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)
    assert sorted(r.text[0] for r in kept.collect()) == ["a", "b"]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 99), (7, 7), (200, 200), (5, None)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {99: 99, 100: 99, 200: 200} | {300 + i: 300 for i in range(50)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# syncmers


def test_syncmer_query(spark):
    docs = {d: r.text or "" for d, r in texts(spark).items()}
    order = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in entries.op8_syncmer_fingerprints(spark, SF).collect()}
    prints = {}
    for i, d in enumerate(order):
        text, after = docs[d], docs[order[(i + 1) % len(order)]]
        cut = len(text) // 3
        edit = text[: len(text) - cut] + after[:cut]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if after == text:
            assert r.near_next == 1
    near = np.array([rows[d].near_edited for d in docs if len(docs[d]) > 200])
    far = np.array([rows[d].near_next for d in docs if len(docs[d]) > 200])
    assert np.median(near) > 0.5 and near.min() > 0.2 and np.median(far) < 0.1


def brute_anchors(units):
    """Positions of closed syncmers, from the hashes of pairs of units."""
    return [i for i in range(len(units) - 3) if min(units[i], units[i + 3]) <= min(units[i + 1], units[i + 2])]


def test_syncmers_equal_brute_force(spark):
    text = "one two three four five six seven eight nine ten eleven twelve " * 2 + "abcdefghijklmnop"
    df = spark.createDataFrame([(text,)], "t string")
    units = re.findall(r"\S{1,6}", text)
    pairs = [r.h for r in spark.createDataFrame([(i, units[i], units[i + 1]) for i in range(len(units) - 1)], "i int, a string, b string").select("i", F.xxhash64("a", "b").alias("h")).orderBy("i").collect()]
    sketch = df.select(syncmers.anchors(F.col("t")).alias("s")).first().s
    kmers = {tuple(pairs[i : i + 4]) for i in brute_anchors(pairs)}
    assert len(sketch) == min(len(kmers), syncmers.SKETCH) and [x.h for x in sketch] == sorted(x.h for x in sketch)
    assert {x.p for x in sketch} <= set(brute_anchors(pairs))


def test_syncmers_of_long_texts(spark):
    """Of 12,000 words no anchor is left out, and a passage of 600 shared words is seen in the likeness."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 10**5)}"
    passage = [word() for _ in range(600)]
    a, b = (" ".join([*(word() for _ in range(3000)), *passage, *(word() for _ in range(8400))]) for _ in range(2))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    r = df.select("a", "b", syncmers.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert min(len(r.a), len(r.b)) > 4000
    at = {x.h: x.p for x in r.b}
    diffs = sorted(x.p - at[x.h] for x in r.a if x.h in at)
    reach = 16 + max(x.p for x in r.a) // 10
    matched = sum(abs(d - diffs[len(diffs) // 2]) <= reach for d in diffs)
    assert matched > 200 and r.near == 2 * matched / (len(r.a) + len(r.b))


def test_syncmers_without_blanks(spark):
    """One more character in front leaves the anchors of a text without blanks; words and short runs are cut as before."""
    rng = random.Random(6)
    for letters in ("".join(map(chr, range(0x4E00, 0x5200))), "abcdefghijklmnopqrstuvwxyz0123456789+/", "𝒳𝒴𝒵𐍈𐍉abc漢字"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        cut = text[1000:2000]
        df = spark.createDataFrame([(text, "x" + text, cut)], "a string, b string, c string")
        a, b, c = ({x.h for x in s} for s in df.select(*(syncmers.anchors(F.col(x)) for x in "abc")).first())
        assert len(a & b) >= len(a) - 2 and len(c & a) == len(c) > 300
    words = "one sevenses twelveletter sixteencharacter seventeencharacte é𝒳 x"
    units = spark.createDataFrame([(words,)], "t string").select(F.regexp_extract_all("t", F.lit(syncmers.UNITS), F.lit(0))).first()[0]
    assert units == [u for w in words.split() for u in (re.findall(".{1,6}", w) if len(w) <= 16 else w)]


def test_next_over_many_ranges(spark):
    """Each of 2,003 rows sees the one that follows, whatever the number of ranges."""
    docs = spark.range(2003).select((F.col("id") * 7 - 5000).alias("doc_id"), F.col("id").cast("string").alias("text"))
    for ranges in (1, 2, 61, 500):
        after = {r.text: r.next_text for r in syncmers.with_next(docs, "text", [], ranges).collect()}
        assert len(after) == 2003 and all(after[str(i)] == str((i - 1) % 2003) for i in range(2003))


def test_syncmers_of_odd_rows(spark, odd_docs):
    rows = syncmers.edited(odd_docs, part_rows=3).collect()
    assert len(rows) == 12
    text = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    order = [11, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1, None]
    for d, after in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text[d]) // 3
        assert text[d][: len(text[d]) - cut] + text[after][:cut] in {r.edited for r in rows if r.doc_id == d}
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3)} == {""}
    assert syncmers.edited(odd_docs.limit(0)).count() == 0


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    number = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(number) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(number[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(number) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


PII = [
    "mail a.b@c.de.f_g@h.org, a@b@c.d.e and x@y..z or 𝒳 é q@r.st",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 99999999999999999999.1.1.1 1.2.3 10.0.0.1:80",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 6 7  8 " + "1 2 " * 30_000,
    "+1 (743) 555-3824 +49 30 1234567 +1 2 +123456789012345678 call +33.1.23.45.67.89.",
    "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not DE88370400440532013000; SSN 078-05-1120, 123-45-6789 order",
    "9" * 50_000 + "@" + "a.b" * 5_000,
    None,
    "",
]


def test_personal_data(spark, odd_docs):
    rows = [(i, t) for i, t in enumerate(PII)] + [(100 + i, r.text) for i, r in enumerate(odd_docs.collect())] + [(1000 + d, r.text) for d, r in texts(spark).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(docs, ["doc_id", "text"]).withColumn("base", pii.digest(pii.BASE)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(r.text)), r.doc_id
        assert all(s.value == r.text[s.start : s.end] for s in r.spans)
    added = {(s.kind, s.value) for r in found if r.doc_id == 4 for s in r.spans if s.kind not in pii.BASE}
    assert added == {("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000"), ("ssn", "078-05-1120"), ("ssn", "123-45-6789")}


def test_running(spark):
    rows = [([],), ([5],), ([3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5],), (list(range(1000)),)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", pii.running(F.col("a"), lambda a, b: a + b).alias("s"), pii.running(F.col("a"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in got:
        assert r.s == list(itertools.accumulate(r.a)) and r.m == list(itertools.accumulate(r.a, max))


def test_very_many_spans(spark):
    """Sixteen thousand addresses in one text: as found one by one, and all of them redacted."""
    n = 16_000
    text = "é𝒳 " + " ".join(f"mail a{i}@b{i}.com" for i in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.detect(docs, ["doc_id"]).first().spans
    assert [(x.kind, x.start, x.end) for x in spans] == base_spans(text)
    assert pii.redacted(docs).first().text == "é𝒳 " + " ".join(["mail <email>"] * n)


def test_redaction(spark, odd_docs):
    docs = spark.createDataFrame([(1, "x a@b.cd y +1 743 555 3824.", "k"), (2, None, "k"), (3, "none", None)], "doc_id long, text string, spans string")
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["x <email> y <phone>.", None, "none"]
    assert pii.redacted(odd_docs).count() == 12 and pii.redacted(odd_docs.limit(0)).count() == 0


# language


def test_language_id(spark):
    rows = entries.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and any(c.isalpha() for c in r.text)]
    assert len(held) > 100 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_query_equals_brute_force(spark):
    import sentencepiece

    path = entries.tokenizer_file("piece_bpe_32k.model")
    cutter = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = {cutter.id_to_piece(i): i for i in range(cutter.get_piece_size()) if not (cutter.is_control(i) or cutter.is_unknown(i) or cutter.is_byte(i))}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def runs(text):
        """Letters with their marks, in pieces of at most 24."""
        out, open_run = [], ""
        for c in (text or "").lower():
            kind = unicodedata.category(c)[0]
            if kind == "L" or kind == "M" and open_run:
                open_run += c
            else:
                out, open_run = [*out, open_run], ""
        return [part for run in [*out, open_run] if run for part in [run[i : i + 24] for i in range(0, len(run), 24)]]

    counts, priors = {}, Counter()
    for r in docs.values():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            priors[r.lang] += 1
            own = counts.setdefault(r.lang, Counter())
            for word in runs(r.text):
                own.update(cutter.encode(word))

    @functools.cache
    def word_score(word, lang):
        own, whole = counts[lang], counts[lang].total() + 0.05 * len(cutter)
        sums = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                if word[i:j] in vocabulary:
                    sums[j] += sums[i] * (own[vocabulary[word[i:j]]] + 0.05) / whole
                elif j == i + 1:
                    sums[j] += sums[i] * 1e-7
        return math.log(sums[-1])

    got = entries.op10_language_id(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        words = runs(docs[r.doc_id].text)
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = {lang: math.log((priors[lang] + 1) / (priors.total() + len(priors))) + sum(word_score("▁" + w, lang) for w in words) for lang in counts}
        best = max(sorted(total), key=total.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - total[best]) for v in total.values()), rel=1e-6)


def test_language_of_odd_rows(spark, odd_docs):
    fitted = langid.learn(odd_docs, entries.tokenizer_file("piece_bpe_32k.model"))
    assert fitted.langs == ["de", "en", "fr"]
    out = langid.predict(odd_docs, fitted, odd_docs.columns)
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert got[2] == got[3] == got[4] == "und" and got[8] == "fr" and got[1] == "en" and len(out.columns) == 9
    none = langid.learn(odd_docs.limit(0), entries.tokenizer_file("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(odd_docs, none, ["doc_id"]).collect()} == {"und"}


def test_letters_make_words():
    assert langid.words("½ ² ① Ⅷ ١٢ 12_!") == []
    assert langid.words("Été नमस्ते abc1def") == ["été", "नमस्ते", "abc", "def"]
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(8)).lower()
        letters = [unicodedata.category(c)[0] for c in text]
        assert bool(langid.words(text)) == ("L" in letters)


def test_forward_sums_all_segmentations():
    pieces = [None, "▁a", "▁", "a", "b", "ab", "ba", "▁ab"]
    m = langid.Model([("x", i, i + 1) for i in range(1, 8)] + [("y", 4, 9), ("x", -1, 3)], pieces)

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            i = pieces.index(word[:n]) if word[:n] in pieces else (len(pieces) if n == 1 else None)
            if i is not None:
                total += m.prob[i, k] * brute(word[n:], k)
        return total

    words = ["▁abba", "▁b", "▁azb", "▁a"]
    got = m.word_scores(words)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([math.log(brute(w, 0)), math.log(brute(w, 1))])


# pipeline


def test_pipeline_stages(spark, odd_docs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spent = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, spent = spent, common.written(stage(spark, spent, SF), name)
        assert spent.columns == docs.columns
        if name == "language":
            gone = before.join(spent, "doc_id", "left_anti").collect()
            assert all(not any(c.isalpha() for c in r.text or "") for r in gone)
        if name == "near_duplicates":
            want = {c for _, c in brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5).values()}
            assert {r.doc_id for r in spent.collect()} == want
        if name == "personal_data":
            assert spent.count() == before.count() and not any(k in ("email", "phone") for r in spent.collect() for k, _, _ in base_spans(r.text))
    last = corpus_pipeline.STAGES[-1][1](spark, spent, SF).collect()
    check_sequences(last, 1024)
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter(r.doc_id for r in spent.collect())


def test_language_stage_decides_by_posterior(spark, odd_docs):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    learned = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:120]
    alike = [(i, "le chat noir dort ici", lang, "a", 21) for i, lang in zip(learned, ["aa", "bb", "cc"] * 40, strict=True)]  # as likely in each of three
    clear = [(500 + i, "wort zeile blatt strich", "dd", "a", 23) for i in range(40)]
    docs = spark.createDataFrame(alike + clear + [(900, "12 34", "dd", "a", 5), (901, None, "dd", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == set(range(500, 540))
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unknown, SF).count() == docs.count()
    kept = corpus_pipeline.language(spark, odd_docs, SF)
    assert kept.columns == odd_docs.columns and {r.score for r in kept.collect()} == {"t"}
    assert corpus_pipeline.language(spark, docs.limit(0), SF).select(columns).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert names >= set(entries.QUERIES) and {n.split("_")[0] for n in entries.QUERIES} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
