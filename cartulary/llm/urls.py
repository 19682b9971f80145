"""URL filters: rules on hosts and paths, and listed hosts, by exact membership in cascades of Bloom filters.

The first filter of a cascade holds the listed keys. The second holds those other keys of the corpus that the first lets
through, the third the listed keys that the second lets through, and so on, until none is let through wrongly. The filter at
which a key stops says whether it is listed, and that is exact for every listed key and every key of the corpus. Keys are
dealt into buckets by hash; a task makes one bucket's cascade, and rows are tested where they are, without a join.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import rewritten, written

#: Keys of a bucket on average: listed ones, and all of the corpus.
LISTED, UNIVERSE = 1 << 16, 1 << 20
#: Bytes of filters that tasks hold at once; more are tested in turns.
HELD = 16 << 20
#: Filters of a cascade at most; each halves what is left, so more mean that two keys share both hashes.
FILTERS = 128

CASCADES = "bucket int, buckets int, filters array<struct<bits long, probes int, held binary>>"
#: Seeds and multipliers that mix hashes; any odd numbers would do.
STEP = 0x9E3779B97F4A7C15
MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def hashed(key: Column) -> Column:
    """Two 64-bit hashes of a key; it is told from others by both."""
    return F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit("second"), key).alias("g"))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class Filter:
    """A Bloom filter; `level` makes those of a cascade independent."""

    def __init__(self, level: int, bits: int, probes: int, held: bytes | None = None):
        self.level, self.bits, self.probes = level, bits, probes
        self.held = np.zeros(-(-bits // 8), np.uint8) if held is None else np.frombuffer(held, np.uint8)

    def places(self, h: np.ndarray, g: np.ndarray, probe: int) -> np.ndarray:
        salt = np.uint64((2 * self.level + 1) * STEP % (1 << 64))
        with np.errstate(over="ignore"):
            return (mixed(h ^ salt) + np.uint64(probe) * (mixed(g + salt) | np.uint64(1))) % np.uint64(self.bits)

    def put(self, h: np.ndarray, g: np.ndarray) -> None:
        for probe in range(self.probes):
            at = self.places(h, g, probe)
            np.bitwise_or.at(self.held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for probe in range(self.probes):
            at = self.places(h, g, probe)
            out &= (self.held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def cascade(listed: np.ndarray, others: np.ndarray) -> list[Filter]:
    """Filters for two sets of keys (n x 2 hashes) that have none in common. The first lets through about as many of the
    others as are listed, the rest one half each."""
    filters, inside, outside = [], listed, others
    while len(inside):
        if len(filters) == FILTERS:
            raise ValueError("two keys share both hashes")
        rate = 0.5 if filters else min(0.5, len(inside) / (1.5 * len(outside) + 1))
        probes = max(1, round(-math.log2(rate)))
        one = Filter(len(filters), max(8, math.ceil(len(inside) * probes / math.log(2))), probes)
        one.put(inside[:, 0], inside[:, 1])
        filters.append(one)
        inside, outside = outside[one.has(outside[:, 0], outside[:, 1])], inside
    return filters


def listed_in(filters: list[Filter], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which keys are listed: those that stop at a filter of the other keys, or pass all and the last holds listed ones."""
    out, going = np.zeros(len(h), bool), np.arange(len(h))
    for one in filters:
        on = one.has(h[going], g[going])
        out[going[~on]] = one.level % 2 == 1
        going = going[on]
    out[going] = len(filters) % 2 == 1
    return out


def cascades(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """The table of a list's cascades, a row a bucket: listed (key), and universe (key), all keys that will ever be asked.
    Null keys are in no list; keys that repeat, or of both tables, count once and are listed."""
    sides = [df.where("key IS NOT NULL").select(hashed(F.col("key")).alias("k"), F.lit(own).alias("own")) for df, own in ((listed, True), (universe, False))]
    keys = written(sides[0].unionByName(sides[1]).groupBy("k.h", "k.g").agg(F.max("own").alias("own")), "url-keys")
    n = keys.agg(F.count("*").alias("all"), F.count_if("own").alias("own")).first()
    buckets = max(1, -(-n["own"] // LISTED), -(-n["all"] // UNIVERSE))

    def made(table: pa.Table) -> pa.Table:
        key = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("h", "g")], 1)
        own = table.column("own").to_numpy(zero_copy_only=False)
        found = [{"bits": f.bits, "probes": f.probes, "held": f.held.tobytes()} for f in cascade(key[own], key[~own])]
        return pa.Table.from_pylist([{"bucket": table.column("bucket")[0].as_py(), "buckets": buckets, "filters": found}], pa.schema([("bucket", pa.int32()), ("buckets", pa.int32()), ("filters", pa.list_(pa.struct([("bits", pa.int64()), ("probes", pa.int32()), ("held", pa.binary())])))]))

    dealt = keys.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    return written(dealt.groupBy("bucket").applyInArrow(made, CASCADES), "url-cascades")


def turns(made: DataFrame, most: int) -> list[list[int]]:
    """Buckets in groups whose filters have at most so many bytes together (a bucket alone may have more)."""
    weight = F.aggregate("filters", F.lit(0).cast("long"), lambda n, f: n + F.octet_length(f["held"]))
    groups, held = [], most + 1
    for bucket, size in sorted((r.bucket, r.size) for r in made.select("bucket", weight.alias("size")).collect()):
        if held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(bucket)
        held += size
    return groups


def with_listed(rows: DataFrame, keys: str, made: DataFrame, name: str, most: int = HELD) -> DataFrame:
    """rows with `name`: an array<boolean>, for each of the array `keys` (hashes, see hashed) whether it is listed."""
    out = rows.withColumn(name, F.transform(keys, lambda k: F.lit(False)))
    groups = turns(made, most)
    for i, group in enumerate(groups):
        some = made.where(F.col("bucket").between(group[0], group[-1])).collect()
        tables = {r.bucket: [(n, f.bits, f.probes, bytes(f.held)) for n, f in enumerate(r.filters)] for r in some}
        buckets = some[0].buckets

        def tested(batches, tables=tables, buckets=buckets):
            ready = {b: [Filter(*f) for f in filters] for b, filters in tables.items()}
            for batch in batches:
                column = batch.column(keys)
                flat = column.flatten()
                h, g = (flat.field(c).to_numpy().view(np.uint64) for c in ("h", "g"))
                was = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                now, bucket = was.astype(bool), np.mod(h.view(np.int64), buckets)
                for b in np.unique(bucket):
                    if b in ready:
                        at = bucket == b
                        now[at] = listed_in(ready[b], h[at], g[at])
                ends = pa.array(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int32))
                yield batch.set_column(batch.schema.get_field_index(name), name, pa.ListArray.from_arrays(ends, pa.array(now)))

        found = out.mapInArrow(tested, out.schema)
        if len(groups) == 1:
            return found
        out = rewritten(found, "url-turns", out) if i else written(found, "url-turns")
    return out


LOWER = [chr(c) for c in range(65, 91)], [chr(c) for c in range(97, 123)]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "".join(LOWER[0]), "".join(LOWER[1]))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host in lower case (what follows the first ://, up to /, ? or #) and the path behind it (up to ? or #); both
    empty for a null url and one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys host + path with which rules of these shapes (labels of the host, characters of the path) can fit."""
    labels = F.split(host, r"\.")
    some = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(size).alias("size")) for n, size in shapes)) if shapes else F.from_json(F.lit("[]"), "array<struct<n int, size int>>")
    fit = F.filter(some, lambda s: (s["n"] <= F.size(labels)) & (s["size"] <= F.char_length(path)))
    return F.transform(fit, lambda s: F.concat(F.array_join(F.slice(labels, F.size(labels) - s["n"] + 1, s["n"]), "."), F.substr(path, F.lit(1), s["size"])))


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, keep: list[str], url: str = "url", most: int = HELD) -> DataFrame:
    """(keep, host, path, rule, verdict) of every page, by rules (verdict, host, path) and listed hosts (key).

    A rule fits its host and all subdomains where the path starts with its own; of those that fit, the longest host + path
    wins, and block wins over allow where one is both. Without a rule pages of listed hosts are blocked, others allowed.
    A page without a host has no rule and is allowed. Rows stay as they are, repeated ones too; an empty table gives none.
    """
    shapes = sorted({(r.n, r.size) for r in rules.select(F.size(F.split("host", r"\.")).alias("n"), F.char_length("path").alias("size")).distinct().collect()})
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*keep).alias("row"), host.alias("host"), path.alias("path"))
    rows = written(rows.withColumn("keys", F.when(F.col("host") != "", candidates(F.col("host"), F.col("path"), shapes)).otherwise(F.array().cast("array<string>"))), "url-rows")
    universe = written(rows.select(F.explode("keys").alias("key")).distinct(), "url-candidates")
    hosts = rows.select(F.col("host").alias("key")).distinct()
    rows = rows.withColumn("hashes", F.transform("keys", hashed)).withColumn("own", F.array(hashed(F.col("host"))))
    for verdict in ("allow", "block"):
        keys = rules.where(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key"))
        rows = with_listed(rows, "hashes", cascades(keys, universe), verdict, most)
    rows = with_listed(rows, "own", cascades(listed, hosts), "known", most)
    found = F.filter(F.arrays_zip(F.col("keys"), F.col("allow"), F.col("block")), lambda r: r["allow"] | r["block"])
    best = F.array_max(F.transform(found, lambda r: F.struct(F.char_length(r["keys"]).alias("n"), r["keys"].alias("rule"), r["block"].alias("block"))))
    rows = rows.withColumn("best", best)
    blocked = F.coalesce(F.col("best.block"), (F.col("host") != "") & F.get("known", F.lit(0)))
    return rows.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def hosts_with_words(pages: DataFrame, words: list[str], url: str = "url") -> DataFrame:
    """(key) hosts of pages that have one of the words between dots and hyphens."""
    host, _ = host_and_path(F.col(url))
    hosts = pages.select(host.alias("key")).distinct()
    return hosts.where(F.arrays_overlap(F.split("key", "[.-]"), F.array(*map(F.lit, words))))
