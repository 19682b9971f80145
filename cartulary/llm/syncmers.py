"""Document fingerprints from closed syncmers.

A text is read as units: runs without white space of at most LONG characters, cut after UNIT characters, and the single
characters of longer runs, so that no unit depends on more than LONG characters around it. A k-mer is K units in a row; it is a
closed syncmer if the smallest hash among its inner pairs of units stands at its first or last pair. Whether it is
depends on its own units alone, so equal passages get equal anchors wherever they stand, but for those in a run of at
most LONG characters at their ends. The fingerprint keeps all
anchors, each with its position; two fingerprints are matched by hash, and matches count only near the median of their
position differences.

DataFrame functions only; each text is read whole, in its row.
"""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT, K, LONG = 6, 5, 16
#: The units of a run by where they begin, each with what may follow in a run of at most LONG; else one character.
_SHORT = (rf"(?<=(?<!\S)\S{{{at}}})(?=\S{{1,{LONG - at}}}+(?!\S))\S{{1,{UNIT}}}" for at in range(0, LONG, UNIT))
UNITS = "|".join([*_SHORT, r"\S"])
#: Anchors that a fingerprint may hold: as many as an array.
SKETCH = 2**31 - 1


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row."""
    return F.transform(F.array(value), use)[0]


def anchors(text: Column) -> Column:
    """array<struct<h, p>>, by h: all anchors of a text and the unit where each first stands. A text of
    fewer than K units is one anchor, an empty one has none; of white space alone, the text is its only unit."""
    units = F.regexp_extract_all(text, F.lit(UNITS), F.lit(0))

    def of_pairs(h: Column) -> Column:  # h: hashes of pairs of neighbouring units
        kmer = lambda i: [F.get(h, i + j) for j in range(K - 1)]
        closed = lambda i: F.least(F.get(h, i), F.get(h, i + K - 2)) <= F.least(*(F.get(h, i + j) for j in range(1, K - 2)))
        at = F.filter(F.sequence(F.lit(0), F.size(h) - (K - 1)), closed)
        return F.transform(at, lambda i: F.struct(F.xxhash64(*kmer(i)).alias("h"), i.alias("p")))

    def of_units(u: Column) -> Column:
        pairs = F.zip_with(F.slice(u, 1, F.size(u) - 1), F.slice(u, 2, F.size(u) - 1), lambda a, b: F.xxhash64(a, b))
        short = F.array(F.struct(F.xxhash64(text).alias("h"), F.lit(0).alias("p")))
        empty = F.filter(short, lambda _: F.lit(False))
        return F.when(F.size(u) >= K, let(pairs, of_pairs)).when(text == "", empty).otherwise(short)

    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["h"] != x["h"]))
    return let(F.sort_array(let(units, of_units)), first)


def written_out(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.concat(F.lower(F.hex(x["h"])), F.lit(":"), x["p"].cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the matching anchors over all that both sketches hold. Two empty ones are alike."""
    of_side = lambda s, side: F.transform(s, lambda x: F.struct(x["h"], F.lit(side).alias("side"), x["p"]))
    met = lambda s: F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.size(s)), lambda x, y: F.when(x["h"] == y["h"], x["p"] - y["p"]))
    common = let(F.sort_array(F.concat(of_side(a, 0), of_side(b, 1))), met)  # equal hashes, one of each side, are neighbours
    diffs = F.sort_array(F.filter(common, lambda d: d.isNotNull()))
    reach = 16 + F.floor(F.coalesce(F.array_max(F.transform(a, lambda x: x["p"])), F.lit(0)) / 10)
    matched = let(diffs, lambda d: let(F.get(d, (F.size(d) / 2).cast("int")), lambda m: let(reach, lambda r: F.size(F.filter(d, lambda x: F.abs(x - m) <= r)))))
    return F.coalesce(F.try_divide(2.0 * matched, F.size(a) + F.size(b)), F.lit(1.0))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, fingerprint (a string: hash:position, ...) and sketch. Null text counts as empty."""
    keep = [c for c in keep if c not in ("fingerprint", "sketch")]
    got = docs.select(*keep, anchors(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("sketch"))
    return got.select(*keep, written_out(F.col("sketch")).alias("fingerprint"), "sketch")


def with_next(docs: DataFrame, text: str, values: list[str], ranges: int) -> DataFrame:
    """Adds next_text and next_<value> of the row that follows by descending doc_id; after the last comes the first.

    Ids are cut at approximate quantiles into ranges, each a window partition. The first row of each range also stands
    behind the last row of the range before it, there only to be seen (its values are null). Rows of equal ids follow
    one another in the order of a hash of their text; null ids come last.
    """
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * ranges))).first()[0] or [])) if cuts else []
    known = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")  # folded to one literal
    # how many bounds are at most an id, by bisection
    halves = F.array(*(F.lit(1 << b) for b in reversed(range(len(bounds).bit_length()))))
    below = F.aggregate(halves, F.lit(0), lambda n, h: n + F.when(F.get(known, n + h - 1) <= F.col("doc_id"), h).otherwise(0)) if bounds else F.lit(0)
    number = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(len(bounds) - below).cast("int")  # along descending ids
    rows = docs.withColumns({"__r": number, "__h": F.xxhash64(text), "__seen": F.lit(False)})
    first = F.min_by(F.col(text), F.struct(F.bitwise_not("doc_id"), "__h")).alias(text)
    heads = rows.groupBy("__r").agg(first)
    all_ranges = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("__r").over(Window.orderBy("__r")), F.last("__r").over(all_ranges))
    order = rows.select("__r").distinct().select("__r", before.alias("__before"))  # one number per range
    behind = heads.join(order, "__r").select(F.col("__before").alias("__r"), F.col(text), F.lit(True).alias("__seen"))
    by = Window.partitionBy("__r").orderBy("__seen", F.col("doc_id").desc_nulls_last(), "__h")
    both = rows.unionByName(behind, allowMissingColumns=True)
    both = both.withColumns({f"next_{c}": F.lead(c).over(by) for c in (text, *values)})
    return both.where("NOT __seen").drop("__r", "__h", "__seen")


def edited(docs: DataFrame, part_rows: int = 5_000) -> DataFrame:
    """(doc_id, n_chars, text, fingerprint, sketch, edited, edited_fingerprint, edited_sketch, next_sketch): every text
    with the edit that the contract fixes. Null text counts as empty; the only row of a table is its own next."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = max(1, -(-docs.count() // part_rows))
    rows = with_next(docs, "text", [], ranges)  # sketches are larger than texts, so they are made behind the shuffle
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    head = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int"))
    rows = rows.withColumn("edited", F.concat(head, F.substring(F.col("next_text"), F.lit(1), F.col("cut"))))
    rows = rows.withColumns({f"{c}sketch": anchors(F.col(f"{t}")) for c, t in (("", "text"), ("edited_", "edited"), ("next_", "next_text"))})
    return rows.withColumns({"fingerprint": written_out(F.col("sketch")), "edited_fingerprint": written_out(F.col("edited_sketch"))})
