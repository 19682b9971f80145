"""Mixing sources to target weights by entropy balancing.

Each document d of a source gets a rate r in (0, cap) whose relative entropy to the rate 1 of all documents is least
under the constraint that the source's expected words meet its target. The dual is convex with one variable per source:
r = cap * sigmoid(lambda * size / mean size + log(1 / (cap - 1))), an exponential tilt by size that the cap bounds.
Newton steps, kept inside a bracket, solve it for all sources at once; each step is one aggregation of a histogram
(source, size, documents), and the multipliers stay a table. Rates become whole copies per (source, size), largest size
first with the rest carried on, so a source's words end within a small document of its target. That fold sees a source's
distinct sizes, which are at most about the root of twice its words.

Documents of one size and source get their copies in order of a hash, in up to SALTS parts: no task orders more of a hot
source than one part. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.common import WORD, rewritten, written

SALTS = 1024
#: Newton steps at most, and the relative miss at which they stop. Rounding evens out what is left.
STEPS, MISS = 60, 1e-9
#: The relative miss that is an error after the last step.
FAR = 1e-3


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[int], cap: float) -> DataFrame:
    """Adds target to (k, source, source_size): weights, repeating in order of code points with null last, share the
    whole size; a target stops at cap times its source's size, and the others share the excess by weight.

    With sources in order of cap * size / weight the capped ones come first; what is left at each, per weight left, is
    the level they are held against. One row per source is sorted here, nothing else.
    """
    order, n = Window.orderBy(F.col("source").asc_nulls_last()), len(weights)
    rank = (F.row_number().over(order) - 1) % n
    each = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int"))
    s = sources.withColumn("weight", each).withColumn("most", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), "k")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))
    open_level = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct(F.col("most") / F.col("weight"), "k", "level"))
    level = F.min(open_level).over(all_rows)["level"]  # of the first source that isn't capped
    return s.withColumn("target", F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("weight")))).drop("left", "level", "most")


def multipliers(histogram: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """(k, lam): the dual's solution for each source, by distributed Newton steps."""
    share = F.least(F.greatest(F.col("target") / (F.lit(cap) * F.col("source_size")), F.lit(1e-12)), F.lit(1 - 1e-12))
    base = F.lit(cap - 1)
    first = F.when(F.col("source_size") > 0, F.log(share / (1 - share)) + F.log(base)).otherwise(0.0)
    state = written(sources.select("k", "target", first.alias("lam"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(None).cast("double").alias("miss")), "newton")
    for _ in range(STEPS):
        at = histogram.join(state, "k")
        r = rate(cap)
        got = at.groupBy("k").agg(F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.col("n") * F.col("size") * F.col("x") * r * (1 - r / cap)).alias("g"))
        got = state.join(got, "k").withColumn("over", F.col("f") - F.col("target"))
        low = F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - F.try_divide(F.col("over"), F.col("g"))
        reach = 4 * (1 + F.abs("lam"))
        step = F.greatest(F.least(F.coalesce(step, F.col("lam")), F.col("lam") + reach), F.col("lam") - reach)
        new = F.when((step > low) & (step < high), step).otherwise((F.greatest(low, F.col("lam") - reach) + F.least(high, F.col("lam") + reach)) / 2)
        miss = F.abs("over") / (1 + F.col("target"))
        state = rewritten(got.select("k", "target", F.when(miss <= MISS, F.col("lam")).otherwise(new).alias("lam"), low.alias("low"), high.alias("high"), miss.alias("miss")), "newton", state)
        miss = state.agg(F.max("miss")).first()[0] or 0
        if miss <= MISS:
            return state.select("k", "lam")
    if miss > FAR:
        raise ArithmeticError(f"after {STEPS} steps a source misses its target by {miss:g} of it")
    return state.select("k", "lam")


def rate(cap: float) -> Column:
    return F.lit(cap) / (1 + F.exp(F.log(F.lit(cap - 1.0)) - F.col("lam") * F.col("x")))


def mix(docs: DataFrame, keep: list[str], weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Columns `keep`, then size, source_size, target, rate, copies and taken (copies * size) of every document.

    Null text has size 0, null is a source of its own. Documents without words get no copies. Ties are broken by a hash
    of the key; equal rows are interchangeable. An empty table gives none. Columns of docs that are named like an output
    are replaced. 0 <= copies <= cap.
    """
    made = ("size", "source_size", "target", "rate", "copies", "taken")
    keep = [c for c in keep if c not in made]
    of = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    rows = docs.select(*keep, of.alias("__k"), F.col(source).cast("string").alias("__source"), words(text).alias("__size"), F.xxhash64(key).alias("__h"))
    rows = rows.withColumn("__salt", F.pmod("__h", F.lit(SALTS)).cast("int"))
    parts = written(rows.groupBy("__k", "__source", "__size", "__salt").agg(F.count("*").alias("n")), "mix-parts").toDF("k", "source", "size", "salt", "n")

    cells = parts.groupBy("k", "source", "size").agg(F.sum("n").alias("n"))
    sources = cells.groupBy("k", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = written(targets(sources, list(weights), float(cap)), "mix-sources")
    mean = F.col("source_size") / F.col("docs")
    histogram = cells.where("size > 0").join(sources.select("k", mean.alias("mean")), "k").select("k", "size", "n", (F.col("size") / F.col("mean")).alias("x"))
    histogram = written(histogram, "mix-histogram")
    lam = multipliers(histogram, sources.where("source_size > 0"), float(cap))

    rated = histogram.join(lam, "k").select("k", "size", "n", rate(float(cap)).alias("rate"))
    listed = rated.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("cells")).join(sources.select("k", "target"), "k")
    # largest size first; what a size takes too little or too much goes to the next
    nothing = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("c"))

    def step(acc: Column, cell: Column) -> Column:
        want = cell["rate"] * cell["n"] * cell["size"] + acc["carry"]
        c = F.least(F.greatest(F.round(want / cell["size"]).cast("long"), F.lit(0).cast("long")), F.lit(cap) * cell["n"])
        return F.struct((want - c * cell["size"]).alias("carry"), F.concat(acc["c"], F.array(c)).alias("c"))

    # in blocks of about the root of the number of sizes: a step copies a block's numbers, not all of them
    side = F.ceil(F.sqrt(F.size("cells"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), side - 1), lambda i: F.slice("cells", i * side + 1, side))
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<array<bigint>>").alias("c"))

    def block_step(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["carry"].alias("carry"), nothing["c"].alias("c")), step)
        return F.transform(F.array(done), lambda d: F.struct(d["carry"].alias("carry"), F.concat(acc["c"], F.array(d["c"])).alias("c")))[0]

    folded = F.flatten(F.aggregate(blocks, start, block_step, lambda acc: acc["c"]))
    rounded = listed.select("k", F.inline(F.arrays_zip("cells", folded.alias("c"))))
    rounded = rounded.select("k", "cells.size", "cells.rate", F.col("cells.n").alias("all"), F.col("c").alias("wanted"))

    # each part of a cell gets its share of the copies, whole numbers that add up
    upto = F.sum("n").over(Window.partitionBy("k", "size").orderBy("salt"))
    share = parts.select("k", "size", "salt", "n", upto.alias("upto")).join(rounded, ["k", "size"])
    share = share.select("k", "size", "salt", "n", "rate", F.expr("(CAST(wanted AS decimal(19,0)) * upto) div all - (CAST(wanted AS decimal(19,0)) * (upto - n)) div all").alias("c"))
    share = share.select(F.col("k").alias("__k"), F.col("size").alias("__size"), F.col("salt").alias("__salt"), "n", "rate", "c")
    each = sources.select(F.col("k").alias("__k"), "source_size", "target")
    turn = F.row_number().over(Window.partitionBy("__k", "__size", "__salt").orderBy("__h")) - 1
    out = rows.withColumn("__turn", turn).join(share, ["__k", "__size", "__salt"], "left").join(each, "__k")
    copies = F.coalesce(F.expr("c div n") + F.when(F.col("__turn") < F.col("c") % F.col("n"), 1).otherwise(0), F.lit(0)).cast("long")
    out = out.select(*keep, F.col("__size").alias("size"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The columns of docs, every document as often as the mix takes it."""
    out = mix(docs.select(F.struct("*").alias("doc"), "doc_id", "text", "source"), ["doc"], weights, cap)
    return out.select("doc", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1L, copies) ELSE array() END"))).select("doc.*")
