"""The Jaccard join of regions in metric space: pivots, Voronoi cells, windows by the triangle inequality, recursion.

Jaccard distance is a metric; documents link at a distance of eps at most. At each level every large cell gets pivots, and
all its documents learn their distances to them (Spark rows: cell, slice, document beside cell, slice, pivot). Links with
pivots are found there, exactly, so pivots are done. A document's home is the cell of its nearest pivot; with no pivot
nearer than 1 - eps it is the far cell. A partner of a document at home in a pivot's cell lies

    within least + 2 * eps of that pivot, least being the partner's distance to its own nearest one, and within 1,

so it enters that cell as a visitor, and every linked pair meets in a cell where one of the two is at home. Cells join
recursively; those of at most LEAF documents in one task, by the same rule.

Documents that links have connected need no second look: pivots come first from those outside a cell's largest connected
part, and a cell that has no more than PIVOTS of them is done once these are pivots, so a large group of near copies takes
work in proportion to its size. Cells that don't shrink are dealt into slices joined two by two, but for pairs of slices
of the same connected part. Only links that span a connected part are found, never all pairs.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.common import connected_components, sized, written

#: Pivots of a cell at each level (for cells above MANY documents more, with the root of their number), documents of a
#: cell that one task joins, and of a slice.
PIVOTS, MANY, LEAF, SLICE = 64, 4096, 1500, 1500
#: Levels at most, and what a cell's children may hold of it, the largest and all together: beyond, slices join it.
LEVELS, LARGEST, ALL = 16, 0.9, 3.0
#: A cell stays whole for the next level if no more than this share of the others is left outside its largest part.
PEELED = 0.6
#: Inside a task: pivots, and documents that are compared all with all.
LOCAL_PIVOTS, FEW = 16, 48
#: Slack for distances as floating-point numbers.
SLACK = 1e-6


def intersections(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each of sets with each of others."""
    universe = np.unique(np.concatenate([np.zeros(0, np.uint64), *others]))
    both = [np.concatenate([np.zeros(0, np.uint64), *x]) for x in (sets, others)]
    at = [np.searchsorted(universe, b) for b in both]
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (sets, others)]
    held = [np.flatnonzero((i < len(universe)) & (universe[np.minimum(i, len(universe) - 1)] == b)) if len(universe) else np.zeros(0, int) for i, b in zip(at, both, strict=True)]
    columns = np.bincount(at[0][held[0]], minlength=len(universe)) > 0
    number = np.cumsum(columns) - 1
    out = np.zeros((len(sets), len(others)), np.float32)
    for low in range(0, int(columns.sum()), 4096):
        part = []
        for k, x in enumerate((sets, others)):
            col = at[k][held[k]]
            ok = columns[col] & (number[col] >= low) & (number[col] < low + 4096)
            m = np.zeros((len(x), 4096), np.float32)
            m[rows[k][held[k]][ok], number[col[ok]] - low] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out.astype(np.int64)


def measured(sets: list[np.ndarray], pivots: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents x pivots): which are linked, and the distances."""
    inter = intersections(sets, pivots)
    union = np.array([len(s) for s in sets], np.int64)[:, None] + np.array([len(s) for s in pivots], np.int64)[None, :] - inter
    return den * inter >= num * union, 1 - inter / union


def cells_of(distance: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each document (the number of pivots: the far cell), and whom each cell, the far one last, holds."""
    least = distance.min(1)
    home = np.where(least > 1 - eps - 2 * SLACK, distance.shape[1], distance.argmin(1))
    holds = distance <= np.minimum(least + 2 * eps, 1 - 2 * SLACK)[:, None] + SLACK
    holds = np.concatenate([holds, (home == distance.shape[1])[:, None]], 1)
    return home, holds


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            a = todo.pop()
            near = np.flatnonzero(linked[a] & left)
            left[near] = False
            out += [(a, int(b)) for b in near]
            todo += near.tolist()
    return out


def direct(index: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that span the connected parts of index, found by comparing all."""
    mine = [sets[i] for i in index]
    _, back, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *mine]), return_inverse=True, return_counts=True)
    kept = [s[k] for s, k in zip(mine, np.split(held[back] > 1, np.cumsum([len(s) for s in mine])[:-1]), strict=True)]  # others meet no one
    inter = intersections(kept, kept)
    sizes = np.array([len(s) for s in mine], np.int64)
    return [(int(index[a]), int(index[b])) for a, b in spanning(den * inter >= num * (sizes[:, None] + sizes[None, :] - inter))]


class Local:
    """Links that span the connected parts of sets, all in one task. splits: cells that were split."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, few: int = FEW, pivots: int = LOCAL_PIVOTS):
        self.sets, self.num, self.den, self.few, self.pivots = sets, num, den, few, pivots
        self.eps, self.splits, self.links = 1 - num / den, 0, []
        self.part = np.arange(len(sets))
        self.join(np.arange(len(sets)))

    def link(self, pairs: list[tuple[int, int]]) -> None:
        for a, b in pairs:
            x, y = self.part[a], self.part[b]
            if x != y:
                self.part[self.part == max(x, y)] = min(x, y)
                self.links.append((a, b))

    def join(self, index: np.ndarray) -> None:
        while len(index) > self.few:
            values, counts = np.unique(self.part[index], return_counts=True)
            if len(values) == 1:
                return
            main = self.part[index] == values[counts.argmax()]
            index = index[np.argsort(main, kind="stable")]
            others = int((~main).sum())
            chosen = index[: self.pivots] if others <= self.pivots else index[np.linspace(0, others - 1, self.pivots).astype(int)]
            linked, distance = measured([self.sets[i] for i in index], [self.sets[i] for i in chosen], self.num, self.den)
            for k, p in enumerate(chosen):
                self.link([(int(p), int(i)) for i in index[linked[:, k]]])
            if others <= self.pivots:
                return  # all outside the largest part have met everyone
            rest = ~np.isin(index, chosen)
            index, distance = index[rest], distance[rest]
            part = self.part[index]
            values, counts = np.unique(part, return_counts=True)
            if len(index) - counts.max(initial=0) <= self.pivots:
                continue  # the others are the next pivots
            home, holds = cells_of(distance, self.eps)
            children = []
            for k in range(holds.shape[1]):
                at_home = part[home == k]
                held = holds[:, k]
                if len(at_home) and (at_home == at_home[0]).all():
                    held = held & ((home == k) | (part != at_home[0]))
                if len(at_home) and held.sum() > 1 and len(np.unique(part[held])) > 1:
                    children.append(index[held])
            if children and (max(map(len, children)) > LARGEST * len(index) or sum(map(len, children)) > ALL * len(index)):
                break
            self.splits += 1
            for child in children:
                self.join(child)
            return
        if len(index) > 1:
            self.link(direct(index, self.sets, self.num, self.den))


EDGES = "a long, b long, how string"


def joined(docs: DataFrame, regions: DataFrame, sets_of, num: int, den: int, pivots: int = PIVOTS, leaf: int = LEAF, slice_docs: int = SLICE) -> DataFrame:
    """(a, b, how): links that span the connected parts of every region. docs: (doc_id, text); regions: (region, node,
    doc_id), node being the digest of a set and doc_id a document that has it; sets_of: texts to sorted arrays and digests.

    how says where a link was found: 'pivot <level>', 'cell' (in one task) or 'slices'. Rows of docs whose set isn't the
    node's (other texts of the same doc_id) are left out.
    """
    eps, columns = 1 - num / den, ["cell", "node", "doc_id"]
    cells = regions.withColumnRenamed("region", "cell").select(*columns, F.col("node").alias("part"))
    ids = written(cells.select("doc_id").distinct(), "region-ids")
    docs = written(docs.join(sized(ids), "doc_id", "left_semi"), "region-texts")
    found, leaves, pairs, level = [], [], [], 0
    while True:
        by = Window.partitionBy("cell")
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
        leaves.append(cells.join(sizes.where(f"n <= {leaf}"), "cell", "left_semi").select(*columns))
        if not (sizes.agg(F.max("n")).first()[0] or 0) > leaf:
            break
        large = cells.join(sizes.where(f"n > {leaf}"), "cell")
        largest = large.groupBy("cell", "part").agg(F.count("*").alias("m")).groupBy("cell").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.max("m").alias("m"))
        large = large.join(largest, "cell").withColumns({"main": F.col("part") == F.col("largest"), "others": F.col("n") - F.col("m")}).where("others > 0")
        large = large.withColumn("p", F.ceil(pivots * F.sqrt(F.greatest(F.col("n") / MANY, F.lit(1.0)))).cast("long"))
        large = written(large.drop("largest", "m"), "large")
        if level >= LEVELS:
            pairs.append(large.select(*columns, "main"))
            break
        # pivots: by hash, those outside the largest part first; found part by part, so no task orders a whole cell
        u = F.struct("main", F.xxhash64("node", F.lit(level)), "node")
        near = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / 10_000)))
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("cell", "salt").orderBy(u))).where("r <= p")
        chosen = near.withColumn("r", F.row_number().over(by.orderBy(u))).where("r <= p")
        slices = F.ceil(F.col("n") / slice_docs).cast("int")
        chosen = chosen.select("cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("i"), "node", "doc_id")
        dealt = large.withColumn("i", F.pmod(F.xxhash64("node", F.lit("slice")), slices).cast("int"))
        left = docs.join(dealt.hint("shuffle_hash"), "doc_id").select(*columns, "i", "part", "main", "others", "p", "text")
        right = docs.join(chosen.hint("shuffle_hash"), "doc_id").select("cell", "i", "node", "text").toDF("cell", "i", "node", "text")
        schema = "cell long, node long, doc_id long, part long, main boolean, others long, p long, pivot boolean, home int, holds array<int>, linked array<long>"

        def placed(group: pa.Table, beside: pa.Table) -> pa.Table:
            rows, sets = whole(group, sets_of)
            about, theirs = whole(beside, sets_of)
            names = about.column("node").to_pylist()
            links, distance = measured(sets, theirs, num, den) if sets and theirs else (np.zeros((len(sets), 0), bool), np.ones((len(sets), 1)))
            home, holds = cells_of(distance, eps)
            pivot = np.isin(rows.column("node").to_numpy(), np.array(names, np.int64))
            own = rows.column("node").to_pylist()
            made = [
                pa.array(pivot), pa.array(home, pa.int32()), pa.array([np.flatnonzero(h).tolist() for h in holds], pa.list_(pa.int32())),
                pa.array([[names[k] for k in ks] for ks in pivots_met(links, [names.index(me) if p else None for me, p in zip(own, pivot, strict=True)])], pa.list_(pa.int64())),
            ]
            kept = [rows.column(c) for c in ("cell", "node", "doc_id", "part", "main", "others", "p")]
            return pa.Table.from_arrays([*kept, *made], names=schema.replace(",", "").split()[::2])

        seen = written(left.groupBy("cell", "i").cogroup(right.groupBy("cell", "i")).applyInArrow(placed, schema), "placed")
        level += 1
        found.append(seen.select(F.col("node").alias("a"), F.explode("linked").alias("b"), F.lit(f"pivot {level}").alias("how")))
        rest = seen.where("others > p AND NOT pivot")
        if rest.isEmpty():
            break
        parts = connected_components(union(found).select("a", "b"), "parts")
        rest = rest.drop("part", "main").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        counts = rest.groupBy("cell", "part").agg(F.count("*").alias("m")).groupBy("cell").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.sum("m").alias("n"), (F.sum("m") - F.max("m")).alias("out"))
        rest = written(rest.join(counts, "cell").where("out > 0"), "rest")
        # pivots that reached many of the others are worth repeating; what is then outside the largest part comes first
        peeled = F.col("out") <= F.greatest(F.col("p"), PEELED * F.col("others"))
        again = rest.where(peeled).select(*columns, "part")  # the others are the next pivots
        child = F.xxhash64("cell", F.lit(level), "k")
        split = rest.where(~peeled).withColumn("k", F.explode("holds")).withColumn("at_home", F.col("k") == F.col("home"))
        homes = split.where("at_home").groupBy("cell", "k").agg(F.min("part").alias("from"), F.max("part").alias("upto"))
        split = split.join(homes, ["cell", "k"]).where("at_home OR `from` <> upto OR part <> `from`")
        shrunk = split.groupBy("cell", "k").agg(F.count("*").alias("c"), F.max("n").alias("n")).groupBy("cell").agg(F.max("c").alias("c"), F.sum("c").alias("s"), F.max("n").alias("n"))
        stuck = shrunk.where((F.col("c") > LARGEST * F.col("n")) | (F.col("s") > ALL * F.col("n"))).select("cell")
        pairs.append(rest.where(~peeled).join(stuck, "cell", "left_semi").select(*columns, (F.col("part") == F.col("largest")).alias("main")))
        split = split.join(stuck, "cell", "left_anti").select(child.alias("cell"), "node", "doc_id", "part")
        cells = written(again.unionByName(split), "cells")

    def leaf_links(group: pa.Table) -> pa.Table:
        rows, sets = whole(group, sets_of)
        names = rows.column("node").to_pylist()
        return edges([(names[a], names[b]) for a, b in Local(sets, num, den).links], "cell")

    met = docs.join(union(leaves).hint("shuffle_hash"), "doc_id").select("cell", "node", "text")
    found.append(met.groupBy("cell").applyInArrow(leaf_links, EDGES))
    if pairs:
        found.append(by_slices(docs, written(union(pairs), "stuck"), sets_of, num, den, slice_docs))
    return union(found)


def pivots_met(links: np.ndarray, selves: list[int | None]) -> list[list[int]]:
    """For each row of links (rows x pivots) pivots that connect what all its links connect: a row's first one, and those
    that no earlier row has connected with it; in all at most rows + pivots of them. `selves` are rows' own pivots."""
    group, left, out = list(range(links.shape[1])), links.shape[1] - 1, []

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for row, own in zip(links, selves, strict=True):
        first = own if own is not None else int(row.argmax()) if row.any() else None
        kept = [first] if first is not None and own is None else []
        if left and first is not None:
            for k in np.flatnonzero(row):
                a, b = top(first), top(int(k))
                if a != b:
                    group[b] = a
                    left -= 1
                    kept.append(int(k))
        out.append(kept)
    return out


def by_slices(docs: DataFrame, rows: DataFrame, sets_of, num: int, den: int, slice_docs: int) -> DataFrame:
    """EDGES of cells that pivots don't split: their documents in slices, of one connected part (main) or of the others;
    each two slices are a task, but those of two main ones."""
    sizes = rows.groupBy("cell").agg(F.greatest(F.ceil(F.count_if(~F.col("main")) / slice_docs), F.lit(1)).cast("int").alias("g"), F.ceil(F.count_if("main") / slice_docs).cast("int").alias("h"))
    part = F.pmod(F.xxhash64("node", F.lit("pair")), F.when(F.col("main"), F.col("h")).otherwise(F.col("g"))).cast("int")
    dealt = rows.join(sizes, "cell").withColumn("i", F.when(F.col("main"), F.col("g") + part).otherwise(part))
    partners = F.sequence(F.lit(0), F.when(F.col("main"), F.col("g")).otherwise(F.col("g") + F.col("h")) - 1)
    tasks = dealt.withColumn("j", F.explode(partners)).select("cell", "node", "doc_id", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"))

    def pair_links(group: pa.Table) -> pa.Table:
        kept, sets = whole(group, sets_of)
        names = kept.column("node").to_pylist()
        return edges([(names[a], names[b]) for a, b in direct(np.arange(len(sets)), sets, num, den)], "slices")

    met = docs.join(tasks.hint("shuffle_hash"), "doc_id").select("cell", "node", "x", "y", "text")
    return met.groupBy("cell", "x", "y").applyInArrow(pair_links, EDGES)


def whole(group: pa.Table, sets_of) -> tuple[pa.Table, list[np.ndarray]]:
    """Of rows (node, text), in order of node, those whose text has the set that the node is, once each; and the sets."""
    group = group.sort_by("node")
    sets, digests = sets_of(group.column("text").to_pylist())
    node = group.column("node").to_numpy()
    good = np.flatnonzero(np.array(digests, np.int64) == node)
    good = good[np.r_[True, node[good][1:] != node[good][:-1]]] if len(good) else good
    return group.take(pa.array(good)), [sets[i] for i in good]


def edges(pairs: list[tuple[int, int]], how: str) -> pa.Table:
    return pa.Table.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "how": [how] * len(pairs)}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("how", pa.string())]))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
