"""Exact n-gram Jaccard join and its connected components.

A document is the set of its distinct k-word shingles; two link when the Jaccard similarity is at least num / den. The
links come from a metric-space join (module voronoi): pivots, Voronoi cells, windows, recursion, all exact.

Most texts share nothing, so all random pivots are at distance 1 from them. Regions for the join therefore come first
from an exact filter. Sizes form classes, with windows that put a document also into the class of
any smaller partner; in a class, shingles fall by hash into D + T segments, D being the largest possible symmetric
difference of a linked pair and T = 3 plus the empty segments that its sets may be expected to have. At least T segments
of such a pair are equal, so the pair shares the hash of one that isn't empty, or both have T empty ones, which is a
hash of its own. Holders of a hash are compared by how many
shingles fall into each of CLASSES classes: the sums of differences of two documents are a metric that never exceeds
their symmetric difference, so pairs beyond D can't link. Many holders of a hash are dealt into slices, and a task compares two
slices; each comparison takes what it reached out of the next ones. Documents left together, directly or through others, form a
region.

Of each class, a document with e < T empty segments drops the T - 1 - e hashes that most documents hold (its spare). At
least T - e hashes are shared with every partner there, and the least held of them is among the dropped ones of neither:
the other shared ones stand before it. A document with T empty segments drops nothing.

Equal sets are one node from the start. Only links that span a component leave a task, never all pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm import voronoi
from cartulary.llm.common import connected_components, sized, written

CLASSES, PAIRS = 256, 20_000
#: Holders of a hash in a slice, about; a task compares two. Buckets of more rows than WIDE are searched row by row.
HOLDERS, WIDE = 4000, 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; fewer than k words are one shingle; none: empty."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(each) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mixed(h * _A + each[i : n + i])
    return np.unique(h)


class Segments:
    """Segment hashes of sets, for links of similarity num / den at least."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * 13 // 10))
        self.lows = np.array(self.lows)
        self.equal: dict[int, int] = {}

    def least_equal(self, c: int, most: int) -> int:
        """T of class c: 3, and more where its smallest sets would often leave that many of most + T segments empty."""
        if c not in self.equal:
            t = np.arange(3, most + 6)
            m = most + t
            mean = m * (1 - 1 / m) ** float(self.lows[c])
            rare = np.flatnonzero(t - 0.5 - mean >= 3 * np.sqrt(mean))
            self.equal[c] = int(t[rare[0]]) if len(rare) else 3
        return self.equal[c]

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes, and for each a tag: its class among those of the set, and the hashes to spare there (16 bits)."""
        n, out, tags = len(s), [], []
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s))])
        least = -(-n * self.num // self.den)
        first, last = np.searchsorted(self.lows, [least, n], "right") - 1
        for c in range(first, last + 1):
            most = (int(self.lows[c + 1]) - 1) * (self.den - self.num) // self.num
            if not most:
                continue  # only equal sets link
            t = self.least_equal(c, most)
            m = most + t
            at = np.searchsorted(s, (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64))
            at = np.concatenate([[0], at, [n]])
            filled = at[1:] > at[:-1]
            key = np.array([c], np.uint64) * _A
            parts = sums[at[1:]] - sums[at[:-1]] + key + np.arange(1, m + 1, dtype=np.uint64) * _C
            out.append(mixed(parts[filled]))
            empty = m - int(filled.sum())
            if empty >= t:
                out.append(mixed(key))
            tags.append(np.full(sum(map(len, out)) - sum(map(len, tags)), (c - first) << 16 | min(max(t - 1 - empty, 0), 0xFFFF), np.int32))
        return (np.concatenate(out), np.concatenate(tags)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def digest(s: np.ndarray) -> int:
    """A set's 64-bit hash, by which equal sets are one."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def class_counts(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


def leaders(bucket: np.ndarray, sizes: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """For rows sorted by bucket: the first row that each is connected with by pairs of its bucket that may link."""
    label, n = np.arange(len(bucket)), len(bucket)
    widest = np.diff(np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])).max(initial=1)
    left, right = [], []
    for k in range(1, int(widest)):
        i = np.flatnonzero(bucket[: n - k] == bucket[k:])
        low, high = np.minimum(sizes[i], sizes[i + k]), np.maximum(sizes[i], sizes[i + k])
        i = i[den * low >= num * high]
        for part in np.split(i, range(PAIRS, len(i), PAIRS)):
            apart = np.abs(counts[part] - counts[part + k]).sum(1, dtype=np.int64)
            part = part[(den + num) * apart <= (den - num) * (sizes[part] + sizes[part + k])]
            left.append(part)
            right.append(part + k)
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def reached(side: np.ndarray, sizes: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """For rows of one bucket: the first row that each is connected with by pairs that may link. Rows of sides 1 and 2
    are compared with the other side only. Rows that were reached are not compared again, so near copies, which one row
    reaches, take a number of comparisons that grows with their number, not with its square."""
    of = np.arange(len(side))
    left = np.ones(len(side), bool)
    for root in range(len(side)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(left & ((side != side[i]) | (side == 0)) & (den * np.minimum(sizes, sizes[i]) >= num * np.maximum(sizes, sizes[i])))
            for part in np.split(near, range(PAIRS, len(near), PAIRS)):
                apart = np.abs(counts[part] - counts[i]).sum(1, dtype=np.int64)
                part = part[(den + num) * apart <= (den - num) * (sizes[part] + sizes[i])]
                left[part] = False
                of[part] = root
                todo += part.tolist()
    return of


def stars_of(num: int, den: int):
    """Of rows (segment, side, node, n_shingles, counts) in order of segment: (a, b), edges that connect what may link."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: pa.Table) -> pa.RecordBatch:
            node = rows.column("node").to_numpy()
            counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16)
            bucket, side, sizes = (rows.column(c).to_numpy() for c in ("segment", "side", "n_shingles"))
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            wide = np.diff(cuts) > WIDE
            few = np.flatnonzero(np.repeat(~wide, np.diff(cuts)))
            of = np.arange(len(bucket))
            of[few] = few[leaders(bucket[few], sizes[few], counts[few], num, den)]
            for low, high in zip(cuts[:-1][wide], cuts[1:][wide], strict=True):
                of[low:high] = low + reached(side[low:high], sizes[low:high], counts[low:high], num, den)
            pairs = np.stack([node, node[of]])[:, of != np.arange(len(of))]
            pairs = np.unique(pairs, axis=1)
            return pa.RecordBatch.from_pydict({"a": pairs[0], "b": pairs[1]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            segment = held.column("segment").to_numpy()
            done = int(np.searchsorted(segment, segment[-1])) if len(segment) else 0
            if done:
                yield edges(held.slice(0, done))
                held = held.slice(done).combine_chunks()
        if held is not None and held.num_rows:
            yield edges(held)

    return stars


def profiles(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, node, counts, segments, tags): size, hash, class counts and segments of each set. A set that
    the same task has met before, an empty one and that of a null doc_id get no segments."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, met = Segments(num, den), set()
        nothing = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        for batch in batches:
            sets = [shingles(t, k) for t in batch.column("text").to_pylist()]
            nodes, found = [digest(s) for s in sets], []
            for doc_id, s, node in zip(batch.column("doc_id").to_pylist(), sets, nodes, strict=True):
                found.append(nothing if doc_id is None or node in met else segments.of(s))
                if doc_id is not None:
                    met.add(node)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f, _ in found])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *(f for f, _ in found)]).view(np.int64)
            tags = np.concatenate([np.zeros(0, np.int32), *(t for _, t in found)])
            columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64())]
            columns += [pa.array([class_counts(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, values), pa.ListArray.from_arrays(offsets, tags)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "counts", "segments", "tags"])

    return docs.mapInArrow(profiled, "doc_id long, n_shingles long, node long, counts binary, segments array<long>, tags array<int>")


def dealt_holders(kept: DataFrame, most: int) -> DataFrame:
    """(node, segment, side) of (node, held_by, holders): buckets of bounded size, in which all pairs of holders
    meet. Up to `most` holders are one bucket; more are dealt into slices, and each two slices are one, with sides 1
    and 2. Side 0 is compared with all."""
    rows = kept.select("node", "held_by", F.ceil(F.col("holders") / most).cast("int").alias("g")).distinct()
    rows = rows.withColumn("i", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    bucket = F.when(F.col("g") == 1, F.col("held_by")).otherwise(F.xxhash64("held_by", "g", F.least("i", "j"), F.greatest("i", "j")))
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("byte")
    return rows.select("node", bucket.alias("segment"), side.alias("side"))


def components(docs: DataFrame, k: int, num: int, den: int, slice_holders: int = HOLDERS, **sizes: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document of (doc_id, text).

    component_id is the smallest doc_id that links reach. Null or wordless text has the empty set, linked with nothing.
    Rows with a null doc_id link with nothing and get a null component_id. Repeated rows come out as often as they come
    in; different texts of one doc_id each have their own set and component. An empty table gives none. Shingles and
    whole sets are told apart by 64-bit hashes. sizes: of pivots, leaf and slice_docs, see voronoi.joined.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(profiles(docs, k, num, den), "profiles")
    real = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = real.groupBy("node").agg(F.min("doc_id").alias("first"))
    rows = real.select("node", F.explode(F.arrays_zip("segments", "tags")).alias("s")).select("node", F.col("s.segments").alias("segment"), F.col("s.tags").alias("tag"))
    # A set may come from several tasks: its copies count as holders, alike for all of a segment, and are left out after
    same, h = Window.partitionBy("segment"), F.xxhash64("node")
    held_by = F.xxhash64(F.sum(h.bitwiseAND(0xFFFFFFFF)).over(same), F.sum(F.shiftright(h, 32)).over(same))
    held = rows.withColumns({"holders": F.count("*").over(same), "held_by": held_by, "several": F.min("node").over(same) != F.max("node").over(same)})
    shared = written(held.where("several").drop("segment", "several"), "shared")
    place = F.row_number().over(Window.partitionBy("node", "tag").orderBy(F.desc("holders"), "held_by"))
    kept = shared.repartition("node").withColumn("place", place).where(F.col("place") > F.col("tag").bitwiseAND(0xFFFF))
    # Segments with the same holders say the same: one of each stays. Those whose hashes meet are compared together.
    counted = dealt_holders(kept, slice_holders).join(real.select("node", "n_shingles", "counts").dropDuplicates(["node"]), "node")
    ordered = counted.repartition("segment").sortWithinPartitions("segment", "node")
    stars = ordered.mapInArrow(stars_of(num, den), "a long, b long").distinct()
    regions = written(connected_components(stars, "regions").join(first, "node").select(F.col("component").alias("region"), "node", F.col("first").alias("doc_id")), "regions")

    def sets_of(texts: list[str | None]) -> tuple[list[np.ndarray], list[int]]:
        sets = [shingles(t, k) for t in texts]
        return sets, [digest(s) for s in sets]

    edges = voronoi.joined(docs, regions, sets_of, num, den, **sizes)
    found = written(connected_components(edges.select("a", "b"), "links").join(first, "node"), "found")
    least = found.groupBy("component").agg(F.min("first").alias("least"))
    of_set = found.join(least, "component").select("node", "least", F.lit(True).alias("linked"))
    keyed = own.select("doc_id", "n_shingles", "node", F.expr("n_shingles > 0 AND doc_id IS NOT NULL").alias("linked"))
    copies = first.select("node", "first", F.lit(True).alias("linked"))
    out = keyed.join(copies, ["node", "linked"], "left").join(of_set, ["node", "linked"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "first", "doc_id").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The columns of docs; of each component only the document with the smallest doc_id stays, once if its row is
    repeated (each of its texts, if it has several; one that has a component of its own keeps the others). Documents with a null doc_id stay."""
    of_id = components(docs, k, num, den).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = written(of_id.where("NOT stays").select("doc_id"), "gone")
    twice = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "twice")
    left = docs.join(sized(gone), "doc_id", "left_anti")
    once, more = left.join(sized(twice), "doc_id", "left_anti"), left.join(sized(twice), "doc_id", "left_semi")
    return once.unionByName(more.dropDuplicates(["doc_id", "text"])).select(*docs.columns)
