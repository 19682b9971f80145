"""Ranked lexical search over posting lists cut into blocks of similar documents; blocks are skipped by exact bounds.

Documents are indexed in shards of bounded size, so a term that every document holds is a list in every shard and no key
gathers a corpus. In a shard each term's posting list is clustered: documents go to the most similar of some of the list's
own, and each group is a block with a summary, the largest value that any of its documents has for each term. A query's
bound for a block is its weights times the summary. Blocks are opened from the highest bound down, and all whose bound is
below the tenth best score so far are skipped: what they hold scores less.

Terms are those that queries ask for, so documents keep a bounded vocabulary; summaries hold the terms that some query asks
for together with the list's own. Queries are taken in slices that bound both.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.common import small, written
from cartulary.llm.urls import lower_ascii

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 text with A-Z in lower case and all that is in no term as blanks.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms of a slice of queries at most, counted once for each query; one query alone may have more.
TERMS = 1 << 15
#: Documents times terms of a shard at most (4 bytes each), documents of a block on average, numbers of a sketch.
CELLS, BLOCK, SKETCH = 1 << 22, 64, 32
TOP = 10

COUNTED = "n long, terms array<int>, counts array<long>"
COLUMNS = ("ends", "terms", "values", "lists", "sizes", "docs", "summaries")
SHARD = "ends binary, terms binary, values binary, lists binary, sizes binary, docs binary, summaries binary"


class Asked:
    """A slice of queries: their terms by number, each query's terms in order of weight once that is known, and for each
    term those that a query asks for with it."""

    def __init__(self, queries: list[list[str]]):
        self.terms = sorted({t for q in queries for t in q})
        number = {t: i for i, t in enumerate(self.terms)}
        self.queries = [np.array(sorted(number[t] for t in q), np.int32) for q in queries]
        beside = [set() for _ in self.terms]
        for q in self.queries:
            for t in q:
                beside[t].update(q.tolist())
        self.beside = [np.array(sorted(b), np.int32) for b in beside]

    def weigh(self, weight: np.ndarray) -> None:
        self.plans = []
        for q in self.queries:
            q = q[np.argsort(-weight[q], kind="stable")]
            self.plans.append((q, weight[q], [np.searchsorted(self.beside[t], q[i:]) for i, t in enumerate(q)]))


def counted(docs: DataFrame, keep: list[str], text: str, asked: Asked) -> DataFrame:
    """(row, n, terms, counts) of documents with a term: their terms in all, and which of those asked for how often."""
    number = {t.encode(): i for i, t in enumerate(asked.terms)}
    rows = docs.where(F.col(text).isNotNull()).select(F.struct(*keep).alias("row"), F.col(text).cast("binary").alias("text"))

    def counts(batches):
        for batch in small(batches):
            n, terms, times = [], [], []
            for data in batch.column("text"):
                held, found = data.as_py().translate(BYTES).split(), {}
                for word in held:
                    at = number.get(word)
                    if at is not None:
                        found[at] = found.get(at, 0) + 1
                n.append(len(held))
                terms.append(list(found))
                times.append(list(found.values()))
            out = pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["row", "n", "terms", "counts"])
            yield out.filter(pa.array([k > 0 for k in n]))

    return written(rows.mapInArrow(counts, f"row {rows.schema['row'].dataType.simpleString()}, {COUNTED}"), "search-counts")


def matrix(docs: int, terms: int, ends: np.ndarray, which: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((docs, terms), np.int32)
    out[np.repeat(np.arange(docs), np.diff(ends, prepend=0)), which] = values
    return out


def clustered(held: np.ndarray, sketch: np.ndarray) -> list[np.ndarray]:
    """A posting list's documents in blocks: each beside the most similar of some of them, evenly chosen."""
    n = -(-len(held) // BLOCK)
    if n == 1:
        return [held]
    own = sketch[held]
    to = (own @ own[:: len(held) // n][:n].T).argmax(1)
    order = np.argsort(to, kind="stable")
    return [b for b in np.split(held[order], np.cumsum(np.bincount(to, minlength=n))[:-1]) if len(b)]


def shard_of(n: list, which: list, counts: list, totals: tuple[int, int], asked: Asked) -> dict[str, np.ndarray]:
    """A shard (SHARD): documents' values by term, each list's blocks, each block's documents and summary."""
    size = np.array([len(w) for w in which])
    ends, terms, tf = np.cumsum(size), np.concatenate(which), np.concatenate(counts)
    m = np.array([10 + 90 * k * totals[0] // totals[1] for k in n], np.int64)
    values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, size))
    table = matrix(len(n), len(asked.terms), ends, terms, values)
    signs = np.random.default_rng(0).choice(np.array([-1, 1], np.float32), (len(asked.terms), SKETCH))
    sketch = table.astype(np.float32) @ signs
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    by_term = np.argsort(terms, kind="stable")
    doc = np.repeat(np.arange(len(n)), size)[by_term]
    bounds = np.searchsorted(terms[by_term], np.arange(len(asked.terms) + 1))
    lists, sizes, docs, summaries = [], [], [], []
    for t, beside in enumerate(asked.beside):
        held = doc[bounds[t] : bounds[t + 1]]
        if len(held):
            blocks = clustered(held, sketch)
            order, starts = np.concatenate(blocks), np.cumsum([0] + [len(b) for b in blocks[:-1]])
            lists.append((t, len(blocks)))
            sizes += [len(b) for b in blocks]
            docs.append(order)
            summaries.append(np.maximum.reduceat(table[np.ix_(order, beside)], starts, axis=0).ravel())
    held = (ends, terms, values, np.array(lists), np.array(sizes), np.concatenate(docs), np.concatenate(summaries))
    return {c: np.ascontiguousarray(a, np.int32) for c, a in zip(COLUMNS, held, strict=True)}


def shards(batches, totals: tuple[int, int], asked: Asked):
    """(shard, keys) of counted documents, one shard at a time in memory; keys are their `row`s in order."""
    most = max(1, CELLS // max(1, len(asked.terms)))
    n, which, counts, rows = [], [], [], []
    for batch in small(batches, most):
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, most - len(n))
            n += some.column("n").to_pylist()
            which += [np.array(x, np.int32) for x in some.column("terms").to_pylist()]
            counts += [np.array(x, np.int64) for x in some.column("counts").to_pylist()]
            rows.append(some.column("row"))
            at += some.num_rows
            if len(n) == most:
                yield shard_of(n, which, counts, totals, asked), pa.concat_arrays(rows)
                n, which, counts, rows = [], [], [], []
    if n:
        yield shard_of(n, which, counts, totals, asked), pa.concat_arrays(rows)


def index(postings: DataFrame, totals: tuple[int, int], asked: Asked) -> DataFrame:
    """Shards as a table (SHARD, and `rows` in order), for searching more than once with other weights or numbers."""

    def packed(batches):
        for shard, held in shards(batches, totals, asked):
            data = [pa.array([shard[c].tobytes()], pa.binary()) for c in COLUMNS]
            data.append(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held))
            yield pa.RecordBatch.from_arrays(data, [*COLUMNS, "rows"])

    found = postings.where(F.size("terms") > 0).mapInArrow(packed, f"{SHARD}, rows array<{postings.schema['row'].dataType.simpleString()}>")
    return written(found, "search-index")


def unpacked(batches):
    """(shard, keys) of an index table's rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in COLUMNS}, batch.column("rows").slice(i, 1).flatten()


class Best:
    """The best documents of a query so far: score, key (None last), in order."""

    def __init__(self):
        self.rows, self.least = [], 1

    def add(self, rows: list[tuple[int, bool, object]], top: int) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1], 0 if r[1] else r[2]))[:top]
        if len(self.rows) == top:
            self.least = max(1, self.rows[-1][0])


def searched_shard(shard: dict[str, np.ndarray], keys: pa.Array, asked: Asked, best: list[Best], top: int) -> int:
    """Adds a shard's documents to the best of each query; returns how many blocks were opened."""
    ends, which, values, lists, sizes, docs, summaries = (shard[c] for c in COLUMNS)
    table = matrix(len(ends), len(asked.terms), ends, which, values)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    summary, first, at, block = {}, {}, 0, 0
    for t, n in lists.reshape(-1, 2).tolist():
        width = len(asked.beside[t])
        summary[t], first[t] = summaries[at : at + n * width].reshape(n, width), block
        at, block = at + n * width, block + n
    opened = 0
    for found, (terms, weights, places) in zip(best, asked.plans, strict=True):
        # A document counts in the list of its first term alone, so a list's bound leaves out the terms before it
        bounds = [(summary[t][:, place] @ weights[i:], first[t]) for i, (t, place) in enumerate(zip(terms.tolist(), places, strict=True)) if t in summary]
        if not bounds:
            continue
        bound, block = np.concatenate([b for b, _ in bounds]), np.concatenate([f + np.arange(len(b)) for b, f in bounds])
        order = np.argsort(-bound, kind="stable")
        seen, at, step = np.zeros(len(ends), bool), 0, 4
        while at < len(order) and bound[order[at]] >= found.least:
            some = order[at : at + step]
            some = block[some[bound[some] >= found.least]]
            opened += len(some)
            held = np.unique(np.concatenate([docs[firsts[b] : firsts[b + 1]] for b in some]))
            held = held[~seen[held]]
            seen[held] = True
            scores = table[np.ix_(held, terms)] @ weights
            good = np.flatnonzero(scores >= found.least)
            if len(good) > top:  # ties with the last of the top stay
                good = good[scores[good] >= np.partition(scores[good], -top)[-top]]
            ids = keys.take(pa.array(held[good])).to_pylist()
            found.add([(int(s), key is None, key) for s, key in zip(scores[good], ids, strict=True)], top)
            at, step = at + step, step * 2
    return opened


def search(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", top: int = TOP, most: int = TERMS) -> DataFrame:
    """(item, rank, doc, score) of each item's best documents; formulas as below.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))) and a document's value for it 10^9 tf div (1000 tf + 8 m),
    m = 10 + (90 n N div L). N counts the documents with a term, L their terms, n one's terms, df the documents with the
    term, tf its occurrences. Scores sum weight times value over the item's terms, once each; those above 0 rank, equal
    ones by ascending key (null last). Documents' rows count one by one, repeated ones too. Rows of one item, or without
    an item, are one query with the terms of all. Null and empty texts have no terms; empty tables give no rows.
    """
    terms = items.select(F.col(item).alias("item"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"({TERM})"), 1)).alias("term")).distinct()
    terms = written(terms, "search-terms")
    slices = max(1, -(-terms.count() // most))
    kind = docs.schema[doc].dataType.simpleString()
    out = []
    for number in range(slices):
        some = terms.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == number).groupBy("item").agg(F.collect_list("term").alias("terms")).collect()
        if not some:
            continue
        asked = Asked([r.terms for r in some])
        postings = counted(docs, [doc], text, asked)
        totals = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(asked.terms), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            weight[r["t"]] = math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * r["count"] + 1)))
        asked.weigh(weight)
        held = postings.where(F.size("terms") > 0)
        found = held.mapInArrow(lambda batches, asked=asked, totals=tuple(totals): best_of(shards(batches, totals, asked), asked, doc, top), f"number int, doc {kind}, score long")
        names = docs.sparkSession.createDataFrame([(i, r.item) for i, r in enumerate(some)], f"number int, item {terms.schema['item'].dataType.simpleString()}")
        out.append(found.join(F.broadcast(names), "number").select("item", "doc", "score"))
    if not out:
        return docs.sparkSession.createDataFrame([], f"`{item}` {terms.schema['item'].dataType.simpleString()}, rank int, `{doc}` {kind}, score long")
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return both.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")


def best_of(held, asked: Asked, doc: str, top: int):
    """The best documents of a task's shards for each query; scores found in one shard skip blocks of the next."""
    best, kind = [Best() for _ in asked.queries], None
    for shard, rows in held:
        keys = rows.field(doc)
        kind = keys.type
        searched_shard(shard, keys, asked, best, top)
    if kind is not None:
        rows = [(i, key, score) for i, b in enumerate(best) for score, _, key in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64())], ["number", "doc", "score"])


def search_index(table: DataFrame, asked: Asked, doc: str = "doc_id", top: int = TOP) -> DataFrame:
    """(number, doc, score): each task's best documents of an index table for each query, by its number in `asked`."""
    kind = table.schema["rows"].dataType.elementType[doc].dataType.simpleString()
    return table.mapInArrow(lambda batches: best_of(unpacked(batches), asked, doc, top), f"number int, doc {kind}, score long")
