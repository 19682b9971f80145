"""Vector code compression: vectors as codes of eight parts, learned and assigned in integers.

Vectors are stored in blocks. A block has, for every dimension, a dictionary of the distinct integers that its vectors hold
there, and each vector's places in these dictionaries. To compare with a codebook, the squared differences of each distinct
integer to all entries are tabulated once for a dimension; a part's distances are then rows of these tables, gathered by the
codes and added up. Sums for new entries come from counts of (entry, dictionary place) in the same way. A block's tables
are as large as the block allows, whatever range the values have, and nothing but codebooks passes the driver.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import BROADCAST_IDS, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most; places in its dictionaries fit 16 bits. Integers of a block at most: 64 MB of them.
BLOCK, VALUES = 8192, 1 << 23

STORED = "dim int, n int, sizes array<int>, dictionary binary, places binary"


def finite(vector: Column) -> Column:
    """Whether a vector is known and so are all its components, and they are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def dictionaries(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Each dimension's distinct integers, ascending, and the places in them (dimensions x vectors)."""
    found = [np.unique(x[:, d], return_inverse=True) for d in range(x.shape[1])]
    return [v for v, _ in found], np.array([at for _, at in found], np.uint16).reshape(x.shape[1], len(x))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers; an error where squared distances of such vectors would not fit 64 bits."""
    scaled = np.floor(scale * x)
    if scaled.size and np.abs(scaled).max() > math.isqrt((1 << 62) // x.shape[1]) // 2:
        raise ValueError("a component is too large for squared distances in 64 bits")
    return scaled.astype(np.int64)


def blocks(vectors: DataFrame, keep: list[str], vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """The stored blocks of vectors, as a table: STORED, and `rows`, the columns `keep` of its vectors in order.

    Vectors that are null or hold null, NaN or infinite components are left out. Vectors of several lengths, or of one
    that doesn't divide into the parts, are an error.
    """
    rows = vectors.where(finite(F.col(vector))).select(F.struct(*keep).alias("row"), F.col(vector).cast("array<double>").alias("v"))
    schema = f"{STORED}, rows array<{rows.schema['row'].dataType.simpleString()}>"

    def stored(batches):
        for batch in batches:
            widths = set(batch.column("v").value_lengths().to_pylist())
            if len(widths) > 1 or any(w % parts for w in widths):
                raise ValueError(f"vectors of lengths {sorted(widths)}: all must have the same, a multiple of {parts}")
            dim = max(widths, default=0)
            step = min(BLOCK, VALUES // max(dim, 1) + 1)
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                x = some.column("v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dim)
                values, places = dictionaries(integers(x, scale))
                held = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("row"))
                data = [pa.array([dim], pa.int32()), pa.array([some.num_rows], pa.int32()), pa.array([[len(v) for v in values]], pa.list_(pa.int32()))]
                data += [pa.array([b"".join(v.tobytes() for v in values)], pa.binary()), pa.array([places.tobytes()], pa.binary()), held]
                yield pa.RecordBatch.from_arrays(data, ["dim", "n", "sizes", "dictionary", "places", "rows"])

    out = written(rows.mapInArrow(stored, schema), "vector-blocks")
    dims = [r.dim for r in out.select("dim").distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError(f"vectors of several lengths, such as {dims}")
    return out


def opened(block: dict) -> tuple[list[np.ndarray], np.ndarray]:
    values = np.frombuffer(block["dictionary"], np.int64)
    return np.split(values, np.cumsum(block["sizes"])[:-1]) if block["dim"] else [], np.frombuffer(block["places"], np.uint16).reshape(block["dim"], block["n"])


def nearest(values: list[np.ndarray], places: np.ndarray, n: int, book: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts x n) each part's nearest entry, the lower index where several are, and its squared distance."""
    which, how_far = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    width = len(values) // parts
    for p in range(parts):
        far = np.zeros((n, len(book)), np.int64)
        for d in range(p * width, (p + 1) * width):
            table = (values[d][:, None] - book[:, d]) ** 2  # every distinct integer to all entries
            far += table[places[d]]
        which[p] = far.argmin(1)
        how_far[p] = far[np.arange(n), which[p]]
    return which, how_far


def refined(stored: DataFrame, book: np.ndarray, parts: int) -> np.ndarray:
    """The codebook with each entry replaced by the mean of the parts nearest to it, rounded down; unused entries stay."""
    entries, dim = book.shape

    def sums(batches):
        total, count = np.zeros((dim, entries), np.int64), np.zeros((dim, entries), np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                values, places = opened(block)
                which, _ = nearest(values, places, block["n"], book, parts)
                for d, (v, at) in enumerate(zip(values, places, strict=True)):
                    own = which[d * parts // dim]
                    held = np.bincount(own * len(v) + at, minlength=entries * len(v)).reshape(entries, len(v))
                    total[d] += held @ v
                    count[d] += held.sum(1)
        d, e = (a.ravel() for a in np.indices((dim, entries)))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (d, e, total.ravel(), count.ravel())], ["d", "e", "total", "n"])

    found = stored.select(*STORED.replace(" int", "").replace(" array<int>", "").replace(" binary", "").split(", ")).mapInArrow(sums, "d long, e long, total long, n long")
    new = book.copy()
    for r in found.groupBy("d", "e").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
        new[r.e, r.d] = int(r.total) // r.n
    return new


def first_entries(vectors: DataFrame, key: str, vector: str, entries: int, scale: int) -> np.ndarray:
    """The vectors of the smallest keys, one each (of equal keys the smallest vector); a null key only if all are null."""
    kept = vectors.where(finite(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    found, rest = {}, kept.where("key IS NOT NULL")
    while len(found) < entries:
        some = rest.orderBy("key", "v").limit(entries).collect()
        for r in some:
            found.setdefault(r.key, r.v)
        if len(some) < entries:
            break
        rest = kept.where(F.col("key") > F.lit(some[-1].key))
    rows = list(found.values())[:entries] or [r.v for r in kept.orderBy("v").limit(1).collect()]
    return integers(np.array(rows, float), scale) if rows else np.zeros((0, 0), np.int64)


def codebook(stored: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    """(entries x dimensions), from the first entries in so many rounds of assigning and averaging, each one pass."""
    book = first
    for _ in range(rounds if len(first) else 0):
        book = refined(stored, book, parts)
    return book


def digest(book: np.ndarray, parts: int = PARTS) -> str:
    """sha256 of the entries' components by part, entry and place in the part, comma-joined."""
    width = book.shape[1] // parts if book.size else 0
    return hashlib.sha256(",".join(str(x) for p in range(parts) for entry in book[:, p * width : (p + 1) * width] for x in entry.tolist()).encode()).hexdigest()


def coded(stored: DataFrame, book: np.ndarray, parts: int = PARTS) -> DataFrame:
    """The blocks' rows with code (two hex digits a part) and error (squared distance to the coded entries)."""
    kept = stored.schema["rows"].dataType.elementType

    def codes(batches):
        for batch in batches:
            for i, block in enumerate(batch.select(["dim", "n", "sizes", "dictionary", "places"]).to_pylist()):
                which, far = nearest(*opened(block), block["n"], book, parts)
                text, size = np.ascontiguousarray(which.T.astype(np.uint8)).tobytes().hex(), 2 * parts
                rows = batch.column("rows").slice(i, 1).flatten()
                data = [rows, pa.array([text[j : j + size] for j in range(0, len(text), size)]), pa.array(far.sum(0))]
                yield pa.RecordBatch.from_arrays(data, ["row", "code", "error"])

    return stored.mapInArrow(codes, f"row {kept.simpleString()}, code string, error long")


def with_sums(rows: DataFrame, by: str, value: str, name: str, most: int = BROADCAST_IDS) -> DataFrame:
    """rows with the sum of value over each value of `by`, nulls together. Few sums are broadcast. Of many, those that hold
    more than a thousandth of all rows are (they are at most a thousand), so no key's rows meet in one task."""
    sums = written(rows.groupBy(F.col(by).alias("__by")).agg(F.sum(F.col(value).cast("decimal(38,0)")).cast("long").alias(name), F.count("*").alias("__n")), "sums")
    size = sums.agg(F.count("*").alias("keys"), F.sum("__n").alias("rows")).first()
    same = F.col(by).eqNullSafe(F.col("__by"))
    if size["keys"] <= most:
        return rows.join(F.broadcast(sums), same).drop("__by", "__n")
    often = F.col("__n") * 1000 > size["rows"]
    hot = rows.join(F.broadcast(sums.where(often)), same, "left").withColumn("__hot", F.col("__n").isNotNull())
    cold = hot.where("NOT __hot").drop("__by", "__n", "__hot", name).join(sums.where(~often), same)
    return hot.where("__hot").drop("__by", "__n", "__hot").unionByName(cold.drop("__by", "__n"))


def compressed(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that is kept, see `blocks`.

    Repeated rows stay and count; a null key is coded like others but starts no entry while others do; null labels are
    one label; fewer keys than ENTRIES make so many entries. An empty table gives none.
    """
    vectors = vectors.select(F.col(key), F.col(label), F.col(vector))
    stored = blocks(vectors, [key, label], vector)
    book = codebook(stored, first_entries(vectors, key, vector, ENTRIES, SCALE))
    rows = written(coded(stored, book).select(F.col(f"row.`{key}`").alias(key), F.col(f"row.`{label}`").alias("__label"), "code", "error"), "vector-codes")
    return with_sums(rows, "__label", "error", "label_error").select(key, "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
