"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a fixed number of bins stays open, held in a bitset keyed by free space. A piece goes
to the open bin it fills best; when one bin too many is open, the fullest closes first.

Tokenising is one map stage. Only (doc_id, piece, start, length, crc) rows are shuffled: they are dealt by hash into
groups whose number grows with the number of rows, and each group is packed on its own. Pieces as long as a sequence
need no packing and are never shuffled.
"""

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import small

#: Rows that one group packs. A group ends with at most OPEN_BINS sequences that are not full.
GROUP_ROWS = 200_000
OPEN_BINS = 1024
#: Runs of white space (Unicode's) of at least this length are encoded apart from the rest of their text.
LONG_BLANK = 1000
_BLANKS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_BLANK},}}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_TYPES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(ids_length: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all have the longest length but the first, which takes the rest."""
    first = ids_length % longest or min(ids_length, longest)
    return [(0, first)] + [(s, longest) for s in range(first, ids_length, longest)] if ids_length else []


def best_fit(lengths: list[int], size: int, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given. Bins are numbered from 0.

    Bit f of `free` is set while a bin with f free places is open. The lowest set bit from `length` on is the best fit;
    the lowest set bit of all is the fullest bin, which closes when more than open_bins are open.
    """
    free, bins, used, count = 0, [[] for _ in range(size + 1)], 0, 0
    number, offset = [], []
    for length in lengths:
        fits = free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = bins[f].pop()
            if not bins[f]:
                free &= ~(1 << f)
            count -= 1
        else:
            b, f, used = used, size, used + 1
        number.append(b)
        offset.append(size - f)
        if f - length:
            bins[f - length].append(b)
            free |= 1 << (f - length)
            count += 1
            if count > open_bins:
                f = (free & -free).bit_length() - 1
                bins[f].pop()
                if not bins[f]:
                    free &= ~(1 << f)
                count -= 1
    return number, offset


def added_tokens(file: str) -> dict[str, int]:
    """Strings that a `tokenizers` file maps to ids of their own wherever they stand in a text."""
    with open(file, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        raise ValueError(f"added tokens of {file} that aren't matched as they stand")
    return {t["content"]: t["id"] for t in added}


def encoder(ranks: str, pattern: str, added: dict[str, int]) -> Callable[[str], list[int]]:
    """Ids of a text. Of a long run of white space the pattern takes all at a text's end or before an added token, and
    all but the last character elsewhere; that piece is merged by itself, since the pattern would need a stack as deep
    as the run is long."""
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens=added)
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def plain(text: str) -> list[int]:
        ids, at = [], 0
        for run in _BLANKS.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += own.encode_ordinary(text[at : run.start()])
            ids += own._encode_single_piece(text[run.start() : end])
            at = end
        return ids + own.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if not _BLANKS.search(text):
            return own.encode(text, allowed_special="all", disallowed_special=())
        ids, at = [], 0
        for found in special.finditer(text) if special else ():
            ids += plain(text[at : found.start()])
            ids.append(added[found[0]])
            at = found.end()
        return ids + plain(text[at:])

    return encode


def token_pieces(docs: DataFrame, ranks: str, pattern: str, end_id: int = 2, longest: int = 1024, added: dict[str, int] | None = None) -> DataFrame:
    """PIECES of every document: its ids, then end_id, cut to at most `longest`. Null text counts as empty.

    ranks: file of the byte-level vocabulary as ranks; it gives the ids that the same vocabulary gives as a
    `tokenizers` file (tests compare them), several times faster on texts whose words rarely repeat.
    added: strings that have ids of their own in that file.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern, added or {})
        for batch in small(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(end_id)
                raw = memoryview(np.array(ids, dtype="<u4").tobytes())
                rows += [(doc_id, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids), longest))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(PIECE_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES.types, strict=True)], schema=PIECE_TYPES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, rows: int, longest: int = 1024, open_bins: int = OPEN_BINS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds sequence_id and offset to PIECES. rows: about how many there are, which sets the number of groups.

    Pieces of `longest` stand alone in a sequence. Others arrive in the order of a hash, so reruns agree; equal rows
    are packed one by one. An empty table gives no rows. A sequence_id is group * 2^32 + bin, or negative where one
    piece fills it.
    """
    groups = max(1, -(-rows // group_rows))
    key = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        number, offset = best_fit(group.column("length").to_pylist(), longest, open_bins)
        first = group.column("g")[0].as_py() << 32
        found = [pa.array([first + b for b in number], pa.int64()), pa.array(offset, pa.int64())]
        return pa.Table.from_arrays([*(group.column(c) for c in PIECE_TYPES.names), *found], names=[*PIECE_TYPES.names, "sequence_id", "offset"])

    short = pieces.where(F.col("length") < longest).withColumn("h", key).withColumn("g", F.pmod("h", F.lit(groups)).cast("long"))
    out = short.groupBy("g").applyInArrow(packed, f"{PIECES}, sequence_id long, offset long")
    whole = pieces.where(F.col("length") >= longest)
    return out.unionByName(whole.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}))


def pack_documents(docs: DataFrame, ranks: str, pattern: str, end_id: int = 2, longest: int = 1024, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenises and packs all documents. The pieces are a table in the shared folder, so each text is tokenised once."""
    from cartulary.llm.common import written

    pieces = written(token_pieces(docs, ranks, pattern, end_id, longest, added), "pieces")
    return pack(pieces, pieces.where(F.col("length") < longest).count(), longest)
