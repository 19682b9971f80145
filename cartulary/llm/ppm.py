"""Scoring documents by prediction by partial matching over bytes, with a model pretrained on the corpus.

The model is a trie of byte contexts up to ORDER bytes. A symbol unseen behind a context escapes to the next shorter
one (estimate C: the escape has as many counts as the context has distinct symbols); symbols that the longer context
has seen are excluded there. Behind order 0, symbols never seen share the rest evenly. A text ends with a symbol of its
own, and its first contexts hold start symbols; UTF-8 has neither byte.

The trie is never gathered in one place. Documents are dealt by hash into blocks of bounded size. A block sends its
distinct (context, symbol) grams, with how often its training documents hold them, to the cell that owns the last two
bytes of the context; a cell sees all counts behind its contexts, finds escapes and exclusions of orders 2 and up, and
answers each block with one probability per gram. Orders 0 and 1 are a table of 256 x 256 counts that every
cell gets. Words for the base score travel alike.

A cell never meets more than FAN blocks. Beyond that the blocks are dealt into slices, each of which adds up its blocks'
counts per cell, asks for its own distinct grams as a block does, and passes the answers on; slices are dealt likewise. So a
task holds a block, or the tables that at most FAN blocks or slices have of one cell.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import text_bytes, written

ORDER = 5
START, END = 0xFE, 0xFF
#: Bytes of text of a block, and of the slices in which it is read; blocks for each cell.
BLOCK_BYTES, SLICE_BYTES, BLOCKS_A_CELL = 20 << 20, 4 << 20, 0.5
#: Blocks, or slices of them, whose tables of a cell one task brings together.
FAN = 256


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Every (context, symbol) as one number, context first, and where each text's begin."""
    head, tail = bytes([START]) * order, bytes([END])
    joined = np.frombuffer(b"".join([head + t + tail for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    out = np.zeros(len(joined) - order, np.uint64)
    for k in range(order + 1):
        out <<= np.uint64(8)
        out |= joined[k : len(joined) - order + k]
    ends = np.cumsum(sizes + order)
    keep = np.ones(len(out), bool)
    for k in range(order):  # windows that reach into the next text
        at = ends[:-1] - order + k
        keep[at] = False
    return out[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def word_hashes(text: bytes) -> np.ndarray:
    import xxhash

    found = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def cell_of(keys: np.ndarray, cells: int, is_gram: bool) -> np.ndarray:
    """The cell that owns a gram (by the last two bytes of its context) or a word."""
    part = (keys >> np.uint64(8)) & np.uint64(0xFFFF) if is_gram else keys
    return ((part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(cells)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 P(symbol | context) of each distinct gram of a cell. counts: in training, 0 for grams only to be scored.
    low[c, s]: how often s followed byte c in training, over the whole corpus."""
    symbol = (keys & np.uint64(0xFF)).astype(np.int64)
    result = np.zeros(len(keys))
    done = np.zeros(len(keys), bool)
    over = None  # per gram, at the longer context: sums over its seen symbols of counts here, and how many they are
    for k in range(order, -1, -1):
        if k >= 2:
            node, to_node = np.unique(keys & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
            n_node = np.bincount(to_node, counts, len(node))
            context, of = np.unique(node >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, n_node, len(context)), np.bincount(of, n_node > 0, len(context))
            own, ctx = n_node[to_node], of[to_node]
            total, distinct = total[ctx], distinct[ctx]
            seen_nodes = (of, to_node, ctx, len(context), n_node)
        elif k == 1:
            byte = ((keys >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)
            own, total, distinct = low[byte, symbol], low.sum(1)[byte], (low > 0).sum(1)[byte]
            seen_nodes = None
        else:
            zero = low.sum(0)
            own, total, distinct = zero[symbol], np.full(len(keys), zero.sum()), np.full(len(keys), (zero > 0).sum())
        out_t, out_d = over if over is not None else (0, 0)
        rest_t, rest_d = total - out_t, distinct - out_d
        live = ~done & (rest_t + rest_d > 0)
        hit = live & (own > 0)
        with np.errstate(divide="ignore"):
            result[hit] += np.log10(own[hit] / (rest_t + rest_d)[hit])
            miss = live & ~hit
            result[miss] += np.log10(rest_d[miss] / (rest_t + rest_d)[miss])
        done |= hit
        if k == 0:
            break
        # what the next shorter context must exclude: the symbols seen here, with their counts there
        if k >= 3:
            of, to_node, ctx, size, n_node = seen_nodes
            shorter = node & np.uint64((1 << (8 * k)) - 1)
            _, to_shorter = np.unique(shorter, return_inverse=True)
            n_shorter = np.bincount(to_shorter, n_node)[to_shorter]
            over = np.bincount(of, n_shorter * (n_node > 0), size)[ctx], np.bincount(of, n_node > 0, size)[ctx]
        elif k == 2:
            of, to_node, ctx, size, n_node = seen_nodes
            n_shorter = low[((node >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64), (node & np.uint64(0xFF)).astype(np.int64)]
            over = np.bincount(of, n_shorter * (n_node > 0), size)[ctx], np.bincount(of, n_node > 0, size)[ctx]
        else:
            zero = low.sum(0)
            over = ((low > 0) * zero).sum(1)[byte], (low > 0).sum(1)[byte]
    never = 255 - int((low.sum(0) > 0).sum())  # START never is a symbol
    result[~done] -= np.log10(max(never, 1))
    return result


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes: sorted keys and small counts then compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(raw: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def slices(texts: list[bytes]) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= SLICE_BYTES or i + 1 == len(texts):
            yield slice(at, i + 1)
            at, size = i + 1, 0


def coded(texts: list[bytes], is_gram: bool, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: a code for each gram or word, the distinct keys, and how many of them each text has."""
    if is_gram:
        keys, _ = grams(texts, order)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
    else:
        found = [word_hashes(t) for t in texts]
        keys, sizes = np.concatenate([np.zeros(0, np.uint64), *found]), np.array([len(x) for x in found], np.int64)
    codes, distinct = pd.factorize(keys)
    return codes.astype(np.int32), distinct, sizes


def dictionary(parts: list[np.ndarray], counts: list[np.ndarray], cells: int, is_gram: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys by (cell, key), their summed counts, and the cells."""
    keys, back = np.unique(np.concatenate(parts), return_inverse=True)
    total, cell = np.bincount(back, np.concatenate(counts), len(keys)), cell_of(keys, cells, is_gram)
    by = np.argsort(cell, kind="stable")
    return keys[by], total[by].astype("<i4"), cell[by]


BLOCKS = "block long, cell long, words boolean, keys binary, counts binary"


def block_tables(docs: DataFrame, cells: int, order: int) -> DataFrame:
    """Of (block, learn, text): each block's distinct grams and words per cell, with their counts in training texts."""

    def profile(group: pa.Table) -> pa.Table:
        block, learn = group.column("block")[0].as_py(), np.array(group.column("learn").to_pylist())
        texts = [(t or "").encode() for t in group.column("text").to_pylist()]
        rows = []
        for is_gram in (True, False):
            parts, counts = [], []
            for part in slices(texts):
                codes, keys, sizes = coded(texts[part], is_gram, order)
                parts.append(keys)
                counts.append(np.bincount(codes[np.repeat(learn[part], sizes)], minlength=len(keys)))
            keys, total, cell = dictionary(parts, counts, cells, is_gram)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
                rows.append((block, int(cell[a]), not is_gram, packed(keys[a:b]), packed(total[a:b])))
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "cell", "words", "keys", "counts"])

    return docs.groupBy("block").applyInArrow(profile, BLOCKS)


def low_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): counts of pairs of bytes in training texts, pair -1: their words."""
    total, words = np.zeros(65536, np.int64), 0
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        words += sum(len(t.split()) for t in texts)
        for part in slices(texts):
            total += np.bincount(grams(texts[part], 1)[0].astype(np.int64), minlength=65536)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"pair": np.append(at, -1).astype(np.int32), "n": np.append(total[at], words)})


def table_of(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of each row, and the counts of all rows; counts are of four or of eight bytes."""
    raw = list(zip(group.column("keys").to_pylist(), group.column("counts").to_pylist(), strict=True))
    counts = [unpacked(n, "<i8" if len(n) == len(k) else "<i4").astype(np.int64) for k, n in raw]
    return [unpacked(k, "<u8") for k, _ in raw], np.concatenate(counts)


ANSWERS = "block long, cell long, words boolean, n long, answers binary"
PLACES = ["cell", "words", "slice"]


def replied(group: pa.Table, n: list[int], parts: list[np.ndarray]) -> dict:
    return {c: group.column(c) for c in ("block", "cell", "words")} | {"n": pa.array(n, pa.int64()), "answers": pa.array([packed(p) for p in parts], pa.binary())}


def answers(tables: DataFrame, low: np.ndarray, order: int, blocks: int, fan: int = FAN, keyed: bool = False) -> DataFrame:
    """For each block and cell one number per key (and, if keyed, the keys), in the keys' order: a gram's log10 probability (four bytes), a word's
    count in training; n: of one words row of a cell, the number of distinct training words that the cell owns."""
    if blocks > fan:
        slices = -(-blocks // fan)
        columns = ["block", "cell", "words", "n", "answers", *["keys"] * keyed]
        dealt = written(tables.withColumn("slice", F.col("block") % slices), "ppm-tables")
        sums = dealt.groupBy(*PLACES).applyInArrow(summed, BLOCKS)
        upper = answers(sums, low, order, slices, fan, True).withColumnRenamed("block", "slice")
        return dealt.groupBy(*PLACES).cogroup(upper.groupBy(*PLACES)).applyInArrow(passed_on, ANSWERS + ", keys binary").select(*columns)
    shipped = tables.sparkSession.sparkContext.broadcast(low)  # 256 x 256 counts

    def answer(group: pa.Table) -> pa.Table:
        is_words = group.column("words")[0].as_py()
        keys, counts = table_of(group)
        codes, distinct = pd.factorize(np.concatenate(keys))
        total = np.bincount(codes, counts, len(distinct))
        values = (total.astype("<i8") if is_words else log_probabilities(distinct, total, shipped.value, order).astype("<f4"))[codes]
        n = [int((total > 0).sum()) if is_words and i == 0 else 0 for i in range(len(keys))]
        made = replied(group, n, np.split(values, np.cumsum([len(k) for k in keys])[:-1]))
        return pa.table(made | {"keys": group.column("keys")} if keyed else made)

    return tables.groupBy("cell", "words").applyInArrow(answer, ANSWERS + ", keys binary" if keyed else ANSWERS)


def summed(group: pa.Table) -> pa.Table:
    """A slice's distinct keys of a cell in order, with the sums of its blocks' counts; the slice stands as the block."""
    keys, counts = table_of(group)
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, counts, len(distinct)).astype("<i8")
    row = [group.column("slice")[:1], *(group.column(c)[:1] for c in ("cell", "words")), pa.array([packed(distinct)], pa.binary()), pa.array([packed(total)], pa.binary())]
    return pa.Table.from_arrays(row, names=BLOCKS.replace(",", "").split()[::2])


def passed_on(group: pa.Table, upper: pa.Table) -> pa.Table:
    """The answers to a slice, which has all keys of its blocks in order, as answers to these blocks."""
    kind = "<i8" if group.column("words")[0].as_py() else "<f4"
    known, values = unpacked(upper.column("keys")[0].as_py(), "<u8"), unpacked(upper.column("answers")[0].as_py(), kind)
    parts = [values[np.searchsorted(known, unpacked(k, "<u8"))] for k in group.column("keys").to_pylist()]
    return pa.table(replied(group, [upper.column("n")[0].as_py(), *[0] * (len(parts) - 1)], parts) | {"keys": group.column("keys")})


SCORES = "doc_id long, n_tokens long, n_known long, sum_log double, score double"


def score(docs: DataFrame, learn: str, order: int = ORDER, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; `learn` is a SQL condition for
    training documents (null: not).

    Null text counts as empty; a text's words are followed by one end token. base_score is the add-one unigram score
    over tokens. Repeated rows are scored, and learned from, one by one; without training documents every byte costs
    log10(255) and every token log10(2). An empty table gives no rows. Words are told apart by 64-bit hashes.
    """
    blocks = max(1, -(-text_bytes(docs) // block_bytes))
    cells = max(1, int(blocks / BLOCKS_A_CELL))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"))

    low, words = np.zeros((256, 256)), 0
    for pair, n in rows.where("learn").select("text").mapInArrow(low_orders, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():  # at most 65,537 rows
        if pair < 0:
            words = n
        else:
            low[pair >> 8, pair & 255] = n
    ends = float(low[:, END].sum())  # training documents
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.col("text")), F.lit(blocks)).cast("long"))
    replies = written(answers(block_tables(rows, cells, order), low, order, blocks, fan), "ppm-answers")
    tokens = int(words + ends)
    distinct = replies.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + int(ends > 0)

    def scored(key: tuple, group: pa.Table, reply: pa.Table) -> pa.Table:
        texts = [(t or "").encode() for t in group.column("text").to_pylist()]
        got: dict[bool, dict[int, bytes]] = {True: {}, False: {}}
        for w, c, a in zip(*(reply.column(x).to_pylist() for x in ("words", "cell", "answers")), strict=True):
            got[w][c] = a
        sums: dict[str, list[np.ndarray]] = {"score": [], "log": [], "known": [], "sizes": []}
        for is_gram in (True, False):
            parts = [coded(texts[part], is_gram, order) for part in slices(texts)]
            keys, _, _ = dictionary([k for _, k, _ in parts], [np.zeros(len(k)) for _, k, _ in parts], cells, is_gram)
            values = np.concatenate([np.zeros(0), *(unpacked(got[not is_gram][c], "<f4" if is_gram else "<i8") for c in sorted(got[not is_gram]))])
            by = np.argsort(keys)
            keys, values = keys[by], values[by]
            for codes, distinct_keys, sizes in parts:
                each, at = values[np.searchsorted(keys, distinct_keys)][codes], np.concatenate([[0], np.cumsum(sizes)])
                chosen = (("score", each),) if is_gram else (("log", np.log10(each + 1)), ("known", each > 0))
                for name, x in chosen:
                    # each text's sum on its own: equal texts get equal sums
                    sums[name].append(np.array([x[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)], np.float64))
                if not is_gram:
                    sums["sizes"].append(sizes + 1)
        total = {k: np.concatenate(v) for k, v in sums.items()}
        known = total["known"].astype(np.int64) + int(ends > 0)
        return pa.Table.from_arrays([group.column("doc_id"), pa.array(total["sizes"]), pa.array(known), pa.array(total["log"] + np.log10(ends + 1)), pa.array(total["score"])], names=["doc_id", "n_tokens", "n_known", "sum_log", "score"])

    out = rows.select("doc_id", "text", "block").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(scored, SCORES)
    each = F.log10(F.lit(float(tokens + distinct + 1)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("sum_log") - F.col("n_tokens") * each).alias("base_score"), "score")
