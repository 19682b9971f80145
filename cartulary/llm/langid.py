"""Language identification by segmentation-marginalised unigrams.

The pieces are a fixed public vocabulary. Each language has a probability for each piece; a forward algorithm sums the
probabilities of all ways to cut a word into pieces, and a text's score is the sum over its words. Words are runs of
letters (Unicode's categories L, with the marks M behind them) in lower case, behind a word-start mark; runs longer than
LONGEST_RUN are cut there, so every text is read whole.

Learning: pieces are counted per task (at most vocabulary x languages rows each), summed by Spark, and only those sums
- bounded by the vocabulary's 32,000 pieces times the languages - reach the driver and the executors.
"""

import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import small

LONGEST_RUN = 24
#: Words whose scores a worker remembers; it forgets them all when there are more.
CACHED_WORDS = 400_000
MARK = "▁"


def characters(categories: str, last: int = sys.maxunicode) -> str:
    """The inside of a regular expression's brackets: code points whose category begins with one of the letters."""
    held = np.array([unicodedata.category(chr(c))[0] in categories for c in range(last + 1)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


_RUN = re.compile(f"[{characters('L')}][{characters('LM')}]{{0,{LONGEST_RUN - 1}}}")
#: Texts without marks, numbers other than digits and code points above FFFF have the same runs by a quicker pattern.
_RARE = re.compile(f"[{characters('MN', 0xFFFF).removeprefix(chr(92) + 'U00000030-' + chr(92) + 'U00000039')}\U00010000-\U0010ffff]")
_COMMON = re.compile(rf"[^\W\d_]{{1,{LONGEST_RUN}}}")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_RUN if _RARE.search(text) else _COMMON).findall(text)


def piece_counts(docs: DataFrame, model: str) -> DataFrame:
    """(lang, piece, n): pieces of all words of docs (lang, text), each word cut once by the vocabulary's own merges.
    Piece -1 counts the documents. Null text counts as a document without words."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sentencepiece

        cutter = sentencepiece.SentencePieceProcessor(model_file=model)
        total: Counter = Counter()
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=False):
                total[lang, -1] += len(part)
                texts = part["text"].tolist()
                for at in range(0, len(texts), 512):
                    seen = Counter(w for text in texts[at : at + 512] for w in words(text))
                    for ids, n in zip(cutter.encode(list(seen), num_threads=1), seen.values(), strict=True):
                        for i in ids:
                            total[lang, i] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in total.items()], columns=["lang", "piece", "n"])

    got = docs.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return got.mapInPandas(counted, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Log priors and piece probabilities of each language; scores words by summing over all their segmentations."""

    def __init__(self, counts: list[tuple[str, int, int]], pieces: list[str | None], smooth: float = 0.05):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: k for k, lang in enumerate(self.langs)}
        n, priors = np.zeros((len(pieces) + 1, len(at))), np.ones(len(at))
        for lang, piece, k in counts:
            if piece < 0:
                priors[at[lang]] += k
            else:
                n[piece, at[lang]] += k
        n[:-1] += smooth
        self.prob = n / n.sum(0)
        self.prob[-1] = 1e-7  # a letter that no piece covers
        self.prior = np.log(priors / priors.sum())
        # A language's numbers grow with every character, midway between its rarest piece and 1, so that no product of a
        # longest run leaves the range of doubles however many pieces were counted
        self.step = self.prob.min(0) ** -0.5 if len(at) else np.ones(0)
        size = np.array([min(len(p), LONGEST_RUN + 1) if p else 1 for p in pieces] + [1])
        self.grown = self.prob * self.step ** size[:, None]
        #: Piece ids by text, and -1 for texts that only begin pieces.
        self.ids = {p[:n]: -1 for p in pieces if p for n in range(1, len(p))} | {p: i for i, p in enumerate(pieces) if p}

    def word_scores(self, new: list[str]) -> np.ndarray:
        """Log probability of each word (with its mark) in each language: the forward algorithm, all words at once."""
        hits: list[list[int]] = [[] for _ in range(max(map(len, new), default=0) + 1)]  # by end: word, start and piece in one number
        get, unknown = self.ids.get, len(self.prob) - 1
        for w, word in enumerate(new):
            size = len(word)
            for i in range(size):
                here = w << 21 | i << 16
                k = get(word[i])
                hits[i + 1].append(here | (unknown if k is None or k < 0 else k))
                if k is None:
                    continue
                for j in range(i + 2, size + 1):
                    k = get(word[i:j])
                    if k is None:
                        break
                    if k >= 0:
                        hits[j].append(here | k)
        alpha = np.zeros((len(hits), len(new), len(self.langs)))
        alpha[0] = 1
        for j in range(1, len(hits)):
            found = np.array(hits[j], np.int64)
            w, i, k = found >> 21, found >> 16 & 31, found & 0xFFFF
            starts = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            alpha[j, w[starts]] = np.add.reduceat(alpha[i, w] * self.grown[k], starts)
        size = np.array([len(x) for x in new], np.int64)
        return np.log(alpha[size, np.arange(len(new))]) - size[:, None] * np.log(self.step)


def vocabulary(model: str) -> list[str | None]:
    """The pieces by id; None for control, unknown and byte pieces, which no run of letters contains."""
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=model)
    return [None if s.is_control(i) or s.is_unknown(i) or s.is_byte(i) else s.id_to_piece(i) for i in range(s.get_piece_size())]


def learn(docs: DataFrame, model: str) -> Model:
    return Model([tuple(r) for r in piece_counts(docs, model).collect()], vocabulary(model))


#: What a worker process keeps from one task to the next: the model in use and the words that it has scored.
_HELD: dict = {}


def held_words(token: str, shipped) -> dict:
    """The model of a prediction with the words scored by it so far (at most CACHED_WORDS and a batch's) in this worker;
    another prediction's are dropped."""
    if _HELD.get("token") != token:
        m = Model.__new__(Model)
        m.__dict__.update(shipped.value)
        _HELD.clear()
        _HELD.update(token=token, model=m, known={}, table=np.zeros((0, len(m.langs))))
    return _HELD


def predict(docs: DataFrame, fitted: Model, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs, then lang_pred and score: the likeliest language and its posterior probability.

    `und` with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to the language that
    sorts first. A column of docs named like an output is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vars(fitted))  # vocabulary x languages numbers
    token = uuid.uuid4().hex
    keep = [c for c in keep if c not in ("lang_pred", "score")]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_words(token, shipped)
        m, known, table = held["model"], held["known"], held["table"]
        for batch in small(batches):
            texts = [words(t) for t in batch.column("__text").to_pylist()]
            new = list({w for t in texts for w in t if w not in known})
            if len(known) + len(new) > CACHED_WORDS:
                known, new, table = {}, list({w for t in texts for w in t}), table[:0]
            if new and m.langs:
                parts = [m.word_scores([MARK + w for w in new[i : i + 20_000]]) for i in range(0, len(new), 20_000)]
                table = np.concatenate([table, *parts])
                known.update({w: len(known) + i for i, w in enumerate(new)})
            held["known"], held["table"] = known, table
            lang, score = [], []
            for t in texts:
                if not t or not m.langs:
                    lang.append("und")
                    score.append(0.0)
                    continue
                total = table[[known[w] for w in t]].sum(0) + m.prior
                best = int(total.argmax())
                lang.append(m.langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])
    return rows.mapInArrow(predicted, schema)
