"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features of a text are the byte n-grams (2 to 4) of its words with a mark at either end, hashed into
2**BITS buckets.  A text's vector is the mean of its features' embeddings; embeddings and softmax
are trained together by stochastic gradient descent in numpy, on a bounded sample.  For prediction
the two linear maps fold into one table of a score per bucket and language, so every byte of every
text is read, vectorised and a piece at a time.

Scores are softmax probabilities at a temperature fitted on a validation part of the sample; a
document is rejected if it has no letter or its score lies below what all but REJECT_RATE of the
validation documents reach, though never above ABOVE_CHANCE more than a blind guess would score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather_sample
from .text_hash import _strings

#: Bytes that are worked on at a time, and texts.
PIECE, TEXTS = 1 << 18, 1024
BITS = 17
DIM = 16
NGRAMS = (2, 3, 4)
EPOCHS = 4
RATE = 20.0
#: At most so many labelled documents are fitted, shared out evenly among languages.
SAMPLE_ROWS = 4000
#: Longer texts are not sampled for fitting (they are predicted like any other).
SAMPLE_TEXT_BYTES = 1 << 16
#: All texts of the sample together; beyond it the sample has fewer rows.
SAMPLE_BYTES = 48 << 20
VALIDATION_SHARE = 0.2
REJECT_RATE = 0.001
ABOVE_CHANCE = 0.1
UNKNOWN = "und"

_fold = np.full(256, 32, np.uint8)
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def buckets(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place) of the n-grams of folded bytes that don't reach over a gap between words."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = data == 32
    ok = ~(gap[:m] & gap[n - 1 : n - 1 + m]) if n == 2 else np.ones(m, bool)
    for i in range(1, n - 1):
        ok &= ~gap[i : i + m]
    code = np.zeros(m, np.uint32)
    for i in range(n):
        code = code * np.uint32(256) + data[i : i + m]
    at = np.flatnonzero(ok)
    code = (code[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(15)
    return (code * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int64), at


def _padded(text: bytes) -> np.ndarray:
    return _fold[np.frombuffer(b" " + text + b" ", np.uint8)]


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = _padded(text)
    found, counts = np.unique(np.concatenate([buckets(data, n)[0] for n in NGRAMS]), return_counts=True)
    return found, counts / max(1, counts.sum())


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # language x bucket
    temperature: float
    threshold: float

    def logits(self, column: pa.Array) -> np.ndarray:
        """Mean score per text and language, over whole texts."""
        data, offsets = _strings(column)
        n, width = len(column), max(NGRAMS)
        sums, seen = np.zeros((n, len(self.langs))), np.zeros(n)
        a, end = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
        while a < end:  # windows that start in [a, b), read with what lies around
            b = min(end, a + PIECE)
            lo, hi = max(int(offsets[0]), a - 1), min(end, b + width)
            first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
            bounds = np.clip(offsets[first : last + 1], lo, hi) - lo
            # a gap before and after each text: texts must not run into each other
            shift = np.arange(len(bounds) - 1)
            part = np.full(hi - lo + 2 * (len(bounds) - 1), 32, np.uint8)
            lens = np.diff(bounds)
            to = np.arange(hi - lo) + np.repeat(2 * shift + 1, lens)
            part[to] = _fold[data[lo:hi]]
            owner = np.repeat(np.arange(first, last), lens + 2)
            origin = np.full(len(part), -1, np.int64)
            origin[to] = np.arange(lo, hi)
            # a window counts where its first byte lies, the gap before a text counts as its first byte
            home = np.where(origin >= 0, origin, np.append(origin[1:], -1))
            mine = (home >= a) & (home < b)
            if lo < a:  # the byte before this piece is no gap of its own
                mine[0] = False
            for k in NGRAMS:
                bucket, at = buckets(part, k)
                pick = mine[at]
                bucket, who = bucket[pick], owner[at[pick]]
                if len(bucket):
                    cut = np.concatenate([[0], np.flatnonzero(np.diff(who)) + 1])
                    seen[who[cut]] += np.diff(np.append(cut, len(who)))
                    for c in range(len(self.langs)):
                        sums[who[cut], c] += np.add.reduceat(self.table[c][bucket], cut)
            a = b
        return sums / np.maximum(seen, 1)[:, None]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected) per text, some texts at a time."""
        parts = [self._predict(column.slice(a, TEXTS)) for a in range(0, max(1, len(column)), TEXTS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(column)
        letters = np.array([x is not None and (any(map(str.isalpha, x[:64])) or any(map(str.isalpha, x))) for x in column.to_pylist()], bool)
        if not self.langs:
            return np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        p = softmax(self.logits(column) / self.temperature)
        best = p.argmax(1) if n else np.zeros(0, np.int64)
        score = np.where(letters, p[np.arange(n), best], 0.0)
        return np.where(letters, np.array(self.langs, object)[best], UNKNOWN), score, ~letters | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 0) -> Model:
    """Fits (text, language) pairs: the whole text and a short piece of it are an example each."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((0, 1 << BITS), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    examples, checks, whole = [], [], []
    for text, lang in rows:
        words = text.split()
        y = langs.index(lang)
        a = int(rng.integers(max(1, len(words) - 3)))
        piece = " ".join(words[a : a + int(rng.integers(2, 30))])
        held = rng.random() < VALIDATION_SHARE
        for x, full in ((text, True), (piece, False)):
            found, weights = _bag(x.encode())
            if len(found):
                (checks if held else examples).append((found, weights, y))
                if held:
                    whole.append(full)
    emb = rng.uniform(-1.0 / DIM, 1.0 / DIM, (1 << BITS, DIM))
    out = np.zeros((DIM, len(langs)))
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            found, weights, y = examples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = weights @ emb[found]
            wrong = softmax(hidden @ out)
            wrong[y] -= 1
            back = out @ wrong
            out -= 0.05 * rate * np.outer(hidden, wrong)
            emb[found] -= rate * weights[:, None] * back
    table = np.ascontiguousarray((emb @ out).T.astype(np.float32))
    if not checks:
        return Model(langs, table, 1.0, 0.0)
    raw = np.array([w @ table[:, f].T for f, w, _ in checks])
    gold = np.array([y for _, _, y in checks])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    nll = [-np.log(np.maximum(softmax(raw / t)[np.arange(len(gold)), gold], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(nll))])
    top = softmax(raw / temperature).max(1)[np.array(whole)]
    threshold = float(np.quantile(top, REJECT_RATE)) if len(top) else 0.0
    return Model(langs, table, temperature, min(threshold, 1 / len(langs) + ABOVE_CHANCE))


def sample(docs: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most about ``rows`` labelled texts for fitting, an even share of them for each language, and at most SAMPLE_BYTES."""
    labelled = docs.where(learn_from & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_TEXT_BYTES))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(scale * min(1.0, each / n)))])
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(scale))
    picked = labelled.where(draw < F.coalesce(share[F.col(lang_col)], F.lit(0))).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    return gather_sample(picked, "text", 2 * rows, SAMPLE_BYTES)


def fit(docs: DataFrame, learn_from: Column, **options) -> Model:
    return train(sample(docs, learn_from, **options))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row; only the text is an input.

    A null text, or one without a letter, is ``und`` with score 0 and rejected.  If nothing could be
    learned every row is.  Equal texts get equal results, rows with equal ids are kept, an empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # size fixed by BITS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = held.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the documents that the model rejects."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(~held.value.predict(pa.array(texts, pa.string()))[2])

    return docs.where(accepted(F.col(text_col).cast("string")))
