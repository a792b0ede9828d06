"""Toxicity by weak supervision.

Many weak voters look at a text: words of a seed lexicon, words and word beginnings mined from a
bounded labelled sample, and patterns of typing.  A generative label model estimates by expectation
maximisation how often each voter fires on toxic and on other texts, and from the covariance that
is left within the classes which voters say the same thing twice, so that they share a vote.  Its
posterior for each sampled text is the soft label on which a linear classifier over the voters is
trained; the classifier alone scores the corpus.  The labels of the sample mine voters and are half
of every round's posteriors (ANCHOR); the voters' agreement is the other half.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gather_sample

# The seed lexicon.
LEXICON = ["clown", "disgusting", "dumb", "fool", "garbage", "idiot", "idiotic", "loser", "moron", "pathetic", "scum", "shut", "stupid", "trash", "vermin", "worthless"]
SAMPLE_ROWS = 8000
#: Longer texts are not sampled for fitting (they are scored like any other).
SAMPLE_TEXT_BYTES = 1 << 16
#: All texts of the sample together; beyond it the sample has fewer rows.
SAMPLE_BYTES = 48 << 20
#: Code points of the word beginnings that mining looks at.
STEMS = (4, 5, 6, 7, 8, 9)
MINED = 160
MIN_SUPPORT = 4
MIN_PRECISION = 0.85
#: Mined voters must be this unlikely by chance, over all that mining looks at.
CHANCE = 0.01
EM_ROUNDS = 60
#: Voters whose firing is this correlated within the classes share a vote when both fire.
CORRELATED = 0.35
#: Share of the known labels in every round's posteriors.
ANCHOR = 0.5
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ["shouting", "exclaiming", "insulting"]
_INSULT = re.compile(r"\byou(?:'re| are)? (?:a |an |such |so |all |just )*(?:" + "|".join(LEXICON) + r")\b", re.IGNORECASE)


#: By code point: whether it is a capital.
_UPPER = np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def _capitals(text: str) -> int:
    return int(np.count_nonzero(_UPPER[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]))


def _patterns(text: str) -> list[bool]:
    """Of PATTERNS: mostly capitals, many exclamation marks, an insult aimed at the reader."""
    letters = len(text) or 1
    return [
        len(text) >= 20 and _capitals(text) > 0.6 * letters,
        text.count("!") > max(3, 0.02 * letters),
        "you" in text.lower() and _INSULT.search(text) is not None,
    ]


@dataclass
class Voters:
    """Voters by what makes them fire: whole words, word beginnings, then PATTERNS."""

    words: dict[str, int]
    stems: dict[str, int]
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __len__(self) -> int:
        return len(self.words) + len(self.stems) + len(PATTERNS)

    def _of(self, word: str) -> tuple[int, ...]:
        found = [self.words[word]] if word in self.words else []
        found += [self.stems[word[:n]] for n in STEMS if word[:n] in self.stems and len(word) >= n]
        if len(self.cache) < 200_000:
            self.cache[word] = tuple(found)
        return tuple(found)

    def votes(self, text: str | None) -> np.ndarray:
        """How often each voter fires on a whole text."""
        out = np.zeros(len(self), np.float32)
        if not text:
            return out
        cache = self.cache
        for word in _WORD.findall(text.lower()):
            found = cache.get(word)
            if found is None:
                found = self._of(word)
            for k in found:
                out[k] += 1
        out[len(self) - len(PATTERNS) :] = _patterns(text)
        return out


def _distinct(rows: list[tuple[str, int]]) -> np.ndarray:
    """Positions of rows without near copies: one per label and least hash of three words in a row."""
    seen, out = set(), []
    for k, (text, label) in enumerate(rows):
        words = text.encode().split()
        key = label, min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0)
        if key not in seen:
            seen.add(key)
            out.append(k)
    return np.array(out, np.int64)


def mine(rows: list[tuple[str, int]], weights: np.ndarray) -> Voters:
    """Seed words, and words and word beginnings that are nearly only seen in labelled-toxic texts."""
    seeds, begun = set(LEXICON), set()
    support: Counter = Counter()
    silent: Counter = Counter()
    weight = [1.0, 1.0]  # one for each label
    for (text, label), w in zip(rows, weights):
        words = set(_WORD.findall((text or "").lower())) - seeds  # they vote already, and say nothing of their beginnings
        starts = {word[:n] for word in words for n in STEMS if len(word) > n}
        begun |= starts if label else set()
        seen = words | starts
        if label:
            support.update(seen)
            weight[1] = float(w)
        else:
            silent.update(seen)
            weight[0] = float(w)
    share = sum(1 for _, y in rows if y) / max(1, len(rows))
    candidates = len(support.keys() | silent.keys())

    def by_chance(x: str) -> float:
        """Bound of the chance that so many of x's texts are toxic, times what was looked at (Chernoff)."""
        n = support[x] + silent[x]
        rate = min(support[x] / n, 1 - 1e-9)
        far = rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / max(1 - share, 1e-9)) if rate > share else 0.0
        return float(candidates * np.exp(-n * far))

    good = {x for x, n in support.items() if n >= MIN_SUPPORT and weight[1] * n >= MIN_PRECISION * (weight[1] * n + weight[0] * silent[x]) and by_chance(x) < CHANCE}
    chosen = sorted(good, key=lambda x: (-support[x], -len(x), x))
    words = dict.fromkeys(LEXICON)
    stems: dict[str, None] = {}
    held: Counter = Counter()  # by beginning, the most texts of a longer voter that is chosen
    for x in chosen:
        if len(words) + len(stems) >= len(LEXICON) + MINED:
            break
        # a beginning that one longer voter accounts for is that voter
        if x in words or any(x[:n] in stems for n in STEMS if n < len(x)) or held[x] > 0.9 * support[x]:
            continue
        # whole words of a beginning's length are beginnings only if other words share them
        (stems if x in begun else words)[x] = None
        for n in STEMS:
            if n < len(x):
                held[x[:n]] = max(held[x[:n]], support[x])
    return Voters({w: k for k, w in enumerate(words)}, {s: k + len(words) for k, s in enumerate(stems)})


@dataclass
class LabelModel:
    """Class prior, coverage and accuracies, and which voters say the same.

    A text that no voter speaks on is judged by coverage alone.  Else each voter that fires adds its
    log odds, divided among the correlated voters that fire with it; voters that are silent abstain.
    """

    prior: float
    silent: np.ndarray  # by class, how likely no voter fires
    fires: np.ndarray  # class x voters, how likely each fires
    same: np.ndarray  # voters x voters, correlation within the classes where it is high

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        spoken = fired.any(1)
        odds = np.log(self.fires[1] / self.fires[0])
        covered = np.log1p(-self.silent)
        given = odds - (covered[1] - covered[0])
        gain = (fired * given / (1 + fired @ self.same)).sum(1) + (covered[1] - covered[0])
        gain = np.where(spoken, gain, np.log(self.silent[1] / self.silent[0]))
        return 1 / (1 + np.exp(-np.clip(gain + np.log(self.prior / (1 - self.prior)), -30, 30)))


def fit_label_model(fired: np.ndarray, weights: np.ndarray, prior: float, labels: np.ndarray) -> LabelModel:
    """EM over voters' firing (texts x voters, 0 or 1).

    Voters that hardly ever fire together say little about each other, so the known labels anchor
    the accuracies: they are the first posteriors, and ANCHOR of the weight in every round.
    """
    p = anchor = np.clip(labels, 0.02, 0.98)
    quiet = (~fired.any(1)).astype(np.float64)
    m = fired.shape[1]
    model = LabelModel(prior, np.full(2, 0.5), np.full((2, m), 0.5), np.zeros((m, m)))
    for step in range(EM_ROUNDS):
        for y, q in ((0, weights * (1 - p)), (1, weights * p)):
            model.fires[y] = np.clip((q @ fired + 0.05) / (q.sum() + 1.0), 1e-5, 0.9999)
            model.silent[y] = np.clip((q @ quiet + 0.05) / (q.sum() + 1.0), 1e-3, 0.999)
        # a voter may say nothing, it must not speak for "not toxic"
        model.fires[1] = np.maximum(model.fires[1], model.fires[0] * 1.01)
        model.silent[1] = min(model.silent[1], model.silent[0])
        if step == EM_ROUNDS // 2:  # what is left within the classes once accuracies have settled
            left = fired - (np.outer(1 - p, model.fires[0]) + np.outer(p, model.fires[1]))
            cov = (left * weights[:, None]).T @ left
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.abs(cov / np.outer(scale, scale))
            model.same = np.where(corr > CORRELATED, np.minimum(corr, 1.0), 0.0)
            np.fill_diagonal(model.same, 0.0)
        p = ANCHOR * anchor + (1 - ANCHOR) * model.posterior(fired)
    return model


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = _inputs(np.stack([self.voters.votes(t) for t in texts]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _inputs(votes: np.ndarray) -> np.ndarray:
    """Per voter whether it fired, then how many did and how often (logarithms)."""
    fired = (votes > 0).astype(np.float64)
    return np.hstack([fired, np.log1p(fired.sum(1, keepdims=True)), np.log1p(votes.sum(1, keepdims=True))])


def train(rows: list[tuple[str, int]], positives: int, negatives: int) -> Classifier:
    """rows: sampled (text, label); positives and negatives: how many rows the sample stands for."""
    labels = np.array([y for _, y in rows], np.float64)
    of = {1: positives / max(1, labels.sum()), 0: negatives / max(1, (1 - labels).sum())}
    weights = np.array([of[int(y)] for y in labels])
    weights = weights / weights.mean() if len(weights) else weights
    single = _distinct(rows)
    prior = min(max((positives + 1) / (positives + negatives + 2), 0.01), 0.99)
    voters = mine([rows[k] for k in single], weights[single])
    if not rows:  # nothing to learn from: any seed word makes a text likelier toxic than not
        w = np.zeros(len(voters) + 2)
        w[: len(LEXICON)] = 4.0
        return Classifier(voters, w, -3.0)
    votes = np.stack([voters.votes(t) for t, _ in rows])
    fired = (votes > 0).astype(np.float64)
    model = fit_label_model(fired, weights, prior, labels)
    soft = model.posterior(fired)
    x = _inputs(votes)
    w, b = np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 601):  # Adam on the weighted cross entropy with a little shrinkage
        p = 1 / (1 + np.exp(-(x @ w + b)))
        wrong = weights * (p - soft) / len(soft)
        grad = np.append(x.T @ wrong + 1e-4 * w, wrong.sum())
        moment, square = 0.9 * moment + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Classifier(voters, w, b)


def fit(docs: DataFrame, labels: DataFrame, learn_from: Callable[[Column], Column], rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Learns from documents that have a label in labels and an id that learn_from admits.

    At most about ``rows`` are sampled, by a hash of the id, half of either label where there are
    enough, and at most SAMPLE_BYTES; texts over SAMPLE_TEXT_BYTES are not.  Of contradicting labels of one id the higher
    counts; labels other than 0 and 1 are none.  No other column of docs is an input.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(learn_from(F.col("_id")) & F.col("_y").isin(0, 1))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("_id")), F.lit(scale))
    bound = {y: int(scale * min(1.0, rows / 2 / max(1, n.get(y, 0)))) for y in (0, 1)}
    drawn = known.where(draw < F.when(F.col("_y") == 1, bound[1]).otherwise(bound[0])).orderBy(draw, "_id").limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).where(F.octet_length("_text") <= SAMPLE_TEXT_BYTES)
    picked = gather_sample(texts.join(F.broadcast(drawn), "_id").select("_text", "_y"), "_text", 2 * rows, SAMPLE_BYTES)
    return train(picked, n.get(1, 0), n.get(0, 0))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; only the text is an input.

    A null text scores like an empty one, equal texts score alike, rows with equal or null ids are
    kept, other columns are ignored, and an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most LEXICON + MINED voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = held.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
