"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is a lattice of vocabulary pieces.  Forward Viterbi scores give the best segmentation, and
they are the exact heuristic of an A* search backward from the end, which therefore pops the n best
paths in order.  Scores are multiples of SCORE_STEP, so sums are exact in any order and equally good
paths are known as such: of those the search goes on with the one that has come furthest, and as
every open path leads to a whole one of just its score, no more are kept open than results are
still wanted.  A word of k characters therefore takes at most n * k steps, whatever it repeats.

As no piece reaches over the start of a word, the lattice of a text is a row of small ones: Viterbi
runs over the distinct words of a batch at once (and gives, by forward and backward scores, how much
the second-best path of each loses), A* runs where a word can take part in the n best of a text, and
the words' lists are merged.  That merge is exact, as a text's n best paths leave the best one at
most at the n - 1 words that lose least.  Words of more than WIDE characters are first cut wherever
no piece holds the two characters side by side, as no path goes over such a place either.

The vocabulary is read from a model file whose path is a parameter; nothing is trained.  Where the
scores are merge ranks (a BPE model), a piece of rank r scores -ln(r + 2) - ln(H), H the sum of
1 / (r + 2) over the ranks, as for a unigram model under Zipf's law; else they are used as they are.
Characters outside the vocabulary become byte pieces.  Control strings in a text are ordinary text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: A character outside the vocabulary scores this much below the worst piece, for each byte.
UNKNOWN_PENALTY = 10.0
#: Scores are rounded to this, exact for sums up to 2**29.
SCORE_STEP = 2.0**-24
#: Words that are remembered between batches, with their characters, and the longest that are worked on in numpy.
CACHE_WORDS, CACHE_CHARS = 400_000, 16 << 20
WIDE = 40
_SPACE = "▁"
#: Stands for a space mark that is part of a text; as a lone surrogate it can't be in one.
STAND_IN = "\ud800"
_P = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces with scores, byte pieces, and the look-up tables over them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], normal: list[int]):
        self.pieces, self.byte_ids = pieces, byte_ids
        raw = np.array([scores[i] for i in normal])
        if len(raw) > 1 and raw.max() <= 0 and np.array_equal(raw, np.floor(raw)) and len(np.unique(raw)) > 0.9 * len(raw):
            ranks = np.empty(len(raw))
            ranks[np.argsort(-raw, kind="stable")] = np.arange(len(raw)) + 2
            raw = -np.log(ranks) - np.log((1 / ranks).sum())
        raw = np.round(raw / SCORE_STEP) * SCORE_STEP
        self.scores = np.full(len(pieces), -np.inf)
        self.scores[normal] = raw
        self.floor = float(raw.min()) - UNKNOWN_PENALTY if len(raw) else -UNKNOWN_PENALTY
        self.ids = {pieces[i]: i for i in normal if pieces[i]}
        self.longest = max(map(len, self.ids), default=1)
        self.begins = {p[:k] for p in self.ids for k in range(2, len(p) + 1)}
        self.ends = {p[k:] for p in self.ids for k in range(len(p) - 1)}
        self.steps = {p: (float(self.scores[i]), [i]) for p, i in self.ids.items()}
        self.side_by_side = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        lone = set()
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        for c in map(chr, range(128)):
            if c not in inner:
                lone.add(c)
        self.splits = not any(_SPACE in p.lstrip(_SPACE) for p in self.ids)
        # words: a run of space marks with what follows; characters that only stand alone are cut out
        out = re.escape("".join(sorted(lone)))
        self.cut = re.compile(f"{_SPACE}+[^{_SPACE}{out}]*|[^{_SPACE}{out}]+|[{out}]") if self.splits else re.compile(".+", re.DOTALL)
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, self.longest + 1):
            own = [(p, i) for p, i in self.ids.items() if len(p) == k]
            h = _hash(np.array([p for p, _ in own], f"U{k}").view(np.uint32).reshape(len(own), k)) if own else np.zeros(0, np.uint64)
            order = np.argsort(h)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces share a hash")
            self.by_length.append((h[order], np.array([i for _, i in own], np.int64)[order]))
        self.bytes = [b"" if np.isinf(self.scores[i]) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, byte_ids)):
            raise ValueError("the model has no byte pieces, so it can't write every text")
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], byte_ids, normal)

    def words(self, text: str) -> list[str]:
        """The independent parts of a text, with the space mark in front and for every space."""
        # a mark that is in the text goes by the stand-in and is written as bytes
        found = self.cut.findall(_SPACE + text.replace(_SPACE, STAND_IN).replace(" ", _SPACE))
        if max(map(len, found)) <= WIDE:
            return found
        out: list[str] = []
        for word in found:
            out += self._apart(word) if len(word) > WIDE else [word]
        return out

    def _apart(self, word: str) -> list[str]:
        """A word cut where no piece holds the two characters side by side."""
        held = self.side_by_side
        at = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in held), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:])]

    def single(self, c: str) -> tuple[float, list[int]]:
        """Score and ids of one character that no other piece need help with."""
        known = self.steps.get(c)
        if known is not None:
            return known
        raw = (_SPACE if c == STAND_IN else c).encode()
        return self.floor * len(raw), [self.byte_ids[b] for b in raw]

    def ending(self, word: str, b: int) -> list[tuple[int, float, list[int]]]:
        """(start, score, ids) of the pieces that end at b."""
        out = [(b - 1, *self.single(word[b - 1]))] if b else []
        for a in range(b - 2, -1, -1):
            part = word[a:b]
            if part not in self.ends:
                break
            if part in self.steps:
                out.append((a, *self.steps[part]))
        return out

    def forward(self, word: str) -> list[float]:
        """The best score up to each place (Viterbi)."""
        n, begins, steps = len(word), self.begins, self.steps
        ahead = [0.0] + [-np.inf] * n
        for a in range(n):
            so_far = ahead[a]
            ahead[a + 1] = max(ahead[a + 1], so_far + self.single(word[a])[0])
            for b in range(a + 2, n + 1):
                part = word[a:b]
                if part not in begins:
                    break
                if part in steps and so_far + steps[part][0] > ahead[b]:
                    ahead[b] = so_far + steps[part][0]
        return ahead

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations by backward A*, its heuristic the forward Viterbi score."""
        ahead = self.forward(word)
        # open paths, best last: (score of the best whole path, -place, -tick, score behind, path);
        # each leads to a whole path of its own with just that score, so as many as are wanted will do
        front: list[tuple] = [(ahead[-1], -len(word), 0, 0.0, None)]
        out, tick = [], 0
        while front and len(out) < n:
            _, place, _, behind, path = front.pop()
            if not place:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, ids))
                continue
            for a, s, ids in self.ending(word, -place):
                whole = ahead[a] + s + behind
                if len(front) >= n - len(out):
                    if (whole, -a) <= front[0][:2]:
                        continue
                    del front[0]
                tick -= 1
                insort(front, (whole, -a, tick, s + behind, (ids, path)))
        return out


def _hash(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * _P + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


class Encoder:
    """Encodes texts, remembering words between calls."""

    def __init__(self, vocabulary: Vocabulary, n_best: int = N_BEST):
        self.vocabulary, self.n = vocabulary, n_best
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.known: list[str] = []
        self.chars = 0
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.lists: dict[int, list[tuple[float, list[int]]]] = {}

    def _learn(self) -> None:
        """Scores, losses of the second-best path, and ids of the words met since the last call."""
        new = self.known[len(self.score) :]
        if not new:
            return
        score, loss = np.zeros(len(new)), np.full(len(new), np.inf)
        ids: list[np.ndarray | None] = [None] * len(new)
        by: dict[int, list[int]] = {}
        for k, word in enumerate(new):
            by.setdefault(len(word), []).append(k)
        for length, members in by.items():
            if length > WIDE or not all(map(_plain, (new[k] for k in members))):
                wide = members if length > WIDE else [k for k in members if not _plain(new[k])]
                for k in wide:
                    found = self.lists[len(self.score) + k] = self.vocabulary.n_best(new[k], max(2, self.n))
                    score[k], ids[k] = found[0][0], np.array(found[0][1], np.int32)
                    if len(found) > 1:
                        loss[k] = found[0][0] - found[1][0]
                members = [k for k in members if ids[k] is None]
            step = max(1, 1_500_000 // (length * min(length, self.vocabulary.longest)))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                s, d, rows = self._viterbi([new[k] for k in part], length)
                score[part], loss[part] = s, d
                for k, row in zip(part, rows):
                    ids[k] = row
        self.score, self.loss = np.append(self.score, score), np.append(self.loss, loss)
        self.flat = np.concatenate([self.flat, *ids])
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(x) for x in ids]))

    def _viterbi(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Best score, loss of the second best, and best ids for words of n characters each."""
        v, m = self.vocabulary, len(words)
        codes = np.array(words, f"U{n}").view(np.uint32).reshape(m, n)
        wide = min(n, v.longest)
        ident = np.full((n, wide, m), -1, np.int32)
        gain = np.full((n, wide, m), -np.inf)
        for a in range(n):
            h = np.zeros(m, np.uint64)
            for k in range(min(wide, n - a)):
                c = codes[:, a + k]
                h = h * _P + c.astype(np.uint64) + np.uint64(1)
                keys, pieces = v.by_length[k]
                if not len(keys):
                    continue
                spot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[spot] == h)
                ident[a, k, hit] = pieces[spot[hit]]
                gain[a, k, hit] = v.scores[pieces[spot[hit]]]
            lost = np.flatnonzero(ident[a, 0] < 0)
            if len(lost):
                c = codes[lost, a]
                size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
                gain[a, 0, lost] = v.floor * size
        ahead, back = np.full((n + 1, m), -np.inf), np.zeros((n + 1, m), np.int64)
        behind = np.full((n + 1, m), -np.inf)
        ahead[0] = behind[n] = 0
        for b in range(1, n + 1):
            for k in range(min(wide, b)):
                s = ahead[b - k - 1] + gain[b - k - 1, k]
                better = s > ahead[b]
                ahead[b] = np.where(better, s, ahead[b])
                back[b] = np.where(better, k, back[b])
        for a in range(n - 1, -1, -1):
            for k in range(min(wide, n - a)):
                behind[a] = np.maximum(behind[a], gain[a, k] + behind[a + k + 1])
        on = np.zeros((n, wide, m), bool)
        at, every = np.full(m, n), np.arange(m)
        while (live := every[at > 0]).size:
            k = back[at[live], live]
            at[live] -= k + 1
            on[at[live], k, live] = True
        second = np.full(m, -np.inf)
        for a in range(n):
            for k in range(min(wide, n - a)):
                through = ahead[a] + gain[a, k] + behind[a + k + 1]
                second = np.maximum(second, np.where(on[a, k], -np.inf, through))
        best = ahead[n]
        who, start, k = np.nonzero(on.transpose(2, 0, 1))
        taken = ident[start, k, who]
        cuts = np.searchsorted(who, np.arange(m + 1))
        rows = []
        unknown = set(who[taken < 0].tolist())
        for w in range(m):
            a, b = cuts[w], cuts[w + 1]
            if w in unknown:
                row: list[int] = []
                for i, x in zip(taken[a:b].tolist(), start[a:b].tolist()):
                    row += [i] if i >= 0 else v.single(words[w][x])[1]
                rows.append(np.array(row, np.int32))
            else:
                rows.append(taken[a:b])
        return best, np.where(np.isinf(second), np.inf, best - second), rows

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """Per text: ids of the best segmentation, and the n best as (score, edits of those ids)."""
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        index, rows = self.index, []
        for text in texts:
            words = self.vocabulary.words(text)
            row = list(map(index.get, words))
            if None in row:
                for k, c in enumerate(row):
                    if c is None:
                        c = index.get(words[k])
                        if c is None:
                            c = index[words[k]] = len(self.known)
                            self.known.append(words[k])
                            self.chars += len(words[k])
                        row[k] = c
            rows.append(np.array(row, np.int64))
        self._learn()
        size = np.diff(self.at)
        for row in rows:
            lens = size[row]
            starts = np.cumsum(lens) - lens
            take = np.repeat(self.at[row] - starts, lens) + np.arange(lens.sum())
            yield self.flat[take], self._merge(row, starts, lens)

    def _merge(self, row: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[tuple[float, list[tuple[int, int, list[int]]]]]:
        best = float(self.score[row].sum())
        paths: list[tuple[float, list[tuple[int, int, list[int]]]]] = [(0.0, [])]
        if self.n > 1 and len(row):
            loss = self.loss[row]
            if len(row) > self.n:
                bound = np.partition(loss, self.n - 2)[self.n - 2]
                near = np.concatenate([np.flatnonzero(loss < bound), np.flatnonzero(loss == bound)])[: self.n - 1]
            else:
                near = np.arange(len(row))
            for k in sorted(near[np.isfinite(loss[near])].tolist()):
                c = int(row[k])
                if c not in self.lists:
                    self.lists[c] = self.vocabulary.n_best(self.known[c], self.n)
                # of equally good paths, the one that stands in the best segmentation need not come first here
                own = self.flat[self.at[c] : self.at[c + 1]].tolist()
                options = [o for o in self.lists[c] if o[1] != own][: self.n - 1]
                top, grown = float(self.score[c]), list(paths)
                for lost, edits in paths:
                    grown += [(lost + top - s, [*edits, (int(starts[k]), int(lens[k]), ids)]) for s, ids in options]
                paths = sorted(grown, key=lambda p: p[0])[: self.n]
        return [(best - lost, edits) for lost, edits in paths]


def _plain(word: str) -> bool:
    """Whether numpy keeps the word as it is (it drops NULs at the end)."""
    return word[-1] != "\0"


def edited(ids: np.ndarray, edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """One of the n best: the best segmentation's ids with its edits."""
    out, at = [], 0
    for start, length, new in sorted(edits):
        out += [*ids[at:start].tolist(), *new]
        at = start + length
    return out + ids[at:].tolist()


def decode_ids(vocabulary: Vocabulary, ids) -> str:
    """The text of ids; the space in front, which encoding adds, is taken off."""
    table = vocabulary.bytes
    raw = b"".join([table[i] for i in ids])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


N_BEST_TYPE = "array<struct<score: double, edits: array<struct<start: int, length: int, ids: array<int>>>>>"
_KIND = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, model_path: str = MODEL_PATH, n_best: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_best for every row.

    ``ids`` is the best segmentation, ``n_best`` up to n_best of them, best first, each with its
    score and its edits of ids (none for the best).  A null text encodes like an empty one, which is
    the lone space mark.  Ties keep the order in which the search meets them, so equal texts get
    equal results; rows with equal or null ids are kept; other columns are ignored; an empty table
    gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, n_best)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            a = 0
            while a < len(batch):  # some texts at a time, whatever they weigh
                b, weight = a, 0
                while b < len(batch) and (b == a or weight < 2 << 20):
                    weight += len(texts[b].as_py() or "")
                    b += 1
                rows, best = [], []
                for own, paths in encoder.encode([x or "" for x in texts.slice(a, b - a).to_pylist()]):
                    rows.append(own)
                    best.append([{"score": s, "edits": [{"start": x, "length": n, "ids": i} for x, n, i in e]} for s, e in paths])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
                flat = pa.array(np.concatenate(rows).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(best, _KIND)], ["doc_id", "ids", "n_best"])
                a = b

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, ids array<int>, n_best {N_BEST_TYPE}")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, text, n_best: ids written back as text; null ids give a null text."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests, n = [], [], []
            for own in batch.column(1):
                ids = own.values.to_numpy(zero_copy_only=False) if own.is_valid else None
                texts.append(None if ids is None else decode_ids(held.value, ids.tolist()))
                digests.append(None if ids is None else hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                n.append(None if ids is None else len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), batch.column(2)], ["doc_id", "n_pieces", "ids_sha256", "text", "n_best"])

    return encoded.select("doc_id", "ids", "n_best").mapInArrow(run, f"doc_id long, n_pieces long, ids_sha256 string, text string, n_best {N_BEST_TYPE}")
