"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two documents link when 100 * |A & B| >= 80 * |A | B| over their sets of five-word shingles.

1. One pass hashes every text: a 64-bit stamp of the shingle set and its size stand for all
   documents with that set, and a count sketch of bounded size over all shingles of the corpus
   gives one global order, rare before frequent.
2. Linked sets of size n share one of the first n - ceil(0.8 n) + 1 shingles in that order; the
   inverted lists of those are short.  Pairs within lists of up to SHORT_LIST sets are counted, and
   a pair stays if the count can still lead to the required overlap, as in T-occurrence search.
   The sets of a longer list are tied to its first one instead, so no list makes many pairs; a task
   ties what it has met too often itself, so no list gathers in one task either.  The pairs and ties
   that stay divide the sets into connected parts.
3. Only sets in parts of two or more travel on.  A part is dealt out in chunks of up to BLOCK_SETS
   sets, and each is searched by DivideSkip: for each set the short inverted lists are merged, sets
   that occur often enough are probed in the long lists by binary search, and those that reach the
   required overlap are linked.  Sets already joined are not probed again, so a group of near
   copies costs a tree of links.
4. Of a part of several chunks, a few sets of every class found so far are searched together, again
   and again until they fit one chunk; that joins what belongs together across chunks.  Then every
   set of the part is probed, chunk by chunk, in the inverted lists of those that are not in the
   part's largest class, and connected components over the links that this finds join classes.  So
   each pair that could still do so is met, and a group of near copies costs about its size.
5. The smallest document id of each class.

``join`` needs a tree of links for each class only.  ``links`` returns all of them, between the
distinct sets (``members`` says which documents share one): there step 4 probes every set in all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_classes
from .graph import components
from .text_hash import shingle_sets

SHINGLE_WORDS = 5
PERCENT = 80
#: The sketch that orders shingles has about one counter for so many of them, within these bounds
#: (a rank takes a byte of broadcast, so 64 MB at most).
SHINGLES_PER_COUNTER = 24
SKETCH_BITS = (18, 26)
_CHUNK = 1 << 16
#: Lists of up to so many sets are counted pair by pair.
SHORT_LIST = 64
#: Shingles that one task searches at a time, and sets of one part.
BLOCK_SHINGLES, BLOCK_SETS = 3_000_000, 200
#: Sets of a class that stand for it when chunks are joined.
LEADERS = 4
#: How many times a part's shingles may be copied to spread its last search.
COPIES = 4
#: The count of sets tied by a long list.
TIED = 1 << 40
#: Size in a row that ties two sets, and how many long lists a task keeps in mind (16 bytes each).
TIE, MAX_LONG_LISTS = -1, 1_000_000
#: DivideSkip's factor between the cost of merging and of probing.
MU = 0.01


def _i64(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _slot(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (shingles >> np.uint64(64 - bits)).astype(np.int64)


def _sketch_bits(docs: DataFrame, text_col: str) -> int:
    """About log2 of the corpus' shingles over SHINGLES_PER_COUNTER, taking six bytes for a word."""
    weight = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(max((weight // (6 * SHINGLES_PER_COUNTER)).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def _stamp(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _count(sketch: np.ndarray, slots: list[np.ndarray]) -> None:
    if slots:
        at, n = np.unique(np.concatenate(slots), return_counts=True)
        sketch[at] += n.astype(np.uint32)


def _first_pass(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, slots, held = np.zeros(1 << bits, np.uint32), [], 0
        for batch in batches:
            stamps, sizes = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for k, s in shingle_sets(batch.column(1), size):
                sizes[k], stamps[k] = len(s), _stamp(s)
                slots.append(_slot(s, bits))
                if (held := held + len(s)) > 1 << 20:
                    _count(sketch, slots)
                    slots, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stamps), pa.array(sizes), pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], ["doc_id", "d", "n", "chunk", "counts"])
        _count(sketch, slots)
        parts = sketch.reshape(-1, _CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()), pa.array(used.astype(np.int32)), pa.array([_packed(parts[i]) for i in used], pa.binary())],
            ["doc_id", "d", "n", "chunk", "counts"],
        )

    return run


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u4").tobytes(), 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """The counters per chunk over all that a task reads, as many as the sketch has at most."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = sums.setdefault(chunk, np.zeros(_CHUNK, np.uint32))
            more = np.frombuffer(zlib.decompress(counts), "<u4")
            own[:] = np.minimum(own.astype(np.int64) + more, 0xFFFFFFFF)
    return sums


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _sums(batches)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], ["chunk", "counts"])


def _rank(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per counter a coarse rank: 0 for what is usual, more for each quarter doubling above it."""
        sums = _sums(batches)
        usual = max(1.0, sum(int(x.sum(dtype=np.int64)) for x in sums.values()) / (1 << bits))
        spread = usual + 4 * np.sqrt(usual)
        ranks = [np.clip(np.floor(4 * np.log2(np.maximum(x / spread, 1.0))), 0, 62).astype(np.uint8) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in ranks], pa.binary())], ["chunk", "counts"])

    return run


def _ranks(sketch: DataFrame, bits: int) -> np.ndarray:
    """One byte for each counter of the sketch, summed by tasks and then by one."""
    kind = "chunk int, counts binary"
    out = np.zeros((1 << bits) // _CHUNK * _CHUNK, np.uint8).reshape(-1, _CHUNK)
    for row in sketch.repartition("chunk").mapInArrow(_add_up, kind).repartition(1).mapInArrow(_rank(bits), kind).collect():
        out[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.reshape(-1)


def _prefix(s: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    keep = len(s) - -(-percent * len(s) // 100) + 1
    key = (ranks[_slot(s, len(ranks).bit_length() - 1)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
    return s[np.argsort(key, kind="stable")[:keep]]


class _LongLists:
    """The lists that one task has met more than ``short`` sets of, each with the first of them.

    Those sets stay postings, so the whole list is long too; any further set is tied to the first here
    and now.  So a very frequent shingle sends a few postings a task, however many sets hold it.
    """

    def __init__(self, short: int):
        self.short, self.keys, self.first = short, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each posting (distinct ones of one batch) stays one, and what it is tied to if not."""
        stays, tied = np.ones(len(h), bool), np.zeros(len(h), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            stays = self.keys[at] != h
            tied = np.where(stays, 0, self.first[at])
        open_ = np.flatnonzero(stays)
        order = open_[np.argsort(h[open_], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(order)))
        nth = np.arange(len(order)) - np.repeat(start, size)
        lead = np.repeat(d[order[start]], size)
        over = nth > self.short
        stays[order[over]], tied[order[over]] = False, lead[over]
        if len(self.keys) < MAX_LONG_LISTS:
            more = order[start[size > self.short]]
            keys, first = np.concatenate([self.keys, h[more]]), np.concatenate([self.first, d[more]])
            by = np.argsort(keys)
            self.keys, self.first = keys[by], first[by]
        return stays, tied


def _postings(size: int, percent: int, short: int, ranks):
    """Rows (h, d, n): a set in the list of h, or if n is TIE, set h is tied to set d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        long = _LongLists(short)
        for batch in batches:
            lists, stamps, sizes, here = [], [], [], set()
            for k, s in shingle_sets(batch.column(0), size):
                if len(s) and (d := _stamp(s)) not in seen and d not in here:
                    # repeats beyond that are met again where lists are sorted
                    (seen if len(seen) < 1_000_000 else here).add(d)
                    lists.append(_prefix(s, ranks.value, percent))
                    stamps.append(d)
                    sizes.append(len(s))
            if lists:
                lens = [len(x) for x in lists]
                h, d, n = _i64(np.concatenate(lists)), np.repeat(np.array(stamps, np.int64), lens), np.repeat(np.array(sizes, np.int32), lens)
                stays, tied = long.split(h, d)
                ties = np.unique(np.stack([d[~stays], tied[~stays]], 1), axis=0)
                ties = ties[ties[:, 0] != ties[:, 1]]
                cols = [np.concatenate(x) for x in ((h[stays], ties[:, 0]), (d[stays], ties[:, 1]), (n[stays], np.full(len(ties), TIE, np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "d", "n"])

    return run


def _pairs(percent: int, short: int):
    """From postings sorted by (h, n, d): a, b and how many lists of up to short sets hold both.

    In a longer list every set is tied to the first one, with a count that no filter stops; so are
    the ties that come along.
    """

    def made(a, b, na, nb, c) -> pa.RecordBatch:
        swap = a > b
        a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        order = np.lexsort((b, a))
        a, b, na, nb, c = a[order], b[order], na[order], nb[order], c[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        c = np.add.reduceat(c, at) if len(at) else c
        return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(na[at]), pa.array(nb[at]), pa.array(c)], ["a", "b", "na", "nb", "c"])

    def within(h, d, n, pivot) -> list[tuple]:
        """Pairs of whole lists; pivot: (h, d, n) of a list that goes on from before and is long."""
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        goes_on = pivot is not None and len(h) and h[0] == pivot[0]
        out = []
        many = np.repeat(size, size)
        long = many > short
        if goes_on:
            long[: size[0]] = True
        if long.any():
            lead = np.repeat(first, size)
            pd, pn = d[lead], n[lead]
            if goes_on:
                pd[: size[0]], pn[: size[0]] = pivot[1:]
            pick = long & (pd != d)
            out.append((pd[pick], d[pick], pn[pick], n[pick], np.full(int(pick.sum()), TIED, np.int64)))
        keep = ~long & (many > 1)
        h, d, n = h[keep], d[keep], n[keep]
        for step in range(1, short):
            if len(h) <= step:
                break
            pick = (h[step:] == h[:-step]) & (100 * n[:-step].astype(np.int64) >= percent * n[step:].astype(np.int64))
            if not pick.any() and not (h[step:] == h[:-step]).any():
                break
            out.append((d[:-step][pick], d[step:][pick], n[:-step][pick], n[step:][pick], np.ones(int(pick.sum()), np.int64)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, pivot = None, None
        for batch in _and_last(batches):
            cols = [batch.column(i).to_numpy() for i in range(3)] if batch is not None else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
            if (tie := cols[2] == TIE).any():
                one = np.ones(int(tie.sum()), np.int32)
                yield made(cols[0][tie], cols[1][tie], one, one, one * np.int64(TIED))
                cols = [x[~tie] for x in cols]
            if batch is not None and not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            h, d, n = cols
            if not len(h):
                continue
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d, n = h[once], d[once], n[once]
            cut_at = len(h) if batch is None else int(np.searchsorted(h, h[-1]))
            tail = len(h) - cut_at
            on = pivot is not None and pivot[0] == h[-1]
            if batch is not None and (on or tail > short):  # a long list that may go on: tie what is there
                found = within(h, d, n, pivot)
                if not on:
                    pivot = (h[-1], d[cut_at], n[cut_at])
                # lists before the last one are whole; the last one is long whatever follows
                rest = (h[-1:], d[-1:], n[-1:])
            else:
                found = within(h[:cut_at], d[:cut_at], n[:cut_at], pivot)
                rest = (h[cut_at:], d[cut_at:], n[cut_at:])
                if pivot is not None and len(rest[0]) and rest[0][0] != pivot[0]:
                    pivot = None
            if found:
                yield made(*(np.concatenate(x) for x in zip(*found)))

    return run


def _and_last(batches):
    yield from batches
    yield None


def _sets(size: int):
    """Stamp, size and shingles of every text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_stamp(s), len(s), s.tobytes()) for _, s in shingle_sets(batch.column(0), size) if len(s)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.binary()])], ["d", "n", "s"])

    return run


class Lists:
    """Inverted lists over sets (sorted arrays, in order of their sizes): who shares how much with a set."""

    def __init__(self, sets: list[np.ndarray]):
        self.lens = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        by = np.argsort(flat, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = flat[by][1:] != flat[by][:-1]
        self.keys = flat[by][new]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(by)))
        self.posted = np.repeat(np.arange(len(sets)), self.lens)[by]
        self.probe = (np.cumsum(new) - 1) * max(1, len(sets)) + self.posted  # sorted: for binary search of (list, set)

    def linked(self, s: np.ndarray, percent: int, least: int, below: int, skip) -> Iterator[tuple[int, int]]:
        """(position, overlap) of the sets in lists of at least ``least`` that link with s, of positions under ``below``.

        Short lists are merged; what occurs often enough there, and skip(position) does not rule out,
        is probed in the long ones.
        """
        n = len(s)
        need = -(-percent * n // 100)
        lo, hi = int(np.searchsorted(self.lens, need)), min(below, int(np.searchsorted(self.lens, 100 * n // percent, "right")))
        if lo >= hi or not n:
            return
        own = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        own = own[self.keys[own] == s]
        own = own[self.size[own] >= least]
        if len(own) < need:
            return
        own = own[np.argsort(self.size[own], kind="stable")]
        n_long = min(need - 1, int(need / (MU * np.log2(self.size[own[-1]]) + 1)))
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        count = self.size[short]
        at = np.repeat(self.first[short] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        merged = self.posted[at]
        merged = merged[(merged < hi) & (merged >= lo)]
        if not len(merged):
            return
        seen = np.bincount(merged - lo)
        likely = np.flatnonzero(seen >= need - n_long)
        for k in likely[np.argsort(-seen[likely], kind="stable")]:
            y, have = int(k) + lo, int(seen[k])
            if skip(y):
                continue
            if n_long:
                q = long * len(self.lens) + y
                have += int((self.probe[np.minimum(np.searchsorted(self.probe, q), len(self.probe) - 1)] == q).sum())
            if 100 * have >= percent * (n + int(self.lens[y]) - have):
                yield y, have


class Classes(dict):
    """Which labels have been joined."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


def _joined(sets: list[np.ndarray], labels: list[int], percent: int, classes: Classes) -> Iterator[tuple[int, int]]:
    """Links between sets in order of their sizes that join two classes of labels; classes learns them."""
    lists = Lists(sets)
    for x in range(1, len(sets)):
        for y, _ in lists.linked(sets[x], percent, 2, x, lambda y: classes.root(labels[x]) == classes.root(labels[y])):  # noqa: B023
            classes.join(labels[x], labels[y])
            yield x, y


def divide_skip(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sorted distinct sets, as a forest: positions that join two groups not yet joined."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    return [(order[x], order[y]) for x, y in _joined([sets[k] for k in order], list(range(len(order))), percent, Classes())]


#: What a search says of each set: the label it had, the least label of its class, and of the sets of
#: parts that are in several chunks the shingles, and whether it stands for its class.
FOUND = "part long, chunks int, d long, n long, was long, label long, leader boolean, s binary"
_FOUND_KIND = pa.schema([("part", pa.int64()), ("chunks", pa.int32()), ("d", pa.int64()), ("n", pa.int64()), ("was", pa.int64()), ("label", pa.int64()), ("leader", pa.bool_()), ("s", pa.binary())])


def _search(percent: int):
    """Classes within each chunk, from rows (part, chunks, chunk, d, n, label, s) sorted by (part, chunk, n, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, labels, sets = None, [], [], []
        part = chunks = 0

        def found() -> pa.RecordBatch:
            classes, led = Classes(), Counter()
            for _ in _joined(sets, labels, percent, classes):
                pass
            rows = []
            for d, was, s in zip(ids, labels, sets):
                label = classes.root(was)
                led[label] += 1
                rows.append((part, chunks, d, len(s), was, label, led[label] <= LEADERS, s.tobytes() if chunks > 1 else None))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND_KIND)], schema=_FOUND_KIND)

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)]
            s = batch.column(6)
            for k, (p, wide, chunk, d, label) in enumerate(zip(*cols)):
                if unit != (p, chunk):
                    if ids:
                        yield found()
                    unit, part, chunks, ids, labels, sets = (p, chunk), p, wide, [], [], []
                if ids and ids[-1] == d:
                    continue
                ids.append(d)
                labels.append(label)
                sets.append(np.frombuffer(s[k].as_buffer(), np.uint64).copy())
        if ids:
            yield found()

    return run


LINK = "a long, b long, shared long"


def _probe(percent: int, forest: bool):
    """Links of probes (role 1) with the sets of their unit that are listed (role 0), from rows
    (part, i, j, role, d, label, rest, s) sorted by (part, i, j, role, n, d).

    forest: labels of classes that are joined; else every two sets.  Of two listed sets the larger stamp probes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, lists, ids, labels, sets, classes, last = None, None, [], [], [], Classes(), None
        for batch in batches:
            found = []
            part, i, j, role, d, label, rest = (batch.column(k).to_pylist() for k in range(7))
            s = batch.column(7)
            for k in range(len(batch)):
                if unit != (part[k], i[k], j[k]):
                    unit, lists, ids, labels, sets, classes, last = (part[k], i[k], j[k]), None, [], [], [], Classes(), None
                if last == (role[k], d[k]):
                    continue
                last = role[k], d[k]
                own = np.frombuffer(s[k].as_buffer(), np.uint64).copy()
                if role[k] == 0:
                    ids.append(d[k])
                    labels.append(label[k])
                    sets.append(own)
                    continue
                if lists is None:
                    lists, sets = Lists(sets), []

                def skip(y: int, x: int = d[k], c: int = label[k], listed: bool = rest[k]) -> bool:
                    return listed and ids[y] >= x or forest and classes.root(labels[y]) == classes.root(c)  # noqa: B023

                for y, shared in lists.linked(own, percent, 1, len(ids), skip):
                    found.append((label[k], labels[y], shared))
                    if forest:
                        classes.join(labels[y], label[k])
            cols = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "shared"])

    return run


def _chunks(block_shingles: int, block_sets: int):
    return F.greatest(F.ceil(F.col("w") / block_shingles), F.ceil(F.col("m") / block_sets)).cast("int").alias("chunks")


def _within_chunks(placed: DataFrame, percent: int) -> DataFrame:
    dealt = placed.repartition("part", "chunk").sortWithinPartitions("part", "chunk", "n", "d")
    return cut(dealt.select("part", "chunks", "chunk", "d", "n", "label", "s").mapInArrow(_search(percent), FOUND))


def _across_chunks(rows: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Links from rows (part, d, n, label, rest, blocks, probes, s): each set probed in those of its part's rest."""
    own, upto = F.shiftright("d", 7), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumns({"i": F.pmod(own, F.col("blocks")).cast("int"), "j": F.pmod(F.shiftright(own, 11), F.col("probes")).cast("int")})
    listed = rows.where("rest").select("part", "i", F.explode(upto("probes")).alias("j"), F.lit(0).alias("role"), "d", "label", "rest", "n", "s")
    probes = rows.select("part", F.explode(upto("blocks")).alias("i"), "j", F.lit(1).alias("role"), "d", "label", "rest", "n", "s")
    units = listed.unionByName(probes).repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "role", "n", "d")
    return cut(units.select("part", "i", "j", "role", "d", "label", "rest", "s").mapInArrow(_probe(percent, forest), LINK))


def _spread(listed: str, block_shingles: int) -> dict:
    """Into how many blocks a part's listed shingles go, and its probes: enough chunks to spread them, as
    long as that copies the listed ones to COPIES times the part at most."""
    spread = F.least(F.col("chunks"), F.floor(COPIES * F.col("w") / F.col(listed)).cast("int"))
    return {"blocks": F.ceil(F.col(listed) / block_shingles).cast("int"), "probes": F.greatest(F.ceil(F.col("w") / block_shingles).cast("int"), spread)}


def _wide_classes(found: DataFrame, percent: int, block_shingles: int, block_sets: int) -> DataFrame:
    """label, root: over all chunks, the class of each class that a chunk of a wide part has."""
    classes = cut(found.groupBy("part", "chunks", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n")).withColumn("now", F.col("label")))
    leaders, left = found.where("leader").select("part", "d", "n", "label", "s"), None
    while True:
        weights = leaders.groupBy("part").agg(F.sum("n").alias("w"), F.count("*").alias("m"))
        weights = cut(weights.select("part", "m", _chunks(block_shingles, block_sets)))
        m, most = weights.agg(F.sum("m"), F.max("chunks")).first()
        if left is not None and m > left // 2:  # what is left does not join
            break
        left = m
        # all leaders of a class in one chunk, so that what becomes of it is said once
        dealt = join_classes(leaders, weights, ["part"], "m").withColumn("chunk", F.pmod(F.xxhash64("label"), F.col("chunks")).cast("int"))
        led = _within_chunks(dealt, percent)
        became = led.select("part", F.col("was").alias("now"), F.col("label").alias("next")).distinct()
        classes = cut(classes.join(became, ["part", "now"], "left").withColumn("now", F.coalesce("next", "now")).drop("next"))
        if most == 1:
            break
        leaders = led.where("leader and chunks > 1").select("part", "d", "n", "label", "s")
    merged = classes.groupBy("part", "now").agg(F.sum("n").alias("n"))
    tops = merged.groupBy("part").agg(F.max_by("now", F.struct("n", "now")).alias("top"), F.sum("n").alias("w"), F.max("n").alias("most"), F.count("*").alias("k"))
    tops = tops.where("k > 1").select("part", "top", "w", (F.col("w") - F.col("most")).alias("listed"))
    dealt = cut(classes.join(tops, "part").withColumns(_spread("listed", block_shingles)).select("part", "label", "now", "size", (F.col("now") != F.col("top")).alias("rest"), "blocks", "probes"))
    rows = join_classes(found.select("part", "d", "n", "label", "s"), dealt, ["part", "label"], "size").withColumn("label", F.col("now"))
    roots = components(_across_chunks(rows, percent, True).select("a", "b"))
    return classes.join(roots, F.col("now") == F.col("node"), "left").select("label", F.coalesce("root", "now").alias("root"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _candidates(rows: DataFrame, shingle_words: int, percent: int, block_shingles: int, block_sets: int) -> tuple[DataFrame, DataFrame]:
    """Stamp and size of every document's set, and the sets that may link, dealt to parts and chunks."""
    bits = _sketch_bits(rows, "text")
    first = cut(rows.mapInArrow(_first_pass(shingle_words, bits), "doc_id long, d long, n long, chunk int, counts binary"))
    narrow = first.where("chunk is null").select("doc_id", "d", "n")
    sketch = first.where("chunk is not null").select("chunk", "counts")
    ranks = rows.sparkSession.sparkContext.broadcast(_ranks(sketch, bits))
    postings = rows.select("text").mapInArrow(_postings(shingle_words, percent, SHORT_LIST, ranks), "h long, d long, n int")
    counted = postings.repartition("h").sortWithinPartitions("h", "n", "d").mapInArrow(_pairs(percent, SHORT_LIST), "a long, b long, na int, nb int, c long")
    counted = counted.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"))
    # beyond the shared prefix at most ceil(percent n / 100) - 1 shingles of the larger set can be shared
    needed = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent)) - F.ceil(percent * F.greatest("na", "nb") / 100) + 1
    parts = components(counted.where(F.col("c") >= needed).select("a", "b"))
    nodes = narrow.where("n > 0").groupBy("d").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    sized = cut(nodes.join(parts, nodes["d"] == parts["node"]).select("rep", "d", "n", F.col("root").alias("part")))
    weights = cut(sized.groupBy("part").agg(F.sum("n").alias("w"), F.count("*").alias("m")))
    dealt = join_classes(sized.select("part", "d", "n"), weights.withColumn("chunks", _chunks(block_shingles, block_sets)), ["part"], "m")
    # texts by the ids of candidates, sets by their own stamps: an id may be that of many texts
    texts = rows.join(sized.select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(shingle_words), "d long, n long, s binary").drop("n")
    chunk = F.pmod(F.shiftright("d", 7), F.col("chunks")).cast("int").alias("chunk")
    return narrow, sets.join(dealt, "d").select("part", "w", "chunks", chunk, "d", "n", F.col("d").alias("label"), "s")


def _classes(placed: DataFrame, percent: int, block_shingles: int, block_sets: int) -> DataFrame:
    """d, label: the class of every set that may link."""
    found = _within_chunks(placed, percent)
    own = found.select("d", "label")
    wide = found.where("chunks > 1")
    if wide.isEmpty():
        return own
    over = _wide_classes(wide, percent, block_shingles, block_sets).withColumnRenamed("label", "of")
    return own.join(over, F.col("label") == F.col("of"), "left").select("d", F.coalesce("root", "label").alias("label"))


def join(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A null or empty text (or one of white space) has no shingles, links with nothing and is a
    component of its own; equal texts link; a null id never names a component that has another id;
    rows with equal ids are documents of their own.  Empty tables give no rows; only the id and the
    text are read.
    """
    narrow, placed = _candidates(_documents(docs, id_col, text_col), shingle_words, percent, block_shingles, block_sets)
    classes = _classes(placed, percent, block_shingles, block_sets)
    labelled = cut(narrow.where("n > 0").join(classes, "d", "left").select("doc_id", "n", F.coalesce("label", "d").alias("label")))
    names = cut(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")))
    full = join_classes(labelled, names, ["label"], "size").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(narrow.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def members(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_id, n_shingles for every row: documents with the same shingles have the same set_id (null: none)."""
    rows = _documents(docs, id_col, text_col).mapInArrow(_first_pass(shingle_words, SKETCH_BITS[0]), "doc_id long, d long, n long, chunk int, counts binary")
    return rows.where("chunk is null").select("doc_id", F.when(F.col("n") > 0, F.col("d")).alias("set_id"), F.col("n").alias("n_shingles"))


def links(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """set_id, other_id, shared: every link between different sets once, set_id < other_id; ``members`` has their documents.

    As many rows as there are links, which in a group of near copies is up to the square of its
    distinct sets.  Edge cases are those of ``join``.
    """
    _, placed = _candidates(_documents(docs, id_col, text_col), shingle_words, percent, block_shingles, block_sets)
    found = _across_chunks(placed.withColumn("rest", F.lit(True)).withColumns(_spread("w", block_shingles)), percent, False)
    return found.select(F.least("a", "b").alias("set_id"), F.greatest("a", "b").alias("other_id"), "shared")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents whose component holds a smaller id; rows with equal ids share a fate."""
    found = join(docs, id_col=id_col, **options)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("_gone"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    return packed.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
