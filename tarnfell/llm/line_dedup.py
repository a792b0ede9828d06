"""Line dedup over sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of white space at both ends with A-Z lower-cased, stored as a
128-bit digest.  Keys of at least ``min_chars`` code points that at least two documents hold lose
all their lines except in the smallest of those documents.

State (``LineIndex``), three DataFrames:

* ``keys``: (hi, lo, doc_id), each key of each document once: the exact references;
* ``counts``: (hi, lo, owner, last, refs), their count per key, and the smallest holder;
* ``filters``: (shard, n, table, members), a cuckoo filter per shard of the repeated keys
  (refs >= 2), with those keys for the day it gets too full.

The filters let through what may be repeated and the exact counts decide, so false positives cost
a look-up and nothing else.  Insertions and deletions of documents update counts and filters by
the keys they touch, so a later deletion gives the next holder its lines back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_salted

MIN_CHARS = 10
SHARD_KEYS = 200_000
MIN_SHARDS = 8
#: Lines that are probed together; a shard with more of them, as of a very common line, is spread by documents.
PROBE_LINES = 50_000
#: Up to so many shards, how far each is spread goes by broadcast (a row of two numbers a shard).
BROADCAST_SHARDS = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"
_SLOTS = 4
_MAX_KICKS = 500


class CuckooFilter:
    """Partial-key cuckoo filter: buckets of four 16-bit prints; insert, delete and test many at once."""

    def __init__(self, capacity: int = 1024, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / (_SLOTS * 0.8)))))
            table = np.zeros((buckets, _SLOTS), np.uint16)
        self.table = table

    def _places(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        prints = (lo.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (hi.view(np.uint64) & mask).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, place: np.ndarray, prints: np.ndarray) -> np.ndarray:
        step = prints.astype(np.uint64) * np.uint64(0xC6A4A7935BD1E995) >> np.uint64(20)
        return place ^ (step & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _put(self, prints: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Puts what has room at its place; the positions of what had none."""
        order = np.argsort(place, kind="stable")
        p = place[order]
        start = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
        rank = np.arange(len(p)) - np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))
        free = self.table[p] == 0
        fits = rank < free.sum(1)
        slot = np.argmax((np.cumsum(free, 1) == (rank + 1)[:, None]) & free, 1)
        self.table[p[fits], slot[fits]] = prints[order][fits]
        return order[~fits]

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """False if the filter got too full (it is then of no more use)."""
        prints, one, two = self._places(hi, lo)
        rest = self._put(prints, one)
        rest = rest[self._put(prints[rest], two[rest])]
        rng = np.random.default_rng(len(self.table))
        for k in rest:
            value, at = prints[k], int(two[k])
            for _ in range(_MAX_KICKS):
                empty = np.flatnonzero(self.table[at] == 0)
                if len(empty):
                    self.table[at, empty[0]] = value
                    break
                slot = int(rng.integers(_SLOTS))
                value, self.table[at, slot] = self.table[at, slot], value
                at = int(self._other(np.array([at]), np.array([value], np.uint16))[0])
            else:
                return False
        return True

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(hi, lo)
        return (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Removes keys that were inserted before."""
        for value, *places in zip(*self._places(hi, lo)):
            for at in places:
                found = np.flatnonzero(self.table[at] == value)
                if len(found):
                    self.table[at, found[0]] = 0
                    break


@dataclass
class LineIndex:
    keys: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def _key(line: bytes, min_chars: int) -> bytes | None:
    line = line.strip(_SPACE).lower()
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(line, digest_size=16).digest()


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, owners = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if doc is None or not text.is_valid:
                    continue
                found = {k for line in text.as_buffer().to_pybytes().split(b"\n") if (k := _key(line, min_chars))}
                prints += found
                owners += [doc] * len(found)
            both = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(owners, pa.int64())], ["hi", "lo", "doc_id"])

    return run


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_keys(min_chars), "hi long, lo long, doc_id long")


def reference_counts(keys: DataFrame) -> DataFrame:
    """Exact counts per key; Spark adds them up per task before they meet."""
    return keys.groupBy("hi", "lo").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("refs"))


def _shard(shards: int):
    return F.pmod(F.shiftright("lo", 8), F.lit(shards)).cast("int").alias("shard")


def _maintain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shard, kind): 0 a stored filter, 1 keys to add, 2 keys to remove."""
    shard, stored, held = None, None, {1: [], 2: []}

    def made() -> pa.RecordBatch:
        adds, drops = (np.concatenate(held[k]) if held[k] else np.zeros((0, 2), np.int64) for k in (1, 2))
        table, members = stored or (None, np.zeros((0, 2), np.int64))
        if len(drops):
            gone = set(map(tuple, drops.tolist()))
            members = np.array([k for k in map(tuple, members.tolist()) if k not in gone], np.int64).reshape(-1, 2)
        members = np.concatenate([members, adds])
        f = CuckooFilter(max(64, len(members)), table)
        f.delete(drops[:, 0].copy(), drops[:, 1].copy())
        fits = f.insert(adds[:, 0].copy(), adds[:, 1].copy())
        while not fits:  # too full: twice the buckets, from the exact members
            f = CuckooFilter(len(f.table) * _SLOTS)
            fits = f.insert(members[:, 0].copy(), members[:, 1].copy())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(members)], pa.int64()), pa.array([f.table.tobytes()], pa.binary()), pa.array([members.tobytes()], pa.binary())], ["shard", "n", "table", "members"])

    for batch in batches:
        shards, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = np.stack([batch.column(2).fill_null(0).to_numpy(), batch.column(3).fill_null(0).to_numpy()], 1)
        edges = np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1
        for a, b in zip([0, *edges], [*edges, len(shards)]):
            if a == b:
                continue
            if shard != shards[a]:
                if shard is not None:
                    yield made()
                shard, stored, held = int(shards[a]), None, {1: [], 2: []}
            if kinds[a] == 0:
                table = np.frombuffer(batch.column(4)[int(a)].as_buffer(), np.uint16).reshape(-1, _SLOTS).copy()
                stored = table, np.frombuffer(batch.column(5)[int(a)].as_buffer(), np.int64).reshape(-1, 2)
            else:
                held[int(kinds[a])].append(rows[a:b])
    if shard is not None:
        yield made()


def _filters(shards: int, added: DataFrame, removed: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    none = F.lit(None)
    blank = [none.cast("binary").alias("table"), none.cast("binary").alias("members")]
    rows = added.select(_shard(shards), F.lit(1).alias("kind"), "hi", "lo", *blank)
    if removed is not None:
        rows = rows.union(removed.select(_shard(shards), F.lit(2), "hi", "lo", *blank))
    if stored is not None:
        rows = rows.union(stored.select("shard", F.lit(0), none.cast("long"), none.cast("long"), "table", "members"))
    return rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_maintain, "shard int, n long, table binary, members binary")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shard, salt, kind): the filter, then keys; passes on what it may hold."""
    shard, table = None, None
    for batch in batches:
        shards, kinds = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        hi, lo = batch.column(3).fill_null(0).to_numpy(), batch.column(4).fill_null(0).to_numpy()
        hit = np.zeros(len(shards), bool)
        edges = np.flatnonzero(np.diff(shards) | np.diff(kinds)) + 1
        for a, b in zip([0, *edges], [*edges, len(shards)]):
            if a == b:
                continue
            if kinds[a] == 0:
                shard, table = shards[a], CuckooFilter(table=np.frombuffer(batch.column(6)[int(a)].as_buffer(), np.uint16).reshape(-1, _SLOTS))
            elif shard == shards[a]:
                hit[a:b] = table.contains(hi[a:b].copy(), lo[a:b].copy())
        yield batch.select(["hi", "lo", "doc_id"]).filter(pa.array(hit))


def build(docs: DataFrame, min_chars: int = MIN_CHARS, shards: int | None = None, **columns: str) -> LineIndex:
    keys = cut(line_keys(docs, min_chars, **columns))
    counts = cut(reference_counts(keys).where("owner <> last"))
    shards = shards or max(MIN_SHARDS, -(-counts.count() // SHARD_KEYS))
    return LineIndex(keys, counts, cut(_filters(shards, counts)), shards)


def _with_keys(index: LineIndex, keys: DataFrame, touched: DataFrame) -> LineIndex:
    """The index over other keys; only counts of touched keys are taken anew, filters follow them."""
    touched = cut(touched.select("hi", "lo").distinct())
    fresh = cut(reference_counts(keys.join(touched, ["hi", "lo"], "left_semi")).where("owner <> last"))
    stale = index.counts.join(touched, ["hi", "lo"], "left_semi")
    counts = cut(index.counts.join(touched, ["hi", "lo"], "left_anti").unionByName(fresh))
    added, removed = fresh.join(stale, ["hi", "lo"], "left_anti"), stale.join(fresh, ["hi", "lo"], "left_anti")
    return LineIndex(keys, counts, cut(_filters(index.shards, added, removed, index.filters)), index.shards)


def insert(index: LineIndex, docs: DataFrame, min_chars: int = MIN_CHARS, **columns: str) -> LineIndex:
    """The index with more documents (ids that it holds already gain lines)."""
    new = cut(line_keys(docs, min_chars, **columns).join(index.keys, ["hi", "lo", "doc_id"], "left_anti"))
    return _with_keys(index, cut(index.keys.unionByName(new)), new)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents whose ids are in the first column of ids."""
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct()
    gone = cut(index.keys.join(ids, "doc_id", "left_semi"))
    return _with_keys(index, cut(index.keys.join(ids, "doc_id", "left_anti")), gone)


def dropped_keys(index: LineIndex) -> DataFrame:
    """(doc_id, hi, lo) of the keys that lose their lines in doc_id."""
    none, keys = F.lit(None), index.keys.select(_shard(index.shards), "hi", "lo", "doc_id")
    salts = keys.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_LINES).cast("int").alias("salts"))
    salts = F.broadcast(salts) if index.shards <= BROADCAST_SHARDS else salts
    lines = keys.join(salts, "shard").select("shard", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "hi", "lo", "doc_id", none.cast("binary").alias("table"))
    stored = index.filters.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0), none.cast("long"), none.cast("long"), none.cast("long"), "table")
    maybe = stored.union(lines).toDF("shard", "salt", "kind", "hi", "lo", "doc_id", "table").repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(_probe, "hi long, lo long, doc_id long")
    return join_salted(maybe, index.counts, ["hi", "lo"], "refs", "doc_id").where("doc_id <> owner").select("doc_id", "hi", "lo")


def _rebuild(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, gone = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            out = []
            for text, drop in zip(texts, gone):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = body.split(b"\n")
                if drop:
                    drop = {np.array([d["hi"], d["lo"]], np.int64).tobytes() for d in drop}
                    kept = [x for x in lines if _key(x, min_chars) not in drop]
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                else:
                    out.append((len(lines), 0, body))
            n, lost, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row.

    A null or empty text is one empty line.  Rows with equal ids are one document; a row without an
    id is none: it neither takes lines from others nor loses its own.  Ties can't arise, as ids
    order the holders.  An empty table gives no rows; other columns are ignored.
    """
    index = index or build(docs, min_chars, id_col=id_col, text_col=text_col)
    gone = dropped_keys(index).groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(_rebuild(min_chars), "doc_id long, n_lines long, n_dropped long, kept_text string")
