"""Vectorised word and shingle hashes over Arrow string columns.

A word's hash is a polynomial over its bytes modulo 2**64, read off one running sum for many texts
at once, then mixed.  Pieces of at most PIECE bytes are worked on at a time, so memory stays
bounded whatever a batch or a single text weighs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_P = 0x9E3779B97F4A7C15
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        _tables["up"] = _powers(_P, PIECE + 1)
        _tables["down"] = _powers(pow(_P, -1, 1 << 64), PIECE + 1)
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        _tables["fold"] = fold
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _tables["space"] = space
    return _tables[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data and the start of each; no word crosses a bound."""
    solid = ~_table("space")[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_table("fold")[data].astype(np.uint64) + np.uint64(1)) * _table("up")[: len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * _table("down")[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _Q), starts


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, cuts) for runs of texts: text k has hashes[cuts[k-first]:cuts[k-first+1]]."""
    data, offsets = _strings(column)
    k, n = 0, len(column)
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        a, b = offsets[k], offsets[end]
        if b - a <= PIECE:
            h, starts = _piece(data[a:b], offsets[k : end + 1] - a)
            yield k, end, h, np.searchsorted(starts, offsets[k : end + 1] - a)
        else:  # one long text, cut where white space allows
            parts, space = [], _table("space")
            while a < b:
                stop = min(b, a + PIECE)
                if stop < b:
                    gaps = np.flatnonzero(space[data[a:stop]])
                    if len(gaps):
                        stop = a + int(gaps[-1]) + 1
                    else:  # a word longer than a piece: hash it by parts
                        while stop < b and not space[data[stop]]:
                            stop += 1
                        parts.append(_long_word(data[a:stop]))
                        a = stop
                        continue
                parts.append(_piece(data[a:stop], np.zeros(0, np.int64))[0])
                a = stop
            h = np.concatenate(parts)
            yield k, end, h, np.array([0, len(h)])
        k = end


def _long_word(data: np.ndarray) -> np.ndarray:
    h = 0
    for a in range(0, len(data), PIECE):
        part = (_table("fold")[data[a : a + PIECE]].astype(np.uint64) + np.uint64(1)) * _table("up")[: len(data[a : a + PIECE])]
        h = (h * _P + int(part.sum(dtype=np.uint64))) & _MASK
    return mix(np.array([(h + len(data)) & _MASK], np.uint64))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); a text of fewer words is one shingle, of none nothing."""
    q = np.array([pow(int(_Q), i + 1, 1 << 64) for i in range(size)], np.uint64)
    for first, last, h, cuts in words(column):
        full = sum((h[i : len(h) - size + 1 + i] * q[i] for i in range(size)), np.uint64(size)) if len(h) >= size else h[:0]
        full = mix(full)
        for k in range(first, last):
            a, b = cuts[k - first], cuts[k - first + 1]
            if b - a >= size:
                yield k, np.unique(full[a : b - size + 1])
            elif b > a:
                yield k, mix((h[a:b] * q[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield k, h[:0]
