"""Media columns over ISO base media files.

``media_index`` walks the nested boxes of a file, decodes the sample tables of every track, those of
the movie and those of its fragments, and stores codec, duration and the byte ranges of key frames;
no payload is decoded.  Times are those of presentation: decode times, composition offsets, and the
edit list's start.  ``mux`` writes bytes as such a file: a video track of raw 8x8 grey frames, so one
sample is 64 bytes and the bytes are stored as they are; ``payload`` reads them back through the
sample tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: box types that hold boxes, and header bytes before a child list.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"moof": 0, b"traf": 0, b"mvex": 0}
MAX_DEPTH = 16
FRAME_BYTES = 64
FRAMES_PER_SECOND = 25
KEY_EVERY = 16
FRAMES_PER_CHUNK = 32


class MediaError(ValueError):
    """The bytes are not a file that can be indexed."""


#: Fixed values of the format: flags of the boxes tfhd and trun, and of a sample that needs others.
TFHD_BASE, TFHD_ENTRY, TFHD_DURATION, TFHD_SIZE, TFHD_FLAGS, TFHD_BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TRUN_OFFSET, TRUN_FIRST_FLAGS, TRUN_DURATION, TRUN_SIZE, TRUN_FLAGS, TRUN_COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
SAMPLE_DEPENDS = 0x10000


@dataclass
class MediaIndex:
    """One track: its samples in decode order, with times in units of the timescale."""

    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    keys: np.ndarray  # positions of key frames
    track: int = 0
    handler: str = ""

    @property
    def duration_ms(self) -> float:
        return 1000.0 * self.duration / self.timescale if self.timescale else 0.0

    def time_ms(self, sample: int) -> float:
        return 1000.0 * float(self.times[sample]) / self.timescale if self.timescale else 0.0


def boxes(data, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of the boxes side by side in data[start:end]."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise MediaError("cut off in a box header")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError(f"box {kind!r} leaves its parent")
        yield kind, start + head, start + size
        start += size
    if start != end and any(bytes(data[start:end])):
        raise MediaError("bytes after the last box")


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes, parents before children, each with its path."""
    if len(path) > MAX_DEPTH:
        raise MediaError("boxes nest too deep")
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


def _ints(data, at: int, n: int, kind: str = ">u4") -> np.ndarray:
    if n < 0 or at + n * np.dtype(kind).itemsize > len(data):
        raise MediaError("a table leaves its box")
    return np.frombuffer(data, kind, n, at).astype(np.int64)


def _sizes(data, kind: bytes, at: int) -> np.ndarray:
    if kind == b"stsz":
        each, n = struct.unpack_from(">II", data, at + 4)
        if each:
            if n * each > len(data):
                raise MediaError("more samples than bytes")
            return np.full(n, each, np.int64)
        return _ints(data, at + 12, n)
    width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if width == 4:
        both = _ints(data, at + 12, (n + 1) // 2, ">u1")
        return np.stack([both >> 4, both & 15], 1).reshape(-1)[:n]
    if width not in (8, 16):
        raise MediaError("stz2 width")
    return _ints(data, at + 12, n, f">u{width // 8}")


def _offsets(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Where each sample starts: chunks' places, samples per chunk by runs (first chunk, samples)."""
    if not len(sizes):
        return sizes
    if not len(runs) or not len(chunks) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise MediaError("stsc")
    upto = np.append(runs[1:, 0] - 1, len(chunks))
    per = np.repeat(runs[:, 1], np.maximum(upto - (runs[:, 0] - 1), 0))[: len(chunks)]
    if per.sum() < len(sizes):
        raise MediaError("fewer samples in chunks than sizes")
    chunk = np.repeat(np.arange(len(per)), per)[: len(sizes)]
    ahead = np.cumsum(sizes) - sizes
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    return chunks[chunk] + ahead - ahead[np.minimum(first[chunk], len(sizes) - 1)]


def _version_1(data, at: int) -> bool:
    return data[at] == 1


def _movie(data) -> tuple[list[dict], dict[int, dict], int]:
    """The tables of each track of the movie, the defaults of fragments by track, and the movie's timescale."""
    tracks: list[dict] = []
    defaults: dict[int, dict] = {}
    scale = 0
    for path, a, b in walk(data):
        kind = path[-1]
        if path == (b"moov", b"mvhd"):
            scale = struct.unpack_from(">I", data, a + (20 if _version_1(data, a) else 12))[0]
        elif path == (b"moov", b"mvex", b"trex"):
            track, entry, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif path == (b"moov", b"trak"):
            tracks.append({"track": 0, "handler": ""})
        elif path[:2] != (b"moov", b"trak"):
            continue
        elif kind == b"tkhd":
            tracks[-1]["track"] = struct.unpack_from(">I", data, a + (20 if _version_1(data, a) else 12))[0]
        elif path[-2:] == (b"mdia", b"hdlr"):
            tracks[-1]["handler"] = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"mdhd":
            tracks[-1]["time"] = struct.unpack_from(">IQ", data, a + 20) if _version_1(data, a) else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            tracks[-1]["codec"] = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind in (b"stsz", b"stz2"):
            tracks[-1]["sizes"] = _sizes(data, kind, a)
        elif kind in (b"stco", b"co64"):
            tracks[-1]["chunks"] = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], ">u4" if kind == b"stco" else ">u8")
        elif kind == b"stsc":
            tracks[-1]["runs"] = _ints(data, a + 8, 3 * struct.unpack_from(">I", data, a + 4)[0]).reshape(-1, 3)
        elif kind == b"stts":
            tracks[-1]["deltas"] = _ints(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0]).reshape(-1, 2)
        elif kind == b"ctts":
            table = _ints(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0], ">i4" if _version_1(data, a) else ">u4")
            tracks[-1]["shifts"] = table.reshape(-1, 2)
        elif kind == b"stss":
            tracks[-1]["keys"] = _ints(data, a + 8, struct.unpack_from(">I", data, a + 4)[0]) - 1
        elif kind == b"elst":
            tracks[-1]["edits"] = _edits(data, a)
    return tracks, defaults, scale


def _edits(data, at: int) -> list[tuple[int, int]]:
    """(duration in the movie's units, first media time; -1 for an empty edit)."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    kind, step = (">Qq", 20) if _version_1(data, at) else (">Ii", 12)
    if n * step > len(data):
        raise MediaError("a table leaves its box")
    return [struct.unpack_from(kind, data, at + 8 + step * k) for k in range(n)]


def _fragments(data, defaults: dict[int, dict]) -> dict[int, list[dict]]:
    """Runs of samples by track: offsets, sizes, durations, flags, composition offsets, and the time of the first if told."""
    out: dict[int, list[dict]] = {}
    moof = end = 0
    head: dict = {}
    for path, a, b in walk(data):
        if path == (b"moof",):
            moof = end = a - (8 if bytes(data[a - 4 : a]) == b"moof" else 16)
        elif path == (b"moof", b"traf"):
            head = {}
        elif path == (b"moof", b"traf", b"tfhd"):
            flags, track = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
            if track not in defaults:
                raise MediaError(f"a fragment of track {track}, which the movie does not extend")
            # where nothing is told, data follows on what the fragment before it holds, at first on the moof
            head, at = dict(defaults[track], track=track, base=moof if flags & TFHD_BASE_IS_MOOF else end), a + 8
            for flag, name, kind in ((TFHD_BASE, "base", ">Q"), (TFHD_ENTRY, "entry", ">I"), (TFHD_DURATION, "duration", ">I"), (TFHD_SIZE, "size", ">I"), (TFHD_FLAGS, "flags", ">I")):
                if flags & flag:
                    head[name] = struct.unpack_from(kind, data, at)[0]
                    at += struct.calcsize(kind)
            head["next"] = head["base"]
        elif path == (b"moof", b"traf", b"tfdt"):
            head["time"] = struct.unpack_from(">Q" if _version_1(data, a) else ">I", data, a + 4)[0]
        elif path == (b"moof", b"traf", b"trun"):
            if "track" not in head:
                raise MediaError("a run without a track")
            run = _run(data, a, head)
            head["next"] = end = int(run["offsets"][-1] + run["sizes"][-1]) if len(run["sizes"]) else head["next"]
            out.setdefault(head["track"], []).append(run)
    return out


def _run(data, a: int, head: dict) -> dict:
    version, flags, n = data[a], struct.unpack_from(">I", data, a)[0] & 0xFFFFFF, struct.unpack_from(">I", data, a + 4)[0]
    at, first, start = a + 8, None, head["next"]
    if flags & TRUN_OFFSET:
        start = head["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & TRUN_FIRST_FLAGS:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    told = [name for flag, name in ((TRUN_DURATION, "duration"), (TRUN_SIZE, "size"), (TRUN_FLAGS, "flags"), (TRUN_COMPOSITION, "shift")) if flags & flag]
    if n > len(data):
        raise MediaError("more samples than bytes")
    table = _ints(data, at, n * len(told)).reshape(n, len(told))
    column = lambda name, other: table[:, told.index(name)] if name in told else np.full(n, other, np.int64)
    sizes, own, shifts = column("size", head["size"]), column("flags", head["flags"]).copy(), column("shift", 0)
    if first is not None and n:
        own[0] = first
    if version == 1:
        shifts = shifts.astype(np.uint32).view(np.int32).astype(np.int64)
    return {"offsets": start + np.cumsum(sizes) - sizes, "sizes": sizes, "durations": column("duration", head["duration"]), "shifts": shifts, "keys": own & SAMPLE_DEPENDS == 0, "time": head.pop("time", None)}


def _track(data, t: dict, runs: list[dict], scale: int) -> MediaIndex:
    if missing := {"time", "codec"} - set(t):
        raise MediaError(f"no {sorted(missing)[0]}")
    n = len(t.get("sizes", ()))
    if n or not runs:
        if missing := {"sizes", "chunks", "runs", "deltas"} - set(t):
            raise MediaError(f"no {sorted(missing)[0]}")
        if t["deltas"][:, 0].sum() != n:
            raise MediaError("stts")
        offsets, sizes = _offsets(t["sizes"], t["chunks"], t["runs"]), t["sizes"]
        durations = np.repeat(t["deltas"][:, 1], t["deltas"][:, 0])
    else:
        offsets = sizes = durations = np.zeros(0, np.int64)
    shifts = np.zeros(n, np.int64)
    if "shifts" in t:
        if (t["shifts"][:, 0] < 0).any() or t["shifts"][:, 0].sum() != n:
            raise MediaError("ctts")
        shifts = np.repeat(t["shifts"][:, 1], t["shifts"][:, 0])
    keys = t.get("keys", np.arange(n))
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise MediaError("samples outside the file")
    times, upto = np.cumsum(durations) - durations + shifts, int(durations.sum())
    parts = {"offsets": [offsets], "sizes": [sizes], "times": [times], "keys": [keys]}
    for run in runs:
        begin = upto if run["time"] is None else int(run["time"])
        parts["offsets"].append(run["offsets"])
        parts["sizes"].append(run["sizes"])
        parts["times"].append(begin + np.cumsum(run["durations"]) - run["durations"] + run["shifts"])
        parts["keys"].append(n + np.flatnonzero(run["keys"]))
        n, upto = n + len(run["sizes"]), begin + int(run["durations"].sum())
    offsets, sizes, times, keys = (np.concatenate(parts[c]) for c in ("offsets", "sizes", "times", "keys"))
    if n and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise MediaError("samples outside the file")
    timescale, duration = t["time"]
    # the first edit that shows media says what time is shown first, empty ones before it by how much later
    late = 0
    for length, first in t.get("edits", ()):
        if first >= 0:
            times = times - first
            break
        late += length
    if late and scale:
        times = times + late * timescale // scale
    return MediaIndex(t["codec"], timescale, max(duration, upto) if runs else duration, offsets, sizes, times, keys, t["track"], t["handler"])


def tracks(data: bytes) -> list[MediaIndex]:
    """Every track of a file, with the samples of the movie and of all fragments."""
    try:
        movie, defaults, scale = _movie(data)
        if not movie:
            raise MediaError("no track")
        runs = _fragments(data, defaults) if any(kind == b"moof" for kind, _, _ in boxes(data)) else {}
        if lost := set(runs) - {t["track"] for t in movie}:
            raise MediaError(f"a fragment of track {min(lost)}, which the movie does not have")
        return [_track(data, t, runs.get(t["track"], []), scale) for t in movie]
    except (struct.error, IndexError) as why:
        raise MediaError(str(why)) from why


def main_track(found: list[MediaIndex]) -> MediaIndex:
    """The first video track that has samples, else the first track that has, else the first."""
    with_samples = [t for t in found if len(t.sizes)]
    return next((t for t in with_samples if t.handler == "vide"), (with_samples or found)[0])


def index(data: bytes) -> MediaIndex:
    return main_track(tracks(data))


def payload(data: bytes, at: MediaIndex) -> bytes:
    """The bytes of all samples, in order."""
    if not len(at.sizes):
        return b""
    run = np.concatenate([[True], at.offsets[1:] != at.offsets[:-1] + at.sizes[:-1]])
    starts = np.flatnonzero(run)
    ends = np.append(starts[1:], len(run)) - 1
    return b"".join(data[at.offsets[a] : at.offsets[b] + at.sizes[b]] for a, b in zip(starts, ends))


def pad(body: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of a frame."""
    return body + bytes(-len(body) % FRAME_BYTES or (0 if body else FRAME_BYTES))


def _box(kind: bytes, *parts: bytes) -> bytes:
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def mux(body: bytes) -> bytes:
    """body, a multiple of FRAME_BYTES, as an ISO media file."""
    n = len(body) // FRAME_BYTES
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    sides = struct.pack(">II", 8 << 16, 8 << 16)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    whole, tail = divmod(n, FRAMES_PER_CHUNK)
    runs = [(1, FRAMES_PER_CHUNK, 1)] * bool(whole) + [(whole + 1, tail, 1)] * bool(tail)
    keys = np.arange(1, n + 1, KEY_EVERY)

    def moov(first: int) -> bytes:
        places = first + np.arange(whole + bool(tail)) * FRAMES_PER_CHUNK * FRAME_BYTES
        long = len(places) and places[-1] >= 1 << 32
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", FRAME_BYTES, n)),
            _full(b"co64" if long else b"stco", struct.pack(">I", len(places)), places.astype(">u8" if long else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, FRAMES_PER_SECOND, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), matrix, sides, flags=3)
        movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, FRAMES_PER_SECOND, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", movie, _box(b"trak", track, media))

    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = 8 if len(body) + 8 < 1 << 32 else 16
    first = len(kind) + len(moov(0)) + head
    first = len(kind) + len(moov(first)) + head  # again, as places may have become longer
    data = struct.pack(">I4s", len(body) + 8, b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", len(body) + 16)
    return kind + moov(first) + data + body


RANGES = "array<struct<sample: long, time_ms: double, offset: long, length: long>>"
INDEX_SCHEMA = (
    f"codec string, duration_ms double, n_samples long, payload_bytes long, key_frames {RANGES}, "
    f"tracks array<struct<track: long, handler: string, codec: string, duration_ms: double, n_samples: long, payload_bytes: long, key_frames: {RANGES}>>, error string"
)
COLUMNS = ["codec", "duration_ms", "n_samples", "payload_bytes", "key_frames", "tracks", "error"]


def _key_frames(at: MediaIndex) -> list[dict]:
    return [{"sample": int(k), "time_ms": at.time_ms(k), "offset": int(at.offsets[k]), "length": int(at.sizes[k])} for k in at.keys]


def _indexed(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * len(COLUMNS)
    try:
        found = tracks(data)
    except MediaError as why:
        return *(None,) * (len(COLUMNS) - 1), str(why)
    rows = [
        {"track": at.track, "handler": at.handler, "codec": at.codec, "duration_ms": at.duration_ms, "n_samples": len(at.sizes), "payload_bytes": int(at.sizes.sum()), "key_frames": _key_frames(at)}
        for at in found
    ]
    main = next(row for row, at in zip(rows, found) if at is main_track(found))
    return *(main[c] for c in COLUMNS[:5]), rows, None


def media_index(df: DataFrame, media_col: str, out_col: str = "media_index") -> DataFrame:
    """df with a struct column (INDEX_SCHEMA) for the files in media_col: the main track, and all of them.

    In a track without a table of key frames every sample is one.  A null file has a struct of nulls; bytes that can't be indexed have the reason in ``error`` and
    nulls else.  A column that is already named out_col is replaced.
    """

    @F.pandas_udf(INDEX_SCHEMA)
    def run(files):
        import pandas as pd

        return pd.DataFrame([_indexed(None if x is None else bytes(x)) for x in files], columns=COLUMNS)

    return df.withColumn(out_col, run(F.col(media_col)))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        held, bodies, weight = 0, [], 0
        for k in range(len(batch)):
            body = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            bodies.append((len(body), mux(pad(body))))
            weight += len(body)
            if weight > 8 << 20 or k + 1 == len(batch):  # batches of bounded weight, whatever the texts weigh
                n, files = zip(*bodies)
                yield pa.RecordBatch.from_arrays([ids.slice(held, len(bodies)), pa.array(n, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                held, bodies, weight = k + 1, [], 0


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text (null: empty) padded and stored as a file."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_ms", "n_key_frames"]
    for batch in batches:
        rows = []
        for doc, n, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = file.as_buffer().to_pybytes()
            at = index(data)
            body = payload(data, at)
            ranges = np.stack([at.keys, at.offsets[at.keys], at.sizes[at.keys]], 1).astype("<i8").tobytes()
            feature = f"codec={at.codec.strip()};ms={at.duration_ms:.0f};samples={len(at.sizes)};keys={len(at.keys)};ranges={hashlib.sha256(ranges).hexdigest()[:16]}"
            rows.append((doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-FRAME_BYTES:]), len(data), hashlib.sha256(data).hexdigest(), feature, at.codec, at.duration_ms, len(at.keys)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def features(stored: DataFrame) -> DataFrame:
    """Digests of what store_texts made, read back through the index."""
    return stored.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_ms double, n_key_frames long")
