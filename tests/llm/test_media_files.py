"""Hand-built media files of several tracks, whole and in fragments: what they hold is known as they are written."""

from __future__ import annotations

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfell.llm import media


def box(kind, *parts, long=False):
    size = sum(map(len, parts))
    return (struct.pack(">I4sQ", 1, kind, 16 + size) if long else struct.pack(">I4s", 8 + size, kind)) + b"".join(parts)


def full(kind, *parts, version=0, flags=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def u(*x):
    return struct.pack(f">{len(x)}I", *x)


def track(number, handler, codec, samples, rng, edits=()):
    """samples: (size, duration, shift, key); returns a function from chunk places to the trak box, and the chunks."""
    chunks, at = [], 0
    while at < len(samples):
        n = rng.randrange(1, 4)
        chunks.append(samples[at : at + n])
        at += n
    runs, before = [], None
    for k, chunk in enumerate(chunks, 1):
        if len(chunk) != before:
            runs.append((k, len(chunk), 1))
            before = len(chunk)
    v1 = rng.random() < 0.5

    def trak(places):
        keys = [k + 1 for k, s in enumerate(samples) if s[3]]
        wide = rng.random() < 0.5
        table = [
            full(b"stsd", u(1), box(codec, bytes(8))),
            full(b"stts", u(len(samples)), *(u(1, s[1]) for s in samples)),
            full(b"ctts", u(len(samples)), *(struct.pack(">Ii", 1, s[2]) for s in samples), version=1),
            full(b"stsc", u(len(runs)), *(u(*r) for r in runs)),
            full(b"stsz", u(0, len(samples)), *(u(s[0]) for s in samples)),
            full(b"co64", u(len(places)), struct.pack(f">{len(places)}Q", *places)) if wide else full(b"stco", u(len(places)), u(*places)),
        ]
        if len(keys) < len(samples):
            table.append(full(b"stss", u(len(keys)), u(*keys)))
        rng.shuffle(table)
        total = sum(s[1] for s in samples)
        mdhd = full(b"mdhd", struct.pack(">QQIQ", 0, 0, 600, total), bytes(4), version=1) if v1 else full(b"mdhd", u(0, 0, 600, total), bytes(4))
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, number, 0, 0), version=1) if v1 else full(b"tkhd", u(0, 0, number, 0, 0))
        listed = [box(b"edts", full(b"elst", u(len(edits)), *(struct.pack(">Iii", length, first, 1 << 16) for length, first in edits)))] if edits else []
        other = full(b"hdlr", bytes(4), b"alis", bytes(13))  # a data handler is none of the track's
        return box(b"trak", tkhd, *listed, box(b"mdia", mdhd, full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", other, box(b"stbl", *table))))

    return trak, chunks


def some(rng, n):
    return [(rng.randrange(1, 40), rng.randrange(1, 50), rng.randrange(-5, 30), rng.random() < 0.4) for _ in range(n)]


def movie(seed):
    """A file of tracks with chunks in turn, then fragments in every style; and per track (offset, size, time, key)."""
    rng = random.Random(seed)
    n_tracks = rng.randrange(1, 4)
    handlers = [rng.choice([(b"soun", b"mp4a"), (b"vide", b"avc1"), (b"text", b"tx3g")]) for _ in range(n_tracks)]
    empty = rng.random() < 0.4  # as fragmented files are written: no samples in the movie itself
    plans = [some(rng, 0 if empty else rng.randrange(1, 12)) for _ in range(n_tracks)]
    edits = [rng.choice([(), [(100, 7)], [(50, -1), (100, 3)]]) for _ in range(n_tracks)]
    made = [track(7 + k, *handlers[k], plans[k], rng, edits[k]) for k in range(n_tracks)]
    defaults = {7 + k: (rng.randrange(1, 9), rng.randrange(1, 9), rng.choice([0, 0x10000])) for k in range(n_tracks)}
    turn = sorted((j, k) for k in range(n_tracks) for j in range(len(made[k][1])))
    head = box(b"ftyp", b"isom", bytes(4))

    def moov(start):
        places, at = [[] for _ in range(n_tracks)], start
        for j, k in turn:
            places[k].append(at)
            at += sum(s[0] for s in made[k][1][j])
        state = rng.getstate()
        out = box(b"moov", full(b"mvhd", u(0, 0, 300, 0)), *(made[k][0](places[k]) for k in range(n_tracks)), box(b"mvex", *(full(b"trex", u(t, 1, *d)) for t, d in defaults.items())))
        rng.setstate(state)
        return out, places, at

    start = len(head) + len(moov(0)[0]) + 8
    movie_box, places, end = moov(start)
    truth = [[] for _ in range(n_tracks)]
    clock = [0] * n_tracks
    for k in range(n_tracks):
        for chunk, at in zip(made[k][1], places[k]):
            for size, duration, shift, key in chunk:
                truth[k].append([at, size, clock[k] + shift, key])
                at += size
                clock[k] += duration
    file = head + movie_box + box(b"mdat", bytes(end - start))
    for number in range(rng.randrange(0, 4) if not empty else rng.randrange(1, 4)):
        file += fragment(rng, len(file), number, n_tracks, defaults, truth, clock)
    for k, t in enumerate(truth):
        late = 0
        for length, first in edits[k]:
            late, first = (length * 600 // 300, None) if first < 0 else (late, first)
            for row in t if first is not None else ():
                row[2] += late - first
    return file, handlers, truth


def fragment(rng, begin, number, n_tracks, defaults, truth, clock):
    style = rng.choice(["moof", "base", "old"])
    plan = []
    for k in rng.sample(range(n_tracks), rng.randrange(1, n_tracks + 1)):
        own = {name: rng.randrange(1, 9) for name in ("duration", "size") if rng.random() < 0.5}
        if rng.random() < 0.5:
            own["flags"] = rng.choice([0, 0x10000])
        runs = [(some(rng, rng.randrange(1, 6)), {name for name in ("duration", "size", "flags", "shift") if rng.random() < 0.5}, rng.random() < 0.3) for _ in range(rng.randrange(1, 3))]
        plan.append((k, own, runs, rng.random() < 0.5, rng.randrange(2)))

    def build(data):
        """The moof box for a payload that starts at data, and the samples as (track, offset, size, time, key)."""
        rows, trafs, at, now = [], [], data, list(clock)
        for k, own, runs, timed, version in plan:
            duration, size, flags = defaults[7 + k]
            values = {"duration": duration, "size": size, "flags": flags} | own
            bits = {"moof": 0x20000, "base": 1, "old": 0}[style] | 8 * ("duration" in own) | 16 * ("size" in own) | 32 * ("flags" in own)
            tfhd = full(b"tfhd", u(7 + k), struct.pack(">Q", data) if style == "base" else b"", *(u(own[c]) for c in ("duration", "size", "flags") if c in own), flags=bits)
            base, parts = {"moof": begin, "base": data, "old": begin if not trafs else at}[style], []
            if timed:
                now[k] += 13
                parts.append(full(b"tfdt", struct.pack(">Q" if version else ">I", now[k]), version=version))
            for j, (samples, told, first) in enumerate(runs):
                first = first and "flags" not in told
                place = j == 0 or rng.random() < 0.5
                bits = place | 4 * first | 0x100 * ("duration" in told) | 0x200 * ("size" in told) | 0x400 * ("flags" in told) | 0x800 * ("shift" in told)
                table = b""
                for i, (s, d, shift, key) in enumerate(samples):
                    flag = 0 if key else 0x10000
                    table += u(d) * ("duration" in told) + u(s) * ("size" in told) + u(flag) * ("flags" in told) + struct.pack(">i", shift) * ("shift" in told)
                    s, d = s if "size" in told else values["size"], d if "duration" in told else values["duration"]
                    used = flag if "flags" in told else 0 if first and i == 0 else values["flags"]
                    rows.append((k, [at, s, now[k] + (shift if "shift" in told else 0), not used & 0x10000]))
                    now[k] += d
                    if i == 0:
                        offset = at - base
                    at += s
                parts.append(full(b"trun", u(len(samples)), struct.pack(">i", offset) if place else b"", u(0) if first else b"", table, version=1, flags=bits))
            trafs.append(box(b"traf", tfhd, *parts))
        return box(b"moof", full(b"mfhd", u(number)), *trafs, long=wide), rows, at, now

    wide, state = rng.random() < 0.3, rng.getstate()
    size = len(build(0)[0])
    rng.setstate(state)
    moof, rows, end, now = build(begin + size + 8)
    clock[:] = now
    for k, row in rows:
        truth[k].append(row)
    return moof + box(b"mdat", bytes(end - begin - size - 8))


@pytest.mark.parametrize("seed", range(150))
def test_tracks_are_what_was_written(seed):
    file, handlers, truth = movie(seed)
    found = media.tracks(file)
    assert [(t.handler.encode(), t.codec.encode(), t.track) for t in found] == [(*h, 7 + k) for k, h in enumerate(handlers)]
    for t, rows in zip(found, truth):
        keys = set(t.keys.tolist())
        assert [[a, b, c, k in keys] for k, (a, b, c) in enumerate(zip(t.offsets.tolist(), t.sizes.tolist(), t.times.tolist()))] == rows
    main = media.index(file)
    videos = [t for t in found if t.handler == "vide" and len(t.sizes)]
    assert main.track == (videos or [t for t in found if len(t.sizes)] or found)[0].track


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.data())
def test_damaged_files_are_told_not_crashed_on(seed, data):
    file = bytearray(movie(seed)[0])
    for _ in range(data.draw(st.integers(1, 4))):
        file[data.draw(st.integers(0, len(file) - 1))] = data.draw(st.integers(0, 255))
    try:
        media.tracks(bytes(file[: data.draw(st.integers(0, len(file)))]))
    except media.MediaError:
        pass


def test_index_has_all_tracks_and_tells_what_it_cannot(spark):
    seed = next(k for k in range(150) if len(movie(k)[1]) == 3 and any(h[0] == b"vide" for h in movie(k)[1][1:]) and movie(k)[1][0][0] != b"vide")
    file, handlers, truth = movie(seed)
    orphan = file + box(b"moof", full(b"mfhd", u(9)), box(b"traf", full(b"tfhd", u(99)), full(b"trun", u(0))))
    df = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(orphan)), (3, None)], "doc_id long, media binary")
    got = {r["doc_id"]: r["media_index"] for r in media.media_index(df, "media").collect()}
    assert [(t["track"], t["n_samples"], t["payload_bytes"]) for t in got[1]["tracks"]] == [(7 + k, len(t), sum(x[1] for x in t)) for k, t in enumerate(truth)]
    for t, rows in zip(got[1]["tracks"], truth):
        assert [(f["sample"], f["offset"], f["length"], round(f["time_ms"], 6)) for f in t["key_frames"]] == [(k, a, b, round(c / 0.6, 6)) for k, (a, b, c, key) in enumerate(rows) if key]
    assert got[1]["codec"] == "avc1" and "99" in got[2]["error"] and got[2]["tracks"] is None and got[3]["error"] is None
