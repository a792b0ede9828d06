"""op2, op3, op4, op7, op8, op9, op10: round trips, brute force, held-out accuracy, edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import time
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnfell.llm import chat_format, language_id, license_scan, media, mixing, queries, toxicity
from tarnfell.llm import sentencepiece_codec as codec

TABLES = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
needs_model = pytest.mark.skipif(not os.path.exists(codec.MODEL_PATH), reason="no tokenizer file here")
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "same text"), (5, "same text"), (5, "same text"), (None, "x"), (6, "12 !? 34"), (7, "word und é\0▁ " * 20000), (8, "é")]
SCHEMA = "doc_id long, text string, media binary, ids int, score string, labels string, rejected int, row string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, "s", "l", 1, "r", None) for i, t in rows], SCHEMA)


def by_text(rows, *columns):
    out: dict = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).add(tuple(r[c] for c in columns))
    return out


# --- media --------------------------------------------------------------------------------------
def test_media_round_trip_and_digests(spark):
    rows = media.features(media.store_texts(frame(spark, EDGES))).collect()
    assert len(rows) == len(EDGES)
    want = {}
    for i, t in EDGES:
        body = (t or "").encode()
        body += bytes(-len(body) % 64 or (0 if body else 64))
        want.setdefault(i, (len((t or "").encode()), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]]
    assert by_text(rows, "feature", "media_sha256")[4] == by_text(rows, "feature", "media_sha256")[5]
    assert media.features(media.store_texts(frame(spark, []))).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=9000))
def test_media_payload_survives(body):
    data = media.mux(media.pad(body))
    at = media.index(data)
    assert media.payload(data, at) == media.pad(body) and len(media.pad(body)) % 64 == 0 < len(media.pad(body))
    for k in at.keys:
        assert data[at.offsets[k] : at.offsets[k] + 64] == media.pad(body)[64 * k : 64 * k + 64]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_damaged_media_is_told_not_crashed_on(data):
    file = bytearray(media.mux(media.pad(b"x" * 500)))
    for _ in range(data.draw(st.integers(1, 4))):
        file[data.draw(st.integers(0, 612))] = data.draw(st.integers(0, 255))
    try:
        media.index(bytes(file[: data.draw(st.integers(0, len(file)))]))
    except media.MediaError:
        pass


def test_sample_tables_of_other_files(spark):
    box = lambda kind, *parts: struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    sizes = [3, 5, 2, 7, 1]
    stz2 = full(b"stz2", u(4), u(5), bytes([0x35, 0x27, 0x10]))
    head = struct.pack(">I4sQ", 1, b"free", 16)  # a box with a long size

    def file(first):
        table = box(b"stbl", full(b"stsd", u(1), box(b"avc1", bytes(8))), full(b"stts", u(2, 2, 10, 3, 20)), full(b"stss", u(2, 1, 4)), full(b"stsc", u(2, 1, 2, 1, 2, 3, 1)), stz2, full(b"co64", u(2), struct.pack(">QQ", first, first + 100)))
        mdhd = box(b"mdhd", bytes([1, 0, 0, 0]), struct.pack(">QQIQI", 0, 0, 1000, 80, 0))
        return head + box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", table)))) + struct.pack(">I4s", 0, b"mdat") + bytes(200)

    first = len(file(0)) - 200
    at = media.index(file(first))
    assert (at.codec, at.duration_ms, at.sizes.tolist(), at.keys.tolist(), at.times.tolist()) == ("avc1", 80.0, sizes, [0, 3], [0, 10, 20, 40, 60])
    assert (at.offsets - first).tolist() == [0, 3, 100, 102, 109]
    df = spark.createDataFrame([(1, bytearray(file(first))), (2, None), (3, bytearray(b"nothing"))], "doc_id long, media binary")
    got = {r["doc_id"]: r["media_index"] for r in media.media_index(df, "media").collect()}
    assert [(k["offset"] - first, k["length"], k["time_ms"]) for k in got[1]["key_frames"]] == [(0, 3, 0.0), (102, 7, 40.0)]
    assert got[2]["codec"] is got[2]["error"] is None and got[3]["error"]


# --- chat ---------------------------------------------------------------------------------------
NASTY = ["", "\\", "<|im_end|>", "<|im_start|>user<|im_sep|>", "\\<|", "<\\|", "<<SYS>>a<</SYS>>", "[INST] x [/INST]</s><s>", "<\\s>", "[\\INST]", "<<|", "tail <", "| head", "\n\n", "é\U0001f600", "<\\\\|"]


def test_escape_is_reversible(spark):
    texts = NASTY + ["".join(x) for x in product(["<", "|", "\\", "s>"], repeat=4)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect()
    assert all(r["u"] == r["t"] for r in rows) and len({r["e"] for r in rows}) == len({r["t"] for r in rows})
    control = re.compile(r"<\||</?s>|<</?SYS>>|\[/?INST\]")
    assert not any(control.search(r["e"]) for r in rows)


def test_prefix_targets(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a<|im_sep|>b"]), rng.choice(NASTY)) for c in range(12) for t in range(rng.randrange(1, 7))]
    rows += [(50, None, None, None), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (None, 0, "assistant", "lost"), (51, 0, "assistant", "y" * 200000), (52, 0, "user", "only")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    made = chat_format.examples(df)
    want: dict = {}
    for c, t, r, x in rows:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    for r in chat_format.read_back(made).collect():
        turns = sorted(want.pop(r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[1:] for x in turns]
        assert r["loss_text"] == "".join(x for _, role, x in turns if role == "assistant")
    assert not want
    for r in made.collect():  # only the last reply is trainable
        reply = r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]]
        assert not reply or r["formatted"] == r["formatted"][: r["loss_start"]] + reply + chat_format.END
    assert chat_format.read_back(chat_format.examples(df.limit(0))).count() == 0


def test_a_conversation_of_very_many_turns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"<s> turn {k}") for k in range(700)]
    made = chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert made.count() == 350
    back = chat_format.read_back(made).first()
    assert [t["text"] for t in back["turns"]] == [r[3] for r in rows]
    assert back["loss_text"] == "".join(r[3] for r in rows if r[2] == "assistant")


# --- languages ----------------------------------------------------------------------------------
@needs_tables
def test_held_out_languages(spark):
    got = queries.op4_language_id(spark, TABLES).where("held_out").select("doc_id", "lang_pred", "score")
    truth = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    rows = got.join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def _languages():
    rng = random.Random(4)
    say = lambda parts: " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(30))
    return [(say(["th", "ing", "er", "he"]), "aa") for _ in range(60)] + [(say(["sch", "ung", "ß", "ein"]), "bb") for _ in range(60)]


def test_language_edge_cases(spark):
    model = language_id.train(_languages())
    rows = language_id.predict(frame(spark, EDGES), model).collect()
    assert len(rows) == len(EDGES)
    at = by_text(rows, "lang_pred", "score", "rejected")
    assert at[1] == at[2] == at[3] == at[6] == {("und", 0.0, True)} and at[4] == at[5] and next(iter(at[8]))[0] in ("aa", "bb")
    assert language_id.predict(frame(spark, []), model).count() == 0
    kept = language_id.keep_known(frame(spark, EDGES), model)
    assert kept.columns == frame(spark, []).columns and {r["doc_id"] for r in kept.collect()} <= {4, 5, 7, 8, None}
    nothing = language_id.train([])
    assert {r["lang_pred"] for r in language_id.predict(frame(spark, EDGES), nothing).collect()} == {"und"}
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.fit(unlabelled, F.lit(True)).langs == []


def test_language_calibration_and_rejection_are_those_of_brute_force():
    rng = random.Random(9)
    mixed = lambda: " ".join("".join(rng.choices(["th", "ing", "er"] if rng.random() < share else ["sch", "ung", "ein"], k=2)) for _ in range(6))
    rows = []
    for _ in range(600):
        share = rng.choice([0.35, 0.65, 0.9, 0.1])
        rows.append((mixed(), "aa" if rng.random() < share else "bb"))
    model = language_id.train(rows[:400])
    texts = [t for t, _ in rows[400:]] + ["123", "", "thing 1"]
    lang, score, rejected = model.predict(pa.array([*texts, None]))
    for text, a, b, c in zip([*texts, None], lang, score, rejected):
        if not any(map(str.isalpha, text or "")):
            assert (a, b, c) == ("und", 0.0, True)
            continue
        found, weights = language_id._bag(text.encode())
        z = [sum(w * float(model.table[k, f]) for f, w in zip(found, weights)) / model.temperature for k in range(2)]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p]
        assert a == model.langs[p.index(max(p))] and b == pytest.approx(max(p), abs=1e-4) and (abs(b - model.threshold) < 1e-4 or c == (b < model.threshold))
    # scores say how often a prediction is right, which at labels like these is far from always
    right = np.array([x == y for x, (_, y) in zip(lang, rows[400:])])
    assert abs(score[:200].mean() - right.mean()) < 0.1 and right.mean() < 0.9 and model.threshold <= 0.6


def test_language_scores_do_not_depend_on_pieces(monkeypatch):
    model = language_id.train(_languages())
    texts = [t for t, _ in _languages()[::7]] + ["", "ß", "a b", "theißung " * 50]
    bags = [language_id._bag(t.encode()) for t in texts]
    want = np.array([w @ model.table[:, f].T if len(f) else np.zeros(2) for f, w in bags])
    for piece in (7, 64, 1 << 18):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert np.allclose(model.logits(pa.array(texts)), want, atol=1e-5)
    assert np.allclose(model.logits(pa.array(["junk", *texts])[1:]), want, atol=1e-5)


# --- licences -----------------------------------------------------------------------------------
def base(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@needs_tables
def test_licence_phrases_are_those_of_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    for r in queries.op7_license_scan(spark, TABLES).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("gnu general public license apache cc by mit the licensed under x é".split()), max_size=40))
def test_matching_statistics(words):
    scanner = license_scan.Scanner()
    text = " ".join(words)
    assert tuple(scanner.scan(text.encode())[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base(text)
    held = [license_scan.tokens(t.encode()) for ts in license_scan.TEMPLATES.values() for t in ts] + [p.encode().split() for p in license_scan.PHRASES]
    inside = lambda run: any(t[i : i + len(run)] == run for t in held for i in range(len(t) - len(run) + 1))
    raw = [w.encode() for w in words]
    got = {i: n for i, n, _ in scanner.statistics([scanner.ids.get(w) for w in raw])}
    for i in range(len(raw)):
        assert got.get(i, 0) == max((n for n in range(1, i + 2) if inside(raw[i + 1 - n : i + 1])), default=0)


def test_licence_spans_survive_edits(spark):
    scanner = license_scan.Scanner()
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            assert label in scanner.scan(f"code {t} more".encode())["labels"].split(",")
    words = license_scan.TEMPLATES["mit"][1].split()
    words[10:11] = ["really", "truly"]
    found = scanner.scan(("x y " + " ".join(words)).encode())
    assert found["labels"] == "mit" and found["spans"][0]["first_word"] == 2 and 0.9 < found["score"] < 1
    assert scanner.scan(" ".join(words[:8]).encode())["labels"] == "" == scanner.scan(b"the software is of the public")["labels"]
    rows = license_scan.scan(frame(spark, EDGES)).collect()
    assert len(rows) == len(EDGES) and by_text(rows, "labels", "n_words")[4] == {("", 2)} and license_scan.scan(frame(spark, [])).count() == 0


# --- pieces -------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def vocabulary():
    return codec.Vocabulary.load(codec.MODEL_PATH)


def paths(vocabulary, word):
    """All segmentations of a word, best first."""

    def ending(b):
        if not b:
            yield 0.0, []
        for a, s, ids in vocabulary.ending(word, b):
            for t, more in ending(a):
                yield t + s, more + ids

    return sorted(ending(len(word)), key=lambda p: -p[0])


@needs_model
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abthe ing▁\n\0é\U0001f600</s>", max_size=14))
def test_n_best_is_that_of_brute_force(vocabulary, text):
    encoder = codec.Encoder(vocabulary, 4)
    ids, best = next(encoder.encode([text]))
    assert codec.decode_ids(vocabulary, ids.tolist()) == text
    whole = paths(vocabulary, "▁" + text.replace("▁", codec.STAND_IN).replace(" ", "▁"))[:4]
    assert np.allclose([s for s, _ in best], [s for s, _ in whole])
    every = [codec.edited(ids, e) for _, e in best]
    assert len(set(map(tuple, every))) == len(every) and all(codec.decode_ids(vocabulary, e) == text for e in every)


@needs_model
@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["a", "A", "x", "ab", " ", "=", "the", "é", "\0", "no"]), st.integers(1, 12), st.integers(1, 6), st.sampled_from([3, codec.WIDE]))
def test_n_best_of_repeats_is_that_of_brute_force(vocabulary, unit, times, n, wide):
    text = (unit * times)[:14]
    whole = paths(vocabulary, "▁" + text.replace(" ", "▁"))[:n]
    held, codec.WIDE = codec.WIDE, wide  # short words take the long words' way too
    try:
        ids, best = next(codec.Encoder(vocabulary, n).encode([text]))
    finally:
        codec.WIDE = held
    assert [s for s, _ in best] == [s for s, _ in whole]  # scores add up exactly, in any order
    every = [codec.edited(ids, e) for _, e in best]
    assert len(set(map(tuple, every))) == len(every) and all(codec.decode_ids(vocabulary, e) == text for e in every)


@needs_model
def test_long_words_end_in_time(vocabulary):
    rng = random.Random(3)
    words = [c * n for c in "Ax =é\0" for n in (1, 2, 37, 400, 20_000)]
    words += ["ab" * 10_000, "xX" * 10_000, "=-" * 10_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20)), "A" * (1 << 20)]
    began = time.process_time()
    for word in words:
        ids, best = next(codec.Encoder(vocabulary).encode([word]))
        assert codec.decode_ids(vocabulary, ids.tolist()) == word
        every = [codec.edited(ids, e) for _, e in best]
        assert len(set(map(tuple, every))) == len(every) and all(codec.decode_ids(vocabulary, e) == word for e in every)
        assert [s for s, _ in best] == sorted((s for s, _ in best), reverse=True)
    assert time.process_time() - began < 60


@needs_model
@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_every_text_is_written_back(vocabulary, text):
    ids, _ = next(codec.Encoder(vocabulary).encode([text]))
    assert codec.decode_ids(vocabulary, ids.tolist()) == text


@needs_model
def test_encoding_edge_cases(spark, vocabulary):
    made = codec.encode(frame(spark, EDGES))
    assert {r["doc_id"]: r["text"] for r in codec.decode(made).collect()} == {i: t or "" for i, t in EDGES}
    at = by_text(codec.decode(made).collect(), "ids_sha256", "n_pieces")
    assert at[4] == at[5] and at[1] == at[2] and codec.encode(frame(spark, [])).count() == 0
    wide = "".join(random.Random(1).choices("abcdefgh", k=500))  # longer than what numpy works on
    narrow = codec.Encoder(vocabulary, 2)
    assert np.isclose(next(narrow.encode([wide]))[1][0][0], vocabulary.n_best("▁" + wide, 1)[0][0])


@needs_tables
@needs_model
def test_documents_are_written_back(spark):
    got = queries.op8_sentencepiece(spark, TABLES).select("doc_id", "decoded_sha256")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("want"))
    assert got.join(docs, "doc_id").where("decoded_sha256 = want").count() == docs.count()


# --- toxicity -----------------------------------------------------------------------------------
def _toxic(n=900):
    rng = random.Random(6)
    plain = ["".join(rng.choices("aeioudlmnprst", k=rng.randrange(3, 9))) for _ in range(600)]
    rows = []
    for k in range(n):
        words, y = rng.choices(plain, k=rng.randrange(5, 60)), int(k % 6 == 0)
        if y:
            for _ in range(rng.randrange(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "zorq" + rng.choice(["el", "an", "ifo", "uru"]), "grubwok" + rng.choice("aeiou")]))
        rows.append((" ".join(words), y))
    return rows


def test_toxicity_on_unseen_texts():
    rows = _toxic()
    model = toxicity.train(rows[:600], sum(y for _, y in rows[:600]), sum(1 - y for _, y in rows[:600]))
    score = model.score([t for t, _ in rows[600:]] + ["a grubwoky day", "zorqual", "nothing here", "", None])
    truth = np.array([y for _, y in rows[600:]])
    assert ((score[:300] >= 0.5) == truth).mean() > 0.98
    assert (score[300:302] > 0.5).all() and (score[302:] < 0.5).all() and score[303] == score[304]


def test_label_model_shares_the_vote_of_copies():
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.3).astype(float)
    fires = lambda a, b: np.where(y == 1, rng.random(4000) < a, rng.random(4000) < b).astype(float)
    # three voters that err apart from each other make accuracies known; the fourth votes twice
    rates = [(0.8, 0.05), (0.7, 0.02), (0.6, 0.1)]
    good, weak = [fires(*r) for r in rates], fires(0.5, 0.3)
    model = toxicity.fit_label_model(np.stack([*good, weak, weak], 1), np.ones(4000), 0.3, y)
    # as silence abstains, hit rates come out somewhat low, by alike factors; false alarms and ranks hold
    assert all(0.75 * a < model.fires[1, k] < 1.05 * a and abs(model.fires[0, k] - b) < 0.05 for k, (a, b) in enumerate(rates))
    odds = np.log(model.fires[1] / model.fires[0])
    assert odds[1] > odds[0] > odds[2] > odds[3]
    assert model.same[3, 4] > 0.9 and not model.same[:3, :3].any()
    p = model.posterior(np.array([[1, 0, 0, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 1, 1], [0, 0, 0, 0, 0]], float))
    assert p[0] > p[2] > p[3] and abs(p[1] - p[2]) < 0.1


def test_label_model_and_scores_are_those_of_brute_force():
    rows = _toxic(300)
    model = toxicity.train(rows, sum(y for _, y in rows), sum(1 - y for _, y in rows))
    texts = [t for t, _ in rows[:40]] + ["You are an IDIOT, you clown!!!! " * 3, "zorqual zorqel", "", "THE END OF ALL THIS SHOUTING"]
    for text, vote, score in zip(texts, map(model.voters.votes, texts), model.score(texts)):
        words, want = re.findall(r"[^\W\d_]+", text.lower()), np.zeros(len(model.voters))
        for w, k in model.voters.words.items():
            want[k] = words.count(w)
        for w, k in model.voters.stems.items():
            want[k] = sum(x.startswith(w) for x in words)
        want[-3] = len(text) >= 20 and sum(c.isupper() for c in text) > 0.6 * len(text)
        want[-2] = text.count("!") > max(3, 0.02 * len(text))
        want[-1] = re.search(r"\byou(?:'re| are)? (?:a |an |such |so |all |just )*(?:" + "|".join(toxicity.LEXICON) + r")\b", text, re.I) is not None
        assert vote.tolist() == want.tolist()
        x = [*(want > 0), np.log1p((want > 0).sum()), np.log1p(want.sum())]
        assert np.isclose(score, 1 / (1 + np.exp(-sum(a * b for a, b in zip(x, model.weights)) - model.bias)))
    rng = np.random.default_rng(8)
    fired = (rng.random((50, 6)) < 0.3).astype(float)
    lm = toxicity.LabelModel(0.2, np.array([0.7, 0.2]), rng.uniform(0.05, 0.9, (2, 6)), np.array([[0.5 * (a != b and a + b == 5) for a in range(6)] for b in range(6)]))
    for row, p in zip(fired, lm.posterior(fired)):  # voter by voter
        shift = np.log((1 - lm.silent[1]) / (1 - lm.silent[0]))
        gain = np.log(0.2 / 0.8) + (shift if row.any() else np.log(lm.silent[1] / lm.silent[0]))
        for k in np.flatnonzero(row):
            gain += (np.log(lm.fires[1, k] / lm.fires[0, k]) - shift) / (1 + sum(lm.same[j, k] for j in np.flatnonzero(row)))
        assert np.isclose(p, 1 / (1 + np.exp(-gain)))


def test_samples_are_bounded_and_depend_on_content_only(spark, monkeypatch):
    rows = [(k % 3, f"text {k % 50} " + "x" * (k % 50), "aa") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [language_id.sample(df.repartition(n), F.lit(True), rows=1000) for n in (1, 5)]
    assert got[0] == got[1] == sorted({(t, lang) for _, t, lang in rows})
    assert len(language_id.sample(df, F.lit(True), rows=10)) <= 20
    monkeypatch.setattr(language_id, "SAMPLE_BYTES", 500)
    few = [language_id.sample(df.repartition(n), F.lit(True), rows=1000) for n in (1, 5)]
    assert few[0] == few[1] and 0 < sum(len(t) for t, _ in few[0]) <= 500 and set(few[0]) < set(got[0])


def test_toxicity_edge_cases(spark):
    for rows in ([], _toxic(60), [("fine text", 0)] * 5, [("bad idiot", 1)] * 5):
        model = toxicity.train(rows, sum(y for _, y in rows), sum(1 - y for _, y in rows))
        out = toxicity.score(frame(spark, EDGES), model).collect()
        at = by_text(out, "score", "predicted")
        assert len(out) == len(EDGES) and at[4] == at[5] and at[1] == at[2] and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert toxicity.score(frame(spark, []), model).count() == 0
    labels = spark.createDataFrame([(4, 0), (4, 1), (6, None), (7, 5), (None, 1)], "doc_id long, toxic int")
    assert toxicity.fit(frame(spark, EDGES), labels, lambda i: i > 0).score(["x"]).shape == (1,)


@needs_tables
def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = queries.op9_toxicity(spark, TABLES).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.9


# --- mixing -------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_pattern_never_deviates_by_a_block(weights):
    total, taken = sum(weights), [0] * len(weights)
    for slot, i in enumerate(mixing.pattern(weights), 1):
        taken[i] += 1
        assert all(abs(n * total - slot * w) < total for n, w in zip(taken, weights))
        j = taken[i]
        assert (j - 1) * total // weights[i] < slot <= -(-j * total // weights[i])  # between release and deadline
    assert taken == weights


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, None: 1, "c": 1}])
def test_mix_is_the_simulated_schedule(spark, weights):
    sizes = {"a": 300, "b": 57, None: 20, "c": 1}
    rows = [(k, s, 0) for s, n in sizes.items() for k in range(len(str(s)) * 1000, len(str(s)) * 1000 + n)]
    rows = [(k * 10 + len(s or "") + (s == "b"), s, x) for k, (_, s, x) in enumerate(rows)]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, source string, slot int")
    got = mixing.mix(df, weights, block_rows=4, denominator=10, bucket_rows=50).collect()
    assert len(got) == len(rows) + 1
    slots: dict[int, set] = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"], r["phase"], r["weight"], r["release"], r["deadline"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    # slot by slot, the block with the earliest deadline of those released, per phase from where it starts
    blocks = {s: -(-(n + (s == "a")) // 4) for s, n in sizes.items()}
    done = dict.fromkeys(sizes, 0)
    order = [next(iter(slots[k])) for k in range(len(slots))]
    start, before, phase = 0, dict(done), 0
    share = {s: next(r["weight"] for r in got if r["source"] == s) for s in sizes}
    for slot, (s, block, p, weight, release, deadline) in enumerate(order):
        if p != phase:
            start, before, phase = slot, dict(done), p
        assert weight == share[s] and block == done[s] and release <= slot < deadline
        done[s] += 1
        total = sum(share[x] for x in sizes if before[x] < blocks[x])
        for x in sizes:
            if before[x] < blocks[x]:
                assert abs((done[x] - before[x]) * total - (slot + 1 - start) * share[x]) < total
    assert done == blocks


def test_mix_edge_cases(spark):
    df = frame(spark, EDGES)
    assert sorted(((r["doc_id"], r["text"]) for r in mixing.in_order(df).collect()), key=repr) == sorted(EDGES, key=repr)
    assert mixing.in_order(df).columns == df.columns and mixing.in_order(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1.0})
    assert mixing.mix(df, {None: 2.0}).count() == len(EDGES)
