"""Licence scans against brute force: chains, labels, and the base columns in SQL."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfell.llm import license_scan, queries

TABLES = "/root/testdata/sf0.01"
SMALL = {"x": ["a b c d e f g h i j"], "y": ["c d e q r s t u", "a b c d e f g h i j k l m n o p"]}


def matches(words, template):
    """Maximal runs of words that stand in some template, as places of one template: (text start, template start, length)."""
    every = [t.split() for ts in SMALL.values() for t in ts]
    inside = lambda run: any(t[i : i + len(run)] == run for t in every for i in range(len(t) - len(run) + 1))
    out = []
    for end in range(1, len(words) + 1):
        n = max((n for n in range(end + 1) if inside(words[end - n : end])), default=0)
        # the longest run that ends here goes no further: the next word breaks it off or shortens it
        if n >= license_scan.MIN_MATCH and not (end < len(words) and inside(words[end - n : end + 1])):
            out += [(end - n, x, n) for x in range(len(template) - n + 1) if template[x : x + n] == words[end - n : end]]
    return out


def covers(parts):
    """Covered words, first and last word of every chain there is."""
    def grow(chain):
        (a, x, n), covered = chain[-1][0], chain[-1][1]
        yield covered, chain[0][0][0], a + n - 1
        for b, y, m in parts:
            lap = max(0, a + n - b, x + n - y)
            if b > a and y > x and lap < m and b - (a + n) <= license_scan.MAX_GAP and y - (x + n) <= license_scan.MAX_GAP:
                yield from grow([*chain, ((b, y, m), covered + m - lap)])

    for p in parts:
        yield from grow([(p, p[2])])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a b c d", "e f g h i j", "c d e", "q r s t u", "g h i j k l m", "n o p", "a b c d e f g h i j", "z", "zz zz", "d", "e"]), max_size=7))
def test_best_chains_are_those_of_brute_force(pieces):
    text = " ".join(pieces)
    words = text.split()
    scanner = license_scan.Scanner({}, SMALL, {})
    found = scanner.scan(text.encode())
    spans = found["spans"]
    assert found["labels"] == ",".join(sorted({s["label"] for s in spans})) and found["score"] == max((s["cover"] for s in spans), default=0.0)
    at = 0
    for label, texts in SMALL.items():
        for t in texts:
            template, own = t.split(), [s for s in spans if s["template"] == at]
            enough = max(license_scan.MIN_WORDS, license_scan.MIN_COVER * len(template))
            every = [c for c in covers(matches(words, template)) if c[0] >= enough]
            best = max((c[0] for c in every), default=0)
            assert (max((s["cover"] for s in own), default=0) * len(template)) == pytest.approx(min(best, len(template)))
            assert all(s["label"] == label and a["last_word"] < b["first_word"] for s in own for a, b in zip(own, own[1:]))
            for s in own:  # each is a chain that there is
                assert any((min(1.0, c / len(template)), a, b) == (pytest.approx(s["cover"]), s["first_word"], s["last_word"]) for c, a, b in every)
            for _, a, b in every:  # and no chain is left that shares no word with those taken
                assert any(s["first_word"] <= b and a <= s["last_word"] for s in own)
            at += 1


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_notices_and_tags_have_their_own_label_only(label):
    scanner, rng = license_scan.Scanner(), random.Random(1)
    # the base phrases "gnu general public license" and "cc by", and the notices made of them, stand in their relatives'
    related = next((f for f in ({"gpl", "lgpl", "agpl"}, {"cc-by", "cc-by-nc", "cc-by-sa"}) if label in f), {label})
    for text in license_scan.TEMPLATES[label] + license_scan.TAGS.get(label, []):
        found = set(scanner.scan(f"# {text}\n{' '.join(rng.choices('lorem ipsum of the software', k=30))}".encode())["labels"].split(","))
        assert label in found and (found == {label} or label in related and found <= related), (text, found)


def test_tags_count_word_for_word():
    scan = lambda t: license_scan.Scanner().scan(t.encode())["labels"]
    assert scan("// SPDX-License-Identifier: MIT\n") == "mit" and scan("SPDX-License-Identifier: AGPL-3.0-only") == "agpl"
    assert scan("SPDX-License-Identifier: XGPL-3.0-only") == "" == scan("SPDX-License-Identifier: see below") == scan("an SPDX license identifier")
    assert scan("SPDX-License-Identifier: (MIT OR Apache-2.0)") == "mit"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
def test_base_columns_are_those_of_sql(spark):
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
    want = con.sql(
        r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        p(label, phrase) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
        h AS (SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1 : i + len(phrase)] = phrase)) AS i FROM w CROSS JOIN p)
        SELECT w.doc_id, len(ws), count(i), min(i), max(i), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '')
        FROM w LEFT JOIN h USING (doc_id) GROUP BY w.doc_id, ws
        """
    ).fetchall()
    got = [tuple(r[c] for c in columns) for r in queries.op7_license_scan(spark, TABLES).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[2] for r in got)
