from __future__ import annotations

import pytest

from tarnfell.llm import license_scan, toxicity


@pytest.mark.parametrize("head", ["Re: Anna, ", '"... 123 !? ' * 4, "", "é ü "])
def test_shouting_is_heard_after_any_beginning(head):
    assert toxicity._patterns(head + "SHOUTING ALL THE WAY ÄÖ " * 20)[0]
    assert not toxicity._patterns(head + "SHOUTING TWO WORDS AT MOST IN THE BEGINNING HERE " + "then quiet for long " * 20)[0]
    assert not toxicity._patterns("TOO SHORT")[0]


@pytest.mark.parametrize("between", ["", "some other words between the notices "])
def test_every_edited_copy_of_a_notice_is_a_span(between):
    words = license_scan.TEMPLATES["mit"][1].split()
    copies = []
    for at in (10, 14, 20):
        edited = list(words)
        edited[at : at + 1] = ["really", "truly"]
        copies.append(" ".join(edited))
    text = between.join(c + " " for c in copies)
    spans = [s for s in license_scan.Scanner().scan(text.encode())["spans"] if s["template"] == license_scan.Scanner().scan(copies[0].encode())["spans"][0]["template"]]
    assert len(spans) == 3 and all(s["cover"] < 1 for s in spans)
    assert all(a["last_word"] < b["first_word"] for a, b in zip(spans, spans[1:]))
