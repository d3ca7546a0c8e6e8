import time

import pytest

from ledgerloom.llm.sentences import units

LONG = "the old cook of the north house went over the yard with the lamp and the rope " * 5
CASES = {
    "emphasis": [f"*He saw that {LONG}.*", "Next one."],
    "speech": [f"“Stop there!” Marlow of {LONG} said.", "Next one."],
    "open pairs": ["(" + " [" * 70 + "one here. Two here) is all.", "Next one."],
    "path": ["Hello" + "! " * 14, "Next one."],
}


@pytest.mark.parametrize("name", CASES)
def test_evidence_from_far_away_counts(name):
    parts = [x.strip() for x in CASES[name]]
    text = " ".join(parts)
    assert [text[a:b] for a, b in units(text)] == parts


def test_long_paragraphs_take_linear_time():
    began = time.process_time()
    for s in ("! " * 100_000, "“" * 100_000 + "a. B", "x “…” " * 50_000, "*a.* B " * 50_000, "(“" * 50_000 + ")" * 50_000):
        units(s)
    assert time.process_time() - began < 60
