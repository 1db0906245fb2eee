"""The keyword filter loses no match: every way through a rule's expression passes it, and detections are those of all rules."""

import random
import re
from re import _parser

import pytest

from pointloom.llm import licenses


def texts(tree, rng) -> list[str]:
    """Texts for the ways through an expression: every alternative once, of classes and repeats some."""
    out = [""]
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                ways = [chr(arg)]
            case "IN":
                ways = [chr(a) for o, a in arg if str(o) == "LITERAL"] or [" " if str(arg[0][1]) == "CATEGORY_SPACE" else "x"]
            case "BRANCH":
                ways = [t for b in arg[1] for t in texts(b, rng)]
            case "SUBPATTERN":
                ways = texts(arg[-1], rng)
            case "MAX_REPEAT" | "MIN_REPEAT":
                ways = [t * max(1, arg[0]) for t in texts(arg[2], rng)] + ([""] if arg[0] == 0 else [])
            case "ANY":
                ways = ["y"]
            case _:
                ways = [""]
        out = [a + b for a in out for b in ways]
        if len(out) > 24:
            out = rng.sample(out, 24)
    return out


def test_every_rule_passes_the_filter():
    rng = random.Random(1)
    tried = 0
    for rule in licenses.rules():
        for t in texts(_parser.parse(rule[2].pattern), rng):
            low = f" {t} "
            if rule[2].search(low):
                tried += 1
                present = {w for _, w in licenses._automaton().iter(low)}
                assert any(g in low for g in licenses.gates()) and all(need & present for need in rule[3]), (rule, low)
    assert tried > 2 * len(licenses.rules())


def test_detections_equal_those_of_all_rules():
    rng = random.Random(2)
    pool = [t for rule in licenses.rules() for t in texts(_parser.parse(rule[2].pattern), rng)[:3]] + ["license", "under the", "and\nso", "free", "public domain", "x"]
    for _ in range(150):
        low = " ".join(rng.choices(pool, k=rng.randint(0, 6)))
        found = licenses.detect(low)
        assert found == licenses.detect(low, filtered=False)
        matches = sorted((r[0], -(m.end() - m.start()), m.start(), m.end(), r[1], r[4]) for r in licenses.rules() for m in r[2].finditer(low))
        kept = []
        for _, _, a, b, label, c in matches:  # suppression, pair by pair
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, label, c))
        assert found == sorted(kept)


@pytest.mark.parametrize("text,label", [("spdx-license-identifier: python-2.0", "python-2.0"), ("released under the expat license", "mit"), ("apache license 2.0", "apache-2.0"), ("permission is hereby granted, free of\n charge", "mit"), ("neither the name of acme nor the names of its\ncontributors may be used to endorse", "bsd-3-clause")])
def test_labels(text, label):
    assert label in {d[2] for d in licenses.detect(text)}


def test_priority_and_labels_of_all_rules():
    assert len(licenses.rules()) > 350 and [r[0] for r in licenses.rules()] == sorted(r[0] for r in licenses.rules())
    assert all(re.fullmatch(r"[a-z0-9.-]+", r[1]) and 0 < r[4] <= 1 for r in licenses.rules())
