"""Credentials among other symbols, against all candidates scored one by one."""

import random

import pytest

from pointloom.llm import secrets

HELD = [(k, t) for k, t in secrets.labelled_examples(6, seed=99) if secrets.classify(t)]


@pytest.mark.parametrize("glue", ["GH_PAT={}", "https://host.example/v1/{}", "https://host.example/q?k={}", "a.b.{}", "https://host.example/{}/files/list", "x=1/{}=y", "MY_KEY-{}"])
def test_glued_credentials_are_masked(glue):
    for kind, text in HELD:
        out = secrets.redact(glue.format(text))
        assert text not in out and text[-12:] not in out, (kind, glue, out)


def test_boundaries():
    token = next(t for k, t in HELD if k == "github")
    assert secrets.spans_of(f"x={token}")[1] == [(2, 2 + len(token), "github")]
    text = f"https://host.example/q?k={token}&z=1"
    assert secrets.spans_of(text)[1] == [(text.index(token), text.index(token) + len(token), "github")]
    inside = f"password={token}"
    assert (9, 9 + len(token), "github") in secrets.spans_of(inside)[1] and (0, len(inside), "assign") in secrets.spans_of(inside)[1]


def test_two_in_one_run_and_plain_paths():
    a, b = [t for k, t in HELD if k == "github"][:2]
    out = secrets.redact(f"x/{a}/y/{b}/z")
    assert a not in out and b not in out
    for plain in ("https://example.com/docs/guide/getting-started/index.html", "v1.2.3/release-notes/2024-01-02=final"):
        assert secrets.redact(plain) == plain


def test_spans_against_all_candidates():
    """Every candidate of every run scored under every automaton, taken by margin."""
    rng = random.Random(4)
    tokens = [t for _, t in HELD] + ["plain", "v1.2", "0123456789" * 4, "abcdef" * 5, "some-long-identifier_name", "=", "/", "Q" * 30]
    for _ in range(40):
        text = "".join(rng.choice(tokens) + rng.choice([" ", "=", "/", ".", "-", ""]) for _ in range(6))
        want = []
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end].isascii() and (text[end].isalnum() or text[end] in "_.=+/-"):
                end += 1
            run = text[at:end]
            cut = lambda i: 0 <= i < len(run) and run[i] in "=/.+-"
            starts = {0} | {i for i in range(len(run) + 1) if (cut(i - 1) and not cut(i)) or any(run.startswith(p, i) for _, ps, *_ in secrets.FORMATS for p in ps if p)}
            ends = {len(run)} | {i for i in range(len(run)) if cut(i) != cut(i - 1)}
            found = []
            for name, (auto, least, shortest, fixed) in secrets.models().items():
                for a in starts:
                    state, margin = 0, 0.0
                    for b in range(a + 1, len(run) + 1):
                        stop, edges, unseen = auto.step[state]
                        state, gain = edges.get(run[b - 1], (state, unseen))
                        margin += gain - least
                        if margin < -secrets.DROP:
                            break
                        whole = margin + auto.step[state][0]
                        if whole >= 0 and (b - a == shortest if fixed else b - a >= shortest and b in ends):
                            found.append((-whole, a - b, a, b, name))
            for _, _, a, b, name in sorted(found):
                if all(b <= x or y <= a for x, y, _ in [(s[0] - at, s[1] - at, s[2]) for s in want if s[0] >= at]):
                    want.append((at + a, at + b, name))
            at = max(end, at + 1)
        base, spans = secrets.spans_of(text)
        assert sorted(s for s in spans if s[2] not in secrets.KINDS) == sorted(want)


def web_token(rng, sizes):
    symbols = secrets.ALNUM + "_-"
    return "eyJ" + ".".join("".join(rng.choices(symbols, k=n)) for n in sizes)


@pytest.mark.parametrize("length", [131, 184, 284, 683, 2500, 30_000])
def test_long_web_tokens_whole(length):
    """Longer than every labelled example too: no length bound."""
    rng = random.Random(length)
    for _ in range(5):
        head = min(40, length // 4)
        token = web_token(rng, (head, length - head - 48, 43))
        assert len(token) == length
        text = f"curl -H Bearer {token} https://host.example/"
        at = text.index(token)
        assert [s for s in secrets.spans_of(text)[1] if s[2] == "jwt"] == [(at, at + length, "jwt")]
        assert secrets.redact(text) == "curl -H Bearer [SECRET] https://host.example/"


@pytest.mark.parametrize("tail", ["abc", "_old", "Z9"])
def test_fixed_length_leaves_what_is_glued_behind(tail):
    for kind, token in HELD:
        if kind in ("github", "npm"):
            assert secrets.spans_of(f"see {token}{tail} there")[1] == [(4, 4 + len(token), kind)]


def test_plain_strings_are_no_credentials():
    rng = random.Random(1)
    for k in range(2000):
        letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(20, 60)))
        words = rng.choice(["_", "-", ".", "/"]).join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(8))
        for plain in (letters, words, letters.capitalize(), letters.upper()):
            base, spans = secrets.spans_of(plain)
            assert all(any(a <= b and e <= f for b, f, _ in base) for a, e, _ in spans), plain  # AKIA may stand in random capitals


def test_very_long_runs():
    """A run of a million symbols, and one with many separators, with one credential inside."""
    token = next(t for k, t in HELD if k == "github")
    for filler in ("A" * 500_000, "ab/cd+ef=" * 20_000):
        text = f"{filler}/{token}/{filler}"
        spans = secrets.spans_of(text)[1]
        assert any(a <= len(filler) + 1 and len(filler) + 1 + len(token) <= b for a, b, _ in spans)
