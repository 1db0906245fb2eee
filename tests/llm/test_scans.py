"""License scan, language ID, quality network, secret scan: small rows, brute force, held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pytest

from pointloom.llm import langid, licenses, quality, secrets

COLS = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, spans string"


def rows_of(spark, texts, langs=None):
    langs = langs or [None] * len(texts)
    return spark.createDataFrame([(None if i == 1 else i, t, l, None, None, 1.0, 2, "x") for i, (t, l) in enumerate(zip(texts, langs))], COLS)


EDGE = ["", None, "   \n\t", "MIT License", "word " * 40_000, "x", "x", "password='abcdefghijkl' deadbeefdeadbeef00"]


def test_licenses_base_against_regex(spark):
    rng = random.Random(3)
    bits = ["MIT", "License", "mit license", "Apache-License", "GENERAL public", "license", "é", "9", "x-y", "\n", "apache license"]
    texts = EDGE + [" ".join(rng.choices(bits, k=30)) for _ in range(40)]
    got = licenses.scan_licenses(rows_of(spark, texts)).collect()
    assert len(got) == len(texts)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for text, row in zip(texts, got):
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert row.first_word == min((p for p, _ in places), default=None)
        assert row.last_word == max((p for p, _ in places), default=None)
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1
    assert licenses.scan_licenses(rows_of(spark, texts).limit(0)).count() == 0


def test_license_rules_and_suppression():
    assert len(licenses.rules()) > 200
    found = licenses.detect("licensed under the apache license, version 2.0. also spdx-license-identifier: mit")
    assert [d[2] for d in found] == ["apache-2.0", "mit"]
    assert {d[2] for d in licenses.detect("released under the gnu general public license, version 3.")} == {"gpl-3.0"}
    text = "this is under the new bsd license and the isc license file"
    kept = licenses.detect(text)
    assert not any(a is not b and b[0] <= a[0] and a[1] <= b[1] for a in kept for b in kept)


def test_secrets_base_against_regex(spark):
    rng = random.Random(5)
    bits = ["token = \"", "abcdef012345", "AKIA", "ABCDEFGH12345678", "deadbeefdeadbeef", " ", "'", "API_KEY:", "Secret=", "é", "paſſword=", "g"]
    texts = EDGE + ["".join(rng.choices(bits, k=14)) for _ in range(60)]
    got = secrets.scan_secrets(rows_of(spark, texts)).collect()
    for text, row in zip(texts, got):
        text = text or ""
        found = []
        for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = ",".join(f[2] for f in sorted(found))
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(f[1] == k for f in found) for k in range(3))


def test_automata_find_held_out_formats_and_leave_words():
    held = secrets.labelled_examples(40, seed=99)
    by_kind = {}
    for kind, text in held:
        by_kind.setdefault(kind, []).append(secrets.classify(text) is not None)
    assert all(np.mean(v) >= 0.75 for v in by_kind.values()), by_kind
    assert sum(map(sum, by_kind.values())) / len(held) > 0.9
    for plain in ("internationalization2", "1234567890123456", "chapter-12-section-34", "the_quick_brown_fox_99"):
        assert secrets.classify(plain) is None


def test_redact(spark):
    text = 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b'
    assert secrets.redact(text) == "a [SECRET]\" b"
    out = secrets.redact_secrets(rows_of(spark, [text, None, "clean"])).collect()
    assert [r.text for r in out] == [secrets.redact(text), None, "clean"]
    assert out[0].n_chars == len(out[0].text)


def language_rows():
    rng = random.Random(1)
    words = {"aa": ["the", "ing", "and", "thes"], "bb": ["der", "ung", "und", "ein"]}
    texts, langs = [], []
    for i in range(200):
        lang = "aa" if i % 2 else "bb"
        texts.append(" ".join("".join(rng.choices(words[lang], k=2)) for _ in range(20)))
        langs.append(None if i % 50 == 7 else lang)
    return texts, langs


def test_language_held_out_and_edges(spark):
    texts, langs = language_rows()
    docs = rows_of(spark, texts + EDGE, langs + [None] * len(EDGE))
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    for r, lang in zip(got, langs):
        assert r.lang_pred in ("aa", "bb") and 0 <= r.score <= 1
        assert lang in (None, r.lang_pred)
    assert [r.lang_pred for r in got[len(texts) : len(texts) + 3]] == ["und"] * 3
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_quality_gradient_and_accuracy(spark):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(32, 120, size=int(rng.integers(100, 1500))).astype(np.uint8)) for _ in range(4)]
    y = np.array([1, 0, 1, 0], np.float32)
    p = {k: v.astype(np.float32) for k, v in quality.init(2).items()}
    g = quality.gradients(p, texts, y)

    def loss(q):
        o = quality.forward(q, texts)
        return -float(np.mean(y * np.log(o) + (1 - y) * np.log(1 - o)))

    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({n: a.copy() for n, a in p.items()} for _ in range(2))
        up[k][i] += 3e-3
        down[k][i] -= 3e-3
        assert (loss(up) - loss(down)) / 6e-3 == pytest.approx(float(g[k][i]), rel=0.02)
    long = b"some words here " * 5000
    assert quality.score_long(p, long, piece=40 * quality.HALF) == pytest.approx(float(quality.forward(p, [long])[0]), abs=1e-3)
    good = ["plain words about %d things and more" % i * 6 for i in range(60)]
    bad = ["junk### words&&& %d%%%%%% xx*** " % i * 6 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad + ["", None])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(5000, 1), (None, 0), (3, None)], "doc_id long, quality int")
    rows = quality.score_quality(docs, quality.fit(docs, labels, epochs=8)).collect()
    held = [r for r in rows if r.held_out and r.doc_id < 120]
    assert len(held) > 10 and np.mean([r.predicted == (r.doc_id < 60) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == 122
    assert quality.fit(docs, labels.limit(0)) == 0.5
