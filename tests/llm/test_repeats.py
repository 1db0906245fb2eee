"""Repeated windows by words and bytes, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from pointloom.llm import repeats, rindex, rlz


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["a", "b", "cc", "dd", "é", "ff"]
    passages = [" ".join(rng.choices(vocab + [f"w{i}" for i in range(40)], k=rng.randint(13, 60))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(vocab, k=rng.randint(1, 30))))
        out.append(rng.choice([" ", "\n", "\t "]).join(parts))
    return out + ["", None, "For " * 80, "For " * 120, passages[0], passages[0]]


def brute_words(rows):
    seen, out = {}, []
    words = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            seen.setdefault(tuple(words[d][i : i + 13]), d)
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 12):
            if seen[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(rows):
    seen, out = {}, []
    raw = {d: (t or "").encode() for d, t in rows}
    for d in sorted(raw):
        for i in range(len(raw[d]) - 99):
            seen.setdefault(raw[d][i : i + 100], (d, i))
    for d, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 99):
            if seen[b[i : i + 100]] < (d, i):
                gone[i : i + 100] = True
        kept = bytes(x for i, x in enumerate(b) if not gone[i])
        out.append((d, len(b), int(gone.sum()), int((gone[1:] > gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [3000, 2, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    for seed in (1, 2):
        rows = [(i * 3 - 20, t) for i, t in enumerate(corpus(seed))]
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(d, t, 7, 8) for d, t in rows], "doc_id long, text string, a int, start int").repartition(5)
        assert sorted(tuple(r) for r in rlz.remove_duplicates(docs).collect()) == brute_words(rows)
        assert sorted(tuple(r) for r in rindex.remove_repeats(docs).collect()) == brute_bytes(rows)


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (3, "zz"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in rlz.remove_duplicates(docs).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].n_removed == 0 and got[2].n_removed == 60 and got[3].n_words == 1
    assert rlz.remove_duplicates(docs.limit(0)).count() == 0
    assert rindex.remove_repeats(docs.limit(0)).count() == 0


def test_batches_are_sifted_alike():
    """The sifting of sorted units gives the same however the rows are cut into batches."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 400
    a = rng.integers(0, 25, n)
    u = a * 10 + rng.integers(0, 3, n) * (a % 3 > 0)
    doc, at = rng.integers(0, 9, n), rng.integers(0, 50, n)
    order = np.lexsort((at, doc, u, a))
    cols = [np.zeros(n, np.int8), a[order], u[order], doc[order], at[order], np.ones(n, np.int32)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "a", "u", "doc", "at", "n"])
    for same in (True, False):
        results = set()
        for step in (400, 97, 7, 1):
            out = repeats._sift(same)(iter([whole.slice(i, step) for i in range(0, n, step)]))
            results.add(tuple(sorted(tuple(r.values()) for b in out for r in b.to_pylist())))
        assert len(results) == 1


def test_run_index_maps_back():
    units = [b"abracadabra" * 12, b"xbracadabra" * 12, b"abracadabra" * 12]
    index = rindex.RunIndex(units)
    rows, text = index.rows.copy(), [b"" for _ in units]
    for _ in range(len(units[0])):
        symbol, rows = index.step(rows)
        text = [bytes([s - 1]) + t for s, t in zip(symbol, text)]
    assert text == units
    assert len(index.start) < sum(map(len, units)) / 4  # runs are few in repetitive text
