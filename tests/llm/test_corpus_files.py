"""Divergence, fill-in-middle and token files against brute force, SQL and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from pointloom.llm import divergence, fim, queries, rans, token_files

SF = "/root/testdata/sf0.001"
COLS = "doc_id long, text string, lang string, source string, n long, item string, ids string, form string"


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, l, s, 1, "x", "y", "z") for d, t, l, s in rows], COLS)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_fill_in_middle"])
def test_queries_against_sql(spark, name):
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        want = c.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    rows = lambda df: [tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(got.columns)].astype(object).itertuples(index=False)]
    assert sorted(map(plain, rows(got))) == sorted(map(plain, rows(want)))


def plain(row):
    """Values as text; pandas reads a column with nulls as floats."""
    return tuple("null" if v is None else str(int(v)) if isinstance(v, float) else str(v) for v in row)


def diverging(rows, least, top):
    """Every group's values by the definition."""
    find = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+").findall
    groups, df = {}, {}
    for _, text, lang, source in rows:
        terms = find("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups.setdefault(lang or "", {}).setdefault(source or "", Counter()).update(terms)
        df.setdefault(lang or "", Counter()).update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = {}
        for s, c in [*sources.items(), (None, sum(sources.values(), Counter()))]:
            total = sum(c[t] for t in kept) + 2 * len(kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(share[s][t], share[None][t]), t.encode()) for t in kept if sources[s][t] and share[s][t] > share[None][t]]
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", o.decode(), -v, i) for i, (v, o) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk,flush,slice_", [(50_000, 500_000, 1_000_000), (7, 5, 3)])
def test_divergence_against_definition(spark, monkeypatch, chunk, flush, slice_):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "FLUSH", flush)
    monkeypatch.setattr(divergence, "SLICE", slice_)
    rng = random.Random(11)
    words = ["Äpfel", "apple", "APPLE", "x1y", "ß", "straße", "STRASSE", "a", "b", "c", "日本", "d", "e\x00f", "İ"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "Ünï"])
        rows.append((None if i % 17 == 0 else i // 2, " ".join(rng.choices(words, k=rng.randint(0, 12))) if i % 9 else None, lang, source))
    rows += [(7, "hot " * 3000 + "apple", "en", "hot")] * 12 + [(9, "", "xx", "only"), (10, "...", "xx", "other"), (11, None, "yy", None)]
    got = sorted(map(tuple, divergence.divergence(rows_of(spark, rows), 10, 3).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == diverging(rows, 10, 3)
    assert divergence.divergence(rows_of(spark, rows).limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    total = [rng.randint(1, 8 * 10**15) for _ in range(500)]
    count = [rng.randint(0, t) for t in total]
    assert divergence.shares(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(count, total)]


def test_divergence_of_sources_with_many_pairs(spark):
    rows = [(i, f"common w{i % 3} w{i % 5}", "en", f"s{i % 41:02d}") for i in range(410)]
    got = divergence.divergence(rows_of(spark, rows)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == diverging(rows, 10, 10)


def test_middle_against_regex(spark):
    rng = random.Random(4)
    bits = ["word", "Ab", " ", "  ", "\n", "é", "é", "日本", "😀", "7", "<P", ">", "-", "\r\n", " ", "\x00", "ﬁ", "İ", "x" * 100]
    texts = ["", None, " ", "a", "<P>", "x <S> y", "z<M>", "lorem ipsum " * 30_000, "q" * 200_000, "same", "same"] + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(300)]
    rows = [(None if i == 3 else i, t, None, None) for i, t in enumerate(texts)]
    made = fim.fill_in_middle(rows_of(spark, rows))
    got = {(r.doc_id, r.n): r for r in made.withColumn("back", fim.restored()).collect()}
    forms = Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        n, row = len(units), got[doc_id, len(units)]
        digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want = ("plain", None, None, text)
        elif h4 % 100 < 20:
            want = ("spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
        else:
            want = ("psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")
        assert (row.form, row.prefix_chars, row.middle_chars, row.output) == want
        assert row.back == text
        forms[row.form] += 1
    assert min(forms.values()) > 10 and made.count() == len(rows)
    assert fim.fill_in_middle(rows_of(spark, rows).limit(0)).count() == 0


def test_sentinels_across_a_cut_restore(spark):
    rows = [(i, "a<P" + "b" * (i % 3) + "> <S x<M", None, None) for i in range(200)]
    bad = fim.fill_in_middle(rows_of(spark, rows)).withColumn("back", fim.restored()).join(rows_of(spark, rows).select("doc_id", "text"), "doc_id").where("not (back <=> text)")
    assert bad.count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, rans.BLOCK - 1, rans.BLOCK, rans.BLOCK + 1, 5 * rans.BLOCK + 77])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 40_000).astype(np.int64)
    table = rans.Table.from_bytes(rans.Table.fit(np.bincount(ids, minlength=50_000)).to_bytes())
    lengths = np.array([n // 3, n - n // 3, 0])
    data = rans.pack([5, None, -2], lengths, ids, table)
    frame = rans.Frame(data)
    assert frame.doc_ids == [5, None, -2] and frame.lengths.tolist() == lengths.tolist()
    assert (frame.ids(table) == ids).all()
    assert (frame.document(1, table) == ids[n // 3 :]).all()
    for a, b in ((0, n // 2), (n // 2, n), (n // 3, n // 3 + 1)):
        assert (frame.ids(table, a, min(b, n)) == ids[a : min(b, n)]).all()
    if n > rans.BLOCK:
        entropy = -sum(c / n * np.log2(c / n) for c in np.bincount(ids).tolist() if c)
        assert len(frame.words) * 32 + frame.states.size * 64 < n * entropy * 1.03 + frame.states.size * 64  # words alone near the entropy


def test_damage_is_found():
    ids = np.random.default_rng(1).integers(0, 300, 3 * rans.BLOCK)
    table = rans.Table.fit(np.bincount(ids))
    data = bytearray(rans.pack([1], np.array([len(ids)]), ids, table))
    data[-50] ^= 4  # in the last block's words
    with pytest.raises(ValueError, match="damaged frame"):
        rans.Frame(bytes(data))
    frame = rans.Frame(bytes(data), check=False)
    assert (frame.ids(table, 0, 100) == ids[:100]).all()
    with pytest.raises(ValueError, match="damaged block 2"):
        frame.ids(table, 2 * rans.BLOCK, 3 * rans.BLOCK)
    with pytest.raises(ValueError):
        rans.Table.from_bytes(table.to_bytes()[:-1])
    with pytest.raises(ValueError, match="not in the table"):
        rans.encode(np.array([400]), table)


def odd_texts():
    rng = random.Random(8)
    bits = ["Word", "don't", "'S", "é", "é", "́", " ", "  ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "　", "日本", "😀", "12", "½", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "İ", "ﬁ", "ǅ", "‍", "﻿", "\x00", "...", "--", "가", "가"]
    return ["", None, " ", "́", "a ́b", "plain words", "z" * 3000, "long text " * 20_000, "twin", "twin"] + ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(800)]


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FRAME", 3000)  # many frames
    path = token_files.default_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = odd_texts()
    rows = [(None if i in (4, 5) else (i * 7) % 1201 - 100, t, None, None) for i, t in enumerate(texts)] + [(2000, "repeated id", None, None)] * 40 + [(2000, "another", None, None)]
    folder = f"file:{tmp_path}/tokens"
    index = token_files.write_tokens(rows_of(spark, rows).repartition(5), folder, path, 2)
    assert index.count() > 3
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(token_files.read_tokens(spark, folder, ids=True).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    stream = np.frombuffer(b"".join(bytes(r.ids) for r in got), "<u4")
    part = sorted(token_files.read_span(spark, folder, 2500, 9100).collect())
    assert [i for r in part for i in r.ids] == stream[2500:9100].tolist()


def test_words_in_use_are_learned_once(monkeypatch):
    """A word that every batch has goes through the tokenizer once, however often the worker forgets; ids are the library's."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "WORDS", 40)
    monkeypatch.setattr(token_files, "BYTES", 100)
    path = token_files.default_tokenizer()
    whole, words = Tokenizer.from_file(path), token_files.WordIds(path)
    monkeypatch.setitem(token_files._KEPT, path, words)
    learned, learn = Counter(), token_files.WordIds._learn
    monkeypatch.setattr(token_files.WordIds, "_learn", lambda self, some: (learned.update(some), learn(self, some))[1])
    for i in range(12):
        texts = [None, "", " \t", f"common Often\x0bT\u0308 {' '.join(f'w{i}x{j}' for j in range(15))} ", "common <|endoftext|>\x00\x1cy \U0001f468\u200d\U0001f469 it's"]
        sizes, ids = words.encode(pa.array(["before", *texts]).slice(1), 2)
        want = [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert len(words.memo) < 80
        run = token_files._tokenized(path, 2, "<u2")
        batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
        monkeypatch.setattr(token_files.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
        (row,) = [r for b in run([batch]) for r in b.to_pylist()]  # texts are looked up in two parts
        assert row["ids"] == np.array(ids, "<u2").tobytes() and row["lengths"] == np.array(sizes, "<i8").tobytes()
    assert learned["common"] == learned["Often"] == learned["it's"] == 1 and learned["w3x3"] == 1


def test_token_files_of_no_rows(spark, tmp_path):
    folder = f"{tmp_path}/none"
    token_files.write_tokens(rows_of(spark, [(1, "a", None, None)]).limit(0), folder, token_files.default_tokenizer(), 2)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_token_query_against_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.default_tokenizer())
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(queries.op13_token_files(spark, SF).collect())
    at = 0
    for doc, row in zip(docs, got, strict=True):
        ids = whole.encode(doc.text or "", add_special_tokens=False).ids + [2]
        assert tuple(row) == (doc.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
