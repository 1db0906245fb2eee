"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, convolved with learned filters over every STRIDE-th window
of the whole text, rectified, and max-pooled over overlapping chunks (two
adjacent halves each). The maximum and the mean over all chunks feed a small
dense layer and a sigmoid. Training is plain back-propagation with Adam on a
bounded, seeded sample of labelled rows (about per_class of each class, by the
hash of the id); scoring reads every text whole. Texts are multiplied in
batches, so the last bits of a score can depend on its neighbours in a batch.

Edge cases: null texts count as empty; empty texts are one chunk of padding;
labels without a document or with a null mark are not used; a document with
several labels is learned once per label; without labels of both classes every
score is the share of the one class (0.5 without any); equal rows give equal
results; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import held_out, map_rows

WIDTH, STRIDE, HALF, DIM, FILTERS, HIDDEN = 12, 3, 240, 6, 24, 12


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Texts on one byte array, each padded to whole halves and a gap of WIDTH bytes.

    Returns the array, the first window of every half and gap, the document of each half (-1: gap), and the number of windows."""
    halves = [max(1, -(-len(t) // HALF)) for t in texts]
    size = sum(k * HALF + WIDTH for k in halves)
    buf = np.zeros(size + WIDTH, np.uint8)
    starts, owner, at = [], [], 0
    for i, (t, k) in enumerate(zip(texts, halves)):
        buf[at : at + len(t)] = np.frombuffer(t, np.uint8)
        starts += range(at // STRIDE, (at + k * HALF) // STRIDE + 1, HALF // STRIDE)
        owner += [i] * k + [-1]
        at += k * HALF + WIDTH
    return buf, np.array(starts), np.array(owner), size // STRIDE


def windows(buf: np.ndarray, embedding: np.ndarray, n: int) -> np.ndarray:
    e = embedding[buf]
    return np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIM), (STRIDE * DIM * 4, 4))


def init(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "emb": make(256, DIM, scale=0.5), "conv": make(WIDTH * DIM, FILTERS, scale=0.15), "bias": np.zeros(FILTERS, np.float32),
        "w1": make(2 * FILTERS, HIDDEN, scale=0.15), "b1": np.zeros(HIDDEN, np.float32), "w2": make(HIDDEN, scale=0.3), "b2": np.zeros(1, np.float32),
    }


def pooled(p: dict[str, np.ndarray], texts: list[bytes]) -> tuple:
    """Features of each text, and what back-propagation needs of the way there."""
    buf, starts, owner, n = lay_out(texts)
    x = windows(buf, p["emb"], n)
    act = np.maximum(x @ p["conv"] + p["bias"], 0)
    half = np.maximum.reduceat(act, starts, axis=0)
    real = np.flatnonzero(owner >= 0)
    follows = np.append(owner[1:], -2)[real] == owner[real]  # the next half is of the same text
    first = np.append(True, owner[real][1:] != owner[real][:-1])
    chunk_at = real[follows | (first & ~follows)]
    paired = np.append(owner[1:], -2)[chunk_at] == owner[chunk_at]
    right = np.where(paired, chunk_at + 1, chunk_at)
    chunk = np.maximum(half[chunk_at], half[right])
    own = owner[chunk_at]
    begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    count = np.diff(np.append(begin, len(own))).astype(np.float32)
    top = np.maximum.reduceat(chunk, begin, axis=0)
    mean = np.add.reduceat(chunk, begin, axis=0) / count[:, None]
    return np.concatenate([top, mean], axis=1), (buf, starts, x, act, half, chunk_at, right, chunk, own, top, count)


def forward(p: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    f, _ = pooled(p, texts)
    h = np.tanh(f @ p["w1"] + p["b1"])
    return 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30)))


def _first(hits: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first hit of each group in each column."""
    rows, cols = np.nonzero(hits)
    at = np.unique(group[rows].astype(np.int64) * hits.shape[1] + cols, return_index=True)[1]
    return rows[at], cols[at]


def gradients(p: dict[str, np.ndarray], texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    f, (buf, starts, x, act, half, chunk_at, right, chunk, own, top, count) = pooled(p, texts)
    h = np.tanh(f @ p["w1"] + p["b1"])
    out = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30)))
    d = ((out - y) / len(y)).astype(np.float32)
    g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
    dh = np.outer(d, p["w2"]) * (1 - h * h)
    g["w1"], g["b1"] = f.T @ dh, dh.sum(axis=0)
    df = dh @ p["w1"].T
    dtop, dmean = df[:, :FILTERS], df[:, FILTERS:]
    dchunk = dmean[own] / count[own][:, None]
    r, c = _first(chunk == top[own], own)
    dchunk[r, c] += dtop[own[r], c]
    dhalf = np.zeros_like(half)
    left_wins = half[chunk_at] >= half[right]
    np.add.at(dhalf, chunk_at, np.where(left_wins, dchunk, 0))
    np.add.at(dhalf, right, np.where(left_wins, 0, dchunk))
    size = np.diff(np.append(starts, len(act)))
    seg = np.repeat(np.arange(len(starts)), size)
    rows, cols = _first((act == half[seg]) & (act > 0) & (dhalf[seg] != 0), seg)  # the window that attains its half's maximum
    v = dhalf[seg[rows], cols]
    dact = np.zeros_like(act)
    dact[rows, cols] = v
    hit = np.unique(rows)
    sub = dact[hit]
    g["conv"], g["bias"] = x[hit].T @ sub, sub.sum(axis=0)
    dx = (sub @ p["conv"].T).reshape(len(hit), WIDTH, DIM)
    demb = np.zeros_like(p["emb"])
    np.add.at(demb, buf[hit[:, None] * STRIDE + np.arange(WIDTH)], dx)
    g["emb"] = demb
    return g


def train(texts: list[bytes], marks: list[int], epochs: int = 10, batch: int = 16, rate: float = 0.004, seed: int = 1, most_bytes: int = 4800) -> dict[str, np.ndarray]:
    """Fit the network; in each epoch a text longer than most_bytes shows a random part of that length."""
    p, rng = init(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    y, step = np.array(marks, np.float32), 0
    p["b2"][0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            part = []
            for i in ids:
                t = texts[i]
                cut = int(rng.integers(0, max(1, len(t) - most_bytes + 1)))
                part.append(t[cut : cut + most_bytes])
            step += 1
            lr = rate * (1 - step / (total + 1)) ** 0.5
            for k, g in gradients(p, part, y[ids]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1200, epochs: int = 10, most_chars: int = 20_000) -> dict | float:
    """Network weights from about per_class labelled rows of each class; a constant without both classes.

    A label is taken if its id's hash falls under its class's share. Of a longer text most_chars characters from a
    hashed place are sent, so what the driver gets is bounded in bytes."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("mark")).where(F.col("mark").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    shares = marked.groupBy("mark").agg((F.lit(float(per_class)) / F.count("*")).alias("_share"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    sample = marked.join(F.broadcast(shares), "mark").where(place < F.col("_share")).select("doc_id", "mark")
    from_ = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - most_chars + 1, F.lit(1))).cast("int") + 1
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "mark", F.substring(F.col("text"), from_, F.lit(most_chars)).alias("text")).distinct().toArrow()
    found = sorted(zip(*(column.to_pylist() for column in rows.columns)), key=lambda r: (r[0], r[1], r[2] or ""))
    marks = [mark for _, mark, _ in found]
    if len(set(marks)) < 2:
        return sum(marks) / len(marks) if marks else 0.5
    return train([(text or "").encode() for _, _, text in found], marks, epochs=epochs)


def score_quality(docs: DataFrame, model: dict | float, threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(rows: dict[str, list]) -> dict[str, list]:
        p = shared.value
        texts = [(t or "").encode() for t in rows["text"]]
        scores: list[float] = []
        if isinstance(p, float):
            scores = [p] * len(texts)
        else:
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 120_000):
                    size += len(texts[end])
                    end += 1
                scores += [float(s) for s in forward(p, texts[at:end])] if size <= 300_000 else [score_long(p, texts[at])]
                at = end
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_rows(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def score_long(p: dict[str, np.ndarray], text: bytes, piece: int = 1000 * HALF) -> float:
    """The score of one very long text, its chunks computed piece by piece.

    A piece but the last is read WIDTH bytes on, so its windows are whole, and leaves its last chunk to the next, which starts one half earlier."""
    top, total, count, at = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0, 0
    while True:
        last = at + piece >= len(text)
        _, (_, _, _, _, _, _, _, chunk, *_rest) = pooled(p, [text[at:] if last else text[at : at + piece + WIDTH]])
        chunk = chunk if last else chunk[:-1]
        top, total, count = np.maximum(top, chunk.max(axis=0)), total + chunk.sum(axis=0), count + len(chunk)
        if last:
            break
        at += piece - HALF
    f = np.concatenate([top, (total / count).astype(np.float32)])
    h = np.tanh(f @ p["w1"] + p["b1"])
    return float(1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"][0], -30, 30))))
