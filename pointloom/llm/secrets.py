"""Secret scan: base rules plus probabilistic automata inferred from labelled credentials.

Inference (ALERGIA style): labelled credentials of one format build a prefix
tree with counts; states whose stopping and branching frequencies differ by
less than a Hoeffding bound, recursively, are merged (red-blue order). The
result is a probabilistic automaton; a sparse state joins the compatible one
that explains best what follows it. A candidate is a stretch of a run of
credential symbols, from the run's start, a separator or a format's prefix to a
separator or the run's end, of any length from the shortest labelled one; where
all labelled credentials of a format have one length, it ends at that length,
also inside a word. Every candidate is scored by its log-likelihood per symbol
under each automaton; those above a format's threshold (from held-back labelled
credentials) are taken by the margin over it, and none overlaps one taken
before. A candidate more than DROP behind its threshold at any of its symbols is
given up. Spans inside base spans are reported too.

Scores are additive, so a run is read as a stream: of all starts that are in one
state of an automaton, the one with the largest margin stays ahead whatever
follows, and only it is kept. Work is a run's length times an automaton's states
and the starts within its shortest length, for each credential taken.

Edge cases: a null or empty text has no spans; runs of any length are scored;
equal rows give equal results; null ids pass through; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import map_rows, short_batches

#: The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_HEX16 = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")

#: Public credential formats as (kind, prefixes, alphabet, shortest, longest body of the labelled examples).
ALNUM = string.ascii_letters + string.digits
FORMATS = (
    ("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ALNUM, 36, 36),
    ("gitlab", ("glpat-",), ALNUM + "_-", 20, 20),
    ("slack", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), string.digits + ALNUM + "-", 40, 60),
    ("google", ("AIza",), ALNUM + "_-", 35, 35),
    ("stripe", ("sk_live_", "rk_live_", "sk_test_"), ALNUM, 24, 32),
    ("aws", ("AKIA", "ASIA"), string.ascii_uppercase + "234567", 16, 16),
    ("sendgrid", ("SG.",), ALNUM + "_-.", 66, 66),
    ("npm", ("npm_",), ALNUM, 36, 36),
    ("jwt", ("eyJ",), ALNUM + "_-.", 60, 1000),
    ("digest", ("",), "0123456789abcdef", 32, 128),
)

#: Length of the shortest credential that any format has.
_SHORTEST = min(len(p) + shortest for _, ps, _, shortest, _ in FORMATS for p in ps)
#: Log-likelihood behind the threshold at which a candidate is given up.
DROP = 60.0
#: Runs of credential symbols; a shorter one holds no candidate.
CANDIDATE = re.compile(r"[A-Za-z0-9_.=+/-]{%d,}" % _SHORTEST, re.ASCII)

#: Where a credential may start or end inside a run: at a separator, or at a format's prefix.
_CUT = re.compile(r"[=/.+-]+")
_PREFIX = re.compile("(?=" + "|".join(re.escape(p) for _, ps, *_ in FORMATS for p in ps if p) + ")")


def labelled_examples(per_format: int = 240, seed: int = 7) -> list[tuple[str, str]]:
    """Seeded labelled credentials (kind, text), drawn from the public formats; lengths are log-uniform, as short ones are commoner."""
    rng = random.Random(seed)
    out = []
    for kind, prefixes, alphabet, low, high in FORMATS:
        for i in range(per_format):
            out.append((kind, prefixes[i % len(prefixes)] + "".join(rng.choices(alphabet, k=min(high, int(low * ((high + 1) / low) ** rng.random()))))))
    return out


class Automaton:
    """A probabilistic automaton: state -> (stop probability, {symbol: (next, probability)})."""

    def __init__(self, states: dict[int, tuple[int, int, dict[str, tuple[int, int]]]], alphabet: int):
        self.step = {}
        for s, (total, stops, edges) in states.items():
            unit = 1.0 / (total + 1.0)  # one visit's worth of mass for unseen symbols and for stopping
            self.step[s] = (
                math.log((stops + 0.01) * unit), {c: (t, math.log(n * unit)) for c, (t, n) in edges.items()}, math.log(unit / alphabet),
            )

    def score(self, text: str) -> float:
        """Log-likelihood per symbol; an unseen symbol costs the state's reserve and stays there."""
        s, total = 0, 0.0
        step = self.step
        for c in text:
            _, edges, unseen = step[s]
            hit = edges.get(c)
            if hit is None:
                total += unseen
            else:
                total += hit[1]
                s = hit[0]
        return (total + step[s][0]) / max(1, len(text))


def infer(samples: list[str], alpha: float = 0.05, least: int = 4, alphabet: int = 96) -> Automaton:
    """Merge statistically compatible prefix-tree states of the samples into an automaton."""
    total, stops, kids = [0], [0], [{}]
    for text in samples:
        at = 0
        for c in text:
            total[at] += 1
            nxt = kids[at].get(c)
            if nxt is None:
                nxt = len(total)
                kids[at][c] = nxt
                total.append(0), stops.append(0), kids.append({})
            at = nxt
        total[at] += 1
        stops[at] += 1
    count: list[dict[str, int]] = [{c: total[t] for c, t in k.items()} for k in kids]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(n1: int, t1: int, n2: int, t2: int) -> bool:
        return abs(n1 / t1 - n2 / t2) > bound * (1 / math.sqrt(t1) + 1 / math.sqrt(t2))

    def classes(s: int) -> dict[str, int]:
        """Visits by symbol class, so that sparse states are compared on what they can show."""
        out: dict[str, int] = {}
        for c, n in count[s].items():
            k = "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else c
            out[k] = out.get(k, 0) + n
        return out

    def alike(a: int, b: int) -> bool:
        if differ(stops[a], total[a], stops[b], total[b]):
            return False
        ka, kb = classes(a), classes(b)
        if any(differ(ka.get(c, 0), total[a], kb.get(c, 0), total[b]) for c in {*ka, *kb}):
            return False
        return total[a] < least or total[b] < least or not any(differ(count[a].get(c, 0), total[a], count[b].get(c, 0), total[b]) for c in {*count[a], *count[b]})

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if not alike(x, y):
                return False
            todo += [(kids[x][c], kids[y][c]) for c in kids[x].keys() & kids[y].keys() if kids[x][c] != kids[y][c]]
        return True

    def explained(q: int, t: int, depth: int = 24) -> float:
        """Log-likelihood of what follows t, to a depth, when it is read from state q."""
        out, todo = 0.0, [(q, t, 0)]
        while todo:
            x, y, d = todo.pop()
            for c, n in count[y].items():
                out += n * math.log((count[x].get(c, 0) + 1 / alphabet) / (total[x] + 1))
                if d < depth:
                    todo.append((kids[x].get(c, x), kids[y][c], d + 1))
            out += stops[y] * math.log((stops[x] + 0.01) / (total[x] + 1))
        return out

    def fold(a: int, b: int) -> None:
        """Add b's subtree to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            total[x] += total[y]
            stops[x] += stops[y]
            for c, n in count[y].items():
                count[x][c] = count[x].get(c, 0) + n
            for c, t in kids[y].items():
                if c not in kids[x]:
                    kids[x][c] = t
                elif kids[x][c] != t:
                    todo.append((kids[x][c], t))

    red, done = [0], {0}
    while True:
        blue = [(r, c, t) for r in red for c, t in sorted(kids[r].items()) if t not in done]
        if not blue:
            break
        r, c, t = max(blue, key=lambda e: (total[e[2]], -e[2]))
        target = max((q for q in red if q != 0 and compatible(q, t)), key=lambda q: explained(q, t), default=None)
        if target is None:
            red.append(t)
            done.add(t)
        else:
            kids[r][c] = target
            fold(target, t)
    return Automaton({s: (total[s], stops[s], {c: (t, count[s][c]) for c, t in kids[s].items()}) for s in red}, alphabet)


@lru_cache(1)
def models() -> dict[str, tuple[Automaton, float, int, bool]]:
    """By kind: the automaton, a low score of held-back labelled credentials less a margin, their shortest length, and whether all have it."""
    by_kind: dict[str, list[str]] = {}
    for kind, text in labelled_examples():
        by_kind.setdefault(kind, []).append(text)
    out = {}
    for kind, texts in by_kind.items():
        mixed = random.Random(11).sample(texts, len(texts))  # examples come prefix by prefix
        quarter, lengths = len(mixed) // 4, {len(t) for t in texts}
        auto, held = infer(mixed[quarter:]), mixed[:quarter]
        out[kind] = (auto, sorted(auto.score(t) for t in held)[len(held) // 20] - 0.25, min(lengths), len(lengths) == 1)
    return out


def likeliest(token: str) -> tuple[float, str | None]:
    """The largest margin of a format's log-likelihood over its threshold, summed over the symbols, and the format; (-inf, None) if none is likely enough."""
    best: tuple[float, str | None] = (-math.inf, None)
    for name, (auto, least, shortest, fixed) in models().items():
        fits = len(token) == shortest if fixed else len(token) >= shortest
        if fits and (margin := (auto.score(token) - least) * len(token)) >= 0 and margin > best[0]:
            best = (margin, name)
    return best


def classify(token: str) -> str | None:
    """The format that explains the token best, or None if none is likely enough."""
    return likeliest(token)[1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base rules: leftmost non-overlapping per kind, failing matches dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX16.finditer(text)]  # runs are maximal, so short ones never hide long ones
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]], s[1]))


def _best(run: str, starts: list[int], ends: set[int], low: int, high: int) -> tuple[float, int, int, int, str] | None:
    """The best candidate within run[low:high] as (-margin, -length, start, end, kind), read as a stream by each automaton."""
    best = None
    for kind, (auto, least, shortest, fixed) in models().items():
        step = auto.step
        young: list[tuple[int, float, int]] = []  # (state, margin, start) of starts still below the shortest length, first start first
        old: dict[int, tuple[float, int]] = {}  # by state the best (margin, start) of all others
        i, nxt = low, bisect_left(starts, low)
        while i < high:
            if nxt < len(starts) and starts[nxt] == i:
                young.append((0, 0.0, i))
                nxt += 1
            elif not young and not old:
                if nxt == len(starts):
                    break
                i = starts[nxt]
                continue
            c = run[i]
            i += 1
            moved, aged = [], {}
            for state, margin, start in [*young, *((s, m, a) for s, (m, a) in old.items())] if old else young:
                _, edges, unseen = step[state]
                hit = edges.get(c)
                if hit is None:
                    margin += unseen - least
                else:
                    state = hit[0]
                    margin += hit[1] - least
                if margin < -DROP:
                    continue
                if i - start < shortest:
                    moved.append((state, margin, start))
                elif state not in aged or (-margin, start) < (-aged[state][0], aged[state][1]):
                    aged[state] = (margin, start)
            if aged and (fixed or i in ends):
                for state, (margin, start) in aged.items():
                    margin += step[state][0]
                    if margin >= 0 and (best is None or (-margin, start - i, start, i, kind) < best):
                        best = (-margin, start - i, start, i, kind)
            young, old = moved, {} if fixed else aged
    return best


def likely_spans(run: str) -> list[tuple[int, int, str]]:
    """Credentials in a run of credential symbols: the candidates that a format explains, by margin and then length, none overlapping a better one."""
    cuts = [(m.start(), m.end()) for m in _CUT.finditer(run)]
    starts = sorted({0, *(b for _, b in cuts), *(m.start() for m in _PREFIX.finditer(run))})
    ends = {*(x for cut in cuts for x in cut), len(run)}  # some formats have bodies that may end in a separator
    out, todo = [], [(0, len(run))]
    while todo:
        low, high = todo.pop()
        if high - low >= _SHORTEST and (found := _best(run, starts, ends, low, high)):
            _, _, start, end, kind = found
            out.append((start, end, kind))
            todo += [(low, start), (end, high)]
    return sorted(out)


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the method adds the likely credentials."""
    base = base_spans(text)
    extra = [(m.start() + a, m.start() + b, kind) for m in CANDIDATE.finditer(text) for a, b, kind in likely_spans(m.group())]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda s: (s[0], order.get(s[2], 9), s[2], s[1]))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(rows: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for doc_id, text in zip(rows["doc_id"], rows["text"]):
        base, spans = spans_of(text or "")
        kinds = [k for _, _, k in base]
        out["doc_id"].append(doc_id)
        for k in KINDS:
            out[f"n_{k}"].append(kinds.count(k))
        out["base_sha256"].append(hashlib.sha256(_join(base).encode()).hexdigest())
        out["spans"].append(_join(spans))
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: counts of base spans, their digest, and all spans."""
    return map_rows(docs.select("doc_id", "text"), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced by mask; overlapping spans become one."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans_of(text)[1]:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def _redacted(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else redact(t))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret span masked; all rows and columns stay, n_chars follows the text."""
    out = short_batches(docs).withColumn("text", F.pandas_udf(_redacted, "string")(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
