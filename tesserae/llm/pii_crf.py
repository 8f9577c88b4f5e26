"""Personal data by patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  The
field adds spans that the patterns miss.  Its variables are a text's tokens with
a digit or an @; any other token is surely outside.  Potentials:

* a unary one from shape and context features (multinomial logistic regression),
* a chain one between neighbouring tokens,
* a skip one between distant tokens that are the same or have the same digits,
  each linked to the one before, so a token that repeats n times has n - 1 links.

Marginals come from damped loopy belief propagation over the whole text, so what
is clear in one place speaks for a repeated token in a doubtful one.  A token
joins a span if a label has at least MIN_P.

Training uses the base patterns as labels on a bounded sample, a documented
parameter: of the texts of at most SAMPLE_CHARS characters that have such tokens,
the share whose hash is lowest, SAMPLE of them on average.  Weights follow by gradient descent, link
potentials from how often labels meet; the patterns themselves scan every text.

Nulls and odd cases: a null text counts as empty and has no spans; a null id is
carried; repeated rows are scanned each; without a sample the field adds nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import bound_batches

KINDS = ("email", "ip", "card", "phone")
SAMPLE, SAMPLE_CHARS = 2000, 100_000
MIN_P, ROUNDS, DAMP = 0.9, 30, 0.3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_DIGIT = re.compile(r"[0-9]")
_SPACE = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches: at each @ the longest local part to its left that no match has used, and the domain after it."""
    out, floor, at = [], 0, t.find("@")
    while at >= 0:
        m = _DOMAIN.match(t, at)
        nxt = at + 1
        if m:
            s = at
            while s > floor and t[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end()))
                floor = nxt = m.end()
        if not m or s == at:
            floor = at + 1
        at = t.find("@", nxt)
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the order of KINDS, then by start."""
    out = [(0, s, e) for s, e in emails(t)] if "@" in t else []
    if _DIGIT.search(t):
        out += [(1, *m.span()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in t:
            out += [(3, *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


def tokens(t: str) -> list[tuple[int, int]]:
    """Spans of the words that hold a digit or an @."""
    out, end, n = [], 0, len(t)
    for m in _MARK.finditer(t):
        if m.start() < end:
            continue
        s, end = m.start(), m.end()
        while s > 0 and t[s - 1] not in _SPACE:
            s -= 1
        while end < n and t[end] not in _SPACE:
            end += 1
        out.append((s, end))
    return out


_CUES = (("mail", "contact"), ("phone", "tel", "call", "mobile", "fax"), ("card", "visa", "pay"), ("ip", "host", "server", "addr"))
N_FEATURES = 42


def _before(t: str, s: int) -> str:
    e = s
    while e > 0 and t[e - 1] in _SPACE:
        e -= 1
    b = e
    while b > 0 and e - b < 24 and t[b - 1] not in _SPACE:
        b -= 1
    return t[b:e].lower()


def features(t: str, toks: list[tuple[int, int]]) -> np.ndarray:
    x = np.zeros((len(toks), N_FEATURES), np.float32)
    for i, (s, e) in enumerate(toks):
        w, f = t[s:e], x[i]
        d, dots, before = len(_only_digits(w)), w.count("."), _before(t, s)
        f[0] = 1
        f[1] = "@" in w
        f[2] = "@" in w and "." in w.rsplit("@", 1)[1].strip(".,;:!?")
        f[3 + min(9, 0 if not d else 1 + (d > 1) + (d > 3) + (d > 6) + (d > 9) + (d > 12) + (d > 15) + (d > 19))] = 1
        f[13 + min(4, dots)] = 1
        f[18], f[19], f[20], f[21] = w[0] == "+", "-" in w, "(" in w, ")" in w
        core = w.strip(".,;:!?()#*$%&\"'")
        f[22], f[23] = core.isdigit(), any(ch.isalpha() for ch in core)
        f[24] = len(core) >= 20
        f[25] = f[22] and 13 <= len(core) <= 19 and luhn(_only_digits(core))
        f[26] = dots == 3 and all(p.isdigit() and len(p) <= 3 for p in core.split("."))
        f[27] = before[:1] == "+"
        f[28] = before[:1] == "(" or before[-1:] == ")"
        f[29] = any("0" <= ch <= "9" for ch in before)
        f[30] = i + 1 < len(toks) and t[toks[i + 1][0]] == "("
        f[31] = f[23] and d > 0 and "@" not in w
        for k, cue in enumerate(_CUES):
            f[32 + k] = any(before.startswith(c) for c in cue)
        f[36] = "=" in w or ":" in w
        f[37] = len(w) < 4
    return x


def links(t: str, toks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(chain pairs, skip pairs) of token numbers."""
    chain, skip, last = [], [], {}
    for i, (s, e) in enumerate(toks):
        if i and not t[toks[i - 1][1] : s].strip(_SPACE):
            chain.append((i - 1, i))
        w = t[s:e].strip(".,;:!?()#*$%&\"'").lower()
        d = _only_digits(w)
        for key in {("w", w), ("d", d)} if len(d) > 6 else {("w", w)}:
            if key in last and last[key] < i - 1:
                skip.append((last[key], i))
            last[key] = i
    return np.array(chain, np.int64).reshape(-1, 2), np.unique(np.array(skip, np.int64).reshape(-1, 2), axis=0)


def labels_of(toks: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside, 1 + kind inside a span."""
    y, spans, k = np.zeros(len(toks), np.int64), sorted((s, e, kind) for kind, s, e in spans), 0
    for i, (a, b) in enumerate(toks):
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            y[i] = 1 + spans[k][2]
    return y


class Field:
    """Trained potentials: unary weights, chain and skip log-potentials."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Label probabilities of each token by damped sum-product message passing."""
        node = x @ self.unary
        edges = np.concatenate([chain, skip])
        if len(edges):
            pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            msg = np.zeros((len(src), node.shape[1]))
            for _ in range(ROUNDS):
                belief = node.copy()
                np.add.at(belief, dst, msg)
                out = _log_sum((belief[src] - msg[back])[:, :, None] + pot)
                out -= out.max(axis=1, keepdims=True)
                new = DAMP * msg + (1 - DAMP) * out
                done = np.abs(new - msg).max() < 1e-4
                msg = new
                if done:
                    break
            node = node.copy()
            np.add.at(node, dst, msg)
        p = np.exp(node - node.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def more_spans(self, t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        toks = tokens(t)
        if not toks or len(taken := np.flatnonzero(labels_of(toks, base))) == len(toks):
            return []
        chain, skip = links(t, toks)
        p = self.marginals(features(t, toks), chain, skip)
        label = np.where(p.max(axis=1) >= MIN_P, p.argmax(axis=1), 0)
        label[taken] = 0
        joined, out = {(int(a), int(b)) for a, b in chain}, []
        for i in np.flatnonzero(label).tolist():
            s, e = toks[i]
            while s < e and t[s] in ".,;:!?\"'#*$%&":
                s += 1
            while e > s and t[e - 1] in ".,;:!?\"'#*$%&":
                e -= 1
            kind = int(label[i]) - 1
            if s == e:
                continue
            if out and out[-1][0] == kind and (i - 1, i) in joined and label[i - 1] == label[i]:
                out[-1] = (kind, out[-1][1], e)
            else:
                out.append((kind, s, e))
        return out


def _log_sum(a: np.ndarray) -> np.ndarray:
    m = a.max(axis=1, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=1)) + m[:, 0, :]


def _agreement(pairs: np.ndarray, y: np.ndarray, n: int, strength: float) -> np.ndarray:
    """Pointwise mutual information of the labels at linked tokens, shrunk towards agreement by `strength` counts."""
    c = np.full((n, n), 0.1) + np.eye(n) * strength
    np.add.at(c, (y[pairs[:, 0]], y[pairs[:, 1]]), 1)
    c = c + c.T
    p = c / c.sum()
    q = p.sum(axis=1)
    return np.clip(np.log(p / (q[:, None] * q[None, :])), -3, 3)


def fit(texts: list[str]) -> Field:
    """Weights from texts labelled by the base patterns."""
    xs, ys, chains, skips, n = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)], 0
    for t in texts:
        toks = tokens(t)
        if toks:
            xs.append(features(t, toks))
            ys.append(labels_of(toks, base_spans(t)))
            c, s = links(t, toks)
            chains.append(c + n)
            skips.append(s + n)
            n += len(toks)
    x, y, k = np.concatenate(xs).astype(np.float64), np.concatenate(ys), len(KINDS) + 1
    w = np.zeros((N_FEATURES, k))
    w[0, 0] = 4.0  # outside, unless the sample says otherwise
    if n:
        prior, goal = w.copy(), np.eye(k)[y]
        for step in range(400):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w -= 2.0 / (1 + step / 200) * (x.T @ (p - goal) / n + 2e-4 * (w - prior))
    return Field(w, _agreement(np.concatenate(chains), y, k, 1.0), _agreement(np.concatenate(skips), y, k, 5.0))


def sample_texts(docs: DataFrame, n: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """About n texts: all of them, or the share n / count whose hash is lowest; so a task sends its share of n, not n."""
    own = docs.where((F.char_length("text") <= chars) & F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    count = own.count()
    if count > n:
        own = own.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int((1 << 40) * n / count))
    return sorted(r["text"] for r in own.distinct().collect())


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, n_added and spans (kind:start:end) of every text."""
    model = docs.sparkSession.sparkContext.broadcast(field or fit(sample_texts(docs)))

    def show(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def run(batches):
        for batch in batches:
            for part, arr in K.slices(batch):
                rows = []
                for t in arr.to_pylist():
                    base = base_spans(t)
                    more = model.value.more_spans(t, base)
                    n = [0] * len(KINDS)
                    for k, _, _ in base:
                        n[k] += 1
                    rows.append((*n, hashlib.sha256(show(base).encode()).hexdigest(), len(more), show(sorted(base + more)) if more else show(base)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string()]))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans"])

    src = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, n_added long, spans string")
