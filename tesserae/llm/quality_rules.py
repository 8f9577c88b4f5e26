"""Quality rules with risk-controlled thresholds.

Each rule is a rate in [0, 1] on a fixed grid; a document whose rate lies above
the cutoff of its stratum is rejected.  Cutoffs come from labelled holdouts.
For a stratum and a rule, candidate cutoffs are tested from the most lenient
one down (fixed-sequence testing): a cutoff is certified while the exact
binomial test refutes "more than `risk` of good documents are rejected" at
level delta / (strata * rules), a Bonferroni correction over the family, so
with probability 1 - delta no certified cutoff exceeds its risk.  Each rule has
risk alpha / rules, hence all rules together reject at most a share alpha of a
stratum's good documents.  Among certified cutoffs the one with the best margin
of bad over good rejections is used; if none has a margin, the rule is off.

Nulls and odd cases: a null or empty text has no words and fails the base rule;
a null stratum is a stratum of its own; labels without an id or a quality are
ignored, several labels of one id count as good if any is; repeated rows are
judged each; without labels no rule is on and only the base rule rejects.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import bound_batches, materialize, plain_names

WINDOW = 8
GRID = 200
RULES = ("symbol_rate", "upper_rate", "punct_rate", "dup_line_rate", "repeat_rate")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?;:=~^_+/\\@{}[]()\"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def text_counts(arr: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of an Arrow string array."""
    w = K.Words(arr)
    n = len(arr)
    doc = w.docs()
    gram = K.ngrams(w.hashes, WINDOW)
    ok = np.flatnonzero(w.room() >= WINDOW)
    key = K.mix(gram[ok] + doc[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again = ok[order[same[:-1] | same[1:]]]
    rep = K.covered(again, WINDOW, len(w.starts))
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(arr.to_pylist()):
        own = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    return {
        "n_words": w.counts,
        "word_chars": K.per_text(_LEAD[w.data] & ~K.SPACE[w.data], w.offs),
        "n_symbols": K.per_text(_SYMBOL[w.data], w.offs),
        "n_dup_lines": dups,
        "n_repeat_words": K.per_text(rep, w.first),
        "n_lines": lines,
        "n_upper": K.per_text(_UPPER[w.data], w.offs),
        "n_punct": K.per_text(_PUNCT[w.data], w.offs),
    }


def featurize(docs: DataFrame, keep: list[str], text: str = "text", prefix: str = "") -> DataFrame:
    """The columns `keep` of docs followed by the counts, whose names get `prefix`."""
    names = [prefix + c for c in COUNTS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in names])
    src = bound_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        for batch in batches:
            for part, arr in K.slices(batch, "__text"):
                got = text_counts(arr)
                cols = [part.column(i) for i in range(len(keep))] + [pa.array(got[c], pa.int64()) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *names])

    return src.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 20) | (100 * r > 30 * n)


def rule_bins(prefix: str = "") -> dict[str, Column]:
    """Each rule's rate as a grid step from 0 to GRID; integer arithmetic, so every engine agrees."""
    c = lambda x: F.col(prefix + x)
    step = lambda a, b: F.least(F.lit(GRID), F.floor(GRID * a / F.greatest(b, F.lit(1)))).cast("int")
    return {
        "symbol_rate": step(c("n_symbols"), c("word_chars")),
        "upper_rate": step(c("n_upper"), c("word_chars")),
        "punct_rate": step(c("n_punct"), c("word_chars")),
        "dup_line_rate": step(c("n_dup_lines"), c("n_lines")),
        "repeat_rate": step(c("n_repeat_words"), c("n_words")),
    }


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f / a


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly."""
    return 1.0 if k >= n else _betainc(n - k, k + 1, 1 - p)


def choose_cutoff(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, level: float, margin: float = 0.02) -> int:
    """The chosen grid step of one stratum and rule; GRID if the rule stays off."""
    g, b = np.zeros(GRID + 1), np.zeros(GRID + 1)
    np.add.at(g, bins, good)
    np.add.at(b, bins, bad)
    n, n_bad = int(g.sum()), int(b.sum())
    best, cut = margin, GRID
    if not n or not n_bad:
        return GRID
    for c in range(GRID - 1, -1, -1):
        k, hit = int(g[c + 1 :].sum()), int(b[c + 1 :].sum())
        if binomial_tail(k, n, risk) > level:
            break
        if hit / n_bad - 2 * k / n > best + 1e-12:
            best, cut = hit / n_bad - 2 * k / n, c
    return cut


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str, prefix: str = "", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row (__stratum, cut_<rule>...) for each stratum with labelled documents that pass the base rule."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__good"))
    held = features.where(~base_failed(prefix)).join(lab, F.col("doc_id") == F.col("__id"))
    bins = rule_bins(prefix)
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bins[r].alias("bin")) for r in RULES]))
    hist = (
        held.select(F.col(f"`{stratum}`").cast("string").alias("__stratum"), "__good", pairs.alias("p"))
        .groupBy("__stratum", "p.rule", "p.bin")
        .agg(F.sum(F.when(F.col("__good") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("__good") > 0, 0).otherwise(1)).alias("bad"))
    )
    hist = materialize(hist, "quality-hist")
    family = max(1, hist.select("__stratum").distinct().count()) * len(RULES)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"__stratum": [pdf["__stratum"].iloc[0]]}
        for r in RULES:
            x = pdf[pdf.rule == r]
            out[f"cut_{r}"] = [choose_cutoff(x.bin.to_numpy(), x.good.to_numpy(), x.bad.to_numpy(), alpha / len(RULES), delta / family)]
        return pd.DataFrame(out)

    return hist.groupBy("__stratum").applyInPandas(pick, "__stratum string, " + ", ".join(f"cut_{r} int" for r in RULES))


def judge(features: DataFrame, cuts: DataFrame, stratum: str, prefix: str = "") -> DataFrame:
    """Adds <prefix>base_failed, <prefix>rejected_by (array of rules) and <prefix>kept."""
    bins = rule_bins(prefix)
    failed = F.filter(F.array(*[F.when(bins[r] > F.coalesce(F.col(f"cut_{r}"), F.lit(GRID)), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    out = features.join(cuts, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col("__stratum")), "left")
    out = out.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "rejected_by", failed)
    return out.withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.size(prefix + "rejected_by") == 0)).drop("__stratum", *[f"cut_{r}" for r in RULES])


def quality_report(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, counts, base_failed, rejected_by and kept of every document."""
    feats = materialize(featurize(docs.select("doc_id", F.col(f"`{stratum}`").alias("stratum"), "text"), ["doc_id", "stratum"]), "quality-counts")
    return judge(feats, cutoffs(feats, labels, "stratum", alpha=alpha, delta=delta), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that pass, with their columns unchanged; the texts are not shuffled unless the cutoff table outgrows a broadcast."""
    own, name, back = plain_names(docs)
    i, s, t, p = name["doc_id"], name[stratum], name["text"], "__q_"
    counted = materialize(featurize(own, own.columns, t, p), "quality-counted")
    narrow = counted.select(F.col(i).alias("doc_id"), F.col(s).alias("stratum"), *[F.col(p + c).alias(c) for c in COUNTS])
    cuts = materialize(cutoffs(narrow, labels, "stratum", alpha=alpha, delta=delta), "quality-cuts")
    return back(judge(counted, cuts, s, p).where(F.col(p + "kept")))
