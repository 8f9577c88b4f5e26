"""Secret scan with a randomness test battery, in DataFrame functions only.

Base patterns give assignments, access keys and hex strings.  The battery looks
at every run of 20 or more key characters that meets none of them, letters only
and digits only included.  The narrowest alphabet that holds the run is its
inferred encoding.  Three tests ask whether the run could be uniform over that
alphabet: Pearson's chi-squared with the exact multinomial variance, the runs test
about the middle of the alphabet, and the lag-one serial correlation.

Discoveries are controlled against ordinary text: the null hypothesis is a source
whose index of coincidence (the chi-squared statistic in another unit) is that of
written text in the alphabet, and a run's p-value is the chance that so few repeats
arise at that length, or 1 if any of the three tests refutes randomness (at LEVEL,
Bonferroni over the three), which can only raise it.  Benjamini-Hochberg at rate Q,
within each encoding and class of length, so that the many short runs do not use
up the rate of the long ones, selects the discoveries: the spans reported are those
selected, and nothing is taken from them afterwards.  The counts behind it are a
histogram over the whole corpus.  Short runs over a narrow alphabet hold too little
evidence: see the README for the recall by encoding and length.

Positions are code points; a match starts where the pieces and matches before it
end, summed in blocks, so many matches in one text stay far from quadratic.

Nulls and odd cases: a null text counts as empty and has no spans; a null id is
carried; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
LEVEL, Q = 1e-3, 0.01
_D, _L, _U = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: encoding: (pattern, alphabet, index of coincidence of ordinary text over it)
ENCODINGS = {
    "digits": ("[0-9]+", _D, 0.2),
    "hex": ("[0-9a-f]+", _D + "abcdef", 0.105),
    "HEX": ("[0-9A-F]+", _D + "ABCDEF", 0.105),
    "lower": ("[a-z]+", _L, 0.065),
    "upper": ("[A-Z]+", _U, 0.065),
    "base32": ("[A-Z2-7]+", _U + "234567", 0.065),
    "base36": ("[0-9a-z]+", _D + _L, 0.065),
    "letters": ("[A-Za-z]+", _L + _U, 0.058),
    "base62": ("[0-9A-Za-z]+", _D + _L + _U, 0.058),
    "base64": ("[0-9A-Za-z+/_-]+", _U + _L + _D + "+/_-", 0.058),
}
BIN, BINS = 0.25, 120


def let(value: Column, body) -> Column:
    """Bind a value so that `body` evaluates it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def prefix_sums(step: Column) -> Column:
    """Exclusive prefix sums of an array of longs, by blocks of its square root."""

    def blocks(s):
        n = F.ceil(F.size(s["v"]) / s["b"]).cast("int")
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda j: _total(F.slice(s["v"], j * s["b"] + 1, s["b"]))))

    def inside(w):
        at = lambda i: F.floor(i / w["b"]).cast("int")
        return F.transform(w["v"], lambda x, i: F.get(w["p"], at(i)) + _total(F.slice(w["v"], at(i) * w["b"] + 1, i % w["b"])))

    first = F.struct(step.alias("v"), F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(step)))).cast("int").alias("b"))
    second = lambda s: F.struct(s["v"].alias("v"), s["b"].alias("b"), blocks(s).alias("t"))
    third = lambda u: F.struct(u["v"].alias("v"), u["b"].alias("b"), F.transform(u["t"], lambda x, j: _total(F.slice(u["t"], F.lit(1), j))).alias("p"))
    return let(let(let(first, second), third), inside)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<s, e, m, g>>: code-point start and end, the match, and a group (the match if None)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    long = lambda a: F.transform(a, lambda x: F.char_length(x).cast("long"))
    parts = F.struct(hits.alias("m"), held.alias("g"), long(F.split(text, pattern, -1)).alias("gap"))

    def place(p):
        step = F.zip_with(F.slice(p["gap"], F.lit(1), F.size(p["m"])), long(p["m"]), lambda a, b: a + b)
        return F.zip_with(
            F.zip_with(prefix_sums(step), F.slice(p["gap"], F.lit(1), F.size(p["m"])), lambda a, b: a + b),
            F.arrays_zip(p["m"].alias("m"), p["g"].alias("g")) if group else F.transform(p["m"], lambda m: F.struct(m.alias("m"), m.alias("g"))),
            lambda s, x: F.struct(s.alias("s"), (s + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), x["g"].alias("g")),
        )

    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string,g:string>>")
    return F.when(text.rlike(pattern), let(parts, place)).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), absolute error under 1e-7 (rational approximation), exact symmetry."""

    def positive(x):
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * (1 / math.sqrt(2 * math.pi)) * poly

    return F.when(z >= 0, positive(z)).otherwise(1 - positive(-z))


def encoding_of(run: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(ENCODINGS.items()):
        out = F.when(run.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _pick(enc: Column, value) -> Column:
    out = F.lit(None)
    for name, spec in ENCODINGS.items():
        out = F.when(enc == name, F.lit(value(spec))).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """struct<enc, n, p> of a run: the p-value against ordinary text, 1 if one of the three tests refutes randomness."""

    def stats(e):
        alphabet, n = e["alphabet"], F.size(e["x"]).cast("double")
        a = F.char_length(alphabet).cast("double")
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda s, ch: s + F.pow((F.char_length(e["run"]) - F.char_length(F.replace(e["run"], ch, F.lit("")))).cast("double"), F.lit(2.0)) * F.when(ch == "", 0.0).otherwise(1.0))
        zero = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("sq"), F.lit(0.0).alias("lag"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("high"))
        half = a / 2

        def step(s, x):
            up, was = x >= half, s["last"] >= half
            return F.struct(
                x.alias("last"), (s["sum"] + x).alias("sum"), (s["sq"] + x * x).alias("sq"),
                (s["lag"] + F.when(s["last"] < 0, 0.0).otherwise(s["last"] * x)).alias("lag"),
                (s["runs"] + F.when((s["last"] < 0) | (up != was), 1.0).otherwise(0.0)).alias("runs"),
                (s["high"] + F.when(up, 1.0).otherwise(0.0)).alias("high"))

        walk = F.aggregate(e["x"], zero, step)
        return F.struct(e["enc"].alias("enc"), n.alias("n"), a.alias("a"), e["ic"].alias("ic"), squares.alias("sq"), walk.alias("w"), F.get(e["x"], F.lit(0)).alias("first"))

    def tests(t):
        n, a, w = t["n"], t["a"], t["w"]
        z_chi = (a / n * t["sq"] - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
        h, l = w["high"], n - w["high"]
        mu = 2 * h * l / n + 1
        sd = F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(1e-9)))
        z_runs = F.when((h == 0) | (l == 0), F.lit(9.0)).otherwise(F.abs(w["runs"] - mu) / sd)
        lag = w["lag"] + w["last"] * t["first"]  # circular
        den = n * w["sq"] - w["sum"] * w["sum"]
        serial = F.when(den <= 0, F.lit(1.0)).otherwise((n * lag - w["sum"] * w["sum"]) / den)
        z_serial = F.abs(serial + 1 / (n - 1)) / (n / (n - 1) * F.sqrt(1 / (n - 2)))
        p = F.least(upper_tail(z_chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial))
        ic = (t["sq"] - n) / (n * (n - 1))
        k = t["ic"]
        # U-statistic variance; the cubic moment of written text is taken as 1.4 times the square of its index
        var = 2 * k * (1 - k) / (n * (n - 1)) + 4 * (0.4 * k * k) / n
        return F.struct(t["enc"].alias("enc"), n.cast("long").alias("n"), F.when(3 * p >= LEVEL, upper_tail((k - ic) / F.sqrt(var))).otherwise(1.0).alias("p"))

    def code(e):
        chars = F.filter(F.split(e["run"], ""), lambda c: c != "")
        return F.struct(e["run"].alias("run"), e["enc"].alias("enc"), e["alphabet"].alias("alphabet"), e["ic"].alias("ic"), F.transform(chars, lambda c: (F.instr(e["alphabet"], c) - 1).cast("double")).alias("x"))

    head = let(F.struct(run.alias("run"), encoding_of(run).alias("enc")), lambda e: F.struct(e["run"].alias("run"), e["enc"].alias("enc"), _pick(e["enc"], lambda s: s[1]).alias("alphabet"), _pick(e["enc"], lambda s: s[2]).cast("double").alias("ic")))
    return let(let(let(head, code), stats), tests)


def length_class(n: Column) -> Column:
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def p_bin(p: Column) -> Column:
    """Steps of BIN decimal orders, larger is rarer; a step's p-values are at most 10**(-BIN * step)."""
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / BIN)).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array<struct<kind, rank, s, e>>) and runs (array<struct<s, e, enc, n, p>>) that meet no base span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    span = lambda kind, rank, a: F.transform(a, lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), m["s"].alias("s"), m["e"].alias("e")))
    assign = F.filter(matches(text, ASSIGN, 2), lambda m: F.char_length(m["g"]) >= 8)
    base = F.concat(span("assign", 0, assign), span("access", 1, matches(text, ACCESS)), span("hex", 2, matches(text, HEX)))
    base = F.array_sort(base, lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"]))

    def test(m):
        return let(battery(m["m"]), lambda b: F.struct(m["s"].alias("s"), m["e"].alias("e"), b["enc"].alias("enc"), b["n"].alias("n"), b["p"].alias("p")))

    clear = lambda m: ~F.exists(F.col("base"), lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"]))
    found = docs.select("doc_id", base.alias("base"), matches(text, RUN).alias("runs"))
    return found.select("doc_id", "base", F.transform(F.filter("runs", clear), test).alias("runs"))


def discovery_limits(scanned: DataFrame, q: float = Q) -> dict[tuple[str, int], int]:
    """For each encoding and length class, the least p_bin that Benjamini-Hochberg accepts.

    The histogram has at most encodings * length classes * BINS rows whatever the corpus.
    """
    r = scanned.select(F.explode("runs").alias("r")).select("r.*")
    hist = r.groupBy("enc", length_class(F.col("n")).alias("c"), p_bin(F.col("p")).alias("b")).agg(F.count("*").alias("k"))
    by: dict[tuple[str, int], dict[int, int]] = {}
    for x in hist.collect():
        by.setdefault((x["enc"], x["c"]), {})[x["b"]] = x["k"]
    out = {}
    for key, bins in by.items():
        m, got = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            got += bins[b]
            if m * 10.0 ** (-BIN * b) <= q * got:
                out[key] = b
    return out


def secret_report(docs: DataFrame, q: float = Q) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, n_random and spans (kind:start:end, by start) of every document."""
    scanned = materialize(scan(docs), "secrets")
    return _report(scanned, discovery_limits(scanned, q))


def _report(scanned: DataFrame, limits: dict[tuple[str, int], int]) -> DataFrame:
    keys = sorted(limits)
    table = F.map_from_arrays(F.array(*[F.lit(f"{e}/{c}") for e, c in keys]).cast("array<string>"), F.array(*[F.lit(limits[k]) for k in keys]).cast("array<int>"))

    def secret(r):
        key = F.concat(r["enc"], F.lit("/"), length_class(r["n"]).cast("string"))
        return F.coalesce(p_bin(r["p"]) >= F.element_at(table, key), F.lit(False))

    more = F.transform(F.filter("runs", secret), lambda r: F.struct(F.lit("random").alias("kind"), F.lit(3).alias("rank"), r["s"].alias("s"), r["e"].alias("e")))
    out = scanned.withColumn("more", more)
    order = lambda a, b: F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    show = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(show(F.col("base")), 256).alias("base_sha256"),
        F.size("more").cast("long").alias("n_random"), show(F.array_sort(F.concat("base", "more"), order)).alias("spans"))
