"""Secret scans: fixed patterns and a battery of randomness tests. DataFrame functions only.

Patterns: three kinds of secrets by regular expression, as spans in code points.

Battery: maximal runs of at least `min_chars` characters of the base64 alphabets are candidates. The smallest alphabet
that holds a candidate is its encoding. Its characters, numbered by their place in that alphabet, are tested for

* uniformity, by chi-squared over eight equal bins,
* independence of high and low, by the number of runs about the middle, and
* no serial correlation at lag one.

Each test is asked two ways. As a test of randomness it is a veto: a candidate that any of the three rejects at
`battery_level` / 3 is not random (p-value 1). As a test of ordinary writing, the null hypothesis is that the candidate
departs from randomness at least as far as words and identifiers do: by `UNEVEN` in chi-squared per character (a
noncentral chi-squared, whose lower tail is the p-value), by `CLINGING` in the share of neighbours on different sides
of the middle, by `SERIAL` in correlation. Those departures are constants; nothing is estimated from the corpus, so
secrets can't hide among secrets. All three p-values fall with length: a short run has to look very even, a long one
need not. Runs and correlation both read the order of the characters, so the larger of the two counts; given the counts
of characters their order is independent of them, so Fisher's method combines it with the first test. In
an alphabet of one class (digits, small letters, capitals) order tells nothing of ordinary writing, and the first
counts alone. Benjamini-Hochberg over all candidates of the corpus bounds the false discoveries by `fdr`.

One pass over the documents gives spans and p-values, which are materialised. The step-up threshold comes from a
histogram of -log2 p in quarter bits, rounded down, capped at 128 bits: at most 513 rows reach the driver whatever the
corpus. Nothing is shuffled but that histogram. Work in a text is linear in its length, but for sorts of its spans and
running sums, which take its matches by the square root of their number at a time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, let, whole_text

# The patterns of the three kinds, and how long the last group of each must be.
PATTERNS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # a run is maximal, so shorter ones can be left out here already
}
#: Stands before and after each match; where a text has it, another character that no pattern takes stands in for it.
MARK, INSTEAD = "\x01", "\x02"
# Alphabets in order of size; a candidate's encoding is the first that holds it.
ENCODINGS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Encodings of one class of characters.
PLAIN = ("digits", "lower", "upper")
BUCKETS, CAP = 4, 128
#: How far ordinary writing departs from randomness, at least: chi-squared per character over that of random draws, in alphabets of one class and in
#: others; by how much fewer than half of the neighbours stand on different sides of the middle; and the correlation of neighbours.
UNEVEN, CLINGING, SERIAL = {True: 0.2, False: 0.8}, 0.3, 0.5
SPAN = "struct<s:int,e:int,kind:string,m:string>"


def running(values: Column, zero: int, op) -> Column:
    """What `op`, associative and with the neutral element `zero`, makes of the first 1, 2, ... of an array of ints.

    The array is taken in parts of about the square root of its size, since appending to an array copies it.
    """
    start = F.struct(F.lit(zero).alias("now"), F.array().cast("array<int>").alias("out"))

    def one(part: Column) -> Column:
        return F.aggregate(part, start, lambda a, x: let(op(a["now"], x), lambda y: F.struct(y.alias("now"), F.array_append(a["out"], y).alias("out"))), lambda a: a["out"])

    def parts(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda k: one(F.slice(v, k * size + 1, size)))

    def joined(ps: Column) -> Column:
        before = one(F.transform(ps, lambda q: F.element_at(q, -1)))
        moved = lambda b: F.transform(ps, lambda q, k: F.when(k == 0, q).otherwise(F.transform(q, lambda x: op(F.get(b, k - 1), x))))
        return F.flatten(let(before, moved))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(parts(v), joined)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def spans(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, kind, m) in code points; those whose group is shorter than `least` are dropped."""
    marked = F.regexp_replace(F.translate(text, MARK, INSTEAD), pattern, f"{MARK}$0{MARK}")
    empty = F.array().cast(f"array<{SPAN}>")

    def found(p: Column) -> Column:
        # what lies before a match, the match, what lies before the next: every second part is a match
        at = lambda ends: F.transform(
            F.sequence(F.lit(0), F.size(p) - 2, F.lit(2)), lambda i: F.struct(F.get(ends, i).alias("s"), F.get(ends, i + 1).alias("e"), F.lit(kind).alias("kind"), F.get(p, i + 1).alias("m"))
        )
        return F.when(F.size(p) < 3, empty).otherwise(let(running(F.transform(p, F.length), 0, _sum), at))

    long_enough = (lambda x: F.length(F.regexp_extract(x["m"], pattern, group)) >= least) if group else (lambda x: F.length(x["m"]) >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(let(F.split(marked, MARK, -1), found), long_enough)).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(N > z), by the approximation of Abramowitz and Stegun 7.1.26; at least 2^-200."""
    # P and a1 to a5 of that formula.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(math.sqrt(2))
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for k in reversed(a):
        poly = (poly + k) * t
    half = F.greatest(F.lit(2.0**-200), poly * F.exp(-x * x) / 2)
    return F.when(z >= 0, half).otherwise(1 - half)


def alphabet_of(token: Column) -> Column:
    """The smallest alphabet that holds the token, else all signs together."""
    out = F
    for alphabet in ENCODINGS.values():
        chars = alphabet.replace("-", "") + ("-" if "-" in alphabet else "")
        out = out.when(F.regexp_like(token, F.lit(f"^[{chars}]+$")), F.lit(alphabet))
    return out.otherwise(F.lit(ENCODINGS["base64"] + "-_"))


def _chi_lower_tail(chi: Column, dof: float, shift: Column) -> Column:
    """P(X <= chi) for a noncentral chi-squared X, by Sankaran's approximation."""
    mean, second, third = dof + shift, dof + 2 * shift, dof + 3 * shift
    h = 1 - 2 * mean * third / (3 * second * second)
    p = second / (mean * mean)
    m = (h - 1) * (1 - 3 * h)
    centre = 1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p)
    spread = h * F.sqrt(2 * p) * (1 + 0.5 * m * p)
    return _normal_tail((centre - F.pow(chi / mean, h)) / spread)


def statistics(token: Column, alphabet: Column) -> Column:
    """Struct n, chi (over eight bins), high (characters in the upper half), switches (neighbours on different sides of the middle) and serial (correlation of neighbours; 1 if all are equal)."""
    size = F.length(alphabet)
    index = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c) - 1)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, v: s + f(v))

    def tests(x: Column) -> Column:
        n = F.size(x).cast("double")
        edge = lambda b: F.ceil(b * size / 8)  # noqa: E731  the first index of bin b
        expected = lambda b: n * (edge(b + 1) - edge(b)) / size
        observed = lambda b: F.size(F.filter(x, lambda i: F.floor(i * 8 / size) == b))
        chi = total(F.sequence(F.lit(0), F.lit(7)), lambda b: F.pow(observed(b) - expected(b), F.lit(2)) / expected(b))
        pairs = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
        switches = F.size(F.filter(pairs, lambda q: (q["a"] * 2 >= size) != (q["b"] * 2 >= size))).cast("double")

        def serial(avg: Column) -> Column:
            cross = F.aggregate(pairs, F.lit(0.0), lambda s, q: s + (q["a"] - avg) * (q["b"] - avg))
            return let(total(x, lambda v: (v - avg) * (v - avg)), lambda square: F.when(square == 0, F.lit(1.0)).otherwise(cross / square))

        return F.struct(
            n.alias("n"), chi.alias("chi"), F.size(F.filter(x, lambda i: i * 2 >= size)).cast("double").alias("high"),
            switches.alias("switches"), let(total(x, lambda v: v) / n, serial).alias("serial"),
        )

    return let(index, tests)


def vetoed(t: Column, battery_level: float) -> Column:
    """Whether a test of randomness rejects: chi-squared on its upper side (Wilson-Hilferty's normal form), the number of runs (Wald-Wolfowitz) and the correlation on both."""
    n, high, low, dof = t["n"], t["high"], t["n"] - t["high"], 7.0
    z_chi = (F.pow(t["chi"] / dof, F.lit(1 / 3)) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    mean, var = 2 * high * low / n, F.greatest(F.lit(1e-9), 2 * high * low * (2 * high * low - n) / (n * n * (n - 1)))
    z_runs = F.when((high == 0) | (low == 0), F.lit(99.0)).otherwise((t["switches"] - mean) / F.sqrt(var))
    z_serial = (t["serial"] + 1 / n) * F.sqrt(n)
    return F.least(_normal_tail(z_chi), 2 * _normal_tail(F.abs(z_runs)), 2 * _normal_tail(F.abs(z_serial))) < battery_level / 3


def ordinary(t: Column, plain: Column) -> Column:
    """The p-value of ordinary writing: small if the token is more even, changes sides more often and is less correlated than words and identifiers are."""
    n = t["n"]
    uneven = F.when(plain, F.lit(UNEVEN[True])).otherwise(F.lit(UNEVEN[False]))
    p_chi = _chi_lower_tail(t["chi"], 7.0, n * uneven)
    share = 0.5 - CLINGING
    p_runs = _normal_tail((t["switches"] - share * (n - 1)) / F.sqrt(share * (1 - share) * (n - 1)))
    bounded = F.least(F.lit(0.999), F.greatest(F.lit(-0.999), t["serial"]))
    p_serial = _normal_tail((F.lit(math.atanh(SERIAL)) - F.atanh(bounded)) * F.sqrt(n - 3))
    fisher = let(p_chi * F.greatest(p_runs, p_serial), lambda q: q * (1 - F.log(q)))
    return F.least(F.lit(1.0), F.when(plain, p_chi).otherwise(fisher))


def p_value(token: Column, battery_level: float) -> Column:
    def one(alphabet: Column) -> Column:
        plain = alphabet.isin(*[ENCODINGS[k] for k in PLAIN])
        return let(statistics(token, alphabet), lambda t: F.when(vetoed(t, battery_level), F.lit(1.0)).otherwise(ordinary(t, plain)))

    return let(alphabet_of(token), one)


def scored(text: Column, min_chars: int, battery_level: float) -> Column:
    """Candidates as structs s, e, kind and bits, -log2 of their p-values."""
    pattern = rf"[A-Za-z0-9+/_-]{{{min_chars},}}={{0,2}}"
    bits = lambda x: F.greatest(F.lit(0.0), -F.log2(p_value(F.regexp_replace(x["m"], "=+$", ""), battery_level)))
    return F.transform(spans(text, pattern, 0, min_chars, "random"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), bits(x).alias("bits")))


def threshold(rows: DataFrame, fdr: float) -> float:
    """The least -log2 p that Benjamini-Hochberg keeps over the column `bits`; infinite if none. Collects at most BUCKETS * CAP + 1 rows."""
    b = F.least(F.lit(BUCKETS * CAP), F.floor(F.col("bits") * BUCKETS)).cast("int")
    counts = {r["b"]: r["n"] for r in rows.groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect()}
    total, best, above = sum(counts.values()), math.inf, 0
    for k in sorted(counts, reverse=True):
        above += counts[k]
        if 2.0 ** (-k / BUCKETS) <= fdr * above / total:
            best = k / BUCKETS
    return best


def clear_of(found: Column, base: Column) -> Column:
    """The spans of `found`, which overlap none of one another, that overlap none of `base`; by one sort and two running extremes."""

    def kept(x: Column) -> Column:
        # the furthest end of a base span that starts here or before, and the next start of one that starts here or after
        ends = running(F.transform(x, lambda y: F.when(y["own"], F.lit(-1)).otherwise(y["e"])), -1, F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(y["own"], F.lit(2**31 - 1)).otherwise(y["s"]))), 2**31 - 1, F.least))
        free = lambda a, b: F.filter(F.transform(x, lambda y, i: F.when(y["own"] & (F.get(a, i) <= y["s"]) & (F.get(b, i) >= y["e"]), F.struct(y["s"], y["e"], y["kind"]))), lambda y: y.isNotNull())
        return let(ends, lambda a: let(starts, lambda b: free(a, b)))

    # of equal starts base spans come first, so they count as before
    flagged = lambda own: lambda y: F.struct(y["s"].alias("s"), F.lit(own).alias("own"), y["e"].alias("e"), y["kind"].alias("kind"))
    both = F.sort_array(F.concat(F.transform(base, flagged(False)), F.transform(found, flagged(True))))
    return F.when((F.size(found) == 0) | (F.size(base) == 0), F.transform(found, lambda y: F.struct(y["s"], y["e"], y["kind"]))).otherwise(let(both, kept))


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, battery_level: float = 0.001, fdr: float = 0.01
) -> DataFrame:
    """One row per input row: id, base (spans of the patterns) and random (spans of the battery that overlap none of base), in order.

    A span is a struct (s, e, kind): code points, end exclusive. Null and empty texts have no spans; repeated rows
    give repeated results; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(PATTERNS) for v in (k, i)])
    base = F.concat(*[spans(text, p, g, n, k) for k, (p, g, n) in PATTERNS.items()])
    order = F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.element_at(rank, x["kind"]).alias("rank"), x["e"].alias("e"), x["kind"].alias("kind")))
    plain = F.transform(F.sort_array(order), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    found = cut(rows.select("id", plain.alias("base"), scored(text, min_chars, battery_level).alias("candidates")))
    limit = threshold(found.select(F.explode("candidates").alias("x")).select("x.bits"), fdr)
    random = F.transform(F.filter("candidates", lambda x: (x["bits"] >= F.lit(limit)) & (x["bits"] > 0)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    out = found.select("id", "base", random.alias("random"))
    return out.select(F.col("id").alias(id_col), "base", clear_of(F.col("random"), F.col("base")).alias("random"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    every = F.transform(
        F.sort_array(F.transform(F.concat("base", "random"), lambda x: F.struct(x["s"], F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3).alias("r"), x["e"], x["kind"]))),
        lambda x: F.struct(x["s"], x["e"], x["kind"]),
    )
    return found.select(
        id_col, *[count(k).alias(f"n_{k}") for k in PATTERNS],
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"),
    )
