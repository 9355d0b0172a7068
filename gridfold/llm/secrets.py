"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Offsets come from SQL functions alone: `split` gives the text between the matches of a pattern and
`regexp_extract_all` the matches, so running sums of their lengths are the starts and ends.

Long strings of token characters are candidates. The encoding of each is inferred from its characters,
and it is tested for being uniformly random over that encoding's alphabet: chi-squared over the
counts, number of runs in the halves of the alphabet, and serial correlation. Their sum has a
p-value. Over the whole corpus a weighted Benjamini-Hochberg cut, with weights in proportion to
length since longer strings show more, finds the candidates that are not random, with at most `fdr` of them wrongly so;
the others are reported as secrets. The cut takes a histogram of bounded size, not the candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint, let, replace_columns

#: Kinds in the order in which they count, with their patterns. A run that is shorter than its kind's least
#: length can't contain a longer match, so the least length is part of the pattern of access and hex.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the battery, and their segments between slashes; = is part of one as padding at its end only.
PADDING = r"(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}" + PADDING
SEGMENT = r"[A-Za-z0-9+_-]{20,}" + PADDING
KINDS = ("assign", "access", "hex", "random")
#: Alphabets by encoding; the first whose characters cover the string is inferred. Fixed values.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Bins of the p-values' negative logarithm: so many a unit, and as many units.
BINS_PER_UNIT, UNITS = 20, 50
#: Running sums are made in blocks of so many, so that their cost stays in proportion to their number.
BLOCK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_sums(values: Column) -> Column:
    """Sums of the array of int up to and with each element."""

    def blocks(v: Column) -> Column:
        numbers = F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")))
        cut = lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))

        def all_of(sums: Column) -> Column:
            def one(b: Column) -> Column:
                return let(
                    F.struct(cut(b).alias("own"), _sum(F.slice(sums, F.lit(1), b)).alias("before")),
                    lambda s: F.transform(s["own"], lambda _, i: s["before"] + _sum(F.slice(s["own"], F.lit(1), i + 1))),
                )

            return F.flatten(F.transform(numbers, one))

        return let(F.transform(numbers, lambda b: _sum(cut(b))), all_of)

    return let(values, blocks)


def matches_at(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches (start, kind, end, value), in code points, end exclusive."""

    def found(parts: Column) -> Column:
        between, matches = parts["between"], parts["matches"]
        ends = running_sums(F.transform(matches, lambda m, i: F.char_length(F.get(between, i)) + F.char_length(m)))
        spans = let(ends, lambda e: F.transform(matches, lambda m, i: F.struct((F.get(e, i) - F.char_length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"), m.alias("value"))))
        return spans

    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    return F.when(text.rlike(pattern), let(parts, found)).otherwise(F.array().cast(SPAN))


def alphabet_of(token: Column) -> Column:
    """The inferred alphabet of a string; padding at its end doesn't count. The last one covers the rest."""
    inferred = F.lit(ALPHABETS[-1][1])
    for _, letters in reversed(ALPHABETS[:-1]):
        inferred = F.when(F.translate(token, letters, "") == "", F.lit(letters)).otherwise(inferred)
    return inferred


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-4; a logistic curve fits it."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def chi2_tail(x: Column, k: int) -> Column:
    """Upper tail of the chi-squared distribution with k degrees, by the cube root's normal approximation."""
    return normal_tail((F.pow(F.greatest(x, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / (2 / (9 * k)) ** 0.5)


def p_random(token: Column) -> Column:
    """P-value of the battery under the hypothesis that the string is random over its inferred alphabet."""

    def battery(t: Column) -> Column:
        at, letters, n, a = t["at"], t["letters"], t["n"], t["a"]
        mean = F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / n
        squares = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, d: s + F.pow(F.size(F.filter(letters, lambda x: x == d)).cast("double"), F.lit(2.0)))
        chi = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (1 - 1 / n))
        upper = F.size(F.filter(at, lambda x: x >= a / 2)).cast("double")
        changes = F.size(F.filter(F.sequence(F.lit(1), F.size(at) - 1), lambda i: (F.get(at, i) >= a / 2) != (F.get(at, i - 1) >= a / 2)))
        expected = 1 + 2 * upper * (n - upper) / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        runs = F.when(spread > 0, (changes + 1 - expected) / F.sqrt(spread)).otherwise(F.lit(6.0))

        def serial(m: Column) -> Column:
            of = lambda i: F.get(at, i) - m
            top = F.aggregate(F.sequence(F.lit(1), F.size(at) - 1), F.lit(0.0), lambda s, i: s + of(i) * of(i - 1))
            below = F.aggregate(at, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
            return F.when(below > 0, top / below * F.sqrt(n)).otherwise(F.lit(6.0))

        x = F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2.0)) + F.pow(runs, F.lit(2.0)) + F.pow(let(mean, serial), F.lit(2.0))
        return chi2_tail(x, 3)

    def prepared(s: Column) -> Column:
        letters = F.split(s["bare"], "")
        alphabet = s["alphabet"]
        return let(
            F.struct(
                letters.alias("letters"),
                F.transform(letters, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double")).alias("at"),
                F.char_length(s["bare"]).cast("double").alias("n"),
                F.char_length(alphabet).cast("double").alias("a"),
            ),
            battery,
        )

    bare = F.rtrim(token, F.lit("="))
    return let(bare, lambda b: let(F.struct(b.alias("bare"), alphabet_of(b).alias("alphabet")), prepared))


def _tested(spans: Column) -> Column:
    """Spans with at least two of lower case, upper case and digits, 20 characters without padding, and their p-values."""
    mixed = F.filter(
        spans,
        lambda s: (F.char_length(F.rtrim(s["value"], F.lit("="))) >= 20)
        & (s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") | s["value"].rlike("[a-z][A-Z]")),
    )
    return F.transform(mixed, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"], p_random(s["value"]).alias("p")))


def _candidates(text: Column) -> Column:
    """Tested candidates, each with its tested segments between slashes: a secret may be a part of a path."""
    kind = KINDS.index("random")

    def with_parts(c: Column) -> Column:
        inner = lambda: F.transform(matches_at(c["value"], SEGMENT, kind), lambda m: F.struct((c["start"] + m["start"]).alias("start"), m["kind"].alias("kind"), (c["start"] + m["end"]).alias("end"), m["value"].alias("value")))
        spans = F.when(F.contains(c["value"], F.lit("/")), inner()).otherwise(F.array().cast(SPAN))
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["value"].alias("value"), c["p"].alias("p"), _tested(spans).alias("parts"))

    return F.transform(_tested(matches_at(text, CANDIDATE, kind)), with_parts)


def _cut(weighted: DataFrame, n: int, fdr: float) -> float:
    """The Benjamini-Hochberg cut on the weighted p-values of n candidates: those at or under it aren't random."""
    level = F.floor(F.least(-F.log(F.greatest(F.col("weighted"), F.lit(1e-300))), F.lit(float(UNITS))) * BINS_PER_UNIT).cast("int")
    counts = weighted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # at most about 1000 rows
    under, cut = 0, -1.0
    for level, count in counts:
        under += count
        p = math.exp(-level / BINS_PER_UNIT)  # the largest in the bin
        if p <= fdr * under / n:
            cut = p
    return cut


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = 0.05) -> DataFrame:
    """(doc, secrets): secrets is an array of (start, kind, end, value), by start, then kind as in KINDS.

    kind is an index of KINDS; offsets are in code points, end exclusive. One row for each row of
    `df`; a null or empty text has none. Repeated rows have the same secrets; null ids stay null.
    Columns other than the two aren't read. The cut of the battery depends on all rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    long_enough = F.filter(matches_at(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST)
    found = rows.select("doc", F.concat(long_enough, matches_at(text, ACCESS, 1), matches_at(text, HEX, 2)).alias("base"), _candidates(text).alias("candidates"))
    found = checkpoint(found)  # spans only; the texts aren't scanned again
    alone = lambda c: F.struct(*(c[n].alias(n) for n in ("start", "kind", "end", "value", "p")))
    all_of = F.flatten(F.transform("candidates", lambda c: F.concat(F.array(alone(c)), c["parts"])))
    each = found.select(F.explode(all_of).alias("c"))
    length = lambda c: c["end"] - c["start"]
    n, total = each.agg(F.count("*"), F.sum(length(F.col("c")))).first()
    weighted = lambda c: c["p"] * F.lit(total / n if n else 1.0) / length(c)
    cut = _cut(each.select(weighted(F.col("c")).alias("weighted")), n, fdr)
    # Segments count where their whole isn't random.
    passed = lambda c: F.when(weighted(c) > cut, F.array(alone(c))).otherwise(F.filter(c["parts"], lambda p: weighted(p) > cut))
    random = F.flatten(F.transform("candidates", passed))
    plain = F.transform(random, lambda c: F.struct(c["start"], c["kind"], c["end"], c["value"]))
    return found.select("doc", F.sort_array(F.concat("base", plain)).alias("secrets"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def with_digests(found: DataFrame) -> DataFrame:
    """n_assign, n_access, n_hex, base_sha256 and spans in place of the secrets."""
    base = F.filter("secrets", lambda s: s["kind"] < KINDS.index("random"))
    counts = {f"n_{name}": _count(k) for k, name in enumerate(KINDS[:3])}
    return replace_columns(found, counts | {"base_sha256": F.sha2(spans_text(base), 256), "spans": spans_text(F.col("secrets"))}).drop("secrets")
