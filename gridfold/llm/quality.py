"""Quality rules: fixed rules on each text, and robust multivariate outliers per language and source.

Statistics of a text are transformed to a vector of whole numbers. For each language and source a
minimum-covariance-determinant estimate is made by concentration steps: from several quantiles as centres
and quartile ranges on, each step takes the half of the vectors that is nearest to the centre, and from
it the next centre and covariance, until the determinant falls no further; the start with the least
determinant counts. Equal vectors are one in the estimate, so that copies don't outweigh the others. Each estimate is drawn toward that of
its language, and that toward the whole corpus's, with a weight that falls as it has more vectors: one formula for all sizes of
groups. Documents far from their group's estimate by Mahalanobis distance are rejected. Vectors are whole numbers and distances are cut by histograms, so sums and cuts are exact, and
the verdict doesn't depend on how rows are dealt over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.common import WORD, checkpoint, keyed, let

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Statistics, each with the least standard deviation that is believed, in the vector's thousandths. Most texts
#: have no symbol and no repeated line, so that without it any would be infinitely far away.
VECTOR = (("v_words", 500), ("v_word_chars", 500), ("v_symbols", 100), ("v_dup_lines", 100), ("v_repeats", 100))
SCALE = 1000
#: Share of the vectors in each concentration step, and the steps after which it is an error that a determinant still falls.
SUBSET, STEPS = 0.5, 100
#: Sums are kept in two parts, of multiples of this and of what is left.
LOW = 1 << 20
#: Quantiles of all statistics that are the starts' centres. The first counts unless another's determinant is smaller
#: by over TIE in its logarithm: distances are cut in bins of a percent, so that less says nothing.
STARTS, TIE = (0.5, 0.25, 0.75, 0.1, 0.9), 0.01
#: Probability that a text of a normal distribution passes.
PASS = 1 - 1e-7
#: An estimate that its last step took from n different vectors, half of its group, counts n; the one it is drawn toward counts this.
SHRINK = 25
#: Up to so many groups their estimates are broadcast (200 bytes each); above, they are joined by shuffle.
BROADCAST_GROUPS = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _covered(positions: Column) -> Column:
    """Words in the 3-word windows that start at the sorted distinct positions."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("long"), p - acc["last"])).alias("n"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def _sorted_positions(first: Column, second: Column) -> Column:
    return F.sort_array(F.array_distinct(F.concat(first, second)))


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur at least twice among `words`."""
    at = lambda a, i: F.get(a, i.cast("int"))

    def by_packing(hashes: Column) -> Column:
        """The hash's upper bits and the position share one long; sorting brings equal windows together."""
        bits = F.length(F.bin(F.size(hashes).cast("long"))).cast("int")

        def packed(b: Column) -> Column:
            low = F.lit(1).cast("long") * F.pow(F.lit(2.0), b).cast("long") - 1
            values = F.transform(hashes, lambda h, i: h - h.bitwiseAND(low) + i)

            def pairs(s: Column) -> Column:
                equal = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: _shift(at(s, i), b) == _shift(at(s, i - 1), b))

                def result(e: Column) -> Column:
                    mine, before = (lambda i: at(s, i).bitwiseAND(low)), (lambda i: at(s, i - 1).bitwiseAND(low))
                    mixed = F.exists(e, lambda i: at(hashes, mine(i)) != at(hashes, before(i)))
                    return F.when(mixed, by_structs(hashes)).otherwise(_covered(_sorted_positions(F.transform(e, mine), F.transform(e, before))))

                return let(equal, result)

            return let(F.sort_array(values), pairs)

        return let(bits, packed)

    def by_structs(hashes: Column) -> Column:
        """For windows that agree in their upper bits only: whole hashes with their positions are sorted."""
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))

        def result(s: Column) -> Column:
            equal = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: at(s, i)["h"] == at(s, i - 1)["h"])
            return let(equal, lambda e: _covered(_sorted_positions(F.transform(e, lambda i: at(s, i)["i"]), F.transform(e, lambda i: at(s, i - 1)["i"]))))

        return let(F.sort_array(pairs), result)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(w, i), at(w, i + 1), at(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(by_packing(h)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(windows(words))


def statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long); null counts as empty.

    n_lines are the lines with a word.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    by_words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return df.select(
        *(F.col(f"`{c}`") for c in keep),
        F.inline(F.array(F.struct(by_words.alias("w"), by_lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")))),
    ).select(*(F.col(f"`{c}`") for c in keep), "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics, in thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    made = {
        "v_words": F.log1p("n_words"),
        "v_word_chars": F.col("word_chars") / n,
        "v_symbols": F.log1p(10 * F.col("n_symbols") / n),
        "v_dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "v_repeats": F.col("n_repeat_words") / n,
    }
    return {name: F.rint(SCALE * value).cast("long") for name, value in made.items()}


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution with k degrees, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 10_000):
        term *= half / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


NAMES = [name for name, _ in VECTOR]
PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def _joined(rows: DataFrame, per_group: DataFrame, few: bool, on: tuple[str, ...] = ("g",)) -> DataFrame:
    return rows.join(F.broadcast(per_group) if few else per_group, list(on))


def _start(rows: DataFrame) -> DataFrame:
    """For each group and start, quantile and quartile range of each statistic, from counts of values."""
    values = rows.select("g", F.posexplode(F.array(*NAMES)).alias("j", "x")).groupBy("g", "j", F.floor(F.col("x") / 10).alias("x")).count()
    part = Window.partitionBy("g", "j")
    ranked = values.withColumns({"upto": F.sum("count").over(part.orderBy("x")), "n": F.sum("count").over(part)})
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), 10 * F.col("x") + 5))
    each = ranked.groupBy("g", "j").agg(*(quartile(q).alias(f"q{s}") for s, q in enumerate(STARTS)), ((quartile(0.75) - quartile(0.25)) / 1.349).alias("spread"))
    pick = lambda j, c: F.max(F.when(F.col("j") == j, F.col(c)))
    least = [s for _, s in VECTOR]
    centre = lambda s: F.struct(F.lit(s).alias("s"), *(pick(j, f"q{s}").cast("double").alias(f"m{j}") for j in range(len(VECTOR))))
    inverse = [(1 / F.sqrt(pick(i, "spread") * pick(i, "spread") + least[i] ** 2) if i == j else F.lit(0.0)).alias(f"k{i}{j}") for i, j in PAIRS]
    made = each.groupBy("g").agg(F.array(*(centre(s) for s in range(len(STARTS)))).alias("starts"), *inverse)
    return made.select("g", F.inline("starts"), *(f"k{i}{j}" for i, j in PAIRS), F.lit(None).cast("double").alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector from m by k, the inverse of the covariance's Cholesky factor."""
    total = F.lit(0.0)
    for i in range(len(VECTOR)):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"k{i}{j}") * (F.col(NAMES[j]) - F.col(f"m{j}"))
        total = total + y * y
    return total


def _bin(distance: Column) -> Column:
    """Bins of about one percent of the squared distance."""
    return F.floor(100 * F.log1p(distance)).cast("int")


def _estimate(summed: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse Cholesky factor and the determinant's logarithm of each group and start, from the sums of `_sums`; `falls` says whether the determinant is smaller than before."""
    d = len(VECTOR)
    whole = lambda name: F.col(f"{name}h") * float(LOW) + F.col(f"{name}l")
    made = summed.select("g", "s", "before", F.col("n").cast("double").alias("n"), *((whole(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(d)), *((whole(f"p{i}{j}") / F.col("n")).alias(f"p{i}{j}") for i, j in PAIRS))
    cov = {f"c{i}{j}": factor * (F.col(f"p{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + F.lit(float(VECTOR[i][1] ** 2) if i == j else 0.0) for i, j in PAIRS}
    made = _factored(made.withColumns(cov))
    falls = F.col("before").isNull() | (F.col("logdet") < F.col("before"))
    return made.select("g", "s", "n", *(f"m{i}" for i in range(d)), *(f"k{i}{j}" for i, j in PAIRS), *(f"c{i}{j}" for i, j in PAIRS), "logdet", falls.alias("falls"))


def _sums() -> dict[str, Column]:
    """Terms whose sums make an estimate: statistics and their products, each as two whole numbers whose sums fit 64 bits for any number of rows."""
    values = {f"s{i}": F.col(n) for i, n in enumerate(NAMES)} | {f"p{i}{j}": F.col(NAMES[i]) * F.col(NAMES[j]) for i, j in PAIRS}
    return {f"{k}h": F.floor(v / LOW).cast("long") for k, v in values.items()} | {f"{k}l": F.pmod(v, F.lit(LOW)) for k, v in values.items()}


def _factored(made: DataFrame) -> DataFrame:
    """`made` with k, the inverse of the Cholesky factor of the covariance c, and the determinant's logarithm."""
    d = len(VECTOR)
    for j in range(d):  # the Cholesky factor by columns; the least deviations keep it positive
        diagonal = F.col(f"c{j}{j}")
        for q in range(j):
            diagonal = diagonal - F.col(f"l{j}{q}") * F.col(f"l{j}{q}")
        made = made.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(1.0))))
        below = {}
        for i in range(j + 1, d):
            value = F.col(f"c{i}{j}")
            for q in range(j):
                value = value - F.col(f"l{i}{q}") * F.col(f"l{j}{q}")
            below[f"l{i}{j}"] = value / F.col(f"l{j}{j}")
        if below:
            made = made.withColumns(below)
    for i in range(d):  # its inverse by rows
        inverse = 1 / F.col(f"l{i}{i}")
        row = {f"k{i}{i}": inverse}
        for j in range(i):
            value = F.lit(0.0)
            for q in range(j, i):
                value = value + F.col(f"l{i}{q}") * F.col(f"k{q}{j}")
            row[f"k{i}{j}"] = -value * inverse
        made = made.withColumns(row)
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(d)), F.lit(0.0))
    return made.withColumn("logdet", logdet).drop(*(f"l{i}{j}" for i, j in PAIRS))


def _step(fitted: DataFrame, estimate: DataFrame, few: bool) -> DataFrame:
    """Sums over the half of each group's vectors that is nearest to each start's estimate, with that estimate's determinant as `before`.

    Vectors are summed by bins of their distance in one pass; of the bins those up to the one that fills the half are added up.
    """
    d = len(VECTOR)
    near = _joined(fitted, estimate.select("g", "s", F.col("logdet").alias("before"), *(f"m{i}" for i in range(d)), *(f"k{i}{j}" for i, j in PAIRS)), few).withColumn("b", _bin(_distance()))
    terms = _sums()
    binned = near.groupBy("g", "s", "b").agg(F.max("before").alias("before"), F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in terms.items()))
    part = Window.partitionBy("g", "s")
    upto = binned.withColumns({"_upto": F.sum("n").over(part.orderBy("b")), "_n": F.sum("n").over(part)})
    # A bin is in if those before it don't fill the half.
    inside = upto.filter(F.col("_upto") - F.col("n") < SUBSET * F.col("_n"))
    return inside.groupBy("g", "s").agg(F.max("before").alias("before"), F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in terms))


def _least(fitted: DataFrame, few: bool) -> DataFrame:
    """Each group's estimate with the least determinant."""
    d = len(VECTOR)
    factor = SUBSET / chi2_cdf(chi2_quantile(SUBSET, d), d + 2)
    moving, settled = checkpoint(_start(fitted)), []
    for _ in range(STEPS):
        made = checkpoint(_estimate(checkpoint(_step(fitted, moving, few)), factor))
        settled.append(made.filter(~F.col("falls")).drop("falls"))
        moving = made.filter("falls").drop("falls")
        if moving.isEmpty():
            break
    else:
        raise ArithmeticError(f"estimates still move after {STEPS} steps")
    every = settled[0]
    for some in settled[1:]:
        every = every.unionByName(some)
    rank = F.struct((F.col("logdet") + F.when(F.col("s") > 0, F.lit(TIE)).otherwise(F.lit(0.0))).alias("at"), F.col("s"))
    values = [c for c in every.columns if c not in ("g", "s", "logdet")]
    return checkpoint(every.groupBy("g").agg(F.min_by(F.struct(*values), rank).alias("least")).select("g", "least.*"))


def _name(*of: str) -> Column:
    """The name of a group: its language and source, its language, or nothing for the corpus; nulls are told from the word null."""
    return F.to_json(F.array(*(F.col(c) for c in of)), {"ignoreNullFields": "false"}) if of else F.lit("[]")


def _shrunk(own: DataFrame, parent: DataFrame, few: bool) -> DataFrame:
    """`own` (g, up, n, m, c) drawn toward the estimate of `up` in `parent` (g, m, c), factored anew."""
    d = len(VECTOR)
    values = [*(f"m{i}" for i in range(d)), *(f"c{i}{j}" for i, j in PAIRS)]
    above = parent.select(F.col("g").alias("up"), *(F.col(v).alias(f"up_{v}") for v in values))
    weight = F.col("n") / (F.col("n") + SHRINK)
    drawn = _joined(own, above, few, ("up",)).select("g", *((weight * F.col(v) + (1 - weight) * F.col(f"up_{v}")).alias(v) for v in values))
    return _factored(drawn)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc, statistics, base_failed, distance, kept): one row for each row of `df`.

    base_failed: fewer than 50 words, or over half of them in repeated 3-word windows. kept: not
    base_failed, and not an outlier of its language and source. Estimates take the rows that passed the base rules,
    those with equal vectors once, and are drawn toward the language's and the corpus's (see SHRINK).
    A null text counts as empty. A null language or source is one of its own. Each row that passed them
    has a distance, whatever the size of its group. Repeated rows are judged each
    for themselves; other columns aren't read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = statistics(rows, "text", ("doc", "lang", "source")).withColumn("base_failed", base_failed()).withColumns(vector())
    rows = checkpoint(rows)  # numbers only; the texts aren't read again
    named = rows.withColumns({"g": _name("lang", "source"), "language": _name("lang")})
    passed = named.filter(~F.col("base_failed"))
    groups = checkpoint(passed.select("g", F.col("language").alias("up")).distinct())
    few = groups.count() <= BROADCAST_GROUPS
    fitted = checkpoint(passed.select(F.explode(F.array("g", "language", _name())).alias("g"), *NAMES).distinct())
    made = _least(fitted, few)
    corpus = made.filter(F.col("g") == _name())
    language = _joined(made, groups.select(F.col("up").alias("g")).distinct(), few).withColumn("up", _name())
    language = checkpoint(_shrunk(language, corpus, few))
    estimate = checkpoint(_shrunk(_joined(made, groups, few), language, few))
    d = len(VECTOR)
    last = estimate.select("g", *(f"m{i}" for i in range(d)), *(f"k{i}{j}" for i, j in PAIRS))
    scored = named.join(F.broadcast(last) if few else last, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(PASS, d))
    return scored.select("doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "distance", kept.alias("kept"), *NAMES, "g")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `df` that `judge` keeps, each by its own verdict, also under a repeated or null id."""
    rows = keyed(df, id_col, text_col, "_gf_key")
    kept = judge(rows, "_gf_key", text_col, lang_col, source_col).filter("kept").select(F.col("doc").alias("_gf_doc"))
    return rows.join(kept, F.col("_gf_key") == F.col("_gf_doc"), "left_semi").drop("_gf_key")
