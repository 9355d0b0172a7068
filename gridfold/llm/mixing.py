"""Mixing sources to target weights by systematic sampling.

A source's target is its share of the mix, filled like water: no source is above `max_repeat` times
its size, and what is over is shared anew by weight. All documents of a source have the same expected
number of copies, target / size. Their prefix sums, plus one random offset for the source, are cut at
the integers: a document is taken once for each integer that its own interval crosses. Documents are
in order of size class, so that the words taken are near the target and not only the copies.

The prefix sum is in two steps, so that no source is in one task: counts of the cells (source, size
class, salt) are summed over the few cells, and ranks are made within a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfold.llm.common import WORD, checkpoint, keyed

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: A size class spans a factor of 2 ** (1 / CLASSES_PER_DOUBLING); each is dealt over SALTS cells.
SALTS = 32


def words(text: Column) -> Column:
    """Number of words, runs of anything but ASCII blanks; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_int(text: Column) -> Column:
    """A hash of 32 bits that other SQL engines have as well: the first 8 hex digits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, share_percent: int = 150, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, target) of (source, size) rows, one row for each source.

    The windows run over one row for each source, after the aggregation.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    pattern = F.array(*(F.lit(w) for w in weights))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.get(pattern, ((F.row_number().over(by_code_point) - 1) % len(weights)).cast("int")).cast("long"))
    # In order of the level at which a source is full, those before the water level are at their cap.
    fills = F.col("source_size") / F.col("weight")
    order = Window.orderBy(fills, F.col("source").isNull(), "source")
    so_far, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = sources.withColumns(
        {
            "_total": F.sum("source_size").over(everything),
            "_full_size": F.coalesce(F.sum("source_size").over(so_far), F.lit(0)),
            "_rest_weight": F.sum("weight").over(rest),
        }
    )
    # The mix less what full sources take, in hundredths of words, and the level that it gives the rest.
    left = F.col("_total") * share_percent - F.col("_full_size") * (100 * max_repeat)
    is_full = F.col("weight") * left >= F.col("source_size") * (100 * max_repeat) * F.col("_rest_weight")
    filled = filled.withColumns({"_left": left, "_is_full": is_full})
    level = F.min_by(F.struct("_left", "_rest_weight"), F.struct(fills, F.col("source").isNull(), "source")).over(Window.partitionBy("_is_full"))
    filled = filled.withColumn("_level", level)
    target = F.when(F.col("_is_full"), (F.col("source_size") * max_repeat).cast("double")).otherwise(
        (F.col("weight") * F.col("_level._left")).cast("double") / (F.lit(100) * F.col("_level._rest_weight")).cast("double")
    )
    return filled.select("source", "source_size", "weight", target.alias("target"))


def taken_copies(sized: DataFrame, targets: DataFrame, seed: int = 0, max_repeat: int = 2) -> DataFrame:
    """`sized` (doc, source, size, ...) with source_size, target and copies.

    Every row counts for itself; rows that agree in all columns are interchangeable.
    """
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    celled = sized.withColumns(
        {
            "_class": F.length(F.bin("size")).cast("int"),
            "_salt": hash_int(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc").cast("string"), F.lit("null")))) % SALTS,
        }
    )
    cell = ["source", "_class", "_salt"]
    cells = celled.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # Both tables have a row for each source or cell; they are joined with each other before the rows.
    per_cell = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target")
    ranked = celled.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("size", "doc")))
    joined = ranked.alias("r").join(
        per_cell.alias("p"),
        F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._class") == F.col("p._class")) & (F.col("r._salt") == F.col("p._salt")),
    )
    offset = hash_int(F.concat(F.lit(f"{seed}:offset:"), source_key)) / F.lit(float(2**32))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    position = F.col("_before") + F.col("_rank")
    crossed = F.floor(position * F.col("_rate") + F.col("_offset")) - F.floor((position - 1) * F.col("_rate") + F.col("_offset"))
    columns = [c for c in sized.columns]
    return (
        joined.select(*(F.col(f"r.`{c}`") for c in columns), "_rank", "_before", "source_size", "target")
        .withColumns({"_rate": rate, "_offset": offset})
        .withColumn("copies", F.least(crossed, F.lit(max_repeat)))
        .select(*columns, "source_size", "target", "copies")
    )


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, share_percent: int = 150, max_repeat: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc, source, size, source_size, target, copies): how often the mix takes each document.

    Size is the number of words; null and empty texts have 0, and a source without words has target 0.
    A null source is a source of its own. Repeated rows count each for themselves, also under one
    or a null id. Columns other than the three aren't read. An empty table gives no rows.
    """
    sized = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{source_col}`").alias("source"), words(F.col(f"`{text_col}`")).alias("size"))
    sized = checkpoint(sized)  # a few bytes a document, read three times: totals, cells and ranks
    return taken_copies(sized, source_targets(sized, share_percent, max_repeat, weights), seed, max_repeat)


def repeat_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix itself: each row of `df` as often as `mix` takes it, also under a repeated or null id."""
    rows = keyed(df, id_col, text_col, "_gf_key")
    taken = mix(rows, "_gf_key", text_col, source_col, **how).filter("copies > 0").select(F.col("doc").alias("_gf_doc"), F.col("copies").alias("_gf_copies"))
    joined = rows.join(taken, F.col("_gf_key") == F.col("_gf_doc"))
    return joined.withColumn("_gf_copy", F.explode(F.sequence(F.lit(1), F.col("_gf_copies")))).select(*(F.col(f"`{c}`") for c in df.columns))
