"""Line dedup: drop lines whose normalised text occurs in many documents.

Lines are exploded, normalised and hashed to 128 bits; documents are counted per hash after a
(hash, document) pre-aggregation, so that a line repeated within a document counts once and a very
common line is combined on the map side before it is shuffled. Hashes at or over the threshold lose
their lines everywhere but in the smallest document id; what stays is reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import checkpoint, let, replace_columns

#: The blanks that are stripped from both ends of a line to make its key.
_STRIP = " \t\n\x0b\x0c\r"
#: Lines in more documents than this, and than this part of all, are joined by broadcast: MOST_HOT rows of 24 bytes at most.
LEAST_HOT, MOST_HOT = 200, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def dropped_positions(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(doc, text_hash, positions) of the rows that lose lines; positions are distinct and start at 0.

    The null id is a group of its own, and the minimum passes over it.
    """
    doc = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = df.select(doc.alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.transform(lines_of(text), key_of)).alias("pos", "key"))
    lines = lines.filter(F.char_length("key") >= min_chars).select(
        "doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )
    # One row per (hash, document) before the count: the pair is the shuffle key, so a hot line spreads by document.
    held = lines.groupBy("h1", "h2", "doc").agg(F.collect_set(F.struct("text_hash", "pos")).alias("at"))
    drop = (
        held.select("h1", "h2", "doc")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.min("doc").alias("keeper"))
        .filter(F.col("docs") >= min_docs)
    )
    drop = checkpoint(drop)
    # Documents of lines that are very common would fill one task of a join by hash. Those lines are few: each has
    # over a share of all documents counted here, so that there are at most MOST_HOT, and they are broadcast.
    total = drop.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    least = max(LEAST_HOT, total // MOST_HOT)
    hot = drop.filter(F.col("docs") > least).select("h1", "h2", "keeper")
    tagged = held.join(F.broadcast(hot), ["h1", "h2"], "left")
    of_hot = tagged.filter("keeper is not null")
    rest = tagged.filter("keeper is null").drop("keeper").join(drop.filter(F.col("docs") <= least).select("h1", "h2", "keeper"), ["h1", "h2"])
    return (
        of_hot.unionByName(rest)
        .filter(~F.col("doc").eqNullSafe(F.col("keeper")))
        .select("doc", F.explode("at").alias("at"))
        .groupBy("doc", F.col("at.text_hash").alias("text_hash"))
        .agg(F.collect_set("at.pos").alias("positions"))
    )


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`df` with `text_col` rid of repeated lines, and n_lines and n_dropped (long).

    A line's key is the line stripped of ASCII blanks and with A-Z lower-cased. Keys of at least
    `min_chars` code points in at least `min_docs` documents stay only in the smallest document id.
    Rows with one id are one document. A null text is one empty line and stays null if nothing is
    dropped; an empty text stays empty. Rows with a null id are one document after all others.
    Input columns named n_lines or n_dropped are replaced; other columns pass through.
    """
    dropped = dropped_positions(df, id_col, text_col, min_chars, min_docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = lambda doc: {"_gf_null": doc.isNull(), "_gf_doc": F.coalesce(doc, F.lit(0).cast("long"))}
    left = df.withColumns(key(F.col(f"`{id_col}`").cast("long")) | {"_gf_hash": F.xxhash64(text)})
    right = dropped.select(*(c.alias(name) for name, c in key(F.col("doc")).items()), F.col("text_hash").alias("_gf_hash"), F.col("positions").alias("_gf_drop"))
    joined = left.join(right, ["_gf_null", "_gf_doc", "_gf_hash"], "left")
    lines = lines_of(F.col(f"`{text_col}`"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gf_drop"))
    kept = F.when(F.col("_gf_drop").isNull(), F.col(f"`{text_col}`")).otherwise(
        F.array_join(let(lines, lambda ls: F.transform(stay, lambda i: F.get(ls, i))), "\n")
    )
    result = replace_columns(
        joined,
        {
            text_col: kept,
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size("_gf_drop"), F.lit(0)).cast("long"),
        },
    )
    order = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return result.select(*(F.col(f"`{c}`") for c in order), "n_lines", "n_dropped")
