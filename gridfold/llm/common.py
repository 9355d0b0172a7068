"""Session, checkpoint and column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.session import checkpoint

__all__ = ["BLANKS", "WORD", "checkpoint", "free_shuffles", "ids_are_keys", "keyed", "let", "numbered", "replace_columns", "table"]
#: ASCII white space, as the contracts count it: space, and tab to carriage return.
BLANKS = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that a checkpoint has made unreachable."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ids_are_keys(df: DataFrame, id_col: str) -> bool:
    """Whether the ids are whole numbers, unique and not null."""
    of = F.col(f"`{id_col}`")
    whole = dict(df.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    return whole and df.select(of.alias("id")).groupBy("id").count().filter("id is null or count > 1").isEmpty()


def numbered(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """`df` with a long `key` for each row, in the order of the ids, null ones last; written once so that the numbers stay."""
    ordered = df.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), F.xxhash64(F.col(f"`{text_col}`")))
    return checkpoint(ordered.withColumn(key, F.monotonically_increasing_id()))


def keyed(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """`df` with a long `key` that no two rows share, in the order of the ids: the id itself where it can be."""
    if ids_are_keys(df, id_col):
        return df.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    return numbered(df, id_col, text_col, key)


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row, even if the body reads it in each step of a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """`df` with the columns of `new`; an input column of the same name (in any case) gives way."""
    lowered = {name.lower() for name in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in lowered]
    return df.select(*kept, *(value.alias(name) for name, value in new.items()))
