"""Tables of results as text, JSON and pixels; small results only, after aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.functions.scalars import state
from gridfold.params import FREE, OCCUPIED, UNKNOWN, EvidenceModel, Grid

#: Red, green and blue of unknown, free and occupied cells, and of cells that are wrong. Our own choice of colours.
COLOURS = {0: (0.55, 0.55, 0.60), 1: (0.97, 0.97, 0.95), 2: (0.10, 0.14, 0.26)}


def render(headers: list[str], rows: list[list[str]]) -> str:
    """A table with columns as wide as their widest entry; every row must have an entry for each header."""
    for row in rows:
        if len(row) != len(headers):
            raise ValueError(f"a row has {len(row)} entries for {len(headers)} headers")
    lines = [headers, None, *rows]
    widths = [max(len(line[i]) for line in lines if line is not None) for i in range(len(headers))]
    text = lambda line: "  ".join("-" * w if line is None else line[i].ljust(w) for i, w in enumerate(widths))
    return "\n".join(map(text, lines))


def fixed(value: Column | str, digits: int) -> Column:
    """A number with so many decimals: rounded from its exact binary value, halves to even."""
    return F.translate(F.format_number(F.col(value).cast("double") if isinstance(value, str) else value, digits), ",", "")


def agreement_rows(agreement: DataFrame, by: str = "decision_prob") -> DataFrame:
    """Formatted strings of a threshold or tolerance sweep, in order of it."""
    if by not in ("decision_prob", "spatial_tolerance"):
        raise ValueError("by must be decision_prob or spatial_tolerance")
    label = fixed(by, 2) if by == "decision_prob" else F.col(by).cast("string")
    rates = ("decided_fraction", "free_agreement", "occupied_agreement", "balanced_agreement")
    counts = ("free_called_occupied", "occupied_called_free")
    return agreement.orderBy(by).select(label.alias("label"), *(fixed(c, 4).alias(c) for c in rates), *(F.col(c).cast("string").alias(c) for c in counts))


#: Headers of the agreement table after the first. Fixed values.
AGREEMENT_HEADERS = ("decided", "free agr", "occ agr", "balanced", "free as occ", "occ as free")


def agreement_table(agreement: DataFrame, by: str = "decision_prob") -> str:
    rows = [list(r) for r in agreement_rows(agreement, by).collect()]  # a row for each step of the sweep
    first = "threshold" if by == "decision_prob" else "tolerance"
    return render([first, *AGREEMENT_HEADERS], rows)


#: Columns of the smear table: header, column of the report, decimals. Fixed values.
SMEAR_COLUMNS = (
    ("swept (m)", "swept_distance", 2),
    ("parked (m)", "parked_extent_along", 2),
    ("moving (m)", "moving_extent_along", 2),
    ("smear (m)", "smear_length", 2),
    ("smear/swept", "smear_fraction_of_sweep", 3),
    ("stale cells", "moving_stale_cells", 0),
    ("stale (m2)", "moving_stale_area", 2),
    ("footprint", "footprint_cells", 0),
    ("found", "moving_detected_cells", 0),
    ("unknown", "moving_unknown_footprint_cells", 0),
    ("called free", "moving_false_free_cells", 0),
    ("parked finds", "parked_detected_cells", 0),
    ("peak returns", "peak_returns_per_cell", 0),
)


def smear_table(report: DataFrame, label: str = "case") -> str:
    return render([label, *(h for h, _, _ in SMEAR_COLUMNS)], [list(r) for r in smear_rows(report, label).orderBy(label).collect()])  # a row for each case


def smear_rows(report: DataFrame, label: str = "case") -> DataFrame:
    """The smear table's formatted strings."""
    return report.select(F.col(label).cast("string"), *(fixed(c, digits).alias(c) for _, c, digits in SMEAR_COLUMNS))


def as_doubles(df: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """All columns but the labels as double, for flat reports."""
    return df.select(*(F.col(c) if c in labels else F.col(c).cast("double").alias(c) for c in df.columns))


def to_json(summary: DataFrame) -> DataFrame:
    """One JSON string for each row."""
    return summary.select(F.to_json(F.struct("*")).alias("json"))


def state_image(cells: DataFrame, model: EvidenceModel) -> DataFrame:
    """(row, col, red, green, blue) of each cell by its state, from 0 to 1; drawing is left to the reader's plotting library."""
    shown = state("log_odds", model)
    channel = lambda k: F.when(shown == 1, COLOURS[1][k]).when(shown == 2, COLOURS[2][k]).otherwise(COLOURS[0][k])
    return cells.select("row", "col", *(channel(k).alias(n) for k, n in enumerate(("red", "green", "blue"))))


def decision_image(cells: DataFrame, model: EvidenceModel) -> DataFrame:
    """(row, col, verdict) of scored cells: right or wrong, by what the map says and what is true."""
    s = state("log_odds", model)
    verdict = F.when(~F.col("scored"), "unscored").when(s == 0, "undecided").when((s == 2) == F.col("occupied"), "right").when(s == 2, "free_called_occupied").otherwise("occupied_called_free")
    return cells.select("row", "col", verdict.alias("verdict"))


def pyramid(cells: DataFrame, model: EvidenceModel, grid: Grid, levels: list[int]) -> DataFrame:
    """(level, row, col, free, occupied, unknown, most, state): what blocks of 2 ** level by 2 ** level cells hold, so that a map of any size is drawn from as many rows as a picture has pixels.

    free, occupied and unknown count the block's cells inside the grid, `most` is its highest log odds (the prior counts), state the one that most of its cells have: of equally many occupied, then free. Blocks
    without a touched cell are left out. Cells are summed on the map side, each for every level.
    """
    shown = state("log_odds", model)
    side = F.pow(F.lit(2.0), F.col("level")).cast("int")
    block = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("int").alias(c)
    spread = cells.withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels)))).select("level", block("row"), block("col"), shown.alias("_state"), "log_odds")
    counted = spread.groupBy("level", "row", "col").agg(F.count_if(F.col("_state") == FREE).alias("free"), F.count_if(F.col("_state") == OCCUPIED).alias("occupied"), F.greatest(F.max("log_odds"), F.lit(model.l_prior)).alias("most"))
    inside = F.least(side, F.lit(grid.rows) - F.col("row") * side) * F.least(side, F.lit(grid.cols) - F.col("col") * side)
    counted = counted.withColumn("unknown", inside.cast("long") - F.col("free") - F.col("occupied"))
    majority = F.when((F.col("occupied") >= F.col("free")) & (F.col("occupied") >= F.col("unknown")), OCCUPIED).when(F.col("free") >= F.col("unknown"), FREE).otherwise(UNKNOWN)
    return counted.select("level", "row", "col", "free", "occupied", "unknown", "most", majority.alias("state"))
