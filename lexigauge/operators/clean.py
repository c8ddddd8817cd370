"""Cleaning of table rows into one text per row, with every rejected row accounted for."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexigauge.functions import clean_text, is_valid_text
from lexigauge.sources.csv_text import CORRUPT, CsvText

RAGGED, INVALID_CELL, INVALID_TEXT = "ragged", "invalid_cell", "invalid_text"
REASONS = (RAGGED, INVALID_CELL, INVALID_TEXT)
KEPT = "kept"


def clean_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the given columns by their cleaned text."""
    return df.withColumns({c: clean_text(F.col(c).cast("string")) for c in columns})


def all_valid(columns: list[str]) -> Column:
    return reduce(and_, [is_valid_text(F.col(c)) for c in columns], F.lit(True))


def concat_fields(columns: list[str]) -> Column:
    """Cells joined with one space."""
    return F.concat_ws(" ", *[F.col(c) for c in columns])


def select_fields(
    columns: list[str], names: list[str] | None = None, positions: list[int] | None = None
) -> list[str]:
    """Columns by name or by 1-based position; all of them if neither is given."""
    if names is not None and positions is not None:
        raise ValueError("give names or positions, not both")
    if positions is not None:
        for position in positions:
            if not 1 <= position <= len(columns):
                raise IndexError(f"position {position} is outside 1..{len(columns)}")
        return [columns[p - 1] for p in positions]
    if names is not None:
        unknown = [n for n in names if n not in columns]
        if unknown:
            raise ValueError(f"no such fields: {unknown}")
        return list(names)
    return list(columns)


def clean_rows(
    df: DataFrame,
    row_id: str,
    columns: list[str],
    names: list[str] | None = None,
    positions: list[int] | None = None,
) -> DataFrame:
    """`(row_id, text, reject_reason)` for every input row, in one pass and without a shuffle.

    All cells must be valid after cleaning, also those not selected. A rejected row has a
    reason and no text; a kept row has a text and no reason.

    The result leaves through a generator of one row, because Spark would otherwise copy the
    whole cleaning chain into every filter on the result and run it again there.
    """
    selected = select_fields(columns, names, positions)
    ragged = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    cleaned = clean_cells(df, columns).select(
        F.col(row_id),
        ragged.alias("ragged"),
        all_valid(columns).alias("cells_valid"),
        concat_fields(selected).alias("joined"),
    )
    reason = (
        F.when(F.col("ragged"), F.lit(RAGGED))
        .when(~F.col("cells_valid"), F.lit(INVALID_CELL))
        .when(~is_valid_text(F.col("joined")), F.lit(INVALID_TEXT))
    )
    judged = cleaned.select(row_id, "joined", reason.alias("reject_reason"))
    text = F.when(F.col("reject_reason").isNull(), F.col("joined")).alias("text")
    return judged.select(row_id, F.inline_outer(F.array(F.struct(text, F.col("reject_reason")))))


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason").isNotNull()).drop("text")


def row_accounting(rows: DataFrame) -> DataFrame:
    """`(reject_reason, n_rows)`; kept rows under the reason `kept`."""
    reason = F.coalesce(F.col("reject_reason"), F.lit(KEPT)).alias("reject_reason")
    return rows.groupBy(reason).agg(F.count("*").alias("n_rows"))


def observed(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """`rows` as they are, and the counts of kept and rejected ones that whatever reads them next takes along.

    The counts stand in the observation once a query over the rows has run: `observed_accounting` shows them.
    """
    reason = F.col("reject_reason")
    counts = [F.count(F.when(reason.isNull(), 1)).alias(KEPT)]
    counts += [F.count(F.when(reason == r, 1)).alias(r) for r in REASONS]
    seen = Observation(name)
    return rows.observe(seen, *counts), seen


def observed_accounting(spark: SparkSession, seen: Observation) -> DataFrame:
    """`row_accounting` from an observation, without a pass over the rows."""
    counts = [(reason, n) for reason, n in seen.get.items() if n]
    return spark.createDataFrame(counts, "reject_reason string, n_rows long")


def preview(rows: DataFrame, row_id: str, n: int = 10) -> DataFrame:
    """The first `n` kept texts."""
    return kept(rows).orderBy(row_id).limit(n)


def clean_csv(
    source: CsvText, names: list[str] | None = None, positions: list[int] | None = None
) -> DataFrame:
    """`clean_rows` over a CSV source; names are cleaned header names."""
    if names is not None:
        if positions is not None:
            raise ValueError("give names or positions, not both")
        positions = [source.columns.index(source.column_of(n)) + 1 for n in names]
    return clean_rows(source.rows, "row_id", source.columns, positions=positions)
