"""CSV files with a header row, read as plain text cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.functions import clean_text, is_valid_text

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class CsvText:
    """Rows as string cells `c1..cn` plus `row_id`, and the cleaned header names by position.

    `row_id` grows with the position in the file but is not dense. Rows with too few or too
    many cells carry their source line in `_corrupt_record`.
    """

    rows: DataFrame
    headers: list[str]
    header_issues: DataFrame

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(1, len(self.headers) + 1)]

    def column_of(self, name: str) -> str:
        """Column of a header name; the first one where a name occurs twice."""
        if name not in self.headers:
            raise ValueError(f"no such header: {name!r}")
        return self.columns[self.headers.index(name)]

    def columns_at(self, positions: list[int]) -> list[str]:
        """Columns at 1-based positions."""
        for position in positions:
            if not 1 <= position <= len(self.headers):
                raise IndexError(f"position {position} is outside 1..{len(self.headers)}")
        return [self.columns[p - 1] for p in positions]


def read_csv_text(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> CsvText:
    """Read CSV (UTF-8, `"` quoting with doubled quotes) without giving up odd headers or rows.

    `multi_line=False` lets Spark split large files; use it where no quoted cell holds a
    newline. Only the header row passes through the driver.
    """
    options = {
        "encoding": "UTF-8",
        "quote": '"',
        "escape": '"',
        "multiLine": multi_line,
        "columnPruning": False,
    }
    try:
        top = spark.read.options(**options).csv(path, header=False).limit(1)
        cells = [clean_text(F.col(c)).alias(c) for c in top.columns]
        first = top.select(*cells).first() if cells else None
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST"):
            raise FileNotFoundError(path) from error
        raise
    if first is None:
        raise ValueError(f"no header row in {path}")
    headers = list(first)

    columns = [T.StructField(f"c{i}", T.StringType()) for i in range(1, len(headers) + 1)]
    schema = T.StructType(columns + [T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.options(**options)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path, schema=schema, header=True)
        .select(F.monotonically_increasing_id().alias("row_id"), "*")
    )
    names = spark.createDataFrame(list(enumerate(headers, 1)), "position int, header string")
    return CsvText(rows, headers, names.filter(~is_valid_text(F.col("header"))))


MAX_HEADERS = 1000


def _first_lines(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, first line) of every file, in the order of their names: one row a file, as many as Spark lists."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    top = lines.filter("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    return [(r.file, r.line) for r in top.orderBy("file").collect()]


def read_csv_by_name(spark: SparkSession, path: str, multi_line: bool = False) -> CsvText:
    """Like `read_csv_text` for files whose headers differ: cells are put together by their cleaned header names.

    Every file has a header of its own, on its first line. The columns are the names of all headers in the
    order they appear, files by their names; of a name that a header has twice the first cell comes
    first, then the second. A file without one of the columns has null there. `header_issues` has
    `(file, position, header, issue)`: names that are no valid text, and, under `differs`, the names of files whose header is
    not that of the first file. Files with the same header are read together.
    """
    try:
        tops = _first_lines(spark, path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST"):
            raise FileNotFoundError(path) from error
        raise
    if not tops:
        raise ValueError(f"no header row in {path}")
    files: dict[str, list[str]] = {}
    for file, line in tops:
        files.setdefault(line, []).append(file)
    if len(files) > MAX_HEADERS:
        raise ValueError(f"{len(files)} different headers in {path}")
    parts = {line: read_csv_text(spark, own, multi_line) for line, own in files.items()}

    def keys(headers: list[str]) -> list[tuple[str, int]]:
        return [(h, headers[:i].count(h)) for i, h in enumerate(headers)]

    known = list(dict.fromkeys(k for part in parts.values() for k in keys(part.headers)))
    tables = []
    for number, part in enumerate(parts.values()):
        own = dict(zip(keys(part.headers), part.columns))
        cells = [(F.col(own[k]) if k in own else F.lit(None).cast("string")).alias(f"c{i}") for i, k in enumerate(known, 1)]
        # ids of a read use fewer than 50 bits, so those of different reads stay apart
        tables.append(part.rows.select((F.col("row_id") + F.lit(number << 50)).alias("row_id"), *cells, CORRUPT))
    rows = reduce(DataFrame.unionByName, tables)
    first = parts[tops[0][1]].headers
    told = [
        (file, i, h, None if parts[line].headers == first else "differs")
        for line, own in files.items()
        for file in own
        for i, h in enumerate(parts[line].headers, 1)
    ]
    names = spark.createDataFrame(told, "file string, position int, header string, issue string")
    issue = F.when(~is_valid_text(F.col("header")), F.lit("invalid")).otherwise(F.col("issue"))
    issues = names.withColumn("issue", issue).filter("issue IS NOT NULL")
    return CsvText(rows, [h for h, _ in known], issues)
