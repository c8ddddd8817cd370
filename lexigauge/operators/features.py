"""The wide feature row: flattening, the fixed template, and normalisation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.fixed_values import (
    BY_SENTENCES,
    BY_WORDS,
    FEATURE_COLUMNS,
    N_SENTS,
    N_WORDS,
    OTHER_FEATURES,
    UNNAMED,
)

_DEPENDENCIES = "syntactic_analysis_dependency_stats_"


def feature_schema() -> T.StructType:
    """The 86 columns: a name, counts as LONG, metrics as DOUBLE."""
    fields = [T.StructField("dataset_name", T.StringType())]
    for name in FEATURE_COLUMNS:
        kind = T.DoubleType() if name in OTHER_FEATURES else T.LongType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def column(name: str) -> Column:
    """A top-level column, also where its name holds `:` or a dot."""
    return F.col(f"`{name}`")


def flatten(df: DataFrame, map_keys: dict[str, list[str]] | None = None, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path.

    Maps have no fixed keys, so `map_keys` names, per flattened path, the keys to take; a map
    not named there stays a map. The walk is over the schema, no data is read.
    """
    map_keys = map_keys or {}
    out: list[Column] = []

    def walk(value: Column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                walk(value.getField(field.name), field.dataType, f"{name}{sep}{field.name}")
        elif isinstance(kind, T.MapType) and name in map_keys:
            out.extend(value[k].alias(f"{name}{sep}{k}") for k in map_keys[name])
        else:
            out.append(value.alias(name))

    for field in df.schema.fields:
        walk(column(field.name), field.dataType, field.name)
    return df.select(*out)


def template_view(flat: DataFrame, dataset_name: str = "dataset_name") -> DataFrame:
    """The 86-column row: known columns kept, others dropped, missing values 0."""
    present = {}
    for c in flat.columns:
        label = c.removeprefix(_DEPENDENCIES)
        present[c if label == c else f"dependency_{label}"] = c
    name = f"cast(`{dataset_name}` as string)" if dataset_name in flat.columns else "null"
    cols = [f"coalesce({name}, '{UNNAMED}') as dataset_name"]
    for field in feature_schema().fields[1:]:
        kind = field.dataType.simpleString()
        value = f"`{present[field.name]}`" if field.name in present else "null"
        cols.append(f"coalesce(cast({value} as {kind}), cast(0 as {kind})) as `{field.name}`")
    return flat.selectExpr(*cols)


def _divide(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    if by not in df.columns:
        return df
    here = [c for c in columns if c in df.columns]
    ratios = {c: F.expr(f"cast(try_divide(`{c}`, `{by}`) as double)") for c in here}
    return df.withColumns(ratios) if here else df


def normalize_by_sentences(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The given columns (the dependency columns) per sentence; NULL where there are no sentences."""
    return _divide(df, BY_SENTENCES if columns is None else columns, N_SENTS)


def normalize_by_words(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The given columns (entities, parts of speech, counts) per word; NULL where there are no words."""
    return _divide(df, BY_WORDS if columns is None else columns, N_WORDS)


def normalize(
    df: DataFrame, by_sentences: list[str] | None = None, by_words: list[str] | None = None
) -> DataFrame:
    """Both, each over the library's columns or over a list of the caller's. Columns that `df` lacks are skipped."""
    own = {
        N_SENTS: [c for c in (BY_SENTENCES if by_sentences is None else by_sentences) if c in df.columns],
        N_WORDS: [c for c in (BY_WORDS if by_words is None else by_words) if c in df.columns],
    }
    twice = set(own[N_SENTS]) & set(own[N_WORDS])
    if twice:
        raise ValueError(f"columns in both lists: {sorted(twice)}")
    ratios = {
        c: F.expr(f"cast(try_divide(`{c}`, `{by}`) as double)")
        for by, columns in own.items()
        if by in df.columns
        for c in columns
    }
    # all from the same row: a column that is divided still divides others by its old value
    return df.withColumns(ratios) if ratios else df


def read_column_list(spark: SparkSession, path: str) -> list[str]:
    """A JSON array of column names, as kept beside a feature table. One small file, read by the driver."""
    try:
        text = spark.read.text(path, wholetext=True)
        parsed = text.select(F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("names")).first()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "FAILED_READ_FILE.FILE_NOT_EXIST"):
            raise FileNotFoundError(path) from error
        raise
    if parsed is None or parsed.names is None or None in parsed.names:
        raise ValueError(f"{path} holds no list of column names")
    return list(parsed.names)


def normalization_columns(
    spark: SparkSession, by_sentences: list[str] | None = None, by_words: list[str] | None = None
) -> DataFrame:
    """`(column, denominator)`: which column is divided by what."""
    rows = [(c, N_SENTS) for c in (BY_SENTENCES if by_sentences is None else by_sentences)]
    rows += [(c, N_WORDS) for c in (BY_WORDS if by_words is None else by_words)]
    return spark.createDataFrame(rows, "column string, denominator string")
