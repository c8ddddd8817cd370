"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that Java and DuckDB lower-case as A-Z are.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small: a batch of long texts must fit beside the others in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows in the queries that run within; the session's own setting after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts without other characters take the fast way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def normal_words(text: Column) -> Column:
    """' word word ... ': A-Z lower-cased, every other ASCII character but letters and digits a cut."""
    words = F.regexp_replace(ascii_lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def let(value: Column, then) -> Column:
    """`then(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def constant_longs(rows: list, size: int) -> Column:
    """An array of `size` longs as a constant, 0 where no row (at, word) gives one.

    For tables of fixed size that lambdas look things up in: they can't hold a subquery, and a column
    would be copied into every row.
    """
    words = dict(rows)
    return F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(size))), ",").cast("array<bigint>")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def carried(docs: DataFrame, own: set[str], made: tuple[str, ...], operate) -> DataFrame:
    """`operate(docs)` with every column but `own` under a name that no operator uses, and back under its own after it.

    made: the columns that the result adds; those of `docs` with such a name are replaced.
    """
    others = [c for c in docs.columns if c not in own and c not in made]
    safe = {c: f"carried {i}" for i, c in enumerate(others)}
    kept = docs.drop(*[c for c in made if c not in own])
    out = operate(kept.withColumnsRenamed(safe))
    return out.withColumnsRenamed({new: c for c, new in safe.items()})


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of `df` with fields at its end, in place of any of the same name."""
    names = {n for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in fields)])


def arrow_rows(batch, schema, **columns):
    """An Arrow batch with the columns of `schema`: those given, the others from `batch`."""
    import pyarrow as pa

    arrays = [pa.array(columns[n], type=t) if n in columns else batch.column(batch.schema.get_field_index(n)) for n, t in schema]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in schema])


def arrow_schema(schema: T.StructType):
    """(name, Arrow type) of each field."""
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]
