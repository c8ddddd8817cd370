from lexigauge.sources.csv_text import CsvText, read_csv_by_name, read_csv_text
from lexigauge.sources.tables import (
    append_features,
    read_features,
    read_table,
    spread,
    union_features,
    write_normalized,
)

__all__ = [
    "CsvText",
    "append_features",
    "read_csv_by_name",
    "read_csv_text",
    "read_features",
    "read_table",
    "spread",
    "union_features",
    "write_normalized",
]
