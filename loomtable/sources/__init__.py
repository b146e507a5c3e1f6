"""Readers: text, delimited, quarantined CSV, Parquet and in-memory tables."""

from .delimited import (  # noqa: F401
    drop_header,
    parse_lines,
    read_delimited,
    read_exported,
    read_inferred,
    read_lines,
    read_quarantined,
    read_raw,
    read_with_ids,
)
from .local import from_pandas, from_rows, number_range, register_view  # noqa: F401
