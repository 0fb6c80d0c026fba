"""Reading and writing flow tables and fitted state."""

from flowlens.sources.flows import (
    load_split,
    read_processed_csv,
    read_raw,
    read_raw_pair,
    with_row_id,
    write_csv,
    write_processed,
)
from flowlens.sources.state import Registry, load_table, save_table, shared, spread

__all__ = [
    "Registry", "load_split", "load_table", "read_processed_csv", "read_raw", "read_raw_pair",
    "save_table", "shared", "spread", "with_row_id", "write_csv", "write_processed",
]
