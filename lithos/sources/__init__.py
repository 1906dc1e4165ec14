"""Scans: typed CSV, file listings, the driver's parquet tables."""

from lithos.sources.csv_scan import SourceStatus, read_typed_csv, source_status
from lithos.sources.files import list_files
from lithos.sources.tables import TABLES, read_table

__all__ = ["TABLES", "SourceStatus", "list_files", "read_table", "read_typed_csv", "source_status"]
