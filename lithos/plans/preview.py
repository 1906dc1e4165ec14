"""CSV preview (SRC-2 + SRC-1 + AGG-6 + LIM-1): the file-inspection flow as one call.

Returns a dict of small DataFrames, or an error status when the file is missing or does not
parse. The profile aggregates the whole file; the sample is its head.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithos.operators.position import SPLIT
from lithos.operators.profile import column_profile, table_shape
from lithos.sources.csv_scan import apply_ladder, check_csv, scan_text, source_status


def preview_csv(spark: SparkSession, path: str, max_rows: int = 10, multi_line: bool = False) -> dict[str, DataFrame | str]:
    status = source_status(spark, path)
    if status.status != "ok":
        return {"status": "file_missing", "error": status.error or f"File not found: {path}"}
    try:
        scan = scan_text(spark, path, multi_line)
        check_csv(scan, path)
        types = scan.types()
        data = apply_ladder(scan.rows.drop(*SPLIT), types)
        # the first rows in file order, kept by every task and merged
        sample = apply_ladder(scan.rows.orderBy(*SPLIT).limit(max_rows).drop(*SPLIT), types)
    except Exception as e:  # noqa: BLE001 - reported as a status, as the file tools do
        return {"status": "parse_error", "error": str(e)}
    return {
        "status": "ok",
        "shape": table_shape(data),
        "columns": column_profile(data),
        "sample": sample,
    }
