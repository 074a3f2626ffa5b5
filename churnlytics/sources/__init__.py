"""Sources, sinks and input checks."""

from churnlytics.sources.files import (lenient_contracts, normalize_columns, publish_tables, published_tables,
                                       read_csv, read_jdbc, read_parquet, write_csv, write_parquet, write_tables)
from churnlytics.sources.rejects import clean_contracts, read_csv_with_rejects, reject_counts, rejects
from churnlytics.sources.testdata import contracts_from_testdata, raw_contracts_from_testdata


def require_columns(df, required) -> None:
    """Raise ``ValueError`` listing every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


__all__ = ["contracts_from_testdata", "raw_contracts_from_testdata", "require_columns",
           "normalize_columns", "read_csv", "read_jdbc", "read_parquet", "write_csv",
           "write_parquet", "write_tables", "lenient_contracts", "publish_tables", "published_tables",
           "clean_contracts", "read_csv_with_rejects", "reject_counts", "rejects"]
