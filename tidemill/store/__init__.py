"""The versioned table store: manifests over Parquet files, branches, transactions."""
