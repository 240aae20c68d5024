"""A small table warehouse: a JSON catalog over Parquet snapshots, saved views, image tables."""
