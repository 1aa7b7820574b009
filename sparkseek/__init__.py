"""A PySpark-native search and retrieval engine over pinned Parquet snapshots."""
