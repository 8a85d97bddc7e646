"""vaultlens: metadata queries, sector deduplication and integrity checks on Spark DataFrames."""
