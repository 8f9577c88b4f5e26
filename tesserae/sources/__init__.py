"""Sources and sinks: the block layout on Parquet."""
