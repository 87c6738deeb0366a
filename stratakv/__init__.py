"""Multi-version key-value change logs on Spark: SST files as a data source, merge and compaction as DataFrame plans."""
