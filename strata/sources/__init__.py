"""Sources and sinks: the store on Parquet, log framing and table files."""
