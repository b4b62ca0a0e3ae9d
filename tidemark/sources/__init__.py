"""Sources and sinks: driver tables, raw CSV drops, JSON event feeds, Parquet sinks."""
