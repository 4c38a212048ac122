"""keelstone: a key-value analytics engine expressed as Spark DataFrames over a mutation log."""
