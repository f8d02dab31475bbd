"""What a plan does to DataFrames: lookups, aggregates over the many side, outputs."""
