"""Record, table and time-series operators over DataFrames."""
