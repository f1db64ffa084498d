"""lamina: layered change-log analytics on Spark DataFrames."""
