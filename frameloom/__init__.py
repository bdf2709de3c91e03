"""Feature-store dataflow and training-data operators on Spark DataFrames."""
