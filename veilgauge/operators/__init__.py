"""Table operators. Each takes and returns DataFrames and accepts ``keys`` to process many tables in one job."""
