"""Operators on DataFrames: joins, sets, statistics, segments, signals, rendering, quantisation, evaluation."""
