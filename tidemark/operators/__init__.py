"""Operators on DataFrames: versions, time, ranking, packing, search, graph, facts."""
