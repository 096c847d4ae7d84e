"""codeloom: a PySpark analytics engine for code knowledge graphs.

Symbols, modules and named events are rows of a nodes DataFrame, their typed
relations rows of an edges DataFrame; every operator takes and returns
DataFrames.
"""
