"""Exploration-data analytics on Spark: DataFrame in, DataFrame out.

``operators`` holds joins, aggregates, windows, grids, resource and magnetic
models; ``sources`` readers and writers; ``functions`` Column expressions;
``plans`` the registered queries with their SQL twins; ``streaming`` the
Structured Streaming operators.
"""
