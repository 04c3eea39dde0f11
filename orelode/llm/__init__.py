"""Training-data operators: secrets, duplicates, mixing, archives, packing,
quality, token counts and toxicity.

Every operator takes and returns DataFrames. ``queries`` maps the registered
query names to functions of (spark, sf_dir); ``oracle_sql`` holds the DuckDB
twin of those that SQL can express. Nothing outside this package imports it.
"""
