"""Registered queries: each maps (spark, sf_dir) to a DataFrame, with its DuckDB twin where SQL can say it."""
