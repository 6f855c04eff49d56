"""Queries over the driver's tables: each module has QUERIES, name -> (function of (spark, sf_dir), DuckDB SQL or None)."""
