"""Positioned text to relational tables on Spark: regions, rows, columns, headers, merging, workbooks."""
