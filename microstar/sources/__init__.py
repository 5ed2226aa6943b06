"""Readers and writers: delimited positional text, star CSVs, parquet layers."""
