"""Readers and writers: parquet test tables, CSV, file listings, whole-text files, HTML."""
