"""Named queries: each binds an operator chain to the test tables and
carries the independent DuckDB statement that checks it."""
