"""Column-expression helpers (text, dates, math).  All return ``Column``
objects built from Spark built-ins, so they run inside whole-stage codegen."""
