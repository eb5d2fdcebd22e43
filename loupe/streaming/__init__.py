"""Structured Streaming forms of two batch operators (weekly windowed mean,
value counts) over an append-only event source."""
