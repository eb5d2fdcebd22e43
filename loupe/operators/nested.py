"""Nested span records (NST2): one sorted list of {start, end, label} per
document.  A document's spans are bounded by the document, so collecting
them per document keeps each group small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans_from_pieces(df: DataFrame, doc: str, order: str, text: str, label: str,
                      sep_len: int = 1) -> DataFrame:
    """Lay the pieces of each document end to end (``sep_len`` characters
    between them) and return (doc, order, piece_no, start, end, label) rows
    (``piece_no`` is the 1-based position in the document).

    Offsets come from a distributed running sum (ranges of the order within
    each document), so one very long document is not sorted in a single task."""
    from loupe.operators.series import cumulative_sum
    x = df.select(doc, order, F.length(text).alias("_len"), F.col(label).alias("label"))
    x = x.withColumn("_w", F.col("_len") + sep_len).withColumn("_one", F.lit(1))
    x = cumulative_sum(x, order, ["_w", "_one"], keys=doc, out=["_cum", "piece_no"])
    start = (F.col("_cum") - F.col("_w")).cast("long")
    return x.select(doc, order, "piece_no", start.alias("start"), (start + F.col("_len")).alias("end"), "label")


def nest_spans(df: DataFrame, doc: str, order: str, text: str, label: str) -> DataFrame:
    """(doc, spans: array<struct<start, end, label>>) sorted by start.  Only
    for documents of bounded size: the nested list of a document is one
    value.  ``spans_from_pieces`` is the flat, unbounded-safe form."""
    s = spans_from_pieces(df, doc, order, text, label)
    return s.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))


def attach_spans(texts: DataFrame, spans: DataFrame, doc: str) -> DataFrame:
    """Text joined with its nested annotations; texts without spans keep an
    empty list."""
    j = texts.join(spans, doc, "left")
    return j.withColumn("spans", F.coalesce(F.col("spans"), F.array().cast(spans.schema["spans"].dataType)))
