"""Importance resampling towards a target distribution, with Arrow kernels.

Words of a batch become dictionary codes (``ascii_lower``,
``split_pattern_regex``, ``list_flatten``, ``dictionary_encode``); n-grams are
pairs of a shorter gram's code and the code that follows, found by shifting
the index array; a CRC is taken of distinct grams only and spread with
``take``.  The corpus and the target are counted per bucket, the log ratio of
the two is a bucket's gain, and gains are summed over each document's segment.
A seeded Gumbel key turns the weights into a draw without replacement."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import written

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SLICE_BYTES = 4 << 20  # of text encoded together
SEED = 2024


def gram_buckets(texts: pa.Array, n_max: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and all its grams of 1 to ``n_max`` words as
    ``(text, bucket)``, in order of the texts.  Null texts have none."""
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), NON_WORD)
    flat = pc.list_flatten(parts)
    own = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "")
    own = own[full.to_numpy(zero_copy_only=False)]
    coded = pc.dictionary_encode(flat.filter(full))
    words, code = [w.encode() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64)
    n_words = np.bincount(own, minlength=len(texts))
    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    who, found, gram, at = [own], [_take(crc % buckets, code)], code, own
    for n in range(2, n_max + 1):
        # a gram starts where its text goes on for n words
        go = at[:-1] == own[n - 1:] if len(at) > 1 else np.zeros(0, bool)
        pairs = np.stack([gram[:-1], code[n - 1:]])[:, go] if len(at) > 1 else np.zeros((2, 0), np.int64)
        distinct, gram_of = np.unique(pairs, axis=1, return_inverse=True)
        crc = np.fromiter((zlib.crc32(b" " + words[w], int(crc[g])) for g, w in distinct.T), np.int64, distinct.shape[1])
        who.append(at[:-1][go])
        found.append(_take(crc % buckets, gram_of.reshape(-1)))
        keep = np.full(len(at) - 1 if len(at) > 1 else 0, -1, np.int64)  # places stay, so that codes can shift again
        keep[go] = gram_of.reshape(-1)
        gram, at = keep, at[:-1]
    who, found = np.concatenate(who), np.concatenate(found)
    order = np.argsort(who, kind="stable")
    return n_words, who[order], found[order]


def _take(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    return pc.take(pa.array(values), pa.array(index)).to_numpy()


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield b.slice(at, end - at)
        at = end


def _counted(n_max: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in _slices(b):
                total += np.bincount(gram_buckets(part.column("text"), n_max, buckets)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text_col: str, n_max: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs; ``buckets`` numbers reach the driver."""
    x = texts.select(F.col(text_col).alias("text")).mapInArrow(_counted(n_max, buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in x.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the source share)."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(n_max: int, gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                n_words, who, bucket = gram_buckets(part.column("text"), n_max, len(gains))
                n = np.bincount(who, minlength=part.num_rows)
                run_sum = np.concatenate([[0], np.cumsum(_take(gains, bucket))])
                end = np.cumsum(n)
                total = run_sum[end] - run_sum[end - n]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["doc_id", "text_hash", "n_words", "n_features", "weight"])
    return run


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """``rank`` 1, 2, 3, ... in the given order, without gathering the rows:
    a range partitioning sorts them, and each partition's rows follow those
    before it."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    x = df.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    # written with its partition and place, so that both stay
    x = written(x.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    rows = sorted(x.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, start = {}, 0
    for part, n in rows:
        before[part] = start
        start += n
    offsets = x.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    return x.join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def importance_draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
                    n_max: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_words, n_features, weight,
    score, rank``; ``rank`` is null for documents that are not drawn.

    Features are all runs of 1 to ``n_max`` words (A-Z lower-cased), repeats
    counted.  Of the documents with ``least_words`` words or more, the floor of
    ``percent`` per cent with the highest scores are drawn, ties to the smaller
    id, then the smaller text hash; a null id comes last and is hashed as an
    empty string.  Null and empty texts have no features, weight 0 and are not
    drawn.  Repeated rows are scored alike and each has its own rank.  An empty
    target gives gains of the source alone, an empty table an empty result.
    Other columns are not read.  Texts are encoded in slices of bounded size,
    a very long one alone."""
    if n_max < 1 or buckets < 1:
        raise ValueError("n_max and buckets are 1 at least")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    gains = log_gains(bucket_counts(d, "text", n_max, buckets), bucket_counts(target, target_text_col, n_max, buckets))
    kind = dict(d.dtypes)["doc_id"]
    w = d.mapInArrow(_weighed(n_max, gains), f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    w = written(w.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))), "importance")
    able = w.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    out = ranked(able, "importance-ranked", *order)
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return out.unionByName(w.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
