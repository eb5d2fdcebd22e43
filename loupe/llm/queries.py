"""The ``opN_`` queries: thin digests of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.llm import (chat_windows, decontam_join, iblt, importance_draw, markov_secrets, minhash_odd, mix_budget, ordered_jaccard,
                       quality_rff, spectral_whitening, suffix_dedup, toxicity_grammar, warc_cas)
from loupe.llm.common import read


def op1_minhash_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_odd.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")


def op2_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.versions(read(spark, sf_dir, "documents"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = markov_secrets.find_secrets(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind_no"] < 3)
    return s.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
                    F.sha2(markov_secrets.span_string(base), 256).alias("base_sha256"),
                    markov_secrets.span_string(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_grammar.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")


def op7_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_budget.mix_to_weights(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "taken")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_join.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(own).alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(own).alias("text")))).alias("t")).select("conv_id", "t.*")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_windows.read_back(chat_windows.format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.col("formatted_chars").cast("long").alias("formatted_chars"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_cas.archive_pages(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spectral_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral_whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_draw.importance_draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ordered_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered_jaccard.jaccard_join(read(spark, sf_dir, "documents")).drop("text_hash")


WORDS8 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS8}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS8}') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND array_to_string(dw.w[dw.i + 1 : dw.i + dw.k], ' ') = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN keeper IS NULL OR keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h"""

OP12_SQL = rf"""
WITH steps AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM steps),
d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS8}'), lambda x: x <> '') AS w, row_number() OVER () AS rn FROM documents),
dw AS (SELECT rn, w, count(*) AS n FROM (SELECT rn, unnest(w) AS w FROM d) GROUP BY rn, w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS8}')) AS w FROM benchmark) GROUP BY w),
dist AS (SELECT w FROM dw UNION SELECT w FROM bw),
crc AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(w), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket FROM dist, tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN crc USING (w) GROUP BY bucket),
tot AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s_all, (SELECT coalesce(sum(n), 0) FROM t) AS t_all),
gain AS (SELECT k.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
         FROM (SELECT DISTINCT bucket FROM crc) k LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), tot),
wt AS (SELECT rn, sum(n * g) AS total, sum(n) AS n FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY rn),
sc AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT), 0) AS weight,
       CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN wt USING (rn)),
full_score AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM sc),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, 10 * count(*) OVER () // 100 AS take FROM full_score WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= take THEN r END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM full_score WHERE n_features < 20"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_odd, op2_iblt_fingerprints, op3_suffix_repeats, op4_quality, op5_markov_secrets, op6_toxicity, op7_budget_mix, op8_decontaminate, op9_chat_windows, op10_warc_archive,
    op11_spectral_whitening, op12_importance_draw, op13_ordered_jaccard)}

ORACLES: dict[str, str] = {"op8_decontaminate": OP8_SQL, "op10_warc_archive": OP10_SQL, "op12_importance_draw": OP12_SQL}
