"""Benchmark decontamination as a prefix-filtered set join, in DataFrame
operations only.

A benchmark item is cut into windows of 13 words, a window into shingles of 4
words.  Documents keep only their shingles that occur in the benchmark (hits).
Containment must be complete, so one prefix token per window is enough: its
rarest shingle by hits.  A hit of a prefix token proposes a start position;
position and length bounds drop impossible ones, and a start stands only if
the document has the window's shingles at every needed offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import ascii_lower, let, written

NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 4
BROADCAST_ROWS = 1_000_000  # of at most ~40 bytes: 40 MB


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a written table if its counted rows stay under the bound;
    beyond it the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingles(hashes: Column, s: int) -> Column:
    """Array of the hashes of every s consecutive words."""
    one = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(F.lit(s), *[F.get(h, i + j) for j in range(s)]))
    return let(hashes, lambda h: F.when(F.size(h) >= s, one(h)).otherwise(F.array().cast("array<bigint>")))


def benchmark_windows(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(wid, wlen, s, shingles, item_id)``: one row per window of an item."""
    b = (bench.select(F.col(item_col).alias("item_id"), F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))
         .where("size(h) > 0").withColumn("wlen", F.least(F.lit(WINDOW), F.size("h"))))
    b = b.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("wlen"))))
    b = b.withColumn("h", F.slice("h", F.col("start") + 1, F.col("wlen"))).withColumn("s", F.least(F.lit(SHINGLE), "wlen"))
    sh = F.array().cast("array<bigint>")
    for s in range(1, SHINGLE + 1):
        sh = F.when(F.col("s") == s, _shingles(F.col("h"), s)).otherwise(sh)
    return b.select(F.xxhash64("wlen", "h").alias("wid"), "wlen", "s", sh.alias("shingles"), "item_id")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, text_hash``.

    Null or empty text has no words and is clean.  Items without words have no
    window; items that repeat under one id count once, a null item id marks
    words but counts as no item.  Rows that share an id but not a text are
    judged apart (``text_hash``).  Empty tables give an empty or an all-clean
    result.  Other columns are not read."""
    win = written(benchmark_windows(bench, item_col, bench_text_col), "windows")
    shapes = win.select("wid", "wlen", "s", "shingles").dropDuplicates(["wid"])
    tokens = written(shapes.select("wid", "wlen", "s", F.posexplode("shingles").alias("off", "sh")), "tokens")
    vocabulary = _bounded(written(tokens.select("sh").distinct(), "vocabulary"))
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       F.transform(words(text), lambda w: F.xxhash64(w)).alias("h"))
    lengths = sorted(r[0] for r in win.select("s").distinct().collect())  # at most SHINGLE values
    arrays = [_shingles(F.col("h"), s) for s in lengths] or [F.array().cast("array<bigint>")]
    sized = base.select("doc_id", "text_hash", F.size("h").alias("n_words"), F.array(*arrays).alias("all"))
    flat = sized.select("doc_id", "text_hash", "n_words", F.explode("all").alias("one")).select(
        "doc_id", "text_hash", "n_words", F.posexplode("one").alias("pos", "sh"))
    hits = written(flat.join(vocabulary, "sh"), "hits")
    rarity = hits.groupBy("sh").agg(F.count("*").alias("n"))
    # windows with a shingle that no document has cannot occur
    prefix = (tokens.join(rarity, "sh", "left").groupBy("wid", "wlen")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "sh")).alias("p")).where("p.n > 0")
              .select("wid", "wlen", "p.off", "p.sh"))
    prefix = _bounded(written(prefix, "prefix"))
    starts = (hits.join(prefix, "sh").withColumn("start", F.col("pos") - F.col("off"))
              .where("start >= 0 and start + wlen <= n_words")
              .select("doc_id", "text_hash", "start", "wid", "wlen").distinct())
    # shingles side by side cover the window; the last one is flush with its end
    need = tokens.where((F.col("off") % F.col("s") == 0) | (F.col("off") == F.col("wlen") - F.col("s")))
    need = need.withColumn("needed", F.floor((F.col("wlen") - F.col("s")) / F.col("s")) + 1
                           + ((F.col("wlen") - F.col("s")) % F.col("s") > 0).cast("int"))
    need = _bounded(written(need.select("wid", "off", "sh", "needed"), "needed"))
    asked = starts.join(need, "wid").withColumn("pos", F.col("start") + F.col("off")).drop("off").alias("a")
    have = hits.select("doc_id", "text_hash", "pos", "sh").distinct().alias("b")
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))] + [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("text_hash", "pos", "sh")]
    found = (asked.join(have, same).select("a.*").groupBy("doc_id", "text_hash", "start", "wid", "wlen", "needed")
             .agg(F.count("*").alias("n")).where("n = needed"))
    found = written(found.select("doc_id", "text_hash", "start", "wid", "wlen"), "found")
    hit = (found.select("doc_id", "text_hash", F.explode(F.expr("sequence(start, start + wlen - 1)")).alias("pos")).distinct()
           .groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit")))
    items = _bounded(written(win.where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("item")).distinct(), "items"))
    named = (found.select("doc_id", "text_hash", "wid").distinct().join(items, "wid").groupBy("doc_id", "text_hash")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))
    out = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                      F.size(words(text)).cast("long").alias("n_words")).alias("d")
    for name, side in (("hit", hit), ("named", named)):
        out = out.join(side.alias(name), F.col("d.doc_id").eqNullSafe(F.col(f"{name}.doc_id"))
                       & (F.col("d.text_hash") == F.col(f"{name}.text_hash")), "left")
    n_hit = F.coalesce(F.col("hit.n_hit"), F.lit(0))
    items = F.coalesce(F.col("named.items"), F.array().cast("array<string>"))
    return out.select("d.doc_id", "d.n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                      ((n_hit > 0) & (n_hit * 20 >= F.col("d.n_words"))).alias("contaminated"), "d.text_hash")
