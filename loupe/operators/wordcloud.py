"""Word-cloud table: words and two-word collocations of all texts with their
counts, without stop words, numbers, plural and possessive doubles.

Texts are cut into (word, next word) rows once; those are counted with a
map-side combine, and everything after works on the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions import text as T
from loupe.session import stored

THRESHOLD = 30.0  # least likelihood ratio of a collocation
TINY = 1e-10  # shares in logarithms are this at least


def cloud_words(col) -> Column:
    """Lower-cased words of a text in order: a possessive ``'s`` is cut off,
    numbers are left out."""
    bare = F.transform(T.tokens(col), lambda w: F.when(w.endswith("'s"), w.substr(F.lit(1), F.length(w) - 2)).otherwise(w))
    letter = lambda w: (w >= "a") & (w < "{")  # noqa: E731 - most words start so, and no number
    return F.filter(bare, lambda w: letter(w) | (w != "") & ~w.rlike(r"^\p{Nd}+$"))


def _stem(word: str) -> Column:
    """The form that a word and its plural in -s (not -ss) share; at most
    these two have it."""
    w = F.col(word)
    return F.when(w.endswith("s") & ~w.endswith("ss") & (F.length(w) > 1), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)


def _log_likelihood(k: Column, n: Column, x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(TINY))) * k + F.log(F.greatest(1 - x, F.lit(TINY))) * (n - k)


def likelihood_ratio(both: Column, first: Column, second: Column, total: Column) -> Column:
    """How much better a pair is explained by dependence of its words than by
    chance; 0 where one word is all there is."""
    both, first, second, total = (c.cast("double") for c in (both, first, second, total))
    p, p1, p2 = second / total, both / first, (second - both) / (total - first)
    apart = _log_likelihood(both, first, p) + _log_likelihood(second - both, total - first, p)
    joined = _log_likelihood(both, first, p1) + _log_likelihood(second - both, total - first, p2)
    return F.when((total <= first) | (total <= second), 0.0).otherwise(-2 * (apart - joined))


def word_cloud(docs: DataFrame, text: str, top: int = 5000, stop_words=None, threshold: float = THRESHOLD) -> DataFrame:
    """``word, count`` of the ``top`` words and collocations.

    Words next to each other in one text are a collocation if neither is a
    stop word and their likelihood ratio is above ``threshold``; its count is
    taken off both words, and words left without any are gone.  Plurals in -s
    are counted with their singular where that occurs, also in collocations
    (the second word's).  Ties in count are ordered by word.  Null and empty
    texts have no words."""
    stop = [w[:-2] if w.endswith("'s") else w for w in (T.STOP_WORDS if stop_words is None else stop_words)]
    stop = sorted({*stop, *(T.STOP_WORDS if stop_words is None else stop_words)})
    w = docs.select(cloud_words(text).alias("w"))
    after = F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get(F.col("w"), i + 1).alias("b")))
    pairs = w.select(F.explode(after).alias("p")).where(~F.col("p.a").isin(stop)).select(
        "p.a", F.when(~F.col("p.b").isin(stop), F.col("p.b")).alias("b"))
    # counted by the second word's stem: the singular stands for both where it occurs
    pairs = pairs.withColumn("stem", _stem("b")).groupBy("a", "stem").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("b") == F.col("stem"), 1)).alias("singular"))
    plural = F.concat("stem", F.lit("s"))
    pairs = stored(pairs.select("a", F.when(F.col("singular") > 0, F.col("stem")).otherwise(plural).alias("b"), "n"), "word-pairs")
    words = pairs.groupBy("a").agg(F.sum("n").alias("n")).withColumn("stem", _stem("a")).groupBy("stem").agg(
        F.sum("n").alias("n"), *[F.count(F.when((F.col("a") == F.col("stem")) == x, 1)).alias(c) for x, c in ((True, "singular"), (False, "plural"))])
    words = words.select("n", "stem", F.when(F.col("singular") > 0, F.col("stem")).otherwise(plural).alias("base"), "singular", "plural")
    words = stored(words, "words")
    counts = words.select("base", "n")
    total = F.lit(counts.agg(F.sum("n")).first()[0] or 0)
    forms = F.array_compact(F.array(F.when(F.col("singular") > 0, F.col("stem")), F.when(F.col("plural") > 0, plural)))
    form = lambda x: words.select(F.explode(forms).alias(x), F.col("base").alias(f"{x}_form"), F.col("n").alias(f"n_{x}")).hint("shuffle_hash")  # noqa: E731 - a share of the words is small, the pairs need no sort
    two = pairs.where("b is not null").join(form("a"), "a").join(form("b"), "b").withColumn("base", F.concat_ws(" ", "a", "b"))
    two = stored(two.where(likelihood_ratio(F.col("n"), F.col("n_a"), F.col("n_b"), total) > threshold).select("base", "a_form", "b_form", "n"), "collocations")
    gone = two.select("n", F.explode(F.array("a_form", "b_form")).alias("base")).groupBy("base").agg(F.sum("n").alias("gone"))
    left = counts.join(gone, "base", "left").select("base", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0")
    out = left.unionByName(two.select("base", "n")).select(F.col("base").alias("word"), F.col("n").cast("long").alias("count"))
    return out.orderBy(F.col("count").desc(), "word").limit(top)
