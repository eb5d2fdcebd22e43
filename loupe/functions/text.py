"""Text and list-valued column expressions (TXT*, ARR1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English stop words removed before word frequencies.
STOP_WORDS = sorted(set("""
a about above after again against all also am an and any are aren't as at be because been before being
below between both but by can can't cannot com could couldn't did didn't do does doesn't doing don't down
during each else ever few for from further get had hadn't has hasn't have haven't having he he'd he'll he's
hence her here here's hers herself him himself his how how's however http i i'd i'll i'm i've if in into is
isn't it it's its itself just k like me more most mustn't my myself no nor not of off on once only or other
otherwise ought our ours ourselves out over own r same shall shan't she she'd she'll she's should shouldn't
since so some such than that that's the their theirs them themselves then there there's therefore these they
they'd they'll they're they've this those through to too under until up very was wasn't we we'd we'll we're
we've were weren't what what's when when's where where's which while who who's whom why why's with won't
would wouldn't www you you'd you'll you're you've your yours yourself yourselves
""".split()))

# Word pattern: a letter/digit/underscore followed by at least one more of
# those or an apostrophe (the "\w[\w']+" rule, widened to all scripts).
WORD_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def first_token(col, sep: str = " ") -> Column:
    """``x.split(sep)[0]``."""
    return F.split_part(_c(col), F.lit(sep), F.lit(1))


def word_count(col) -> Column:
    """``len(x.split())``: whitespace runs, ends ignored, empty text = 0."""
    return F.size(F.filter(F.split(_c(col), r"(?U)\s+"), lambda x: x != ""))


def normalize_list_separators(col, sep: str = ",") -> Column:
    """' ,' and ', ' -> ','."""
    c = F.replace(_c(col), F.lit(" " + sep), F.lit(sep))
    return F.replace(c, F.lit(sep + " "), F.lit(sep))


def split_list(col, sep: str = ",") -> Column:
    """Multi-valued text -> array of members."""
    return F.split(normalize_list_separators(col, sep), sep)


def tokens(col, pattern: str = WORD_PATTERN) -> Column:
    """Lower-cased words of a text as an array."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(pattern), 0)


def significant(col, digits: int = 3) -> Column:
    """A number with that many significant digits, trailing zeros cut off
    (general format): 12.3456 -> 12.3, 0.00012345 -> 0.000123, 1234567 ->
    1.23e+06.  Exponents below -4, or of ``digits`` and more, are written out."""
    x = _c(col).cast("double")
    # the exponent as the rounded number has it
    sci = F.format_string(f"%.{digits - 1}e", x)
    power = F.regexp_extract(sci, r"e([+-]\d+)$", 1).try_cast("int")
    trim = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    plain = F.lit(None).cast("string")
    for p in range(-4, digits):
        plain = F.when(power == p, trim(F.format_string(f"%.{digits - 1 - p}f", x))).otherwise(plain)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    written = F.concat(trim(F.regexp_extract(sci, r"^(.*)e", 1)), F.regexp_extract(sci, r"(e.*)$", 1))
    return F.when(x.isNotNull(), F.coalesce(odd, plain, written))


def parse_duration(col) -> tuple[Column, Column]:
    """'90 min' -> (90, 0); '3 Seasons' -> (0, 3): the number is the first
    token; which output receives it depends on 'min' being in the text."""
    c = _c(col)
    n = first_token(c).try_cast("long")
    is_min = c.contains("min")
    return (F.when(is_min, n).otherwise(F.lit(0)).alias("minutes"),
            F.when(is_min, F.lit(0)).otherwise(n).alias("seasons"))


def multi_hot(df: DataFrame, list_col: str, classes: list[str], prefix: str = "") -> DataFrame:
    """List column -> one 0/1 column per class (classes given, sorted)."""
    return df.select("*", *[F.array_contains(F.col(list_col), c).cast("int").alias(prefix + c)
                            for c in classes])


def stop_words_df(spark, words=None) -> DataFrame:
    """Stop words as a one-column table (fixed size -> broadcast)."""
    return F.broadcast(spark.createDataFrame([(w,) for w in (words or STOP_WORDS)], "word string"))
