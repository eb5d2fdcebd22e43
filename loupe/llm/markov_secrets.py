"""Secret scan in DataFrame operations only: fixed base patterns, and two
character Markov models (random strings, ordinary identifiers) whose
log-likelihood ratio adds spans the patterns miss.

The labelled samples are the corpus' own: values of the base matches are
random strings, other long identifiers are ordinary.  Their character pairs
are counted over all documents; a table of 128 x 128 pair scores is the whole
model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loupe.llm.common import let, written

# The base patterns and the least length of what they must match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a maximal run of 16 or more
KINDS = ("assign", "access", "hex", "markov")
SHORTEST = 12  # of a Markov span, as of an assigned value
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{11,}"
SYMBOLS = 66  # letters, digits, + / _ =


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern, and the lengths of the text before each."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    both = lambda m: F.when(F.size(m) > 0, F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda x, g: F.struct(x.alias("m"), g.alias("gap"))))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), both)


def _values(text: Column) -> Column:
    """Values of the base matches."""
    assign = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
    access = F.filter(F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), lambda v: F.length(v) >= 18)
    return F.concat(assign, access, F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))


def _pair(t: Column, i: Column) -> Column:
    return F.ascii(F.substring(t, i, 1)) * 128 + F.ascii(F.substring(t, i + 1, 1))


def _segments(run: Column, table: Column, min_ratio: float) -> Column:
    """``start, end`` of the parts of a run whose log-likelihood ratio is at
    least ``min_ratio``: a part begins where the sum before it is not positive
    and ends at its largest sum, before a fall by ``min_ratio``.  Both ends are
    moved to the next separator, so that no letter of a token is left over.
    Pairs with a character that identifiers never hold count nothing: the
    ordinary model has no samples of them."""
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    letter = lambda c: c.between(48, 57) | c.between(65, 90) | c.between(97, 122)

    def over(codes: Column) -> Column:
        done = lambda a: F.when(a["best"] >= min_ratio, F.concat(a["out"], F.array(span(a["from"], a["to"])))).otherwise(a["out"])

        def step(a: Column, i: Column) -> Column:  # the pair of characters i and i + 1, from 0
            token = F.when(letter(F.get(codes, i)), a["token"]).otherwise(i + 1)
            known = lambda c: letter(c) | (c == 95)
            ratio = F.when(known(F.get(codes, i)) & known(F.get(codes, i + 1)), F.get(table, F.get(codes, i) * 128 + F.get(codes, i + 1)))
            now = a["now"] + F.coalesce(ratio, F.lit(0.0))
            state = lambda *x: F.struct(*[v.alias(k) for k, v in zip(("now", "token", "from", "best", "to", "out"), x)])

            def after(x: Column) -> Column:
                up, fell = x["now"] > a["best"], (x["now"] <= 0) | (x["now"] <= a["best"] - min_ratio)
                begin = F.when(letter(F.get(codes, i + 1)), x["token"]).otherwise(i + 1)
                return F.when(fell, state(F.lit(0.0), x["token"], begin, F.lit(0.0), F.lit(0), done(a))).otherwise(
                    state(x["now"], x["token"], a["from"], F.greatest(x["now"], a["best"]), F.when(up, i + 2).otherwise(a["to"]), a["out"]))
            return let(F.struct(now.alias("now"), token.alias("token")), after)
        zero = F.struct(F.lit(0.0).alias("now"), F.lit(0).alias("token"), F.lit(0).alias("from"), F.lit(0.0).alias("best"), F.lit(0).alias("to"),
                        F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.length(run) - 2), zero, step, done)

    rest = lambda e: F.length(F.regexp_extract(F.substring(run, e + 1, F.length(run)), "^[A-Za-z0-9]*+", 0))
    whole = F.transform(let(F.transform(F.split(run, ""), F.ascii), over), lambda x: span(x["start"], x["end"] + rest(x["end"])))
    join = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(span(F.element_at(a, -1)["start"], F.greatest(F.element_at(a, -1)["end"], x["end"]))))
    merged = F.aggregate(whole, F.array().cast("array<struct<start:int,end:int>>"), lambda a, x: F.when(
        F.coalesce(F.try_element_at(a, F.lit(-1))["end"] >= x["start"], F.lit(False)), join(a, x)).otherwise(F.concat(a, F.array(x))))
    return F.filter(merged, lambda x: x["end"] - x["start"] >= SHORTEST)


def _without(span: Column, base: Column) -> Column:
    """What the base spans, in order, leave of a Markov span."""
    part = lambda s, e: F.struct(s.alias("start"), span["kind_no"].alias("kind_no"), e.alias("end"), span["kind"].alias("kind"))
    more = lambda a, e: F.when(e > a["at"], F.concat(a["out"], F.array(part(a["at"], e)))).otherwise(a["out"])
    zero = F.struct(span["start"].alias("at"), F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>").alias("out"))
    hit = F.filter(base, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    return F.aggregate(hit, zero, lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), more(a, b["start"]).alias("out")),
                       lambda a: more(a, span["end"]))


def train(docs: DataFrame, text_col: str = "text", smooth: float = 0.5) -> str:
    """Comma-joined log-likelihood ratios of the 16,384 character pairs.
    Without samples of a class its model is uniform."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = docs.select(_values(text).alias("r"), F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)).alias("o"))
    # an identifier with four or more digits that no base pattern matched is left out: it may be either
    both = both.select("r", F.filter(F.array_except("o", "r"), lambda t: ~t.rlike("[0-9](?:[^0-9]*[0-9]){3}")).alias("o"))
    pairs = lambda c: F.flatten(F.transform(c, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: _pair(t, i))))
    sides = F.array(F.struct(F.lit(1).alias("y"), pairs(F.col("r")).alias("p")), F.struct(F.lit(0).alias("y"), pairs(F.col("o")).alias("p")))
    rows = (both.select(F.explode(sides).alias("s")).select("s.y", F.explode("s.p").alias("p"))
            .groupBy("y", "p").agg(F.count("*").alias("n")).collect())  # at most 2 x 16,384
    n = [[0] * 16384, [0] * 16384]
    total = [[0] * 128, [0] * 128]
    for r in rows:
        if 0 <= r["p"] < 16384:
            n[r["y"]][r["p"]] += r["n"]
            total[r["y"]][r["p"] // 128] += r["n"]
    prob = lambda y, p: (n[y][p] + smooth) / (total[y][p // 128] + smooth * SYMBOLS)
    # a quarter of the random model is uniform: a secret may use symbols that the samples lack
    logp = lambda y, p: math.log(0.75 * prob(1, p) + 0.25 / SYMBOLS if y else prob(0, p))
    return ",".join(f"{logp(1, p) - logp(0, p):.4f}" for p in range(16384))


def scan(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = 8.0) -> DataFrame:
    """``doc_id, text_hash, spans`` of the rows that have any; ``spans`` is an
    array of ``start, kind_no, end, kind`` in order (code points)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("kind_no"), _matches(text, p).alias("found"))
                      for k, p in enumerate((ASSIGN, ACCESS, HEX, CANDIDATE))])
    rows = (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(found).alias("f"))
            .select("doc_id", "text_hash", "f.kind_no", F.posexplode("f.found").alias("i", "x"))
            .select("doc_id", "text_hash", "kind_no", "i", "x.*").dropDuplicates(["doc_id", "text_hash", "kind_no", "i"]))
    run = W.partitionBy("doc_id", "text_hash", "kind_no").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(run)).withColumn("start", F.col("end") - F.length("m"))
    table = F.split(F.lit(model), ",").cast("array<double>")  # folded to one literal
    keep = (F.when(F.col("kind_no") == 0, F.length(F.regexp_extract("m", ASSIGN, 2)) >= 12)
            .when(F.col("kind_no") == 1, F.length("m") >= 18).otherwise(F.lit(True)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("m").alias("end")))
    parts = F.when(F.col("kind_no") < 3, whole).otherwise(_segments(F.col("m"), table, min_ratio))
    rows = rows.where(keep).select("doc_id", "text_hash", "kind_no", "start", F.explode(parts).alias("part"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_no") + 1)
    at = lambda e: (F.col("start") + F.col(f"part.{e}")).cast("long").alias(e)
    g = rows.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(
        F.struct(at("start"), "kind_no", at("end"), kind.alias("kind")))).alias("all"))
    base = F.filter("all", lambda s: s["kind_no"] < 3)
    new = F.flatten(F.transform(F.filter("all", lambda s: s["kind_no"] == 3), lambda s: _without(s, base)))
    return g.select("doc_id", "text_hash", F.array_sort(F.concat(base, new)).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = 8.0) -> DataFrame:
    """One row per document: ``doc_id, text_hash, spans array``.

    A Markov span is a part, of SHORTEST or more characters, of a run of
    secret-like characters; its log-likelihood ratio is at least ``min_ratio``.
    What base spans cover of it is cut out.
    Null text is empty and has no spans; rows that share an id but not a text
    are scanned apart; an empty table trains uniform models and gives an empty
    result.  Other columns are not read."""
    found = written(scan(docs, train(docs, text_col), id_col, text_col, min_ratio), "secrets")
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")).alias("d")
    s = found.alias("s")
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    return d.join(s, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash")), "left").select(
        "d.doc_id", "d.text_hash", F.coalesce("s.spans", empty).alias("spans"))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """Replace every span by ``mark``; overlapping spans are one."""
    zero = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda a: F.element_at(a, -1)
    join = lambda a, s: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))))
    merged = F.aggregate(spans, zero, lambda a, s: F.when((F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(-1)) > s["start"]), join(a, s)).otherwise(
        F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    ends = lambda a: F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(a, lambda s: F.array(s["start"], s["end"]))), F.array(F.length(text).cast("long")))
    piece = lambda b, i: F.substring(text, (F.get(b, i * 2) + 1).cast("int"), (F.get(b, i * 2 + 1) - F.get(b, i * 2)).cast("int"))
    kept = let(let(merged, ends), lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(b) / 2) - 1), lambda i: piece(b, i.cast("int"))), mark))
    return F.when(F.size(spans) == 0, text).otherwise(kept)
