"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame
operations only.

A text is cut into paragraphs (its lines, long ones every 16 words), each one
a 64-bit digest.  A sketch holds per cell the count, the XOR of the digests
and the XOR of their check values; a digest goes to one cell in each of three
parts.  Subtracting two versions cancels what they share; peeling cells of one
digest recovers the rest, and a sketch that does not peel to zero is built
again larger.  Long texts use many small sketches, chosen by digest bits, so
the work stays linear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loupe.llm.common import let, written

PIECE = r"(?:\S+[^\S\n]*+){1,16}\n*+|\s+"
LOAD = 8  # digests of both versions per small sketch
LEVELS = ((4, 0, 0), (16, 6, 0), (64, 18, 0), (64, 0, 11))  # cells per part, first bit, rehash seed
ROUNDS = (6, 16, 16, 16)  # of peeling; a sketch that needs more is built again larger


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _xor(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, d: s.bitwiseXOR(d))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit("check"))


def _in_cell(d: Column, cell: Column, level: tuple[int, int, int]) -> Column:
    m, first, seed = level
    bits = m.bit_length() - 1
    h = F.xxhash64(d, F.lit(seed)) if seed else d
    part = lambda p: F.shiftrightunsigned(h, first + bits * p).bitwiseAND(F.lit(m - 1).cast("long")) + p * m
    return (F.when(cell < m, part(0)).when(cell < 2 * m, part(1)).otherwise(part(2))) == cell


def sketch(ds: Column, level: tuple[int, int, int]) -> Column:
    """Cells ``n, k, c`` of an array of digests."""
    cell = lambda s: F.struct(F.size(s).alias("n"), _xor(s).alias("k"), _xor(F.transform(s, _check)).alias("c"))
    return F.transform(F.sequence(F.lit(0), F.lit(3 * level[0] - 1)),
                       lambda i: let(F.filter(ds, lambda d: _in_cell(d, i, level)), cell))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, level: tuple[int, int, int], rounds: int = ROUNDS[-1]) -> Column:
    """``cells, got``: what is left, and the recovered digests with their side
    (1: first version, -1: second)."""
    pure = lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["c"])

    def less(c: Column, s: Column) -> Column:
        d = F.transform(s, lambda x: x["d"])
        return F.struct((c["n"] - F.aggregate(s, F.lit(0), lambda t, x: t + x["s"])).alias("n"),
                        c["k"].bitwiseXOR(_xor(d)).alias("k"), c["c"].bitwiseXOR(_xor(F.transform(d, _check))).alias("c"))

    def step(state: Column, _: Column) -> Column:
        new = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda c: F.struct(c["k"].alias("d"), c["n"].alias("s"))))
        after = lambda n: F.struct(
            F.transform(state["cells"], lambda c, i: let(F.filter(n, lambda x: _in_cell(x["d"], i, level)), lambda s: less(c, s))).alias("cells"),
            F.concat(state["got"], n).alias("got"))
        return let(new, lambda n: F.when(F.size(n) == 0, state).otherwise(after(n)))

    zero = F.struct(cells.alias("cells"), F.array().cast("array<struct<d:bigint,s:int>>").alias("got"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, step)


def difference(a: Column, b: Column, levels=LEVELS) -> Column:
    """How many digests differ between two small digest arrays: peeled from
    their subtracted sketches, retried larger while cells remain; what the
    last size leaves counts by its cells."""
    def counted(rest: Column | None):
        def count(r: Column) -> Column:
            left = F.exists(r["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0))
            over = F.ceil(F.aggregate(r["cells"], F.lit(0), lambda t, c: t + F.abs(c["n"])) / 3).cast("int")
            return F.when(~left, F.size(r["got"])).otherwise(F.size(r["got"]) + over if rest is None else rest)
        return count

    out = None
    for level, rounds in reversed(list(zip(levels, ROUNDS))):
        out = let(peel(subtract(sketch(a, level), sketch(b, level)), level, rounds), counted(out))
    return out


def fingerprint(text: Column, ds: Column) -> Column:
    """The whole text's smallest sketch as a string, after its length and hash."""
    cells = F.transform(sketch(ds, LEVELS[0]), lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["c"])))
    return F.concat_ws("|", F.length(text).cast("string"), F.hex(F.xxhash64(text)), F.array_join(cells, ","))


KEY = ["kid", "kn", "th"]  # id with null as 0, id is null, text hash


def likeness(pairs: DataFrame, info: list[str], a: str, others: list[str]) -> DataFrame:
    """``KEY``, ``info`` and for each of ``others`` ``near_<name>`` (1 -
    differing digests / digests of both; two texts without digests are alike).

    The digests are dealt to small sketches by their upper bits.  All grouping
    is by KEY first, so rows that a join left clustered by KEY stay there."""
    one = []
    for name in others:
        p = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(name)) / LOAD))
        part = lambda c, s: F.transform(c, lambda d: F.struct(F.lit(name).alias("o"), F.pmod(F.shiftrightunsigned(d, 36), p).alias("p"), d.alias("d"), F.lit(s).alias("s")))  # noqa: B023, E731
        one += [part(F.col(a), 1), part(F.col(name), -1)]
    ends = [F.struct(F.lit(name).alias("o"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("d"), F.lit(0).alias("s")) for name in others]
    sizes = F.struct(*[(F.size(a) + F.size(name)).alias(name) for name in others], *info)
    rows = pairs.select(*KEY, sizes.alias("i"), F.explode(F.concat(*one, F.array(*ends))).alias("x"))
    rows = rows.select(*KEY, "x.o", "x.p", F.when(F.col("x.s") == 0, F.col("i")).alias("i"), F.struct("x.d", "x.s").alias("x"))
    g = rows.groupBy(*KEY, "o", "p").agg(F.first("i", ignorenulls=True).alias("i"), F.collect_list("x").alias("x"))
    pick = lambda s: F.transform(F.filter("x", lambda x: x["s"] == s), lambda x: x["d"])
    g = g.select(*KEY, "o", "i", pick(1).alias("a"), pick(-1).alias("b"))
    g = g.select(*KEY, "o", "i", difference(F.col("a"), F.col("b")).alias("n"))
    g = g.groupBy(*KEY).agg(F.first("i", ignorenulls=True).alias("i"), *[F.sum(F.when(F.col("o") == name, F.col("n")).otherwise(0)).alias(name) for name in others])
    near = lambda name: F.when(F.col(f"i.{name}") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col(name) / F.col(f"i.{name}")))
    return g.select(*KEY, *[F.col(f"i.{c}") for c in info], *[near(name).alias(f"near_{name}") for name in others])


def neighbours(d: DataFrame) -> DataFrame:
    """``KEY, pid, pn, pt, plen``: for every row the key and length of the row
    before it in (id, text hash) order, the last one before the first.

    Only keys and lengths are sorted, by ranges; the range ends are a table of
    one row per partition."""
    order = [F.col("kn").desc(), F.col("kid"), F.col("th")]  # null ids first
    w = W.partitionBy("part").orderBy(*order)
    s = d.select(*KEY, "n").distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    s = written(s, "order")
    me = F.struct(*KEY, "n")
    s = s.withColumn("prev", F.lag(me).over(w)).withColumn("last", F.max(F.struct((~F.col("kn")).alias("o"), *KEY, "n")).over(W.partitionBy("part")))
    ends = s.groupBy("part").agg(F.first("last").alias("last"))
    ring = W.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(ring), F.last("last").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("end"))
    s = s.join(ends, "part")
    get = lambda c: F.coalesce(F.col(f"prev.{c}"), F.col(f"end.{c}"))
    return s.select(*KEY, get("kid").alias("pid"), get("kn").alias("pn"), get("th").alias("pt"), get("n").alias("plen"))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text (the last quarter
    replaced by the start of the next document), and the likenesses.

    Null text is empty; rows that repeat id and text count once; rows with one
    id and several texts are ordered by a hash of the text; a single document
    is its own next.  An empty table gives an empty result, and other columns
    are not read.

    Texts are shuffled once, by key.  Each sends to the document before it
    only the head that document needs and its digests."""
    d = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("kid"), F.col(id_col).isNull().alias("kn"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    n = F.length("text").alias("n")
    order = written(neighbours(d.select(*KEY, n)), "neighbours")
    full = d.join(order, KEY).groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("text", "pid", "pn", "pt", "plen")])
    sent = full.select(F.col("pid").alias("kid"), F.col("pn").alias("kn"), F.col("pt").alias("th"),
                       F.substring("text", F.lit(1), F.floor(F.col("plen") / 4).cast("int")).alias("head"), digests(F.col("text")).alias("next"))
    both = full.select(*KEY, "text", n).join(sent, KEY)
    both = both.withColumn("now", F.concat(F.substring("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 4).cast("int")), "head"))
    both = both.select(*KEY, F.col("n").cast("long").alias("n_chars"), F.sha2("now", 256).alias("edited_sha256"), "text", "now", "next",
                       digests(F.col("text")).alias("own"), digests(F.col("now")).alias("edited"))
    both = both.select("*", fingerprint(F.col("text"), F.col("own")).alias("fingerprint"), fingerprint(F.col("now"), F.col("edited")).alias("edited_fingerprint"))
    info = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    out = likeness(both, info, "own", ["edited", "next"])
    return out.select(F.when(~F.col("kn"), F.col("kid")).alias("doc_id"), *info, "near_edited", "near_next")
