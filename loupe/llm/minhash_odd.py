"""MinHash near-duplicates with odd sketches.

Texts with equal shingle sets are one class.  Each class has MinHash samples;
bands of samples propose partners, and the samples folded into a parity bitmap
(odd sketch) estimate a pair's similarity from the population count of the
XOR, so that few false candidates reach the exact check on full sets.

First every class is compared with its buckets' most central member.  Buckets
whose members are then still in several components are compared inside, in
bounded blocks, except within a component; so no link is missed and a large
group of copies costs little more than one comparison a member."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import connected_components, written

SAMPLES, BITS = 168, 512  # at most, for the bands; of an odd sketch
MISSED = 2.5e-6  # most likely share of pairs at the threshold that share no band
REJECTED = 1e-5  # and of those that the sketch takes for less similar
BLOCK = 2048
GROUP = ["band", "key", "bi", "bj"]
MEMBER = [*GROUP, "id", "component", "side"]
MAX_WORDS = 200_000  # of texts hashed together
BATCH = 1000  # rows handed to Python at once
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of a word; forgets all when it holds 100,000."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, seen: WordHash, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text; fewer
    words: one shingle; none: empty.  ``bytes.split`` cuts at space and
    \\x09-\\x0D, ``bytes.lower`` changes A-Z only."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    s = np.full(n, len(w) if len(w) < k else k, np.uint64)
    for j in range(min(k, len(w))):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(s)


def layout(percent: int) -> tuple[int, int]:
    """Bands and rows for a threshold: as many rows a band as SAMPLES allow
    when a pair at the threshold shares no band with probability MISSED."""
    s = percent / 100
    if s >= 1:
        return 1, SAMPLES
    need = lambda r: math.ceil(math.log(MISSED) / math.log1p(-s**r))
    rows = max((r for r in range(1, SAMPLES + 1) if s**r > 0.05 and need(r) * r <= SAMPLES), default=1)
    return need(rows), rows


def sample_minima(sets: list[np.ndarray], seed: int = 5, k: int = SAMPLES) -> np.ndarray:
    """MinHash samples of non-empty sets: (sets, k)."""
    u = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    rng = np.random.default_rng(seed)
    mul, add = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)
    return np.stack([np.minimum.reduceat(u * mul[i] + add[i], at) for i in range(k)], axis=1)


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(m), bands), np.uint64)
    for j in range(rows):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + m[:, j::rows][:, :bands])
    return out


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each of BITS positions, as words."""
    out, row = np.zeros((len(m), BITS // 64), np.uint64), np.arange(len(m))
    for i in range(m.shape[1]):
        h = _mix(m[:, i] + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS.bit_length() + 1)
        out[row, (h >> np.uint64(6)).astype(int)] ^= np.uint64(1) << (h & np.uint64(63))
    return out


def most_unequal_bits(similarity: float, k: int = SAMPLES) -> int:
    """Expected population count of the XOR at a similarity: of k samples
    2 k (1 - J) differ and are thrown on BITS positions."""
    t = 2 * k * (1 - similarity)
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** t))


def worst_bits(percent: int, k: int) -> int:
    """The population count that a pair at the threshold exceeds with
    probability REJECTED at most: the differing samples are binomial, and each
    throws two bits."""
    s, odd = percent / 100, np.arange(BITS + 1)
    count, now = np.zeros(BITS + 1), np.eye(1, BITS + 1)[0]
    for n in range(k + 1):
        count += math.comb(k, n) * (1 - s) ** n * s ** (k - n) * now
        for _ in range(2):
            up, down = now * (BITS - odd) / BITS, now * odd / BITS
            now = np.append(0, up[:-1]) + np.append(down[1:], 0)
    above = np.append(count[::-1].cumsum()[::-1][1:], 0)
    return int(np.flatnonzero(above <= REJECTED)[0])


def _signatures(bands_rows: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _signed(batches, *bands_rows)
    return run


def _signed(batches: Iterator[pd.DataFrame], n_bands: int, n_rows: int) -> Iterator[pd.DataFrame]:
    seen = WordHash()
    for b in batches:
        at = 0
        size = b["text"].str.len().fillna(0).cumsum().to_numpy()
        while at < len(b):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 6 * MAX_WORDS, "right")))
            part = b.iloc[at:end]
            at = end
            sets = [shingle_set(t, seen) for t in part["text"]]
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            digest, bands, sk = [None] * len(part), [None] * len(part), [None] * len(part)
            if len(full):
                m = sample_minima([sets[i] for i in full], k=n_bands * n_rows)
                keys, sketches = band_keys(m, n_bands, n_rows).view(np.int64), odd_sketch(m).view(np.int64)
                for j, i in enumerate(full):
                    digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i], sk[i] = keys[j], sketches[j]
            yield pd.DataFrame({"doc_id": part["doc_id"], "no_id": part["no_id"], "text_hash": part["text_hash"], "n": n, "digest": digest, "bands": bands, "sketch": sk})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = WordHash()
    for b in batches:
        for at in range(0, len(b), 256):
            part = b.iloc[at:at + 256]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "s": [shingle_set(t, seen).tobytes() for t in part["text"]]})


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (a.size + b.size - common)


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["sa"], b["sb"])]
            yield b.loc[ok, ["a", "b"]]
    return run


def close_pairs(g: pd.DataFrame, percent: int, worst: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of one block (or one pair of blocks) with those after them that
    are in another component and near by size and sketch.  A pair is left to
    the first band that both share, and two members of one side of a pair of
    blocks to that block's own group."""
    ids, n, comp = g["id"].to_numpy(), g["n"].to_numpy(), g["component"].to_numpy()
    sk = np.stack(g["sketch"].to_numpy()).view(np.uint64)
    bands = np.stack(g["bands"].to_numpy())
    side, two, band = g["side"].to_numpy(), bool(g["bi"].iloc[0] != g["bj"].iloc[0]), int(g["band"].iloc[0])
    for i in range(len(g) - 1):
        rest = np.arange(i + 1, len(g))
        low, high = np.minimum(n[rest], n[i]), np.maximum(n[rest], n[i])
        ok = (100 * low >= percent * high) & (comp[rest] != comp[i])
        if two:
            ok &= side[rest] != side[i]
        rest = rest[ok]
        rest = rest[np.bitwise_count(sk[rest] ^ sk[i]).sum(axis=1) <= worst]
        if band and len(rest):
            rest = rest[~(bands[rest, :band] == bands[i, :band]).any(axis=1)]
        if len(rest):
            yield i, rest


def block_members(g: pd.DataFrame, percent: int, worst: int) -> pd.DataFrame:
    """Members with a close partner in another component."""
    near = np.zeros(len(g), bool)
    for i, rest in close_pairs(g, percent, worst):
        near[i] = True
        near[rest] = True
    return g.loc[near, MEMBER]


def block_links(g: pd.DataFrame, percent: int, worst: int) -> pd.DataFrame:
    """Exact links between members that join different components: a spanning
    forest, not all links."""
    ids, comp = g["id"].to_numpy(), g["component"].to_numpy().tolist()
    boss, sets, out = {c: c for c in comp}, {}, []

    def find(c: int) -> int:
        while boss[c] != c:
            boss[c] = c = boss[boss[c]]
        return c

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(g["s"].iloc[i], np.uint64)
        return sets[i]
    for i, rest in close_pairs(g, percent, worst):
        for j in rest:
            if (x := find(comp[i])) != (y := find(comp[j])) and _linked(full(i), full(j), percent):
                boss[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))
    return pd.DataFrame(out, columns=["a", "b"])


def _groups(one, percent: int, worst: int):
    """``one`` for every group; groups arrive whole and in order within a
    partition, cut over batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            k = b[GROUP].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            found = [one(b.iloc[s:t], percent, worst) for s, t in zip([0, *cuts[:-1]], cuts)] if len(cuts) else []
            held = b.iloc[cuts[-1] if len(cuts) else 0:]
            if found := [x for x in found if len(x)]:
                yield pd.concat(found)
        if held is not None and len(held):
            yield one(held, percent, worst)
    return run


def _unequal_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, component_id,
    kept``.

    Documents link if 100 x common >= percent x united shingles (five words,
    A-Z lower-cased); components are the links' closure, named by their
    smallest id.  Null or empty text: no shingles, linked with nothing.
    Repeated rows link like other copies; rows that share an id but not a text
    are judged apart, and of a component the smallest id's smallest text hash
    is kept.  A null id is never linked: its component is null and it is kept.
    Empty table: empty result.  Other columns are not read.

    Sets are recomputed from the texts of classes that share a bucket, never
    stored for all.  A class is a vertex under a number of its own.  Buckets
    and pairs carry these, counts and bitmaps; a hot bucket is merged map-side
    before it is joined, and split into blocks of BLOCK members before members
    meet.  Bands, rows and the sketches' bound follow ``percent``."""
    bands, n_rows = layout(percent)
    worst = worst_bits(percent, bands * n_rows)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    # a null id goes through pandas as a mark: beside nulls whole numbers would become doubles
    sig = d.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text", "text_hash").mapInPandas(
        _signatures((bands, n_rows)), "doc_id long, no_id boolean, text_hash long, n long, digest binary, bands array<long>, sketch array<long>")
    sig = written(sig.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id"), "signatures", BATCH)
    cls = sig.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    # written, so that the numbers stay
    cls = written(cls.select("digest", "rep.*", F.monotonically_increasing_id().alias("id")), "numbers")
    member = written(sig.select("doc_id", "text_hash", "n", "digest").join(cls.select("digest", "id"), "digest", "left").select("doc_id", "text_hash", "n", "id"), "classes")
    reps = written(sig.join(cls, ["digest", "doc_id", "text_hash"]).dropDuplicates(["id"]), "reps")
    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    size = rows.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    shared = written(rows.join(size, ["band", "key"]), "shared")
    central = shared.groupBy("id").agg(F.sum("c").alias("weight"))
    pivot = shared.join(central, "id").groupBy("band", "key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("pivot"))
    pairs = (shared.join(pivot, ["band", "key"]).where("id <> pivot")
             .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("doc_id").alias(f"d{x}"), F.col("text_hash").alias(f"t{x}"))
    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_unequal_bits(F.col("ka"), F.col("kb")) <= worst))
            .select("a", "b", "da", "ta", "db", "tb").distinct())
    near = written(near, "pairs")
    # written, so that its size is known before the texts would be shuffled to
    # it; ids only, so it stays small: other texts of an id leave at the joins
    wanted = written(reps.join(shared.select("id").distinct(), "id").select("doc_id").distinct(), "wanted")
    sets = written(d.join(wanted, "doc_id").dropDuplicates(["doc_id", "text_hash"]).mapInPandas(_sets, "doc_id long, text_hash long, s binary"), "sets", BATCH)
    of = lambda x: sets.select(F.col("doc_id").alias(f"d{x}"), F.col("text_hash").alias(f"t{x}"), F.col("s").alias(f"s{x}"))
    exact = near.join(of("a"), ["da", "ta"]).join(of("b"), ["db", "tb"]).select("a", "b", "sa", "sb")
    links = written(exact.mapInPandas(_verify(percent), "a long, b long").distinct(), "links", BATCH)
    first = connected_components(links)
    # buckets whose members are still in several components
    now = shared.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band", "key")
    now = now.join(mixed, ["band", "key"]).withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int"))
    now = now.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    now = now.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    now = now.select("band", "key", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), "id", "component", F.col("mine").alias("side"))
    # by sketches first: sets go only where a close partner is in another component
    dealt = lambda x: x.repartition(*GROUP).sortWithinPartitions(*GROUP, "id")
    sketched = now.join(reps.select("id", "n", "bands", "sketch"), "id")
    kinds = "band int, key long, bi int, bj int, id long, component long, side int"
    close = written(dealt(sketched).mapInPandas(_groups(block_members, percent, worst), kinds), "close", BATCH)
    full = close.join(reps.select("id", "doc_id", "text_hash", "n", "bands", "sketch"), "id").join(sets, ["doc_id", "text_hash"]).drop("doc_id", "text_hash")
    more = dealt(full).mapInPandas(_groups(block_links, percent, worst), "a long, b long")
    more = written(more.distinct(), "more", BATCH)
    final = connected_components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    final = cls.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keeper = final.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("keeper"))
    out = member.join(final.select("id", "component").join(keeper, "component").select("id", "keeper"), "id", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("keeper.doc_id", "doc_id"))
    kept = F.col("doc_id").isNull() | F.col("keeper").isNull() | ((F.col("keeper.doc_id") == F.col("doc_id")) & (F.col("keeper.text_hash") == F.col("text_hash")))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"))
