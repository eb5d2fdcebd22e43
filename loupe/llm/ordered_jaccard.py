"""Jaccard self-join of documents by prefix filters under several global token
orders.

If two sets are similar enough, then under *any* order that all sets share,
the first few tokens of both (their prefixes) have a token in common.  Four
orders are used and a candidate must pass all of them before full sets meet:

* Order 1 is by token hash.  Its prefix is taken longer than needed, so that
  several common tokens are certain.
* Order 2 is by rarity (documents counted over the prefixes of order 1, ties
  by hash).  Of the longer prefix only the rarest tokens stay: the spare
  common ones allow the most frequent to go, and with them what boilerplate
  shares.  Partners meet at the tokens left.
* Orders 3 and 4 are by other hashes.  A pair's common prefix tokens bound its
  whole overlap; pairs whose bound is too low under either order go.

Before orders 3 and 4, a parity bitmap of the whole set gives a cheap bound
that never errs on a linked pair: sets differ in at least as many tokens as
their bitmaps differ in bits.

Members of a token's group are first compared with one central member; groups
whose members are still in several components are then compared inside, in
blocks of bounded size.  No link between components is lost, and a large group
of near copies costs about one comparison a member."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import connected_components, written

SPARE = 16  # a prefix is longer by one SPAREth of the set
BLOCK, BLOCK_TOKENS = 1024, 2_000_000  # members and tokens of one block
BLOCK_KEY = ["token", "bi", "bj"]
MEMBER = [*BLOCK_KEY, "id", "component", "side"]
SLICE_BYTES = 4 << 20  # of text hashed together
WANTED_ROWS = 1_000_000  # ids of at most 16 bytes: 16 MB, the most that is broadcast
PAIR_WORDS = 1 << 19  # pairs, and bitmap words of pairs, held at once
FEWEST_BITS, MOST_BITS = 256, 1 << 16  # of a parity bitmap
BITMAP_SEED = 0x94D049BB133111EB
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # of orders 3 and 4
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of a word; forgets all when it holds 200,000."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[str | None], k: int, seen: Words) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text;
    fewer words: one shingle; none: empty.  ``bytes.split`` cuts at space and
    \\x09-\\x0D, ``bytes.lower`` changes A-Z only."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(seen.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    run = np.full(max(len(h) - k + 1, 0), k, np.uint64)
    for j in range(k):
        run = _mix(run * np.uint64(SEEDS[0]) + h[j:j + len(run)])
    out, at = [], 0
    for m in n.tolist():
        if m >= k:
            out.append(np.unique(run[at:at + m - k + 1]))
        elif m:
            s = np.full(1, m, np.uint64)
            for x in h[at:at + m]:
                s = _mix(s * np.uint64(SEEDS[0]) + x)
            out.append(s)
        else:
            out.append(np.empty(0, np.uint64))
        at += m
    return out


def least_common(n, percent: int):
    """The fewest tokens that a set of n shares with any partner."""
    return -(-percent * n // 100)


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Length of the longer prefix of order 1, and how many of its most
    frequent tokens may go.

    A partner has at least ``need`` tokens, so its own prefix has at least as
    many to spare as are dropped here."""
    need = least_common(n, percent)
    longer = min(n, n - need + 1 + n // SPARE)
    return longer, max(0, min(need // SPARE, least_common(need, percent) - 1))


def order_prefix(s: np.ndarray, seed: int, percent: int) -> np.ndarray:
    """The prefix of a set under a hashed order, sorted."""
    p = len(s) - least_common(len(s), percent) + 1
    h = _mix(s ^ np.uint64(seed))
    return np.sort(np.partition(h, p - 1)[:p]) if p < len(h) else np.sort(h)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each position, as 64-bit words; about
    two to four positions a token, a power of two."""
    width = min(max(FEWEST_BITS, 1 << (2 * len(s)).bit_length()), MOST_BITS)
    odd = np.bincount((_mix(s ^ np.uint64(BITMAP_SEED)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """The bitmap on fewer positions."""
    return b if len(b) == words else np.bitwise_xor.reduce(b.reshape(-1, words), axis=0)


def most_unequal(na, nb, percent: int):
    """In how many tokens two linked sets differ at most."""
    return na + nb - 2 * least_overlap(na, nb, percent)


def overlap_bound(common, last_a, last_b, rest_a, rest_b):
    """The most tokens that two sets can share: those common to the prefixes,
    and all behind the prefix that ends first."""
    return common + np.where(last_a <= last_b, rest_a, rest_b)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (a.size + b.size - common)


def least_overlap(na, nb, percent: int):
    return -(-percent * (na + nb) // (100 + percent))


def _slices(b: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts = b.column(text).to_pylist()
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield b.slice(at, i + 1 - at), texts[at:i + 1]
            at, size = i + 1, 0


def _signed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for b in batches:
            for part, texts in _slices(b, "text"):
                sets = shingle_sets(texts, k, seen)
                heads = [s[:prefix_lengths(len(s), percent)[0]] for s in sets]
                flat = pa.array(np.concatenate(heads).view(np.int64) if heads else [], pa.int64())
                ends = pa.array(np.cumsum([0] + [len(x) for x in heads]), pa.int32())
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digest, pa.binary()), pa.ListArray.from_arrays(ends, flat)], ["row", "doc_id", "text_hash", "n", "digest", "prefix"])
    return run


def _full_sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Words()
        for b in batches:
            for part, texts in _slices(b, "text"):
                sets = shingle_sets(texts, k, seen)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                     pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                     *[pa.array([order_prefix(s, x, percent).tobytes() for s in sets], pa.binary()) for x in SEEDS]], ["id", "n", "s", "bits", "o3", "o4"])
    return run


def _hashes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum())


def may_link(na: int, nb: int, bits: tuple[np.ndarray, np.ndarray], prefixes: list[tuple[np.ndarray, np.ndarray]], percent: int) -> bool:
    """Whether a pair passes the bitmaps' bound and that of each order."""
    need = least_overlap(na, nb, percent)
    return bits_apart(*bits) <= most_unequal(na, nb, percent) and all(
        overlap_bound(np.intersect1d(a, b, assume_unique=True).size, a[-1], b[-1], na - len(a), nb - len(b)) >= need for a, b in prefixes)


def _filtered(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = lambda x: [[_hashes(v) for v in b[f"a{x}"]], [_hashes(v) for v in b[f"b{x}"]]]
            ok = [may_link(*r[:2], r[2:4], [r[4:6], r[6:8]], percent) for r in zip(b["na"], b["nb"], *of("bits"), *of("3"), *of("4"))]
            yield b.loc[np.array(ok, bool), ["a", "b"]]
    return run


def _verified(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [linked(_hashes(x), _hashes(y), percent) for x, y in zip(b["sa"], b["sb"])]
            yield b.loc[np.array(ok, bool), ["a", "b"]]
    return run


def candidates(n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: list[np.ndarray], two: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of one block (or of a pair of blocks) with those not smaller that
    are in another component and pass the size and bitmap bounds, each pair once.  Two members
    of one side of a pair of blocks are left to that block."""
    if (comp == comp[0]).all():
        return
    order = np.argsort(n, kind="stable")  # by size, so that partners of fitting size are a range
    n, side, bits, comp = n[order], side[order], [bits[k] for k in order.tolist()], np.unique(comp, return_inverse=True)[1][order].astype(np.int32)
    end = np.searchsorted(percent * n, 100 * n, side="right").astype(np.int32)
    m, words = len(n), np.array([len(x) for x in bits])
    level = {w: np.stack([fold(x, w) if len(x) >= w else np.zeros(w, np.uint64) for x in bits]) for w in np.unique(words).tolist()}
    i = 0
    while i < m - 1:
        rows = np.arange(i, min(i + max(1, PAIR_WORDS // (m - i)), m), dtype=np.int32)
        cols = np.arange(i, end[rows[-1]], dtype=np.int32)
        ok = (comp[cols] != comp[rows, None]) & (cols > rows[:, None]) & (cols < end[rows, None])
        if two:
            ok &= side[cols] != side[rows, None]
        a, b = np.nonzero(ok)  # bitmaps of these pairs only
        both, most = np.minimum(words[i + a], words[i + b]), most_unequal(n[i + a], n[i + b], percent)
        for w, x in level.items():
            at = np.flatnonzero(both == w)
            for s in np.split(at, range(PAIR_WORDS // w, len(at), PAIR_WORDS // w)):
                ok[a[s], b[s]] = np.bitwise_count(x[i + a[s]] ^ x[i + b[s]]).sum(axis=1) <= most[s]
        for j in np.flatnonzero(ok.any(axis=1)).tolist():
            yield int(order[i + j]), order[i + np.flatnonzero(ok[j])]
        i += len(rows)


def _close_members(g: dict[str, np.ndarray], percent: int) -> np.ndarray:
    near = np.zeros(len(g["id"]), bool)
    for i, rest in candidates(g["n"], g["component"], g["side"], [_hashes(x) for x in g["bits"]], g["bi"][0] != g["bj"][0], percent):
        near[i] = near[rest] = True
    return np.stack([g[c][near] for c in MEMBER], axis=1)


def _block_links(g: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Links that join components: a spanning forest, not all links."""
    ids, n, comp = g["id"].tolist(), g["n"].tolist(), g["component"].tolist()
    sets, bits, o3, o4 = ([_hashes(x) for x in g[c]] for c in ("s", "bits", "o3", "o4"))
    boss, out = {c: c for c in comp}, []

    def find(c: int) -> int:
        while boss[c] != c:
            boss[c] = c = boss[boss[c]]
        return c
    for i, rest in candidates(g["n"], g["component"], g["side"], bits, g["bi"][0] != g["bj"][0], percent):
        for j in rest.tolist():
            x, y = find(comp[i]), find(comp[j])
            if x != y and may_link(n[i], n[j], (bits[i], bits[j]), [(o3[i], o3[j]), (o4[i], o4[j])], percent) and linked(sets[i], sets[j], percent):
                boss[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def _each_block(one, columns: list[str], percent: int):
    """``one`` for every block; blocks arrive whole and in order within a
    partition, cut over batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def blocks(b: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
            g = {c: b[c].to_numpy() for c in b.columns}
            found = [one({c: v[s:t] for c, v in g.items()}, percent) for s, t in zip([0, *cuts], cuts)]
            return pd.DataFrame(np.concatenate(found), columns=columns)
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(b):
                continue
            k = b[BLOCK_KEY].to_numpy()
            cuts = (np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()
            if cuts:
                yield blocks(b, cuts)
            held = b.iloc[cuts[-1] if cuts else 0:]
        if held is not None and len(held):
            yield blocks(held, [len(held)])
    return run


def _members_hash(*more: Column) -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(x), F.col("id"), *more)).alias(f"h{x}") for x in (1, 2)]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, component_id``.

    Documents link if 100 x common >= percent x united k-word shingles (A-Z
    lower-cased); components are the links' closure, named by their smallest
    id.  Null or empty text: no shingles, linked with nothing, own component.
    Fewer than k words: one shingle.  Repeated rows link like other copies;
    rows that share an id but not a text are judged apart.  A null id is never
    linked and its component is null.  Ids stay integers throughout.  Empty
    table: empty result.  Other columns are not read.

    Texts with equal sets are one class.  Full sets are recomputed from the
    texts of candidate classes only; counts, groups and pairs carry hashes and
    numbers.  Groups with the same members are compared once."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = dict(d.dtypes)["doc_id"]
    sig = written(d.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_hash", "text").mapInArrow(
        _signed(k, percent), f"row long, doc_id {kind}, text_hash long, n long, digest binary, prefix array<long>"), "ordered")
    known = sig.where("digest is not null and doc_id is not null")
    cls = written(known.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "row")).alias("r"))
                  .select("digest", F.col("r.row").alias("id"), F.col("r.doc_id").alias("first"), F.col("r.text_hash").alias("text_hash")), "ordered-classes")
    member = written(sig.select("row", "doc_id", "text_hash", "n", "digest").join(cls.select("digest", "id"), "digest", "left")
                     .select("row", "doc_id", "text_hash", "n", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")), "ordered-members")
    others = member.where("id is null or id <> row").select("row")
    held = sig.where("digest is not null").select("row", "prefix").join(others, "row", "left_anti")
    held = held.select(F.col("row").alias("id"), F.explode("prefix").alias("token"))
    # orders 1 and 2
    often = written(held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "ordered-often")
    ranked = held.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token")), asc=False).alias("t"))
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    spare = F.greatest(F.lit(0), F.least(F.floor(need / SPARE), F.ceil(F.lit(percent) * need / 100) - 1)).cast("int")
    rare = ranked.join(member.select(F.col("row").alias("id"), "n"), "id").select("id", "n", F.explode(
        F.slice("t", spare + 1, F.greatest(F.size("t") - spare, F.lit(0)))).alias("x")).select("id", "n", "x.token")
    rare = written(rare, "ordered-rare")
    size = rare.groupBy("token").agg(F.count("*").alias("c"), F.sum("n").alias("tokens"), *_members_hash()).where("c > 1")
    size = written(size.groupBy("c", "h1", "h2").agg(F.min(F.struct("token", "tokens")).alias("x")).select("c", "x.*"), "ordered-groups")
    shared = written(rare.join(size, "token"), "ordered-shared")
    central = shared.groupBy("id").agg(F.sum("c").alias("weight"))
    pivot = shared.join(central, "id").groupBy("token").agg(F.max_by(F.struct("id", "n"), F.struct("weight", -F.col("id"))).alias("p"))
    pivot = written(pivot, "ordered-pivots")  # a plain table, so that a hot group can be split at the join
    pairs = (shared.join(pivot, "token").where(F.col("id") != F.col("p.id"))
             .where(100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n"))
             .select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct())
    pairs = written(pairs, "ordered-pairs")
    # full sets and orders 3 and 4, of the classes that share a group
    wanted = written(shared.select("id").distinct().join(cls, "id").select("id", F.col("first").alias("doc_id"), "text_hash"), "ordered-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED_ROWS else wanted
    texts = d.join(wanted, ["doc_id", "text_hash"]).groupBy("id").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_full_sets(k, percent), "id long, n long, s binary, bits binary, o3 binary, o4 binary"), "ordered-sets")
    head = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}{c[-1] if c != 'bits' else c}") for c in ("bits", "o3", "o4")])
    full = lambda x: sets.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))
    passed = written(pairs.join(head("a"), "a").join(head("b"), "b").mapInPandas(_filtered(percent), "a long, b long"), "ordered-passed")
    first = connected_components(passed.join(full("a"), "a").join(full("b"), "b").mapInPandas(_verified(percent), "a long, b long"))
    # groups whose members are still in several components, in blocks; of a group
    # of two, the one pair has met at the pivot
    now = shared.where("c > 2").join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    mixed = written(mixed, "ordered-mixed")
    now = now.join(mixed, "token").withColumn("nb", F.ceil(F.greatest(F.col("c") / BLOCK, F.col("tokens") / BLOCK_TOKENS)).cast("int"))
    now = now.withColumn("side", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    now = now.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    now = now.select("token", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "id", "component", "side")
    dealt = lambda x: x.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "id")
    close = dealt(now.join(sets.select("id", "n", "bits"), "id")).mapInPandas(
        _each_block(_close_members, MEMBER, percent), "token long, bi int, bj int, id long, component long, side int")
    close = written(close, "ordered-close")
    # a pair meets in many groups: of groups with the same close members (on the same sides) one is enough
    own = F.when(F.col("bi") == F.col("bj"), F.lit(-1)).otherwise(F.col("side"))
    once = close.groupBy(*BLOCK_KEY).agg(F.count("*").alias("c"), *_members_hash(own)).groupBy("c", "h1", "h2").agg(F.min(F.struct(*BLOCK_KEY)).alias("g")).select("g.*")
    more = dealt(close.join(once, BLOCK_KEY).join(sets, "id")).mapInPandas(_each_block(_block_links, ["a", "b"], percent), "a long, b long")
    final = connected_components(first.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    final = cls.select("id", "first").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    name = final.groupBy("component").agg(F.min("first").alias("component_id"))
    named = final.join(name, "component").select("id", "component_id")
    out = member.join(named, "id", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
