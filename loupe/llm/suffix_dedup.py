"""Repeated passages: every byte covered by a 200-byte string that also starts
elsewhere, found with suffix arrays built by two-stage sorting.

Windows of 200 bytes are dealt by the least hash of the 24-byte grams in them:
equal windows meet, and a run of windows with one least gram is one segment of
about 285 bytes.  A segment whose least gram occurs once in all has no
repeated window.  Where all segments of a gram hold the same bytes, all are repeated.
Only different segments of one gram are sorted: one copy of each, in a suffix
array per group of segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import written

WIDTH, GRAM = 200, 24
REACH = WIDTH - GRAM + 1  # grams of a window
LONGEST = 1024  # windows of one segment
BUNDLE = 1 << 20  # bytes sorted together
HOT = 20_000  # different segments of one gram that one task sorts
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


def window_keys(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for every window start the least of its
    window."""
    n = len(b)
    if n < WIDTH:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    v = np.ndarray((n - 7,), "<u8", buffer=b, strides=(1,))
    g = v[:n - 23] * _C[0] + v[8:n - 15] * _C[1] + v[16:n - 7] * _C[2]
    g = (g ^ (g >> np.uint64(29))) * _C[3]
    g ^= g >> np.uint64(32)
    grams, w = g, 1
    while 2 * w <= REACH:
        g = np.minimum(g[:-w], g[w:])
        w *= 2
    return grams, np.minimum(g[:len(g) - (REACH - w)], g[REACH - w:])


def segments(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, start, windows, again`` of the runs of windows with one least
    gram; ``again``: that gram stands in the segment more than once, so its
    own windows may repeat."""
    grams, m = window_keys(b)
    if not len(m):
        return m, np.empty(0, int), np.empty(0, int), np.empty(0, bool)
    start = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    size = np.diff(np.append(start, len(m)))
    if size.max() > LONGEST:
        parts = -(-size // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(start + size, parts)
        start = np.repeat(start, parts) + step * LONGEST
        size = np.minimum(LONGEST, end - start)
    key = m[start]
    again = [np.count_nonzero(grams[s:s + n + REACH - 1] == k) > 1 for k, s, n in zip(key, start.tolist(), size.tolist())]
    return key, start, size, np.array(again, bool)


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    at = np.where(up != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    return up[at] > 0


def words_at(t: np.ndarray) -> np.ndarray:
    """At every place the next eight bytes as a number (zeros past the end)."""
    pad = np.concatenate([t, np.zeros(WIDTH + 8, np.uint8)]).tobytes()
    return np.ndarray((len(pad) - 7,), ">u8", buffer=pad, strides=(1,)).astype(np.uint64)


def sort_direct(pos: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sort suffixes by their first WIDTH bytes, eight at a time; only those
    still tied go on."""
    key = w[pos]
    o = np.argsort(key, kind="stable")
    pos, key = pos[o], key[o]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(pos) else key
    tied = np.arange(len(pos))
    for d in range(8, WIDTH, 8):
        g = group[tied]
        eq = g[1:] == g[:-1]
        keep = np.concatenate([eq, [False]]) | np.concatenate([[False], eq]) if len(g) else eq
        tied, g = tied[keep], g[keep]
        if not len(tied):
            break
        sub = pos[tied]
        k = w[sub + d]
        o = np.lexsort((k, g))
        pos[tied], k = sub[o], k[o]
        new = np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (k[1:] != k[:-1]))])
        group = np.full(len(pos), -1)
        group[tied] = new
    return pos


def suffix_array(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Two-stage sorting: suffixes smaller than their successors are sorted
    directly; the rest is induced by scanning the buckets in order, each
    sorted suffix putting its predecessor at the head of that one's bucket."""
    n = len(t)
    small = types(t)
    head = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=256))])
    direct = sort_direct(np.flatnonzero(small), w)
    n_small = np.bincount(t[direct], minlength=256)
    sa = np.empty(n, np.int64)
    tail = head[1:] - n_small
    first = np.concatenate([[0], np.cumsum(n_small)])
    free = head[:-1].copy()
    for c in np.flatnonzero(n_small):
        sa[tail[c]:head[c + 1]] = direct[first[c]:first[c + 1]]

    def push(js: np.ndarray) -> None:
        p = js[js > 0] - 1
        p = p[~small[p]]
        p = p[t[p] >= t[np.minimum(p + 1, n - 1)]]
        if len(p):
            c = t[p]
            o = np.argsort(c, kind="stable")
            p, c = p[o], c[o]
            chars, at, num = np.unique(c, return_index=True, return_counts=True)
            for x, a, k in zip(chars, at, num):
                sa[free[x]:free[x] + k] = p[a:a + k]
                free[x] += k
    push(np.array([n]))
    for c in range(256):
        done = head[c]
        while done < free[c]:
            upto = free[c]
            push(sa[done:upto])
            done = upto
        if n_small[c]:
            push(sa[tail[c]:head[c + 1]])
    return sa


def common_prefixes(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Common prefix of neighbours in suffix order, up to WIDTH bytes."""
    out = np.full(max(0, len(s) - 1), WIDTH)
    at = np.arange(len(out))
    for d in range(0, WIDTH, 8):
        x = w[s[at] + d] ^ w[s[at + 1] + d]
        off = np.flatnonzero(x)
        lead = sum((x[off] < np.uint64(1 << (64 - 8 * k))).astype(int) for k in range(1, 8))
        out[at[off]] = d + lead
        at = at[x == 0]
    return out


def repeated_windows(parts: list[bytes]) -> list[np.ndarray]:
    """For every part and window start: does the window occur elsewhere in
    the parts?"""
    t = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    valid = np.ones(len(t), bool)
    for e in ends:
        valid[max(0, e - WIDTH + 1):e] = False
    w = words_at(t)
    sa = suffix_array(t, w)
    sa = sa[valid[sa]]
    same = common_prefixes(sa, w) >= WIDTH
    hit = np.zeros(len(t), bool)
    hit[sa[:-1][same]] = True
    hit[sa[1:][same]] = True
    return [hit[e - len(p):e - WIDTH + 1] for p, e in zip(parts, ends)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cols, held = [], 0
        for i, th, text in zip(b["doc_id"], b["th"], b["text"]):
            data = text.encode("utf-8", "surrogatepass")
            m, s, k, again = segments(data)
            c = [int.from_bytes(hashlib.blake2b(data[x:x + n + WIDTH - 1], digest_size=8).digest(), "little", signed=True) for x, n in zip(s.tolist(), k.tolist())]
            cols.append((np.full(len(m), i), np.full(len(m), th, np.int32), m.view(np.int64), np.array(c, np.int64), s.astype(np.int32), k.astype(np.int32), again))
            held += len(m)
            if held > 100_000:
                yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("doc_id", "th", "m", "c", "w0", "nw", "again"), zip(*cols))})
                cols, held = [], 0
        if cols:
            yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(("doc_id", "th", "m", "c", "w0", "nw", "again"), zip(*cols))})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of wanted segments."""
    for b in batches:
        out, held = [], 0
        for text, want in zip(b["text"], b["want"]):
            data = text.encode("utf-8", "surrogatepass")
            for x in want:
                out.append((x["m"], x["c"], x["n"], data[x["w0"]:x["w0"] + x["nw"] + WIDTH - 1]))
                held += x["nw"] + WIDTH
            if held > 16 << 20:
                yield pd.DataFrame(out, columns=["m", "c", "n", "b"])
                out, held = [], 0
        yield pd.DataFrame(out, columns=["m", "c", "n", "b"])


def _mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (m, c); segments of one gram are sorted together,
    small groups in bundles."""
    bundle: list[tuple[int, int, int, bytes]] = []
    group: list[tuple[int, int, int, bytes]] = []
    size = group_size = 0

    def flush(rows):
        hits = repeated_windows([r[3] for r in rows]) if rows else []
        out = [(m, c, _runs(np.ones_like(h) if n > 1 else h)) for (m, c, n, _), h in zip(rows, hits)]
        return pd.DataFrame([r for r in out if r[2]], columns=["m", "c", "runs"])
    for b in batches:
        for row in zip(b["m"], b["c"], b["n"], b["b"]):
            if group and row[0] == group[-1][0] and row[1] == group[-1][1]:
                continue  # a row of documents that was there twice
            if group and row[0] != group[-1][0]:
                bundle, size, group, group_size = bundle + group, size + group_size, [], 0
                if size > BUNDLE:
                    yield flush(bundle)
                    bundle, size = [], 0
            group.append(row)
            group_size += len(row[3])
    yield flush(bundle + group)


def _window_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for m, c, n, data in zip(b["m"], b["c"], b["n"], b["b"]):
            k = len(data) - WIDTH + 1
            yield pd.DataFrame({"m": m, "c": c, "n": n, "off": range(k), "h": [hashlib.blake2b(data[i:i + WIDTH], digest_size=16).digest() for i in range(k)]})


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
            data = text.encode("utf-8", "surrogatepass")
            depth = np.zeros(len(data) + 1, np.int32)
            for s in spans if spans is not None else ():
                depth[s["s"]] += 1
                depth[s["e"]] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((i, len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept`` (the remaining bytes).

    Every byte covered by a 200-byte string that starts at another place too,
    of this or any document, is removed; the input decides, and no string
    crosses documents.  Null text is empty.  Texts under 200 bytes stay whole.
    Repeated rows are copies of each other; rows that share an id but not a
    text are told apart by a hash of the text.  A null id is an id like any.
    Empty table: empty result.  Other columns are not read.

    Copies are settled by counting, so a passage in a third of all documents
    is sorted once.  If one gram has more than HOT different segments, their
    windows are counted by hash over all tasks instead of sorted in one."""
    d = docs.select(F.coalesce(F.col(id_col), F.lit(-1 << 63)).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("th", F.hash("text"))
    seg = written(d.where(F.octet_length("text") >= WIDTH).select("doc_id", "th", "text").mapInPandas(
        _segments, "doc_id long, th int, m long, c long, w0 int, nw int, again boolean"), "segments")
    stat = seg.groupBy("m").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("again").alias("again"))
    stat = stat.where((F.col("k") > 1) | F.col("again")).select("m", ((F.col("lo") == F.col("hi")) & (F.col("k") > 1)).alias("alike"))
    cand = written(seg.join(stat, "m"), "candidates")
    alike = cand.where("alike").select("doc_id", "th", F.col("w0").alias("s"), (F.col("w0") + F.col("nw") + WIDTH - 1).alias("e"))
    mixed = cand.where("not alike")
    content = written(mixed.groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "w0", "nw")).alias("at")), "contents")
    want = content.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th")).agg(
        F.collect_list(F.struct("m", "c", "n", "at.w0", "at.nw")).alias("want"))
    cut = d.join(want, ["doc_id", "th"]).select("text", "want").mapInPandas(_cut, "m long, c long, n long, b binary")
    hot = content.groupBy("m").agg(F.count("*").alias("k")).where(F.col("k") > HOT).select("m")
    runs = "m long, c long, runs array<struct<a:int,k:int>>"
    if hot.take(1):
        cut = written(cut, "cut")
        h = cut.join(hot, "m").dropDuplicates(["m", "c"]).mapInPandas(_window_hashes, "m long, c long, n long, off int, h binary")
        twice = h.groupBy("h").agg(F.sum("n").alias("t")).where("t > 1").select("h")
        by_hash = h.join(twice, "h").select("m", "c", F.array(F.struct(F.col("off").alias("a"), F.lit(1).alias("k"))).alias("runs"))
        cut = cut.join(hot, "m", "left_anti")
    marks = cut.repartition("m").sortWithinPartitions("m", "c").mapInPandas(_mark, runs)
    if hot.take(1):
        marks = marks.unionByName(by_hash)
    marks = written(marks, "marks")
    found = mixed.join(marks, ["m", "c"]).select("doc_id", "th", "w0", F.explode("runs").alias("r")).select(
        "doc_id", "th", (F.col("w0") + F.col("r.a")).alias("s"), (F.col("w0") + F.col("r.a") + F.col("r.k") + WIDTH - 1).alias("e"))
    spans = alike.unionByName(found).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    out = d.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans").mapInPandas(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-1 << 63), F.col("doc_id")))
