"""Whitening, importance draw and ordered Jaccard join against plain
statements of their contracts, and their odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loupe.llm import importance_draw, ordered_jaccard, spectral_whitening
from loupe.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm import brute as B

BIG = 2**53 + 1


def by_whitening(rows):
    """(vec_id, component) -> (n, deviation, |whitened|, explained)."""
    x = [(i, np.floor(256 * np.asarray(v, np.float64)).astype(np.int64)) for i, v in rows]
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T, bias=True)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, v in x:
        for c in range(min(4, len(e))):
            out[i, c + 1] = (n, int(((n * v - s) ** 2).sum()), abs((v - s / n) @ q[:, c] / math.sqrt(e[c])), e[c] / np.trace(cov))
    return out


def test_whitening(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = by_whitening(rows)
    got = Q.op11_spectral_whitening(spark, SF_SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        n, dev, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev) and r.identity_error <= 1e-10
        assert abs(abs(r.whitened) - w) < 1e-8 and abs(r.explained - share) < 1e-10
    for c in range(1, 5):  # one sign for all rows
        signs = {np.sign(r.whitened) == np.sign(w) for r in got if r.component == c
                 for w in [B_sign(rows, c)[r.vec_id]] if abs(w) > 1e-6}
        assert len(signs) == 1


def B_sign(rows, c, cache={}):
    if c not in cache:
        x = np.floor(256 * np.array([v for _, v in rows], np.float64))
        fit = np.unique(x, axis=0)
        q = np.linalg.eigh(np.cov(fit.T, bias=True))[1][:, ::-1][:, c - 1]
        cache[c] = {i: float(v) for (i, _), v in zip(rows, (x - fit.mean(axis=0)) @ q)}
    return cache[c]


def test_whitening_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * [5, 4, 3, 2, 1, 0.5]).tolist()) for i in range(600)]
    want = by_whitening(rows)
    got = spectral_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)).collect()
    assert len(got) == 2400
    for r in got:
        n, dev, w, share = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, dev) and abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - share) < 1e-12


def test_whitening_odd_rows(spark):
    kinds = "vec_id long, embedding array<float>, x int, w string, part int"
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [3.0, 2.0]),
            (6, [3.0, 2.0]), (None, [5.0, 2.0]), (BIG, [7.0, 2.0]), (BIG + 2, [1.0]), (8, [])]
    df = spark.createDataFrame([(i, v, 1, "w", 2) for i, v in rows], kinds)
    got = spectral_whitening.whiten(df).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i in (1, 6, 6, None, BIG, BIG + 2, 8) for c in (1, 2))
    assert {r.n for r in got} == {6}  # zeros fill up [1.0] and []
    flat = spectral_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(flat) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in flat)
    assert spectral_whitening.whiten(df.limit(0)).count() == 0 and spectral_whitening.whiten(df.where("vec_id = 8")).count() == 0
    huge = spark.createDataFrame([(1, [1e12, 2.0]), (2, [-1e12, 1.0])], "vec_id long, embedding array<double>")
    assert {int(r.deviation) for r in spectral_whitening.whiten(huge).collect()} == {(2 * 256 * 10**12) ** 2 + 256**2}


@pytest.mark.parametrize("x", [np.eye(12, dtype=int) * 5, np.zeros((5, 4), int), np.outer(np.arange(40), np.ones(6, int)),
                               np.repeat(np.random.default_rng(1).integers(-3, 3, (30, 8)), 2, axis=0),
                               np.random.default_rng(2).integers(-10**6, 10**6, (80, 20)) * ([1] * 10 + [0] * 10)])
def test_rank_one_updates(x):
    """Repeated, zero and close eigenvalues; one spectrum and two combined."""
    a, b, c = (spectral_whitening.Spectrum(x.shape[1]) for _ in range(3))
    a.add(x)
    b.add(x[:7])
    c.add(x[7:])
    b.merge(c)
    y = x - x.mean(axis=0)
    for s in (a, b):
        size = max(np.abs(y.T @ y).max(), 1)
        assert np.abs(s.q * s.lam @ s.q.T - y.T @ y).max() <= 1e-13 * size and np.abs(s.q.T @ s.q - np.eye(x.shape[1])).max() < 1e-12
        assert s.total == x.sum(axis=0).tolist() and s.n == len(x)


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(B.LOW))


def by_draw(docs, bench, n_max=1, buckets=10_000):
    grams = lambda t: [" ".join(w[i:i + n]) for w in [cut(t)] for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)), Counter(bucket(g) for x in bench for g in grams(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, x in docs:
        g = [gain(bucket(y)) for y in grams(x)]
        w = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(cut(x))])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): n + 1 for n, r in enumerate(able[:len(able) * 10 // 100])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def test_importance_draw(spark, texts):
    docs, bench = [(i, t) for i, t, _ in texts], [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = Q.op12_importance_draw(spark, SF_SMALL).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == by_draw(docs, bench)


@pytest.mark.parametrize("n_max", [2, 3])
def test_importance_draw_of_longer_grams(spark, n_max):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["a", "B", "cé", "d1", "e"]) for _ in range(rng.choice([0, 1, 2, 25, 40])))) for i in range(60)] + [(None, None), (BIG, "a . b")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), ["a b a b", "", None, "e"]
    got = importance_draw.importance_draw(df.repartition(7), spark.createDataFrame([(t,) for t in bench], "text string"), n_max=n_max, buckets=50)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == by_draw(docs, bench, n_max, 50)


def test_importance_draw_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    empty = spark.createDataFrame([], "text string")
    got = importance_draw.importance_draw(odd_docs, empty, percent=50).collect()
    assert len(got) == 13 and Counter((r.doc_id, r.n_features) for r in got) == Counter((i, len(cut(t))) for i, t in docs)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 4))  # 7 have 20 words
    assert importance_draw.importance_draw(no_docs, empty).count() == 0
    ids = spark.createDataFrame([(BIG, "x " * 30), (BIG + 2, "x " * 30), (None, "x " * 30)], "doc_id long, text string")
    got = importance_draw.importance_draw(ids, empty, percent=100).collect()
    assert {r.doc_id for r in got} == {BIG, BIG + 2, None} and sorted(r.rank for r in got) == [1, 2, 3]


def four_word_groups(rows, monkeypatch):
    monkeypatch.setattr(B, "shingles", lambda t: {tuple(w[i:i + 4]) for w in [B.words(t)] for i in range(max(1, len(w) - 3))} if B.words(t) else set())
    return B.near_groups(rows)


def test_ordered_jaccard(spark, texts, monkeypatch):
    want = four_word_groups([(i, t) for i, t, _ in texts], monkeypatch)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op13_ordered_jaccard(spark, SF_SMALL).collect()} == want


def test_ordered_jaccard_in_blocks(spark, monkeypatch):
    """Copies that link only with some others, beside boilerplate that many
    unlike texts share; small blocks, so that pairs of blocks occur."""
    rng = random.Random(3)
    base, common = [f"w{rng.randrange(10**6)}" for _ in range(120)], [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for p in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[p] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 8, 60]))])) for i in range(60)]
    rows += [(2000 + i, " ".join(["x"] * rng.choice([1, 2, 3, 4, 9]))) for i in range(20)]
    want = {i: c for i, (_, c) in four_word_groups(rows, monkeypatch).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ordered_jaccard.jaccard_join(df).collect()} == want
    monkeypatch.setattr(ordered_jaccard, "BLOCK", 8)
    assert {r.doc_id: r.component_id for r in ordered_jaccard.jaccard_join(df).collect()} == want


def test_order_filters_lose_no_pair():
    """Every linked pair shares a kept token of order 1 and 2 and passes the
    bounds of orders 3 and 4, at several thresholds and sizes."""
    rng = np.random.default_rng(7)
    for percent in (50, 80, 85, 100):
        for n in (1, 2, 6, 7, 20, 48, 200, 900):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = (100 - percent) * len(a) // 100
            for gone in {0, most // 2, most}:
                b = np.sort(rng.choice(a, len(a) - gone, replace=False))
                b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, rng.integers(0, 2), dtype=np.uint64)]))
                if not len(b) or not ordered_jaccard.linked(a, b, percent):
                    continue
                df, kept = {}, []
                for s in (a, b):
                    df |= {x: int(rng.integers(2, 50)) for x in s.tolist() if x not in df}
                for s in (a, b):
                    longer, spare = ordered_jaccard.prefix_lengths(len(s), percent)
                    kept.append(set(sorted(s[:longer].tolist(), key=lambda x: (df[x], x))[:longer - spare]))
                assert kept[0] & kept[1]
                orders = [tuple(ordered_jaccard.order_prefix(s, x, percent) for s in (a, b)) for x in ordered_jaccard.SEEDS]
                assert ordered_jaccard.may_link(len(a), len(b), (ordered_jaccard.bitmap(a), ordered_jaccard.bitmap(b)), orders, percent)


def test_ordered_jaccard_odd_rows(spark, odd_docs, no_docs):
    got = ordered_jaccard.jaccard_join(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 13 and ordered_jaccard.jaccard_join(no_docs).count() == 0
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert by[2].component_id == by[3].component_id == 1 and by[7].component_id == 6 and by[10].component_id == 10
    assert by[4].n_shingles == by[5].n_shingles == by[9].n_shingles == 0 and by[8].n_shingles == 1
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(BIG, same), (BIG + 2, same + " z"), (None, same), (5, "a b c d e"), (5, "unlike text of the same id")] + [(7, same + " y")] * 40
    got = ordered_jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 45 and {r.component_id for r in got if r.doc_id in (BIG, BIG + 2, 7)} == {7}
    assert {r.doc_id for r in got} == {BIG, BIG + 2, None, 5, 7}


def test_block_candidates_are_all_unlinked_pairs_within_the_bounds(monkeypatch):
    rng, percent = np.random.default_rng(9), 85
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(base[rng.random(400) < rng.choice([0.1, 0.9, 0.97])]) for _ in range(70)]
    n, comp, side = np.array([len(s) for s in sets]), rng.integers(0, 40, 70), rng.integers(0, 2, 70)
    bits = [ordered_jaccard.bitmap(s) for s in sets]
    for at_once in (1 << 19, 100):
        monkeypatch.setattr(ordered_jaccard, "PAIR_WORDS", at_once)
        for two in (False, True):
            got = [(int(i), int(j)) for i, rest in ordered_jaccard.candidates(n, comp, side, bits, two, percent) for j in rest]
            want = {(i, j) for i in range(70) for j in range(i) if comp[i] != comp[j] and not (two and side[i] == side[j])
                    and 100 * min(n[i], n[j]) >= percent * max(n[i], n[j])
                    and ordered_jaccard.bits_apart(bits[i], bits[j]) <= ordered_jaccard.most_unequal(n[i], n[j], percent)}
            assert len(got) == len(want) > 100 and {(max(p), min(p)) for p in got} == want


def test_ordered_jaccard_blocks_skip_pairs_that_met(spark, monkeypatch):
    """Groups of two met at the pivot: no block has only two members, and links are kept."""
    docs = [" ".join(f"w{d}x{j}" if d % 2 and j % 9 == 0 else f"w{d // 2}y{j}" for j in range(60)) for d in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    seen, real = [], ordered_jaccard.written

    def held(x, name, *a):
        out = real(x, name, *a)
        if name == "ordered-mixed":
            seen.append(out.count())
        return out
    monkeypatch.setattr(ordered_jaccard, "written", held)
    got = {r.doc_id: r.component_id for r in ordered_jaccard.jaccard_join(df).collect()}
    assert got == {i: i for i in range(40)} and seen == [0]
