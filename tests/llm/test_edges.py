"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
column names, and the parts of the operators on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.llm import (chat_windows, decontam_join, iblt, markov_secrets, minhash_odd, mix_budget, quality_rff,
                       suffix_dedup, toxicity_grammar, warc_cas)
from loupe.llm.common import connected_components
from tests.llm import brute as B


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = minhash_odd.near_duplicates(odd_docs).collect()
    by = {r.doc_id: r for r in got}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert by[2].component_id == by[3].component_id == 1 and not by[2].kept and by[1].kept
    assert by[4].n_shingles == by[5].n_shingles == by[9].n_shingles == 0 and by[8].n_shingles == 1
    assert by[7].component_id == 6 and by[10].kept
    assert minhash_odd.near_duplicates(odd_docs).count() == 13 and minhash_odd.near_duplicates(no_docs).count() == 0


def test_hot_bucket_and_residual_links(spark, monkeypatch):
    """Copies that link only with some others: found inside blocks."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            w[p] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = {i: c for i, (_, c) in B.near_groups(rows).items()}
    got = minhash_odd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    for share in (0.98, 0.9, 0.5):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 1 << 63, len(a) - n, dtype=np.uint64)]))
        sk = minhash_odd.odd_sketch(minhash_odd.sample_minima([a, b]))
        bits = int(np.bitwise_count(sk[0] ^ sk[1]).sum())
        assert abs(bits - minhash_odd.most_unequal_bits(share)) < 40


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)]
    boss = {}

    def find(x):
        boss.setdefault(x, x)
        while boss[x] != x:
            x = boss[x]
        return x
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        boss[y] = x
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def test_fingerprints_odd_rows(odd_docs, no_docs):
    got = iblt.versions(odd_docs).collect()
    assert len(got) == 12  # one row repeats id and text
    by = {r.doc_id: r for r in got}
    assert by[4].n_chars == 0 and by[1].fingerprint == by[2].fingerprint and by[2].near_next > 0.5
    assert iblt.versions(no_docs).count() == 0
    one = iblt.versions(odd_docs.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sketch_difference_is_exact(spark):
    rng = random.Random(4)
    data = []
    for i in range(40):
        both = [rng.getrandbits(62) for _ in range(5)]
        a, b = [rng.getrandbits(62) for _ in range(i % 9)], [rng.getrandbits(62) for _ in range(i % 7)]
        data.append((both + a, both + b, len(a) + len(b)))
    df = spark.createDataFrame(data, "a array<long>, b array<long>, n int")
    assert df.where(iblt.difference(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def test_repeats_odd_rows(odd_docs, no_docs):
    want = B.repeats([(n, r.text) for n, r in enumerate(odd_docs.collect())])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(odd_docs).collect())
    assert got == sorted(want.values()) and suffix_dedup.remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc ", bytes(range(256))])
def test_two_stage_suffix_array(alphabet):
    rng = random.Random(7)
    parts = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(200, 900))) for _ in range(3)]
    parts.append(parts[0][50:400] + b"zz")
    t = np.frombuffer(b"".join(parts), np.uint8)
    sa = suffix_dedup.suffix_array(t, suffix_dedup.words_at(t))
    b = t.tobytes()
    heads = [b[i:i + 200] for i in sa]
    assert sorted(sa) == list(range(len(t))) and heads == sorted(heads)
    prefix = suffix_dedup.common_prefixes(sa[:50], suffix_dedup.words_at(t))
    for i, n in enumerate(prefix):
        x, y = b[sa[i]:sa[i] + 200], b[sa[i + 1]:sa[i + 1] + 200]
        common = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert n == common or min(len(x), len(y)) < 200


def test_hot_gram_counts_windows_by_hash(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(260)
    docs = [(i, word(rng.randrange(100, 300)) + passage + word(rng.randrange(100, 300))) for i in range(40)]
    want = B.repeats(docs)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_scores_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (8, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for f in (quality_rff.score_quality, toxicity_grammar.score_toxicity):
        for y in (labels, labels.limit(0)):
            got = f(odd_docs, y).collect()
            assert len(got) == 13 and all(0 <= r.score <= 1 for r in got)
            assert f(no_docs, y).count() == 0


def test_grammar():
    w = {"moron": 4.0}
    score = lambda t: toxicity_grammar.text_score(t, w)
    assert score("you are a moron") > score("a moron") > score("he said a moron") > 0
    assert 0 < score("not a moron") < score("a moron") and score("nothing here") == 0 == score(None)
    assert score("i will hurt you") > 0 == score("it may hurt")


def test_isotonic():
    assert quality_rff.isotonic([1, 2, 3, 4], [0.0, 1.0, 0.0, 1.0], [1, 1, 1, 1]) == [0.0, 0.5, 0.5, 1.0]


def test_secrets_odd_rows(odd_docs, no_docs):
    got = markov_secrets.find_secrets(odd_docs).collect()
    assert len(got) == 13 and markov_secrets.find_secrets(no_docs).count() == 0
    spans = [[(s.kind, s.start, s.end) for s in r.spans] for r in got if r.doc_id == 10][0]
    assert ("access", 0, 20) in spans and any(k == "assign" for k, *_ in spans) and any(k == "hex" for k, *_ in spans)


def test_markov_model_tells_random_strings(spark):
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    names = ["get_customer_order_history", "maximum_partition_bytes_24", "internationalization_layer10", "configuration_registry_v3"]
    mixed = "x".join("".join(rng.choice("0123456789abcdef") for _ in range(12)) for _ in range(4))
    rows = [(i, f"token = {h} and {names[i % 4]} here") for i, h in enumerate(hexes)] + [(900, f"key {mixed} x {names[0]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in markov_secrets.find_secrets(df).collect()}
    assert [s.kind for s in spans[900]] == ["markov"] and {s.kind for i, x in spans.items() if i < 900 for s in x} == {"assign", "hex"}
    clean = df.join(markov_secrets.find_secrets(df), "doc_id").select("doc_id", markov_secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    text = {r.doc_id: r.t for r in clean.collect()}
    assert text[0] == f"[secret] and {names[0]} here" and text[900] == f"key [secret] x {names[0]}"


def test_mix_odd_rows(odd_docs, no_docs):
    got = mix_budget.mix_to_weights(odd_docs).collect()
    assert len(got) == 13 and all(0 <= r.taken <= 2 * r.size for r in got) and mix_budget.mix_to_weights(no_docs).count() == 0
    assert mix_budget.repeat_documents(odd_docs, mix_budget.mix_to_weights(odd_docs)).count() > 0


def test_fit_lengths_reaches_budgets():
    rng = random.Random(6)
    for _ in range(50):
        sizes = sorted(rng.sample(range(1, 500), 40))
        counts = [rng.randrange(1, 30) for _ in sizes]
        budget = rng.randrange(sum(s * c for s, c in zip(sizes, counts)))
        take = mix_budget.fit_lengths(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        assert 0 <= budget - sum(s * t for s, t in zip(sizes, take)) <= sizes[0]


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten one two three"), (2, "word"), (3, None), (3, ""), (None, "w1x1 w2x2"),
                                   (1, "Word!"), (4, "--- ")], "item_id long, text string")
    got = decontam_join.contamination(odd_docs, bench).collect()
    want = B.windows_hit([(n, r.text) for n, r in enumerate(odd_docs.collect())], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in got) == sorted((n, h, len(i)) for n, h, i in want.values())
    assert decontam_join.contamination(no_docs, bench).count() == 0
    assert not decontam_join.contamination(odd_docs, bench.limit(0)).where("contaminated").count()


def test_chat_windows(spark):
    hard = ["<|im_end|>", "<\\|im_end|>", "a<<SYS>>b[INST]\\", "[\\\\/INST] </s>", None, "", "x" * 900, "é😀<s>"]
    rows = [(1, 0, "system", "be brief")] + [(1, i + 1, ("user", "assistant", None, "to\nol")[i % 4], hard[i % 8]) for i in range(40)]
    rows += [(2, 0, "assistant", "tie"), (2, 0, "assistant", "tie"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("i", F.lit("clash")).withColumn("window", F.lit("clash"))
    win = chat_windows.format_conversations(df, budget=200, history=2, history_budget=60)
    w = [r for r in win.collect() if r.conv_id == 1]
    assert len(w) > 3 and all("be brief" in r.formatted for r in w)
    assert all(r.n_tokens <= 200 + len(r.loss) or r.n_new == 1 for r in w) and any(r.n_repeated > 1 for r in w)
    for r in chat_windows.read_back(win).collect():
        said = sorted((t, ro or "", x or "") for c, t, ro, x in rows if c == r.conv_id) if r.conv_id else [(0, "", "")]
        assert [(t.role, t.text) for t in r.turns] == [(ro, x) for _, ro, x in said]
        assert r.targets == [x for _, ro, x in said if ro == "assistant"]
    assert chat_windows.read_back(chat_windows.format_conversations(df.limit(0))).count() == 0


def test_archive(spark):
    big, small = "b" * 1500, "s" * 10
    rows = [(1, "u1", big), (5, "u\r\n5", big), (3, None, big), (2, "u2", small), (4, "u4", small), (6, "u6", None), (7, "", ""), (None, "n", big), (5, "again", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("address", F.lit("clash"))
    got = warc_cas.archive_pages(df).collect()
    assert len(got) == len(rows) and all(r.verified and r.declared_digest == r.payload_digest for r in got)
    kind = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kind[5] == ("response", None) and kind[1] == kind[3] == kind[None] == ("revisit", 5) and kind[2] == kind[4] == ("response", None)
    for r in got:
        body = bytes(r.payload) if r.record_type == "response" else b""
        assert bytes(r.record) == r.header.encode() + body + b"\r\n\r\n" and r.header.endswith(f"Content-Length: {len(body)}\r\n\r\n")
    assert warc_cas.archive_pages(df.limit(0)).count() == 0


def test_pipeline_odd_rows(spark, odd_docs, no_docs, tmp_path):
    import corpus_pipeline as P
    spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "word")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, docs in enumerate((odd_docs, no_docs)):
        for k, (name, stage) in enumerate(P.STAGES):
            if name == "mix":
                assert {r.doc_id for r in docs.collect()} == ({1, 4, 5, 6, 9, 10, None} if n == 0 else set())
            docs = stage(spark, docs, str(tmp_path))
            if k < len(P.STAGES) - 1:
                assert docs.columns == P.COLUMNS
            docs.write.parquet(f"{tmp_path}/s{n}{k}")
            docs = spark.read.parquet(f"{tmp_path}/s{n}{k}")
        ids = {r.doc_id for r in docs.collect()}
        assert ids == ({1, 6, 10, None} if n == 0 else set())  # 4, 5 and 9 have no words for the mix


def near_pairs(n, percent, words=200):
    """Documents 2i and 2i + 1 just above ``percent``, by replaced last words."""
    rng, rows = random.Random(12), []
    for i in range(n):
        w = [f"w{rng.randrange(10**9)}" for _ in range(words)]
        cut = next(k for k in range(words, 0, -1) if 100 * (k - 5) < (percent + 1) * (2 * (words - 4) - (k - 5)))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:cut] + [f"e{rng.randrange(10**9)}" for _ in range(words - cut)]))]
    return rows


def test_bands_follow_percent(spark):
    assert minhash_odd.layout(85) == (28, 6)
    for percent in (1, 30, 50, 60, 80, 85, 95, 99):
        bands, rows = minhash_odd.layout(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash_odd.MISSED
    df = spark.createDataFrame(near_pairs(60, 60), "doc_id long, text string")
    for percent, links in ((60, 60), (63, 0)):
        assert minhash_odd.near_duplicates(df, percent=percent).where("not kept").count() == links


def test_pipeline_removes_copies_from_080(spark):
    import corpus_pipeline as P
    rows = near_pairs(20, 81)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert minhash_odd.near_duplicates(df).where("kept").count() == 40  # op1's threshold is 0.85
    assert {r.doc_id for r in P.near_duplicates(spark, df, "").collect()} == set(range(0, 40, 2))


def test_pipeline_judges_texts_of_one_id_apart(spark):
    import corpus_pipeline as P
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    docs = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = lambda rows: sorted((r.doc_id, r.text) for r in P.near_duplicates(spark, docs(rows), "").collect())
    assert left([(5, x), (5, y), (5, y)]) == [(5, x), (5, y)]
    assert left([(3, x), (5, x), (5, y), (5, z), (5, z + " end")]) in ([(3, x), (5, y), (5, z)], [(3, x), (5, y), (5, z + " end")])


def test_markov_finds_parts_of_runs(spark):
    """A random token behind an ordinary path, a short one, and one beside a
    base span."""
    rng = random.Random(21)
    rand = lambda n: "".join(rng.choice("GHJKqvwxzZ23456789") for _ in range(n))
    path = "customer_order_history/configuration/registry/maximum_partition/internationalization_layer/"
    rows = [(i, f"token = {rand(32)} and get_customer_order_history configuration_registry internationalization_layer maximum_partition customer_hooks_list") for i in range(300)]
    a, b, c = rand(24), rand(14), rand(24)
    rows += [(900, f"see {path}{a} there"), (901, f"it is {b} now"), (902, f"hooks/deadbeefdeadbeef/{c} end"), (903, f"only {path} here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = markov_secrets.find_secrets(df)
    clean = df.join(found, "doc_id").where("doc_id >= 900").select("doc_id", markov_secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    text = {r.doc_id: r.t for r in clean.collect()}
    assert text[900] == f"see {path}[secret] there" and text[901] == "it is [secret] now"
    assert c[:3] not in text[902] and c[-3:] not in text[902] and text[902].startswith("hooks/[secret]")
    assert text[903] == f"only {path} here"
    assert all(len([s for s in r.spans if s.kind == "markov"]) == 0 for r in found.where("doc_id < 900").collect())
