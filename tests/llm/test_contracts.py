"""Every operator against a plain statement of its contract, on the smallest
tables."""

from collections import Counter, defaultdict

from loupe.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm import brute as B


def rows(spark, name):
    return [r.asDict() for r in Q.QUERIES[name](spark, SF_SMALL).collect()]


def test_near_duplicates(spark, texts):
    want = B.near_groups([(i, t) for i, t, _ in texts])
    got = rows(spark, "op1_minhash_odd")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_fingerprints(spark, texts):
    got = rows(spark, "op2_iblt_fingerprints")
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in got} == B.edited([(i, t) for i, t, _ in texts])
    by_text = defaultdict(set)
    text = {i: t for i, t, _ in texts}
    for r in got:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.6 and mean("near_next") < 0.1


def test_repeats(spark, texts):
    want = B.repeats([(i, t) for i, t, _ in texts])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op3_suffix_repeats")} == want


def held_out_accuracy(spark, name, label):
    y = {r["doc_id"]: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = [r for r in Q.QUERIES[name](spark, "/root/testdata/sf0.1").collect() if r["doc_id"] in y and r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in got)
    return sum(r["predicted"] == y[r["doc_id"]] for r in got) / len(got)


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, "op4_quality", "quality") > 0.97


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, "op6_toxicity", "toxic") > 0.96


def test_secrets(spark, texts):
    text, kinds = {i: t for i, t, _ in texts}, ("assign", "access", "hex")
    for r in rows(spark, "op5_markov_secrets"):
        spans = B.base_spans(text[r["doc_id"]])
        n = Counter(k for _, k, _ in spans)
        assert r["base_sha256"] == B.sha(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (n[0], n[1], n[2])


def test_mix(spark, texts):
    want = B.targets([(s, len(B.words(t))) for _, t, s in texts])
    source, size = {i: s for i, _, s in texts}, {i: len(B.words(t)) for i, t, _ in texts}
    taken, got = Counter(), rows(spark, "op7_budget_mix")
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        assert r["source_size"] == want[s][0] and abs(r["target"] - want[s][1]) < 1e-6
        taken[s] += r["taken"]
    # ten documents a source: some subset comes within the smallest one
    assert all(abs(taken[s] - t) <= 0.05 * t + 60 for s, (_, t) in want.items())
    assert sorted(map(repr, got)) == sorted(map(repr, rows(spark, "op7_budget_mix")))


def test_decontamination(spark, texts):
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = B.windows_hit([(i, t) for i, t, _ in texts], bench)
    for r in rows(spark, "op8_decontaminate"):
        n, hit, items = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(items), B.sha(",".join(items)))
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_chat(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    own = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", own), (1, "assistant", own)]
    got = rows(spark, "op9_chat_windows")
    assert {r["conv_id"] for r in got} == set(turns)
    for r in got:
        t = sorted(turns[r["conv_id"]])
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(t), len(loss))
        assert r["turns_sha256"] == B.sha("".join(f"{role}\n{x}\n" for _, role, x in t)) and r["loss_sha256"] == B.sha(loss)


def test_sql_oracles(spark, duck):
    for name, sql in Q.ORACLES.items():
        c = duck.execute(sql)
        cols = [x[0] for x in c.description]
        want = sorted(repr(r) for r in c.fetchall())
        assert sorted(repr(tuple(r[k] for k in cols)) for r in rows(spark, name)) == want, name
