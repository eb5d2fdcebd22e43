"""Ids of 2^53 and more beside null ids stay exact in every operator and
stage, and no document is lost."""

from collections import Counter

import pytest

import corpus_pipeline
from loupe.llm import (decontam_join, importance_draw, markov_secrets, minhash_odd, mix_budget, ordered_jaccard, quality_rff,
                       suffix_dedup, toxicity_grammar)

A, B, C = 2**53 + 1, 2**53 + 3, -(2**60) - 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(A, "one text of its own with some words in it"), (B, "another text that is quite unlike all others here"), (None, "a text without an id at all"),
            (C, None), (None, None)]
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


OPERATORS = {
    "op1": lambda d, t: minhash_odd.near_duplicates(d), "op3": lambda d, t: suffix_dedup.remove_repeats(d),
    "op4": lambda d, t: quality_rff.score_quality(d, t["labels"]), "op5": lambda d, t: markov_secrets.find_secrets(d),
    "op6": lambda d, t: toxicity_grammar.score_toxicity(d, t["labels"]), "op7": lambda d, t: mix_budget.mix_to_weights(d),
    "op8": lambda d, t: decontam_join.contamination(d, t["benchmark"]), "op12": lambda d, t: importance_draw.importance_draw(d, t["benchmark"]),
    "op13": lambda d, t: ordered_jaccard.jaccard_join(d)}


@pytest.fixture(scope="module")
def tables(spark):
    return {"labels": spark.createDataFrame([(A, 1, 0), (B, 0, 1)], "doc_id long, quality int, toxic int"),
            "benchmark": spark.createDataFrame([(1, "words that no text has")], "item_id long, text string")}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, tables, name):
    got = OPERATORS[name](docs.coalesce(1), tables).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter({A: 1, B: 1, C: 1, None: 2})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, tables, tmp_path, name, stage):
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    got = Counter(r.doc_id for r in stage(spark, docs.coalesce(1), str(tmp_path)).select("doc_id").collect())
    if name == "mix":  # texts without words are never taken, others up to twice
        assert got and got <= Counter({A: 2, B: 2, None: 2})
    else:
        assert got == Counter({A: 1, B: 1, C: 1, None: 2})


def test_mix_is_the_mixed_corpus(spark):
    """Every document as often as the mix takes it, rows of one id apart."""
    rows = [(i % 7 if i < 20 else None, f"text {i % 9} " * (i % 5 + 1), "en", "ab"[i % 2], i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mix = mix_budget.mix_to_weights(docs)
    want = Counter()
    for r in mix.collect():
        want[r.doc_id, r.text_hash] += r.copies
    got = Counter((r.doc_id, r.h) for r in corpus_pipeline.mix(spark, docs, "").selectExpr("doc_id", "xxhash64(text) AS h").collect())
    assert got == +want and sum(got.values()) > 0
