"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause's words become symbols (insult, threat, second person, named target,
negation, reported speech, other).  Small weighted transducers run over the
symbols: one adds the weights of insults and threats, others raise them next
to a target, lower them under a negation or in reported speech.  Which words
are insults, and how much they weigh, is learned from labelled rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import crc_fold, written

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
# Closed word classes of the grammar (en, de, fr, es).
TARGET = frozenset("you your yours yourself u ur they them people du dich dir dein deine ihr euch tu te toi vous votre tú ti usted ustedes vosotros".split())
NEGATION = frozenset("not no never isn aren don doesn didn wasn won cannot without nicht kein keine nie pas jamais aucun nunca jamás sin".split())
REPORT = frozenset("said says say claimed claims wrote writes called quoted reported alleged sagte schrieb behauptet dit déclaré écrit dijo dice escribió".split())
THREAT = frozenset("kill hurt destroy burn shoot stab strangle beat töten verletzen umbringen tuer frapper détruire matar golpear destruir".split())
STEMS = (5, 4)  # first letters of longer words
NEAR, DAMP_NEGATED, DAMP_REPORTED, RAISE_TARGET, THREAT_WEIGHT = 3, 0.25, 0.5, 1.25, 2.0
CUT = 0.7  # scores from here on are predicted toxic


def tokens(text: str) -> set[str]:
    """Words of a text, and the stems (first letters) of its longer words."""
    w = set(WORD.findall(text.lower()))
    return w | {"^" + x[:n] for n in STEMS for x in w if len(x) > n}


def insult_weight(w: str, weight: dict[str, float]) -> float:
    """The learned weight of a word, or of its longest learned stem."""
    return weight.get(w, 0.0) or next((weight[s] for n in STEMS if len(w) > n and (s := "^" + w[:n]) in weight), 0.0)


def clause_score(clause: list[str], weight: dict[str, float]) -> float:
    """Run the transducers over one clause, left to right.

    State: words since the last negation, whether reported speech opened the
    clause part, and whether a target was seen.  An insult emits its weight,
    scaled by the state; a threat emits only with a target; a target after an
    insult raises what the clause has so far."""
    total, raised, since_neg, reported, target, threat = 0.0, False, NEAR + 1, False, False, False
    for w in clause:
        since_neg += 1
        if w in NEGATION:
            since_neg = 0
        elif w in REPORT:
            reported = True
        elif w in TARGET:
            target = True
        out = insult_weight(w, weight)
        if not out and w in THREAT:
            threat = threat or since_neg > NEAR
        if out:
            out *= DAMP_NEGATED if since_neg <= NEAR else 1.0
            out *= DAMP_REPORTED if reported else 1.0
            total += out
            raised = True
    if raised and target:
        total *= RAISE_TARGET
    if threat and target:
        total += THREAT_WEIGHT * (DAMP_REPORTED if reported else 1.0)
    return total


def text_score(text: str | None, weight: dict[str, float]) -> float:
    """Sum of clause scores; 0 without words."""
    low = (text or "").lower()
    return sum(clause_score(WORD.findall(c), weight) for c in CLAUSE.split(low))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """Texts and labels of at most ``max_rows`` labelled training rows, the first in the
    order of a hash of the id.  The ids are at most that many longs, so they
    are broadcast and texts are not shuffled."""
    y = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 3) != 1))
    y = y.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    y = written(y, "toxic_ids")
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with a token, counted within the batch: memory and shuffle hold
    distinct tokens only."""
    for b in batches:
        n = Counter()
        for text, y in zip(b["text"], b["y"]):
            n.update((t, int(y)) for t in tokens(text))
        yield pd.DataFrame([(t, y, k) for (t, y), k in n.items()], columns=["token", "y", "n"])


def learn_weights(rows: DataFrame) -> dict[str, float]:
    """Token weights (log odds).

    A token is an insult if toxic rows hold it at least ten times as often and
    a likelihood-ratio test stands after correction for all tokens tried.
    Without rows of both classes nothing is learned."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}
    c = rows.select("text", "y").mapInPandas(_count, "token string, y int, n long").groupBy("token").agg(
        F.sum(F.col("y") * F.col("n")).alias("a"), F.sum((1 - F.col("y")) * F.col("n")).alias("b"))
    c = c.where("a >= 3")
    tried = math.log(max(2, c.count()))
    xlog = lambda x, p: F.when(x > 0, x * F.log(x / p)).otherwise(0.0)
    a, b, share = F.col("a"), F.col("b"), n1 / (n1 + n0)
    g2 = 2 * (xlog(a, (a + b) * share) + xlog(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    found = c.select("token", odds.alias("w"), g2.alias("g2")).where((F.col("g2") > 2 * tried + 8) & (F.col("w") > math.log(10)))
    return {r["token"]: r["w"] for r in found.collect()}  # bounded by the training rows


def raw_score(weight: dict[str, float], text: Column) -> Column:
    """The clause scores' sum as a column: other columns stay in the JVM."""
    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([text_score(x, weight) for x in t], dtype="float64")
    return run(text)


def calibrate(train: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Logistic slope and offset of log(1 + raw) by Newton steps over a table
    of at most 200 score cells."""
    cell = F.least(F.lit(199), F.floor(F.log1p("raw") * 20)).cast("int")
    rows = train.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg(F.log1p("raw")).alias("x")).collect()
    a, b = 1.0, -1.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = -0.01 * a, -0.01 * b, 0.01, 0.0, 0.01
        for r in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * r["x"] + b))))
            e, v = r["y"] - r["n"] * p, r["n"] * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + e * r["x"], gb + e, haa + v * r["x"] ** 2, hab + v * r["x"], hbb + v
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a + da / size, b + db / size
    return max(a, 1e-3), b


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = 20_000) -> tuple[dict[str, float], float, float]:
    """Insult weights, and slope and offset of the score, from at most
    ``max_rows`` labelled rows whose fold is not 1."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows)
    weight = learn_weights(rows)
    if not weight:
        return {}, 1.0, -2.0
    return weight, *calibrate(rows.select("y", raw_score(weight, F.col("text")).alias("raw")))


def toxicity(model: tuple[dict[str, float], float, float], text: Column) -> Column:
    """Score (0 to 1) of a text."""
    weight, a, b = model
    return 1 / (1 + F.exp(-(F.log1p(raw_score(weight, text)) * a + b)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", max_rows: int = 20_000) -> DataFrame:
    """One row per document: ``doc_id, text_hash, held_out, score,
    predicted``.

    Learns from at most ``max_rows`` labelled rows whose fold is not 1; every
    document is scored over its whole text.  Null and empty texts score like
    texts without a match.  Several labels of one id: the largest counts; rows
    that share an id are scored apart; a null id is not held out.  Empty
    labels leave only the grammar's threats.  Other columns are not read."""
    model = learn(docs, labels, id_col, text_col, label_col, max_rows)
    out = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), toxicity(model, F.col(text_col)).alias("score"))
    return out.select("doc_id", "text_hash", F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
