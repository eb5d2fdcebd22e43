"""Flat text folders, templates filled by position, the additive forecast, the
word cloud and number labels."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from loupe.functions import text as T
from loupe.operators import forecast as FC
from loupe.operators import relate as R
from loupe.operators import wordcloud as W
from loupe.sources import files as FS
from tests.conftest import SF_SMALL


def test_flat_folder_of_ten_thousand_files(spark, tmp_path):
    n = 10_000
    for i in range(n):
        (tmp_path / f"{i:05d}.txt").write_text(f"text {i}\nline two {i}\n")
    (tmp_path / "a b+c.txt").write_text("odd name")
    (tmp_path / "notes.md").write_text("not one")
    df = FS.read_texts(spark, str(tmp_path), "id")
    assert df.rdd.getNumPartitions() <= 8
    got = {r["id"]: r["text"] for r in df.collect()}
    assert len(got) == n + 1 and got["00042"] == "text 42\nline two 42" and got["a b+c"] == "odd name"
    ids = spark.createDataFrame([("00007",), ("09999",), ("missing",), (None,), ("00007",)], "id string")
    some = FS.read_texts(spark, str(tmp_path), "id", ids)
    os.chmod(tmp_path / "00008.txt", 0)  # never opened
    assert sorted((r["id"], r["file_name"]) for r in some.collect()) == [("00007", "00007.txt"), ("09999", "09999.txt")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "00007.txt" in plan


def test_texts_are_written_as_one_file_a_key_and_read_back_whole(spark, tmp_path):
    texts = {"a/b": "ends in breaks\n\n", "p+q %": "x\n\u2028", "7": "", "é": "line\r\n", "8": None, None: "no key"}
    texts |= {f"n{i}": f"text {i}\n{i}" for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "id string, body string").repartition(4)
    FS.write_texts(df, "id", "body", f"file://{tmp_path}/t")
    files = [f for _, _, names in os.walk(tmp_path / "t") for f in names]
    assert len(files) == len(texts) - 1 and all(f.endswith(".txt") for f in files)  # no checksum beside each
    want = {k: v or "" for k, v in texts.items() if k is not None}
    assert {r["id"]: r["text"] for r in FS.read_texts(spark, f"{tmp_path}/t", "id").collect()} == want
    some = FS.read_texts(spark, f"{tmp_path}/t", "id", df.where("id in ('a/b', '7', 'n5')").select("id"))
    assert {r["id"] for r in some.collect()} == {"a/b", "7", "n5"}
    FS.write_texts(df, "id", "body", f"{tmp_path}/t")  # a repeated task replaces its files
    assert FS.read_texts(spark, f"{tmp_path}/t", "id").count() == len(want)
    df.where("id like 'n%'").select("id", "body").write.partitionBy("id").text(f"{tmp_path}/u")
    assert {r["id"]: r["text"] for r in FS.read_texts(spark, f"{tmp_path}/u", "id").collect()} == {k: v for k, v in want.items() if k[0] == "n"}


def test_text_files_are_listed_by_tasks_not_by_the_driver(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("text "), "id").alias("body"))
    FS.write_texts(df, "id", "body", f"{tmp_path}/t")
    got = FS.read_texts(spark, f"{tmp_path}/t", "id")
    assert len(got.inputFiles()) < 100  # the planner knows the stored listing, no text file
    assert sum(f.is_file() for f in (tmp_path / "t").rglob("*")) == 2000 == got.where("text = 'text ' || id").distinct().count()
    q = E.queries()["src_wholetext_join"](spark, SF_SMALL)
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert len(q.inputFiles()) < n / 2
    want = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id", "lang", "length(text)")
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, want.collect()))
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" in plan[plan.index("Join Inner"):] and "length(" not in plan[:plan.index("Join Inner")]  # no text is shuffled
    # the listing is small, the texts need not be: neither side of a join sends them through the driver
    for j in (got.join(df, "id"), df.join(got, "id")):
        assert "BroadcastExchange" not in j._jdf.queryExecution().executedPlan().toString() and j.count() == 2000


def test_listed_text_files_of_any_depth_and_name(spark, tmp_path, monkeypatch):
    names = ["a b", "p%20q", "é", "100%", "sub/deep/z", "sub/[x]#?", "text-007/p%2Bq%20r", "empty"]
    for n in [*names, "_hidden", ".hidden", "_no/x", ".no/y"]:
        (tmp_path / "t" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / f"{n}.txt").write_bytes(b"" if n == "empty" else f"{n}\n\n".encode())
    (tmp_path / "t/notes.md").write_text("not one")
    (tmp_path / "t/nothing").mkdir()
    os.symlink(tmp_path / "nowhere", tmp_path / "t/broken.txt")
    monkeypatch.setattr(FS, "ENTRIES", 2)
    monkeypatch.setattr(FS, "HELD", 8)
    got = [(r["id"], r["text"]) for r in FS.read_texts(spark, f"file://{tmp_path}/t", "id").collect()]
    key = lambda n: "p+q r" if n.startswith("text") else n.split("/")[-1]
    assert sorted(got) == sorted((key(n), "" if n == "empty" else f"{n}\n") for n in names)
    ids = spark.createDataFrame([("a b",), ("100%",), ("p+q r",), ("[x]#?",), ("none",)], "path string")
    assert {r["path"] for r in FS.read_texts(spark, f"{tmp_path}/t", "path", ids).collect()} == {"a b", "100%", "p+q r", "[x]#?"}
    monkeypatch.setattr(FS, "LISTED", 2)  # more ids are joined to the listing
    assert {r["path"] for r in FS.read_texts(spark, f"{tmp_path}/t", "path", ids).collect()} == {"a b", "100%", "p+q r", "[x]#?"}
    assert FS.read_texts(spark, f"{tmp_path}/t/nothing", "id").count() == 0


def test_template_by_position(spark):
    rng = np.random.default_rng(2)
    template = spark.createDataFrame([(int(i), -1.0, "x") for i in rng.permutation(500)], "id int, target double, note string").repartition(5)
    values = spark.createDataFrame([(float(v), int(k)) for k, v in enumerate(rng.permutation(480))], "score double, id int").repartition(3)
    got = {r.id: r.target for r in R.fill_template(template, "id", values, F.col("score").desc(), {"target": "score"}).collect()}
    assert got == {i: (479.0 - i if i < 480 else None) for i in range(500)}
    longer = R.fill_template(template.where("id < 3"), "id", values, "score", {"target": "score"})
    assert longer.columns == template.columns and sorted((r.id, r.target) for r in longer.collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)]
    assert R.fill_template(template.limit(0), "id", values, "score", {"target": "score"}).count() == 0


def test_submission_scores_unseen_documents_in_order(spark):
    got = E.queries()["ml_submission"](spark, SF_SMALL).collect()
    direct = {r.doc_id: r.quality_pred for r in E.queries()["gbt_classify"](spark, SF_SMALL).collect()}
    assert {r.doc_id: r.quality for r in got} == direct and [r.doc_id for r in got] == sorted(direct)
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    assert not labelled & set(direct)


DAY0 = datetime.date(2015, 1, 1)


def known_series(spark, years=4, per_day=2, noise=0.3):
    """Trend with one change of slope, both seasons, two holidays."""
    rng, n = np.random.default_rng(9), 365 * years
    total = n + 364
    t = np.arange(total)
    trend = 10 + 0.01 * t + np.where(t > 0.5 * n, 0.02 * (t - 0.5 * n), 0)
    season = 2 * np.sin(2 * np.pi * t / 7) + 1.5 * np.cos(2 * np.pi * t / 365.25)
    dates = [DAY0 + datetime.timedelta(days=int(i)) for i in t]
    bump = np.array([5.0 if (x.month, x.day) == (12, 25) else -3.0 if (x.month, x.day) == (7, 4) else 0.0 for x in dates])
    rows = [(dates[i], float(trend[i] + season[i] + bump[i] + rng.normal() * noise)) for i in range(n) for _ in range(per_day)]
    hol = [(x, "winter" if x.month == 12 else "summer") for x, b in zip(dates, bump) if b]
    return spark.createDataFrame(rows + [(None, 1.0), (dates[3], None)], "ds date, y double"), spark.createDataFrame(hol, "ds date, holiday string"), trend, season, bump, n


def test_forecast_recovers_a_known_series(spark):
    history, hol, trend, season, bump, n = known_series(spark)
    f = FC.additive_forecast(history, "ds", "y", holidays=hol).toPandas().sort_values("ds").reset_index(drop=True)
    assert len(f) == n + 364 and np.allclose(f.trend + f.weekly + f.yearly + f.holidays, f.yhat)
    assert np.abs(f.holidays - bump).max() < 0.35
    assert np.abs(f.weekly + f.yearly - season)[:n].max() < 0.3
    assert np.abs(f.trend - trend)[:n].max() < 0.6 and abs(f.trend.iloc[-1] - trend[-1]) < 3
    wide = (f.yhat_upper - f.yhat_lower).to_numpy()
    assert np.allclose(wide[:n], 2 * 1.96 * 0.3, rtol=0.1) and (np.diff(wide[n - 1:]) > 0).all()


def test_forecast_without_changes_or_data(spark):
    line = spark.createDataFrame([(DAY0 + datetime.timedelta(days=i), 3.0 + 0.5 * i) for i in range(800)], "ds date, y double")
    f = FC.additive_forecast(line, "ds", "y", horizon=30).toPandas().sort_values("ds")
    assert np.abs(f.yhat - (3.0 + 0.5 * np.arange(830))).max() < 1e-2  # the trend itself is not shrunk
    assert FC.additive_forecast(line.limit(0), "ds", "y").count() == 0
    one = FC.additive_forecast(line.limit(1), "ds", "y", horizon=2).collect()
    assert len(one) == 3


def test_sparse_ridge_is_a_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    y = x @ np.array([1, 2, 0, 0, 0.5, 0, 0, -1.0]) + rng.normal(size=200) * 0.1
    g, c, sq, sparse, pen = x.T @ x, x.T @ y, np.array([0, 0, 0, 0, 0, 0, 3.0, 3.0]), [2, 3, 4, 5], 8.0
    b = FC.sparse_ridge(g, c, sq, sparse, pen)
    cost = lambda v: v @ g @ v / 2 - v @ c + (sq * v * v).sum() / 2 + pen * np.abs(v[sparse]).sum()
    assert (b[[2, 3, 5]] == 0).all() and b[4] > 0.3
    for _ in range(300):
        assert cost(b + rng.normal(size=8) * 10.0 ** rng.uniform(-6, 0)) >= cost(b) - 1e-9


def test_word_cloud_forms_share_a_count_without_joins(spark):
    texts = ["big buses's"] * 40 + ["big buse", "big bus's", "glass s", "ss boss", "bos bosses", "x1 s 12's", "٣ élan élans", "élan"] * 3 + [f"u{i} v{i}" for i in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    got = {r.word: r["count"] for r in W.word_cloud(df, "t").collect()}
    assert got["big buse"] == 43 and "big buses" not in got and "buses" not in got  # the pair in -s goes to the one without
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?)", [[t] for t in texts])
    assert got == dict(con.sql(E.oracle_sql()["word_cloud"]).fetchall())
    assert {r[0]: r[1] for r in df.select(F.explode(W.cloud_words("t")).alias("w")).groupBy("w").count().collect()}["buses"] == 40
    written, real = [], W.stored
    try:
        W.stored = lambda x, name: (written.append((name, x._jdf.queryExecution().optimizedPlan().toString())), real(x, name))[1]
        W.word_cloud(df, "t").collect()
    finally:
        W.stored = real
    assert sum(p.count("Join") for _, p in written) == 2  # only the two counts of a pair's words are looked up


def test_word_cloud_rules(spark):
    texts = ["red cars and 2020 red car's wheels"] * 40 + ["blue glass, glass 7"] * 30 + ["car", "cars", None, "", "the and 12"] + [f"w{i} other{i}" for i in range(200)]
    got = {r.word: r["count"] for r in W.word_cloud(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert "2020" not in got and "the" not in got and "cars" not in got and "car's" not in got
    # "red cars" and "red car" are one collocation, which takes its 80 off both words; "glass" keeps its -ss
    assert got["red car"] == 80 and "red" not in got and got["car wheels"] == 40 and "wheels" not in got
    assert got["blue glass"] == 30 and got["glass glass"] == 30 and got["w3"] == 1


@pytest.mark.parametrize("digits", [1, 3, 5])
def test_significant_digits(spark, digits):
    xs = [0.0, 1.0, -1.0, 12.3456, 99.96, 999.6, 1234567.0, 0.00012345, 0.000012345, -0.5, 100.0, 1e22, 1e-300, 5e-5, float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = {r.x: r.s for r in df.select("x", T.significant("x", digits).alias("s")).collect()}
    assert got.pop(None) is None
    assert got == {x: f"{x:.{digits}g}" for x in xs}
    assert df.select(T.significant(F.lit(float("nan")))).first()[0] == "nan" and not math.isnan(got[0.0] == "0")
