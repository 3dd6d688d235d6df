"""Files, answers and logs, and the operators that only people call."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from idiolect.operators import profile, render, scoring
from idiolect.plans import fixtures as fx
from idiolect.sources import evidence, files


def test_files_are_samples_and_blank_ones_are_counted(spark, tmp_path):
    for name, text in (("a.txt", "One line.\nAnother."), ("b.md", " \n\t"), ("c.txt", ""), ("d.txt", "Ünï")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = [str(tmp_path / n) for n in ("a.txt", "b.md", "d.txt")]
    assert {(r.path.rsplit("/", 1)[1], r.text) for r in files.samples(spark, found).collect()} == {("a.txt", "One line.\nAnother."), ("d.txt", "Ünï")}
    assert files.skipped(spark, found) == 1


def test_home_is_the_argument_or_the_variable_or_the_users(monkeypatch):
    monkeypatch.setenv("IDIOLECT_HOME", "/there")
    assert files.home("/here") == "/here" and files.home() == "/there"
    monkeypatch.delenv("IDIOLECT_HOME")
    assert files.home().endswith("/.idiolect")


def test_answers_are_an_object(spark):
    good = spark.createDataFrame([(1, '{"a": "x", "b": 7}'), (2, "{}")], "n int, value string")
    assert sorted(map(tuple, files.answers(good).collect())) == [(1, "a", "x"), (1, "b", "7")]
    for bad in ("[1]", "{", "text"):
        with pytest.raises(PySparkException, match="not a JSON object"):
            files.answers(spark.createDataFrame([(1, bad)], "n int, value string")).collect()


def test_answered_pairs_in_the_order_of_the_log(spark):
    log = spark.createDataFrame(
        [("w", 1, "calibration_choice", "choice_thus"), ("w", 2, "writing_sample", "choice_hence"), ("w", 3, "calibration_choice", "choice_thus"), ("w", 4, "calibration_choice", "choice_hence")],
        "writer string, seq long, kind string, source string",
    )
    assert [tuple(r) for r in evidence.answered_pairs(log, ["writer"]).orderBy("since").collect()] == [("w", "choice_thus", 1), ("w", "choice_hence", 4)]


def test_explained_results_are_sorted_and_whole(spark):
    samples = profile.usable(fx.frame(spark, fx.SAMPLES, "writer string, seq long, context string, text string"))
    scored = profile.score_groups(samples, ["writer"])[1].where("writer = 'ada'")
    plain = {r.dimension: r for r in scored.collect()}
    told = {r.dimension: r for r in scoring.explained(scored).collect()}
    assert set(told) == set(scoring.NAMES)
    for d, r in told.items():
        assert [tuple(c) for c in r.contributions] == sorted(plain[d].contributions.items())
        assert tuple(r.confidence_factors) == (plain[d].ceiling, plain[d].coverage, plain[d].consistency) and r.sample_values == plain[d].sample_values


def test_confident_dimensions(spark):
    style = spark.createDataFrame([([("warmth", 5, 0.45), ("humour", 9, 0.44), ("hedging", 1, 0.9)],)], "style array<struct<dimension:string,value:int,confidence:double>>")
    assert style.select(profile.confident(F.col("style"), 0.45).alias("d")).first().d == ["warmth", "hedging"]


def test_context_report(spark):
    kind = "array<struct<dimension:string,value:int,confidence:double>>"
    flat = [("formality", 50, 0.9), ("warmth", 40, 0.9), ("humour", 30, 0.9), ("hedging", 20, 0.9), ("technicality", 53, 0.9)]
    work = [("formality", 82, 0.9), ("warmth", 8, 0.45), ("humour", 99, 0.44), ("hedging", 30, 0.8), ("technicality", 28, 0.7)]
    rows = [("w", flat, [("work", work, (2, 1862)), ("home", flat, (1, 352))]), ("x", flat, [])]
    p = spark.createDataFrame(rows, f"writer string, style {kind}, contexts array<struct<context:string,style:{kind},metadata:struct<sample_count:long,word_count:long>>>")
    told = {r.writer: r.report for r in render.context_report(p, "tool").collect()}
    assert told == {"w": """\
  How that shifts by context
    home  (1 sample, 352 words)
      much like your overall voice, so far
    work  (2 samples, 1,862 words)
      Formality           82  +32 vs overall
      Warmth               8  -32 vs overall
      Technicality        28  -25 vs overall
      and 1 more
  Write for one of these with: tool prompt --context NAME"""}  # fmt: skip
